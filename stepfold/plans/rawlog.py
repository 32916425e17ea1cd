"""The driver's `events` as a raw command log: JSON in the many shapes that logs have, and what it says, in SQL.

A case is a user's week, as in `events`, but each step is a command and a response as JSON text, read by the
whole path (`normalise`, `fold.state`, the cascade). From event type, k and q (the value's whole part modulo
12) come method, status, target, cells, columns and payloads; `STEPS` says how. The JSON of a step varies:
methods as names, objects or under other keys, statuses as words, objects, lists or not at all, targets as
objects or plain ids, numbers as text. The SQL never sees the JSON: it derives from the same columns what
the accessors should find, and what the rules should say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.operators.sequence import number_steps

# What a step is; written so that Spark and DuckDB read it alike.
METHOD = """CASE WHEN k = 97 THEN '' WHEN k = 98 THEN 'random'
  WHEN event_type = 'signup' THEN CASE WHEN k % 5 = 0 THEN 'genkey' WHEN k % 7 = 1 THEN 'activate' ELSE 'startsession' END
  WHEN event_type = 'error' THEN CASE WHEN k % 9 = 1 THEN 'authenticate' ELSE 'endsession' END
  WHEN event_type = 'view' THEN CASE WHEN k % 11 = 3 THEN 'properties' ELSE 'get' END
  WHEN event_type = 'click' THEN 'set' WHEN k % 2 = 0 THEN 'write' ELSE 'read' END"""
STATUS = """CASE WHEN k = 96 THEN CASE WHEN method IN ('read', 'write') THEN 'success' ELSE '' END
  WHEN k % 7 = 0 THEN 'notauthorized' WHEN k % 11 = 0 THEN 'invalidparameter' WHEN k % 13 = 5 THEN 'fail' ELSE 'success' END"""
#: Name, id and kind of the object that a step is addressed to.
TARGET = """CASE WHEN method IN ('get', 'set') THEN CASE k % 4 WHEN 0 THEN 'Locking_Range1' WHEN 1 THEN '' WHEN 2 THEN 'C_PIN_SID' ELSE 'MBRControl' END
  WHEN method = 'genkey' OR (method = 'activate' AND k % 3 = 1) THEN 'K_AES'
  WHEN (method = 'activate' AND k % 3 = 0) OR (method = 'properties' AND k % 5 = 2) THEN 'SP_Locking' WHEN method = 'activate' THEN 'SP_Other'
  WHEN method IN ('properties', 'startsession') THEN 'Session Manager UID' WHEN method = 'authenticate' THEN 'Authority_Admin1' ELSE '' END"""
UID = """CASE WHEN method IN ('get', 'set') THEN CASE k % 4 WHEN 0 THEN '00 00 08 02 00 03 00 01' WHEN 1 THEN '00 00 08 02 00 03 00 02' WHEN 2 THEN '00 00 00 0B 00 00 00 01' ELSE '00 00 08 03 00 00 00 01' END
  WHEN target = 'K_AES' THEN '00 00 08 06 00 03 00 01' WHEN target = 'SP_Locking' THEN '00 00 02 05 00 00 00 02' WHEN target = 'SP_Other' THEN '00 00 00 06 00 00 00 02'
  WHEN target = 'Session Manager UID' THEN '00 00 00 00 00 00 00 FF' WHEN target = 'Authority_Admin1' THEN '00 00 00 09 00 00 00 01' ELSE '' END"""
#: The first and last column of a Get; `reversed` ones end before they start, in one object.
FIRST = "CASE k % 4 WHEN 2 THEN 3 WHEN 3 THEN 1 + v % 2 ELSE 3 + v END"
LAST = "first + CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END"
CHALLENGE = "CASE WHEN method <> 'startsession' THEN '' WHEN k % 13 = 0 THEN repeat('a', 33) WHEN k % 13 = 1 THEN concat('pw', CAST(k % 4 AS STRING), 'xx') ELSE '' END"
PAYLOAD = """CASE WHEN k % 17 = 0 THEN '' WHEN method = 'write' THEN concat('p', CAST(k % 4 AS STRING)) WHEN method <> 'read' OR status <> 'success' THEN ''
  WHEN q % 3 = 0 THEN concat('p', CAST(k % 4 AS STRING)) WHEN q % 3 = 1 THEN concat('Pattern p', CAST(k % 4 AS STRING)) ELSE concat('zz', CAST(q AS STRING)) END"""
STEPS = {"method": METHOD, "status": STATUS, "target": TARGET, "uid": UID, "v": "CAST(floor(k / 4) AS BIGINT) % 5", "first": FIRST, "last": LAST, "challenge": CHALLENGE, "payload": PAYLOAD}


def _in_duckdb(expr: str) -> str:
    return expr.replace("AS STRING", "AS VARCHAR")


def _layers(source: str) -> str:
    """The columns of STEPS, each from those before it."""
    out, at = [], source
    for name, expr in STEPS.items():
        out.append(f'{name}_ AS (SELECT *, {_in_duckdb(expr)} AS "{name}" FROM {at})')
        at = f"{name}_"
    return ",\n".join(out)


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, step_idx and the columns of STEPS of each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, q = F.regexp_extract("props", "([0-9]+)", 1).cast("long"), F.floor("value") % 12
    e = e.select("event_id", "ts", (F.col("user_id") * 100 + F.weekofyear("ts")).alias("case_id"), "event_type", k.alias("k"), q.alias("q"))
    for name, expr in STEPS.items():
        e = e.withColumn(name, F.expr(expr))
    return number_steps(e, "case_id", "ts", "event_id")


# How a step is written, as Spark expressions over its columns.
_SAID = "CASE WHEN k = 96 THEN 'SP_BUSY' WHEN status = 'success' THEN 'SUCCESS' WHEN status = 'notauthorized' THEN 'NOT_AUTHORIZED' WHEN status = 'invalidparameter' THEN 'INVALID_PARAMETER' ELSE 'FAIL' END"
_STATUS = """CASE WHEN k = 96 OR q % 5 = 0 THEN concat('"status_codes": "', said, '"') WHEN q % 5 = 1 THEN concat('"status": "', said, '"') WHEN q % 5 = 2 THEN concat('"status": {"name": "', said, '"}')
  WHEN q % 5 = 3 THEN concat('"Status": {"code": {"Name": "', said, '"}}') ELSE concat('"status_codes": ["', said, '"]') END"""
_NAMED = "CASE method WHEN 'startsession' THEN 'StartSession' WHEN 'endsession' THEN 'EndSession' WHEN 'genkey' THEN 'GenKey' ELSE initcap(method) END"
_METHOD = """CASE WHEN q % 3 = 0 THEN concat('"method": {"name": "', named, '", "args": ', args, '}') WHEN q % 3 = 1 THEN concat('"method": "', named, '", "args": ', args) ELSE concat('"MethodName": {"uid": 7, "Name": "', named, '"}, "args": ', args) END"""
_INVOKING = """CASE WHEN uid = '' THEN '' WHEN target = '' AND k % 8 = 1 THEN concat(', "invoking": "', uid, '"') WHEN target = '' THEN concat(', "invoking_id": {"uid": "', uid, '"}')
  WHEN k % 3 = 0 THEN concat(', "invoking_id": {"uid": "', uid, '", "name": "', target, '"}') ELSE concat(', "InvokingUID": {"name": "', target, '", "uid": "', uid, '"}') END"""
_CELLS = """CASE WHEN k % 4 = 2 THEN concat('[{"3": "pw', q % 4, 'xx"}]') WHEN k % 4 = 3 AND v % 2 = 0 THEN concat('[{"1": ', q % 3, '}]') WHEN k % 4 = 3 THEN '[{"2": "T"}]'
  WHEN v = 0 THEN '[{"5": 1, "7": 1}]' WHEN v = 1 THEN '[{"6": 1}, {"8": true}]' WHEN v = 2 THEN concat('[{"3": ', q, '}]') WHEN v = 3 THEN '[{"5": 1}, {"5": 0}]' ELSE concat('[{"7": ', q % 3, '}]') END"""
_BLOCK = """CASE WHEN k % 14 = 1 THEN concat('{"startColumn": ', first + 2, ', "endColumn": ', first, '}') WHEN last = first THEN concat('[{"startColumn": ', first, '}]')
  WHEN q % 2 = 1 THEN concat('[{"startColumn": "', first, '"}, {"endColumn": "', last, '"}]') ELSE concat('[{"startColumn": ', first, '}, {"endColumn": ', last, '}]') END"""
_ARGS = """CASE method WHEN 'set' THEN CASE WHEN q % 2 = 0 THEN concat('{"required": {}, "optional": {"Values": ', cells, '}}') ELSE concat('{"RowValues": ', cells, '}') END
  WHEN 'get' THEN concat('{"required": {"Cellblock": ', block, '}}')
  WHEN 'startsession' THEN concat('{"required": {"HostSessionID": ', k % 4 + 1, ', "SPID": "0000020500000001", "Write": 1}, "optional": {', CASE WHEN challenge = '' THEN '' ELSE concat('"HostChallenge": "', challenge, '"') END, '}}')
  ELSE '{}' END"""
_INPUT = """CASE WHEN method = '' THEN '{"note": "zz"}'
  WHEN method IN ('read', 'write') THEN concat('{"command": "', named, '", "args": {', CASE WHEN q % 2 = 0 THEN concat('"LBA": ', k % 8) ELSE concat('"startLBA": "', k % 8, '"') END,
    CASE WHEN method = 'read' OR payload = '' THEN '' WHEN q % 2 = 0 THEN concat(', "pattern": "', payload, '"') ELSE concat(', "data": " ', payload, '"') END, '}}')
  ELSE concat('{', method_json, invoking, CASE WHEN method = 'endsession' AND k % 3 = 0 THEN concat(', "SessionID": "0000000', k % 4 + 1, '"') ELSE '' END, '}') END"""
_SHOWN = """concat('[[{', array_join(transform(sequence(first, CASE WHEN q % 4 = 3 AND last > first THEN last - 1 ELSE last END), j -> concat('"', j, '": ', (q + j) % 3)), ', '), '}]]')"""
_RETURNED = """CASE WHEN method = 'startsession' AND status = 'success' THEN concat('{"required": {"HostSessionID": "0000000', CASE WHEN k % 19 = 0 THEN 9 ELSE k % 4 + 1 END, '"', CASE WHEN k % 23 = 0 THEN '' ELSE ', "SPSessionID": "00001001"' END, '}, "optional": {}}')
  WHEN method IN ('genkey', 'activate', 'set', 'endsession') THEN CASE WHEN k % 12 = 0 THEN '[{"x": 1}]' WHEN q % 2 = 0 THEN '[]' ELSE '{"required": {}, "optional": {}}' END
  WHEN method = 'get' AND status = 'success' AND k % 10 <> 0 AND k % 14 <> 1 THEN shown WHEN method = 'properties' AND k % 3 <> 0 THEN '[{"Properties": {"MaxMethods": 1}}]' WHEN method = 'authenticate' THEN '[true]' ELSE '[]' END"""
_OUTPUT = """CASE WHEN method IN ('read', 'write') THEN concat('{"command": "', CASE WHEN k % 23 <> 0 THEN named WHEN method = 'read' THEN 'Write' ELSE 'Read' END, '", "args": {', CASE WHEN method = 'read' AND payload <> '' THEN concat('"result": "', payload, '"') ELSE '' END, '}',
    CASE WHEN status = 'success' AND q % 5 = 0 THEN '' ELSE concat(', ', status_json) END, '}')
  WHEN method = 'startsession' AND status = 'success' THEN concat('{"method": {"name": "', CASE WHEN k % 29 = 0 THEN 'Get' ELSE 'SyncSession' END, '"}, "return_values": ', returned, ', ', status_json, '}')
  ELSE concat('{"return_values": ', returned, ', ', status_json, '}') END"""
_WRITTEN = {
    "said": _SAID, "status_json": _STATUS, "named": _NAMED, "cells": _CELLS, "block": _BLOCK, "args": _ARGS, "method_json": _METHOD,
    "invoking": _INVOKING, "shown": _SHOWN, "returned": _RETURNED, "input": _INPUT, "output": _OUTPUT,
}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, step_idx, input, output: the log as JSON."""
    d = typed(spark, sf_dir)
    for name, expr in _WRITTEN.items():
        d = d.withColumn(name, F.expr(expr))
    return d.select("case_id", "step_idx", "input", "output")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, raw: the same log as one JSON document a case, as files hold it."""
    step = F.struct("step_idx", F.concat(F.lit('{"input": '), "input", F.lit(', "output": '), "output", F.lit("}")).alias("r"))
    lines = records(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_list(step)).alias("a"))
    return lines.select("case_id", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["r"]), ", "), F.lit("]")).alias("raw"))


# What a reader of the JSON should find, from the columns alone.
_COMPACT = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
RAW_SQL = f"""e_ AS (SELECT event_id, ts, user_id * 100 + weekofyear(ts) AS case_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(floor(value) AS BIGINT) % 12 AS q FROM events),
{_layers('e_')},
t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) - 1 AS step_idx, count(*) OVER (PARTITION BY case_id) AS n_steps,
  CASE WHEN target = '' THEN {_COMPACT.format('uid')} ELSE {_COMPACT.format('target')} END AS invoking, {_COMPACT.format('uid')} AS invoking_uid,
  CASE WHEN target IN ('Locking_Range1', 'SP_Locking') OR starts_with(uid, '00 00 08 02') THEN 'locking' WHEN target = 'C_PIN_SID' THEN 'cpin' WHEN target = 'MBRControl' THEN 'mbrcontrol' WHEN target = 'Authority_Admin1' THEN 'authority' ELSE '' END AS kind,
  CASE WHEN method <> 'set' THEN [] WHEN k % 4 = 2 THEN ['3'] WHEN k % 4 = 3 THEN [CASE WHEN v % 2 = 0 THEN '1' ELSE '2' END] WHEN v = 0 THEN ['5', '7'] WHEN v = 1 THEN ['6', '8'] WHEN v = 2 THEN ['3'] WHEN v = 3 THEN ['5'] ELSE ['7'] END AS set_columns,
  CASE WHEN method <> 'set' THEN [] WHEN k % 4 = 2 THEN ['pw' || CAST(q % 4 AS VARCHAR) || 'xx'] WHEN k % 4 = 3 THEN [CASE WHEN v % 2 = 0 THEN CAST(q % 3 AS VARCHAR) ELSE 'T' END]
       WHEN v = 0 THEN ['1', '1'] WHEN v = 1 THEN ['1', 'True'] WHEN v = 2 THEN [CAST(q AS VARCHAR)] WHEN v = 3 THEN ['0'] ELSE [CAST(q % 3 AS VARCHAR)] END AS set_values,
  CASE WHEN method <> 'set' OR k % 4 <> 2 THEN [] WHEN q % 3 = 2 THEN ['pw' || CAST(q % 4 AS VARCHAR) || 'xx', 'MethodName'] ELSE ['pw' || CAST(q % 4 AS VARCHAR) || 'xx'] END AS set_secrets, -- an unknown word may be a secret
  CASE WHEN method = 'get' AND k % 14 <> 1 THEN list_transform(range(first, last + 1), lambda j: CAST(j AS VARCHAR)) ELSE [] END AS requested,
  CASE WHEN method = 'get' AND status = 'success' AND k % 10 <> 0 AND k % 14 <> 1 THEN list_transform(range(first, CASE WHEN q % 4 = 3 AND last > first THEN last ELSE last + 1 END), lambda j: CAST(j AS VARCHAR)) ELSE [] END AS shown,
  method = 'set' AND k % 4 IN (0, 1) AND v = 3 AS repeated, method = 'set' AND ((k % 4 IN (0, 1) AND v = 4) OR (k % 4 = 3 AND v % 2 = 0)) AND q % 3 = 2 AS bad_bool,
  method = 'get' AND k % 14 = 1 AS reversed, '0000000' || CAST(CASE WHEN k % 19 = 0 THEN 9 ELSE k % 4 + 1 END AS VARCHAR) AS opened,
  CASE WHEN method = 'endsession' AND k % 3 = 0 THEN '0000000' || CAST(k % 4 + 1 AS VARCHAR) ELSE '' END AS closed,
  CASE WHEN method IN ('genkey', 'activate', 'set', 'endsession') THEN k % 12 <> 0 WHEN method = 'startsession' THEN status <> 'success' WHEN method = 'get' THEN status <> 'success' OR k % 10 = 0 OR k % 14 = 1
       WHEN method = 'properties' THEN k % 3 = 0 WHEN method = 'authenticate' THEN false ELSE true END AS returns_nothing,
  CASE WHEN method IN ('read', 'write') THEN CAST(k % 8 AS VARCHAR) ELSE 'default' END AS address FROM payload_)"""

#: Steps before a case's last, and the state that they leave.
STATE_SQL = f"""{RAW_SQL},
z AS (SELECT * FROM t WHERE step_idx = n_steps - 1),
p AS (SELECT * FROM t WHERE step_idx < n_steps - 1 AND status = 'success'),
opens AS (SELECT case_id, opened AS sid, max(step_idx) AS at FROM p WHERE method = 'startsession' GROUP BY ALL),
closes AS (SELECT case_id, closed AS sid, max(step_idx) AS at FROM p WHERE method = 'endsession' AND closed <> '' GROUP BY ALL),
alls AS (SELECT case_id, max(step_idx) AS at FROM p WHERE method = 'endsession' AND closed = '' GROUP BY ALL),
act AS (SELECT o.case_id, count(*) AS n FROM opens o LEFT JOIN closes c USING (case_id, sid) LEFT JOIN alls a ON a.case_id = o.case_id WHERE o.at > coalesce(c.at, -1) AND o.at > coalesce(a.at, -1) GROUP BY ALL),
lastopen AS (SELECT case_id, arg_max(k % 13 <> 0, step_idx) AS fine FROM p WHERE method = 'startsession' GROUP BY ALL),
setting AS (SELECT case_id, step_idx, kind, invoking || ':' || invoking_uid AS object_key, unnest(set_columns) AS col, unnest(set_values) AS val FROM p WHERE method = 'set'),
known AS (SELECT case_id, object_key, col, arg_max(val, step_idx) AS val FROM setting GROUP BY ALL),
locks AS (SELECT case_id, bool_or(col = '5' AND lower(val) IN ('1', 't', 'true')) AND bool_or(col = '7' AND lower(val) IN ('1', 't', 'true')) AS lock_read,
    bool_or(col = '6' AND lower(val) IN ('1', 't', 'true')) AND bool_or(col = '8' AND lower(val) IN ('1', 't', 'true')) AS lock_write FROM known WHERE contains(object_key, 'locking') GROUP BY ALL),
secrets AS (SELECT case_id, list(DISTINCT val) AS secrets FROM (SELECT case_id, unnest(set_secrets) AS val FROM p) GROUP BY ALL),
sps AS (SELECT case_id, count(DISTINCT invoking) AS n_sps FROM p WHERE method = 'activate' AND contains(invoking, 'sp') GROUP BY ALL),
fields AS (SELECT case_id, count(*) AS n_fields FROM known GROUP BY ALL),
writes AS (SELECT case_id, address, arg_max(payload, step_idx) AS payload FROM p WHERE method = 'write' AND payload <> '' GROUP BY ALL),
keys AS (SELECT case_id, coalesce(max(step_idx) FILTER (method = 'genkey') > coalesce(max(step_idx) FILTER (method = 'write'), -1)
    AND min(step_idx) FILTER (method = 'write' AND payload <> '') < max(step_idx) FILTER (method = 'genkey'), false) AS fresh FROM p GROUP BY ALL),
errors AS (SELECT case_id, arg_max(status, step_idx) AS last_error FROM t WHERE step_idx < n_steps - 1 AND status <> 'success' GROUP BY ALL),
stale AS (SELECT DISTINCT case_id FROM (SELECT case_id, invoking || ':' || invoking_uid AS object_key, q, unnest(list_intersect(requested, shown)) AS col FROM z) g JOIN known USING (case_id, object_key, col)
    WHERE {_COMPACT.format('val')} <> CAST((q + CAST(col AS BIGINT)) % 3 AS VARCHAR)),
j AS (SELECT z.*, coalesce(act.n, 0) AS n_active, coalesce(act.n, 0) > 0 AND coalesce(fine, false) AS authed, coalesce(lock_read, false) AS lock_read, coalesce(lock_write, false) AS lock_write,
    coalesce(secrets.secrets, []) AS secrets, coalesce(n_sps, 0) AS n_sps, coalesce(n_fields, 0) AS n_fields, coalesce(writes.payload, '') AS expected, coalesce(fresh, false) AS fresh, coalesce(last_error, '') AS last_error, stale.case_id IS NOT NULL AS is_stale
    FROM z LEFT JOIN act USING (case_id) LEFT JOIN lastopen USING (case_id) LEFT JOIN locks USING (case_id) LEFT JOIN secrets USING (case_id) LEFT JOIN sps USING (case_id) LEFT JOIN fields USING (case_id)
    LEFT JOIN writes ON writes.case_id = z.case_id AND writes.address = z.address LEFT JOIN keys ON keys.case_id = z.case_id LEFT JOIN errors ON errors.case_id = z.case_id LEFT JOIN stale ON stale.case_id = z.case_id)"""

#: The cascade, once as it is (mutant_id '') and once for each mutant, whose switch `sw` turns a check off.
RULES_SQL = f"""{STATE_SQL},
mutant AS (SELECT * FROM (VALUES ('', ''), ('NO_STARTSESSION_FINAL', 'startsession'), ('NO_KNOWN_FIELD_EXPECTED_SUCCESS', 'known_field_success'), ('NO_GET_PAYLOAD', 'get_payload'), ('NO_READ_PAYLOAD', 'read_payload'), ('NO_PRECONDITION_ERROR', 'precondition'),
  ('NO_PROPERTIES_PAYLOAD', 'properties_payload'), ('NO_EMPTY_RESULT', 'empty_result'), ('NO_LOCKING_DATA_ACCESS', 'locking'), ('NO_ACTIVATE_TARGET', 'activate_target'), ('NO_PROPERTIES_TARGET', 'properties_target'), ('NO_DISABLED_AUTHORITY', 'disabled_authority'),
  ('ALWAYS_PASS', 'always_pass'), ('ALWAYS_FAIL', 'always_fail')) m(mutant_id, sw)),
x AS (SELECT *, status = 'success' AS ok, method = 'activate' AND k % 3 <> 0 AND sw <> 'activate_target' AS bad_target,
  CASE WHEN method IN ('get', 'set', 'activate', 'genkey', 'endsession') AND n_active = 0 THEN 'notauthorized' WHEN method IN ('set', 'activate', 'genkey') AND NOT authed THEN 'notauthorized' WHEN reversed OR repeated OR bad_bool THEN 'invalidparameter'
       WHEN method = 'activate' AND k % 3 <> 0 AND sw <> 'activate_target' THEN 'invalidparameter' END AS wanted FROM j CROSS JOIN mutant),
y AS (SELECT *, wanted IS NOT NULL AND sw <> 'precondition' AS asked, sw <> 'locking' AND ((method = 'read' AND lock_read) OR (method = 'write' AND lock_write)) AS blocked,
  (method = 'set' AND kind <> '') OR (method = 'get' AND len(requested) > 0 AND CASE kind WHEN 'locking' THEN first >= 3 AND last <= 8 WHEN 'cpin' THEN last = 3 ELSE last <= 2 END) AS accessible FROM x),
r AS (SELECT *, CASE WHEN method = '' OR status = '' THEN 'PARSE_FINAL_COMMAND' WHEN method = 'properties' AND k % 5 = 2 AND sw <> 'properties_target' THEN 'PROPERTIES_TARGET' WHEN method = 'properties' THEN 'PROPERTIES_PAYLOAD'
  WHEN method = 'startsession' THEN 'STARTSESSION_FINAL' WHEN blocked THEN 'LOCKING_DATA_ACCESS' WHEN asked AND bad_bool THEN 'KNOWN_FIELD_INVALID_VALUE' WHEN asked THEN 'PRECONDITION_EXPECTED_ERROR' WHEN NOT ok AND accessible THEN 'KNOWN_FIELD_EXPECTED_SUCCESS'
  WHEN NOT ok AND method IN ('get', 'set', 'activate', 'genkey', 'read', 'write', 'endsession') THEN 'UNEXPECTED_ERROR_STATUS' WHEN bad_target THEN 'ACTIVATE_TARGET' WHEN method = 'activate' THEN 'ACTIVATE_PAYLOAD'
  WHEN method = 'endsession' THEN 'ENDSESSION_PAYLOAD' WHEN method = 'set' THEN 'SET_PAYLOAD' WHEN method = 'read' THEN 'READ_PAYLOAD' WHEN method = 'write' THEN 'WRITE_RESPONSE' WHEN method = 'genkey' THEN 'GENKEY_PAYLOAD' WHEN method = 'get' THEN 'GET_PAYLOAD'
  WHEN method = 'authenticate' AND ok AND n_active = 0 THEN 'AUTHENTICATE_NO_SESSION' WHEN method = 'authenticate' AND ok THEN 'AUTHENTICATE_SUCCESS' ELSE 'DEFAULT_PASS' END AS final_rule_id FROM y),
u AS (SELECT *, CASE final_rule_id WHEN 'PARSE_FINAL_COMMAND' THEN true WHEN 'PROPERTIES_TARGET' THEN true WHEN 'PROPERTIES_PAYLOAD' THEN NOT ok OR (k % 3 = 0 AND sw <> 'properties_payload')
  WHEN 'STARTSESSION_FINAL' THEN sw <> 'startsession' AND CASE WHEN k % 13 = 0 THEN ok WHEN challenge <> '' AND len(secrets) > 0 AND NOT list_contains(secrets, challenge) THEN status <> 'notauthorized' ELSE NOT ok OR k % 19 = 0 OR k % 23 = 0 OR k % 29 = 0 END
  WHEN 'LOCKING_DATA_ACCESS' THEN status NOT IN ('fail', 'notauthorized') WHEN 'KNOWN_FIELD_INVALID_VALUE' THEN status <> wanted WHEN 'PRECONDITION_EXPECTED_ERROR' THEN status <> wanted WHEN 'KNOWN_FIELD_EXPECTED_SUCCESS' THEN true WHEN 'UNEXPECTED_ERROR_STATUS' THEN true WHEN 'ACTIVATE_TARGET' THEN true
  WHEN 'READ_PAYLOAD' THEN sw <> 'read_payload' AND (k % 23 = 0 OR payload = '' OR CASE WHEN fresh AND expected <> '' THEN payload IN (expected, 'Pattern ' || expected) WHEN fresh THEN length(payload) <= 2 WHEN expected <> '' THEN payload NOT IN (expected, 'Pattern ' || expected) ELSE false END)
  WHEN 'WRITE_RESPONSE' THEN payload = '' OR k % 23 = 0 WHEN 'GET_PAYLOAD' THEN sw <> 'get_payload' AND len(requested) > 0 AND (len(shown) < len(requested) OR is_stale) WHEN 'AUTHENTICATE_NO_SESSION' THEN true WHEN 'AUTHENTICATE_SUCCESS' THEN false WHEN 'DEFAULT_PASS' THEN false
  ELSE sw <> 'empty_result' AND k % 12 = 0 END AS broken FROM r),
verdict AS (SELECT mutant_id, case_id, CAST(n_steps AS BIGINT) AS n_steps, method, status, final_rule_id,
  CASE WHEN sw = 'always_fail' THEN 'fail' WHEN sw = 'always_pass' OR (sw = 'known_field_success' AND method IN ('get', 'set') AND NOT ok) THEN 'pass' WHEN broken THEN 'fail' ELSE 'pass' END AS prediction FROM u)"""
