"""The driver's `events` as a command log: the encoding that queries and their SQL share.

A case is a user's week. signup opens a session (generates a key where k % 5 = 0), error closes sessions,
view gets, click sets, purchase writes (k even) or reads. From k come also the status, the object, the
table column, the address and the payload; see `steps`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.operators.sequence import number_steps


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed row a step."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    e = e.select("event_id", "ts", (F.col("user_id") * 100 + F.weekofyear("ts")).alias("case_id"), "event_type", "value", k.alias("k"))
    kind, k = F.col("event_type"), F.col("k")
    method = (
        F.when((kind == "signup") & (k % 5 == 0), "genkey").when(kind == "signup", "startsession").when(kind == "error", "endsession")
        .when(kind == "view", "get").when(kind == "click", "set").when(k % 2 == 0, "write").otherwise("read")
    )
    status = F.when(k % 7 == 0, "notauthorized").when(k % 11 == 0, "invalidparameter").otherwise("success")
    d = e.withColumns({"method": method, "status": status})
    return number_steps(d, "case_id", "ts", "event_id").withColumns({
        "sid": F.when(F.col("method") == "startsession", (k % 4).cast("string")).when((F.col("method") == "endsession") & (k % 3 == 0), (k % 4).cast("string")).otherwise(""),
        "object_key": F.concat(F.lit("locking"), (k % 2).cast("string")),
        "column": F.expr("string(3 + (k div 2) % 7)"),
        "cell": (F.floor("value") % 3).cast("string"),
        "address": (k % 8).cast("string"),
        "payload": F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("p"), (k % 4).cast("string"))),
        "step_idx": F.col("step_idx").cast("long"),
    })


#: The same in SQL.
STEPS_SQL = """e0 AS (SELECT event_id, ts, user_id * 100 + weekofyear(ts) AS case_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
ev AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) - 1 AS step_idx, count(*) OVER (PARTITION BY case_id) AS n_steps,
  CASE WHEN event_type = 'signup' AND k % 5 = 0 THEN 'genkey' WHEN event_type = 'signup' THEN 'startsession' WHEN event_type = 'error' THEN 'endsession'
       WHEN event_type = 'view' THEN 'get' WHEN event_type = 'click' THEN 'set' WHEN k % 2 = 0 THEN 'write' ELSE 'read' END AS method,
  CASE WHEN k % 7 = 0 THEN 'notauthorized' WHEN k % 11 = 0 THEN 'invalidparameter' ELSE 'success' END AS status,
  'locking' || CAST(k % 2 AS VARCHAR) AS object_key, CAST(3 + (k // 2) % 7 AS VARCHAR) AS "column", CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS cell,
  CAST(k % 8 AS VARCHAR) AS address, CASE WHEN k % 17 = 0 THEN '' ELSE 'p' || CAST(k % 4 AS VARCHAR) END AS payload FROM e0),
st AS (SELECT *, CASE WHEN method = 'startsession' THEN CAST(k % 4 AS VARCHAR) WHEN method = 'endsession' AND k % 3 = 0 THEN CAST(k % 4 AS VARCHAR) ELSE '' END AS sid FROM ev)"""


def normalised(d: DataFrame) -> DataFrame:
    """The steps in the columns that `fold.state` reads, as `normalise` would give them for real logs."""
    cell = F.struct(F.col("column").alias("column"), F.lit("int").alias("kind"), F.col("cell").alias("text"))
    none = F.array().cast("array<struct<column:string,kind:string,text:string>>")
    empty = F.array().cast("array<string>")
    k, is_ = F.col("k"), lambda *m: F.col("method").isin(*m)
    shown = F.when(k % 10 == 0, none).otherwise(F.array(cell))
    boolean = F.col("column").isin("5", "6", "7", "8")
    wanted = F.col("column").between("3", "8")
    return d.select(
        "case_id", "step_idx", "method", "status", F.col("object_key").alias("invoking"), F.lit("").alias("invoking_uid"), "object_key", F.lit("locking").alias("object_kind"),
        is_("read", "write").alias("is_data_command"), F.when(is_("endsession"), F.col("sid")).otherwise("").alias("session_in"), F.when(is_("startsession"), F.col("sid")).otherwise("").alias("session_out"),
        F.lit("").alias("challenge"), (is_("startsession") & (k % 13 == 0)).alias("challenge_malformed"),
        F.lit("1").alias("host_session_in"), F.when(k % 19 == 0, "2").otherwise("00000001").alias("host_session_out"), F.lit("7").alias("sp_session_out"), F.lit("syncsession").alias("reply_method"),
        F.when(k % 23 == 0, "set").otherwise(F.col("method")).alias("reply_command"), is_("read", "write").alias("has_reply_command"),
        F.when(is_("write"), F.col("payload")).otherwise("").alias("payload_in"), F.when(is_("read"), F.col("payload")).otherwise("").alias("payload_out"), "address",
        (k % 12 != 0).alias("result_empty"), F.lit(False).alias("has_properties"), F.lit(False).alias("mentions_cpin"), empty.alias("secrets"),
        (is_("get") & (k % 14 == 1)).alias("cellblock_invalid"), (is_("set") & (k % 15 == 1)).alias("columns_repeated"),
        F.when(is_("set"), F.array(cell)).otherwise(none).alias("cells_in"), F.when(is_("get"), shown).otherwise(none).alias("cells_out"), F.when(is_("get"), F.array("column")).otherwise(empty).alias("requested"),
        (is_("set") & boolean & (F.col("cell") == "2")).alias("bad_bool"), F.when(is_("get", "set") & wanted, F.concat(F.lit("locking:"), "column")).otherwise("").alias("known_access"),
    )


#: The cascade over the encoded steps: case_id, n_steps, method, status, final_rule_id, prediction.
VERDICTS_SQL = f"""{STEPS_SQL},
l AS (SELECT * FROM st WHERE step_idx = n_steps - 1),
p AS (SELECT st.* FROM st WHERE step_idx < n_steps - 1 AND status = 'success'),
opens AS (SELECT case_id, sid, max(step_idx) AS at FROM p WHERE method = 'startsession' GROUP BY ALL),
closes AS (SELECT case_id, sid, max(step_idx) AS at FROM p WHERE method = 'endsession' AND sid <> '' GROUP BY ALL),
alls AS (SELECT case_id, max(step_idx) AS at FROM p WHERE method = 'endsession' AND sid = '' GROUP BY ALL),
act AS (SELECT o.case_id, count(*) AS n FROM opens o LEFT JOIN closes c USING (case_id, sid) LEFT JOIN alls a ON a.case_id = o.case_id
        WHERE o.at > coalesce(c.at, -1) AND o.at > coalesce(a.at, -1) GROUP BY ALL),
lastopen AS (SELECT case_id, arg_max(k % 13 <> 0, step_idx) AS fine FROM p WHERE method = 'startsession' GROUP BY ALL),
cells AS (SELECT case_id, object_key, "column", arg_max(cell, step_idx) AS cell FROM p WHERE method = 'set' GROUP BY ALL),
locks AS (SELECT case_id, bool_or(r) AS lock_read, bool_or(w) AS lock_write FROM (
   SELECT case_id, object_key, bool_or("column" = '5' AND cell = '1') AND bool_or("column" = '7' AND cell = '1') AS r,
          bool_or("column" = '6' AND cell = '1') AND bool_or("column" = '8' AND cell = '1') AS w FROM cells GROUP BY ALL) GROUP BY ALL),
writes AS (SELECT case_id, address, arg_max(payload, step_idx) AS payload FROM p WHERE method = 'write' AND payload <> '' GROUP BY ALL),
keys AS (SELECT case_id, coalesce(max(step_idx) FILTER (method = 'genkey') > coalesce(max(step_idx) FILTER (method = 'write'), -1)
          AND min(step_idx) FILTER (method = 'write' AND payload <> '') < max(step_idx) FILTER (method = 'genkey'), false) AS fresh FROM p GROUP BY ALL),
j AS (SELECT l.*, coalesce(act.n, 0) > 0 AS in_session, coalesce(act.n, 0) > 0 AND coalesce(lastopen.fine, false) AS authed, coalesce(lock_read, false) AS lock_read, coalesce(lock_write, false) AS lock_write,
        coalesce(writes.payload, '') AS expected, coalesce(keys.fresh, false) AS fresh, cells.cell AS known
      FROM l LEFT JOIN act USING (case_id) LEFT JOIN lastopen USING (case_id) LEFT JOIN locks USING (case_id) LEFT JOIN writes ON writes.case_id = l.case_id AND writes.address = l.address
      LEFT JOIN keys ON keys.case_id = l.case_id LEFT JOIN cells ON cells.case_id = l.case_id AND cells.object_key = l.object_key AND cells."column" = l."column"),
x AS (SELECT *, CASE WHEN method NOT IN ('read', 'write', 'startsession') AND NOT in_session THEN 'notauthorized'
        WHEN method IN ('set', 'genkey') AND NOT authed THEN 'notauthorized' WHEN method = 'get' AND k % 14 = 1 THEN 'invalidparameter'
        WHEN method = 'set' AND (k % 15 = 1 OR ("column" IN ('5', '6', '7', '8') AND cell = '2')) THEN 'invalidparameter' END AS asked FROM j),
r AS (SELECT *, CASE WHEN method = 'startsession' THEN 'STARTSESSION_FINAL'
        WHEN (method = 'read' AND lock_read) OR (method = 'write' AND lock_write) THEN 'LOCKING_DATA_ACCESS'
        WHEN asked IS NOT NULL AND method = 'set' AND "column" IN ('5', '6', '7', '8') AND cell = '2' THEN 'KNOWN_FIELD_INVALID_VALUE'
        WHEN asked IS NOT NULL THEN 'PRECONDITION_EXPECTED_ERROR'
        WHEN status <> 'success' AND method IN ('get', 'set') AND "column" BETWEEN '3' AND '8' THEN 'KNOWN_FIELD_EXPECTED_SUCCESS'
        WHEN status <> 'success' THEN 'UNEXPECTED_ERROR_STATUS' WHEN method = 'endsession' THEN 'ENDSESSION_PAYLOAD' WHEN method = 'set' THEN 'SET_PAYLOAD' WHEN method = 'read' THEN 'READ_PAYLOAD'
        WHEN method = 'write' THEN 'WRITE_RESPONSE' WHEN method = 'genkey' THEN 'GENKEY_PAYLOAD' ELSE 'GET_PAYLOAD' END AS final_rule_id FROM x),
v AS (SELECT case_id, CAST(n_steps AS BIGINT) AS n_steps, method, status, k, final_rule_id, CASE WHEN CASE final_rule_id
        WHEN 'STARTSESSION_FINAL' THEN CASE WHEN k % 13 = 0 THEN status = 'success' ELSE status <> 'success' OR k % 19 = 0 END
        WHEN 'LOCKING_DATA_ACCESS' THEN status NOT IN ('fail', 'notauthorized') WHEN 'KNOWN_FIELD_INVALID_VALUE' THEN status <> asked WHEN 'PRECONDITION_EXPECTED_ERROR' THEN status <> asked
        WHEN 'KNOWN_FIELD_EXPECTED_SUCCESS' THEN true WHEN 'UNEXPECTED_ERROR_STATUS' THEN true
        WHEN 'READ_PAYLOAD' THEN k % 23 = 0 OR payload = '' OR CASE WHEN fresh AND expected <> '' THEN payload = expected WHEN fresh THEN length(payload) <= 2 WHEN expected <> '' THEN payload <> expected ELSE false END
        WHEN 'WRITE_RESPONSE' THEN payload = '' OR k % 23 = 0 WHEN 'GET_PAYLOAD' THEN k % 10 = 0 OR (known IS NOT NULL AND known <> cell)
        ELSE k % 12 = 0 END THEN 'fail' ELSE 'pass' END AS prediction FROM r)"""
