"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepfold.functions import render
from stepfold.functions import text as X
from stepfold.functions import tokens as K
from stepfold.generate import mutations
from stepfold.generate.families import families, with_public
from stepfold.operators import cascade, coverage, fold, metrics, retrieval, sequence
from stepfold.operators.rules import BASELINES
from stepfold.operators.normalise import normalise, object_kind
from stepfold.operators.rules import MUTANTS
from stepfold.plans import rawlog
from stepfold.plans.events import STEPS_SQL, VERDICTS_SQL, normalised, steps
from stepfold.plans.rawlog import RAW_SQL, RULES_SQL, STATE_SQL
from stepfold.plans.verdict import ensemble, kill_report, mutation_report, mutation_runs, score_deltas, verify
from stepfold.plans.verdict import mutation_score as share_killed
from stepfold.sources.reports import case_summaries, mismatches
from stepfold.sources.trajectories import steps_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EV = f"WITH {STEPS_SQL}\n"
VERDICTS = f"WITH {VERDICTS_SQL}\n"


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def verdicts(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return cascade.judge(fold.state(normalised(steps(spark, sf_dir))), **how)


long = lambda c: F.col(c).cast("long").alias(c)


# --- verdicts ----------------------------------------------------------------------------------


@query(EV + """, l AS (SELECT * FROM st WHERE step_idx = n_steps - 1),
s AS (SELECT case_id, max(step_idx) FILTER (method = 'startsession') AS o, max(step_idx) FILTER (method = 'endsession') AS c FROM st WHERE step_idx < n_steps - 1 AND status = 'success' GROUP BY ALL)
SELECT l.case_id, l.n_steps, l.method, l.status, coalesce(o, -1) > coalesce(c, -1) AS in_session,
  CASE WHEN method = 'startsession' THEN CASE WHEN status = 'success' THEN 'pass' ELSE 'fail' END
       WHEN NOT (coalesce(o, -1) > coalesce(c, -1)) THEN CASE WHEN status = 'notauthorized' THEN 'pass' ELSE 'fail' END
       WHEN status <> 'success' THEN 'fail' ELSE 'pass' END AS prediction FROM l LEFT JOIN s USING (case_id)""")
def session_verdicts(spark, sf_dir):
    """Is each case's last step legal given the sessions before it? One exchange, one aggregate."""
    ok = F.col("status") == "success"
    at = lambda m: F.max(F.when(ok & (F.col("method") == m) & (F.col("step_idx") < F.col("n_steps") - 1), F.col("step_idx")))
    c = steps(spark, sf_dir).groupBy("case_id").agg(at("startsession").alias("o"), at("endsession").alias("c"), F.max_by(F.struct("method", "status"), "step_idx").alias("last"), F.count("*").alias("n_steps"))
    inside = F.coalesce("o", F.lit(-1)) > F.coalesce("c", F.lit(-1))
    good = F.when(F.col("last.method") == "startsession", F.col("last.status") == "success").when(~inside, F.col("last.status") == "notauthorized").otherwise(F.col("last.status") == "success")
    return c.select("case_id", "n_steps", "last.method", "last.status", inside.alias("in_session"), F.when(good, "pass").otherwise("fail").alias("prediction"))


@query(VERDICTS + "SELECT case_id, prediction, final_rule_id, n_steps FROM v")
def full_cascade_verdicts(spark, sf_dir):
    return verdicts(spark, sf_dir)


@query(VERDICTS + "SELECT final_rule_id, prediction, count(*) AS n FROM v GROUP BY ALL")
def rule_histogram(spark, sf_dir):
    return verdicts(spark, sf_dir).groupBy("final_rule_id", "prediction").agg(F.count("*").alias("n"))


EFFECTS = """CASE WHEN status <> 'success' THEN 'last_error' WHEN method = 'startsession' THEN 'active_sessions,authenticated' WHEN method = 'endsession' THEN 'active_sessions,authenticated'
  WHEN method = 'set' THEN 'object_fields' WHEN method = 'write' THEN 'generated_key_after_write,written_payloads' WHEN method = 'genkey' THEN 'generated_key_after_write' ELSE '' END"""


@query(EV + f""", w AS (SELECT DISTINCT case_id, unnest(string_split({EFFECTS}, ',')) AS x FROM st WHERE step_idx < n_steps - 1),
c AS (SELECT DISTINCT case_id FROM st)
SELECT c.case_id, coalesce(string_agg(x, ',' ORDER BY x) FILTER (x <> ''), '') AS writes FROM c LEFT JOIN w USING (case_id) GROUP BY ALL""")
def state_writes_per_case(spark, sf_dir):
    v = coverage.trace_columns(verdicts(spark, sf_dir, with_trace=True))
    return v.select("case_id", F.array_join(F.array_sort("writes"), ",").alias("writes"))


@query(EV + """SELECT case_id, coalesce(arg_max(status, step_idx) FILTER (status <> 'success' AND step_idx < n_steps - 1), '') AS last_error FROM st GROUP BY ALL""")
def last_error_per_case(spark, sf_dir):
    return fold.state(normalised(steps(spark, sf_dir))).select("case_id", "last_error")


@query(VERDICTS + "SELECT l.case_id, coalesce(act.n, 0) AS n_active, coalesce(act.n, 0) > 0 AND coalesce(fine, false) AS authenticated FROM l LEFT JOIN act USING (case_id) LEFT JOIN lastopen USING (case_id)")
def session_set_fold(spark, sf_dir):
    s = fold.state(normalised(steps(spark, sf_dir)))
    return s.select("case_id", F.size("active_sessions").cast("long").alias("n_active"), "authenticated")


@query(EV + """SELECT case_id, object_key, "column", arg_max(cell, step_idx) AS cell, max(step_idx) AS at_step FROM st WHERE method = 'set' AND status = 'success' GROUP BY ALL""")
def field_state_last_write_wins(spark, sf_dir):
    d = steps(spark, sf_dir).where("method = 'set' and status = 'success'")
    return sequence.last_value_per(d, ["case_id", "object_key", "column"], "cell")


@query(EV + """SELECT case_id, address, arg_max(payload, step_idx) AS payload, max(step_idx) AS at_step FROM st WHERE method = 'write' AND status = 'success' AND payload <> '' GROUP BY ALL""")
def payload_state_by_address(spark, sf_dir):
    d = steps(spark, sf_dir).where("method = 'write' and status = 'success' and payload <> ''")
    return sequence.last_value_per(d, ["case_id", "address"], "payload")


@query(VERDICTS + "SELECT l.case_id, coalesce(fresh, false) AS generated_key FROM l LEFT JOIN keys USING (case_id)")
def genkey_after_write_flag(spark, sf_dir):
    return fold.state(normalised(steps(spark, sf_dir))).select("case_id", "generated_key")


def _ruled(name: str, rule: str):
    @query(VERDICTS + f"SELECT case_id, status, prediction FROM v WHERE final_rule_id = '{rule}'")
    def run(spark, sf_dir):
        v = verdicts(spark, sf_dir, keep=["last.status"]).where(F.col("final_rule_id") == rule)
        return v.select("case_id", "status", "prediction")

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


for _name, _rule in (("read_consistency_verdicts", "READ_PAYLOAD"), ("get_consistency_verdicts", "GET_PAYLOAD"), ("precondition_verdicts", "PRECONDITION_EXPECTED_ERROR"), ("startsession_verdicts", "STARTSESSION_FINAL")):
    _ruled(_name, _rule)


# --- the raw log -------------------------------------------------------------------------------

RAW, STATE, RULES = f"WITH {RAW_SQL}\n", f"WITH {STATE_SQL}\n", f"WITH {RULES_SQL}\n"


def read_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised steps of the raw log."""
    return normalise(rawlog.records(spark, sf_dir))


def raw_verdicts(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """The verdicts of the raw log, from one JSON document a case."""
    return verify(steps_of(rawlog.cases(spark, sf_dir)), **how)




@query(RAW + "SELECT case_id, step_idx, method, status, method IN ('read', 'write') AS is_data_command, CASE WHEN method NOT IN ('read', 'write') THEN '' WHEN k % 23 <> 0 THEN method WHEN method = 'read' THEN 'write' ELSE 'read' END AS reply_command, CASE WHEN method <> 'startsession' OR status <> 'success' THEN '' WHEN k % 29 = 0 THEN 'get' ELSE 'syncsession' END AS reply_method FROM t")
def json_methods(spark, sf_dir):
    """Methods, statuses and replies, whatever the shape of the JSON."""
    d = read_steps(spark, sf_dir)
    return d.select("case_id", long("step_idx"), "method", "status", "is_data_command", "reply_command", F.when(F.col("method") == "startsession", F.col("reply_method")).otherwise("").alias("reply_method"))


@query(RAW + "SELECT case_id, step_idx, invoking, invoking_uid, CASE WHEN invoking_uid <> '' THEN invoking || ':' || invoking_uid ELSE invoking END AS object_key, kind AS object_kind FROM t")
def json_targets(spark, sf_dir):
    return read_steps(spark, sf_dir).select("case_id", long("step_idx"), "invoking", "invoking_uid", "object_key", "object_kind")


@query(RAW + """SELECT case_id, step_idx, CASE WHEN method = 'startsession' THEN CAST(k % 4 + 1 AS VARCHAR) ELSE closed END AS session_in, CASE WHEN method = 'startsession' AND status = 'success' THEN opened ELSE '' END AS session_out,
  challenge, method = 'startsession' AND k % 13 = 0 AS challenge_malformed, CASE WHEN method = 'startsession' AND status = 'success' AND k % 23 <> 0 THEN '00001001' ELSE '' END AS sp_session_out,
  method = 'startsession' AND status = 'success' AND k % 19 <> 0 AS echoed FROM t""")
def json_sessions(spark, sf_dir):
    d = read_steps(spark, sf_dir)
    return d.select("case_id", long("step_idx"), "session_in", "session_out", "challenge", "challenge_malformed", "sp_session_out", X.ids_equivalent(F.col("host_session_in"), F.col("host_session_out")).alias("echoed"))


@query(RAW + """SELECT case_id, step_idx, array_to_string(list_transform(list_zip(set_columns, set_values), lambda x: x[1] || '=' || x[2]), ',') AS cells_in,
  array_to_string(list_transform(shown, lambda c: c || '=' || CAST((q + CAST(c AS BIGINT)) % 3 AS VARCHAR)), ',') AS cells_out, array_to_string(requested, ',') AS requested, reversed AS cellblock_invalid, repeated AS columns_repeated, bad_bool,
  CASE WHEN method = 'set' THEN kind || ':' || array_to_string(set_columns, ',')
       WHEN len(requested) > 0 AND CASE kind WHEN 'locking' THEN first >= 3 AND last <= 8 WHEN 'cpin' THEN last = 3 ELSE last <= 2 END THEN kind || ':' || array_to_string(requested, ',') ELSE '' END AS known_access FROM t""")
def json_cells(spark, sf_dir):
    """Table cells, requested columns and their faults."""
    shown = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat(x["column"], F.lit("="), x["text"])), ",")
    d = read_steps(spark, sf_dir)
    return d.select("case_id", long("step_idx"), shown(F.col("cells_in")).alias("cells_in"), shown(F.col("cells_out")).alias("cells_out"), F.array_join("requested", ",").alias("requested"), "cellblock_invalid", "columns_repeated", "bad_bool", "known_access")


@query(RAW + """SELECT case_id, step_idx, CASE WHEN method = 'write' THEN payload ELSE '' END AS payload_in, CASE WHEN method = 'read' THEN payload ELSE '' END AS payload_out, address, returns_nothing AS result_empty,
  method = 'properties' AND k % 3 <> 0 AS has_properties, kind = 'cpin' AS mentions_cpin, array_to_string(set_secrets, ',') AS secrets FROM t""")
def json_payloads(spark, sf_dir):
    d = read_steps(spark, sf_dir)
    said = F.when((F.col("method") == "set") & F.col("mentions_cpin"), F.array_join("secrets", ",")).otherwise("")
    return d.select("case_id", long("step_idx"), F.when(F.col("method") == "write", F.col("payload_in")).otherwise("").alias("payload_in"), F.when(F.col("method") == "read", F.col("payload_out")).otherwise("").alias("payload_out"), "address", "result_empty", "has_properties", "mentions_cpin", said.alias("secrets"))


@query(STATE + "SELECT case_id, n_active, authed AS authenticated, len(secrets) AS n_secrets, list_contains(secrets, challenge) AS secret_known, n_sps, n_fields, expected AS expected_payload, fresh AS generated_key, last_error FROM j")
def json_state(spark, sf_dir):
    """What the steps before a case's last leave behind."""
    s = fold.state(read_steps(spark, sf_dir))
    n = lambda c: F.size(c).cast("long")
    fields = F.array_distinct(F.transform("fields", lambda f: F.concat_ws(":", f["object_key"], f["column"])))
    return s.select("case_id", n("active_sessions").alias("n_active"), "authenticated", n("known_secrets").alias("n_secrets"), F.array_contains("known_secrets", F.col("last.challenge")).alias("secret_known"), n("activated_sps").alias("n_sps"), n(fields).alias("n_fields"), "expected_payload", "generated_key", "last_error")


@query(STATE + "SELECT case_id, unnest(secrets) AS secret FROM j")
def secret_membership(spark, sf_dir):
    """The secrets that a case's steps have set."""
    return fold.state(read_steps(spark, sf_dir)).select("case_id", F.explode("known_secrets").alias("secret"))


@query(RULES + "SELECT case_id, prediction, final_rule_id, n_steps FROM verdict WHERE mutant_id = ''")
def json_verdicts(spark, sf_dir):
    return raw_verdicts(spark, sf_dir)


@query(RULES + "SELECT final_rule_id, prediction, count(*) AS n FROM verdict WHERE mutant_id = '' GROUP BY ALL")
def json_rule_histogram(spark, sf_dir):
    return raw_verdicts(spark, sf_dir).groupBy("final_rule_id", "prediction").agg(F.count("*").alias("n"))


@query(RULES + "SELECT case_id, prediction, n_steps FROM verdict WHERE mutant_id = '' AND final_rule_id = 'LOCKING_DATA_ACCESS'")
def locking_gate_verdicts(spark, sf_dir):
    return raw_verdicts(spark, sf_dir).where("final_rule_id = 'LOCKING_DATA_ACCESS'").select("case_id", "prediction", "n_steps")


TRACE_STEPS = """s AS (SELECT *, bool_or(method = 'write' AND status = 'success' AND payload <> '') OVER (PARTITION BY case_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wrote FROM t),
o AS (SELECT * FROM s WHERE step_idx < n_steps - 1)"""
TRACE_ROWS = """SELECT case_id, step_idx AS step, 'OBSERVE_ERROR' AS rule_id, '' AS reads, 'last_error' AS writes, method || '->' || status AS detail FROM o WHERE status <> 'success'
UNION ALL SELECT case_id, step_idx, 'STARTSESSION_EFFECT', 'HostChallenge', 'active_sessions,authenticated', 'sid=' || opened FROM o WHERE status = 'success' AND method = 'startsession'
UNION ALL SELECT case_id, step_idx, 'ENDSESSION_EFFECT', 'active_sessions', 'active_sessions,authenticated', 'sid=' || CASE WHEN closed = '' THEN 'all' ELSE closed END FROM o WHERE status = 'success' AND method = 'endsession'
UNION ALL SELECT case_id, step_idx, 'SET_CPIN_SECRET', 'C_PIN', 'known_secrets', 'C_PIN updated count=' || CAST(len(set_secrets) AS VARCHAR) FROM o WHERE status = 'success' AND method = 'set' AND kind = 'cpin'
UNION ALL SELECT case_id, step_idx, 'SET_OBJECT_FIELDS', 'Values,invoking_uid', 'object_fields', 'columns=' || array_to_string(set_columns, ',') FROM o WHERE status = 'success' AND method = 'set'
UNION ALL SELECT case_id, step_idx, 'ACTIVATE_SP_EFFECT', 'invoking_uid', 'activated_sps', invoking_uid FROM o WHERE status = 'success' AND method = 'activate' AND contains(invoking, 'sp')
UNION ALL SELECT case_id, step_idx, 'WRITE_PAYLOAD_EFFECT', 'LBA,payload', 'written_payloads,generated_key_after_write', 'address=' || address FROM o WHERE status = 'success' AND method = 'write'
UNION ALL SELECT case_id, step_idx, 'GENKEY_EFFECT', 'written_payloads', 'generated_key_after_write', 'after_write=' || CASE WHEN coalesce(wrote, false) THEN 'True' ELSE 'False' END FROM o WHERE status = 'success' AND method = 'genkey'"""


@query(f"{RAW}, {TRACE_STEPS} {TRACE_ROWS}")
def trace_explode(spark, sf_dir):
    """One row a trace event of the steps before a case's last: what each read and wrote."""
    e = raw_verdicts(spark, sf_dir, with_trace=True).select("case_id", (F.col("n_steps") - 1).alias("last"), F.explode("trace").alias("e")).where("e.step < last")
    return e.select("case_id", F.col("e.step").cast("long").alias("step"), "e.rule_id", F.array_join("e.state_reads", ",").alias("reads"), F.array_join("e.state_writes", ",").alias("writes"), "e.detail")


@query(RULES + "SELECT case_id, CASE WHEN final_rule_id = 'ACTIVATE_PAYLOAD' THEN 'ACTIVATE_TARGET,ACTIVATE_PAYLOAD' WHEN final_rule_id = 'PROPERTIES_PAYLOAD' THEN 'PROPERTIES_TARGET,PROPERTIES_PAYLOAD' ELSE final_rule_id END AS rules FROM verdict WHERE mutant_id = ''")
def trace_ends(spark, sf_dir):
    """The rules that a case's last step passes on its way and at its end."""
    t = raw_verdicts(spark, sf_dir, with_trace=True)
    own = F.filter("trace", lambda e: e["step"] == F.col("n_steps") - 1)
    return t.select("case_id", F.array_join(F.transform(own, lambda e: e["rule_id"]), ",").alias("rules"))


# Prompts look at fewer places than the rules do: methods under `method`, statuses under `status` and `status_codes`.
PROMPTS = """w AS (SELECT *, q % 3 < 2 AND method <> '' AND method NOT IN ('read', 'write') AS told, method = 'startsession' AND q % 3 < 2 AND status = 'success' AND q % 5 <> 3 AS opens, method = 'endsession' AND q % 3 < 2 AS ends FROM t)
SELECT case_id, 'SessionState: active=' || CASE WHEN coalesce(max(step_idx) FILTER (opens) > coalesce(max(step_idx) FILTER (ends), -1), false) THEN 'True, auth=True' ELSE 'False, auth=False' END
    || CASE WHEN bool_or(opens AND q % 3 = 0) THEN ', SPID=0000020500000001,Write=1' ELSE '' END AS state, count(*) AS n_lines,
  '[FINAL] Step ' || CAST(max(step_idx) AS VARCHAR) || ': ' || arg_max(CASE WHEN NOT told THEN '' WHEN method = 'startsession' THEN 'StartSession' WHEN method = 'endsession' THEN 'EndSession' WHEN method = 'genkey' THEN 'GenKey' ELSE upper(method[1]) || method[2:] END, step_idx) AS final
FROM w GROUP BY ALL"""


@query(RAW + ", " + PROMPTS)
def json_prompts(spark, sf_dir):
    """The state line, the number of steps, and the beginning of the last step of each case's prompt."""
    p = render.prompts(rawlog.records(spark, sf_dir)).withColumn("lines", F.split("prompt", "\n"))
    step = F.filter("lines", lambda x: x.rlike(r"^(\[FINAL\] )?Step \d+: "))
    final = F.regexp_extract(F.element_at(step, -1), r"^(\[FINAL\] Step \d+: [A-Za-z]*)", 1)
    return p.select("case_id", F.element_at("lines", 2).alias("state"), F.size(step).cast("long").alias("n_lines"), final.alias("final"))


@query(RULES + "SELECT case_id, 'system,user,assistant' AS roles, prediction AS answer FROM verdict WHERE mutant_id = ''")
def chat_examples(spark, sf_dir):
    raw = rawlog.records(spark, sf_dir)
    d = render.chat(render.prompts(raw).join(verify(raw).select("case_id", F.col("prediction").alias("label")), "case_id"))
    return d.select("case_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.element_at("messages", -1)["content"].alias("answer"))


KILLS = "w AS (SELECT case_id, prediction AS was FROM verdict WHERE mutant_id = ''), c AS (SELECT mutant_id, count(*) FILTER (prediction <> was) AS n_changed FROM verdict JOIN w USING (case_id) WHERE mutant_id <> '' GROUP BY ALL)"


def kill_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kill_report(mutation_runs(rawlog.records(spark, sf_dir)))


@query(RULES + f", {KILLS} SELECT mutant_id, mutant_id IN ('ALWAYS_PASS', 'ALWAYS_FAIL') AS is_baseline, n_changed, n_changed > 0 AS killed FROM c")
def mutation_kill_matrix(spark, sf_dir):
    return kill_matrix(spark, sf_dir).select("mutant_id", "is_baseline", "n_changed", "killed")


@query(RULES + f", {KILLS} SELECT count(*) AS n_mutants, count(*) FILTER (n_changed > 0) AS n_killed, count(*) FILTER (n_changed > 0) / count(*) AS mutation_score FROM c WHERE mutant_id NOT IN ('ALWAYS_PASS', 'ALWAYS_FAIL')")
def mutation_score(spark, sf_dir):
    return share_killed(kill_matrix(spark, sf_dir))


LABELLED = "l AS (SELECT DISTINCT case_id, CASE WHEN case_id % 3 = 0 THEN 'fail' ELSE 'pass' END AS label FROM t)"


def some_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rawlog.records(spark, sf_dir).select("case_id").distinct().withColumn("label", F.when(F.col("case_id") % 3 == 0, "fail").otherwise("pass"))


@query(RULES + f", {LABELLED}, c AS (SELECT mutant_id, count(*) FILTER (prediction = label) AS n_correct FROM verdict JOIN l USING (case_id) GROUP BY ALL) SELECT mutant_id, n_correct, n_correct - (SELECT n_correct FROM c WHERE mutant_id = '') AS delta FROM c WHERE mutant_id <> ''")
def mutation_score_deltas(spark, sf_dir):
    return score_deltas(mutation_runs(rawlog.records(spark, sf_dir)), some_labels(spark, sf_dir))


ENDS = "ends AS (SELECT case_id, n_steps - 1 AS step, unnest(CASE WHEN final_rule_id = 'ACTIVATE_PAYLOAD' THEN ['ACTIVATE_TARGET', 'ACTIVATE_PAYLOAD'] WHEN final_rule_id = 'PROPERTIES_PAYLOAD' THEN ['PROPERTIES_TARGET', 'PROPERTIES_PAYLOAD'] ELSE [final_rule_id] END) AS rule_id FROM verdict WHERE mutant_id = '')"


@query(f"{RULES}, {LABELLED}, {TRACE_STEPS}, eff AS ({TRACE_ROWS}), {ENDS}, " + """
seen AS (SELECT case_id, rule_id, min(step * 10 + CASE rule_id WHEN 'SET_OBJECT_FIELDS' THEN 1 WHEN 'ACTIVATE_PAYLOAD' THEN 1 WHEN 'PROPERTIES_PAYLOAD' THEN 1 ELSE 0 END) AS place FROM (SELECT case_id, step, rule_id FROM eff UNION ALL SELECT * FROM ends) GROUP BY ALL),
four AS (SELECT case_id, string_agg(rule_id, ', ' ORDER BY place) AS rules FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY place DESC) AS r FROM seen) WHERE r <= 4 GROUP BY ALL)
SELECT v.case_id, label, prediction, rules FROM verdict v JOIN l USING (case_id) JOIN four USING (case_id) WHERE mutant_id = '' AND prediction <> label ORDER BY v.case_id LIMIT 20""")
def mismatch_report(spark, sf_dir):
    """The first twenty wrong verdicts of the report, with their last rules."""
    raw = rawlog.records(spark, sf_dir)
    return mismatches(case_summaries(normalise(raw), verify(raw, with_trace=True), some_labels(spark, sf_dir))).select("case_id", "label", "prediction", "rules")


# Of each relation, the steps of the raw log that it applies to.
RELATIONS = """w AS (SELECT *, max(CASE WHEN method = 'read' THEN step_idx END) OVER c AS last_read, max(CASE WHEN method = 'genkey' THEN step_idx END) OVER c AS last_genkey,
  count(*) FILTER (method = 'write') OVER (PARTITION BY case_id ORDER BY step_idx DESC ROWS UNBOUNDED PRECEDING) AS write_rank, coalesce(bool_or(method = 'set' AND kind = 'locking') OVER b, false) AS locked, coalesce(bool_or(method = 'set' AND kind = 'cpin') OVER b, false) AS pinned,
  (method = 'set') OR (method = 'get' AND len(requested) > 0 AND CASE kind WHEN 'locking' THEN first >= 3 AND last <= 8 WHEN 'cpin' THEN last = 3 ELSE last <= 2 END) AS accessible
  FROM t WINDOW c AS (PARTITION BY case_id), b AS (PARTITION BY case_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT unnest(list_concat(
  CASE WHEN method = 'genkey' THEN ['genkey_empty_success pass', 'genkey_nonempty_success fail', 'genkey_no_session_success fail', 'genkey_no_session_rejected pass'] ELSE [] END,
  CASE WHEN challenge <> '' THEN ['malformed_challenge_success fail', 'malformed_challenge_not_authorized pass'] ELSE [] END,
  CASE WHEN method = 'properties' THEN ['properties_wrong_target_success fail', 'properties_missing_payload_success fail'] ELSE [] END,
  CASE WHEN method = 'read' AND step_idx = last_read AND last_read >= last_genkey THEN ['read_old_pattern_after_genkey fail', 'read_random_after_genkey pass', 'read_success_missing_result fail', 'read_wrong_response_command fail'] ELSE [] END,
  CASE WHEN method = 'write' AND write_rank <= 2 AND last_read >= last_genkey THEN ['write_missing_payload_success fail', 'write_wrong_response_command fail'] ELSE [] END,
  CASE WHEN method IN ('read', 'write') AND locked THEN ['locking_' || method || '_locked_success fail', 'locking_' || method || '_locked_fail pass', 'locking_' || method || '_locked_not_authorized pass'] ELSE [] END,
  CASE WHEN method = 'get' THEN ['get_no_session_success fail', 'get_no_session_rejected pass'] ELSE [] END,
  CASE WHEN method = 'startsession' AND pinned THEN ['known_pin_success pass', 'known_pin_rejected fail', 'wrong_pin_success fail', 'wrong_pin_rejected pass'] ELSE [] END,
  CASE WHEN method = 'startsession' THEN ['startsession_missing_sp_session fail', 'startsession_wrong_host_session fail', 'startsession_wrong_response_method fail'] ELSE [] END,
  CASE WHEN method = 'set' THEN ['set_duplicate_column_rejected pass', 'set_duplicate_column_success fail', 'set_nonempty_success_payload fail'] ELSE [] END,
  CASE WHEN method = 'endsession' THEN ['endsession_success pass', 'endsession_nonempty_success fail', 'endsession_no_session_success fail', 'endsession_no_session_rejected pass'] ELSE [] END,
  CASE WHEN method = 'activate' AND k % 3 = 0 THEN ['activate_empty_success pass', 'activate_nonempty_success fail'] ELSE [] END,
  CASE WHEN accessible AND status = 'success' THEN ['known_' || kind || '_' || method || '_success pass'] ELSE [] END,
  CASE WHEN accessible THEN ['known_' || kind || '_' || method || '_not_authorized fail', 'known_' || kind || '_' || method || '_invalid_parameter fail', 'known_' || kind || '_' || method || '_fail fail'] ELSE [] END,
  CASE WHEN method = 'set' AND kind IN ('locking', 'mbrcontrol') AND NOT (kind = 'locking' AND v = 2) THEN ['known_' || kind || '_invalid_bool_rejected pass', 'known_' || kind || '_invalid_bool_success fail'] ELSE [] END,
  CASE WHEN len(requested) >= 2 THEN ['get_partial_columns fail', 'get_empty_success fail'] ELSE [] END)) AS x FROM w)
SELECT split_part(x, ' ', 1) AS relation, split_part(x, ' ', 2) AS label, count(*) AS n FROM r GROUP BY ALL"""


@query(RAW + ", " + RELATIONS)
def synthetic_cases(spark, sf_dir):
    """The cases that the mutation relations derive from the raw log, as rows of a dataset, by relation and label."""
    d = mutations.as_cases(mutations.mutate(rawlog.records(spark, sf_dir)))
    return d.groupBy(X.relation_name(F.regexp_replace("case_id", "^synthetic:", "")).alias("relation"), "label").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'train' ELSE 'none' END AS split FROM documents")
def public_sources(spark, sf_dir):
    """Which of labelled training cases are observed ones, and so always train."""
    old = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.lit("pass").alias("label"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("public:"), "source")).otherwise(F.concat("source", F.lit(" public:"))).alias("source"))
    kept = with_public(old.limit(0).withColumn("split", F.lit("")), old).select(F.col("case_id").cast("long").alias("id"), "split")
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return docs.join(kept, docs["doc_id"] == kept["id"], "left").select("doc_id", F.coalesce("split", F.lit("none")).alias("split"))


# --- order -------------------------------------------------------------------------------------


@query(EV + "SELECT event_id, case_id, step_idx, n_steps FROM st")
def step_numbering(spark, sf_dir):
    return steps(spark, sf_dir).select("event_id", "case_id", "step_idx", "n_steps")


@query(EV + "SELECT event_id, step_idx = n_steps - 1 AS is_last FROM st")
def last_step_flag(spark, sf_dir):
    return steps(spark, sf_dir).select("event_id", sequence.is_last().alias("is_last"))


@query(EV + """, n AS (SELECT *, method || '(' || object_key || ') -> ' || status AS s FROM st WHERE step_idx >= n_steps - 5)
SELECT case_id, string_agg(s, '; ' ORDER BY step_idx) AS receptive_field FROM n GROUP BY ALL""")
def last_n_receptive_field(spark, sf_dir):
    d = steps(spark, sf_dir).withColumn("s", X.event_signature(F.col("method"), F.col("object_key"), F.col("status")))
    near = d.withColumns({"field": sequence.last_n(F.col("s"), 5), "last": sequence.is_last()})
    return near.where("last").select("case_id", F.array_join("field", "; ").alias("receptive_field"))


@query("SELECT conv_id, turn, row_number() OVER w AS n_turns, CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def prefix_cases(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("step_idx", F.col("turn"))
    p = c.withColumn("p", sequence.prefix(F.length("text"), "conv_id"))
    return p.select("conv_id", "turn", F.size("p").cast("long").alias("n_turns"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_chars"))


@query(EV + """, t AS (SELECT lag(method) OVER (PARTITION BY case_id ORDER BY step_idx) AS previous, method FROM st)
SELECT previous, method, count(*) AS n FROM t WHERE previous IS NOT NULL GROUP BY ALL""")
def rule_transitions(spark, sf_dir):
    return sequence.transitions(steps(spark, sf_dir), "method")


def _asof(name: str, sought: str, by: str, forward: bool = False):
    frame = "1 FOLLOWING AND UNBOUNDED FOLLOWING" if forward else "UNBOUNDED PRECEDING AND 1 PRECEDING"
    pick = "min" if forward else "max"

    @query(EV + f""", a AS (SELECT *, {pick}(CASE WHEN method = '{sought}' THEN step_idx END) OVER (PARTITION BY case_id ORDER BY step_idx ROWS BETWEEN {frame}) AS partner_step FROM st)
SELECT event_id, case_id, step_idx, partner_step FROM a WHERE method = '{by}'""")
    def run(spark, sf_dir):
        d = steps(spark, sf_dir)
        find = sequence.first_after if forward else sequence.latest_before
        d = d.withColumn("partner_step", find(F.col("step_idx"), F.col("method") == sought))
        return d.where(F.col("method") == by).select("event_id", "case_id", "step_idx", "partner_step")

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


for _name, _sought, _by, _fwd in (("asof_latest_set_before_read", "set", "read", False), ("asof_latest_secret", "set", "startsession", False), ("asof_last_genkey", "genkey", "read", False), ("forward_first_start_after_set", "startsession", "set", True)):
    _asof(_name, _sought, _by, _fwd)


@query(EV + """, n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY step_idx DESC) AS r FROM st WHERE method = 'write') SELECT case_id, step_idx, payload FROM n WHERE r <= 2""")
def last_two_writes(spark, sf_dir):
    return sequence.last_k(steps(spark, sf_dir), F.col("method") == "write", 2).select("case_id", "step_idx", "payload")


@query(EV + """SELECT case_id, coalesce(max(step_idx) FILTER (method = 'read') > max(step_idx) FILTER (method = 'genkey'), false) AS read_after FROM st GROUP BY ALL""")
def read_after_last_genkey(spark, sf_dir):
    at = lambda m: F.max(F.when(F.col("method") == m, F.col("step_idx")))
    return steps(spark, sf_dir).groupBy("case_id").agg(F.coalesce(at("read") > at("genkey"), F.lit(False)).alias("read_after"))


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, sum(CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS g FROM labels)
SELECT i AS n_rows, round(g / i, 6) AS accuracy FROM n WHERE i % 50 = 0""")
def running_accuracy_every_50(spark, sf_dir):
    return sequence.running_share(read(spark, sf_dir, "labels"), F.col("quality") == 1 - F.col("toxic"), ["doc_id"], 50)


# --- text and values ---------------------------------------------------------------------------

ASCII = r"regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


@query(r"SELECT conv_id, turn, md5(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS digest FROM conversations")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.norm(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5({ASCII.format('text')}) AS digest FROM documents")
def compact_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.compact(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, contains({ASCII.format('text')}, 'license') AS found FROM documents")
def contains_needle(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.contains_text(F.array("text"), "Li-cense").alias("found"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props) = 'OBJECT' AS is_object FROM events")
def json_prop_extract(spark, sf_dir):
    d = read(spark, sf_dir, "events").select("event_id", K.tokens(F.col("props")).alias("t"), F.startswith(F.trim("props"), F.lit("{")).alias("is_object"))
    return d.select("event_id", K.first(F.col("t"), "k")["text"].cast("long").alias("k"), "is_object")


@query("SELECT event_id, 0 AS ord, 'k' AS name, 'k' AS key, 'int' AS kind, regexp_extract(props, '([0-9]+)', 1) AS text, false AS under_cell FROM events")
def json_tokens(spark, sf_dir):
    d = read(spark, sf_dir, "events").select("event_id", F.explode(K.tokens(F.col("props"))).alias("t"))
    return d.select("event_id", "t.ord", "t.name", "t.key", "t.kind", "t.text", "t.under_cell")


@query(f"SELECT event_id, lower(to_hex(user_id)) = ltrim(lower(printf('%08x', event_id % 150)), '0') OR user_id = event_id % 150 AS same FROM events")
def hex_id_equivalence(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", X.ids_equivalent(F.lower(F.hex("user_id")), F.lower(F.lpad(F.hex(F.col("event_id") % 150), 8, "0"))).alias("same"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false ELSE length(regexp_replace(lang, '\\s+', '', 'g')) < 4 END AS malformed FROM documents")
def challenge_wellformedness(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    h = F.md5("text")
    token = F.when(F.col("doc_id") % 3 == 0, h).when(F.col("doc_id") % 3 == 1, F.concat(h, h)).otherwise(F.col("lang"))
    return d.select("doc_id", X.challenge_malformed(token).alias("malformed"))


@query(EV + """SELECT event_id, "column" IN ('5', '6', '7', '8') AND cell NOT IN ('0', '1') AS invalid FROM st""")
def bool_token_validity(spark, sf_dir):
    return steps(spark, sf_dir).select("event_id", (F.col("column").isin("5", "6", "7", "8") & X.bool_invalid(F.lit("int"), F.col("cell"))).alias("invalid"))


@query(EV + """SELECT event_id, CAST(unnest(range(k % 9, k % 9 + k % 4)) AS VARCHAR) AS "column" FROM st WHERE method = 'get'""")
def column_range_expand(spark, sf_dir):
    d = steps(spark, sf_dir).where("method = 'get' and k % 4 > 0").withColumn("doc", K.tokens(F.format_string('{"Cellblock": [{"startColumn": %d}, {"endColumn": "%d"}]}', F.col("k") % 9, F.col("k") % 9 + F.col("k") % 4 - 1)))
    return d.select("event_id", F.explode(K.requested_columns(F.col("doc"))).alias("column"))


@query("SELECT l_orderkey, count(*) AS n, count(*) <> count(DISTINCT l_linenumber) AS repeated FROM lineitem GROUP BY ALL")
def duplicate_column_detect(spark, sf_dir):
    row = F.format_string('{"%d": 0}', "l_linenumber")
    d = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(F.collect_list(row), ", ").alias("rows"))
    d = d.withColumn("t", K.tokens(F.concat(F.lit('{"Values": ['), "rows", F.lit("]}"))))
    return d.select("l_orderkey", "n", K.repeated_columns(F.col("t")).alias("repeated"))


@query("SELECT conv_id, turn, text IS NULL OR trim(text) = '' AS empty FROM conversations")
def is_empty_payload(spark, sf_dir):
    d = read(spark, sf_dir, "conversations").select("conv_id", "turn", K.tokens(F.to_json(F.struct(F.struct(F.array("text").alias("required")).alias("return_values")))).alias("t"))
    return d.select("conv_id", "turn", K.empty_below(F.col("t"), K.first(F.col("t"), "returnvalues")).alias("empty"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'mbrcontrol' WHEN contains(lower(p_type), 'brass') THEN 'locking' WHEN contains(lower(p_type), 'tin') THEN 'authority' WHEN starts_with(lower(p_brand), 'brand#1') THEN 'cpin' ELSE '' END AS kind FROM part")
def object_kind_classify(spark, sf_dir):
    name = F.lower("p_type")
    for metal, kind in (("steel", "MBR Control"), ("brass", "Locking_"), ("tin", "Authority")):
        name = F.replace(name, F.lit(metal), F.lit(kind))
    uid = F.when(F.startswith(F.lower("p_brand"), F.lit("brand#1")), "00 00 00 0B 00").otherwise("00 00 00 08 00")
    return read(spark, sf_dir, "part").select("p_partkey", object_kind(X.compact(name), X.compact(uid)).alias("kind"))


@query(EV + """, f AS (SELECT case_id, object_key, min(step_idx) AS seen FROM st GROUP BY ALL) SELECT case_id, string_agg(object_key, ',' ORDER BY seen) AS objects FROM f GROUP BY ALL""")
def order_preserving_distinct(spark, sf_dir):
    c = steps(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("step_idx", "object_key"))).alias("a"))
    return c.select("case_id", F.array_join(X.unique(F.transform("a", lambda x: x["object_key"])), ",").alias("objects"))


@query("SELECT s_suppkey, CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS INTEGER) AS idx, 'rel' || CAST(s_nationkey AS VARCHAR) AS relation FROM supplier")
def case_name_parts(spark, sf_dir):
    number = F.regexp_extract("s_name", "([0-9]+)$", 1)
    name = F.concat(F.lit("tc1_a.json:rel"), F.col("s_nationkey").cast("string"), F.lit(":"), number)
    return read(spark, sf_dir, "supplier").select("s_suppkey", X.trailing_index(name).alias("idx"), X.relation_name(name).alias("relation"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN CAST(s_suppkey AS INTEGER) END AS number FROM supplier")
def case_numbers(spark, sf_dir):
    key = F.col("s_suppkey")
    name = F.when(key % 3 == 0, F.format_string("tc%d_a.json", key)).when(key % 3 == 1, F.format_string("%d_7.json", key)).otherwise(F.format_string("case%d", key))
    return read(spark, sf_dir, "supplier").select("s_suppkey", X.case_number(name).alias("number"))


@query("""WITH t AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, string_agg(CASE WHEN turn = last THEN '[FINAL] ' ELSE '' END || 'Step ' || CAST(turn AS VARCHAR) || ': ' || role || ' ' || CASE WHEN length(text) > 60 THEN text[1:60] || '...' ELSE text END, chr(10) ORDER BY turn) AS prompt FROM t GROUP BY ALL""")
def prompt_render(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("last", F.max("turn").over(W.partitionBy("conv_id")))
    line = F.concat(F.when(F.col("turn") == F.col("last"), "[FINAL] ").otherwise(""), F.lit("Step "), F.col("turn").cast("string"), F.lit(": "), "role", F.lit(" "), X.truncated(F.col("text"), 60))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("a"))
    return g.select("conv_id", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("prompt"))


@query("SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY ALL")
def chat_triples(spark, sf_dir):
    g = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return g.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


# --- joins and metrics -------------------------------------------------------------------------

GOLD = "CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END"
PRED = "CASE WHEN toxic = 1 THEN 'fail' ELSE 'pass' END"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "labels").withColumns({"gold": F.when(F.col("quality") == 1, "pass").otherwise("fail"), "pred": F.when(F.col("toxic") == 1, "fail").otherwise("pass")})
    return d.join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


@query(f"SELECT count(*) AS n, count(*) FILTER ({GOLD} = {PRED}) AS n_correct, round(100.0 * count(*) FILTER ({GOLD} = {PRED}) / count(*), 4) AS accuracy FROM labels JOIN documents USING (doc_id)")
def label_join_accuracy(spark, sf_dir):
    return metrics.accuracy(judged(spark, sf_dir), ok=F.col("gold") == F.col("pred"))


@query("SELECT lang, coalesce(CAST(toxic AS VARCHAR), '?') AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def left_label_default(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang", F.coalesce(F.col("toxic").cast("string"), F.lit("?")).alias("label")).agg(F.count("*").alias("n"))


@query(f"SELECT source, lang, count(*) AS n, count(*) FILTER ({GOLD} = {PRED}) AS n_correct, round(100.0 * count(*) FILTER ({GOLD} = {PRED}) / count(*), 4) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def accuracy_by_group(spark, sf_dir):
    return metrics.accuracy(judged(spark, sf_dir), "source", "lang", ok=F.col("gold") == F.col("pred"))


COUNTS = f"""c AS (SELECT lang, count(*) FILTER ({GOLD} = 'fail' AND {PRED} = 'fail') AS tp, count(*) FILTER ({GOLD} = 'pass' AND {PRED} = 'fail') AS fp,
  count(*) FILTER ({GOLD} = 'fail' AND {PRED} = 'pass') AS fn, count(*) FILTER ({GOLD} = 'pass' AND {PRED} = 'pass') AS tn FROM labels JOIN documents USING (doc_id) GROUP BY ALL)"""


@query(f"WITH {COUNTS} SELECT * FROM c")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(judged(spark, sf_dir), F.col("gold"), F.col("pred"), "lang")


@query(f"""WITH {COUNTS}, r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
SELECT lang, tp, fp, fn, tn, round_even((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round_even(p, 4) AS fail_precision, round_even(r, 4) AS fail_recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1_fail FROM r""")
def precision_recall_f1(spark, sf_dir):
    return metrics.scores(confusion_matrix(spark, sf_dir))


SPLIT = "CASE WHEN r <= floor(0.6 * n) THEN 'train' WHEN r <= floor(0.8 * n) THEN 'val' ELSE 'test' END"
SPLITS = f"s AS (SELECT doc_id, {SPLIT} AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents))"


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60/20/20 of each source, in the order of a hash of the id; exact sizes, the same in every run."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("doc_id").cast("string")).alias("h"))
    # ranks come from counts of 4,096 ranges of the hash, then an order within each: no task holds a source
    d = d.withColumn("b", F.left("h", F.lit(3)))
    counts = d.groupBy(F.col("source").alias("s"), F.col("b").alias("c")).agg(F.count("*").alias("m"))
    ahead = W.partitionBy("s").orderBy("c").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumns({"before": F.coalesce(F.sum("m").over(ahead), F.lit(0)), "n": F.sum("m").over(W.partitionBy("s"))})
    d = d.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("c")))
    d = d.withColumn("r", F.col("before") + F.row_number().over(W.partitionBy("source", "b").orderBy("h")))
    return d.select("doc_id", F.when(F.col("r") <= F.floor(0.6 * F.col("n")), "train").when(F.col("r") <= F.floor(0.8 * F.col("n")), "val").otherwise("test").alias("split"))


@query(f"WITH {SPLITS} SELECT * FROM s")
def hash_split_60_20_20(spark, sf_dir):
    return splits(spark, sf_dir)


@query(f"WITH {SPLITS} SELECT split, count(*) AS n, count(*) FILTER (quality = 1) AS n_pass, count(*) FILTER (quality = 0) AS n_fail FROM s JOIN labels USING (doc_id) GROUP BY ALL")
def class_balance_by_split(spark, sf_dir):
    d = splits(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_pass"), F.count_if(F.col("quality") == 0).alias("n_fail"))


@query("""SELECT count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT md5(text) AS h, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL HAVING count(DISTINCT toxic) > 1)""")
def label_conflict_detect(spark, sf_dir):
    """Equal texts with different labels."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h")).join(read(spark, sf_dir, "labels"), "doc_id")
    g = d.groupBy("h").agg(F.count("*").alias("n"), F.countDistinct("toxic").alias("k")).where("k > 1")
    return g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


@query(f"""WITH {SPLITS} SELECT count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT md5(text) AS h, count(*) AS n FROM documents JOIN s USING (doc_id) GROUP BY ALL HAVING count(DISTINCT split) > 1)""")
def split_leak_detect(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h")).join(splits(spark, sf_dir), "doc_id")
    g = d.groupBy("h").agg(F.count("*").alias("n"), F.countDistinct("split").alias("k")).where("k > 1")
    return g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


P = "1 / (1 + exp(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE)))"
SCORED = f"p AS (SELECT vec_id, {P} AS p, CASE WHEN label % 2 = 0 THEN 'pass' ELSE 'fail' END AS gold FROM embeddings)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    logit = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return read(spark, sf_dir, "embeddings").select("vec_id", X.p_fail(logit(0), logit(1)).alias("p"), F.when(F.col("label") % 2 == 0, "pass").otherwise("fail").alias("gold"))


@query(f"WITH {SCORED} SELECT vec_id, round(p, 6) AS p_fail, CASE WHEN p > 0.5 THEN 'fail' ELSE 'pass' END AS model FROM p")
def two_way_softmax(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", F.round("p", 6).alias("p_fail"), F.when(F.col("p") > 0.5, "fail").otherwise("pass").alias("model"))


@query(f"""WITH {SCORED}, b AS (SELECT least(CAST(floor(greatest(p, 1 - p) * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(CASE WHEN (p > 0.5) = (gold = 'fail') THEN 1.0 ELSE 0.0 END) AS acc FROM p GROUP BY ALL)
SELECT round(sum(abs(acc - (bin + 0.5) / 10) * n) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b""")
def ece_10_bins(spark, sf_dir):
    return metrics.calibration(scored(spark, sf_dir), F.col("p"), F.col("gold"))


@query(f"WITH {SCORED}, h AS (SELECT -(p * ln(p) + (1 - p) * ln(1 - p)) AS h FROM p) SELECT count(*) AS n, round(min(h), 6) AS min_entropy, round(max(h), 6) AS max_entropy, round(avg(h), 6) AS mean_entropy FROM h")
def entropy_stats(spark, sf_dir):
    return metrics.entropy_stats(scored(spark, sf_dir), F.col("p"))


@query(f"WITH {SCORED} SELECT gold, count(*) AS n, round(min(p), 6) AS min_p, round(max(p), 6) AS max_p, round(avg(p), 6) AS mean_p FROM p GROUP BY ALL")
def pfail_by_gold(spark, sf_dir):
    return metrics.spread(scored(spark, sf_dir), F.col("p"), "gold", name="p")


MODEL = f"m AS (SELECT vec_id, CASE WHEN {P} > 0.5 THEN 'fail' ELSE 'pass' END AS model, CASE WHEN label % 2 = 0 THEN 'pass' ELSE 'fail' END AS gold FROM embeddings)"


def numbered_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with the embedding that stands for their model's score: that of the case's user and week, modulo 500."""
    return verdicts(spark, sf_dir).withColumn("vec_id", F.col("case_id") % 500)


@query(VERDICTS + f", {MODEL} SELECT count(*) AS n_override, count(*) FILTER (model = gold) AS n_right FROM v JOIN m ON m.vec_id = v.case_id % 500 WHERE prediction <> model")
def override_accuracy(spark, sf_dir):
    m = scored(spark, sf_dir).select("vec_id", F.when(F.col("p") > 0.5, "fail").otherwise("pass").alias("model"), "gold")
    d = numbered_verdicts(spark, sf_dir).join(m, "vec_id").where(F.col("prediction") != F.col("model"))
    return d.agg(F.count("*").alias("n_override"), F.count_if(F.col("model") == F.col("gold")).alias("n_right"))


@query(VERDICTS + f""", {MODEL} SELECT v.case_id, prediction AS rule, CASE WHEN prediction = 'pass' AND model = 'fail' THEN 'fail' WHEN prediction = 'fail' AND model = 'pass' AND final_rule_id = 'UNEXPECTED_ERROR_STATUS' THEN 'pass' ELSE prediction END AS prediction
FROM v LEFT JOIN m ON m.vec_id = v.case_id % 500""")
def ensemble_bidirectional(spark, sf_dir):
    v = numbered_verdicts(spark, sf_dir)
    m = scored(spark, sf_dir).select("vec_id", F.when(F.col("p") > 0.5, "fail").otherwise("pass").alias("model"))
    scores = v.select("case_id", "vec_id").join(m, "vec_id").select("case_id", "model")
    return ensemble(v, scores).select("case_id", "rule", "prediction")


# --- coverage ----------------------------------------------------------------------------------


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = coverage.trace_columns(verdicts(spark, sf_dir, with_trace=True, keep=["last.method"]))
    return v.withColumn("categories", coverage.categories(F.col("rules"), F.col("reads"), F.col("writes"), F.lit(0)))


# The last rules that read the invoking object, and effects before the last step (not of get and read) that do or write.
FACTS = f"""w AS (SELECT case_id, bool_or({EFFECTS} <> '') AS wrote, bool_or(status = 'success' AND method = 'set') AS invoked FROM st WHERE step_idx < n_steps - 1 GROUP BY ALL),
f AS (SELECT v.*, coalesce(wrote, false) AS wrote, coalesce(invoked, false) OR final_rule_id IN ('KNOWN_FIELD_INVALID_VALUE', 'PRECONDITION_EXPECTED_ERROR', 'KNOWN_FIELD_EXPECTED_SUCCESS') AS invoked,
  final_rule_id IN ('PRECONDITION_EXPECTED_ERROR', 'KNOWN_FIELD_INVALID_VALUE', 'STARTSESSION_FINAL') AS pre,
  final_rule_id IN ('UNEXPECTED_ERROR_STATUS', 'PRECONDITION_EXPECTED_ERROR', 'KNOWN_FIELD_EXPECTED_SUCCESS', 'KNOWN_FIELD_INVALID_VALUE', 'STARTSESSION_FINAL', 'READ_PAYLOAD', 'WRITE_RESPONSE', 'LOCKING_DATA_ACCESS', 'SET_PAYLOAD', 'GET_PAYLOAD', 'GENKEY_PAYLOAD', 'ENDSESSION_PAYLOAD') AS stat,
  final_rule_id IN ('READ_PAYLOAD', 'GET_PAYLOAD', 'STARTSESSION_FINAL', 'SET_PAYLOAD', 'ENDSESSION_PAYLOAD', 'WRITE_RESPONSE', 'LOCKING_DATA_ACCESS', 'GENKEY_PAYLOAD') AS pay FROM v LEFT JOIN w USING (case_id))"""


@query(VERDICTS + f""", {FACTS} SELECT method, true AS parser, bool_or(invoked) AS object_identity, bool_or(pre) AS precondition, bool_or(wrote) AS state_effect, bool_or(stat) AS status_invariant, bool_or(pay) AS payload_invariant, false AS spec_backed, true AS tested FROM f GROUP BY ALL""")
def coverage_matrix(spark, sf_dir):
    return coverage.matrix(traced(spark, sf_dir)).drop("gaps")


@query(VERDICTS + f""", {FACTS}, m AS (SELECT method, bool_or(invoked) AS o, bool_or(pre) AS p, bool_or(wrote) AS s, bool_or(stat) AS i, bool_or(pay) AS y FROM f GROUP BY ALL)
SELECT method, concat_ws(',', CASE WHEN NOT o AND method NOT IN ('endsession', 'read', 'write') THEN 'object_identity' END, CASE WHEN NOT p AND method NOT IN ('properties', 'read', 'write') THEN 'precondition' END,
  CASE WHEN NOT s AND method NOT IN ('properties', 'get') THEN 'state_effect' END, CASE WHEN NOT i THEN 'status_invariant' END, CASE WHEN NOT y THEN 'payload_invariant' END, 'spec_backed') AS gaps FROM m""")
def coverage_gaps(spark, sf_dir):
    return coverage.matrix(traced(spark, sf_dir)).select("method", "gaps")


@query(VERDICTS + "SELECT case_id, final_rule_id FROM v WHERE final_rule_id IN ('DEFAULT_PASS', 'PARSE_FINAL_COMMAND', 'UNEXPECTED_ERROR_STATUS')")
def low_confidence_cases(spark, sf_dir):
    t = traced(spark, sf_dir)
    return t.where(coverage.low_confidence(F.lit(1), F.col("final_rule_id"), F.col("reads"))).select("case_id", "final_rule_id")


SETS = """o AS (SELECT DISTINCT case_id, method || ':' || object_key AS x FROM st), c AS (SELECT DISTINCT case_id FROM st),
n AS (SELECT case_id, lead(case_id) OVER (PARTITION BY case_id // 100 ORDER BY case_id) AS other FROM c)"""


def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = steps(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "method", "object_key"))).alias("x"))
    return d.withColumn("other", F.lead("case_id").over(W.partitionBy(F.floor(F.col("case_id") / 100)).orderBy("case_id")))


@query(EV + f""", {SETS}, g AS (SELECT case_id, list(x) AS l FROM o GROUP BY ALL), j AS (SELECT n.case_id, n.other, a.l AS a, b.l AS b FROM n JOIN g a USING (case_id) JOIN g b ON b.case_id = n.other)
SELECT case_id, other, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS union_size, CAST(len(list_distinct(list_concat(a, b))) - len(list_intersect(a, b)) AS BIGINT) AS mc_size,
  round((len(list_distinct(list_concat(a, b))) - len(list_intersect(a, b))) / len(list_distinct(list_concat(a, b))), 6) AS mc_ratio FROM j""")
def symmetric_difference_pairs(spark, sf_dir):
    f = feature_sets(spark, sf_dir)
    pairs = f.where("other is not null").select("case_id", "other", F.col("x").alias("source_tokens")).join(f.select(F.col("case_id").alias("other"), F.col("x").alias("follow_tokens")), "other")
    return coverage.pair_coverage(pairs).select("case_id", "other", F.col("union_coverage_size").alias("union_size"), "mc_size", "mc_ratio")


@query(EV + """, g AS (SELECT case_id, count(*) FILTER (method = 'set') AS size, arg_max(method, step_idx) AS relation FROM st GROUP BY ALL)
SELECT relation, count(*) AS n, round(avg(size), 6) AS mean_size, round(median(size), 6) AS median_size, max(size) AS max_size, count(*) FILTER (size = 0) AS n_zero, round(coalesce(stddev_pop(size) / nullif(avg(size), 0), 0), 6) AS cv FROM g GROUP BY ALL""")
def relation_stats(spark, sf_dir):
    g = steps(spark, sf_dir).groupBy("case_id").agg(F.count_if(F.col("method") == "set").alias("size"), F.max_by("method", "step_idx").alias("relation"))
    return metrics.relation_stats(g, ["relation"], F.col("size"))


@query("SELECT l_returnflag, round(coalesce(stddev_pop(l_quantity) / nullif(avg(l_quantity), 0), 0), 6) AS cv FROM lineitem GROUP BY ALL")
def coefficient_of_variation(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(metrics.variation(F.col("l_quantity")), 6).alias("cv"))


@query(EV + "SELECT method, count(DISTINCT object_key || ':' || \"column\") AS n_features FROM st GROUP BY ALL")
def feature_union_card(spark, sf_dir):
    return steps(spark, sf_dir).groupBy("method").agg(F.countDistinct(F.concat_ws(":", "object_key", "column")).alias("n_features"))


@query(EV + """, f AS (SELECT case_id // 100 AS u, min(case_id) AS first, min(case_id) FILTER (r = 2) AS second FROM (SELECT case_id, row_number() OVER (PARTITION BY case_id // 100 ORDER BY case_id) AS r FROM (SELECT DISTINCT case_id FROM st)) GROUP BY ALL)
SELECT DISTINCT case_id, CASE WHEN case_id = first THEN second ELSE first END AS partner FROM st JOIN f ON f.u = case_id // 100""")
def cross_case_partner(spark, sf_dir):
    """For each case the first other case of its user: of all cases, the two first of a user are enough."""
    c = steps(spark, sf_dir).select("case_id").distinct().withColumn("u", F.floor(F.col("case_id") / 100))
    firsts = c.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy("case_id"))).where("r <= 2").groupBy("u").agg(F.min("case_id").alias("first"), F.max(F.when(F.col("r") == 2, F.col("case_id"))).alias("second"))
    return c.join(firsts, "u").select("case_id", F.when(F.col("case_id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("partner"))


TERMS = "t AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(replace(text, '_', ' ')), '\\s+')) AS term FROM benchmark), k AS (SELECT * FROM t WHERE length(term) >= 4)"
HITS = f"{TERMS}, h AS (SELECT item_id, doc_id, count(*) AS score FROM k JOIN documents ON contains(lower(text), term) GROUP BY ALL)"


def found_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "benchmark").select("item_id", retrieval.terms(F.array("text")).alias("terms"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return retrieval.hits(q, docs, "item_id", "doc_id")


def hit_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.sum("score").alias("n_hits"))


def best_docs(found: DataFrame) -> DataFrame:
    return retrieval.top(found, "item_id", "doc_id", 5).select("item_id", "doc_id", "score", long("rank"))


@query(f"WITH {HITS} SELECT item_id, count(*) AS n_docs, CAST(sum(score) AS BIGINT) AS n_hits FROM h GROUP BY ALL")
def term_hit_count(spark, sf_dir):
    return hit_counts(found_terms(spark, sf_dir))


@query(f"WITH {HITS} SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM h) WHERE rank <= 5")
def topk_docs_per_query(spark, sf_dir):
    return best_docs(found_terms(spark, sf_dir))


def _picked(name: str, n: int):
    @query(f"""WITH e AS (SELECT s_suppkey, s_acctbal, s_acctbal >= 9000 AS ok FROM supplier) SELECT s_suppkey, s_acctbal FROM e WHERE ok OR NOT (SELECT bool_or(ok) FROM e) ORDER BY s_acctbal DESC, s_suppkey LIMIT {n}""")
    def run(spark, sf_dir):
        d = read(spark, sf_dir, "supplier")
        return metrics.best(d, F.col("s_acctbal"), F.col("s_acctbal") >= 9000, F.asc("s_suppkey"), n=n).select("s_suppkey", "s_acctbal")

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_picked("constrained_argmax", 1)
_picked("constrained_topn_stable", 10)

STATS = """g AS (SELECT case_id, count(*) FILTER (method = 'set') AS size, arg_max(object_key || ':' || "column", step_idx) AS relation FROM st GROUP BY ALL), s AS (SELECT relation, count(*) AS n, round(avg(size), 6) AS mean_size FROM g GROUP BY ALL)"""


def _extreme(name: str, high: bool):
    order = "mean_size DESC, relation" if high else "mean_size, n DESC, relation"

    @query(EV + f", {STATS} SELECT relation, n, mean_size FROM s ORDER BY {order} LIMIT 10")
    def run(spark, sf_dir):
        g = steps(spark, sf_dir).groupBy("case_id").agg(F.count_if(F.col("method") == "set").alias("size"), F.max_by(F.concat_ws(":", "object_key", "column"), "step_idx").alias("relation"))
        return coverage.extremes(metrics.relation_stats(g, ["relation"], F.col("size")), high).select("relation", "n", "mean_size")

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_extreme("low_relations_top10", False)
_extreme("high_relations_top10", True)


# --- mutants and mutations ---------------------------------------------------------------------


def mutant_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spark.createDataFrame(list(MUTANTS.items()), "mutant_id string, switch string")
    s = fold.state(normalised(steps(spark, sf_dir))).crossJoin(F.broadcast(every))  # a fixed handful of rows
    return cascade.judge(s.withColumn("case_id", F.struct("mutant_id", "case_id")), switch=F.col("switch")).select("case_id.mutant_id", "case_id.case_id", "prediction")


@query(VERDICTS + "SELECT 'ALWAYS_PASS' AS mutant_id, count(*) FILTER (prediction <> 'pass') AS n_changed FROM v UNION ALL SELECT 'ALWAYS_FAIL', count(*) FILTER (prediction <> 'fail') FROM v UNION ALL SELECT 'NO_GET_PAYLOAD', count(*) FILTER (final_rule_id = 'GET_PAYLOAD' AND prediction = 'fail') FROM v UNION ALL SELECT 'NO_READ_PAYLOAD', count(*) FILTER (final_rule_id = 'READ_PAYLOAD' AND prediction = 'fail') FROM v UNION ALL SELECT 'NO_STARTSESSION_FINAL', count(*) FILTER (final_rule_id = 'STARTSESSION_FINAL' AND prediction = 'fail') FROM v UNION ALL SELECT 'NO_EMPTY_RESULT', count(*) FILTER (final_rule_id IN ('ENDSESSION_PAYLOAD', 'SET_PAYLOAD', 'GENKEY_PAYLOAD') AND prediction = 'fail') FROM v")
def mutation_changes(spark, sf_dir):
    known = [*BASELINES, "NO_GET_PAYLOAD", "NO_READ_PAYLOAD", "NO_STARTSESSION_FINAL", "NO_EMPTY_RESULT"]
    return mutation_report(verdicts(spark, sf_dir), mutant_runs(spark, sf_dir)).where(F.col("mutant_id").isin(known)).select("mutant_id", "n_changed")


@query("SELECT count(DISTINCT {'k': k}) AS n_shapes FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)")
def canonical_json_identity(spark, sf_dir):
    """Equal documents whatever the order of their keys: VARIANT sorts them."""
    d = read(spark, sf_dir, "events").select(F.to_json(F.parse_json("props")).alias("canonical"))
    return d.agg(F.countDistinct("canonical").alias("n_shapes"))


@query("SELECT 'events' AS source, count(*) AS n FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'pages', count(*) FROM pages")
def union_sources(spark, sf_dir):
    part = lambda name: read(spark, sf_dir, name).select(F.lit(name).alias("source"))
    return part("events").unionByName(part("conversations")).unionByName(part("pages")).groupBy("source").agg(F.count("*").alias("n"))


@query(VERDICTS + "SELECT l.case_id, coalesce(act.n, 0) AS n_active, coalesce(act.n, 0) > 0 AND coalesce(fine, false) AS authenticated, true AS like_batch FROM l LEFT JOIN act USING (case_id) LEFT JOIN lastopen USING (case_id)")
def stream_vs_batch_fold(spark, sf_dir):
    """The sessions before each case's last step, from the stateful processor run as one batch, beside the fold's."""
    from stepfold.streaming.sessions import judge_stream, typed

    d = normalised(steps(spark, sf_dir))
    own = judge_stream(typed(d)).withColumn("id", F.col("case_id").cast("long")).drop("case_id")
    s = fold.state(d).select("case_id", "last.step_idx", F.size("active_sessions").alias("n"), F.col("authenticated").alias("a"))
    both = s.join(own, (s["case_id"] == own["id"]) & (s["step_idx"] == own["step_idx"]), "left")
    same = (F.col("n") == F.col("n_active")) & (F.col("a") == F.col("authenticated"))
    return both.select("case_id", "n_active", "authenticated", F.coalesce(same, F.lit(False)).alias("like_batch"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    from stepfold.streaming.sessions import counts_by_window

    return counts_by_window(read(spark, sf_dir, "events"), "ts", F.col("event_type")).select(F.col("window.start").alias("day"), F.col("group").alias("event_type"), "n")


@query("SELECT family, label, count(*) AS n FROM (VALUES " + ", ".join(f"('{f}', '{l}', {n})" for f, p, q in (
    ("R1", 180, 60), ("R2", 90, 90), ("R3", 9, 18), ("R4", 28, 28), ("R5", 7, 7), ("R6", 1, 1), ("R7", 1, 1), ("R8", 60, 60), ("R9", 30, 30), ("R10", 24, 72), ("R11", 2, 2),
    ("R12", 3, 6), ("R13", 7, 14), ("R14", 7, 7), ("R15", 1, 1), ("R16", 40, 16), ("R17", 90, 90), ("R18", 180, 0), ("R19", 0, 120), ("R20", 10, 10), ("R21", 8, 4),
) for l, n in (("pass", p), ("fail", q)) if n) + ") AS t(family, label, k), range(k) GROUP BY ALL")
def family_counts(spark, sf_dir):
    return families(spark).groupBy("family", "label").agg(F.count("*").alias("n"))


@query(None)
def family_verdicts(spark, sf_dir):
    """The rules' verdicts on the generated cases, by family, through the whole JSON path."""
    f = families(spark)
    s = f.select("case_id", F.posexplode("steps").alias("step_idx", "s")).select("case_id", "step_idx", "s.input", "s.output")
    return verify(s).join(f.select("case_id", "family", "label"), "case_id").groupBy("family", "label", "prediction").agg(F.count("*").alias("n"))


@query(None)
def mutation_relations(spark, sf_dir):
    """Cases derived from generated sessions by the mutation relations, and how the rules judge them."""
    f = families(spark)
    s = f.select("case_id", F.posexplode("steps").alias("step_idx", "s")).select("case_id", "step_idx", "s.input", "s.output")
    m = mutations.mutate(s)
    return mutations.pass_rate(m, verify(mutations.as_steps(m)))


@query(None)
def family_prompts(spark, sf_dir):
    f = families(spark)
    s = f.select("case_id", F.posexplode("steps").alias("step_idx", "s")).select("case_id", "step_idx", "s.input", "s.output")
    return render.prompts(s)
