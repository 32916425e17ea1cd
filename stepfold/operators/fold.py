"""The state of each case before its last step, in one exchange by case.

A case's steps are aggregated once: its last step, and of the steps, only those that state or a trace needs
(errors, and methods that change state). Order then decides: sessions are folded in step order; of cells and payloads, the last
write counts. All of it is JVM-side higher-order functions. A case is one protocol log, which one task
holds; for logs without an end see `stepfold.streaming`, whose state is bounded by the distinct keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions import text as X


def cases(steps: DataFrame) -> DataFrame:
    """case_id, n_steps, last (the last step) and the events of the steps; `steps` comes from `normalise`."""
    done = F.col("status") == "success"
    is_ = lambda *m: F.col("method").isin(*m)
    others = [c for c in steps.columns if c != "case_id"]
    event = F.struct(
        F.col("step_idx").alias("step"), "method", "status", "invoking", "invoking_uid", "session_in", "session_out", "challenge_malformed", "object_key", "address", "payload_in",
        F.when(is_("set") & done, F.col("cells_in")).alias("cells"), F.when(is_("set") & done & F.col("mentions_cpin"), F.col("secrets")).alias("secrets"),
    )
    needed = F.when(~done | is_("startsession", "endsession", "set", "activate", "write", "genkey"), event)
    return steps.groupBy("case_id").agg(F.count("*").alias("n_steps"), F.max_by(F.struct(*others), "step_idx").alias("last"), F.array_sort(F.collect_list(needed)).alias("events"))


def _sessions(prefix: Column) -> Column:
    """Active sessions and authentication after the steps, and the session id that each start got."""
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("active"), F.lit(False).alias("auth"), F.array().cast("array<struct<step:int,sid:string>>").alias("sids"))

    def step(acc: Column, e: Column) -> Column:
        given = F.coalesce(F.nullif(e["session_out"], F.lit("")), F.nullif(e["session_in"], F.lit("")), (F.size(acc["active"]) + 1).cast("string"))
        left = F.when(e["session_in"] == "", none).otherwise(F.array_remove(acc["active"], e["session_in"]))
        started = F.struct(F.array_union(acc["active"], F.array(given)).alias("active"), (~e["challenge_malformed"]).alias("auth"), F.concat(acc["sids"], F.array(F.struct(e["step"].cast("int").alias("step"), given.alias("sid")))).alias("sids"))
        ended = F.struct(left.alias("active"), ((F.size(left) > 0) & acc["auth"]).alias("auth"), acc["sids"].alias("sids"))
        return F.when(e["method"] == "startsession", started).otherwise(ended)

    return F.aggregate(F.filter(prefix, lambda e: e["method"].isin("startsession", "endsession")), zero, step)


def state(steps: DataFrame) -> DataFrame:
    """One row a case: case_id, n_steps, last, prefix (events before it), and the state variables."""
    d = cases(steps).withColumn("prefix", F.filter("events", lambda e: e["step"] < F.col("last.step_idx")))
    d = d.withColumn("good", F.filter("prefix", lambda e: e["status"] == "success"))
    good = F.col("good")
    of = lambda *m: F.filter(good, lambda e: e["method"].isin(*m))
    d = d.withColumns({
        "sessions": _sessions(good),
        "known_secrets": F.array_distinct(F.flatten(F.transform(F.filter(of("set"), lambda e: e["secrets"].isNotNull()), lambda e: e["secrets"]))),
        "activated_sps": F.array_distinct(F.transform(F.filter(of("activate"), lambda e: F.contains(e["invoking"], F.lit("sp"))), lambda e: e["invoking"])),
        "fields": F.flatten(F.transform(of("set"), lambda e: F.transform(e["cells"], lambda c: F.struct(e["object_key"].alias("object_key"), c["column"].alias("column"), c["kind"].alias("kind"), c["text"].alias("text"))))),
        "payload_writes": F.filter(of("write"), lambda e: e["payload_in"] != ""),
        "last_write": F.array_max(F.transform(of("write"), lambda e: e["step"])),
        "last_genkey": F.array_max(F.transform(of("genkey"), lambda e: e["step"])),
        "last_error": F.coalesce(F.try_element_at(F.filter("prefix", lambda e: e["status"] != "success"), F.lit(-1))["status"], F.lit("")),
    })
    first_payload = F.try_element_at(F.col("payload_writes"), F.lit(1))["step"]
    return d.withColumns({
        "first_payload": first_payload,
        "active_sessions": F.col("sessions.active"), "authenticated": F.col("sessions.auth"),
        "generated_key": F.coalesce((F.col("last_genkey") > F.coalesce("last_write", F.lit(-1))) & (first_payload < F.col("last_genkey")), F.lit(False)),
        "expected_payload": F.coalesce(F.try_element_at(F.filter("payload_writes", lambda e: e["address"] == F.col("last.address")), F.lit(-1))["payload_in"], F.lit("")),
    }).drop("events", "sessions.sids")


def last_cell(fields: Column, key: Column, column: str | Column) -> Column:
    """The cell last written to a column of an object, or null."""
    return F.try_element_at(F.filter(fields, lambda f: (f["object_key"] == key) & (f["column"] == column)), F.lit(-1))


def truthy_cell(fields: Column, key: Column, column: str) -> Column:
    cell = last_cell(fields, key, column)
    return F.coalesce(X.bool_truthy(cell["kind"], cell["text"]), F.lit(False))


def effects(e: Column, sids: Column, first_payload: Column) -> Column:
    """The trace events of a step before the last; first_payload: the first step that wrote data."""

    def event(rule: str, reads: list[str], writes: list[str], detail: Column) -> Column:
        listed = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        return F.struct(e["step"].cast("int").alias("step"), F.lit(rule).alias("rule_id"), listed(reads).alias("state_reads"), listed(writes).alias("state_writes"), detail.alias("detail"))

    none = F.array().cast("array<struct<step:int,rule_id:string,state_reads:array<string>,state_writes:array<string>,detail:string>>")
    sid = F.try_element_at(F.filter(sids, lambda s: s["step"] == e["step"]), F.lit(1))["sid"]
    columns = F.array_join(F.array_sort(F.transform(e["cells"], lambda c: c["column"])), ",")
    wrote = F.coalesce(first_payload < e["step"], F.lit(False))
    secret = F.when(F.size(F.coalesce(e["secrets"], F.array().cast("array<string>"))) > 0, F.array(event("SET_CPIN_SECRET", ["C_PIN"], ["known_secrets"], F.concat(F.lit("C_PIN updated count="), F.size(F.array_distinct(e["secrets"])).cast("string"))))).otherwise(none)
    cells = F.when(F.size(e["cells"]) > 0, F.array(event("SET_OBJECT_FIELDS", ["Values", "invoking_uid"], ["object_fields"], F.concat(F.lit("columns="), columns)))).otherwise(none)
    return (
        F.when(e["status"] != "success", F.array(event("OBSERVE_ERROR", [], ["last_error"], F.concat(e["method"], F.lit("->"), e["status"]))))
        .when(e["method"] == "startsession", F.array(event("STARTSESSION_EFFECT", ["HostChallenge"], ["active_sessions", "authenticated"], F.concat(F.lit("sid="), sid))))
        .when(e["method"] == "endsession", F.array(event("ENDSESSION_EFFECT", ["active_sessions"], ["active_sessions", "authenticated"], F.concat(F.lit("sid="), F.coalesce(F.nullif(e["session_in"], F.lit("")), F.lit("all"))))))
        .when(e["method"] == "set", F.concat(secret, cells))
        .when((e["method"] == "activate") & F.contains(e["invoking"], F.lit("sp")), F.array(event("ACTIVATE_SP_EFFECT", ["invoking_uid"], ["activated_sps"], e["invoking_uid"])))
        .when(e["method"] == "write", F.array(event("WRITE_PAYLOAD_EFFECT", ["LBA", "payload"], ["written_payloads", "generated_key_after_write"], F.concat(F.lit("address="), e["address"]))))
        .when(e["method"] == "genkey", F.array(event("GENKEY_EFFECT", ["written_payloads"], ["generated_key_after_write"], F.concat(F.lit("after_write="), F.when(wrote, "True").otherwise("False")))))
        .otherwise(none)
    )
