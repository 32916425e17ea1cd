"""The ordered rules that judge a case's last step against the state before it; the first that applies decides.

The cascade is data: a list of rules, each with the condition under which it is reached and the condition
under which the step breaks it. From the list one CASE expression gives the deciding rule, one the
verdict, one the trace. Switches turn single checks off, for mutants.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions import text as X
from stepfold.operators.fold import effects, last_cell, truthy_cell
from stepfold.operators.rules import AUTHENTICATED_METHODS, SESSION_METHODS, SPEC_QUERIES

EVENT = "struct<step:int,rule_id:string,state_reads:array<string>,state_writes:array<string>,detail:string>"


@dataclass
class Rule:
    """A rule decides where `reached` holds, unless it is one that only `stops` when broken."""

    id: str
    reached: Column
    broken: Column
    reads: list[str]
    detail: Column
    stops: bool = False


def _flag(x: Column) -> Column:
    return F.when(x, "True").otherwise("False")


def rules(off: frozenset[str] = frozenset(), switch: Column | None = None) -> list[Rule]:
    """The cascade over the columns of `fold.state`; `off` names checks that never find anything."""
    c = lambda name: F.col(f"last.{name}")
    never = F.lit(False)

    def checked(name: str, broken: Column) -> Column:
        if name in off:
            return never
        return broken if switch is None else broken & (switch != name)

    method, status, ok = c("method"), c("status"), c("status") == "success"
    in_session, authed = F.size("active_sessions") > 0, F.col("authenticated")
    bad_target = ~F.contains(c("invoking"), F.lit("sp")) | ((c("invoking_uid") != "") & ~F.startswith(c("invoking_uid"), F.lit("00000205")))
    nonempty = checked("empty_result", ~c("result_empty"))
    # the error that the state before asks for
    outside = method.isin(SESSION_METHODS) & ~c("is_data_command")
    expected = (
        F.when(outside & ~in_session, "notauthorized")
        .when(method.isin(AUTHENTICATED_METHODS) & ~c("is_data_command") & ~authed, "notauthorized")
        .when((method == "get") & c("cellblock_invalid"), "invalidparameter")
        .when((method == "set") & (c("columns_repeated") | c("bad_bool")), "invalidparameter")
        .when(checked("activate_target", (method == "activate") & bad_target), "invalidparameter")
    )
    asked = checked("precondition", method.isin(SESSION_METHODS) & expected.isNotNull())
    # a started session
    known = F.array_contains("known_secrets", c("challenge"))
    reply_bad = (
        ((c("reply_method") != "") & (c("reply_method") != "syncsession"))
        | (c("host_session_out") == "") | (c("sp_session_out") == "")
        | ((c("host_session_in") != "") & ~X.ids_equivalent(c("host_session_in"), c("host_session_out")))
    )
    start_bad = (
        F.when(c("challenge_malformed"), ok)
        .when((c("challenge") != "") & (F.size("known_secrets") > 0) & ~known, status != "notauthorized")
        .otherwise(~ok | reply_bad)
    )
    # data
    keys = F.array_distinct(F.transform(F.filter("fields", lambda f: F.contains(f["object_key"], F.lit("locking"))), lambda f: f["object_key"]))
    locked = lambda a, b: F.exists(keys, lambda k: truthy_cell(F.col("fields"), k, a) & truthy_cell(F.col("fields"), k, b))
    blocked = checked("locking", ((method == "read") & locked("5", "7")) | ((method == "write") & locked("6", "8")))
    replied = lambda name: ~c("has_reply_command") | (c("reply_command") == name)
    actual, written = c("payload_out"), F.col("expected_payload")
    read_bad = ~replied("read") | (actual == "") | (
        F.when(F.col("generated_key") & (written != ""), X.payloads_equivalent(actual, written))
        .when(F.col("generated_key"), F.length(X.compact(actual)) <= 2)
        .when(written != "", ~X.payloads_equivalent(actual, written))
        .otherwise(False)
    )
    write_bad = c("is_data_command") & ((c("payload_in") == "") | ~replied("write"))
    given = F.transform(c("cells_out"), lambda x: x["column"])

    def stale(column: Column) -> Column:
        was = last_cell(F.col("fields"), c("object_key"), column)
        now = F.try_element_at(F.filter(c("cells_out"), lambda x: x["column"] == column), F.lit(1))
        return F.coalesce(was.isNotNull() & now.isNotNull() & (X.compact(was["text"]) != X.compact(now["text"])), F.lit(False))

    get_bad = (F.size(c("requested")) > 0) & (~X.is_subset(c("requested"), given) | F.exists(c("requested"), stale))
    wrong_object = ((c("invoking") != "") & ~F.contains(c("invoking"), F.lit("sessionmanager"))) | ((c("invoking_uid") != "") & ~F.endswith(c("invoking_uid"), F.lit("ff")))
    target_bad, load_bad = checked("properties_target", wrong_object), ~ok | checked("properties_payload", ~c("has_properties"))
    said = lambda broken: F.concat(F.lit("inconsistent="), _flag(broken))
    bad_value = (method == "set") & c("bad_bool")
    read_state, start = ["active_sessions", "authenticated", "invoking_uid"], checked("startsession", start_bad)
    access = c("known_access") != ""
    out = [
        Rule("PARSE_FINAL_COMMAND", (method == "") | (status == ""), F.lit(True), [], F.lit("missing method/status")),
        Rule("PROPERTIES_TARGET", method == "properties", target_bad, ["invoking_name", "invoking_uid"], F.concat(F.lit("uid="), c("invoking_uid"), F.lit(", "), said(target_bad)), stops=True),
        Rule("PROPERTIES_PAYLOAD", method == "properties", load_bad, ["status", "return_values"], said(load_bad)),
        Rule("STARTSESSION_FINAL", method == "startsession", start, ["HostChallenge", "known_secrets", "HostSessionID", "SPSessionID", "status"], said(start)),
        Rule("LOCKING_DATA_ACCESS", blocked, ~status.isin("fail", "notauthorized"), ["object_fields", "LBA", "status"], F.concat(F.lit("method="), method, F.lit(", status="), status, F.lit(", "), said(~status.isin("fail", "notauthorized")))),
        Rule("KNOWN_FIELD_INVALID_VALUE", asked & bad_value, status != expected, [*read_state, "Values"], F.concat(F.lit("expected="), expected, F.lit(", actual="), status)),
        Rule("PRECONDITION_EXPECTED_ERROR", asked, status != expected, read_state, F.concat(F.lit("expected="), expected, F.lit(", actual="), status)),
        Rule("KNOWN_FIELD_EXPECTED_SUCCESS", method.isin(SESSION_METHODS) & ~ok & access, F.lit(True), [*read_state, "Cellblock", "Values"], F.concat(F.lit("expected_success="), c("known_access"), F.lit(", actual="), status)),
        Rule("UNEXPECTED_ERROR_STATUS", method.isin(SESSION_METHODS) & ~ok, F.lit(True), ["status"], status),
        Rule("ACTIVATE_TARGET", method == "activate", checked("activate_target", bad_target), ["invoking_name", "invoking_uid"], F.concat(F.lit("uid="), c("invoking_uid"), F.lit(", "), said(checked("activate_target", bad_target))), stops=True),
        Rule("ACTIVATE_PAYLOAD", method == "activate", nonempty, ["return_values"], said(nonempty)),
        Rule("ENDSESSION_PAYLOAD", (method == "endsession") & ok, nonempty, ["active_sessions", "return_values"], said(nonempty)),
        Rule("SET_PAYLOAD", (method == "set") & ok, nonempty, ["return_values"], said(nonempty)),
        Rule("READ_PAYLOAD", (method == "read") & ok, checked("read_payload", read_bad), ["written_payloads", "generated_key_after_write", "result"], said(checked("read_payload", read_bad))),
        Rule("WRITE_RESPONSE", (method == "write") & ok, write_bad, ["payload", "command"], said(write_bad)),
        Rule("GENKEY_PAYLOAD", (method == "genkey") & ok, nonempty, ["return_values"], said(nonempty)),
        Rule("GET_PAYLOAD", (method == "get") & ok, checked("get_payload", get_bad), ["Cellblock", "object_fields", "return_values"], said(checked("get_payload", get_bad))),
        Rule("AUTHENTICATE_NO_SESSION", (method == "authenticate") & ok & ~in_session, F.lit(True), ["active_sessions", "status"], F.lit("no_session_but_success")),
        Rule("AUTHENTICATE_SUCCESS", (method == "authenticate") & ok, F.lit(False), ["active_sessions", "status", "return_values"], F.lit("in session")),
        Rule("DEFAULT_PASS", F.lit(True), F.lit(False), ["status"], method),
    ]
    return out


def judge(states: DataFrame, with_trace: bool = False, off: Iterable[str] = (), switch: Column | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """case_id, prediction, final_rule_id, n_steps and, if asked, the trace, of `fold.state`'s rows; `keep`: further columns of these."""
    held = rules(frozenset(off), switch)
    decided, broken = F.lit(None), F.lit(None)
    for r in reversed(held):
        when = r.reached & r.broken if r.stops else r.reached
        decided, broken = F.when(when, F.lit(r.id)).otherwise(decided), F.when(when, r.broken).otherwise(broken)
    # without the known-field check, errors on known kinds of objects are not looked at at all
    spared = F.col("last.method").isin("get", "set") & (F.col("last.status") != "success") & (F.col("last.object_kind") != "")
    without = F.lit("known_field_success" in off) if switch is None else switch == "known_field_success"
    d = states.withColumns({"final_rule_id": decided, "_broken": F.when(without & spared, False).otherwise(broken)})
    if switch is not None:
        d = d.withColumn("_broken", F.when(switch == "always_pass", False).when(switch == "always_fail", True).otherwise(F.col("_broken")))
    d = d.withColumn("prediction", F.when(F.col("_broken"), "fail").otherwise("pass"))
    out = ["case_id", "prediction", "final_rule_id", F.col("n_steps").cast("long").alias("n_steps")]
    if with_trace:
        listed = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        none = F.array().cast(f"array<{EVENT}>")
        ends = none
        before: list[Column] = []
        for r in held:
            event = F.struct(F.col("last.step_idx").cast("int").alias("step"), F.lit(r.id).alias("rule_id"), listed(r.reads).alias("state_reads"), listed([]).alias("state_writes"), r.detail.alias("detail"))
            shown = F.col("final_rule_id") == r.id
            if r.stops:  # a rule passed on the way leaves its mark too
                follower = held[held.index(r) + 1].id
                shown = shown | (F.col("final_rule_id") == follower)
            before.append(F.when(shown, F.array(event)).otherwise(none))
        ends = F.concat(*before)
        steps = F.flatten(F.transform("prefix", lambda e: effects(e, F.col("sessions.sids"), F.col("first_payload"))))
        queries = F.create_map(*[F.lit(x) for kv in SPEC_QUERIES.items() for x in kv])
        trace = F.transform(F.concat(steps, ends), lambda e: F.struct(e["step"].alias("step"), e["rule_id"].alias("rule_id"), e["state_reads"].alias("state_reads"), e["state_writes"].alias("state_writes"), F.array(queries[e["rule_id"]]).alias("spec_ref_candidates"), e["detail"].alias("detail")))
        out.append(trace.alias("trace"))
    return d.select(*out, *keep)
