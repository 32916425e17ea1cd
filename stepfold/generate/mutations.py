"""Mutation relations: from observed cases, new cases whose verdict the protocol fixes.

Each step of each case meets a table of relations; those whose condition holds at the step give one new
case each: the steps up to it (or the step alone), with its response replaced and, where the relation says
so, a command patched, its own or that of an earlier step. All conditions are columns, so all relations
together are one pass over the steps, one window per as-of partner, and one explode; only patched
commands go through Python, in Arrow batches.

Out come name (source:relation:step), expected, source, relation, reason, the steps as JSON, and a key that
no two new cases share (the name, and the patched step where that is an earlier one).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepfold.functions import text as X
from stepfold.operators.normalise import _columns_of, normalise
from stepfold.operators.rules import ACCESSIBLE_COLUMNS, BOOLEAN_COLUMNS
from stepfold.operators.sequence import by_step, first_after, latest_before

# Responses, in the shapes that logs have.
EMPTY = '{"return_values": [], "status_codes": "SUCCESS"}'
STRANGE = '{"return_values": [{"unexpected": 1}], "status_codes": "SUCCESS"}'
SYNC = '{"method": {"name": "%s"}, "return_values": {"required": {%s}, "optional": {}}, "status_codes": "SUCCESS"}'
STARTED = '{"return_values": {"required": {"HostSessionID": "00000001", "SPSessionID": "00000002"}, "optional": {}}, "status_codes": "SUCCESS"}'
WRONG_SECRET = "f" * 64


def _refused(status: str) -> str:
    return '{"return_values": {}, "status_codes": "%s"}' % status


def patched(command: str | None, patch: str | None) -> str | None:
    """A command with optional arguments set, arguments taken away, its target replaced, or cells merged into its values."""
    if not command or not patch:
        return command
    c, p = json.loads(command), json.loads(patch)
    if "invoking_id" in p:
        c["invoking_id"] = p["invoking_id"]
    for name in p.get("without", []):
        if isinstance(c.get("args"), dict):
            c["args"].pop(name, None)
    if "optional" in p:
        c.setdefault("method", {}).setdefault("args", {}).setdefault("optional", {}).update(p["optional"])
    return json.dumps(c, ensure_ascii=False)


def _patch_all(commands: pa.Array, patches: pa.Array) -> pa.Array:
    return pa.array([patched(c, p) for c, p in zip(commands.to_pylist(), patches.to_pylist())], pa.string())


def _optional(name: str, value: Column) -> Column:
    """A patch that sets one optional argument to a JSON value."""
    return F.concat(F.lit('{"optional": {' + json.dumps(name) + ": "), value, F.lit("}}"))


def _quoted(text: Column) -> Column:
    return F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def _values(cells: Column, **more: int) -> Column:
    """A patch that sets Values to the command's cells with some replaced."""
    kept = F.filter(cells, lambda c: ~c["column"].isin(*more))
    shown = F.transform(kept, lambda c: F.concat(F.lit('"'), c["column"], F.lit('": '), F.when(c["kind"] == "string", _quoted(c["text"])).when(c["kind"] == "bool", F.lower(c["text"])).when(c["kind"] == "null", "null").otherwise(c["text"])))
    new = F.array(*[F.lit(f'"{k}": {v}') for k, v in more.items()])
    return _optional("Values", F.concat(F.lit("[{"), F.array_join(F.concat(shown, new), ", "), F.lit("}]")))


def relations(d: DataFrame) -> list[Column]:
    """The relations, each null at steps where its condition does not hold."""
    is_ = lambda name: F.lower("method_text") == name.lower()
    out: list[Column] = []

    def put(name: str | Column, expected: str, reason: str, when: Column, response: str | Column, patch: Column | None = None, at: Column | None = None, alone: bool = False) -> None:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        out.append(F.when(when, F.struct(
            text(name).alias("relation"), F.lit(expected).alias("expected"), F.lit(reason).alias("reason"), text(response).alias("response"),
            (patch if patch is not None else F.lit(None).cast("string")).alias("patch"), (at if at is not None else F.col("step_idx")).cast("int").alias("at"), F.lit(alone).alias("alone"),
        )))

    genkey, start, get, set_, end = is_("GenKey"), is_("StartSession"), is_("Get"), is_("Set"), is_("EndSession")
    put("genkey_empty_success", "pass", "GenKey returns nothing.", genkey, EMPTY)
    put("genkey_nonempty_success", "fail", "GenKey returns no key material.", genkey, '{"return_values": [{"unexpected": "key"}], "status_codes": "SUCCESS"}')
    put("genkey_no_session_success", "fail", "GenKey needs a session.", genkey, EMPTY, alone=True)
    put("genkey_no_session_rejected", "pass", "GenKey without a session may be refused.", genkey, _refused("NOT_AUTHORIZED"), alone=True)

    bad = _optional("HostChallenge", F.lit(json.dumps("a" * 33)))
    challenged = start & F.contains("input", F.lit("HostChallenge"))
    put("malformed_challenge_success", "fail", "A malformed challenge opens no session.", challenged, '{"return_values": {"HostSessionID": "00000001", "SPSessionID": "00000002"}, "status_codes": "SUCCESS"}', bad)
    put("malformed_challenge_not_authorized", "pass", "A malformed challenge may be refused.", challenged, _refused("NOT_AUTHORIZED"), bad)

    properties = is_("Properties")
    put("properties_wrong_target_success", "fail", "Properties belongs to the session manager.", properties, '{"return_values": [{"MaxMethods": 8, "MaxSessions": 4}], "status_codes": "SUCCESS"}', F.lit('{"invoking_id": {"uid": "00 00 02 05 00 00 00 02", "name": "SP", "type": null}}'))
    put("properties_missing_payload_success", "fail", "Properties returns properties.", properties, EMPTY)

    final_read = (F.col("command") == "Read") & (F.col("step_idx") == F.col("last_read")) & (F.col("last_read") >= F.col("last_genkey"))
    put("read_old_pattern_after_genkey", "fail", "A new key hides what was written.", final_read, '{"command": "Read", "args": {"result": "Pattern 8E"}}')
    put("read_random_after_genkey", "pass", "After a new key, other data is read.", final_read, '{"command": "Read", "args": {"result": "Random Data"}}')
    put("read_success_missing_result", "fail", "A read returns data.", final_read, '{"command": "Read", "args": {}}')
    put("read_wrong_response_command", "fail", "A read is answered as a read.", final_read, '{"command": "Write", "args": {"result": "Random Data"}}')
    late_write = (F.col("command") == "Write") & (F.col("write_rank") <= 2) & (F.col("last_read") >= F.col("last_genkey"))
    put("write_missing_payload_success", "fail", "A write carries data.", late_write, '{"command": "Write", "args": {}}', F.lit('{"without": ["data", "payload", "pattern"]}'))
    put("write_wrong_response_command", "fail", "A write is answered as a write.", late_write, '{"command": "Read", "args": {}}')

    for name, columns in (("read", {"5": 1, "7": 1}), ("write", {"6": 1, "8": 1})):
        there = (X.compact(F.col("command")) == name) & F.col("locking_set").isNotNull()
        lock, at = _values(F.col("locking_set.cells_in"), **columns), F.col("locking_set.step_idx")
        put(f"locking_{name}_locked_success", "fail", "A locked range gives no access.", there, F.col("output"), lock, at)
        put(f"locking_{name}_locked_fail", "pass", "A locked range may refuse.", there, F.concat(F.lit('{"command": "'), "command", F.lit('", "result": "fail"}')), lock, at)
        put(f"locking_{name}_locked_not_authorized", "pass", "A locked range may refuse as not authorised.", there, '{"status_codes": "NOT_AUTHORIZED"}', lock, at)

    put("get_no_session_success", "fail", "Get needs a session.", get, '{"return_values": [{"1": "value"}], "status_codes": "SUCCESS"}', alone=True)
    put("get_no_session_rejected", "pass", "Get without a session may be refused.", get, _refused("NOT_AUTHORIZED"), alone=True)

    known = start & F.col("secret").isNotNull() & (F.col("secret") != WRONG_SECRET)
    right, wrong = _optional("HostChallenge", _quoted(F.col("secret"))), _optional("HostChallenge", F.lit(json.dumps(WRONG_SECRET)))
    put("known_pin_success", "pass", "The current PIN opens a session.", known, STARTED, right)
    put("known_pin_rejected", "fail", "The current PIN is not refused.", known, _refused("NOT_AUTHORIZED"), right)
    put("wrong_pin_success", "fail", "Another PIN opens no session.", known, STARTED, wrong)
    put("wrong_pin_rejected", "pass", "Another PIN may be refused.", known, _refused("NOT_AUTHORIZED"), wrong)

    # from the step that sets the authority: the case ends with the first session started after it
    off = F.struct("start_idx", "invoking_uid_text")
    authority = (F.col("method_text") == "Set") & (F.col("object_kind") == "authority") & (F.col("invoking_uid_text") != "") & off["start_idx"].isNotNull()
    sync = SYNC % ("SyncSession", '"HostSessionID": "00000001", "SPSessionID": "00000002"')
    put("authority_disabled_start_success", "fail", "A disabled authority opens no session.", authority, sync)
    put("authority_disabled_start_rejected", "pass", "A disabled authority may be refused.", authority, _refused("NOT_AUTHORIZED"))

    put("startsession_missing_sp_session", "fail", "Both session ids are returned.", start, SYNC % ("SyncSession", '"HostSessionID": "00000001"'))
    put("startsession_wrong_host_session", "fail", "The host's session id is echoed.", start, SYNC % ("SyncSession", '"HostSessionID": "00000002", "SPSessionID": "00000003"'))
    put("startsession_wrong_response_method", "fail", "StartSession is answered by SyncSession.", start, SYNC % ("Get", '"HostSessionID": "00000001", "SPSessionID": "00000003"'))

    twice = _optional("Values", F.lit('[{"5": 1}, {"5": 0}]'))
    put("set_duplicate_column_rejected", "pass", "A column set twice is an invalid parameter.", set_, '{"return_values": [], "status_codes": "INVALID_PARAMETER"}', twice)
    put("set_duplicate_column_success", "fail", "A column cannot be set twice.", set_, EMPTY, twice)
    put("set_nonempty_success_payload", "fail", "Set returns nothing.", set_, STRANGE)

    put("endsession_success", "pass", "EndSession returns nothing.", end, '{"return_values": {"required": {}, "optional": {}}, "status_codes": "SUCCESS"}')
    put("endsession_nonempty_success", "fail", "EndSession returns nothing.", end, STRANGE)
    put("endsession_no_session_success", "fail", "EndSession needs a session.", end, _refused("SUCCESS"), alone=True)
    put("endsession_no_session_rejected", "pass", "EndSession without a session may be refused.", end, _refused("NOT_AUTHORIZED"), alone=True)

    activate = is_("Activate") & F.startswith("invoking_uid", F.lit("00000205"))
    put("activate_empty_success", "pass", "Activate returns nothing.", activate, EMPTY)
    put("activate_nonempty_success", "fail", "Activate returns nothing.", activate, STRANGE)

    kind = F.col("object_kind")
    names = F.transform("cells_in", lambda c: c["column"])
    allowed = _columns_of(kind, ACCESSIBLE_COLUMNS)
    for m, is_m, wanted in (("get", get, F.col("requested")), ("set", set_, names)):
        open_ = is_m & (kind != "") & (F.size(wanted) > 0) & X.is_subset(wanted, allowed)
        named = lambda tail, m=m: F.concat(F.lit("known_"), kind, F.lit(f"_{m}_{tail}"))
        put(named("success"), "pass", "A known field is accessible.", open_ & (F.col("status") == "success"), F.col("output"))
        for status in ("NOT_AUTHORIZED", "INVALID_PARAMETER", "FAIL"):
            put(named(status.lower()), "fail", "Access to a known field does not fail.", open_, _refused(status))

    booleans = F.array_sort(F.array_intersect(names, _columns_of(kind, BOOLEAN_COLUMNS)))
    two = _optional("Values", F.concat(F.lit('[{"'), F.get(booleans, 0), F.lit('": 2}]')))
    some = set_ & (F.size(booleans) > 0)
    put(F.concat(F.lit("known_"), kind, F.lit("_invalid_bool_rejected")), "pass", "A boolean has two values.", some, _refused("INVALID_PARAMETER"), two)
    put(F.concat(F.lit("known_"), kind, F.lit("_invalid_bool_success")), "fail", "A boolean has two values.", some, EMPTY, two)

    many = get & (F.size("requested") >= 2)
    half = F.slice(F.array_sort("requested"), F.lit(1), F.floor(F.size("requested") / 2).cast("int"))
    cells = F.array_join(F.transform(half, lambda c: F.concat(F.lit('"'), c, F.lit('": "value"'))), ", ")
    put("get_partial_columns", "fail", "Get returns all that was asked for.", many, F.concat(F.lit('{"return_values": [[{'), cells, F.lit('}]], "status_codes": "SUCCESS"}')))
    put("get_empty_success", "fail", "Get returns what was asked for.", many, EMPTY)
    return out


def with_partners(steps: DataFrame) -> DataFrame:
    """Normalised steps with their raw JSON and the other steps that relations look at."""
    d = normalise(steps).join(steps.select("case_id", "step_idx", "input", "output"), ["case_id", "step_idx"])
    d = d.withColumn("command", F.coalesce(F.get_json_object("input", "$.command"), F.lit("")))
    case = W.partitionBy("case_id")
    last = lambda when: F.max(F.when(when, F.col("step_idx"))).over(case)
    locking = (F.col("method_text") == "Set") & (F.col("object_kind") == "locking")
    three = F.get(F.filter("cells_in", lambda c: (c["column"] == "3") & (c["kind"] == "string") & (c["text"] != "")), 0)["text"]
    cpin = (F.col("method_text") == "Set") & F.col("mentions_cpin") & three.isNotNull()
    return d.withColumns({
        "last_read": last(F.col("command") == "Read"), "last_genkey": last(F.col("method_text") == "GenKey"),
        "write_rank": F.sum(F.when(F.col("command") == "Write", 1).otherwise(0)).over(by_step().rowsBetween(0, W.unboundedFollowing)),
        "locking_set": latest_before(F.struct("step_idx", "cells_in"), locking), "secret": latest_before(three, cpin),
        "start_idx": first_after(F.col("step_idx"), F.col("method_text") == "StartSession"),
    })


def mutate(steps: DataFrame) -> DataFrame:
    """name, expected, source, relation, reason, and steps (JSON pairs) of all new cases."""
    d = with_partners(steps)
    found = d.select("case_id", "step_idx", "start_idx", "invoking_uid_text", F.explode(F.array_compact(F.array(*relations(d)))).alias("r")).select("case_id", "step_idx", "start_idx", "invoking_uid_text", "r.*")
    disabled = F.startswith("relation", F.lit("authority_disabled"))
    # a disabled authority: its Set is patched, the case ends with the later StartSession, which names it
    found = found.withColumns({
        "end": F.when(disabled, F.col("start_idx")).otherwise(F.col("step_idx")),
        "patch": F.when(disabled, F.lit('{"optional": {"Values": [{"5": 0}]}}')).otherwise(F.col("patch")),
        "signer": F.when(disabled, F.concat(F.lit('{"optional": {"HostSigningAuthority": {"uid": "'), "invoking_uid_text", F.lit('", "name": "Authority", "type": null}}}'))),
    })
    whole = steps.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("step_idx", "input", "output"))).alias("all"))
    j = found.join(whole, "case_id")
    edit = F.arrow_udf(_patch_all, "string")
    at = lambda i: F.get(F.filter("all", lambda s: s["step_idx"] == F.col(i)), 0)
    j = j.withColumns({"edited": edit(at("at")["input"], F.col("patch")), "final_input": edit(F.when(F.col("at") == F.col("end"), edit(at("at")["input"], F.col("patch"))).otherwise(at("end")["input"]), F.col("signer"))})
    kept = F.filter("all", lambda s: F.when(F.col("alone"), s["step_idx"] == F.col("end")).otherwise(s["step_idx"] <= F.col("end")))
    new = F.transform(kept, lambda s: F.struct(
        F.when(s["step_idx"] == F.col("end"), F.col("final_input")).when(s["step_idx"] == F.col("at"), F.col("edited")).otherwise(s["input"]).alias("input"),
        F.when(s["step_idx"] == F.col("end"), F.col("response")).otherwise(s["output"]).alias("output"),
    ))
    name = F.concat_ws(":", F.col("case_id").cast("string"), "relation", F.col("end").cast("string"))
    # two patched steps may lead to one name: the key tells them apart
    key = F.when(F.col("at") == F.col("end"), name).otherwise(F.concat(name, F.lit("#"), F.col("at").cast("string")))
    return j.select(name.alias("name"), "expected", F.col("case_id").alias("source"), "relation", "reason", new.alias("steps"), key.alias("key"))


def as_steps(mutated: DataFrame) -> DataFrame:
    """The new cases as steps, for `verify`: case_id is the key."""
    return mutated.select(F.col("key").alias("case_id"), F.posexplode("steps").alias("step_idx", "s")).select("case_id", "step_idx", "s.input", "s.output")


def as_cases(mutated: DataFrame, most: int = 0) -> DataFrame:
    """The new cases as rows of a dataset: case_id (synthetic:name), label, synthetic_reason, steps; the first `most` by name, or all."""
    out = mutated.select(F.concat(F.lit("synthetic:"), "name").alias("case_id"), F.col("expected").alias("label"), F.col("reason").alias("synthetic_reason"), "steps")
    return out.orderBy("case_id").limit(most) if most else out


def pass_rate(mutated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """relation, n, n_correct, rate: how often the verdict is the expected one."""
    both = mutated.join(verdicts.select(F.col("case_id").alias("key"), "prediction"), "key")
    return both.groupBy("relation").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("expected")).alias("n_correct"), F.round(F.avg((F.col("prediction") == F.col("expected")).cast("double")), 6).alias("rate"))
