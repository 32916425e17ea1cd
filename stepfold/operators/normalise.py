"""Steps with raw JSON become typed columns: everything later stages read of a command and its response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions import text as X
from stepfold.functions import tokens as K
from stepfold.operators.rules import ACCESSIBLE_COLUMNS, BOOLEAN_COLUMNS, KIND_UIDS

# Status and method words, keys of session ids, markers of properties, words that are no secrets.
_STATUSES = ["success", "fail", "notauthorized", "invalidparameter"]
_METHODS = ["propertiess", "properties", "startsession", "endsession", "get", "set", "activate", "genkey", "read", "write"]
_SESSION_IDS = ["hsn", "tsn", "sessionid", "hostsessionid", "spsessionid", "hostsessionnumber", "tpersessionnumber"]
_PROPERTY_MARKERS = "maxmethods|maxsessions|maxpacketcomsize|maxindtokenpacketssize|continuedtokens"
_NO_SECRETS = ["cpin", "authority", "locking", "admin1", "sid", "anybody"]


def _method(doc: Column, said: Column) -> Column:
    method, command = K.first(doc, "method", "methodname"), K.first(doc, "command")
    named = K.first(doc, "name", within=method)
    spoken = F.try_element_at(F.filter(said, lambda s: X.compact(s).isin(_METHODS)), F.lit(1))
    return F.coalesce(F.when(method["kind"] == "dict", named["text"]), F.when(method["kind"] == "string", method["text"]), F.when(command["kind"] == "string", command["text"]), spoken, F.lit(""))


def _status(doc: Column, said: Column) -> Column:
    status = K.first(doc, "status")
    named = K.first(doc, "name", within=status)
    spoken = F.try_element_at(F.filter(F.transform(said, X.compact), lambda s: s.isin(_STATUSES)), F.lit(1))
    implied = F.when(K.first(doc, "command").isNotNull() | K.first(doc, "result").isNotNull(), "success")
    held = F.when((status["kind"] == "dict") & named.isNotNull(), X.compact(named["text"])).when(status["kind"] == "string", X.compact(status["text"]))
    return F.coalesce(held, spoken, implied, F.lit(""))


def _payload(doc: Column) -> Column:
    """The first non-blank string among the payload keys, by the order of the keys."""
    held = [K.first(doc, k) for k in ("data", "payload", "bytes", "value", "pattern", "result")]
    return F.coalesce(*[F.when((t["kind"] == "string") & (t["text"] != ""), t["text"]) for t in held], F.lit(""))


def _candidate_secret(doc: Column, said: Column) -> Column:
    held = [K.first(doc, k) for k in ("pin", "newpin", "password", "credential", "hostchallenge", "challenge")]
    other = F.try_element_at(F.filter(said, lambda s: (F.length(s) >= 4) & ~X.compact(s).isin(_NO_SECRETS)), F.lit(1))
    return F.coalesce(*[F.when((t["kind"] == "string") & (t["text"] != ""), t["text"]) for t in held], other, F.lit(""))


def _columns_of(kind: Column, known: dict[str, list[str]]) -> Column:
    out = F.array().cast("array<string>")
    for k, columns in known.items():
        out = F.when(kind == k, F.array(*[F.lit(c) for c in columns])).otherwise(out)
    return out


def object_kind(invoking: Column, uid: Column) -> Column:
    """The kind of an object, by its compacted name, else by how its compacted id begins; empty if neither tells."""
    kind = F.lit("")
    for k, start in reversed(KIND_UIDS.items()):
        kind = F.when(F.startswith(uid, F.lit(start)), k).otherwise(kind)
    for k in reversed(KIND_UIDS):
        kind = F.when(F.contains(invoking, F.lit(k)), k).otherwise(kind)
    return kind


def normalise(steps: DataFrame) -> DataFrame:
    """case_id, step_idx and the typed columns of each step; `steps` has case_id, step_idx, input, output (JSON).

    Parsing runs once a side, in Arrow batches; all else is column expressions over the tokens.
    """
    d = steps.select("case_id", "step_idx", K.tokens(F.col("input")).alias("i"), K.tokens(F.col("output")).alias("o"))
    d = d.withColumns({"said": K.strings(F.col("i")), "answered": K.strings(F.col("o"))})
    i, o = F.col("i"), F.col("o")
    d = d.withColumns({
        "_invoking": K.first(i, "invokinguid", "invokingid", "invoking"), "_command": K.first(i, "command"), "_reply": K.first(o, "command"),
        "_returned": K.first(o, "returnvalues"),
        "cells_in": K.cells(i), "cells_out": K.cells(o), "requested": K.requested_columns(i),
    })
    inv, command, reply = F.col("_invoking"), F.col("_command"), F.col("_reply")
    inv_uid = K.first(i, "uid", within=inv)
    d = d.withColumns({
        "method_text": _method(i, F.col("said")),
        "status": _status(o, F.col("answered")),
        "invoking_text": F.coalesce(F.when(inv["kind"] == "dict", F.coalesce(K.first(i, "name", within=inv)["text"], inv_uid["text"])), inv["text"], F.lit("")),
        "invoking_uid_text": F.coalesce(F.when(inv["kind"] == "dict", inv_uid["text"]), F.when(inv["kind"] == "string", inv["text"]), F.lit("")),
        "is_data_command": F.coalesce((command["kind"] == "string") & K.compact_of(command).isin("read", "write"), F.lit(False)),
        "session_in": K.text_of(K.first(i, *_SESSION_IDS)), "session_out": K.text_of(K.first(o, *_SESSION_IDS)),
        "challenge": K.text_of(K.first(i, "hostchallenge", "hostchallange", "challenge")),
        "host_session_in": K.text_of(K.first(i, "hostsessionid")), "host_session_out": K.text_of(K.first(o, "hostsessionid")), "sp_session_out": K.text_of(K.first(o, "spsessionid")),
        "reply_method": X.compact(_method(o, F.col("answered"))),
        "reply_command": K.compact_of(reply), "has_reply_command": reply.isNotNull(),
        "payload_in": _payload(i), "payload_out": _payload(o),
        "address": F.coalesce(*[K.first(i, k)["text"] for k in ("lba", "startlba", "address", "offset")], F.lit("default")),
        "result_empty": K.empty_below(o, F.col("_returned")),
        "has_properties": F.exists("answered", lambda s: X.compact(s).rlike(_PROPERTY_MARKERS)),
        "mentions_cpin": X.contains_text(F.col("said"), "C_PIN"),
        "cellblock_invalid": K.cellblock_invalid(i), "columns_repeated": K.repeated_columns(i),
        "candidate": _candidate_secret(i, F.col("said")),
    })
    d = d.withColumns({"method": X.compact(F.col("method_text")), "invoking": X.compact(F.col("invoking_text")), "invoking_uid": X.compact(F.col("invoking_uid_text")), "challenge_malformed": X.challenge_malformed(F.col("challenge"))})
    d = d.withColumn("object_kind", object_kind(F.col("invoking"), F.col("invoking_uid")))
    cell_names = F.transform("cells_in", lambda c: c["column"])
    allowed = _columns_of(F.col("object_kind"), ACCESSIBLE_COLUMNS)
    wanted = F.when(F.col("method") == "get", F.col("requested")).when(F.col("method") == "set", cell_names).otherwise(F.array().cast("array<string>"))
    secrets = F.transform(F.filter("cells_in", lambda c: (c["kind"] == "string") & (c["text"] != "")), lambda c: c["text"])
    guess = F.when((F.col("candidate") != "") & (X.compact(F.col("candidate")) != "method"), F.array("candidate")).otherwise(F.array().cast("array<string>"))
    return d.withColumns({
        "object_key": F.when(F.col("invoking_uid") != "", F.concat_ws(":", "invoking", "invoking_uid")).otherwise(F.col("invoking")),
        "bad_bool": F.exists("cells_in", lambda c: F.array_contains(_columns_of(F.col("object_kind"), BOOLEAN_COLUMNS), c["column"]) & X.bool_invalid(c["kind"], c["text"])),
        "known_access": F.when((F.size(wanted) > 0) & X.is_subset(wanted, allowed), F.concat(F.col("object_kind"), F.lit(":"), F.array_join(F.array_sort(wanted), ","))).otherwise(""),
        "secrets": F.array_union(secrets, guess),
    }).drop("i", "o", "said", "answered", "candidate", "_invoking", "_command", "_reply", "_returned")
