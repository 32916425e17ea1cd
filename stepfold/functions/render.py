"""Prompts: a case as text, with a summary of its session state, and as chat messages.

Steps are rendered one by one by column expressions; only the depth-limited text of nested arguments and
payloads goes through Python, in Arrow batches. Arguments are those inside the method; a response's values
come from `return_values`, else `payload`.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions.text import truncated
from stepfold.operators.sequence import by_step

# The wording of prompts.
ASK = "Is the final response consistent with the TCG/Opal specification? Answer: "
HEAD = "TCG/Opal SSD protocol trajectory verification."
SYSTEM = "You are a TCG/Opal SSD protocol compliance verifier. Given a command-response trajectory with session state, determine if the final response is consistent with the specification. Answer exactly: pass or fail"


def brief(value: object, depth: int = 2) -> str:
    """Nested values as short text: what lies deeper than `depth` is dots, long lists show their first item and length."""
    if depth == 0 and isinstance(value, dict | list):
        return "{...}" if isinstance(value, dict) else "[...]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}={brief(v, depth - 1)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        shown = [brief(v, depth - 1) for v in value[: 3 if len(value) <= 3 else 1]]
        return "[" + ", ".join(shown) + (f", ... ({len(value)} items)" if len(value) > 3 else "") + "]"
    return value[:60] + "..." if isinstance(value, str) and len(value) > 60 and depth > 0 else str(value)


def _side(text: str | None) -> dict:
    try:
        got = json.loads(text) if text else {}
    except (ValueError, RecursionError):
        return {}
    return got if isinstance(got, dict) else {}


def arguments(command: dict) -> str:
    """The arguments inside the method: the required ones if there are any, else all."""
    method = command.get("method")
    args = method.get("args") if isinstance(method, dict) else None
    if not isinstance(args, dict):
        return brief(args) if args else ""
    required = args.get("required")
    if required and not isinstance(required, dict):
        return ""
    return brief(required or args) if args else ""


def values(response: dict) -> str:
    got = response.get("return_values", response.get("payload"))
    return "" if got is None else brief(got)


def _texts(of: Callable[[dict], str]) -> Callable[[pa.Array], pa.Array]:
    return lambda texts: pa.array([of(_side(t)) for t in texts.to_pylist()], pa.string())


def _at(json_text: str, path: str) -> Column:
    return F.get_json_object(json_text, path)


def prompts(steps: DataFrame) -> DataFrame:
    """case_id, prompt; steps: case_id, step_idx, input, output (JSON)."""
    short = lambda of, side: F.arrow_udf(_texts(of), "string")(F.col(side))
    is_object = lambda x: F.startswith(F.ltrim(x), F.lit("{"))
    d = steps.withColumns({
        "method": F.coalesce(_at("input", "$.method.name"), F.when(~is_object(_at("input", "$.method")), _at("input", "$.method")), F.lit("")),
        "target": F.coalesce(_at("input", "$.invoking_id.name"), F.when(~is_object(_at("input", "$.invoking_id")), _at("input", "$.invoking_id")), F.lit("")), "uid": F.coalesce(_at("input", "$.invoking_id.uid"), F.lit("")),
        "status": F.coalesce(_at("output", "$.status_codes.Name"), _at("output", "$.status_codes.name"), _at("output", "$.status_codes"), _at("output", "$.status.Name"), _at("output", "$.status.name"), _at("output", "$.status"), F.lit("")),
        "args_text": truncated(short(arguments, "input"), 200), "values_text": truncated(short(values, "output"), 150),
        "sp": F.coalesce(_at("input", "$.method.args.required.SPID"), F.lit("")), "write": F.coalesce(_at("input", "$.method.args.required.Write"), F.lit("")),
        "is_final": F.lead("step_idx").over(by_step()).isNull(),
    })
    opened = (F.lower("method") == "startsession") & F.contains(F.lower("status"), F.lit("success"))
    closed = F.lower("method") == "endsession"
    said = lambda c, *skip: (F.col(c) != "") & ~F.col(c).isin(*skip) if skip else F.col(c) != ""
    line = F.concat(
        F.when(F.col("is_final"), "[FINAL] ").otherwise(""), F.lit("Step "), F.col("step_idx").cast("string"), F.lit(": "), "method",
        F.when(said("target"), F.concat(F.lit(" target="), "target")).otherwise(""), F.when(said("uid"), F.concat(F.lit("["), "uid", F.lit("]"))).otherwise(""),
        F.when(said("args_text", "{}"), F.concat(F.lit(" args="), "args_text")).otherwise(""), F.lit(" → "), "status",
        F.when(said("values_text", "[]", "{}"), F.concat(F.lit(" payload="), "values_text")).otherwise(""),
    )
    label = F.when(opened & (F.col("sp") != ""), F.concat(F.lit("SPID="), "sp", F.when(~F.col("write").isin("", "0"), F.concat(F.lit(",Write="), "write")).otherwise("")))
    g = d.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("step_idx", line.alias("line")))).alias("lines"),
        F.coalesce(F.max(F.when(opened, F.col("step_idx"))) > F.coalesce(F.max(F.when(closed, F.col("step_idx"))), F.lit(-1)), F.lit(False)).alias("active"),
        F.coalesce(F.max_by(label, F.when(label.isNotNull(), F.col("step_idx"))), F.lit("")).alias("label"),
    )
    flag = F.when(F.col("active"), "True").otherwise("False")
    state = F.concat(F.lit("SessionState: active="), flag, F.lit(", auth="), flag, F.when(F.col("label") != "", F.concat(F.lit(", "), "label")).otherwise(""))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return g.select("case_id", F.concat(F.lit(HEAD + "\n"), state, F.lit("\n\n"), text, F.lit("\n\n" + ASK)).alias("prompt"))


#: Ways to write a prompt, by name; all take steps and give case_id and prompt.
FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"rich": prompts}


def prompts_as(steps: DataFrame, name: str = "rich", most: int = 0) -> DataFrame:
    """The prompts in a format of FORMATS; with `most`, of longer ones only the last characters, where the final step and the question stand."""
    if name not in FORMATS:
        raise ValueError(f"no prompt format {name!r}; there are {', '.join(sorted(FORMATS))}")
    out = FORMATS[name](steps)
    return out.withColumn("prompt", F.right("prompt", F.lit(most))) if most else out


def chat(prompts_and_labels: DataFrame) -> DataFrame:
    """case_id and the messages of a training example: system, user, assistant."""
    said = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    return prompts_and_labels.select("case_id", F.array(said("system", F.lit(SYSTEM)), said("user", F.col("prompt")), said("assistant", F.col("label"))).alias("messages"))
