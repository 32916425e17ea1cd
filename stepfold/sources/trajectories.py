"""Readers: trajectory files, dataset containers, labels, specification texts and indexes.

All read through Spark's own readers, so any store that Spark reaches will do. Raw JSON stays a string
column, as key order and repeated keys matter later.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.functions.text import case_number, norm

_PART = "array<struct<case_id:string,raw:string>>"


def read_cases(spark: SparkSession, path: str, glob: str = "tc*.json", numeric: bool = True) -> DataFrame:
    """case_id (the file name), raw, position: one row a file, in the order of the numbers in the names, or of the names."""
    raw = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    d = raw.select(F.try_element_at(F.split(F.col("_metadata.file_path"), "/"), F.lit(-1)).alias("case_id"), F.col("value").alias("raw"))
    order = F.struct(case_number(F.col("case_id")).alias("n"), "case_id") if numeric else F.struct("case_id")
    return d.withColumn("position", order)


def _load(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def _dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


def _record_list(value: object) -> list[dict]:
    held = value["records"] if isinstance(value, dict) and "records" in value else value
    return [x for x in held if isinstance(x, dict)] if isinstance(held, list) else []


def _side(record: dict, name: str) -> str:
    return _dump(record[name]) if isinstance(record.get(name), dict) else "{}"


def _steps(texts: pa.Array) -> pa.Array:
    rows = [[{"input": _side(r, "input"), "output": _side(r, "output")} for r in _record_list(_load(t))] for t in texts.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("input", pa.string()), ("output", pa.string())])))


def steps_of(cases: DataFrame) -> DataFrame:
    """case_id, step_idx, n_steps, input, output of cases with `raw`: a list of records, or an object with `records`.

    What is no record is left out before steps are numbered; a side that is no object is an empty one.
    """
    split = F.arrow_udf(_steps, "array<struct<input:string,output:string>>")(F.col("raw"))
    d = cases.select("case_id", split.alias("s"))
    return d.select("case_id", F.size("s").alias("n_steps"), F.posexplode("s").alias("step_idx", "r")).select("case_id", "step_idx", "n_steps", "r.input", "r.output")


def _members(value: object, nested: bool) -> list[tuple[str, str]]:
    if nested and isinstance(value, dict):
        value = value.get("testcases") or value.get("cases") or value.get("data") or []
        if isinstance(value, dict):
            value = [value[k] for k in sorted(value)]
    out = []
    for i, x in enumerate(value if isinstance(value, list) else []):
        named = isinstance(x, dict)
        out.append((str(x.get("id", f"case_{i}")) if named else f"case_{i}", _dump(x.get("steps", x) if named else x)))
    return out


def cases_from_json(containers: DataFrame, column: str = "raw", nested: bool = False) -> DataFrame:
    """case_id, raw, position of the cases in containers: a list of cases or of {id, steps}.

    nested: also an object that holds them under testcases, cases or data (the first that is not empty), a
    list, or an object whose values are taken in the order of its keys. Of equal ids the last one counts.
    """

    def members(texts: pa.Array) -> pa.Array:
        rows = [[{"case_id": i, "raw": r} for i, r in _members(_load(t), nested)] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("case_id", pa.string()), ("raw", pa.string())])))

    d = containers.select(F.arrow_udf(members, _PART)(F.col(column)).alias("c")).select(F.posexplode("c").alias("position", "c")).select("position", "c.case_id", "c.raw")
    return d.groupBy("case_id").agg(F.max_by("raw", "position").alias("raw"), F.max("position").alias("position"))


def _or_none(spark: SparkSession, schema: str, read: Callable[[], DataFrame]) -> DataFrame:
    """What is read, or no rows where the path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_labels(spark: SparkSession, path: str, keep_case: bool = False) -> DataFrame:
    """filename, label from JSON lines; labels trimmed and, unless told otherwise, in lower case; blank lines don't count, and a missing file has none."""
    kind = "filename string, label string"
    d = _or_none(spark, kind, lambda: spark.read.schema(kind).json(path)).where("filename is not null")
    label: Column = F.trim("label")
    return d.select("filename", (label if keep_case else F.lower(label)).alias("label"))


def read_spec_texts(spark: SparkSession, path: str) -> DataFrame:
    """path (relative), text (lower case) of all .txt files below a folder."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    # file names come as URLs, of any file system; what follows the folder's first mention is the relative path
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    folder = F.lit(re.sub("^[a-z0-9]+:/+", "/", path).rstrip("/") + "/")
    return d.select(F.substr(full, F.instr(full, folder) + F.length(folder)).alias("path"), F.lower("value").alias("text"))


def read_spec_index(spark: SparkSession, path: str) -> DataFrame:
    """Index records from JSON lines: section_title, methods, objects, fields, text_preview, and all of it as `haystack`; a missing file has none."""
    kind = "section_title string, methods array<string>, objects array<string>, fields array<string>, text_preview string"
    parts = ["section_title", F.array_join("methods", " "), F.array_join("objects", " "), F.array_join("fields", " "), "text_preview"]
    return _or_none(spark, kind, lambda: spark.read.schema(kind).json(path)).withColumn("haystack", F.lower(F.concat_ws(" ", *parts)))


def read_case_array(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases from JSON arrays: case_id, raw, label, source, spec_rule, description."""
    kind = "array<struct<records:string,steps:string,label:string,expected:string,source:string,spec_rule:string,description:string>>"
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    n = raw.select("file").distinct().count()
    d = raw.select("file", F.lit(n).alias("files"), F.posexplode(F.from_json("value", kind)).alias("n", "c"))
    file = F.regexp_extract(F.col("file"), r"([^/]+?)(\.json)?$", 1)
    several = F.col("files") > 1  # numbers are those of a file: with several, its name tells them apart
    return d.select(F.concat(F.lit("case_"), F.when(several, F.concat(file, F.lit("_"))).otherwise(""), "n").alias("case_id"), F.coalesce("c.records", "c.steps").alias("raw"), F.lower(F.trim(F.coalesce("c.label", "c.expected"))).alias("label"), "c.source", "c.spec_rule", "c.description")


def labelled(cases: DataFrame, labels: DataFrame, default: str | None = None) -> DataFrame:
    """Cases with their labels; without a default, unlabelled cases are left out."""
    named = labels.select(F.col("filename").alias("case_id"), "label")
    return cases.join(named, "case_id", "inner" if default is None else "left").withColumn("label", F.coalesce("label", F.lit(default or "")))


def blank(x: Column) -> Column:
    return norm(x) == ""
