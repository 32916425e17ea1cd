"""Writers: JSON, JSON lines and Markdown reports, training arrays, result logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions import text as X
from stepfold.operators import coverage, metrics, retrieval


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a row, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_results(df: DataFrame, path: str) -> None:
    """Add rows to a result log."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def rotate_results(spark, path: str) -> None:
    """Keep an earlier result log under .bak, so that a new one can begin."""
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".bak")
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        fs.delete(new, True)
        fs.rename(old, new)


def json_report(summary: DataFrame, **parts: DataFrame) -> DataFrame:
    """One row, `value`: a JSON object of a one-row summary and of arrays of the parts' rows (reports are small by nature)."""
    out = summary.select(F.struct("*").alias("summary"))
    for name, part in parts.items():
        out = out.crossJoin(part.agg(F.array_sort(F.collect_list(F.struct("*"))).alias(name)))
    return out.select(F.to_json(F.struct("*")).alias("value"))


def write_text(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").text(path)


def case_summaries(steps: DataFrame, verdicts: DataFrame, labels: DataFrame, texts: DataFrame | None = None, window: int = 5, spec_hits: int = 3) -> DataFrame:
    """A row for each labelled case: verdict, last step, the last `window` steps, its trace's rules, reads, writes and queries,
    and the specification texts that hold most of the queries' terms.

    steps: normalised; verdicts: with trace; labels: case_id, label; texts: path, text.
    """
    sign = X.event_signature(F.col("method_text"), F.col("invoking_text"), F.col("status"))
    ends = steps.groupBy("case_id").agg(
        F.max_by(F.struct(F.col("method_text").alias("final_method"), F.col("invoking_text").alias("final_invoking"), F.col("status").alias("final_status")), "step_idx").alias("end"),
        F.array_sort(F.collect_list(F.struct("step_idx", sign.alias("s")))).alias("all"),
    )
    field = F.transform(F.slice("all", F.greatest(F.size("all") - (window - 1), F.lit(1)), F.lit(window)), lambda x: x["s"])
    d = coverage.trace_columns(verdicts).join(ends, "case_id").join(labels, "case_id")
    d = d.select(
        "case_id", "label", "prediction", (F.col("label") == F.col("prediction")).alias("correct"), "n_steps", "end.*", field.alias("receptive_field"),
        F.col("rules").alias("rule_ids"), F.col("reads").alias("state_reads"), F.col("writes").alias("state_writes"), F.col("queries").alias("spec_ref_candidates"),
    )
    if texts is None:
        return d.withColumn("spec_hits", F.array().cast("array<string>"))
    asked = d.select("case_id", retrieval.terms(F.col("spec_ref_candidates")).alias("terms"))
    best = retrieval.top(retrieval.hits(asked, texts, "case_id", "path"), "case_id", "path", spec_hits)
    hits = best.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("spec_hits"))
    return d.join(hits, "case_id", "left").withColumn("spec_hits", F.coalesce("spec_hits", F.array().cast("array<string>")))


def _cell(x: Column) -> Column:
    return F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))


def mismatches(summaries: DataFrame, most: int = 20) -> DataFrame:
    """The first wrong verdicts by case: what was said and found, the last four rules, reads and writes, and the three best
    specification texts, or else the last three queries."""
    last = lambda c, n: F.slice(c, F.greatest(F.size(c) - (n - 1), F.lit(1)), F.lit(n))
    hits = F.when(F.size("spec_hits") > 0, F.slice("spec_hits", 1, 3)).otherwise(last("spec_ref_candidates", 3))
    bad = summaries.where(~F.col("correct")).orderBy("case_id").limit(most)
    return bad.select(
        "case_id", "label", "prediction", F.concat_ws(" / ", "final_method", "final_invoking").alias("final"), F.col("final_status").alias("status"),
        F.array_join(last("rule_ids", 4), ", ").alias("rules"), F.array_join(last("state_reads", 4), ", ").alias("reads"), F.array_join(last("state_writes", 4), ", ").alias("writes"), F.array_join(hits, ", ").alias("spec_hits"),
    )


def brief(summaries: DataFrame) -> DataFrame:
    """One line (value) for a terminal: the score, and how many verdicts are wrong."""
    n, right = F.count("*"), F.count_if("correct")
    return summaries.agg(n.alias("n"), right.alias("k")).select(F.format_string("score=%.2f correct=%d total=%d mismatches=%d", F.coalesce(F.try_divide(100.0 * F.col("k"), F.col("n")), F.lit(0.0)), "k", "n", F.col("n") - F.col("k")).alias("value"))


def markdown(summaries: DataFrame, title: str) -> DataFrame:
    """The lines (order, value) of a Markdown report: score, accuracy by method, mismatches, all cases."""

    def lines(part: int, df: DataFrame, key: str | None, value: Column) -> DataFrame:
        return df.select(F.struct(F.lit(part).alias("part"), (F.col(key) if key else F.lit("")).cast("string").alias("key")).alias("order"), value.alias("value"))

    spark = summaries.sparkSession
    said = lambda part, text: lines(part, spark.range(1), None, F.lit(text))
    total = metrics.accuracy(summaries, ok=F.col("correct"))
    by = metrics.accuracy(summaries, "final_method", ok=F.col("correct"))
    row = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(F.col(x)) for x in c]), F.lit(" |"))
    bad = mismatches(summaries)
    columns = ["case_id", "label", "prediction", "final", "status", "rules", "reads", "writes", "spec_hits"]
    case = F.concat(F.lit("- "), "case_id", F.lit(": "), "prediction", F.lit(" (label "), "label", F.lit("); "), F.array_join("receptive_field", "; "), F.lit("; rules "), F.array_join("rule_ids", ", "))
    parts = [
        said(0, f"# {title}"), lines(1, total, None, F.concat(F.lit("Accuracy: "), _cell(F.col("accuracy")), F.lit(" % of "), _cell(F.col("n")))),
        said(2, "## By final method"), said(3, "| method | cases | correct | accuracy |"), said(4, "| --- | --- | --- | --- |"), lines(5, by, "final_method", row("final_method", "n", "n_correct", "accuracy")),
        said(6, "## Mismatches"), said(7, "| " + " | ".join(columns) + " |"), said(8, "| " + " | ".join(["---"] * len(columns)) + " |"), lines(9, bad, "case_id", row(*columns)),
        said(10, "## All cases"), lines(11, summaries, "case_id", case),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("order")


def training_cases(cases: DataFrame, labels: DataFrame, *more: DataFrame) -> DataFrame:
    """records, label, source of labelled cases and of further sources with these columns, as one bag."""
    first = cases.join(labels, "case_id").select(F.col("raw").alias("records"), "label", F.concat(F.lit("public:"), "case_id").alias("source"))
    for m in more:
        first = first.unionByName(m.select("records", "label", "source"))
    return first
