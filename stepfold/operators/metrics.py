"""Evaluation metrics over (gold, prediction) rows; the positive class is `fail`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions.text import binary_entropy


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(df: DataFrame, *by: str, ok: Column) -> DataFrame:
    """n, n_correct, accuracy (percent, 0 without rows), by group."""
    n, good = F.count("*"), F.count_if(ok)
    return df.groupBy(*by).agg(n.alias("n"), good.alias("n_correct"), F.round(100 * _ratio(good, n), 4).alias("accuracy"))


def confusion(df: DataFrame, gold: Column, pred: Column, *by: str) -> DataFrame:
    hit = lambda g, p: F.count_if((gold == g) & (pred == p))
    return df.groupBy(*by).agg(hit("fail", "fail").alias("tp"), hit("pass", "fail").alias("fp"), hit("fail", "pass").alias("fn"), hit("pass", "pass").alias("tn"))


def scores(counts: DataFrame) -> DataFrame:
    """accuracy, fail_precision, fail_recall, f1_fail from tp, fp, fn, tn, to four digits, half to even."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    out = {"accuracy": _ratio(tp + tn, tp + fp + fn + tn), "fail_precision": p, "fail_recall": r, "f1_fail": f1}
    return counts.withColumns({k: F.bround(v, 4) for k, v in out.items()})


def calibration(df: DataFrame, p: Column, gold: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error: by confidence bins, whose confidence is their middle."""
    conf = F.greatest(p, 1 - p)
    ok = F.when(p > 0.5, "fail").otherwise("pass") == gold
    d = df.select(F.least(F.floor(conf * bins), F.lit(bins - 1)).alias("bin"), ok.cast("double").alias("ok"))
    per = d.groupBy("bin").agg(F.count("*").alias("n"), F.avg("ok").alias("acc"))
    return per.agg(F.round(F.coalesce(F.sum(F.abs(F.col("acc") - (F.col("bin") + 0.5) / bins) * F.col("n")) / F.sum("n"), F.lit(0.0)), 6).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def spread(df: DataFrame, x: Column, *by: str, name: str = "x") -> DataFrame:
    """n, min, max and mean, by group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.min(x), 6).alias(f"min_{name}"), F.round(F.max(x), 6).alias(f"max_{name}"), F.round(F.avg(x), 6).alias(f"mean_{name}"))


def entropy_stats(df: DataFrame, p: Column, *by: str) -> DataFrame:
    return spread(df, binary_entropy(p), *by, name="entropy")


def variation(x: Column) -> Column:
    """Coefficient of variation: the population's standard deviation by the mean, 0 where either is missing."""
    return F.coalesce(F.try_divide(F.stddev_pop(x), F.avg(x)), F.lit(0.0))


def relation_stats(df: DataFrame, by: list[str], size: Column) -> DataFrame:
    """n, mean, median, max, zeros, and coefficient of variation of the sizes, by group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(size), 6).alias("mean_size"), F.round(F.median(size), 6).alias("median_size"),
        F.max(size).cast("long").alias("max_size"), F.count_if(size == 0).alias("n_zero"), F.round(variation(size), 6).alias("cv"),
    )


def best(df: DataFrame, key: Column, enough: Column, *ties: Column, n: int = 1) -> DataFrame:
    """The n rows with the greatest key among those that are good enough, or among all if none is; ties by the given order."""
    ok = enough.cast("int")
    most = df.agg(F.max(ok).alias("_most"))
    return df.withColumn("_ok", ok).join(F.broadcast(most), F.col("_ok") == F.col("_most")).orderBy(key.desc(), *ties).limit(n).drop("_ok", "_most")  # `most` is one row
