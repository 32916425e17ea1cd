"""Order-aware operators over steps: numbering, frames, as-of partners, last writes.

Each is one window (or one aggregate) over the case; operators with the same partitioning and order share
one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def by_step(case: str = "case_id", *order: str):
    return W.partitionBy(case).orderBy(*(order or ("step_idx",)))


def number_steps(df: DataFrame, case: str, *order: str) -> DataFrame:
    """step_idx from 0, and n_steps, of each row within its case."""
    return df.withColumns({"step_idx": (F.row_number().over(by_step(case, *order)) - 1).cast("int"), "n_steps": F.count("*").over(W.partitionBy(case)).cast("long")})


def is_last(case: str = "case_id") -> Column:
    return F.col("step_idx") == F.max("step_idx").over(W.partitionBy(case))


def last_n(value: Column, n: int, case: str = "case_id") -> Column:
    """The values of the last n steps up to each step, in order."""
    return F.collect_list(value).over(by_step(case).rowsBetween(-(n - 1), 0))


def prefix(value: Column, case: str = "case_id") -> Column:
    """The values of all steps up to each step."""
    return F.collect_list(value).over(by_step(case).rowsBetween(W.unboundedPreceding, 0))


def latest_before(value: Column, when: Column, case: str = "case_id") -> Column:
    """As-of, backward: the value at the latest earlier step where `when` holds."""
    return F.last(F.when(when, value), ignorenulls=True).over(by_step(case).rowsBetween(W.unboundedPreceding, -1))


def first_after(value: Column, when: Column, case: str = "case_id") -> Column:
    """As-of, forward: the value at the first later step where `when` holds."""
    return F.first(F.when(when, value), ignorenulls=True).over(by_step(case).rowsBetween(1, W.unboundedFollowing))


def last_k(df: DataFrame, when: Column, k: int, case: str = "case_id") -> DataFrame:
    """The last k steps of each case where `when` holds."""
    n = F.row_number().over(W.partitionBy(case).orderBy(F.desc("step_idx")))
    return df.where(when).withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def last_value_per(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Last write wins: of each key, the value at its last step."""
    return df.groupBy(*keys).agg(F.max_by(value, "step_idx").alias(value), F.max("step_idx").cast("long").alias("at_step"))


def transitions(df: DataFrame, value: str, case: str = "case_id") -> DataFrame:
    """How often each value is followed by each."""
    was = F.lag(value).over(by_step(case))
    return df.withColumn("previous", was).where(F.col("previous").isNotNull()).groupBy("previous", value).agg(F.count("*").alias("n"))


def running_share(df: DataFrame, good: Column, order: list[str], every: int) -> DataFrame:
    """After each `every` rows, how many there were and the share of good ones; the first column of the order is a number.

    One global order is asked for, so ranks come from counts by ranges of that column, not from one task: rows
    are numbered within their range. A range is told by the values alone, so both uses of it agree."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = df.agg(F.percentile_approx(order[0], [i / n for i in range(1, n)] or [1.0]).alias("b")).first()["b"] or []
    ranges = F.array(*[F.lit(b) for b in sorted(set(bounds))])
    part = F.size(F.filter(ranges, lambda b: b < F.col(order[0]))) if bounds else F.lit(0)
    spread = df.withColumns({"_good": good.cast("long"), "_part": F.coalesce(part, F.lit(-1))})
    local = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = spread.withColumns({"_n": F.count("*").over(local), "_g": F.sum("_good").over(local)})
    sums = spread.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_good").alias("g"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    base = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("g").over(ahead), F.lit(0)).alias("g0"))
    d = rows.join(base, rows["_part"] == base["_p"])
    n, g = F.col("_n") + F.col("n0"), F.col("_g") + F.col("g0")
    return d.where(n % every == 0).select(n.cast("long").alias("n_rows"), F.round(g / n, 6).alias("accuracy"))
