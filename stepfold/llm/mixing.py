"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall, by seeded hashes, into BLOCKS blocks, which a seeded permutation orders
anew for each copy. A source whose target is r times its size gives floor(r) whole copies, and of one
more copy as many permuted blocks as fit; the block at the boundary is cut in the same way by finer
blocks and at last by documents; of some TOP_UP documents beyond the cut, one more is taken whose size
comes nearest to what is left. The exact block quotas of all sources are then split among output shards by a tree: each node gives its
left half of the shards a multivariate-hypergeometric draw of its quotas. A shard's quotas are
consecutive, hence disjoint, pieces of each source's permuted blocks, in a seeded local order; documents
beyond a source's whole blocks are dealt to shards by a hash.

Sizes and thresholds are aggregates; only one row a source comes to the driver. No document is
joined to another: the thresholds of its source decide for each row alone.

Defined cases: a null text has size 0; a null source is a source of its own, the last; a source of
size 0 has target 0, and its documents are taken as if their place in the order decided; rows equal in
id and text are taken alike; an empty table gives no rows; other columns pass through `mix`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from stepfold.llm.common import WORD, cut, whole

BLOCKS = 1024
MOST = 3
TOP_UP = 4096
#: Up to so many sources, their thresholds (some 200 bytes each) are broadcast.
BROADCAST_SOURCES = 10_000


def fill(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of the sum of all sizes by weight, none above `most` sizes, the excess shared anew."""
    left, room = float(sum(sizes)), [float(most * s) for s in sizes]
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if per * weights[i] > room[i]]
        if not over:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = room[i]
            left -= room[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of each shard (rows) and source, which sum to `quotas`; drawn down a binary tree."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    share = int(quotas.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, share, method="marginals") if quotas.sum() else quotas
    return np.vstack([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


def _keys(docs: DataFrame, seed: int) -> DataFrame:
    """`docs` with its size and its places in the three orders."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"_size": size, "_h": h}).withColumns({
        "_block": F.pmod(F.col("_h"), F.lit(BLOCKS)).cast("int"),
        "_fine": F.pmod(F.shiftright("_h", 12), F.lit(BLOCKS)).cast("int"),
        "_order": F.xxhash64(F.lit(seed + 1), F.col("_h")),
    })


def _cut(sums: DataFrame, need: DataFrame, by: list[str]) -> list:
    """For each source, the first place in the order `by` with whose size the need is passed, and what is needed of it."""
    w = W.partitionBy("source").orderBy(*by)
    run = sums.withColumn("upto", F.sum("s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    hit = run.join(need, run["source"].eqNullSafe(need["_src"])).where(F.col("upto") > F.col("need"))
    first = hit.groupBy("_src").agg(F.min_by(F.struct(*by, (F.col("need") - F.col("upto") + F.col("s")).alias("rest")), F.struct(*by)).alias("m"))
    return first.select("_src", "m.*").collect()


def thresholds(docs: DataFrame, shards: int = 32, seed: int = 29) -> tuple[DataFrame, int]:
    """One row a source: size, target, whole copies, where one more copy ends, its shards' cuts; and how many rows."""
    spark = docs.sparkSession
    keyed = cut(_keys(docs.select("doc_id", "source", "text"), seed).select("source", "_size", "_block", "_fine", "_order"), "mix-sizes")
    got = sorted(((r["source"], r["s"], r["n"]) for r in keyed.groupBy("source").agg(F.sum("_size").alias("s"), F.count("*").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    names, sizes, counts = [x for x, _, _ in got], [int(s) for _, s, _ in got], [n for _, _, n in got]
    targets = fill(sizes, [float(1 + i % 3) for i in range(len(got))])
    whole = [min(MOST, math.floor(t / s)) if s else 0 for t, s in zip(targets, sizes)]
    need = {n: t - w * s for n, t, w, s in zip(names, targets, whole, sizes)}
    schema = T.StructType([T.StructField("_src", T.StringType()), T.StructField("need", T.DoubleType())])
    small = lambda rows, kind: F.broadcast(spark.createDataFrame(rows, kind)) if len(rows) <= BROADCAST_SOURCES else spark.createDataFrame(rows, kind)
    cuts = {n: [BLOCKS, 0, 0] for n in names}
    by_block = keyed.groupBy("source", "_block").agg(F.sum("_size").alias("s"))
    for r in _cut(by_block, small(list(need.items()), schema), ["_block"]):
        cuts[r["_src"]][0] = r["_block"]
        need[r["_src"]] = r["rest"]
    at = small([(n, c[0]) for n, c in cuts.items()], T.StructType([T.StructField("_src", T.StringType()), T.StructField("_at", T.IntegerType())]))
    edge = keyed.join(at, keyed["source"].eqNullSafe(at["_src"]) & (keyed["_block"] == at["_at"])).drop("_src", "_at")
    for r in _cut(edge.groupBy("source", "_fine").agg(F.sum("_size").alias("s")), small(list(need.items()), schema), ["_fine"]):
        cuts[r["_src"]][1] = r["_fine"]
        need[r["_src"]] = r["rest"]
    at = small([(n, c[1]) for n, c in cuts.items()], T.StructType([T.StructField("_src", T.StringType()), T.StructField("_at", T.IntegerType())]))
    last = edge.join(at, edge["source"].eqNullSafe(at["_src"]) & (edge["_fine"] == at["_at"])).drop("_src", "_at")
    rest = small(list(need.items()), schema)
    ends = last.groupBy("source", "_order").agg(F.sum("_size").alias("s"))
    w = W.partitionBy("source").orderBy("_order").rowsBetween(W.unboundedPreceding, 0)
    ends = ends.withColumn("upto", F.sum("s").over(w)).join(rest, ends["source"].eqNullSafe(rest["_src"]))
    for r in ends.where(F.col("upto") <= F.col("need")).groupBy("_src").agg(F.max("_order").alias("o"), F.max("upto").alias("u")).collect():
        cuts[r["_src"]][2] = r["o"]
        need[r["_src"]] -= r["u"]
    low = -(1 << 63)
    beyond = small([(n, c[0], c[1], c[2] or low, float(need[n]), k) for (n, c), k in zip(cuts.items(), counts)], "_src string, _c1 int, _c2 int, _c3 long, _need double, _n long")
    past = F.struct("_block", "_fine", "_order") > F.struct(F.col("_c1").alias("_block"), F.col("_c2").alias("_fine"), F.col("_c3").alias("_order"))
    close = (F.col("_block") - F.col("_c1")) * F.col("_n") <= TOP_UP * BLOCKS
    more = keyed.join(beyond, keyed["source"].eqNullSafe(beyond["_src"])).where(past & close).groupBy("_src", "_order").agg(F.sum("_size").alias("s"), F.max("_need").alias("need"))
    off = F.abs(F.col("need") - F.col("s"))
    extra = {r["_src"]: r["o"] for r in more.where(off < F.col("need")).groupBy("_src").agg(F.min_by("_order", F.struct(off.alias("d"), "_order")).alias("o")).collect()}
    quotas = np.array([w * BLOCKS + min(cuts[n][0], BLOCKS) for n, w in zip(names, whole)], dtype=np.int64)
    parts = split_quotas(quotas, shards, np.random.default_rng(seed)) if names else np.zeros((shards, 0), np.int64)
    ends_of = np.cumsum(parts, axis=0)
    rows = [(n, s, t, w, cuts[n][0], cuts[n][1], cuts[n][2] or low, extra.get(n), [int(x) for x in ends_of[:, i]]) for i, (n, s, t, w) in enumerate(zip(names, sizes, targets, whole))]
    kind = "_src string, source_size long, target double, _whole int, _cut1 int, _cut2 int, _cut3 long, _extra long, _ends array<long>"
    return spark.createDataFrame(rows, kind), len(rows)


def allot(docs: DataFrame, shards: int = 32, seed: int = 29) -> DataFrame:
    """`docs` with _size, source_size, target, _copies, and _shards: the output shard of each copy."""
    marks, n = thresholds(docs, shards, seed)
    keyed = _keys(docs, seed)
    joined = keyed.join(F.broadcast(marks) if n <= BROADCAST_SOURCES else marks, keyed["source"].eqNullSafe(marks["_src"]))
    place, end = F.struct("_block", "_fine", "_order"), F.struct(F.col("_cut1").alias("_block"), F.col("_cut2").alias("_fine"), F.col("_cut3").alias("_order"))
    copies = F.col("_whole") + F.when((F.col("_whole") < MOST) & ((place <= end) | F.coalesce(F.col("_order") == F.col("_extra"), F.lit(False))) & (F.col("target") > 0), 1).otherwise(0)
    joined = joined.withColumn("_copies", copies)

    def shard(copy: Column) -> Column:
        odd = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("source"), copy), F.lit(BLOCKS // 2)) * 2 + 1
        rank = F.when(copy < F.col("_whole"), F.pmod(F.col("_block") * odd + copy, F.lit(BLOCKS))).otherwise(F.col("_block"))
        at = F.size(F.filter("_ends", lambda e: e <= copy * BLOCKS + rank))
        # what lies beyond the whole blocks of all quotas is dealt out by a hash
        return F.when(at < shards, at).otherwise(F.pmod(F.xxhash64(F.lit(seed + 5), "_order"), F.lit(shards)).cast("int"))

    shards_of = F.when(F.col("_copies") > 0, F.transform(F.sequence(F.lit(0), F.col("_copies") - 1), shard)).otherwise(F.array().cast("array<int>"))
    return joined.withColumn("_shards", shards_of).drop("_src", "_whole", "_cut1", "_cut2", "_cut3", "_extra", "_ends", "_block", "_fine", "_h")


def mix(docs: DataFrame, shards: int = 32, seed: int = 29, place: str = "mix_place") -> DataFrame:
    """The rows of the mix, each document as often as it is taken, and in `place` the output shard and a local order."""
    rows = allot(docs.select(whole(docs), "doc_id", "source", "text"), shards, seed).select("r", "_order", F.posexplode("_shards").alias("copy", "shard"))
    return rows.select("r.*", F.struct("shard", F.xxhash64(F.lit(seed + 3), "_order", "copy").alias("order")).alias(place))


def in_places(mixed: DataFrame, place: str = "mix_place", slices: int = 1024) -> DataFrame:
    """The rows of `mix` without their place, but dealt out by it and in its local order, as they are then written."""
    spot = F.col(place)
    return mixed.repartition(spot["shard"], F.pmod(spot["order"], F.lit(slices))).sortWithinPartitions(place).drop(place)


def report(docs: DataFrame, shards: int = 32, seed: int = 29) -> DataFrame:
    """What the mix takes of each document."""
    a = allot(docs.select("doc_id", "source", "text"), shards, seed)
    return a.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).cast("long").alias("taken"), F.col("_copies").alias("copies"), F.col("_shards").alias("shards"))
