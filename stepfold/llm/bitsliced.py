"""Exact top-k inner products over a bit-sliced index.

Each component becomes floor(256 x). Vectors are dealt into chunks; a chunk holds, for each component
and binary digit, a bitmap over its rows (a slice). For a query, the slices that its own digits select
are added with bitmap arithmetic (carry-save adders, a whole level of bitmaps at once) into the
slices of the score. The greatest scores are then selected from the most significant slice downward;
rows that tie at the boundary are resolved by their ids. Chunks' winners meet per query.

A negative query component adds the complements of the slices: that changes all scores of the query by
one constant, which is taken off again.

Vectors with a component of 2**24 or more after scaling (wide ones) are not sliced: their products, as
query or as candidate, are summed in integers of any length.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, and empty
vectors and null ids none either; a score beyond 64 bits ranks by its exact value and is given as the
nearest 64-bit integer; vectors meet only those
of the same length; rows with the query's own id are not its candidates; ties go to the smaller id;
fewer than k candidates give fewer rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 24
WHOLE = 2.0**53  # from here on, a double is an integer


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, q (the quantised components) or, for wide vectors, wide (these / scale), dim, of the vectors that take part."""
    by = lambda f: F.transform("embedding", lambda x: f(x.cast("double")))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    narrow = F.forall("embedding", lambda x: F.abs(x.cast("double")) < LIMIT / scale)
    floor = lambda x: F.floor(F.lit(float(scale)) * x)
    whole = lambda x: F.when(F.abs(x) < WHOLE, floor(x).cast("double") / scale).otherwise(x)
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fine))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(narrow, by(floor)).cast("array<int>").alias("q"), F.when(~narrow, by(whole)).alias("wide"), F.size("embedding").alias("dim"))


def integers(q: list, wide: list | None, scale: int = 256) -> np.ndarray:
    """The quantised components as integers of any length."""
    if wide is None:
        return np.array([int(x) for x in q], object)
    return np.array([int(x) * scale if abs(x) >= WHOLE else int(x * scale) for x in wide], object)


class Slices:
    """The slices of one chunk; rows stand in the order of their ids."""

    def __init__(self, ids: np.ndarray, q: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.q = ids[order], q[order]
        self.low = self.q.min(axis=0)
        up = (self.q - self.low).astype(np.int64)  # from 0, so that no slice is for a sign
        self.bits = max(1, int(up.max()).bit_length())
        n = len(ids)
        self.words = -(-n // 64)
        planes = ((up.T[:, None, :] >> np.arange(self.bits)[None, :, None]) & 1).astype(bool)
        padded = np.zeros((up.shape[1], self.bits, self.words * 64), bool)
        padded[:, :, :n] = planes
        self.slices = np.packbits(padded, axis=2, bitorder="little").view(np.uint64)
        live = np.zeros(self.words * 64, bool)
        live[:n] = True
        self.live = np.packbits(live, bitorder="little").view(np.uint64)

    def sum_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of score + a constant of the query."""
        size, minus = np.abs(query), query < 0
        digits = int(size.max()).bit_length()
        levels: list[list[np.ndarray]] = [[] for _ in range(self.bits + digits + 1)]
        for j in range(digits):
            on = (size >> j) & 1 == 1
            for neg in (False, True):
                take = np.flatnonzero(on & (minus == neg))
                if len(take):
                    for i in range(self.bits):
                        got = self.slices[take, i]
                        levels[i + j].append(~got if neg else got)
        out: list[np.ndarray] = []
        k = 0
        while k < len(levels):
            x = np.concatenate(levels[k]) if levels[k] else np.zeros((0, self.words), np.uint64)
            while len(x) > 1:
                third = len(x) // 3
                if third:
                    a, b, c, rest = x[:third], x[third : 2 * third], x[2 * third : 3 * third], x[3 * third :]
                    ab = a ^ b
                    carry, total = (a & b) | (ab & c), ab ^ c
                    x = np.concatenate([total, rest]) if len(rest) else total
                else:
                    carry, x = x[:1] & x[1:], x[:1] ^ x[1:]
                if k + 1 == len(levels):
                    levels.append([])
                levels[k + 1].append(carry)
            out.append(x[0] if len(x) else np.zeros(self.words, np.uint64))
            k += 1
        return out

    def rows_of(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows (all, if fewer) other than the query's own."""
        sure, maybe = np.zeros(self.words, np.uint64), self.live.copy()
        for r in range(np.searchsorted(self.ids, query_id, "left"), np.searchsorted(self.ids, query_id, "right")):
            maybe[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        have = 0
        if np.bitwise_count(maybe).sum() > k:
            for s in reversed(self.sum_slices(query) if query.any() else []):
                ones = maybe & s
                n = have + int(np.bitwise_count(ones).sum())
                if n > k:
                    maybe = ones
                    continue
                sure, have, maybe = sure | ones, n, maybe & ~s
                if n == k:
                    break
        rows = self.rows_of(sure)
        if have < k:  # the boundary rows have equal scores (or all take part): the smaller ids first
            rows = np.concatenate([rows, self.rows_of(maybe)[: k - have]])
        return self.ids[rows], self.q[rows].astype(np.int64) @ query


def _meet(k: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not (len(left) and len(right)):
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
        sliced, others = right[right["r_q"].notna()], right[right["r_q"].isna()]
        held = Slices(sliced["r_vec_id"].to_numpy(np.int64), np.stack(sliced["r_q"].to_numpy()).astype(np.int64)) if len(sliced) else None
        large = [(int(i), integers(None, w)) for i, w in zip(others["r_vec_id"], others["r_wide"])]
        for qid, q, wide in zip(left["vec_id"], left["q"], left["wide"]):
            best: list[tuple[int, int]] = []
            exact = integers(q, wide) if large or q is None else None
            if held and q is not None:
                best += [(int(s), int(i)) for i, s in zip(*held.top(int(qid), np.asarray(q, np.int64), k))]
            elif held:
                best += [(int(s), int(i)) for i, s in zip(held.ids, held.q.astype(object) @ exact) if i != qid]
            best += [(int(v @ exact), i) for i, v in large if i != qid]
            out += [(int(qid), i, str(s)) for s, i in sorted(best, key=lambda x: (-x[0], x[1]))[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def _ranked(k: int):
    """The k best of a query's winners in all chunks; scores come as decimal text."""

    def run(found: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(((-int(s), int(i)) for s, i in zip(found["score"], found["vec_id"])))[:k]
        qid = int(found["query_id"].iloc[0])
        return pd.DataFrame([(qid, n + 1, i, max(-1 << 63, min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(rows)], columns=["query_id", "rank", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, chunk_rows: int = 16384, query_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best among all other rows."""
    q = quantised(vectors)
    n = q.count()
    chunks, groups = max(1, -(-n // chunk_rows)), max(1, -(-n // (every * query_rows)))
    data = q.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "q", "wide"), F.lit(chunks)).cast("int"))
    asked = q.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "q", "wide"]).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(groups)).cast("int"))
    left = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # under names of their own: of columns that both sides share, Spark would prune the right side's
    own = data.select(*[F.col(c).alias(f"r_{c}") for c in ("vec_id", "q", "wide")], "dim", "chunk")
    right = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    by = ["dim", "chunk", "part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_meet(k), "query_id long, vec_id long, score string")
    return found.groupBy("query_id").applyInPandas(_ranked(k), "query_id long, rank int, vec_id long, score long")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
