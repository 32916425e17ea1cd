"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gets a signature of `chunks` x `width` minhash values of 16 bits.
Two signatures at a distance (number of values that differ) of at most 2 * chunks - 1 have, by the
pigeonhole principle, a chunk with at most one wrong value; so each chunk is written under `width` keys,
each leaving out one value, and every pair within that distance shares a key. The number of chunks
is chosen so that a pair at the similarity threshold stays within the distance but for one chance in
a million. Documents with equal sets are one node, its smallest id. Candidates must
also be similar enough by the least hashes of their sets (all hashes, for short texts); links are then
confirmed by the exact Jaccard similarity of the full sets.

Groups that share a key are not expanded into all pairs: at first each node is compared with its group's
centre only, the node that shares most keys with others (of many copies, mostly their original). After
components are known, only nodes of different components that share a key, and whose signatures are
within the distance, remain to be compared; large groups look for these in blocks of BLOCK x BLOCK,
which give out only what is found. So no link between different components is lost, and a group of
many copies costs a few comparisons each.

Defined cases: texts without words, null ones too, have no shingle and are linked with nothing, whatever
else they equal; a text with fewer words than a shingle is one shingle; equal sets are one
component; an id with several texts is one document, linked by its id; rows with a null id get the
component of their equals, or null, and are never kept as the one of a group with ids; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import ascii_lower, cut, lean, mix64, whole, word_hashes
from stepfold.llm.graph import components

WIDTH = 5
_STEP = np.uint64(0x9DDFEA08EB382D69)
#: Up to so many ids (some 40 bytes each) are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
BLOCK = 512
SKETCH = 256
#: Texts are hashed in runs of so many bytes.
RUN_BYTES = 1 << 20


def chunks_for(similarity: float, width: int = WIDTH, miss: float = 1e-6) -> int:
    """The fewest chunks with which a pair at the threshold is missed with at most this chance."""
    p = 1 - similarity
    for m in range(1, 64):
        n = m * width
        if sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(2 * m, n + 1)) <= miss:
            return m
    return 64


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    run: list[bytes] = []
    size = 0

    def flush() -> None:
        if not run:
            return
        words, bounds = word_hashes(run)
        count = len(words) - n + 1
        shingles = np.zeros(max(count, 0), np.uint64)
        for k in range(n if count > 0 else 0):
            shingles = mix64((shingles + words[k : k + count]) * _STEP)
        for i, j in zip(bounds[:-1], bounds[1:]):
            if j - i >= n:
                out.append(np.unique(shingles[i : j - n + 1]))
            else:
                h = np.full(1, j - i, np.uint64)
                for w in words[i:j]:
                    h = mix64((h + w) * _STEP)
                out.append(h if j > i else h[:0])
        run.clear()

    for t in texts:
        b = ascii_lower(t)
        if run and size + len(b) > RUN_BYTES:
            flush()
            size = 0
        run.append(b)
        size += len(b)
    flush()
    return out


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """The k minhash values of 16 bits of each set; sets must not be empty."""
    out = np.empty((len(sets), k), np.uint16)
    rng = np.random.default_rng(11)
    odd, add = rng.integers(1, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 17):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64)]).astype(np.int64)
        for j in range(k):
            out[at:end, j] = mix64(np.minimum.reduceat(flat * odd[j] + add[j], starts)) >> np.uint64(48)
        at = end
    return out


def _summaries(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                sets = shingle_sets(part.column(1).to_pylist(), n)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list[bytes | None] = [None] * len(sets)
                for i, row in zip(full, signatures([sets[i] for i in full], k) if full else []):
                    sig[i] = row.tobytes()
                least = [(s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets]
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(sig, pa.binary()), pa.array(least, pa.binary())], ["doc_id", "n_shingles", "same", "sig", "least"])

    return run


def keys_of(sig: np.ndarray, width: int) -> np.ndarray:
    """For signatures (rows), a key for each left-out value of each chunk; the place of a key is its slot."""
    rows, k = sig.shape
    values = sig.reshape(rows, k // width, width).astype(np.uint64)
    chunk = np.arange(k // width, dtype=np.uint64)[None, :]
    out = []
    for skip in range(width):
        h = np.broadcast_to(chunk * np.uint64(width) + np.uint64(skip), values.shape[:2]).copy()
        for j in range(width):
            if j != skip:
                h = mix64((h + values[:, :, j] + np.uint64(1)) * _STEP)
        out.append(h)
    return np.concatenate(out, axis=1).view(np.int64)


def _keys(width: int):
    def run(sig: pa.Array) -> pa.Array:
        a = np.stack([np.frombuffer(s, np.uint16) for s in sig.to_pylist()]) if len(sig) else np.zeros((0, width), np.uint16)
        keys = keys_of(a, width)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))

    return run


def likely(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, by their SKETCH least hashes, may be as similar as that; exact for sets of at most SKETCH.

    Of the least hashes of the union, the share that both have estimates the similarity; five standard
    errors below the threshold are let through.
    """
    whole = len(a) < SKETCH and len(b) < SKETCH
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    again = np.flatnonzero(both[1:] == both[:-1])
    if whole:
        return len(again) >= similarity * (len(both) - len(again)) - 1e-9
    # the k least distinct values, and how many of them stand twice
    k = min(SKETCH, len(both) - len(again))
    first = np.ones(len(both), bool)
    first[again + 1] = False
    bound = both[first][k - 1]
    hits = int((both[again] <= bound).sum())
    return hits >= k * (similarity - 5 * (similarity * (1 - similarity) / k) ** 0.5)


def _may_link(most: int, similarity: float):
    def run(sig_a: pa.Array, sig_b: pa.Array, least_a: pa.Array, least_b: pa.Array) -> pa.Array:
        rows = zip(sig_a.to_pylist(), sig_b.to_pylist(), least_a.to_pylist(), least_b.to_pylist())
        near = lambda a, b: int((np.frombuffer(a, np.uint16) != np.frombuffer(b, np.uint16)).sum()) <= most
        return pa.array([near(a, b) and likely(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity) for a, b, x, y in rows], pa.bool_())

    return run


def first_slot(differ: np.ndarray, width: int) -> np.ndarray:
    """For pairs of signatures (rows: where they differ), the slot of the first key that they share."""
    wrong = differ.reshape(len(differ), -1, width)
    n = wrong.sum(axis=2)
    chunk = (n <= 1).argmax(axis=1)
    skip = np.where(n[np.arange(len(n)), chunk] == 1, wrong[np.arange(len(n)), chunk].argmax(axis=1), 0)
    return skip * wrong.shape[1] + chunk


def _near_pairs(most: int, similarity: float, width: int):
    """The pairs of each block whose components differ and which may be linked; rows come sorted by block.

    A pair is given out by the group of the first key that it shares, and so once.
    """

    def found(rows: list[tuple]) -> list[tuple[int, int]]:
        _, i, j, slot = rows[0][:4]
        comp = np.array([r[5] for r in rows])
        if (comp == comp[0]).all():
            return []
        sig = np.stack([np.frombuffer(r[6], np.uint16) for r in rows])
        least, block = [np.frombuffer(r[7], np.uint32) for r in rows], np.array([r[8] for r in rows])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = []
        for at in left:
            other = right[right > at] if i == j else right
            other = other[comp[other] != comp[at]]
            if len(other):
                differ = sig[other] != sig[at]
                keep = differ.sum(axis=1) <= most
                other, differ = other[keep], differ[keep]
                if len(other):
                    out += [(rows[at][4], rows[k][4]) for k in other[first_slot(differ, width) == slot] if likely(least[at], least[k], similarity)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        pairs: list[tuple[int, int]] = []

        def batch() -> pa.RecordBatch:
            both = [(min(p), max(p)) for p in pairs]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in both], pa.int64()), pa.array([b for _, b in both], pa.int64())], ["a", "b"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and row[:4] != group[0][:4]:
                    pairs += found(group)
                    group = []
                group.append(row)
            if len(pairs) > 10_000:
                yield batch()
                pairs = []
        if group:
            pairs += found(group)
        yield batch()

    return run


def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    both = lambda x, y: len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
    return pa.array([both(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())


def _sets(n: int):
    def run(text: pa.Array) -> pa.Array:
        return pa.array([s.tobytes() for s in shingle_sets(text.to_pylist(), n)], pa.binary())

    return run


def classes(docs: DataFrame, n: int = 3, num: int = 85, den: int = 100, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`; sets are linked if den * shared >= num * union."""
    lean(docs.sparkSession)
    chunks = chunks_for(num / den, width)
    most = 2 * chunks - 1
    docs = docs.select("doc_id", "text")
    rows = cut(docs.mapInArrow(_summaries(n, chunks * width), "doc_id long, n_shingles long, same binary, sig binary, least binary"), "signatures")
    nodes = cut(rows.where("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("least").alias("least")), "nodes")
    buckets = cut(nodes.select("node", F.posexplode(F.arrow_udf(_keys(width), "array<long>")("sig")).alias("slot", "key")), "buckets")
    sizes = buckets.groupBy("key", "slot").agg(F.count("*").alias("size")).where("size > 1")
    buckets = cut(buckets.join(sizes, ["key", "slot"]), "groups")
    degree = buckets.groupBy("node").agg(F.sum(F.col("size") - 1).alias("degree"))
    centre = buckets.join(degree, "node").groupBy("key", "slot").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("c")).select("key", "slot", (-F.col("c.minus")).alias("centre"))
    star = buckets.join(centre, ["key", "slot"]).where("centre <> node").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs whose signatures are within the distance."""
        sig = nodes.select("node", "sig", "least")
        both = pairs.join(sig.toDF("a", "sig_a", "least_a"), "a").join(sig.toDF("b", "sig_b", "least_b"), "b")
        return both.where(F.arrow_udf(_may_link(most, num / den), "boolean")("sig_a", "sig_b", "least_a", "least_b")).select("a", "b").distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs linked by their full sets."""
        asked = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "asked")
        texts = docs.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        held = cut(texts.select(F.col("doc_id").alias("node"), F.arrow_udf(_sets(n), "binary")("text").alias("set")).where(F.length("set") > 0), "sets")
        size = lambda c: F.length(c) / 8
        both = pairs.join(held.toDF("a", "set_a"), "a").join(held.toDF("b", "set_b"), "b")
        both = both.withColumn("n", F.arrow_udf(_shared, "long")("set_a", "set_b"))
        return both.where(den * F.col("n") >= num * (size("set_a") + size("set_b") - F.col("n"))).select("a", "b")

    tried = cut(near(star), "pairs")
    links = cut(confirmed(tried), "links")
    known = components(links)
    of = nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    placed = buckets.join(of, "node")
    split = placed.groupBy("key", "slot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "slot")
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rest = placed.join(split, ["key", "slot"]).join(nodes.select("node", "sig", "least"), "node")  # the wide columns come last
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    rest = rest.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "slot", "node", "component", "sig", "least", "block")
    rest = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "slot")
    pairs = cut(rest.mapInArrow(_near_pairs(most, num / den, width), "a long, b long"), "pairs")
    pairs = cut(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links = cut(links.union(confirmed(pairs)), "links")
        known = components(links)
    sets = nodes.join(known, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    return rows.join(sets, "same", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` with one document, the smallest id, of each near-duplicate group; five words and 0.8 unless told otherwise.

    Of rows with equal id and text one stays; rows with a null id are no one's near-duplicates.
    """
    found = classes(docs, n, num, den)
    group = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("component_id").alias("_group"))
    gone = group.where("_id <> _group").select("_id")
    rows = docs.select(whole(docs), "doc_id", F.xxhash64("text").alias("text_hash"))
    left = rows.join(gone, rows["doc_id"] == gone["_id"], "left_anti")
    # only rows that stand more than once are dealt out and numbered
    twice = cut(rows.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("k")).where("k > 1").drop("k"), "repeated")
    if twice.isEmpty():
        return left.select("r.*")
    same = left["doc_id"].eqNullSafe(twice["_id"]) & (left["text_hash"].eqNullSafe(twice["_hash"]))
    once = left.join(twice, same, "left_anti").select("r")
    nth = left.join(twice, same, "left_semi").groupBy("doc_id", "text_hash").agg(F.first("r").alias("r"))
    return once.unionByName(nth.select("r")).select("r.*")


CLASSES_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS sh FROM s),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM k JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * k >= 85 * (len(p.sh) + len(q.sh) - k)),
r AS (SELECT doc_id AS node, doc_id AS top FROM s UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.top) AS component_id, s.doc_id = min(r.top) AS kept FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, s.sh
"""
