"""Two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly, by seeded hashes, into buckets that fit in memory; pass two
puts each bucket into a random order by Fisher-Yates and lays the buckets of a shard end to end. A shard
has as many buckets as its own rows and bytes need. Copies of a record are scattered one by one, so they
don't stay together.

The law is `key`: doc_id and the number of shards alone decide a record's shard (the shard with the
greatest seeded hash wins it), so that one more shard takes records only into itself.

Defined cases: a null doc_id is a key like any other; a null text has no bytes and the CRC of empty
bytes; equal records (same id, size and CRC) are told apart by a number, whatever their share of all
rows; an empty table gives no rows; other columns are not looked at by `two_pass_shuffle`, and come back
untouched, in `record` or under their names, from the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepfold.llm.common import bucketed, cut, whole

OVERHEAD = 16
#: Up to so many copies of a record are told apart in one go.
PIECE = 4096


def owner(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is greatest."""
    bids = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s")))
    return F.array_max(bids)["s"]


def digest(docs: DataFrame) -> DataFrame:
    """The id, size and CRC of each record; only the id and the text are read."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def fisher_yates(items: Column, *salt: Column) -> Column:
    """The array in a random order: element i changes places with one at a hashed place j <= i, for each i."""

    def swap(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*salt, i), i + 1).cast("int")
        moved = F.concat(F.slice(a, F.lit(1), j), F.slice(a, i + 1, F.lit(1)), F.slice(a, j + 2, i - j - 1), F.slice(a, j + 1, F.lit(1)), F.slice(a, i + 2, F.size(a)))
        return F.when(j == i, a).otherwise(moved)

    return F.when(F.size(items) < 2, items).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(items) - 1), items, swap))


def _need(found: DataFrame, shards: int, seed: int, bucket_rows: int, bucket_bytes: int) -> DataFrame:
    """_s, buckets: how many buckets each shard needs (a row a shard); found: doc_id, size, copies."""
    owned = found.groupBy(owner(F.col("doc_id"), shards, seed).alias("_s")).agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("b"))
    return owned.select("_s", F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows), F.ceil(F.col("b") / bucket_bytes)).cast("long").alias("buckets"))


def _scattered(rows: DataFrame, need: DataFrame, shards: int, seed: int) -> DataFrame:
    """`rows` with shard, grown_shard and, by `salt` also, bucket."""
    owned = rows.withColumns({"shard": owner(F.col("doc_id"), shards, seed), "grown_shard": owner(F.col("doc_id"), shards + 1, seed)})
    owned = owned.join(F.broadcast(need), F.col("shard") == F.col("_s"))  # a row a shard
    return owned.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "text_crc32", "salt"), F.col("buckets")).cast("int")).drop("_s", "buckets")


def _laid(each: DataFrame, seed: int, *more: str) -> DataFrame:
    """Each bucket's records in a random order, and their slots; `more` columns come along."""
    key = ["doc_id", "size", "text_crc32"]
    full = each.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list(F.struct(*key, "salt", "grown_shard", *more))).alias("held"))
    # the counts alone go to a task a shard
    ahead = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = each.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    counts = counts.select(F.col("shard").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    order = fisher_yates(F.col("held"), F.lit(seed + 2), F.col("shard"), F.col("bucket"))
    placed = full.join(counts, (F.col("shard") == F.col("_s")) & (F.col("bucket") == F.col("_b"))).select("shard", "bucket", "ahead", F.posexplode(order).alias("at", "r"))
    slot = (F.col("ahead") + F.col("at")).cast("long").alias("slot")
    return placed.select(*[F.col(f"r.{c}").alias(c) for c in key], F.lit("key").alias("law"), "shard", slot, F.col("r.grown_shard").alias("grown_shard"), "bucket", *[F.col(f"r.{c}").alias(c) for c in more])


def two_pass_shuffle(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_rows: int = 2048, bucket_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, bucket for each record of `docs`."""
    key = ["doc_id", "size", "text_crc32"]
    found = digest(docs).groupBy(*key).agg(F.count("*").alias("copies"))
    piece = F.lit(0).cast("long")
    if (found.agg(F.max("copies")).first()[0] or 0) > PIECE:  # so many copies of one record are dealt out before they are told apart
        parts = found.select("*", F.explode(F.sequence(piece, F.floor((F.col("copies") - 1) / PIECE))).alias("piece"))
        found = parts.withColumn("copies", F.least(F.lit(PIECE), F.col("copies") - F.col("piece") * PIECE)).repartition(*key, "piece")
        piece = F.col("piece")
    each = found.select(*key, piece.alias("piece"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("nth"))
    each = each.select(*key, (F.col("piece") * PIECE + F.col("nth")).alias("salt"))
    return _laid(_scattered(each, _need(found, shards, seed, bucket_rows, bucket_bytes), shards, seed), seed)


def shuffle_records(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_rows: int = 2048, bucket_bytes: int = 64 << 20) -> DataFrame:
    """The columns of `two_pass_shuffle` and `record`, the whole row.

    Pass one writes the records, bucket by bucket, to the shared folder, as a table from which pass two reads whole
    buckets without a further exchange. Equal rows are told apart by where they were read, which that table then holds.
    """
    raw = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.select(whole(docs).alias("record"), "doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("salt"))
    need = cut(_need(digest(docs).withColumn("copies", F.lit(1)), shards, seed, bucket_rows, bucket_bytes), "need")
    total = need.agg(F.sum("buckets")).first()[0] or 1
    return _laid(bucketed(_scattered(rows, need, shards, seed), "shard", "bucket", n=max(1, -(-total // 4))), seed, "record")


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 17) -> tuple[str, str]:
    """Write the whole records of `docs`, a folder a shard; gives the names of the columns of shard and slot, which clash with none."""
    names = []
    for name in ("_shard", "_slot"):
        while name in docs.columns:
            name = f"_{name}"
        names.append(name)
    out = shuffle_records(docs, shards, seed).select("record.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))
    out.sortWithinPartitions(*names).write.partitionBy(names[0]).parquet(path)
    return names[0], names[1]
