"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract: space and the bytes 0x09 to 0x0D, which is Java's \s.
WORD = r"\S+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Hand whole texts to Python in small batches, of so many rows and bytes at most: with long ones among them, the
    defaults are too many. Plans run later than they are made, so the settings stay with the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def whole(docs: DataFrame) -> Column:
    """All columns as one, `r`, so that no column an operator adds can clash with them."""
    return F.struct(*[docs[c] for c in docs.columns]).alias("r")


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, written as text, leaves the remainder `fold`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only where none is set and all runs on this machine (tests), a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="stepfold-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends, and lost executors can't lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """Like `cut`, in n buckets by `keys` (as many as shuffles have partitions), so that joins and groups by them don't shuffle it again.

    With n, rows are dealt to the buckets first, so that each is one file; without, every task writes what it has of each.
    """
    spark = df.sparkSession
    name = f"stepfold_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    dealt = df.repartition(n, *keys) if n else df
    dealt.write.bucketBy(n or max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and what was read of the catalog with them
    return out


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; null is empty."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


# --- vectorised word hashing -------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POW: dict[str, np.ndarray] = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_POW["pow"]) < n:
        m = 1 << int(n).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, b in (("pow", _BASE), ("inv", inverse)):
            out = np.full(m, b, np.uint64)
            out[0] = 1
            _POW[key] = np.multiply.accumulate(out)
    return _POW["pow"], _POW["inv"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads polynomial hashes over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (data[t]+1) * base**t over i <= t < j, modulo 2**64."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the bytes stand."""
    _, inv = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inv[start])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[data]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of several texts, in order, and the bounds of each text's words."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, end = word_spans(data)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    bounds = np.concatenate([[0], np.searchsorted(start, ends)])
    return span_hash(prefix_hash(data), start, end), bounds
