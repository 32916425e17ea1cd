"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (one to three code points of the lower-cased text), weighted by
TF-IDF: the share of an n-gram among the text's n-grams times its inverse document frequency. One
weight vector a language is trained with follow-the-regularised-leader and elastic-net (L1 and L2)
penalties, whose L1 part leaves most weights at zero. A temperature, fitted on documents that the
weights have not seen, then calibrates the probabilities.

Inverse document frequencies count all texts of the training folds, labelled or not. The classifier is
fitted on a bounded, hash-ordered sample of their labelled texts: `most`, shared out among the languages
by their own counts, but at least `least` of each language (or all that it has). Only their counted n-grams reach the driver. Every whole text is predicted, in Arrow batches.

Defined cases: a null text, or one without a letter, is `und` with score 1; without any labelled text
all are `und` with score 0; null ids belong to the fold of empty text; ties go to the first language by
code point; equal texts get equal results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepfold.llm.common import in_fold, lean, mix64

DIMS = 1 << 16
CHUNK = 1 << 12
#: Shares of n-grams are small; times this, they train at ordinary learning rates.
GAIN = 100.0
_SALT = (np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAEF17502108EF2D9))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngrams(text: str) -> np.ndarray:
    """The hashed places of all n-grams of a text, in order of length, then position."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    pair = (c[:-1] << np.uint64(21)) | c[1:]
    triple = (pair[:-1] << np.uint64(21)) | c[2:]
    return np.concatenate([mix64(x * s) >> np.uint64(48) for x, s in zip((c, pair, triple), _SALT)]).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # DIMS x languages, with idf and GAIN in them
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        g = ngrams(text)
        # a long text counts its n-grams first, a short one sums its rows
        if len(g) > DIMS:
            return np.bincount(g, minlength=DIMS) @ self.weights / len(g) + self.bias
        return self.weights[g].sum(axis=0) / len(g) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return "und", 1.0
        if not self.langs:
            return "und", 0.0
        p = softmax(self.logits(text)[None] / self.temperature)[0]
        i = int(p.argmax())
        return self.langs[i], float(p[i])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_class: int, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIMS x classes) and biases; each row is a pair of feature places and values."""
    z, n = np.zeros((DIMS + 1, n_class)), np.zeros((DIMS + 1, n_class))
    rng = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x = rows[r]
            at, x = np.append(at, DIMS), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax((x @ w)[None])[0]
            p[y[r]] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at], n[at] = zi + g - step * w, ni + g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's n-grams, and the share of each."""
    g = ngrams(text)
    at, n = np.unique(g, return_counts=True)
    return at, n / len(g)


def _counted(texts: pa.Array) -> pa.Array:
    """As bytes, each place with its share; null for texts without a letter."""
    return pa.array([np.stack(counted(t), axis=1).tobytes() if has_letter(t) else None for t in texts.to_pylist()], pa.binary())


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], df: np.ndarray, n_texts: int) -> Model:
    """The model of labelled texts, whose n-grams are counted; df: how many of n_texts texts have an n-gram, by place."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((DIMS, 0), np.float32), np.zeros(0), 1.0)
    y = np.array([names.index(x) for x in langs])
    idf = np.log((1 + n_texts) / (1 + df)) + 1
    rows = [(at, GAIN * tf * idf[at]) for at, tf in rows]
    fitted = len(rows) - len(rows) // 5
    w, b = ftrl(rows[:fitted], y[:fitted], len(names))
    t = 1.0
    if fitted < len(rows):  # the temperature with the least log loss on the rest
        z = np.array([x @ w[at] + b for at, x in rows[fitted:]])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), y[fitted:]] + 1e-12).mean()
        t = min(np.geomspace(0.2, 5, 41), key=loss)
    return Model(names, (w * (GAIN * idf)[:, None]).astype(np.float32), b, float(t))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a task have an n-gram, by place, in chunks; chunk -1 is the number of texts."""
    df, n = np.zeros(DIMS, np.int64), 0
    for b in batches:
        for t in b.column(0).to_pylist():
            if has_letter(t):
                seen = np.zeros(DIMS, bool)
                seen[ngrams(t)] = True
                df += seen
                n += 1
    if n:
        rows = [(-1, np.array([n]).tobytes()), *((at // CHUNK, df[at : at + CHUNK].tobytes()) for at in range(0, DIMS, CHUNK))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["chunk", "counts"])


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
            held[k] = held.get(k, 0) + np.frombuffer(c, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["chunk", "counts"])


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all texts with a letter have an n-gram, by place, and the number of these texts."""
    kind = "chunk int, counts binary"
    df, n = np.zeros(DIMS), 0
    for r in texts.mapInArrow(_frequencies, kind).repartition("chunk").mapInArrow(_sum_chunks, kind).collect():
        got = np.frombuffer(r["counts"], np.int64)
        if r["chunk"] < 0:
            n = int(got[0])
        else:
            df[r["chunk"] * CHUNK :][:CHUNK] = got
    return df, n


def sample(known: DataFrame, most: int, least: int) -> list[Row]:
    """lang and the counted n-grams of `most` rows, shared out by the languages' counts, but `least` of each at least."""
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return []
    every = sum(sizes.values())
    quota = {k: min(n, max(least, -(-most * n // every))) for k, n in sizes.items()}
    # a hashed share of each language, so that only the sample is sorted
    rows = [(k, q, min(1 << 30, int((3 * q + 200) / sizes[k] * (1 << 30)))) for k, q in quota.items()]
    by_lang = F.broadcast(known.sparkSession.createDataFrame(rows, "lang string, _quota long, _below long"))
    near = known.join(by_lang, "lang").where(F.pmod("_o", F.lit(1 << 30)) < F.col("_below"))
    ranked = near.withColumn("_rank", F.row_number().over(W.partitionBy("lang").orderBy("_o")))
    return ranked.where(F.col("_rank") <= F.col("_quota")).select("lang", "_o", F.arrow_udf(_counted, "binary")("text").alias("grams")).orderBy("_o", "lang").collect()


def fit(docs: DataFrame, most: int = 2500, seed: int = 7, least: int = 50) -> Model:
    """The model from text and lang of the rows whose fold is not 1 of 3."""
    lean(docs.sparkSession)
    own = docs.where(~in_fold(F.col("doc_id"), 3, 1) & F.col("text").isNotNull())
    known = own.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("_o"))
    got = [r for r in sample(known, most, least) if r["grams"] is not None]
    if not got:
        return train([], [], np.zeros(DIMS), 0)
    rows = [np.frombuffer(r["grams"], np.float64).reshape(-1, 2) for r in got]
    return train([(x[:, 0].astype(np.int64), x[:, 1]) for x in rows], [r["lang"] for r in got], *frequencies(own.select("text")))


def report(docs: DataFrame) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @F.arrow_udf("lang_pred string, score double")
    def predict(text: pa.Array) -> pa.Array:
        got = [held.value.predict(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["lang_pred", "score"])

    return docs.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), predict(F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
