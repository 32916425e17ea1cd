"""Non-negative positive-unlabelled learning of toxicity.

Confirmed toxic documents are the positives; all other text is unlabelled. A linear model over
word and word-stem features is trained in numpy with the class-prior-corrected risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),
where a step whose bracket is below zero goes up its gradient instead. Features count as present or
absent, so that the length of a text does not dilute them, and only those that several positives
share, and by more than `telling` standard errors oftener than all text, are kept.

The positives are a bounded, hash-ordered sample: at most `most_positive` labelled toxic documents, whose
shared features, and nothing larger, are looked for elsewhere. The unlabelled text is all text of the training
folds: it is counted whole, and dealt into parts of some `part_rows` documents, each of which a task fits with all
positives; the model is the mean over the parts. Every whole text is scored, in Arrow batches.

Defined cases: an empty or null text has no features and gets the score of the bias alone; null labels
are no labels, null ids are training rows of the fold of empty text; labels of ids without a document
are unused, and an id with several labels is toxic if one is; without any positive all scores are 0;
equal texts get equal scores; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import ascii_lower, cut, in_fold, lean, whole

_STRIP = b".,;:!?\"'()[]{}<>*_-"


def features(text: str | None) -> set[bytes]:
    """The words of a text without outer punctuation, and the stems (first five and six bytes) of longer ones."""
    out = set()
    for w in set(ascii_lower(text).split()):
        w = w.strip(_STRIP)
        if w:
            out.add(w)
            if len(w) > 5:
                out.add(b"^" + w[:5])
                if len(w) > 6:
                    out.add(b"^" + w[:6])
    return out


def minimise(rows: tuple[int, int], at_p: tuple[np.ndarray, np.ndarray], at_u: tuple[np.ndarray, np.ndarray], dims: int, prior: float, steps: int = 400, rate: float = 0.1, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias with the least non-negative risk, by Adam over the whole samples.

    rows: how many positives and unlabelled there are; at_p, at_u: the rows and the features of their marks.
    """
    (n_p, n_u), (ip, fp), (iu, fu) = rows, at_p, at_u
    w, b = np.zeros(dims), 0.0
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for t in range(1, steps + 1):
        zp = np.bincount(ip, w[fp], n_p) + b
        zu = np.bincount(iu, w[fu], n_u) + b
        sp, su = sig(zp), sig(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gp, gu = (sp - 1 - sp) * prior / n_p, su / n_u
        else:  # the estimated risk of negatives cannot be below zero: go back up
            gp, gu = prior * sp / n_p, -su / n_u
        g = np.concatenate([np.bincount(fp, gp[ip], dims) + np.bincount(fu, gu[iu], dims) + ridge * w, [gp.sum() + gu.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score_text(text: str | None, weights: dict[bytes, float], bias: float) -> float:
    if bias == -np.inf:
        return 0.0
    z = bias + sum(weights[f] for f in sorted(features(text) & weights.keys()))
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("_o"), pa.array([sorted(features(t)) for t in b.column("text").to_pylist()], pa.list_(pa.binary()))], ["_o", "found"])


def _places(held):
    """Which of the known features each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.value
        for b in batches:
            found = [sorted(at[f] for f in features(t) if f in at) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_o"), pa.array(found, pa.list_(pa.int32()))], ["_o", "at"])

    return run


def _own_places(held):
    """The places, as bytes, of the known features among those that were found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.value
        for b in batches:
            rows = [np.array([at[f] for f in row if f in at], np.int32).tobytes() for row in b.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_o"), pa.array(rows, pa.binary())], ["_o", "at"])

    return run


def _packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(a) for a in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)


def _fit_part(held):
    """The weights (by feature), the bias (-1) and a one (-2) that a task finds for its part of the unlabelled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, positive, prior = held.value
        own = [kept[a][kept[a] >= 0] for b in batches for a in (np.array(x, np.int64) for x in b.column(0).to_pylist())]
        if own:
            dims = int(kept.max(initial=-1)) + 1
            w, bias = minimise((len(positive), len(own)), _packed(positive), _packed(own), dims, prior)
            on = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([on, [-1, -2]]), pa.int64()), pa.array(np.concatenate([w[on], [bias, 1.0]]))], ["i", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, part_rows: int = 12_000, least: int = 4, telling: float = 4.0, seed: int = 5) -> tuple[dict[bytes, float], float]:
    """The model from labels and text of the rows whose fold is not 0 of 5."""
    spark = docs.sparkSession
    lean(spark)
    taught = lambda d: d.where(~in_fold(F.col("doc_id"), 5, 0))
    known = taught(labels).where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    total = known.agg(F.count("*").alias("n"), F.sum((F.col("_toxic") == 1).cast("int")).alias("p")).first()
    if not total["p"]:
        return {}, -np.inf
    prior = total["p"] / total["n"]
    text = taught(docs).select("doc_id", "text").where("text is not null").withColumn("_o", F.xxhash64(F.lit(seed), "doc_id", "text"))
    # a hashed share of the toxic ids, of which some may have no document: their number is bounded too
    share = min(1.0, (4 * most_positive + 200) / total["p"])
    ids = known.where("_toxic = 1").where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("doc_id")
    ids = F.broadcast(ids) if total["p"] * share <= 100_000 else ids
    sample = text.join(ids, "doc_id", "left_semi").orderBy("_o").limit(most_positive)
    own = cut(sample.select("_o", "text").mapInArrow(_own, "_o long, found array<binary>"), "toxic-sample")
    n_p = own.count()
    if not n_p:
        return {}, -np.inf
    shared = own.select(F.explode("found").alias("f")).groupBy("f").agg(F.count("*").alias("k")).where(F.col("k") >= least).orderBy("f").toArrow()
    names, k_p = shared["f"].to_pylist(), shared["k"].to_numpy().astype(np.float64)
    at = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    marked = cut(text.select("_o", "text").mapInArrow(_places(at), "_o long, at array<int>"), "toxic-marks")
    n_u = marked.count()
    k_u = np.zeros(len(names))
    seen = marked.select(F.explode("at").alias("i")).groupBy("i").agg(F.count("*").alias("k")).toArrow()
    k_u[seen["i"].to_numpy()] = seen["k"].to_numpy()
    # by how many standard errors the positives' share with a feature differs from that of all text
    q = (k_p + k_u + 1) / (n_p + n_u + 2)
    off = np.abs(k_p / n_p - k_u / n_u) / np.sqrt(q * (1 - q) * (1 / n_p + 1 / n_u))
    kept = np.full(len(names) + 1, -1)
    on = np.flatnonzero(off >= telling)
    kept[on] = np.arange(len(on))
    positive = [kept[np.frombuffer(r["at"], np.int32)] for r in own.mapInArrow(_own_places(at), "_o long, at binary").orderBy("_o").collect()]
    held = spark.sparkContext.broadcast((kept, [p[p >= 0] for p in positive], prior))
    parts = max(1, n_u // part_rows)
    dealt = marked.repartitionById(parts, F.pmod(F.xxhash64(F.lit(seed + 1), "_o"), F.lit(parts)).cast("int")).sortWithinPartitions("_o")
    found = {r["i"]: r["x"] for r in dealt.select("at").mapInArrow(_fit_part(held), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    done = found.pop(-2)
    bias = found.pop(-1) / done
    return {names[on[i]]: x / done for i, x in sorted(found.items())}, bias


def scorer(docs: DataFrame, model: tuple[dict[bytes, float], float]):
    """The scores, from 0 to 1, of a text column."""
    lean(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(text: pa.Array) -> pa.Array:
        weights, bias = held.value
        return pa.array([score_text(t, weights, bias) for t in text.to_pylist()], pa.float64())

    return F.arrow_udf(score, "double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    score = scorer(docs, fit(docs, labels))
    s = docs.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), score(F.col("text")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those that the model predicts to be toxic."""
    score = scorer(docs, fit(docs, labels))
    return docs.select(whole(docs), score(docs["text"]).alias("score")).where(F.col("score") < 0.5).select("r.*")
