"""The pipeline against its stages by brute force, and where tables are empty."""

from collections import Counter

import corpus_pipeline
from stepfold.llm import toxicity
from stepfold.llm.common import table
from test_operators import components_by_brute_force, words


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, docs
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir).cache()
        held[name] = kept
        assert kept.columns == columns or name == "sharding"
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in toxicity.report(docs, table(spark, sf_dir, "labels")).collect() if r["predicted"]}
    first = {r["doc_id"] for r in held["toxicity"].collect()}
    assert first == set(text) - toxic
    _, top = components_by_brute_force([(i, text[i]) for i in sorted(first)], 5, 80, 100)
    second = {r["doc_id"] for r in held["near_duplicates"].collect()}
    assert second == {i for i in first if top[i] == i}
    items = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    third = {r["doc_id"] for r in held["decontamination"].collect()}
    assert third == {i for i in second if not any(t in text[i] for t in items)}
    mixed = Counter(r["doc_id"] for r in held["mixing"].collect())
    assert set(mixed) <= third and max(mixed.values()) <= 3
    assert abs(sum(n * len(words(text[i])) for i, n in mixed.items()) / sum(len(words(text[i])) for i in third) - 1) < 0.05
    shards = held["sharding"].collect()
    assert Counter(tuple(r["record"]) for r in shards) == Counter(map(tuple, held["mixing"].collect()))  # texts in, texts out
    near = sorted((r["shard"], r["slot"], r["doc_id"]) for r in shards)
    assert sum(a[2] == b[2] for a, b in zip(near, near[1:])) < len(near) / 4  # copies don't stand together


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"shard", "slot", "doc_id"} <= set(out.columns)


def test_odd_documents(spark, sf_dir):
    """Nulls in any column, empty texts, repeated rows and columns whose names operators use pass through all stages."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").limit(60)
    blank = docs.limit(1)
    for text in (None, "", "same words here and there"):
        blank = blank.unionByName(spark.createDataFrame([(None, text, None, None, None)] * 2 + [(9_000_000, text, None, "src1", 0)], docs.schema))
    odd = docs.unionByName(blank).unionByName(docs.limit(3)).withColumns({c: F.lit(i) for i, c in enumerate(("r", "_id", "shard", "slot", "score", "_mix_place", "record", "text_hash"))})
    kept = odd
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == odd.columns or name == "sharding"
    rows = kept.select("record.*").collect()
    assert len(rows) > 20 and {tuple(r) for r in rows} <= {tuple(r) for r in odd.collect()}


def test_empty_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
