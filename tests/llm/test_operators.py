"""Each corpus operator against brute force, and over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log10

import numpy as np
import pytest

from stepfold.llm import bitsliced, ctxmix, decontam, langid, mixing, neardup, pii, sharding, suffixdup, toxicity
from stepfold.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, r string, shard int, target double"


def words(text):
    return WORD.findall((text or "").encode().lower())


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    vocab = {lang: ["".join(rnd.choice(s) for _ in range(rnd.randint(1, 3))) for _ in range(60)] for lang, s in (("en", ["th", "er", "on", "an"]), ("de", ["sch", "ung", "ei", "ver"]))}
    rows = []
    for i in range(120):
        lang = rnd.choice(["en", "de"])
        t = [rnd.choice(vocab[lang]) for _ in range(rnd.randint(5, 120))]
        if i % 6 == 0:
            t.insert(len(t) // 2, "stupid")
        rows.append((i, " ".join(t), lang, f"src{i % 4}", 1, 0.5, "x", 7, 1.0))
    for i in range(120, 150):  # near copies and copies
        t = rows[i - 120][1].split()
        if i % 2:
            t[len(t) // 2] = "other"
        rows.append((i, " ".join(t), rows[i - 120][2], "src0", 1, 0.5, "x", 7, 1.0))
    passage = " ".join(rnd.choice(vocab["en"]) for _ in range(40))
    rows += [(150 + i, f"{rows[i][1]} {passage} {rows[i + 1][1]}", "en", None, 1, None, None, None, None) for i in range(5)]
    rows += [(160, None, None, None, None, None, None, None, None), (161, "", "en", "src1", 0, 0.0, "", 0, 0.0), (162, " \t\n", "de", "src1", 0, 0.0, "", 0, 0.0), (None, "an id less text an id", "en", "src2", 0, 0.0, "", 0, 0.0)]
    rows += [(163, "long " * 30_000, "en", "src3", 0, 0.0, "", 0, 0.0), (164, "Ünïcödé 東京 \U0001f600 a b", "de", "src3", 0, 0.0, "", 0, 0.0)]
    rows += [rows[3], rows[3], (165, "one", "en", "src1", 0, 0.0, "", 0, 0.0), (166, "one", "en", "src1", 0, 0.0, "", 0, 0.0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark, corpus):
    rows = [(i, 1, int("stupid" in (t or ""))) for i, t, *_ in corpus if i is not None and i < 120] + [(None, None, 1), (9999, 1, None), (5, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def of(df):
    return [tuple(r) for r in df.collect()]


# --- 1 ---


def test_decontam(spark, docs, none):
    items = spark.createDataFrame([(1, "Ana sold 48 clips to her friends in April, and then she sold half as many clips in May of 72 km."), (2, ""), (3, None), (4, "hi there"), (None, "one")], "item_id long, text string")
    said = "Intro. Ben sold {} clips to her friends in June, and then she sold half as many clips in July of {} miles. End"
    own = spark.createDataFrame([(1, said.format(55, 91)), (2, "He sold clips. Then her friends left in April, all of them."), (3, None), (4, ""), (5, "Hi there"), (None, said.format(1, 2))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.report(own, items).collect()}
    assert set(got) == {(1, 1), (None, 1), (5, 4)}
    assert got[1, 1]["kind"] == "reparameterised" and got[1, 1]["n_changed"] >= 4 and got[5, 4]["kind"] == "verbatim"
    assert {r["doc_id"] for r in decontam.keep_clean(own, items).collect()} == {2, 3, 4}
    # one value of the item against two of the document, at one offset: no leak
    law = spark.createDataFrame([(1, "take 5 red balls and 5 blue balls and add 5 green balls to it")], "item_id long, text string")
    odd = spark.createDataFrame([(1, "take 5 red balls and 6 blue balls and add 7 green balls to it"), (2, "take 9 red balls and 9 blue balls and add 9 green balls to it")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontam.report(odd, law).collect()] == [2]
    for a, b in ((none, items), (docs, items.limit(0)), (docs, items)):
        kept = decontam.keep_clean(a, b)
        assert kept.columns == docs.columns and kept.count() >= a.count() - 2


def test_decontam_finds_short_items_inside_longer_texts(spark):
    items = spark.createDataFrame([(1, "What is 7*8?"), (2, "hidden word"), (3, "a text of six tokens here")], "item_id long, text string")
    own = spark.createDataFrame([(1, "They ask at school: what is 7*8? Nobody knows."), (2, "Then they ask at school what is 9*4 and go."), (3, "There is a hidden word in this long text."), (4, "There is a word hidden in this long text.")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.report(own, items).collect()}
    assert got == {(1, 1): "verbatim", (2, 1): "reparameterised", (3, 2): "verbatim"}
    assert {r["doc_id"] for r in decontam.keep_clean(own, items).collect()} == {4}


def test_decontam_finds_planted_passages(spark, sf_dir):
    d, b = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = {(x["doc_id"], i["item_id"]) for x in d.collect() for i in b.collect() if i["text"] in x["text"]}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.report(d, b).collect()} == want


# --- 2 ---


def test_toxicity(spark, docs, labels, none, corpus):
    rows = toxicity.report(docs, labels).collect()
    assert len(rows) == len(corpus) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    text = {i: t for i, t, *_ in corpus}
    ok = [r["predicted"] == int("stupid" in (text[r["doc_id"]] or "")) for r in rows]
    assert sum(ok) >= 0.95 * len(ok)
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and clean.count() == sum(r["predicted"] == 0 for r in rows)
    assert toxicity.report(none, labels).count() == 0
    assert {r["score"] for r in toxicity.report(docs, labels.limit(0)).collect()} == {0.0}


def test_risk_never_goes_below_zero_for_long():
    w, b = toxicity.minimise((2, 2), (np.array([0, 1]), np.array([0, 0])), (np.array([0]), np.array([0])), 1, 0.5)
    assert w[0] > 0 > b and np.isfinite([w[0], b]).all()


# --- 3 ---


def test_shuffle(spark, docs, none, corpus):
    rows = sharding.two_pass_shuffle(docs, shards=6, bucket_rows=5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    for s in range(6):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 6) and r["law"] == "key" for r in rows)
    again = sharding.two_pass_shuffle(docs.repartition(7), shards=6, bucket_rows=5).collect()
    assert {(r["doc_id"], r["slot"]) for r in rows} == {(r["doc_id"], r["slot"]) for r in again}
    more = {(r["doc_id"], r["shard"]) for r in sharding.two_pass_shuffle(docs, shards=7).collect()}
    assert more == {(r["doc_id"], r["grown_shard"]) for r in rows}
    assert sharding.two_pass_shuffle(none).count() == 0


def test_fisher_yates_is_a_permutation_that_depends_on_the_seed(spark):
    from pyspark.sql import functions as F

    d = spark.range(200).select(F.sequence(F.lit(0), F.lit(4)).alias("a"), "id")
    got = Counter(tuple(r[0]) for r in d.select(sharding.fisher_yates(F.col("a"), F.col("id"))).collect())
    assert all(sorted(k) == list(range(5)) for k in got) and len(got) > 60


def test_copies_of_a_record_are_spread(spark, monkeypatch):
    """Three copies each of 300 rows, and one row that a third of all rows repeat: neighbours are equal as often as chance has it."""
    from pyspark.sql import functions as F

    d = spark.range(900).select((F.col("id") % 300).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 300).alias("text"))
    d = d.unionByName(spark.range(450).select(F.lit(7000).cast("long").alias("doc_id"), F.lit("hot").alias("text")))
    for piece in (4096, 100):
        monkeypatch.setattr(sharding, "PIECE", piece)
        rows = sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.two_pass_shuffle(d, shards=3, bucket_rows=64).collect())
        assert Counter(x[2] for x in rows) == Counter({**{i: 3 for i in range(300)}, 7000: 450})
        for s in range(3):
            assert [x[1] for x in rows if x[0] == s] == list(range(sum(x[0] == s for x in rows)))
        assert sum(a[2] == b[2] < 7000 for a, b in zip(rows, rows[1:])) < 20
        hot = [x[1] for x in rows if x[2] == 7000]
        n = sum(x[0] == rows[[x[2] for x in rows].index(7000)][0] for x in rows)
        assert len({x * 10 // n for x in hot}) == 10


def test_shards_hold_whole_records_in_the_order_of_their_slots(spark, docs, tmp_path, corpus):
    from pyspark.sql import functions as F

    odd = docs.withColumns({"_n": F.lit(1), "_size": F.lit("x"), "_shard": F.lit(None).cast("int"), "slot": F.lit(2.0), "record": F.lit("r")})
    rows = sharding.shuffle_records(odd, shards=3, bucket_rows=16).collect()
    assert Counter(tuple(r["record"]) for r in rows) == Counter(map(tuple, odd.collect()))
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    owner = {r["doc_id"]: r["shard"] for r in sharding.two_pass_shuffle(docs, shards=3).collect()}
    assert all(r["shard"] == owner[r["doc_id"]] and r["text_crc32"] == zlib.crc32((r["record"]["text"] or "").encode()) for r in rows)
    path = str(tmp_path / "out")
    shard, slot = sharding.write_shards(odd, path, shards=3)
    back = spark.read.parquet(path)
    assert {shard, slot} & set(odd.columns) == set() and Counter(map(tuple, back.select(*odd.columns).collect())) == Counter(map(tuple, odd.collect()))
    assert sharding.shuffle_records(docs.limit(0)).count() == 0


# --- 4 ---


def test_context_mixing(spark, docs, none, corpus):
    rows = ctxmix.score(docs).collect()
    assert len(rows) == len(corpus)
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    toks = [(i, [*words(t), b""]) for i, t, *_ in corpus]
    c = Counter(w for i, t in toks if not fold(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, fold(i), len(t), sum(w in c for w in t), n, round(sum(log10(c[w] + 0.5) - log10(n + 0.5 * (v + 1)) for w in t), 5)) for i, t in toks)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == want
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in rows)
    assert ctxmix.score(none).count() == 0
    assert ctxmix.score(docs.where("doc_id = 160")).count() == 1


def small_model(texts, n_head, seed=1):
    """A model of some texts whose contexts, weights and probability map are arbitrary."""
    h = ctxmix.hashed(texts)[0]
    c = Counter(int(x) for x in h)
    by = sorted(c, key=lambda x: (x != 0, -c[x], x))
    head = sorted(by[:n_head], key=lambda x: (-c[x], x))
    rest = by[n_head:]
    depth = max(0, len(rest) // 4).bit_length()
    buckets = np.zeros(1 << depth)
    for x in rest:
        buckets[x >> (64 - depth) if depth else 0] += c[x] + 0.5
    known = ctxmix.Vocabulary(np.array(head + rest, np.uint64), np.array([*range(len(head)), *(-1 - c[x] for x in rest)]))
    m = ctxmix.start_model([(x, c[x]) for x in head], len(h), len(c), buckets, sum(c[x] == 1 for x in rest), known, True)
    rng = np.random.default_rng(seed)
    m.logit = ctxmix.with_level(rng.normal(size=m.slots), rng.integers(0, 4, m.slots, dtype=np.uint32))
    m.weights, m.refine = rng.normal(0.3, 0.2, m.weights.shape).astype(np.float32), rng.normal(0, 0.2, m.refine.shape).astype(np.float32)
    return m


@pytest.mark.parametrize("n_head", [1, 3, 8, 99])
def test_code_of_all_training_words_is_a_distribution(n_head):
    """Over all next words, the end and one unknown word among them, the probabilities that the model gives sum up to one."""
    texts = ["a b a c a b", "b a a d", "c a b a b e f g h i j k l m n o p q r s t u v w x y z"]
    m = small_model(texts, n_head)
    total = 0.0
    for w in [*"abcdefghijklmnopqrstuvwxyz", "unknown"]:
        total += np.exp(-ctxmix.costs(m, ctxmix.read(m, [f"a e {w}"]))[2])
    total += np.exp(-ctxmix.costs(m, ctxmix.read(m, ["a e"]))[2])
    assert total == pytest.approx(1, abs=1e-3)


def cost_by_hand(m, text):
    """A text's cost, bit after bit, by the definitions alone."""
    tokens = [int(x) for x in ctxmix.hashed([text])[0]]
    mask, sigma = 0xFFFFFFFF, lambda z: 1 / (1 + np.exp(-z))
    paths = ctxmix.huffman([float(c) for c in m.counts] + [max(float(m.n - m.counts.sum()), 0.5)])
    total, mark, w = 0.0, None, None
    for i, h in enumerate(tokens):
        if i % ctxmix.SEGMENT == 0:
            w = m.weights.astype(np.float64).copy()
        k = int(m.words.find(np.array([h], np.uint64))[0])
        said = [(t >> 32) & mask for t in tokens]
        p1, p2 = said[i - 1] if i else 1, said[i - 2] if i > 1 else 1
        k1 = p1 * 0x9E3779B1 & mask
        keys = [((ctxmix.MARKS if mark is None else mark) + 1) * 0x27D4EB2F & mask, k1, ((k1 ^ k1 >> 15) * 0xC2B2AE3D + p2 * 0x27D4EB2F) & mask]
        steps = list(paths[k if k >= 0 else m.escape])
        if k < 0:
            steps.append((m.escape, int(k < -1)))
        if k < -1:
            steps += [(m.escape + (1 << j) + (h >> 64 - j if j else 0), h >> 63 - j & 1) for j in range(m.depth)]
        for node, bit in steps:
            if np.isinf(m.order0[node]):
                continue
            z, seen = [float(m.order0[node])], []
            for c, key in enumerate(keys):
                s = (key + node * 0x85EBCA77) * 0xC2B2AE3D & mask
                s = (s ^ s >> 13) * 0x9E3779B1 & mask
                at = (s >> 32 - m.slot_bits) + (c << m.slot_bits)
                z.append(float(m.logit[at]))
                seen.append(int(m.logit[at : at + 1].view(np.uint32)[0]) & 3)
            x, gate = np.array([*z, 0.3]), seen[1] * 3 + min(seen[2], 2)
            mixed = w[gate] @ x
            w[gate] += ctxmix.RATE * (bit - sigma(mixed)) * x
            p = sigma(mixed + m.refine[gate, int(np.clip(mixed * 2.5 + 32, 0, 63))])
            total -= np.log(p if bit else 1 - p)
        if k < -1:
            total += m.buckets[h >> 64 - m.depth if m.depth else 0] - np.log(-k - 0.5)
        mark = k if 0 <= k < ctxmix.MARKS else mark
    return total


def test_scores_are_those_of_mixing_bit_by_bit(monkeypatch):
    monkeypatch.setattr(ctxmix, "SEGMENT", 40)
    monkeypatch.setattr(ctxmix, "MARKS", 3)
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefgh") + rnd.choice("xyz" * 3 + "uvw") for _ in range(rnd.randint(0, 130))) for _ in range(9)]
    m = small_model(texts[:5], 12)
    run = ctxmix.read(m, texts)
    got = np.add.reduceat(ctxmix.costs(m, run), np.cumsum(run.sizes) - run.sizes)
    assert got == pytest.approx([cost_by_hand(m, t) for t in texts], rel=1e-4)


def test_words_are_the_same_in_runs_of_any_length(monkeypatch):
    texts = [None, "", " \t", "A b\x0bc " * 50, "one-very-long-word" * 9, "é ü\u00a0x y", "end"]
    want = ctxmix.hashed(texts)
    assert want[1].tolist() == [len(words(t)) + 1 for t in texts]
    monkeypatch.setattr(ctxmix, "RUN_BYTES", 16)
    got = ctxmix.hashed(texts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_scores_are_the_same_without_a_broadcast_vocabulary(docs, monkeypatch):
    monkeypatch.setattr(ctxmix, "HEAD", 8)
    order = lambda rows: sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 4), round(r["score"], 2), round(r["bits_per_byte"], 3)) for r in rows)
    want = order(ctxmix.score(docs).collect())
    monkeypatch.setattr(ctxmix, "BROADCAST_WORDS", 10)
    assert order(ctxmix.score(docs).collect()) == want


def test_no_training_rows_leave_all_words_unknown(spark, docs):
    held = docs.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
    rows = ctxmix.score(held).collect()
    assert len(rows) == held.count() and all(r["n_known"] == r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in rows)


def test_words_outside_the_head_are_predicted_from_their_contexts(spark, monkeypatch):
    """Each rare word always follows one other: knowing that, it costs far less than by its count."""
    monkeypatch.setattr(ctxmix, "HEAD", 3)
    rnd = random.Random(8)
    rows = [(i, " ".join(f"{w}x{k} {w}y{k}" for w, k in ((rnd.choice("pq"), rnd.randrange(30)) for _ in range(100)))) for i in range(150)]
    held = ctxmix.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r["n_known"] for r in held) == sum(r["n_tokens"] for r in held) > 0
    assert sum(r["score"] for r in held) > 0.75 * sum(r["base_score"] for r in held)


def test_weights_come_from_every_bit_of_every_training_text(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(6)))) for i in range(4000)]
    seen, begin, learned = {}, ctxmix.begin, ctxmix.learned
    monkeypatch.setattr(ctxmix, "begin", lambda v: seen.setdefault("model", begin(v)))
    monkeypatch.setattr(ctxmix, "learned", lambda cells, middle: learned(seen.setdefault("cells", cells), middle))
    assert ctxmix.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).count() == len(rows)
    run = ctxmix.read(seen["model"], [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1])
    bits = ctxmix.bits_at(seen["model"], run, np.arange(len(run.hashes))).bit
    assert seen["cells"].reshape(-1, 2).sum(axis=0).tolist() == [len(bits) - bits.sum(), bits.sum()]


def test_tally_and_weights_by_hand():
    rnd, rng = random.Random(3), np.random.default_rng(3)
    texts = [" ".join(rnd.choice("abcdefgh") + rnd.choice("xyz" * 3 + "uvw") for _ in range(rnd.randint(0, 130))) for _ in range(9)]
    m = small_model(texts[:5], 12)
    table = rng.integers(1, 9, (m.slots, 2)).astype(np.uint32) ** rng.integers(1, 3, (m.slots, 1)).astype(np.uint32)
    logit, middle = ctxmix.graded(m, table)
    assert (logit[:9] == ctxmix.with_level(*ctxmix.logits(table[:9].astype(np.float32), m.loads[0]))).all()
    cells, sums = np.zeros(np.prod(ctxmix.CELLS), np.int64), np.zeros(ctxmix.BINS + 1)
    run = ctxmix.read(m, texts)
    ctxmix.tally(m, run, cells, sums)
    b = ctxmix.bits_at(m, run, np.arange(len(run.hashes)))
    range_of = lambda z: sum(z > e for e in ctxmix.EDGES)
    want = Counter()
    for j, bit in enumerate(b.bit):
        kinds = []
        for slot, load, levels in zip(b.slots, m.loads, (1, 4, 3)):
            n = table[slot[j]].astype(float)
            n[bit] -= 1
            level = sum(n.sum() >= x for x in (max(1, 0.75 * load), max(4, 2 * load), max(32, 8 * load)))
            kinds.append(range_of(np.log((n[1] + 0.4) / (n[0] + 0.4))) + ctxmix.BINS * min(level, levels - 1))
        own = ctxmix.BINS if np.isinf(m.order0[b.node[j]]) else range_of(b.order0[j])
        want[kinds[1], kinds[2], kinds[0], own, int(bit)] += 1
    shape = cells.reshape(ctxmix.CELLS)
    assert {tuple(map(int, at)): shape[tuple(at)] for at in np.argwhere(shape)} == want
    # of the weights, none is better a little to one side
    middle = [sums / np.maximum(shape.sum(axis=(0, 1, 2, 4)), 1), *middle]
    weights, _ = ctxmix.learned(cells.astype(float), middle)
    for g in range(ctxmix.GATES):
        own = [(k, n) for k, n in want.items() if k[0] // ctxmix.BINS * 3 + k[1] // ctxmix.BINS == g and k[3] < ctxmix.BINS]
        x = np.array([[middle[0][k[3]], middle[1][k[2]], middle[2][k[0]], middle[3][k[1]], 0.3] for k, _ in own]).reshape(-1, 5)
        n, one = np.array([n for _, n in own], float), np.array([k[4] for k, _ in own], float)
        cost = lambda w: (n * (np.logaddexp(0, x @ w) - one * (x @ w))).sum() + (ctxmix.RIDGE * n.sum() + 1) / 2 * ((w - ctxmix.usual()[g]) ** 2).sum()  # noqa: B023, E731
        w = weights[g].astype(float)
        assert all(cost(w + d) > cost(w) < cost(w - d) for d in 0.01 * np.eye(5))


# --- 5 ---


def removed_by_brute_force(rows, span=50):
    least = {}
    for i, t in rows:
        for a in range(len(t) - span + 1):
            least[t[a : a + span]] = min(least.get(t[a : a + span], 1 << 62), 1 << 61 if i is None else i)
    out = Counter()
    for i, t in rows:
        off = bytearray(len(t))
        for a in range(len(t) - span + 1):
            if least[t[a : a + span]] < ((1 << 61) if i is None else i):
                off[a : a + span] = b"\1" * span
        kept = bytes(c for c, f in zip(t, off) if not f)
        out[i, len(t), sum(off), len(bytes(off).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_dedup(docs, none, corpus):
    rows = Counter(of(suffixdup.report(docs)))
    assert rows == removed_by_brute_force([(i, (t or "").encode()) for i, t, *_ in corpus])
    assert sum(r[2] for r in rows) > 0 and suffixdup.report(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_windows_found_elsewhere(seed):
    rnd = random.Random(seed)
    data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(900)), np.uint8)
    start = np.array(sorted(rnd.sample(range(800), 12)))
    size, doc = np.array([rnd.randint(1, 20) for _ in start]), np.array([rnd.randint(0, 4) for _ in start])
    bits = suffixdup.smaller_elsewhere(data, start, size, np.full(12, 30), np.zeros(12, np.uint64), doc, span=8)
    for i in range(12):
        for k in range(size[i]):
            w = data[start[i] + k :][:8].tobytes()
            want = any(doc[j] < doc[i] and k < size[j] and data[start[j] + k :][:8].tobytes() == w for j in range(12))
            assert bool(bits[i] >> np.uint64(k) & np.uint64(1)) == want


# --- 6 ---


def components_by_brute_force(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, set()).update({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    top = {i: i for i in sets}
    linked = lambda a, b: a and b and den * len(a & b) >= num * len(a | b)
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if top[a] < top[b] and linked(sets[a], sets[b]):
                    top[b], changed = top[a], True
    return sets, top


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, none, corpus, n, num):
    rows = [(i, t) for i, t, *_ in corpus if i is not None]
    sets, top = components_by_brute_force(rows, n, num, 100)
    got = of(neardup.classes(docs.where("doc_id is not null"), n, num))
    assert Counter(got) == Counter((i, len(sets[i]), top[i]) for i, _ in rows)
    kept = neardup.keep_one(docs, n, num)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter({None: 1} | {i: 1 for i in top if top[i] == i})
    assert neardup.classes(none).count() == 0 and neardup.report(docs).where("doc_id is null and kept").count() == 0


def test_every_pair_within_the_distance_shares_a_key_and_one_group_gives_it_out():
    rng = np.random.default_rng(3)
    chunks, width = neardup.chunks_for(0.85), 5
    a = rng.integers(0, 1 << 16, (300, chunks * width), dtype=np.uint16)
    b = a.copy()
    for r in b:
        r[rng.choice(chunks * width, 2 * chunks - 1, replace=False)] += 1
    ka, kb = neardup.keys_of(a, width), neardup.keys_of(b, width)
    shared = ka == kb
    assert shared.any(axis=1).all()
    slot = neardup.first_slot(a != b, width)
    assert shared[np.arange(300), slot].all()


def test_sketches_let_no_link_pass():
    rng = np.random.default_rng(5)
    for size in (20, 200, 255, 400, 2000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.93)], rng.integers(0, 1 << 63, int(size * 0.02), dtype=np.uint64)]))
        least = lambda s: (s[: neardup.SKETCH] >> np.uint64(32)).astype(np.uint32)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert j < 0.85 or neardup.likely(least(a), least(b), 0.85)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 50), (50, 70), (7, 7)], "a long, b long")
    assert dict(of(components(links))) == {i: 1 for i in range(1, 31)} | {100: 50, 50: 50, 70: 50}
    assert components(links.limit(0)).count() == 0


# --- 7 ---


def test_mix(docs, none, corpus):
    rows = mixing.report(docs).collect()
    size = Counter()
    for _, t, _, s, *_ in corpus:
        size[s] += len(words(t))
    assert len(rows) == len(corpus) and all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in rows)
    source = {i: s for i, _, _, s, *_ in corpus}
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.fill([size[s] for s in names], [1 + i % 3 for i in range(len(names))])))
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(130, 0.05 * target[s]) for s in names if s != "src3")
    assert Counter(of(mixing.report(docs.repartition(5)).select("doc_id", "taken"))) == Counter((r["doc_id"], r["taken"]) for r in rows)
    out = mixing.mix(docs, place="spot")
    assert out.columns == [*docs.columns, "spot"] and out.count() == sum(r["copies"] for r in rows)
    assert mixing.report(none).count() == 0 and mixing.mix(none).count() == 0


def test_targets():
    assert mixing.fill([100, 100], [1, 3]) == [50, 150]
    assert mixing.fill([10, 1000], [3, 1]) == [30, 980]
    assert mixing.fill([], []) == [] and mixing.fill([0, 5], [1, 2]) == [0, 5]


def test_splitting_tree_is_exact():
    q = np.array([5, 0, 1000, 37])
    parts = mixing.split_quotas(q, 7, np.random.default_rng(1))
    assert (parts.sum(axis=0) == q).all() and (parts >= 0).all() and np.ptp(parts.sum(axis=1)) <= 8


# --- 8 ---


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6).astype(np.float32)], 0) for i in range(230)]
    rows[60] = (60, rows[50][1], 0)  # ties
    rows[61] = (61, rows[50][1], 0)
    rows += [(300, None, 0), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (350, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (400, [0.0] * 6, 0), (450, [1.0, 2.0], 0), (451, [-1.0, 2.0], 0), (304, [], 0), (50, rows[7][1], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, [floor(256 * float(np.float32(x))) for x in e]) for i, e, _ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    want = set()
    for chunk in (40, 10_000):
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in bitsliced.top_k(v.where("not (vec_id = 50 and label = 1)"), chunk_rows=chunk).collect() if r["query_id"] != 50}
        want = set()
        for i, q in good:
            if i % 50 == 0 and i != 50:
                best = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in good if j != i and len(e) == len(q))[:5]
                want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
        assert got == want
    assert bitsliced.top_k(v.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("chunk", [40, 10_000])
def test_top_k_of_large_components(spark, kind, chunk):
    """Every finite vector takes part, as query and as candidate, whatever its size."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4).astype(np.float32)]) for i in range(130)]
    for i, scale in ((0, 1e5), (3, 65536.0), (4, -65535.99), (7, 3e9), (50, 1e13), (51, 1e13), (60, 2e35)):
        rows[i] = (i, [float(np.float32(scale * x)) for x in rows[i][1]])
    v = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    q = {i: [floor(256 * x) if abs(x) < 2**50 else int(x) * 256 for x in e] for i, e in rows}
    want = set()
    for i in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(q[i], e)), j) for j, e in q.items() if j != i)[:5]
        want |= {(i, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(best)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in bitsliced.top_k(v, chunk_rows=chunk).collect()} == want


# --- 9 ---


def test_langid(docs, none, corpus):
    rows = langid.report(docs).collect()
    lang = {i: x for i, _, x, *_ in corpus}
    assert len(rows) == len(corpus) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (160, 161, 162)} == {"und"}
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 150]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held) > 20
    assert langid.report(none).count() == 0


def test_langid_samples_labelled_rows_and_each_language(spark):
    """Few labelled rows among many, and a language that is rare among them; frequencies are of all texts."""
    rows = [(i, "the thin thing" if i % 20 else ("zyx wvu" if i % 400 == 0 else "ein und sein"), None if i % 20 else ("xx" if i % 400 == 0 else "de")) for i in range(9000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    known = d.where("lang is not null").selectExpr("lang", "text", "xxhash64(doc_id) as _o")
    n = Counter(r[2] for r in rows if r[2])
    assert Counter(r["lang"] for r in langid.sample(known, 100, 10)) == {"de": -(-100 * n["de"] // (n["de"] + n["xx"])), "xx": 10}
    df, texts = langid.frequencies(d.select("text"))
    assert texts == 9000 and df[np.unique(langid.ngrams("zyx"))].min() >= n["xx"] and df[langid.ngrams("thin")[1]] >= 8550
    got = {(r["lang_pred"]) for r in langid.report(d).join(d.where("lang = 'xx'"), "doc_id").collect()}
    assert got == {"xx"} and any(fold(r[0]) for r in rows if r[2] == "xx")
    model = langid.fit(d, most=60)
    assert model.langs == ["de", "xx"]


def test_langid_on_the_tables(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.report(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


# --- 10 ---


def base_by_brute_force(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0

    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return out


def test_base_spans():
    rnd = random.Random(6)
    for _ in range(3000):
        t = "".join(rnd.choice("a1.@+- (2_4") for _ in range(rnd.randint(0, 40)))
        assert pii.find(t)[0] == base_by_brute_force(t)


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("write to john dot doe at example dot com now", "email", "john dot doe at example dot com"), ("mail joe [at] example [dot] org!", "email", "joe [at] example [dot] org"),
    ("јоhn@ехаmple.com here", "email", "јоhn@ехаmple.com"), ("plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
    ("ip one nine two dot one six eight dot one dot one x", "ip", "one nine two dot one six eight dot one dot one"), ("on １９２.168.1.1 up", "ip", "１９２.168.1.1"), ("a​bc@exam​ple.com", "email", "a​bc@exam​ple.com"),
])
def test_disguises(text, kind, span):
    base, more = pii.find(text)
    assert [text[i:j] for i, j in more[kind]] == [span] and not base[kind]
    assert pii.mask(text).count(f"<{kind}>") == 1


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("call plus 44 20 7946 0958 now", "phone", "plus 44 20 7946 0958"), ("plus four, four, two, zero, seven, nine, four, six, zero, nine", "phone", "plus four, four, two, zero, seven, nine, four, six, zero, nine"),
    ("ruf plus vier neun drei null eins zwei drei vier fünf sechs an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs"), ("le plus trois trois un deux zéro sept huit neuf six cinq.", "phone", "plus trois trois un deux zéro sept huit neuf six cinq"),
    ("llama más tres cuatro nueve uno cinco dos siete ocho cero seis ya", "phone", "más tres cuatro nueve uno cinco dos siete ocho cero seis"), ("write john dot doe\nat example\ndot com now", "email", "john dot doe\nat example\ndot com"),
    ("nom arobase exemple point fr ici", "email", "nom arobase exemple point fr"), ("juan (arroba) correo (punto) es", "email", "juan (arroba) correo (punto) es"), ("x" * 90 + " at " + "h" * 80 + " dot org", "email", "x" * 90 + " at " + "h" * 80 + " dot org"),
    ("ring +44 20 seven 946 0958.", "phone", "+44 20 seven 946 0958"), ("at 192 point 168 point 0 point 17", "ip", "192 point 168 point 0 point 17"), ("on 10 . 0 . 0 . 12 up", "ip", "10 . 0 . 0 . 12"),
])
def test_slight_disguises(text, kind, span):
    assert any(i <= text.index(span) and j >= text.index(span) + len(span) for i, j in pii.find(text)[1][kind])


SPOKEN = [dict(zip("0123456789", w.split())) for w in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")]


@pytest.mark.parametrize("seed", range(40))
def test_disguised_identifiers_are_found_where_they_stand(seed):
    """Random identifiers, disguised in random ways in random prose: what is added is just them, with their source characters."""
    rnd = random.Random(seed)
    spoken, lines = rnd.choice(SPOKEN), rnd.random() < 0.3
    gap = lambda: rnd.choice(["\n", " \n "]) if lines and rnd.random() < 0.2 else " "
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    say = lambda x: "".join((gap() if i else "") + spoken[c] for i, c in enumerate(x))
    user, host, top = (rnd.choice(["ann", "j.doe", "x_1"]), rnd.choice(["mail", "my-site"]), rnd.choice(["org", "example"]))
    made = {
        "phone": rnd.choice([f"plus{gap()}{say(digits(9))}", f"+{digits(3)} {say(digits(2))} {digits(4)}"]),
        "email": rnd.choice([f"{user}{gap()}at{gap()}{host}{gap()}dot{gap()}{top}", f"{user} [at] {host} (dot) {top}", f"{user} (arroba) {host} [punto] {top}", f"{user}@{host.replace('a', 'а').replace('e', 'е')}.{top}".replace("o", "о")]),
        "ip": rnd.choice(["10 dot 20 dot 30 dot 40", "１０.20.30.4", f"{say('12')} dot {say('7')} dot {say('0')} dot {say('1')}"]),
    }
    kind = rnd.choice(sorted(made))
    text = f"Ask them: {made[kind]} -- or the other, who was there with us."
    base, more = pii.find(text)
    assert not any(base.values()) and {k: [text[i:j] for i, j in v] for k, v in more.items() if v} == {kind: [made[kind]]}


def test_pii(docs, none, corpus, spark):
    rows = pii.report(docs).collect()
    assert len(rows) == len(corpus) and all(r["n_email"] == 0 and r["spans"] == "" for r in rows)
    one = pii.report(spark.createDataFrame([(1, "é a@b.c, 1.2.3.4 and x at y dot com")], "doc_id long, text string")).first()
    assert one["spans"] == "email:2:7,email:21:35,ip:9:16" and (one["n_email"], one["n_ip"], one["n_hidden"]) == (1, 1, 1)
    assert one["base_sha256"] == hashlib.sha256(b"email:2:7,ip:9:16").hexdigest()
    assert pii.report(none).count() == 0
