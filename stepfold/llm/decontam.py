"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

In a text's template, numbers, units (known words after a number) and names (capitalised words that
don't begin a sentence) give way to typed placeholders, and other words are lower-cased. Windows of
WIDTH template tokens are hashed, and documents' windows are joined with the benchmark's by hash.
Documents of whose windows an item's share is large enough are then looked at again with the values of
their placeholders: windows of one item that match at one offset form an alignment, and the values
that its placeholders hold on both sides are its slots. An alignment is consistent if each value of
the item always meets the same value in the document: a question that was given new numbers or names
keeps this law, chance matches of templates don't. A document leaks an item if its consistent
alignments cover at least `coverage` of the item's windows.

Benchmark windows of which over MOST_SLOTS tokens are placeholders say little and aren't used, unless
the item has no others. Texts with fewer tokens than WIDTH are one window; where the benchmark has such
items, documents have windows of their lengths too, so that they are found inside longer texts. Up to BROADCAST_WINDOWS
benchmark windows of BROADCAST_BYTES (both counted first) are broadcast, and documents' windows are never
shuffled; beyond that, both sides are shuffled by hash.

Defined cases: null and empty texts have no window and leak nothing; so do items without a token, even
if a document is empty too; equal rows leak alike; equal ids with different texts are told apart by
text; null ids match only null ids; an item repeated under several ids is reported for each; empty
tables give no rows; other columns pass through `keep_clean` and are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import cut, whole

WIDTH = 5
MOST_SLOTS = 2
COVERAGE = 0.5
BROADCAST_WINDOWS = 1_000_000
BROADCAST_BYTES = 128 << 20
#: Units of measure, currencies and times that may follow a number.
UNITS = (
    "mm cm m km inch inches in ft feet foot yard yards mile miles mi mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees celsius fahrenheit kmh mph km2 m2 hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar psi n kb mb gb tb"
).split()
# Placeholders are private characters: what one stands for follows it, up to END.
NUMBER, NAME, UNIT, END = "", "", "", ""
_NUMBER = r"\d+(?:[.,:/]\d+)*"
_UNIT = rf"({END} ?)((?i:{'|'.join(UNITS)}))(?![\p{{L}}\d])"
_NAME = rf"(?<=[\p{{L}},;{END}] )\p{{Lu}}\p{{L}}*"


def _marked(text: Column, valued: bool) -> Column:
    """The lower-cased text with placeholders, with or without the values they stand for."""
    value = "$0" if valued else ""
    out = F.regexp_replace(text, _NUMBER, NUMBER + value + END)
    out = F.regexp_replace(out, _UNIT, "$1" + UNIT + ("$2" if valued else "") + END)
    return F.lower(F.regexp_replace(out, _NAME, NAME + value + END))


def _starts(n: Column, width: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1)))


def window_hashes(text: Column, widths: list[int]) -> Column:
    """The distinct hashes of a text's windows of some widths; none for a text without tokens."""
    tokens = F.regexp_extract_all(_marked(text, False), F.lit(rf"[{NUMBER}-{UNIT}]|\p{{L}}+"), F.lit(0))
    at_width = lambda t, w: F.transform(_starts(F.size(t), w), lambda i: F.xxhash64(F.slice(t, i, F.lit(w))))
    hashed = lambda t: F.array_distinct(F.concat(*[at_width(t, w) for w in widths]))
    # the tokens are computed once, as the only element of an array
    return F.element_at(F.transform(F.array(tokens), lambda t: F.when(F.size(t) > 0, hashed(t)).otherwise(F.array().cast("array<bigint>"))), 1)


def valued_windows(texts: DataFrame, keys: list[str], widths: list[int]) -> DataFrame:
    """The keys, and for each window of some widths its place, its number of tokens, its hash, and the values of its placeholders, kind first."""
    raw = texts.select(*keys, F.regexp_extract_all(_marked(F.col("text"), True), F.lit(rf"[{NUMBER}-{UNIT}][^{END}]*{END}|\p{{L}}+"), F.lit(0)).alias("raw")).where(F.size("raw") > 0)
    held = lambda x: F.substring(x, 1, 1).between(NUMBER, UNIT)
    t = raw.select(*keys, F.transform("raw", lambda x: F.when(held(x), F.substring(x, 1, 1)).otherwise(x)).alias("t"), F.transform("raw", lambda x: F.when(held(x), x)).alias("slot"))
    cell = lambda i, w: F.struct((i - 1).alias("at"), F.least(F.size("t"), F.lit(w)).alias("n"), F.xxhash64(F.slice("t", i, F.lit(w))).alias("h"), F.array_compact(F.slice("slot", i, F.lit(w))).alias("v"))
    at_width = lambda w: F.transform(_starts(F.size("t"), w), lambda i: cell(i, w))
    cells = F.concat(*[at_width(w) for w in widths])
    return t.select(*keys, F.explode(cells).alias("w")).select(*keys, "w.at", "w.n", "w.h", "w.v")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, i_at, n_tokens, h, i_v of the windows that are used, and their number for the item."""
    w = valued_windows(benchmark, ["item_id"], [WIDTH]).distinct()
    plain = F.size("v") <= MOST_SLOTS
    n = w.groupBy(F.col("item_id").alias("_i")).agg(F.count_if(plain).alias("plain"), F.count("*").alias("all"))
    used = w.join(n, w["item_id"].eqNullSafe(n["_i"])).where((F.col("plain") == 0) | plain)
    return used.select("item_id", F.col("at").alias("i_at"), F.col("n").alias("n_tokens"), "h", F.col("v").alias("i_v"), F.when(F.col("plain") == 0, F.col("all")).otherwise(F.col("plain")).cast("long").alias("n_windows"))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text_hash, item_id, n_windows, n_matched, n_slots, n_changed, kind of each leak."""
    items = cut(item_windows(benchmark), "item-windows")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.array_join("i_v", "")) + 40), F.lit(0)).alias("b")).first()
    small = (lambda d: F.broadcast(d)) if size["n"] <= BROADCAST_WINDOWS and size["b"] <= BROADCAST_BYTES else (lambda d: d)
    widths = sorted({WIDTH} | {r["n_tokens"] for r in items.select("n_tokens").distinct().collect()})
    items = items.drop("n_tokens")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    # first the hashes alone, for the documents that have enough of an item
    by_hash = items.groupBy("item_id", "h").agg(F.count("*").alias("times"), F.first("n_windows").alias("n_windows"))
    hits = keyed.select("doc_id", "text_hash", F.explode(window_hashes(F.col("text"), widths)).alias("h")).join(small(by_hash), "h")
    enough = hits.groupBy("doc_id", "text_hash", "item_id", "n_windows").agg(F.sum("times").alias("n")).where(F.col("n") >= coverage * F.col("n_windows"))
    likely = cut(enough.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "likely")
    # then those with their values; Spark broadcasts `likely` if its files are small
    again = keyed.join(likely, keyed["doc_id"].eqNullSafe(likely["_id"]) & (keyed["text_hash"] == likely["_hash"]), "left_semi")
    hits = valued_windows(again, ["doc_id", "text_hash"], widths).drop("n").join(small(items), "h").where(F.size("v") == F.size("i_v"))
    pairs = F.zip_with("i_v", "v", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    who = ["doc_id", "text_hash", "item_id", "n_windows"]
    lines = hits.groupBy(*who, (F.col("at") - F.col("i_at")).alias("off")).agg(F.collect_set("i_at").alias("found"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    found = lines.where(consistent).groupBy(*who).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).cast("long").alias("n_matched"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("p"),
    )
    changed = F.size(F.filter("p", lambda x: x["i"] != x["d"])).cast("long")
    out = found.where(F.col("n_matched") >= coverage * F.col("n_windows"))
    return out.select(*who, "n_matched", F.size("p").cast("long").alias("n_slots"), changed.alias("n_changed"), F.when(changed > 0, "reparameterised").otherwise("verbatim").alias("kind"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pairs of document and leaked item."""
    return leaks(docs, benchmark).drop("text_hash").distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without those that leak a benchmark item."""
    bad = cut(leaks(docs, benchmark).select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_hash")).distinct(), "leaks")
    rows = docs.select(whole(docs), "doc_id", F.xxhash64("text").alias("text_hash"))
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["_bad"]) & (rows["text_hash"] == bad["_hash"]), "left_anti").select("r.*")
