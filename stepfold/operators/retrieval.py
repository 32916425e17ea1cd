"""Term-containment retrieval: which specification texts hold how many of a query's terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepfold.functions.text import unique

def terms(phrases: Column, least: int = 4) -> Column:
    """The distinct lower-case words of at least `least` characters of an array of phrases; an underscore is a space."""
    words = F.flatten(F.transform(phrases, lambda p: F.split(F.lower(F.replace(p, F.lit("_"), F.lit(" "))), r"\s+")))
    return unique(F.filter(words, lambda w: F.length(w) >= least))


def hits(queries: DataFrame, texts: DataFrame, key: str, name: str, text: str = "text", least: int = 4) -> DataFrame:
    """key, name, score: how many terms of each query each text contains, where any.

    queries: key and terms, of at least `least` characters and without white space, as `terms` gives them. A
    text then contains a term if one of its words does; so the distinct words of all texts meet the distinct
    terms, by an equi-join of the words' grams of `least` characters with the terms' first ones, and only
    what they share goes back to the texts, by an equi-join of words.
    """
    asked = queries.select(key, F.explode("terms").alias("term"))
    first = asked.select("term").distinct().withColumn("gram", F.left("term", F.lit(least)))
    words = texts.select(name, F.explode(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) >= least))).alias("word"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - (least - 1)), lambda i: F.substr(F.col("word"), i, F.lit(least))))
    shared = words.select("word").distinct().select("word", F.explode(grams).alias("gram")).join(first, "gram").where(F.contains("word", "term")).select("word", "term")
    found = words.join(shared, "word").select(name, "term").distinct()
    return asked.join(found, "term").groupBy(key, name).agg(F.count("*").alias("score"))


def top(found: DataFrame, key: str, name: str, k: int) -> DataFrame:
    """The k best texts of each query, ties by name."""
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), F.asc(name)))
    return found.withColumn("rank", n).where(F.col("rank") <= k)
