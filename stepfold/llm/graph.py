"""Connected components of a link table, by distributed minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of `links` (a, b long).

    Each round gives a node the least label among its own, its neighbours' and its label's label; a
    round's labels are written to the shared folder, so that lineage stays short. A repeated or
    self-directed link changes nothing; without links there are no rows.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), "component")
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = step.join(up, "component", "left").select("node", F.least(F.col("component"), F.coalesce("top", "component")).alias("component"), "was")
        new = cut(new, "labels")
        if new.where("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
