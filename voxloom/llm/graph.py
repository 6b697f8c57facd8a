"""Connected components of a link table, by rounds of joins; nothing of it comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components, far fewer where many ids have several neighbours in common.

    Each id keeps a link to its smallest smaller neighbour; its other smaller neighbours are linked to that one instead, which is the same link for all ids that share them.
    """
    down = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    low = down.groupBy("b").agg(F.min("a").alias("low"))
    others = down.join(low, "b").where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return low.select(F.col("low").alias("a"), "b").unionByName(others).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in ``links`` (a, b): label is the smallest id reachable.

    Each round takes the least label among neighbours, then follows labels of labels, so the number of
    rounds grows with the logarithm of the longest chain.  Hot ids are pre-aggregated (min) before they are shuffled.
    """
    links = written(contracted(links), "links")
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.select("id", "label").join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        hop = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        labels = written(
            step.join(hop, "next").select("id", F.least("next", "far").alias("to"), "label").select("id", F.col("to").alias("label"), (F.col("to") < F.col("label")).alias("moved")),
            "labels",
        )
    return labels.select("id", "label")
