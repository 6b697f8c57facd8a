"""The labelled rows a classifier may learn from, as a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, characters: int = 200_000_000) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled rows, of at most ``characters`` together, outside the held-out fold.

    The sample is the ``bound`` rows of smallest hashed id: the same rows on every run.  It is broadcast, which
    its bound allows, so texts are not shuffled.  Exact copies of a text count once, through a hash of it.  Texts longer than a hundredth of
    ``characters`` are not learned from.
    """
    y = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    y = y.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").where(F.length("text") <= characters // 100).join(F.broadcast(y), "doc_id")
    key = rows.groupBy(F.xxhash64("text").alias("k")).agg(F.min("doc_id").alias("doc_id"), F.max(F.length("text")).alias("n"))
    # At most ``bound`` rows, so one window may order them.
    key = key.groupBy("doc_id").agg(F.max("n").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")))
    return rows.join(F.broadcast(key.where(F.col("upto") <= characters).select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
