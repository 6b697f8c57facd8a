"""A training corpus from documents: toxicity, line dedup, near-dedup, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` applies
them to documents, each written to the shared folder and reread as the next one's docs, so a lost
executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import decontaminate, lines, minhash, packing, shared, toxicity

ADDED = ("__added_1", "__added_2")  # for what a stage adds and drops again, so a caller's columns keep their values

def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the score is learned from the labelled rows of the documents table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, names=ADDED).where(F.col(ADDED[1]) == 0).select(*docs.columns)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three-line windows are cut out of the texts; every document stays."""
    return lines.remove_repeated_lines(docs, ADDED).select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the smallest id; copies have a similarity of 0.8 at least.

    Rows without an id and rows that share one are judged by their texts like all others.
    """
    return minhash.representatives(docs, least=80)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go, with or without an id."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts that are left, in length buckets and token-budget batches."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_once), ("near_dedup", near_copies_out), ("decontamination", benchmark_out), ("packing", packed)]

#: SQL can't express the learned toxicity stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
