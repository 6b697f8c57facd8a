"""Tables as CSV and JSON files: headers always present, schemas given, so an empty table keeps its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CENTROIDS = "label_id long, z double, y double, x double, voxel_count long"


def write_csv(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """One file a task, each with a header; lists are joined by ';', as text can't hold them."""
    kinds = dict(df.dtypes)
    flat = df.select(*[F.array_join(c, ";").alias(c) if kinds[c].startswith("array") else F.col(c) for c in df.columns])
    if flat.isEmpty():
        flat = flat.coalesce(1)  # a single file, which still has the header
    flat.write.mode(mode).csv(folder, header=True, nullValue="", emptyValue='""')


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Files of ``write_csv``, or any with a header; columns that a file lacks are null, an empty field is null."""
    return spark.read.schema(schema).csv(folder, header=True, nullValue="", enforceSchema=True)


def write_json(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """One object a line; nulls are left out."""
    df.write.mode(mode).json(folder)


def read_json(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """Objects a line, or with ``whole`` each file as one document (an array of objects gives a row each)."""
    return spark.read.schema(schema).json(path, multiLine=whole)


def centroids(stats: DataFrame) -> DataFrame:
    """The centroid table of object statistics."""
    return stats.select(F.col("label").alias("label_id"), *[F.col(f"c{a}").cast("double").alias(a) for a in "zyx"], F.col("area").alias("voxel_count"))
