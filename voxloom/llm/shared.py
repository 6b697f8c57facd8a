"""Folders that driver and executors share, and tables written there to cut lineage.

A written table is the unit of recovery: a later stage rereads it, so a lost executor costs only the
tasks that ran there.  The folder is the one the session names in ``spark.checkpoint.dir``; only where
that is unset, on one machine, is a temporary folder made and set; on a cluster it must be set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.session import importable

__all__ = ["importable", "shared_dir", "shuffle_partitions", "written"]


def shared_dir(spark: SparkSession) -> str:
    """A new folder of this call under ``spark.checkpoint.dir``, as a URI or path Spark can write to."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = sc._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="voxloom-shared-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/voxloom-{sc.applicationId}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove the tables that this application has written to its shared folder; results that read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: durable, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
