"""Incremental tiles: a file stream of measurement rows, each tile handled once, resumed from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def tile_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Apply ``work`` to the tiles of each batch whose chunk came in no earlier one, and stop when the input is used up.

    Which chunks came is keyed state of the query, so the output is never read again.  A batch writes its own folder, and writes it anew when it runs again after a failure, so each tile is there once.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.dropDuplicates(["chunk"]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
