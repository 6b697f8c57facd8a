"""Exact dedup by content sort.

1. Texts are counted by a 64-bit hash, combined map-side, only to find hot ones: those with more than a hundred-thousandth of all rows
   or bytes.  So at most 200,000 hashes are hot, whatever the input, and their table is broadcast.
2. Rows are range-partitioned by splitters that Spark samples, then sorted by whole text, spilling where they must.  The splitters' keys are the text's leading bytes, its digest
   and, for a hot text, a salt that deals its rows to several ranges: keys of bounded length, since the driver holds the sample.
3. In a sorted range equal texts are adjacent; neighbours are compared by whole text, and each run gives its size and the row that stays.
4. Runs of one hot text are put together by digest (SHA-256): one row for each run of a text, at most 200,000 texts.

DataFrame functions only.  Of equal texts the row of the largest (or smallest) id stays, just one: a null id loses to every other, and rows that share an id
are told apart by their place in the input.  A null text counts as empty.  Repeated rows are copies; very long texts are compared whole; an empty table gives no
rows.  Other columns, of any name, are not read; ``clean`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

HEAD_BYTES = 32
SHARE = 100_000
LEAST_ROWS, LEAST_BYTES = 32, 1 << 20
BODY, KEY, ROW, HEAD, DIGEST, SALT, PARTS, TOP, SIZE = (f"__exact_{x}" for x in ("body", "key", "row", "head", "digest", "salt", "parts", "top", "size"))


def _unchanged(text: Column) -> Column:
    return text


def _hot(rows: DataFrame) -> DataFrame:
    """(hash, parts): hot texts and how many runs their rows are dealt to; at most 2 * SHARE rows."""
    size = F.octet_length(BODY)
    counted = written(rows.select(BODY).groupBy(F.xxhash64(BODY).alias(KEY)).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")), "counts")
    n, size = counted.agg(F.sum("n"), F.sum("bytes")).first()
    most_rows, most_bytes = max(LEAST_ROWS, (n or 0) // SHARE), max(LEAST_BYTES, (size or 0) // SHARE)
    counted = counted.where("n > 1")
    return counted.select(KEY, F.ceil(F.greatest(F.col("n") / most_rows, F.col("bytes") / most_bytes)).cast("int").alias(PARTS)).where(F.col(PARTS) > 1)


def _place(keep: str) -> tuple[Callable, Column]:
    """The aggregate and the value by which the row that stays is chosen."""
    return {"largest": (F.max, F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", ROW)), "smallest": (F.min, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))}[keep]


def _runs(docs: DataFrame, keep: str, normalise: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with, for each row, its digest and the size and chosen row of its run; runs are whole groups but for hot texts (``parts`` is not null)."""
    rows = docs.withColumns({ROW: F.monotonically_increasing_id(), BODY: normalise(F.coalesce("text", F.lit("")))})
    rows = rows.join(F.broadcast(_hot(rows)), F.xxhash64(BODY) == F.col(KEY), "left").drop(KEY)
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", ROW), F.col(PARTS)), F.lit(0).cast("long"))
    rows = rows.withColumns({HEAD: F.substring(F.encode(BODY, "UTF-8"), 1, HEAD_BYTES), DIGEST: F.sha2(BODY, 256), SALT: salt})
    pick, place = _place(keep)
    run = Window.partitionBy(HEAD, DIGEST, SALT, BODY)
    return rows.repartitionByRange(HEAD, DIGEST, SALT).withColumns({TOP: pick(place).over(run), SIZE: F.count("*").over(run)}).drop(HEAD, BODY)


def _whole(runs: DataFrame, keep: str) -> DataFrame:
    """(digest, top, size) of hot texts, from their runs."""
    pick, _ = _place(keep)
    parts = runs.where(F.col(PARTS).isNotNull()).select(DIGEST, SALT, TOP, SIZE).distinct()
    return parts.groupBy(F.col(DIGEST).alias("digest")).agg(pick(TOP).alias("top"), F.sum(SIZE).alias("size"))


def groups(docs: DataFrame, keep: str = "largest", normalise: Callable[[Column], Column] = _unchanged) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; ``normalise`` maps the text column to what is compared."""
    runs = _runs(docs.select("doc_id", "text"), keep, normalise)
    runs = written(runs.select("doc_id", ROW, DIGEST, SALT, PARTS, TOP, SIZE), "runs")
    out = runs.join(F.broadcast(_whole(runs, keep)), F.col(DIGEST) == F.col("digest"), "left").withColumns({TOP: F.coalesce("top", TOP), SIZE: F.coalesce("size", SIZE)})
    return out.select("doc_id", F.col(f"{TOP}.doc_id").alias("keep_id"), F.col(SIZE).alias("group_size"), (F.col(ROW) == F.col(f"{TOP}.{ROW}")).alias("kept"), F.col(DIGEST).alias("text_sha256"))


def clean(docs: DataFrame, keep: str = "largest", normalise: Callable[[Column], Column] = _unchanged) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    tops = written(_runs(docs, keep, normalise).where(F.col(ROW) == F.col(f"{TOP}.{ROW}")), "tops")
    whole = _whole(tops, keep).select(F.col("digest").alias(BODY), F.col(f"top.{ROW}").alias(HEAD))
    return tops.join(F.broadcast(whole), F.col(DIGEST) == F.col(BODY), "left").where(F.coalesce(F.col(HEAD) == F.col(ROW), F.lit(True))).select(*docs.columns)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""
