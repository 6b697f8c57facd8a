"""Packing: optimal length buckets from the global histogram, token-budget batches inside each.

Texts longer than ``max_tokens`` are cut into pieces of that many tokens and a rest; each piece carries its slice of the text.  The histogram of piece lengths
has at most ``max_tokens`` entries, so it may come to the driver whatever the input's size.  Dynamic programming over it
chooses ``buckets`` boundaries that minimise the total padding to the boundary.  A batch of a bucket holds as many
pieces as its token budget allows at the boundary's length.

Tokens are maximal runs outside 0x20 and 0x09-0x0D, or those of a tokenizer file where one is given (a character that a cut divides is in both slices).  Null and
blank texts have no tokens: one row with bucket, batch and text null.  A bucket is dealt by row into shards of about
``shard_rows`` pieces, so no task gets a whole bucket, whatever ids are null or repeated; each shard's last batch may be short.  Rows are
numbered once, in a written table: batches are ordered by (doc_id, piece), ties by that number, so which of several rows with one id comes first depends on how the
input is read.  Repeated rows are packed each.  Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .shared import importable, written


def _pieces(max_tokens: int, tokenizer_file: str | None):
    """Rows of (row, doc_id, piece, start, n_tokens, text), at least one for each text."""

    def run(batches):
        from pyspark import TaskContext

        number, tok = TaskContext.get().partitionId() << 40, None
        if tokenizer_file:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer_file)
        for b in batches:
            data, offsets = T.buffer(b.column("text"))
            for i, j in T.groups(offsets):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                raw = d.tobytes()
                if tok:
                    edges = []
                    for k in range(j - i):
                        t = raw[o[k] : o[k + 1]].decode("utf-8", "replace")
                        at = np.cumsum([0, *(len(c.encode()) for c in t)]) + o[k]
                        edges.append(at[np.array([e for e in tok.encode(t, add_special_tokens=False).offsets], np.int64).reshape(-1, 2)])
                    first = np.cumsum([0, *map(len, edges)])
                    starts, ends = np.concatenate(edges).T
                else:
                    starts, ends, first = T.spans(d, o)
                n = np.diff(first)
                many = np.maximum(1, -(-n // max_tokens))
                text = np.repeat(np.arange(j - i), many)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
                size = np.minimum(max_tokens, n[text] - piece * max_tokens)
                at = first[:-1][text] + piece * max_tokens
                slices = [raw[starts[a] : ends[a + m - 1]].decode("utf-8", "replace") if m else None for a, m in zip(at, size, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + np.arange(len(text))), b.column("doc_id").slice(i, j - i).take(pa.array(text)), pa.array(piece), pa.array(piece * max_tokens), pa.array(size), pa.array(slices, pa.string())],
                    names=["row", "doc_id", "piece", "start", "n_tokens", "text"],
                )
                number += len(text)

    return run


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total of (boundary - length) * count."""
    order = np.argsort(lengths)
    v, c = lengths[order].astype(np.float64), counts[order].astype(np.float64)
    n = len(v)
    if not n:
        return []
    rows, tokens = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(v * c)))
    best = np.concatenate(([0.0], np.full(n, np.inf)))
    back = []
    for _ in range(min(buckets, n)):
        nxt, frm = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        nxt[0] = 0.0
        for j in range(1, n + 1):
            # The last bucket holds lengths i+1..j, all padded to v[j-1].
            cost = best[:j] + v[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            frm[j] = int(np.argmin(cost))
            nxt[j] = cost[frm[j]]
        back.append(frm)
        best = nxt
    out, j = [], n
    for frm in reversed(back):
        if j == 0:
            break
        out.append(int(v[j - 1]))
        j = int(frm[j])
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 12, budget: int = 65_536, max_tokens: int = 2_048, shard_rows: int = 50_000, tokenizer_file: str | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket_tokens, batch, text, padding: one row for each piece of every row of ``docs``."""
    importable(docs.sparkSession)
    fields = "row long, doc_id long, piece long, start long, n_tokens long, text string"
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(max_tokens, tokenizer_file), fields), "pieces")
    histogram = pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas()  # at most max_tokens rows
    bounds = boundaries(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets)
    rows = [int(histogram.loc[(histogram.n_tokens > lo) & (histogram.n_tokens <= hi), "n"].sum()) for lo, hi in zip([0, *bounds], bounds, strict=False)]
    size, shards, fits = F.lit(None).cast("long"), F.lit(1), F.lit(1)
    for hi, n in reversed(list(zip(bounds, rows, strict=True))):
        here = (F.col("n_tokens") > 0) & (F.col("n_tokens") <= hi)
        size, shards, fits = F.when(here, F.lit(hi).cast("long")).otherwise(size), F.when(here, max(1, math.ceil(n / shard_rows))).otherwise(shards), F.when(here, max(1, budget // hi)).otherwise(fits)
    out = pieces.select("*", size.alias("bucket_tokens"), F.pmod(F.xxhash64("row"), shards).alias("shard"), fits.alias("fits"))
    w = Window.partitionBy("bucket_tokens", "shard").orderBy("doc_id", "piece", "row")
    packed = out.where("bucket_tokens is not null").withColumn("k", F.floor((F.row_number().over(w) - 1) / F.col("fits")))
    packed = packed.withColumn("batch", F.concat_ws("-", "bucket_tokens", "shard", "k"))
    empty = out.where("bucket_tokens is null").withColumn("batch", F.lit(None).cast("string"))
    cols = ["doc_id", "piece", "start", "n_tokens", "bucket_tokens", "batch", "text"]
    return packed.select(*cols).unionByName(empty.select(*cols)).withColumn("padding", F.col("bucket_tokens") - F.col("n_tokens"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
