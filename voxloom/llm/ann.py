"""Exact nearest neighbours by a block matrix join.

Vectors are packed into blocks.  For each (query block, candidate block) an int8 x int8 product tile
gives every inner product up to a proven quantisation error; only pairs whose upper bound reaches the
query's k-th best lower bound are recomputed in double precision, and each task keeps one heap (a
sorted top-k) per query it has seen.  The partial heaps are merged per query.

Error bound: with a = s_a * A + e_a, |e_a| <= s_a / 2 in each component, and likewise b,
|a.b - s_a s_b A.B| <= s_a/2 * |b|_1 + s_b/2 * |s_a A|_1.

Vectors that are null, all zero or hold a null or non-finite component take no part; vectors meet only
those of their own length.  Repeated ids are separate rows; a query never meets rows of its own id.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import importable, shuffle_partitions, written

BLOCK = "side int, dim int, block long, n int, ids binary, vectors binary, codes binary, scale binary, l1 binary, q1 binary"


def _pack(rows: tuple[int, int]):
    """Arrow batches of (id, vector, is query) to block rows of one length: side 0 every vector, side 1 the queries."""

    def block(dim: int, ids: np.ndarray, v: np.ndarray, number: int) -> dict:
        scale = np.abs(v).max(axis=1) / 127.0
        scale[scale == 0] = 1.0
        codes = np.rint(v / scale[:, None]).astype(np.int8)
        return {
            "dim": dim, "block": number, "n": len(ids), "ids": ids.tobytes(), "vectors": v.tobytes(), "codes": codes.tobytes(),
            "scale": scale.tobytes(), "l1": np.abs(v).sum(axis=1).tobytes(), "q1": (np.abs(codes.astype(np.float64)).sum(axis=1) * scale).tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[tuple[int, int], list] = {}

        def flush(key):
            nonlocal number
            ids, v = (np.concatenate(x) for x in zip(*waiting.pop(key), strict=True))
            number += 1
            row = {"side": key[0]} | block(key[1], ids, v, number)
            return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

        for b in batches:
            ids, vecs, sides = b.column(0).to_numpy(zero_copy_only=False), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            sizes = vecs.value_lengths().to_numpy(zero_copy_only=False)
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
            for dim in np.unique(sizes):
                for side in (0, 1):
                    pick = np.flatnonzero((sizes == dim) & ((sides == 1) if side else np.ones(len(sides), bool)))
                    for i in range(0, len(pick), rows[side]):
                        p = pick[i : i + rows[side]]
                        key = (side, int(dim))
                        waiting.setdefault(key, []).append((ids[p].astype(np.int64), flat[at[p][:, None] + np.arange(dim)]))
                        if sum(len(x[0]) for x in waiting[key]) >= rows[side]:
                            yield flush(key)
        for key in list(waiting):
            yield flush(key)

    return run


SCHEMA = pa.schema([("side", pa.int32()), ("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "vectors", "codes", "scale", "l1", "q1"))])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: larger score, then smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= least)
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list] = {}

        def out(key):
            q, h = heaps.pop(key)
            rows = [np.full(len(s), i) for i, (s, _) in zip(q, h, strict=True)]
            if not rows:
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(sum(map(len, rows)), key[0])), pa.array(np.concatenate([np.full(len(x), j) for j, x in enumerate(rows)]).astype(np.int32)), pa.array(np.concatenate(rows).astype(np.int64)), pa.array(np.concatenate([i for _, i in h]).astype(np.int64)), pa.array(np.concatenate([s for s, _ in h]))],
                names=["q_block", "q_row", "query_id", "vec_id", "score"],
            )

        for b in batches:
            for r in b.to_pylist():
                dim, key = r["dim"], (r["q_block"], r["dim"])
                qid, cid = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                if key not in heaps and len(heaps) >= 64:
                    first = next(iter(heaps))
                    if (x := out(first)) is not None:
                        yield x
                if key not in heaps:
                    heaps[key] = (qid, [(np.zeros(0), np.zeros(0, np.int64)) for _ in qid])
                qv, cv = (np.frombuffer(r[x], np.float64).reshape(-1, dim) for x in ("q_vectors", "vectors"))
                qc, cc = (np.frombuffer(r[x], np.int8).reshape(-1, dim).astype(np.float32 if dim <= 1024 else np.float64) for x in ("q_codes", "codes"))
                qs, cs, ql, cl, qq = (np.frombuffer(r[x]) for x in ("q_scale", "scale", "q_l1", "l1", "q_q1"))
                tile = (qc @ cc.T).astype(np.float64) * qs[:, None] * cs  # integer sums below 2**24: exact in float32
                error = 0.5 * qs[:, None] * cl + 0.5 * qq[:, None] * cs
                error += 1e-9 * (1 + np.abs(tile))
                heap = heaps[key][1]
                for i in range(len(qid)):
                    other = cid != qid[i]
                    low = np.where(other, tile[i] - error[i], -np.inf)
                    have, have_id = heap[i]
                    floor = np.sort(np.concatenate((have, np.partition(low, len(low) - k)[-k:] if len(low) > k else low)))[-k:][0] if len(have) + len(low) >= k else -np.inf
                    pick = np.flatnonzero(other & (tile[i] + error[i] >= floor))
                    if len(pick):
                        s = np.concatenate((have, (cv[pick] * qv[i]).sum(axis=1)))
                        ids = np.concatenate((have_id, cid[pick]))
                        best = _best(s, ids, k)
                        heap[i] = (s[best], ids[best])
        for key in list(heaps):
            if (x := out(key)) is not None:
                yield x

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = 512, block_rows: int = 2048) -> DataFrame:
    """The k candidates of largest inner product for every row where ``is_query`` holds.

    Returns query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller id, all candidates
    where there are fewer than k.  ``is_query`` is a Column over ``vectors``.
    """
    spark = vectors.sparkSession
    importable(spark)
    v = F.col(vector_col).cast("array<double>")
    usable = (
        vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.cast("int").alias("q"))
        .where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
        .select("id", "v", F.coalesce("q", F.lit(0)).alias("q"))
    )
    parts = shuffle_partitions(spark)
    # Blocks of both sides from one pass; a block holds the double vectors (8 * dim bytes a row) besides the int8 codes.
    blocks = written(usable.mapInArrow(_pack((block_rows, query_rows)), BLOCK), "blocks")
    candidates = blocks.where("side = 0").drop("side").withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(parts)))
    queries = blocks.where("side = 1").select("dim", F.col("block").alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "codes", "scale", "l1", "q1")))
    queries = queries.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    pairs = queries.join(candidates, ["stripe", "dim"]).select("q_block", "dim", *(f"q_{c}" for c in ("ids", "vectors", "codes", "scale", "l1", "q1")), "ids", "vectors", "codes", "scale", "l1")
    partial = pairs.mapInArrow(_tiles(k), "q_block long, q_row int, query_id long, vec_id long, score double")
    w = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(e, F.col("vec_id") % 20 == 0)
