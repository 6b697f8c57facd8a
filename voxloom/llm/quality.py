"""Quality classifier: learned vectors of hashed words, word pairs and character n-grams, averaged per document.

A document's vector is the mean of its word and word-pair vectors plus the mean of its character n-gram
vectors (n-grams of UTF-8 bytes, across word boundaries, so that a space marks the start or end of a word).  A softmax
over the two classes follows.  Embeddings and output layer are trained together by stochastic gradient descent
(Adagrad steps, mini-batches) in numpy, on at most ``bound`` labelled rows.  A word pair of one word twice has a bucket of
its own.  For scoring, the output layer is multiplied into the embeddings once, so a text costs one table look-up for each feature.

Empty and null texts have the zero vector and score the bias.  Whole texts are read, of any length; repeated rows
are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .labelled import held_out, training_rows
from .shared import importable

BITS = 16
GRAMS = (3, 5)
REPEAT = 0


def _grams(d: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes from every position but the last n - 1."""
    m = len(d) - n + 1
    v = np.zeros(m, np.uint64)
    for k in range(n):
        v |= d[k : k + m].astype(np.uint64) << np.uint64(8 * k)
    v *= np.uint64(0x9E3779B97F4A7C15 + 2 * n)
    return (v >> np.uint64(64 - BITS)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list]]:
    """For runs of texts: first, end and [(buckets, text of each)] of the word group and the n-gram group."""
    with np.errstate(over="ignore"):
        for i, j in T.groups(offsets, 1 << 21):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, first = T.spans(d, o)
            h = T.word_hashes(d, starts, ends)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            words = (h >> np.uint64(64 - BITS)).astype(np.int32)
            pairs = (T.ngrams(h, 2) >> np.uint64(64 - BITS)).astype(np.int32)
            if len(h) > 1:
                pairs[h[1:] == h[:-1]] = REPEAT
            inside = doc[1:] == doc[:-1]
            word = (np.concatenate((words, pairs[inside])), np.concatenate((doc, doc[:-1][inside])))
            owner = np.repeat(np.arange(j - i), np.diff(o))
            parts = []
            for n in GRAMS:
                if len(d) >= n:
                    same = owner[: len(d) - n + 1] == owner[n - 1 :]
                    parts.append((_grams(d, n)[same], owner[: len(d) - n + 1][same]))
            gram = tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            yield i, j, [word, gram]


def _collect_features(batches):
    """(y, buckets, weights): distinct buckets of a text with their share of the group they are in."""
    for b in batches:
        data, offsets = T.buffer(b.column("text"))
        y = b.column("y")
        for i, j, sides in features(data, offsets):
            key, weight, at = [], [], []
            for side, (bucket, doc) in enumerate(sides):
                n = np.maximum(np.bincount(doc, minlength=j - i), 1)
                u, c = np.unique(doc.astype(np.int64) << (BITS + 1) | side << BITS | bucket, return_counts=True)
                key.append(u & ((1 << BITS + 1) - 1))
                at.append(u >> (BITS + 1))
                weight.append(c / n[at[-1]])
            key, weight, at = map(np.concatenate, (key, weight, at))
            order = np.argsort(at, kind="stable")
            key, weight, cut = key[order].astype(np.int32), weight[order].astype(np.float32), np.searchsorted(at[order], np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays(
                [y.slice(i, j - i), *(pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in range(j - i)], pa.binary()) for x in (key, weight))], names=["y", "buckets", "weights"]
            )


@dataclass(frozen=True)
class Model:
    """Log-odds of label 1: ``table[side][bucket]`` is what one feature adds, times its share."""

    table: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = T.buffer(texts)
        out = np.full(len(offsets) - 1, self.bias)
        for i, j, sides in features(data, offsets):
            for side, (bucket, doc) in enumerate(sides):
                n = np.maximum(np.bincount(doc, minlength=j - i), 1)
                out[i:j] += np.bincount(doc, weights=self.table[side][bucket], minlength=j - i) / n
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(y: np.ndarray, buckets: list[np.ndarray], weights: list[np.ndarray], dim: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.25, seed: int = 5) -> Model:
    """Stochastic gradient descent on the softmax loss; both classes' output vectors are learned."""
    rng = np.random.default_rng(seed)
    size = 2 << BITS
    e = rng.normal(0, 0.05, (dim, size)).astype(np.float32)
    w = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    c = np.zeros(2, np.float32)
    ge, gw, gc = np.full((dim, size), 1e-4, np.float32), np.full((dim, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    n = len(y)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at : at + batch]
            idx = np.concatenate([buckets[k] for k in pick])
            wt = np.concatenate([weights[k] for k in pick])
            doc = np.repeat(np.arange(len(pick)), [len(buckets[k]) for k in pick])
            v = np.column_stack([np.bincount(doc, weights=wt * e[k][idx], minlength=len(pick)) for k in range(dim)]).astype(np.float32)
            z = v @ w + c
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            dv = p @ w.T
            dw, dc = v.T @ p, p.sum(axis=0)
            for k in range(dim):
                de = np.bincount(idx, weights=wt * dv[doc, k], minlength=size).astype(np.float32)
                ge[k] += de * de
                e[k] -= step * de / np.sqrt(ge[k])
            gw += dw * dw
            w -= step * dw / np.sqrt(gw)
            gc += dc * dc
            c -= step * dc / np.sqrt(gc)
    return Model(((w[:, 1] - w[:, 0]) @ e).astype(np.float64).reshape(2, -1), float(c[1] - c[0]))


def _split(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """Views into a binary column, without copies."""
    data, offsets = T.buffer(column)
    return [data[i:j].view(kind) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 2_500) -> Model:
    """Learn from at most ``bound`` labelled rows outside the held-out fold (see ``training_rows``)."""
    importable(docs.sparkSession)
    rows = training_rows(docs, labels, label, bound)
    got = rows.mapInArrow(_collect_features, "y int, buckets binary, weights binary").toArrow().combine_chunks()
    y = got["y"].to_numpy().astype(np.int64)
    if not len(y):
        return Model(np.zeros((2, 1 << BITS)), 0.0)
    b, w = (_split(got[c], t) for c, t in (("buckets", np.int32), ("weights", np.float32)))
    order = np.lexsort((np.array([float(x.sum()) for x in w]), np.array([int(x.sum()) for x in b]), y))  # the same order on every run
    return fit(y[order], [b[k] for k in order], [w[k] for k in order])


def score(docs: DataFrame, model: Model, threshold: float = 0.3, names: tuple[str, str] = ("quality", "good")) -> DataFrame:
    """Every row of ``docs`` with a score (0 to 1) and a verdict (0 or 1) under ``names``; columns of these names are replaced."""
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)  # 2 * 2**BITS doubles: 1 MB

    def run(batches):
        m = shared.value
        for b in batches:
            s = m.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, *names])

    clean = docs.drop(*names)
    fields = ", ".join(f"`{n}` {t}" for n, t in clean.dtypes)
    return clean.mapInArrow(run, f"{fields}, `{names[0]}` double, `{names[1]}` int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), F.col("good").alias("predicted"))
