"""Volumes through a caller's model: resampling to its voxel size, patches of chunks, masks, and points mapped back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import importable
from ..sources.tiles import cut

AT = ("z", "y", "x")


def _mirror(i: np.ndarray, n: int) -> np.ndarray:
    """Indices reflected about the centres of the first and last voxel."""
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * (n - 1))
    return np.minimum(i, 2 * (n - 1) - i)


def axis_weights(n: int, new: int, order: int = 1) -> list[tuple[int, int, float]]:
    """(voxel of the new axis, voxel of the old one, weight) of resizing an axis of n voxels to ``new``, centres on centres.

    Order 0 takes the nearest voxel.  Order 1 interpolates linearly, mirrored at the ends; where the axis gets shorter it is smoothed first by a Gaussian of (n / new - 1) / 2 voxels.
    """
    at = (np.arange(new) + 0.5) * n / new - 0.5
    if order == 0:
        return [(o, int(i), 1.0) for o, i in enumerate(np.clip(np.floor(at + 0.5), 0, n - 1))]
    low = np.floor(at).astype(int)
    w = np.zeros((new, n))
    np.add.at(w, (np.arange(new), _mirror(low, n)), 1 - (at - low))
    np.add.at(w, (np.arange(new), _mirror(low + 1, n)), at - low)
    sigma = (n / new - 1) / 2
    if sigma > 0:
        r = int(4 * sigma + 0.5)
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        smooth = np.zeros((n, n))
        for d, v in zip(range(-r, r + 1), k / k.sum(), strict=True):
            np.add.at(smooth, (np.arange(n), _mirror(np.arange(n) + d, n)), v)
        w = w @ smooth
    return [(int(o), int(i), float(w[o, i])) for o, i in np.argwhere(w)]


def new_shape(shape: tuple[int, int, int], voxel: tuple[float, float, float], model_voxel: tuple[float, float, float]) -> tuple[int, int, int]:
    """The shape at the model's voxel size; that of the volume where the sizes agree to a hundredth."""
    scale = [a / b for a, b in zip(voxel, model_voxel, strict=True)]
    return shape if all(abs(s - 1) <= 0.01 for s in scale) else tuple(int(round(n * s)) for n, s in zip(shape, scale, strict=True))


def resampled(voxels: DataFrame, shape: tuple[int, int, int], new: tuple[int, int, int], order: int = 1) -> DataFrame:
    """(roi, z, y, x, v) of volumes of ``shape`` resized to ``new``; voxels that aren't there are 0.  Order 0 is for labels.

    Axis by axis voxels meet a table of weights, whose size is that of the axis times a few neighbours, and are summed.
    """
    spark = voxels.sparkSession
    out = voxels.select("roi", *AT, "v")
    for a, n, m in zip(AT, shape, new, strict=True):
        if n == m:
            continue
        w = spark.createDataFrame(axis_weights(n, m, order), "o long, i long, w double")
        out = out.join(F.broadcast(w), out[a] == w["i"]).drop(a, "i").withColumnRenamed("o", a)
        if order == 0:
            out = out.drop("w")
        else:
            out = out.groupBy("roi", *AT).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.select("roi", *AT, "v")


def mapped_back(points: DataFrame, voxel: tuple[float, float, float], model_voxel: tuple[float, float, float]) -> DataFrame:
    """Centroids found at the model's voxel size in voxels of the volume."""
    return points.withColumns({a: F.col(a) * F.lit(m / v) for a, v, m in zip(AT, voxel, model_voxel, strict=True)})


def merged(patches: DataFrame, threshold: float) -> DataFrame:
    """Foreground voxels of overlapping patches (roi, z, y, x, p): the largest probability at each voxel, above the threshold."""
    return patches.groupBy("roi", *AT).agg(F.max("p").alias("p")).where(F.col("p") > threshold)


def patch_mask(chunk: np.ndarray, model: Callable[[np.ndarray], np.ndarray], patch: int, threshold: float, step: int | None = None) -> np.ndarray:
    """Foreground of one chunk: the model's output over patches, merged by maximum where patches overlap.

    The chunk is padded at its ends to whole patches by a ramp down to 0.  A patch whose outputs are all on one side of the threshold, all foreground included, counts as empty.
    """
    step = step or patch
    wide = np.pad(chunk, [(0, max(patch - n, -(n - patch) % step)) for n in chunk.shape], "linear_ramp")
    out = np.zeros(wide.shape, bool)
    for corner in np.ndindex(*[(n - patch) // step + 1 for n in wide.shape]):
        here = tuple(slice(c * step, c * step + patch) for c in corner)
        m = model(wide[here]) > threshold
        if m.any() and not m.all():
            out[here] |= m
    return out[tuple(slice(n) for n in chunk.shape)]


def predicted(
    voxels: DataFrame, shape: tuple[int, int, int], load: Callable[[], Callable[[np.ndarray], np.ndarray]], chunk: int = 128, patch: int = 64, threshold: float = 0.5, step: int | None = None
) -> DataFrame:
    """Foreground voxels (roi, z, y, x) of volumes of ``shape`` by a model of the caller's.

    Chunks become dense rows, dealt to all tasks; ``load`` is called once in each task, and the model that it returns maps a patch (float32) to a probability for each voxel.
    A chunk at the end of a volume is as small as the volume leaves it.  No task holds more than one chunk.
    """
    importable(voxels.sparkSession)
    roi = dict(voxels.dtypes)["roi"]

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        size = [min(chunk, n - o) for n, o in zip(shape, key[1:], strict=True)]
        a = np.zeros(size, np.float32)
        a[tuple(g[f"l{c}"] for c in AT)] = g["v"]
        return pd.DataFrame([[*key, *size, a.tobytes()]], columns=["roi", "tz", "ty", "tx", "nz", "ny", "nx", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k].as_py() for n in b.schema.names}
                model = model or load()
                a = np.frombuffer(row["data"], np.float32).reshape(row["nz"], row["ny"], row["nx"])
                at = np.nonzero(patch_mask(a, model, patch, threshold, step))
                out = {"roi": pa.array([row["roi"]] * len(at[0]), b.schema.field("roi").type)} | {c: pa.array(i + row[f"t{c}"], pa.int64()) for c, i in zip(AT, at, strict=True)}
                yield pa.RecordBatch.from_pydict(out)

    blobs = cut(voxels, chunk).groupBy("roi", "tz", "ty", "tx").applyInPandas(pack, f"roi {roi}, tz long, ty long, tx long, nz long, ny long, nx long, data binary")
    return blobs.mapInArrow(run, f"roi {roi}, z long, y long, x long")
