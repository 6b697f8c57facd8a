"""Kernels applied to tiles: one grouped map for each tile; lines of voxels in, sparse rows out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import kernels as K
from . import objects as O
from .project import assembled, halo_lines, owned
from ..sources.session import importable
from ..sources.tiles import lines
from .settings import Settings
from .shared import settled


BLOCK = ("tz", "ty", "tx")


def _blocks(voxels: DataFrame, tile: int | None, margin: int | tuple[int, int, int], shape: tuple[int, int, int] | None) -> tuple[DataFrame, list[str], Callable]:
    """Voxels as lines by block, the block's key, and a function (key, lines) -> (lowest corner, values, which voxels are there), None for a block without voxels.

    Voxels (roi, z, y, x, v) are put into lines along x first, unless they come as such (``tiles.lines``): what is copied, shuffled and sorted are lines, not voxels.
    """
    keys, margins = ["roi"], margin if isinstance(margin, tuple) else (margin,) * 3
    runs = voxels if "xs" in voxels.columns else lines(voxels, size=tile)
    if tile:
        runs, keys = halo_lines(runs, tile, margins), ["roi", *BLOCK]
        for t, n in zip(BLOCK, shape or (None,) * 3, strict=True):
            runs = runs.where((F.col(t) >= 0) & (F.col(t) < n)) if n else runs.where(F.col(t) >= 0)

    def dense(key: tuple, g: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        at, v = unpacked(g)
        if not len(v):
            return None
        lo, hi = np.zeros(3, int), np.array(shape) if shape else at.max(axis=1) + 1
        if tile:
            o = np.array(key[1:])
            lo = np.maximum(lo, o - margins)
            hi = np.minimum(hi, o + tile + margins) if shape else o + tile + margins
        elif not shape:
            lo = at.min(axis=1)
        a, there = np.zeros(tuple(hi - lo)), np.zeros(tuple(hi - lo), bool)
        at = tuple(at - lo[:, None])
        a[at], there[at] = v, True
        return lo, a, there

    return runs, keys, dense


def unpacked(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places (3, n) and values of the voxels of lines (z, y, xs, vs)."""
    n = pc.list_value_length(g["xs"]).to_numpy()
    flat = lambda c: pc.list_flatten(g[c]).to_numpy()
    return np.array([np.repeat(g["z"].to_numpy(), n), np.repeat(g["y"].to_numpy(), n), flat("xs")]), flat("vs")


def per_tile(
    voxels: DataFrame, kernel: Callable[[np.ndarray], np.ndarray | tuple[np.ndarray, ...]], value: str | tuple[str, ...] = "v", out: str = "long", keep_zero: bool = False, tile: int | None = None, margin: int | tuple[int, int, int] = 0,
    shape: tuple[int, int, int] | None = None, with_there: bool = False,
) -> DataFrame:
    """A kernel over each tile's dense block: (roi, z, y, x, value), zeros left out; voxels come as rows (roi, z, y, x, v) or as ``tiles.lines``.

    With ``tile`` a block is a tile of that side and ``margin`` voxels around it, inside ``shape``, the declared size of a roi; what the kernel gives in the margin is
    dropped, so a kernel that reaches no farther than the margin gives the same as over the whole roi.  Without it a roi is one tile.
    Blocks are made inside the task from sparse lines; voxels that aren't there are 0, and don't change a block's size.
    A kernel that gives several arrays has as many names in ``value``, and a voxel is left out where all are 0.
    ``with_there`` hands the kernel the block and which of its voxels are there, and rows are made for those, 0 or not.
    """
    importable(voxels.sparkSession)
    names = [value] if isinstance(value, str) else list(value)
    fields = T.StructType.fromDDL(f"roi {dict(voxels.dtypes)['roi']}, z long, y long, x long, " + ", ".join(f"{v} {out}" for v in names))
    kinds, (voxels, keys, dense) = to_arrow_schema(fields), _blocks(voxels, tile, margin, shape)

    def run(key: tuple, g: pa.Table) -> pa.Table:
        key = [k.as_py() for k in key]
        block = dense(key, g)
        if block is None:
            return kinds.empty_table()
        lo, a, there = block
        r = kernel(a, there) if with_there else kernel(a)
        r = [r] if isinstance(value, str) else list(r)
        if tile:
            core = tuple(slice(max(0, o - l), o - l + tile) for o, l in zip(key[1:], lo, strict=True))
            r, there, lo = [one[core] for one in r], there[core], np.array([l + s.start for l, s in zip(lo, core, strict=True)])
        pick = np.indices(r[0].shape).reshape(3, -1) if keep_zero else np.array(np.nonzero(there if with_there else np.any([one != 0 for one in r], axis=0)))
        return table(kinds, {"roi": key[0], **{c: pick[i] + lo[i] for i, c in enumerate("zyx")}, **{n: one[tuple(pick)] for n, one in zip(names, r, strict=True)}})

    return voxels.groupBy(*keys).applyInArrow(run, fields)


def table(kinds: pa.Schema, columns: dict) -> pa.Table:
    """Columns of the kinds of a schema; one that is no array is the same in every row."""
    n = max(len(c) for c in columns.values() if isinstance(c, np.ndarray))
    whole = lambda f: pa.array(columns[f.name]).cast(f.type) if isinstance(columns[f.name], np.ndarray) else pa.repeat(pa.scalar(columns[f.name], f.type), n)
    return pa.Table.from_arrays([whole(f) for f in kinds], schema=kinds)


def segmented(voxels: DataFrame, shape: tuple[int, int, int] | None = None, **config) -> DataFrame:
    """Label voxels (roi, z, y, x, label) where each roi is one tile."""
    return per_tile(voxels, lambda a: K.segment(a, **config)[1], "label", shape=shape)


def tiled_segmentation(voxels: DataFrame, shape: tuple[int, int, int], tile: int = 128, margin: int = 16, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Objects of volumes of any size: (label voxels (roi, z, y, x, gid), objects (roi, tz, ty, tx, label, gid, area, solidity, reasons, accepted, ...)).

    Each tile is segmented with ``margin`` voxels of its neighbours around it; voxels that aren't there are invalid and never foreground.  Objects are screened among those of
    their block, by solidity, volume and length; an accepted one is kept by the tile that holds its centroid, so an object on a
    boundary is found once, and where kept objects meet, the tile's own comes first.  No task holds more than one block.
    """
    importable(voxels.sparkSession)
    whole = [f"{a}{k}" for k in "01" for a in "zyx"]
    fields = T.StructType.fromDDL(f"roi {dict(voxels.dtypes)['roi']}, tz long, ty long, tx long, label long, area long, cz double, cy double, cx double, " + ", ".join(f"{c} long" for c in whole) + ", bound double, solidity double, solid boolean, voxels array<long>")
    kinds, (blocks, keys, dense) = to_arrow_schema(fields), _blocks(voxels, tile, margin, shape)
    config, least = settings.kernel(), settings.solidity_thresh

    def run(key: tuple, g: pa.Table) -> pa.Table:
        """One row for each object of a block, with its voxels as places in the roi: what is screened and dealt out are objects, not voxels."""
        key = [k.as_py() for k in key]
        block = dense(key, g)
        if block is None:
            return kinds.empty_table()
        lo, a, there = block
        r = K.segment(a, valid=there, **config)[1]
        at = np.argwhere(r)
        own = r[tuple(at.T)]
        order = np.argsort(own, kind="stable")
        at, (ids, first) = (at + lo)[order], np.unique(own[order], return_index=True)
        rows = []
        for label, p in zip(ids.tolist(), np.split(at, first[1:]), strict=False):
            z0, z1 = p.min(axis=0), p.max(axis=0) + 1
            bound = len(p) / int((z1 - z0).prod())
            clear = bound >= least or K.projections_clear(p, least)
            solidity = None if clear else len(p) / K.hull_volume(p.astype(float))
            rows.append([*key, label, len(p), *(p.sum(axis=0) / len(p)).tolist(), *z0.tolist(), *z1.tolist(), bound, solidity, clear or solidity >= least, np.ravel_multi_index(tuple(p.T), shape)])
        return pa.Table.from_arrays([pa.array([row[k] for row in rows], f.type) for k, f in enumerate(kinds)], schema=kinds)

    found = settled(blocks.groupBy(*keys).applyInArrow(run, fields))
    stats = O.accepted(O.reasons(found.drop("voxels"), keys=tuple(keys), **settings.screen()), settings.accept_big_side_flags)
    stats = settled(stats)
    own = settled(owned(stats.where("accepted"), tile))
    gids = own.select(*keys, "label", "gid").hint("merge")
    pieces = found.select(*keys, "label", "voxels").join(gids, [*keys, "label"]).select("roi", F.struct(*BLOCK).alias("source"), "gid", F.explode("voxels").alias("_at"))
    at = {"z": F.expr(f"_at div {shape[1] * shape[2]}"), "y": F.expr(f"_at div {shape[2]} % {shape[1]}"), "x": F.expr(f"_at % {shape[2]}")}
    target = F.struct(*[(F.floor(F.col(c) / tile) * tile).cast("long").alias(t) for c, t in zip("zyx", BLOCK, strict=True)])
    pieces = pieces.withColumns(at).select("roi", "z", "y", "x", target.alias("target"), "source", "gid")
    return assembled(pieces), stats.join(gids, [*keys, "label"], "left")


def screened(labels: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("roi",)) -> DataFrame:  # noqa: B008
    """Statistics of the objects of each block (``keys``) with their reasons for doubt and whether they are accepted."""
    stats = O.statistics(labels, (*keys, "label"))
    stats = solidity(labels, stats, settings.solidity_thresh, (*keys, "label"))
    return O.accepted(O.reasons(stats, keys=keys, **settings.screen()), settings.accept_big_side_flags)


def accepted_labels(voxels: DataFrame, settings: Settings = Settings(), shape: tuple[int, int, int] | None = None) -> DataFrame:  # noqa: B008
    """Label voxels of accepted objects where each roi is one tile."""
    found = settled(segmented(voxels, shape, **settings.kernel()))
    return found.join(screened(found, settings).where("accepted").select("roi", "label"), ["roi", "label"], "left_semi")


def blob_density(voxels: DataFrame, shape: tuple[int, int, int], diameter: float = 15.0, keys: tuple[str, ...] = ("roi",)) -> DataFrame:
    """(keys, n_blobs, blobs_per_mvox) of every tile, of the declared shape: peaks of the smoothed tile (``kernels.blobs``); null for a tile of fewer than 1,000 non-zero voxels.

    A tile is what ``keys`` name; where they hold its origin (tz, ty, tx), voxels lie relative to that.  Voxels come as rows or as ``tiles.lines``.
    """
    importable(voxels.sparkSession)
    kinds = dict(voxels.dtypes)
    fields = T.StructType.fromDDL(", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_blobs long, blobs_per_mvox double")
    runs, kinds = voxels if "xs" in voxels.columns else lines(voxels, keys), to_arrow_schema(fields)

    def run(key: tuple, g: pa.Table) -> pa.Table:
        key = [k.as_py() for k in key]
        lo = np.array([key[keys.index(t)] if t in keys else 0 for t in BLOCK])
        a, (at, v) = np.zeros(shape), unpacked(g)
        if not len(v):
            return kinds.empty_table()
        a[tuple(at - lo[:, None])] = v
        n, density = K.blobs(a, diameter) or (None, None)
        return pa.Table.from_pylist([dict(zip(kinds.names, [*key, None if n is None else int(n), density], strict=True))], schema=kinds)

    return runs.groupBy(*keys).applyInArrow(run, fields)


def solidity(labels: DataFrame, stats: DataFrame, threshold: float, keys: tuple[str, ...] = ("roi", "label")) -> DataFrame:
    """Adds solidity to statistics, and solid: whether it reaches the threshold.

    Two bounds come before an exact hull: area over box volume never exceeds solidity and needs only the statistics; for what it leaves, the hulls of the
    three projections.  An object that a bound clears is solid without a solidity.
    """
    importable(labels.sparkSession)
    bound = O.box_bound(stats).withColumnRenamed("solidity_bound", "bound")
    doubt = bound.where(F.col("bound") < threshold).select(*keys)
    kinds = dict(labels.dtypes)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        p = g[["z", "y", "x"]].to_numpy()
        clear = K.projections_clear(p, threshold)
        return pd.DataFrame([[*key, None if clear else len(p) / K.hull_volume(p.astype(float)), clear]], columns=[*keys, "solidity", "clear"])

    fields = ", ".join(f"{k} {kinds[k]}" for k in keys)
    hull = labels.select(*dict.fromkeys([*keys, "z", "y", "x"])).join(doubt, list(keys), "left_semi").groupBy(*keys).applyInPandas(run, f"{fields}, solidity double, clear boolean")
    out = bound.join(hull, list(keys), "left")
    return out.withColumn("solid", F.coalesce(F.col("clear") | (F.col("solidity") >= threshold), F.col("clear"), F.col("bound") >= threshold)).drop("clear")
