"""Operators on volumes whose results do not depend on how they are cut: distances, and floods across tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import importable
from . import kernels as K
from .masks import offsets
from .shared import settled

TILE = ("tz", "ty", "tx")
AT = ("z", "y", "x")


def _lines(along: str, across: list[str], n: int, spacing: float):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        line, which = np.unique(g[across].to_numpy(), axis=0, return_inverse=True)
        f = np.zeros((len(line), n))  # a voxel without a row is background
        at = which.ravel(), g[along].to_numpy()
        f[at] = g["d2"]
        return g.assign(d2=K.envelope(f, spacing)[at])[["roi", *AT, "d2"]]

    return run


def distance(mask: DataFrame, shape: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), lines: int = 64) -> DataFrame:
    """(roi, z, y, x, distance) of foreground voxels: the exact distance to the nearest background voxel inside ``shape``, whatever the thickness; infinite in a roi without background.

    One pass for each axis: a group holds ``lines`` by ``lines`` whole lines of one roi and gives each line's lower envelope of parabolas, which costs time linear in the line.  Three shuffles, no halo.
    """
    importable(mask.sparkSession)
    roi = dict(mask.dtypes)["roi"]
    out = mask.select("roi", *AT).distinct().withColumn("d2", F.lit(float("inf")))
    for axis, (n, s) in enumerate(zip(shape, spacing, strict=True)):
        across = [a for a in AT if a != AT[axis]]
        blocks = [F.floor(F.col(a) / lines).alias(f"_{a}") for a in across]
        out = out.groupBy("roi", *blocks).applyInPandas(_lines(AT[axis], across, n, s), f"roi {roi}, z long, y long, x long, d2 double")
    return out.select("roi", *AT, F.sqrt("d2").alias("distance"))


def _tile(tile: int, p: str = "") -> list[Column]:
    return [(F.floor(F.col(f"{p}{a}") / tile) * tile).cast("long").alias(t) for a, t in zip(AT, TILE, strict=True)]


STATE = "level double, hop long, label long"


def _flood(tile: int):
    def run(key: tuple, g: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        """One tile, with a rim of one voxel that holds what its neighbours know."""
        lo = np.array(key[1:]) - 1
        side = (tile + 2,) * 3
        height, free, marker = np.zeros(side), np.zeros(side, bool), np.zeros(side, np.int64)
        at = tuple(g[a].to_numpy() - l for a, l in zip(AT, lo, strict=True))
        height[at], free[at], marker[at] = g["height"], True, g["marker"].fillna(0).astype(np.int64)
        rim = tuple(edge[a].to_numpy() - l for a, l in zip(AT, lo, strict=True))
        level, hop, label = K.flood(height, marker, free, (np.ravel_multi_index(rim, side), edge["level"].to_numpy(), edge["hop"].to_numpy(), edge["label"].to_numpy()) if len(edge) else None)
        out = g.assign(level=level[at], hop=hop[at], label=label[at])
        return out[["roi", *TILE, *AT, "level", "hop", "label"]]

    return run


def watershed(voxels: DataFrame, tile: int = 64) -> DataFrame:
    """(roi, z, y, x, label) of a flood of ``voxels`` (roi, z, y, x, height, marker), the mask's voxels with a marker's label or null, over faces; the same however it is cut.

    The order of the flood is that of ``kernels.flood``.  Tiles are flooded alone, then rims of one voxel are exchanged: a tile whose rim changed is flooded anew from its markers and
    rim, until no rim changes.  A round costs the tiles that changed; there are about as many rounds as an object spans tiles.  Voxels that no marker reaches have label 0.
    """
    importable(voxels.sparkSession)
    roi = dict(voxels.dtypes)["roi"]
    keys = ["roi", *TILE]
    cells = settled(voxels.select("roi", *_tile(tile), *AT, F.col("height").cast("double").alias("height"), F.col("marker").cast("long").alias("marker")))
    fields = f"roi {roi}, tz long, ty long, tx long, z long, y long, x long, {STATE}"
    rim = cells.select(*keys, *AT, F.lit(0.0).alias("level"), F.lit(0).cast("long").alias("hop"), F.lit(0).cast("long").alias("label")).limit(0)
    todo, state = cells, None
    while True:
        new = settled(todo.groupBy(*keys).cogroup(rim.groupBy(*keys)).applyInPandas(_flood(tile), fields))
        state = new if state is None else settled(state.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new))
        now = settled(_rims(state, tile))
        # Tiles whose rim isn't what it was.
        same = ["roi", *TILE, *AT, "level", "hop", "label"]
        changed = now.join(rim, same, "left_anti").select(*keys).unionByName(rim.join(now, same, "left_anti").select(*keys)).distinct()
        changed = settled(changed)
        if not changed.limit(1).count():
            return state.select("roi", *AT, "label")
        todo, rim = cells.join(changed, keys, "left_semi"), now


def _rims(state: DataFrame, tile: int) -> DataFrame:
    """What lies beyond each tile's faces: states of labelled voxels at faces, dealt to the tile on the other side."""
    out = None
    known = state.where("label > 0")
    for a, t in zip(AT, TILE, strict=True):
        for edge, step in ((0, -tile), (tile - 1, tile)):
            part = known.where(F.col(a) - F.col(t) == edge).withColumn(t, F.col(t) + step)
            out = part if out is None else out.unionByName(part)
    return out


# --- components ----------------------------------------------------------------------------------


def _local(tile: int, connectivity: int):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """Components inside one tile, each named by its first voxel."""
        lo = np.array(key[1:])
        mask = np.zeros((tile,) * 3, bool)
        at = tuple(g[a].to_numpy() - l for a, l in zip(AT, lo, strict=True))
        mask[at] = True
        lab = K.components(mask, connectivity)
        where = np.flatnonzero(mask)
        first = np.zeros(lab.max() + 1, np.int64)
        first[lab.ravel()[where][::-1]] = where[::-1]
        f = np.unravel_index(first[lab[at]], mask.shape)
        return g.assign(**{f"f{a}": f[i] + lo[i] for i, a in enumerate(AT)})

    return run


def local_components(mask: DataFrame, connectivity: int, tile: int) -> DataFrame:
    """(roi, tz, ty, tx, z, y, x, fz, fy, fx): each voxel's component inside its tile, as that component's first voxel."""
    importable(mask.sparkSession)
    roi = dict(mask.dtypes)["roi"]
    cells = mask.select("roi", *_tile(tile), *AT).distinct()
    return cells.groupBy("roi", *TILE).applyInPandas(_local(tile, connectivity), f"roi {roi}, tz long, ty long, tx long, z long, y long, x long, fz long, fy long, fx long")


def border_links(local: DataFrame, connectivity: int, tile: int) -> DataFrame:
    """Distinct pairs (a, b) of components of different tiles that touch over a face, an edge or a corner; only voxels at tile borders are joined."""
    rim = F.lit(False)
    for a, t in zip(AT, TILE, strict=True):
        rim = rim | (F.col(a) == F.col(t)) | (F.col(a) == F.col(t) + tile - 1)
    name = F.struct("roi", *[F.col(f"f{a}").alias(a) for a in AT])
    border = settled(local.where(rim).select("roi", *TILE, *AT, name.alias("node")))
    o = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip(AT, x, strict=True)]) for x in offsets(connectivity) if x > (0, 0, 0)]))
    moved = border.withColumn("o", o).select("roi", F.col("node").alias("a"), *[F.col(t).alias(f"o{t}") for t in TILE], *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AT])
    other = F.lit(False)
    for a, t in zip(AT, TILE, strict=True):
        other = other | (F.col(a) < F.col(f"o{t}")) | (F.col(a) >= F.col(f"o{t}") + tile)
    return moved.where(other).join(border.select("roi", *AT, F.col("node").alias("b")), ["roi", *AT]).select("a", "b").distinct()

