"""Volumes to pictures: mosaics, projections, sections, point splats, colours; and deskewing."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import golden_hue
from ..sources.tiles import numbered

SHEAR = math.tan(math.radians(7.0))


def mosaic(tiles: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Tile-local labels (roi, tz, ty, tx, z, y, x, local) made unique by the running sum of earlier tiles' largest ids.

    Of ``expected`` tiles (roi, tz, ty, tx) some must have labels, or it is an error; those that lack them are warned of.
    """
    if expected is not None:
        have = expected.join(tiles.select("roi", "tz", "ty", "tx").distinct().withColumn("have", F.lit(1)), ["roi", "tz", "ty", "tx"], "left").agg(F.count("*").alias("n"), F.count("have").alias("have")).first()
        if have["n"] and not have["have"]:
            raise FileNotFoundError(f"none of {have['n']} tiles has labels")
        if have["have"] < have["n"]:
            warnings.warn(f"{have['n'] - have['have']} of {have['n']} tiles have no labels", stacklevel=2)
    top = tiles.groupBy("roi", "tz", "ty", "tx").agg(F.max("local").alias("m"))
    w = Window.partitionBy("roi").orderBy("tz", "ty", "tx").rowsBetween(Window.unboundedPreceding, -1)
    shift = top.select("roi", "tz", "ty", "tx", F.coalesce(F.sum("m").over(w), F.lit(0)).alias("shift"))
    return tiles.join(shift, ["roi", "tz", "ty", "tx"]).withColumn("label", F.col("local") + F.col("shift"))


def extents(tiles: DataFrame, side: int = 128) -> DataFrame:
    """Per roi: number of tiles and extent by axis."""
    return tiles.groupBy("roi").agg(F.count("*").alias("tiles"), *[(F.max(a) + side).alias(f"n{a}") for a in "zyx"])


def projection(voxels: DataFrame, axis: str = "z") -> DataFrame:
    """Maximum intensity along an axis."""
    return voxels.groupBy("roi", *[a for a in "zyx" if a != axis]).agg(F.max("v").alias("v"))


def brightest_label(voxels: DataFrame, labels: DataFrame, axis: str = "z") -> DataFrame:
    """Label of the brightest labelled voxel along an axis, the first on a tie."""
    both = voxels.join(labels.select("roi", "z", "y", "x", "label").hint("merge"), ["roi", "z", "y", "x"])
    return both.groupBy("roi", *[a for a in "zyx" if a != axis]).agg(F.max(F.struct("v", (-F.col(axis)).alias("m"), "label"))["label"].alias("label"))


def section(voxels: DataFrame, axis: str, depth: int, half_um: float, voxel_um: float) -> DataFrame:
    """Voxels within half_um of the middle of an axis."""
    mid, half = depth // 2, max(1, round(half_um / voxel_um))
    return voxels.where((F.col(axis) >= mid - half) & (F.col(axis) < mid + half))


def splat(points: DataFrame, degrees: float, centre: float, scale: float = 1.0) -> DataFrame:
    """Points (roi, z, y, x, label) turned about y and drawn on a grid: the nearest point of each pixel wins."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    u = (F.col("x") - centre) * c - (F.col("z") - centre) * s
    d = (F.col("x") - centre) * s + (F.col("z") - centre) * c
    p = points.select("roi", F.floor(u * scale + centre).cast("long").alias("u"), F.floor(F.col("y") * scale).cast("long").alias("w"), F.round(d, 6).alias("depth"), "label")
    return p.groupBy("roi", "u", "w").agg(F.min(F.struct("depth", "label")).alias("b")).select("roi", "u", "w", F.col("b.depth").alias("depth"), F.col("b.label").alias("label"))


def coloured(objects: DataFrame) -> DataFrame:
    return objects.withColumn("hue", F.round(golden_hue(F.col("label")), 6))


def deskewed_points(points: DataFrame, shear: float = SHEAR) -> DataFrame:
    """Native (z, y, x) to deskewed coordinates."""
    return points.withColumn("xd", F.col("x") + F.lit(shear) * F.col("z"))


def native_points(points: DataFrame, shear: float = SHEAR) -> DataFrame:
    return points.withColumn("xn", F.col("xd") - F.lit(shear) * F.col("z"))


def deskew_labels(labels: DataFrame, shear: float = SHEAR) -> DataFrame:
    """Nearest voxel of the native grid for each deskewed position: x' = x + shear * z, rounded."""
    return labels.withColumn("x", F.floor(F.col("x") + F.lit(shear) * F.col("z") + 0.5).cast("long"))


def deskew_raw(voxels: DataFrame, depth: int, width: int, shear: float = SHEAR, whole: bool = True) -> DataFrame:
    """Linear interpolation along x on the widened grid, rounded for ``whole`` numbers; valid where the weights of source voxels sum to more than 0.999."""
    at = F.col("x") + F.lit(shear) * F.col("z")
    lo = F.floor(at).cast("long")
    w = at - lo
    two = voxels.select("roi", "z", "y", "v", F.inline(F.array(F.struct(lo.alias("x"), (1 - w).alias("w")), F.struct((lo + 1).alias("x"), w.alias("w")))))
    wide = width + math.ceil(shear * (depth - 1))
    out = two.where((F.col("x") >= 0) & (F.col("x") < wide)).groupBy("roi", "z", "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    return out.select("roi", "z", "y", "x", (F.rint("s").cast("long") if whole else F.col("s")).alias("v"), (F.col("w") > 0.999).alias("valid"))


def halo(voxels: DataFrame, size: int, margin: int | tuple[int, int, int]) -> DataFrame:
    """Each voxel copied to every tile whose box, widened by ``margin`` (one for all axes or one each), holds it; (tz, ty, tx) is the tile's origin.

    At most 27 copies while no margin is wider than a tile.
    """
    out = voxels
    for a, m in zip("zyx", margin if isinstance(margin, tuple) else (margin,) * 3, strict=True):
        first, last = F.floor((F.col(a) - m) / size), F.floor((F.col(a) + m) / size)
        out = out.withColumn(f"t{a}", F.explode(F.sequence(first, last))).withColumn(f"t{a}", (F.col(f"t{a}") * size).cast("long"))
    return out


def halo_lines(lines: DataFrame, size: int, margin: int | tuple[int, int, int]) -> DataFrame:
    """``halo`` for lines along x (roi, z, y, xs, vs): each copied to the tiles that need some of it, with the voxels that such a tile needs; a copy may be empty."""
    mz, my, mx = margin if isinstance(margin, tuple) else (margin,) * 3
    out = lines
    for a, first, last in (("z", F.col("z") - mz, F.col("z") + mz), ("y", F.col("y") - my, F.col("y") + my), ("x", F.array_min("xs") - mx, F.array_max("xs") + mx)):
        out = out.withColumn(f"t{a}", F.explode(F.sequence(F.floor(first / size), F.floor(last / size)))).withColumn(f"t{a}", (F.col(f"t{a}") * size).cast("long"))
    near = lambda x: (x >= F.col("tx") - mx) & (x < F.col("tx") + size + mx)
    return out.withColumn("vs", F.filter("vs", lambda v, i: near(F.get("xs", i)))).withColumn("xs", F.filter("xs", near))


def owned(objects: DataFrame, size: int) -> DataFrame:
    """Objects of halo blocks (roi, tz, ty, tx, label, cz, cy, cx) kept where the centroid lies in the block's own tile; adds gid = tile ordinal * 4096 + rank."""
    inside = F.lit(True)
    for a in "zyx":
        inside = inside & (F.col(f"c{a}") >= F.col(f"t{a}")) & (F.col(f"c{a}") < F.col(f"t{a}") + size)
    kept = objects.where(inside)
    tiles = objects.select("roi", "tz", "ty", "tx").distinct()
    ordinal = numbered(tiles, "ordinal", ("tz", "ty", "tx"))
    kept = kept.join(ordinal.hint("merge"), ["roi", "tz", "ty", "tx"]).withColumn("j", F.row_number().over(Window.partitionBy("roi", "tz", "ty", "tx").orderBy("label")))
    gid = F.when(F.col("j") < 4096, F.col("ordinal").cast("long") * 4096 + F.col("j")).otherwise(F.raise_error(F.lit("4096 objects or more in a tile")).cast("long"))
    return kept.withColumn("gid", gid).drop("ordinal", "j")


def assembled(pieces: DataFrame) -> DataFrame:
    """One object for each voxel of pieces (roi, z, y, x, target, source, gid): the target's own piece first, then by source."""
    best = pieces.groupBy("roi", "z", "y", "x").agg(F.min(F.struct((F.col("source") != F.col("target")).alias("o"), "source", "gid"))["gid"].alias("gid"))
    return best
