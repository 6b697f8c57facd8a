"""Foreground masks of raw voxels, and windows over labels.  Voxels are rows (roi, z, y, x, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MAD_TO_SIGMA
from . import kernels as K
from .segment import per_tile

TILE = ["roi"]
SLICE = ["roi", "z"]


def histogram(voxels: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """(keys, v, c): how often each value stands in a slice; combined map-side, and all that percentiles and floors need."""
    return voxels.groupBy(*keys, "v").agg(F.count("*").alias("c"))


def background_floor(voxels: DataFrame, k: float, keys: list[str] = SLICE, least: int = 100) -> DataFrame:
    """(keys, floor): median + k * 1.4826 * MAD of positive values; minus infinity below ``least`` of them.  Counts ``c`` are used where given."""
    counted = voxels if "c" in voxels.columns else histogram(voxels, keys)
    positive = counted.where("v > 0")
    mid = positive.groupBy(*keys).agg(F.percentile("v", 0.5, F.col("c")).alias("mid"), F.sum("c").alias("n"))
    mad = positive.join(mid, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("v") - F.col("mid")), 0.5, F.col("c")).alias("mad"))
    level = F.when(F.col("n") < least, F.lit(float("-inf"))).otherwise(F.col("mid") + k * MAD_TO_SIGMA * F.col("mad"))
    return counted.select(*keys).distinct().join(mid, keys, "left").join(mad, keys, "left").select(*keys, F.coalesce(level, F.lit(float("-inf"))).alias("floor"), F.coalesce("n", F.lit(0)).alias("n_positive"))


def percentile_mask(voxels: DataFrame, percentile: float = 90.0, floor_k: float = 0.0, valid: str | None = None) -> DataFrame:
    """Foreground voxels: above the slice's percentile and its background floor (``background_floor``).  Flat slices have none; only ``valid`` voxels count.

    Levels are taken over windows of one slice, so voxels are made once and meet no table: where those of a roi lie in one task already, none is shuffled.
    """
    v, w = voxels.where(valid) if valid else voxels, Window.partitionBy(*SLICE)
    positive = lambda c: F.when(F.col("v") > 0, c)
    levels = {"_t": F.percentile("v", percentile / 100).over(w), "_lo": F.min("v").over(w), "_hi": F.max("v").over(w)}
    if floor_k > 0:
        levels |= {"_mid": F.percentile(positive(F.col("v")), 0.5).over(w), "_n": F.count(positive(F.lit(1))).over(w)}
    v = v.select("roi", "z", "y", "x", "v").withColumns(levels)
    level = F.col("_t")
    if floor_k > 0:
        v = v.withColumn("_mad", F.percentile(positive(F.abs(F.col("v") - F.col("_mid"))), 0.5).over(w))
        level = F.greatest(level, F.when(F.col("_n") < 100, F.lit(float("-inf"))).otherwise(F.col("_mid") + floor_k * MAD_TO_SIGMA * F.col("_mad")))
    return v.where(F.col("_lo") < F.col("_hi")).where(F.col("v") > level).select("roi", "z", "y", "x")


def otsu_threshold(voxels: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """(keys, threshold) on integer values: the value that maximises variance between the classes up to and above it."""
    h = voxels.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    up, whole = Window.partitionBy(*keys).orderBy("v"), Window.partitionBy(*keys)
    h = h.withColumns({"w0": F.sum("c").over(up), "s0": F.sum(F.col("c") * F.col("v")).over(up), "w": F.sum("c").over(whole), "s": F.sum(F.col("c") * F.col("v")).over(whole)}).where("w0 < w")
    gap = F.col("s0").cast("double") / F.col("w0") - (F.col("s") - F.col("s0")).cast("double") / (F.col("w") - F.col("w0"))
    h = h.withColumn("between", F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * gap * gap)
    return h.groupBy(*keys).agg(F.max(F.struct("between", (-F.col("v")).alias("m")))["m"].alias("m")).select(*keys, (-F.col("m")).alias("threshold"))


def otsu_mask(voxels: DataFrame, keys: list[str] = TILE) -> DataFrame:
    return voxels.join(otsu_threshold(voxels, keys).hint("shuffle_hash"), keys).where("v > threshold").select("roi", "z", "y", "x")


def above(probabilities: DataFrame, threshold: float = 0.5, value: str = "p") -> DataFrame:
    """Adds mask: 255 where the probability is above the threshold, else 0, nulls included."""
    return probabilities.withColumn("mask", F.when(F.col(value) > threshold, 255).otherwise(0))


def around(points: DataFrame, voxels: DataFrame, offs: list[tuple[int, int, int]], value: str = "v") -> DataFrame:
    """Points (roi, z, y, x, ...) with each voxel of ``voxels`` at an offset from them, as ``near`` its value: an explode of offsets and an equi-join."""
    o = F.explode(F.array(*[F.struct(*[F.lit(int(v)).alias(f"d{a}") for a, v in zip("zyx", x, strict=True)]) for x in offs]))
    rest = [c for c in points.columns if c not in ("roi", "z", "y", "x")]
    spread = points.withColumn("_o", o).select("roi", *[(F.col(a) + F.col(f"_o.d{a}")).alias(a) for a in "zyx"], *[F.col(a).alias(f"c{a}") for a in "zyx"], *rest)
    near = voxels.select("roi", "z", "y", "x", F.col(value).alias("near"))
    return spread.join(near.hint("merge"), ["roi", "z", "y", "x"]).select("roi", *[F.col(f"c{a}").alias(a) for a in "zyx"], *rest, "near")


def peaks(voxels: DataFrame, level: float, offs: list[tuple[int, int, int]]) -> DataFrame:
    """Voxels above ``level`` without a larger one in their footprint: the definition of a seed.  What is larger is above ``level`` too.

    Each candidate shows its value to the places that have it in their footprint, and a place compares its own with the largest shown: one grouping in place of joins, which shuffles nothing where the voxels of a roi lie in one task.
    """
    candidates, moved = voxels.where(F.col("v") > level), [o for o in offs if any(o)]
    o = F.explode(F.array(*[F.struct(*[F.lit(int(k)).alias(f"d{a}") for a, k in zip("zyx", x, strict=True)], F.lit(not any(x)).alias("own")) for x in [(0, 0, 0), *moved]]))
    shown = candidates.select("roi", "z", "y", "x", "v", o.alias("_o")).select("roi", *[(F.col(a) - F.col(f"_o.d{a}")).alias(a) for a in "zyx"], F.when(F.col("_o.own"), F.col("v")).alias("v"), F.when(~F.col("_o.own"), F.col("v")).alias("near"))
    seen = shown.groupBy("roi", "z", "y", "x").agg(F.max("v").alias("v"), F.max("near").alias("near"))
    return seen.where("v is not null and (near is null or near <= v)").select("roi", "z", "y", "x", "v")


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Neighbour offsets of 6-, 18- or 26-connectivity."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    r = (-1, 0, 1)
    return [(a, b, c) for a in r for b in r for c in r if 0 < abs(a) + abs(b) + abs(c) <= most]


def shifted(mask: DataFrame, offs: list[tuple[int, int, int]]) -> DataFrame:
    """Every voxel copied to each offset (one copy for each offset, not yet distinct)."""
    o = F.explode(F.array(*[F.struct(*[F.lit(int(v)).alias(f"d{a}") for a, v in zip("zyx", x, strict=True)]) for x in offs]))
    return mask.select("roi", "z", "y", "x", o.alias("o")).select("roi", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in "zyx"])


def opened(mask: DataFrame, radius: int = 1) -> DataFrame:
    """Erosion, then dilation, with the ball of a radius; 0 leaves the mask as it is.  Outside the volume is background."""
    if radius == 0:
        return mask
    r = range(-radius, radius + 1)
    ball = [(a, b, c) for a in r for b in r for c in r if a * a + b * b + c * c <= radius * radius]
    kept = shifted(mask, ball).groupBy("roi", "z", "y", "x").count().where(F.col("count") == len(ball))
    return shifted(kept, ball).distinct()


def closed(mask: DataFrame, radius: int = 1) -> DataFrame:
    """Dilation, then erosion, with the ball of a radius; 0 leaves the mask as it is.  The volume has no edges, so nothing is lost there."""
    if radius == 0:
        return mask
    r = range(-radius, radius + 1)
    ball = [(a, b, c) for a in r for b in r for c in r if a * a + b * b + c * c <= radius * radius]
    wide = shifted(mask, ball).distinct()
    return shifted(wide, ball).groupBy("roi", "z", "y", "x").count().where(F.col("count") == len(ball)).drop("count")


def z_bounds(spec: str, depth: int) -> tuple[int, int]:
    """lo and hi of lo:hi (half-open, blanks are the ends); an error unless 0 <= lo < hi <= depth."""
    lo, _, hi = spec.partition(":")
    a, b = int(lo or 0), int(hi or depth)
    if not 0 <= a < b <= depth:
        raise ValueError(f"window {spec} isn't inside 0:{depth}")
    return a, b


def z_window(labels: DataFrame, spec: str, depth: int) -> DataFrame:
    """Labels of slices lo:hi; see ``z_bounds``."""
    a, b = z_bounds(spec, depth)
    return labels.where((F.col("z") >= a) & (F.col("z") < b))


def drop_small(labels: DataFrame, least: int) -> DataFrame:
    """Voxels of objects of at least ``least`` voxels."""
    return labels.withColumn("_n", F.count("*").over(Window.partitionBy("roi", "label"))).where(F.col("_n") >= least).drop("_n")


def renumbered(labels: DataFrame, least: int = 0, keys: list[str] = TILE) -> DataFrame:
    """Objects of at least ``least`` voxels, numbered 1..n by label inside each tile; objects are not split."""
    sizes = labels.groupBy(*keys, "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ids = sizes.select(*keys, "label", F.dense_rank().over(Window.partitionBy(*keys).orderBy("label")).cast("long").alias("new_label"))
    return labels.join(ids.hint("merge"), [*keys, "label"])


def stretched(voxels: DataFrame, lo: float = 1.0, hi: float = 99.0, keys: list[str] = TILE) -> DataFrame:
    """Values scaled to [0, 1] between two percentiles, and standardised by mean and sample deviation."""
    s = voxels.groupBy(*keys).agg(F.percentile("v", lo / 100).alias("lo"), F.percentile("v", hi / 100).alias("hi"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    out = voxels.join(s.hint("shuffle_hash"), keys)
    unit = F.when(F.col("hi") > F.col("lo"), F.least(F.greatest((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return out.withColumn("unit", unit).withColumn("standard", F.when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.col("sd")))


def cropped(voxels: DataFrame, size: tuple[int, int, int], side: tuple[int, int, int], seed: int | None = None) -> DataFrame:
    """A centre crop, or a random one (an offset for each roi drawn by hash of roi and seed), in crop coordinates."""
    out = voxels
    for a, n, whole in zip("zyx", size, side, strict=True):
        start = F.lit((whole - n) // 2) if seed is None else F.pmod(F.xxhash64("roi", F.lit(a), F.lit(seed)), F.lit(whole - n + 1))
        out = out.withColumn(a, F.col(a) - start).where((F.col(a) >= 0) & (F.col(a) < n))
    return out


def strided(voxels: DataFrame, dz: int, dxy: int, tile: int = 24) -> DataFrame:
    """Every dz-th slice and dxy-th row and column of each tile, in tile coordinates."""
    return voxels.where(f"(z % {tile}) % {dz} = 0 and (y % {tile}) % {dxy} = 0 and (x % {tile}) % {dxy} = 0")


def median_filter(voxels: DataFrame, offs: list[tuple[int, int, int]], tile: int = 64, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Median over each voxel and its neighbours inside the volume; a place that no voxel holds is only seen by its neighbours and left out.

    By tile: a tile and the margin that its neighbours reach is one block, so lines of voxels are copied to tiles, not voxels to their neighbours.  Voxels come as rows or as ``tiles.lines``.
    """
    reach = tuple(max(abs(o[axis]) for o in offs) if offs else 0 for axis in range(3))
    return per_tile(voxels, lambda a, there: K.median_there(a, there, offs), "median", "double", tile=tile, margin=reach, shape=shape, with_there=True)
