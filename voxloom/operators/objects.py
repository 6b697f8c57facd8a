"""Objects of label volumes: statistics, screens, policy, scale checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MAD_TO_SIGMA
from .quantiles import exact_quantiles
from .shared import settled


def statistics(labels: DataFrame, keys: tuple[str, ...] = ("roi", "label")) -> DataFrame:
    """Area, centroid and half-open box of every object; one aggregation, combined map-side."""
    return labels.groupBy(*keys).agg(
        F.count("*").alias("area"), *[(F.sum(a) / F.count("*")).alias(f"c{a}") for a in "zyx"], *[F.min(a).alias(f"{a}0") for a in "zyx"], *[(F.max(a) + 1).alias(f"{a}1") for a in "zyx"]
    )


def touching(stats: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Adds border: the box touches a face of the tile."""
    cut = F.lit(False)
    for a, n in zip("zyx", shape, strict=True):
        cut = cut | (F.col(f"{a}0") == 0) | (F.col(f"{a}1") == n)
    return stats.withColumn("border", cut)


def volume_zscores(stats: DataFrame, expected: float, keys: tuple[str, ...] = ("roi",)) -> DataFrame:
    """z-score of areas by the tile's own mean and population deviation + 1e-6, or by expected values for two objects or fewer."""
    w = Window.partitionBy(*keys)
    many = F.count("*").over(w) > 2
    mean = F.when(many, F.avg("area").over(w)).otherwise(F.lit(float(expected)))
    sd = F.when(many, F.stddev_pop("area").over(w) + 1e-6).otherwise(F.lit(0.5 * expected))
    return stats.withColumn("volume_z", (F.col("area") - mean) / sd)


def box_bound(stats: DataFrame) -> DataFrame:
    """Adds solidity_bound: area over box volume, a lower bound of solidity that spares most hulls."""
    return stats.withColumn("solidity_bound", F.col("area") / ((F.col("z1") - F.col("z0")) * (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))))


def reasons(stats: DataFrame, expected: float, z_limit: float = 4.0, too_small: float = 0.20, too_big: float = 0.0, long_um: float = 60.0, voxel: tuple[float, float, float] = (2.0, 0.5616, 0.528), solidity: float | None = None, keys: tuple[str, ...] = ("roi",)) -> DataFrame:
    """Adds the list of reasons for doubt, in fixed order; a limit of 0 switches too_big or too_long off.  ``keys`` name the block whose objects are compared.

    With ``solidity`` (the threshold, as ``segment.solidity`` took it) the statistics carry ``solid``.
    """
    s = volume_zscores(stats, expected, keys)
    extent = F.greatest(*[(F.col(f"{a}1") - F.col(f"{a}0")) * F.lit(float(v)) for a, v in zip("zyx", voxel, strict=True)])
    found = [F.when(~F.col("solid"), "solidity")] if solidity is not None else []
    found += [F.when(F.abs("volume_z") > z_limit, "volume_zscore"), F.when(F.col("area") < too_small * expected, "too_small")]
    if too_big > 0:
        found.append(F.when(F.col("area") > too_big * expected, "too_big"))
    if long_um > 0:
        found.append(F.when(extent > long_um, "too_long"))
    return s.withColumn("reasons", F.filter(F.array(*found), lambda r: r.isNotNull()))


def accepted(screened: DataFrame, keep_big: bool = True) -> DataFrame:
    """Adds accepted: no reason, or by policy only reasons of size with a z-score above 0 where one is given."""
    r = F.col("reasons")
    only = F.size(F.array_except(r, F.array(F.lit("too_big"), F.lit("volume_zscore")))) == 0
    big = only & (~F.array_contains(r, "volume_zscore") | (F.col("volume_z") > 0))
    return screened.withColumn("accepted", (F.size(r) == 0) | (F.lit(keep_big) & big))


def scale_check(stats: DataFrame, shape: tuple[int, int, int], voxel: tuple[float, float, float], min_voxels: int = 1, least: int = 20, tolerance: float = 0.25) -> DataFrame:
    """Mean and median extents of uncut objects by axis, the ratio to y and the implied voxel size; null below ``least`` uncut objects of any size."""
    s = touching(stats, shape).where("not border")
    big = ((F.col("z1") - F.col("z0")) * (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))) >= min_voxels
    s = s.withColumns({f"{a}{k}": F.when(big, F.col(f"{a}{k}")) for a in "zyx" for k in (0, 1)})
    e = s.agg(F.count("*").alias("uncut"), F.count(F.when(big, 1)).alias("n"), *[f((F.col(f"{a}1") - F.col(f"{a}0")).cast("double")).alias(f"{m}_{a}") for a in "zyx" for m, f in (("mean", F.avg), ("median", F.median))])
    rows = e.select("n", "uncut", "median_y", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"mean_{a}").alias("mean"), F.col(f"median_{a}").alias("median"), F.lit(float(v)).alias("voxel"), F.lit(float(voxel[1])).alias("voxel_y")) for a, v in zip("zyx", voxel, strict=True)])))
    r = F.col("median") * F.col("voxel") / (F.col("median_y") * F.col("voxel_y"))
    rows = rows.withColumn("ratio", F.when(F.col("uncut") >= least, r)).withColumn("implied_voxel", F.when(F.col("uncut") >= least, F.col("median_y") * F.col("voxel_y") / F.col("median")))
    return rows.select("axis", "n", "mean", "median", "ratio", "implied_voxel", (F.abs(F.col("ratio") - 1) > tolerance).alias("doubtful"))


def residual_shear(labels: DataFrame, least: int = 200) -> DataFrame:
    """Slope of x over z in objects of at least ``least`` voxels: mean, median, standard error.

    Slopes are computed once, one for each object; their median is exact at any number of objects (``quantiles.exact_quantiles``).
    """
    o = labels.groupBy("roi", "label").agg(F.count("*").alias("n"), F.covar_pop("z", "x").alias("c"), F.var_pop("z").alias("v")).where((F.col("n") >= least) & (F.col("v") > 0))
    o = o.select("roi", "label", (F.col("c") / F.col("v")).alias("slope"))
    o = settled(o.repartition("roi", "label").select("slope"))  # a few rows left of many voxels: in as many tasks as those need
    median = exact_quantiles(o, {"slope": ("slope", 0.5)})["slope"].value
    return o.agg(F.count("*").alias("objects"), F.avg("slope").alias("mean"), F.lit(median).cast("double").alias("median"), (F.stddev_pop("slope") / F.sqrt(F.count("*"))).alias("sem"))


def descriptors(voxels: DataFrame, least: int = 1000) -> DataFrame:
    """Tile descriptors: share of zeros, median and MAD of the rest, shares above k sigmas, contrast; unusable below ``least`` non-zero voxels."""
    h, c = settled(voxels.groupBy("roi", "v").agg(F.count("*").alias("c"))), F.col("c")  # voxels are made once; all below is of how often each value stands in a roi
    part = lambda cond: F.sum(F.when(cond, c).otherwise(0)) / F.sum("c")
    zero = h.groupBy("roi").agg(part(F.col("v") == 0).alias("zero_frac"), F.sum(F.when(F.col("v") > 0, c).otherwise(0)).alias("n"))
    rest = h.where("v > 0")
    mid = rest.groupBy("roi").agg(F.percentile("v", 0.5, c).alias("median"), F.percentile("v", 0.99, c).alias("p99"))
    mid = mid.hint("shuffle_hash")  # the hashed side of each join; values are never the one that is collected
    mad = rest.join(mid, "roi").groupBy("roi").agg((F.percentile(F.abs(F.col("v") - F.col("median")), 0.5, c) * MAD_TO_SIGMA).alias("sigma")).withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1e-6))
    share = rest.join(mid, "roi").join(mad.hint("shuffle_hash"), "roi").groupBy("roi", "median", "sigma", "p99").agg(*[part(F.col("v") > F.col("median") + k * F.col("sigma")).alias(f"fg_frac_k{k}") for k in (2, 3, 5)])
    out = zero.join(share.hint("merge"), "roi", "left").withColumn("usable", F.col("n") >= least)
    return out.withColumn("contrast_p99", F.when(F.col("usable"), (F.col("p99") - F.col("median")) / F.col("sigma")))


def tile_quality(labels: DataFrame, tiles: DataFrame, expected: float, shape: tuple[int, int, int]) -> DataFrame:
    """Per-tile counts and shares of objects; measures of size are null where a tile has none.

    Where ``tiles`` has a column ``valid`` (voxels that aren't padding), counts for a million voxels are over those, the labelled share always over all; where it has ``blobs``, ratio_to_blobs is objects by blobs.
    """
    s = touching(statistics(labels), shape)
    g = s.groupBy("roi").agg(
        F.count("*").alias("n_objects"), F.sum("area").alias("labelled"), F.median("area").alias("median_volume"),
        *[F.avg(F.when(c, 1e0).otherwise(0e0)).alias(n) for n, c in (("oversized_frac", F.col("area") > 3 * expected), ("tiny_frac", F.col("area") < 0.2 * expected), ("border_frac", F.col("border")))],
    )
    voxels = float(shape[0] * shape[1] * shape[2])
    out = tiles.join(g, "roi", "left").withColumn("n_objects", F.coalesce("n_objects", F.lit(0).cast("long")))
    room = F.greatest(F.col("valid").cast("double") if "valid" in tiles.columns else F.lit(voxels), F.lit(1.0))
    if "blobs" in tiles.columns:
        out = out.withColumn("ratio_to_blobs", F.when((F.col("n_objects") > 0) & (F.col("blobs") > 0), F.col("n_objects") / F.when(F.col("blobs") > 0, F.col("blobs"))))
    return out.withColumn("per_mvox", F.col("n_objects") / (room / 1e6)).withColumn("labelled_frac", F.coalesce("labelled", F.lit(0)) / voxels).drop("labelled")
