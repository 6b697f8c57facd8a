"""Quality control of tiles: rules, robust outliers, neighbours, status, audit and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MAD_TO_SIGMA, wilson
from .quantiles import exact_quantiles
from .shared import settled

#: Rule weights in the order of reasons.
WEIGHTS = {
    "missing_output": 10, "unlike_exemplars": 5, "no_nuclei_but_signal": 5, "density_jump_vs_neighbors": 3,
    "oversized_outlier": 3, "tiny_outlier": 2, "size_shift_outlier": 2, "ratio_outlier": 2,
}
KEY = ["roi", "z", "y", "x"]


def missing(tiles: DataFrame, outputs: DataFrame) -> DataFrame:
    """Tiles without an output of their name."""
    return tiles.join(outputs.select("chunk").distinct(), "chunk", "left_anti")


def neighbour_medians(tiles: DataFrame, step: int = 128) -> DataFrame:
    """(key, n_neighbours, median_density): usable neighbours with output in the 26 directions, by an equi-join on shifted keys."""
    r = (-step, 0, step)
    offs = [(a, b, c) for a in r for b in r for c in r if (a, b, c) != (0, 0, 0)]
    o = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"d{a}") for a, v in zip("zyx", x, strict=True)]) for x in offs]))
    near = tiles.where("usable and has_output and nuclei_per_mvox is not null").select("roi", *KEY[1:], "nuclei_per_mvox", o.alias("o"))
    near = near.select("roi", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in "zyx"], "nuclei_per_mvox")
    return near.groupBy(*KEY).agg(F.count("*").alias("n_neighbours"), F.median("nuclei_per_mvox").alias("median_density"))


def density_jumps(tiles: DataFrame, step: int = 128) -> DataFrame:
    """Adds n_neighbours and density_jump: far above or below the median of at least three neighbours."""
    t = tiles.join(neighbour_medians(tiles, step), KEY, "left").withColumn("n_neighbours", F.coalesce("n_neighbours", F.lit(0).cast("long")))
    m, mine = F.col("median_density"), F.col("nuclei_per_mvox")
    jump = (F.greatest(m, mine) >= 2) & ((mine > 3 * F.greatest(m, F.lit(0.5))) | (mine < m / 3))
    return t.withColumn("density_jump", F.coalesce(F.col("usable") & F.col("has_output") & (F.col("n_neighbours") >= 3) & jump, F.lit(False)))


OUTLIERS = (("oversized_frac", "oversized_outlier", 0.05, False, False), ("tiny_frac", "tiny_outlier", 0.05, False, False), ("median_vol_vox", "size_shift_outlier", 0.15, True, True), ("ratio_to_blobs", "ratio_outlier", 0.3, False, True))


def robust_scores(tiles: DataFrame, measures: tuple[tuple[str, float, bool], ...], least: int = 8) -> DataFrame:
    """Adds robust_<column> for (column, floor, log): (x - median) / max(1.4826 MAD, floor) over all non-null rows; null below ``least`` of them.

    Medians are exact at any number of tiles (``quantiles.exact_quantiles``); they are a few numbers, put into the plan as literals.
    """
    logged = {c: F.log(F.greatest(F.col(c), F.lit(1e-9))) if log else F.col(c).cast("double") for c, _, log in measures}
    shifted = tiles.withColumns({f"_x_{c}": v for c, v in logged.items()})
    mid = exact_quantiles(shifted, {c: (f"_x_{c}", 0.5) for c in logged})
    mad = exact_quantiles(shifted.withColumns({f"_d_{c}": F.abs(F.col(f"_x_{c}") - F.lit(m.value)) for c, m in mid.items()}), {c: (f"_d_{c}", 0.5) for c in logged})
    scores = {f"robust_{c}": (F.col(f"_x_{c}") - F.lit(mid[c].value)) / F.lit(max(MAD_TO_SIGMA * (mad[c].value or 0.0), floor)) if mid[c].rows >= least else F.lit(None).cast("double") for c, floor, _ in measures}
    return shifted.withColumns(scores).drop(*[f"_x_{c}" for c in logged])


def outlier_flags(tiles: DataFrame, limit: float = 4.0) -> DataFrame:
    """Adds a flag for each of the four robust measures, of usable tiles with output only."""
    t = robust_scores(tiles, tuple((c, floor, log) for c, _, floor, log, _ in OUTLIERS))
    flag = {f: F.coalesce(F.col("usable") & F.col("has_output") & ((F.abs(f"robust_{c}") if both else F.col(f"robust_{c}")) > limit), F.lit(False)) for c, f, _, _, both in OUTLIERS}
    return t.withColumns(flag)


def edges(tiles: DataFrame) -> DataFrame:
    """Adds edge_axes: on how many of y and x the tile is at its roi's end."""
    w = Window.partitionBy("roi")
    at = lambda a: ((F.col(a) == F.min(a).over(w)) | (F.col(a) == F.max(a).over(w))).cast("int")
    return tiles.withColumn("edge_axes", at("y") + at("x")).withColumn("is_edge", F.col("edge_axes") > 0)


def signal_rules(unlike: float = 0.75) -> dict[str, Column]:
    """Usable tiles farther than ``unlike`` from every exemplar, and those with output but no nuclei where there is signal; false where a measurement lacks."""
    rules = {
        "unlike_exemplars": F.col("usable") & (F.col("exemplar_distance") > unlike),
        "no_nuclei_but_signal": F.col("usable") & F.col("has_output") & (F.col("n_nuclei") == 0) & (F.col("contrast_p99") > 3),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def assessed(tiles: DataFrame, step: int = 128, unlike: float = 0.75) -> DataFrame:
    """The whole rule chain: flags, priority, reasons joined by ';' and status.

    Measurements are computed once and written, since several rules aggregate them.
    """
    t = outlier_flags(density_jumps(edges(settled(tiles)), step))
    rules: dict[str, Column] = {"missing_output": ~F.col("has_output")} | signal_rules(unlike) | {"density_jump_vs_neighbors": F.col("density_jump")} | {flag: F.col(flag) for _, flag, *_ in OUTLIERS}
    sure = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    t = t.withColumn("priority", sum((F.when(v, WEIGHTS[k]).otherwise(0) for k, v in sure.items()), F.lit(0)))
    t = t.withColumn("_r", F.filter(F.array(*[F.when(v, k) for k, v in sure.items()]), lambda r: r.isNotNull())).withColumn("reasons", F.array_join("_r", ";"))
    status = F.when(~F.col("has_output"), "MISSING").when(~F.col("usable"), "PADDING").when((F.col("priority") >= 5) | (F.size("_r") >= 2), "REVIEW").when(F.size("_r") == 1, "WATCH").otherwise("OK")
    return settled(t.withColumn("status", status).drop("_r"))


def review_list(t: DataFrame) -> DataFrame:
    return t.where(F.col("status").isin("REVIEW", "MISSING", "WATCH")).orderBy(F.desc("priority"), "chunk")


def timings(seconds: DataFrame, keys: tuple[str, ...] = ("roi",)) -> DataFrame:
    """(keys, n, upper_median, slowest, mean) of seconds by tile; the order statistic comes from a histogram, so no list is gathered."""
    h = seconds.groupBy(*keys, "seconds").agg(F.count("*").alias("c"))
    h = h.withColumns({"upto": F.sum("c").over(Window.partitionBy(*keys).orderBy("seconds")), "n": F.sum("c").over(Window.partitionBy(*keys))})
    upper = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("seconds")))
    return h.groupBy(*keys).agg(F.max("n").alias("n"), upper.alias("upper_median"), F.max("seconds").alias("slowest"), (F.sum(F.col("seconds") * F.col("c")) / F.max("n")).alias("mean"))


#: Statuses in the order of the summary.
STATUSES = ("OK", "WATCH", "REVIEW", "MISSING", "PADDING")


def summary(t: DataFrame, picks: DataFrame | None = None, judged: DataFrame | None = None, timings: DataFrame | None = None) -> DataFrame:
    """(section, place, name, value): tiles by status in fixed order without zeros, reasons by falling count, and totals.

    The median density is that of usable tiles with output.  ``picks``, the result of ``audit_result`` and a table of seconds by tile add their own numbers.
    """
    by = t.groupBy("status").agg(F.count("*").cast("double").alias("value"))
    place = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")).cast("int")
    by = by.select(F.lit("status").alias("section"), place.alias("place"), F.col("status").alias("name"), "value")
    why = t.where("reasons <> ''").select(F.explode(F.split("reasons", ";")).alias("name")).groupBy("name").agg(F.count("*").cast("double").alias("value"))
    # At most one row for each rule, so one window may order them.
    why = why.select(F.lit("reason").alias("section"), F.row_number().over(Window.orderBy(F.desc("value"), "name")).alias("place"), "name", "value")
    one = t.agg(
        F.count("*").alias("n_chunks"), F.sum(F.col("has_output").cast("int")).alias("n_with_output"), F.avg(F.col("has_output").cast("double")).alias("coverage"),
        F.sum(F.col("status").isin("REVIEW", "MISSING", "WATCH").cast("int")).alias("n_flagged"), F.coalesce(F.sum("n_nuclei"), F.lit(0)).alias("n_nuclei_total"),
        F.sum(F.array_contains(F.split("reasons", ";"), "unlike_exemplars").cast("int")).alias("n_unlike"),
    )
    density = exact_quantiles(t.where("usable and has_output"), {"d": ("nuclei_per_mvox", 0.5)})["d"].value
    one = one.withColumn("median_nuclei_per_mvox", F.lit(density).cast("double"))
    if picks is not None:
        one = one.join(picks.agg(F.count(F.when(F.col("why") == EDGE, 1)).alias("n_edge_images"), F.count(F.when(F.col("why").startswith(FLAGGED), 1)).alias("n_main_flagged")))
    out = by.unionByName(why).unionByName(_long(one, "total"))
    if judged is not None:
        out = out.unionByName(_long(judged, "audit"))
    if timings is not None:
        out = out.unionByName(_long(timings.agg(F.count("*").alias("chunks"), F.median("seconds").alias("median_s")), "timing"))
    return out


def _long(row: DataFrame, section: str) -> DataFrame:
    """The columns of a one-row table as (section, place, name, value)."""
    cells = [F.struct(F.lit(section).alias("section"), F.lit(k).alias("place"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for k, c in enumerate(row.columns, 1)]
    return row.select(F.inline(F.array(*cells)))


def audit_size(pool: int, least: int, share: float) -> int:
    return min(pool, max(least, -(-int(round(share * pool * 1e9)) // 10**9)))


def audit_sample(t: DataFrame, existing: DataFrame | None = None, least: int = 10, share: float = 0.015, seed: int = 0) -> DataFrame:
    """A sample of usable tiles with output, in order of their keys; an existing sheet is never overwritten."""
    if existing is not None:
        return existing
    pool = t.where("usable and has_output")
    n = audit_size(pool.count(), least, share)
    drawn = pool.orderBy(F.xxhash64("chunk", F.lit(seed)), "chunk").limit(n)
    return drawn.select("chunk", *KEY, "status", "reasons", *[F.lit("").alias(c) for c in ("verdict", "reviewer", "notes")]).orderBy(*KEY)


def audit_result(sheet: DataFrame) -> DataFrame:
    """(judged, of, ok, minor, major, ok_frac, low, high): tiles by verdict, and the share that is ok with its interval; no row where none is judged."""
    v = sheet.withColumn("v", F.lower(F.trim("verdict")))
    g = v.agg(F.count(F.when(F.col("v").isin("ok", "minor", "major"), 1)).alias("judged"), F.count("*").alias("of"), *[F.count(F.when(F.col("v") == x, 1)).alias(x) for x in ("ok", "minor", "major")]).where("judged > 0")
    lo, hi = wilson(F.col("ok"), F.col("judged"))
    return g.select("judged", "of", "ok", "minor", "major", (F.col("ok") / F.col("judged")).alias("ok_frac"), lo.alias("low"), hi.alias("high"))


#: Why a tile is drawn.
EDGE, INTERIOR, FLAGGED, DENSEST, SPARSEST = "edge of volume", "random interior", "flagged: ", "densest chunk", "sparsest chunk with nuclei"


def _drawn(salt: int):
    """A random order that any engine can repeat."""
    return F.struct(F.md5(F.concat("chunk", F.lit(str(salt)))).alias("draw"), F.col("chunk").alias("chunk"))


def _flagged(t: DataFrame) -> DataFrame:
    return t.where("status in ('REVIEW', 'MISSING') and has_output").select("chunk", "priority", F.concat(F.lit(FLAGGED), F.regexp_replace("reasons", ";", ", ")).alias("why"))


def main_picks(t: DataFrame, n_edge: int = 3, n_interior: int = 3, n_flagged: int = 2, seed: int = 0) -> DataFrame:
    """(chunk, why) of the tiles to draw; each once, the first reason stays.

    Of usable tiles with nuclei: one corner at random, then edge tiles in random order, those of rois not seen yet first and others only once every roi was seen, ``n_edge``
    in all; interior tiles at random; of all tiles with output the flagged ones of highest priority.
    """
    good = t.where("usable and has_output and n_nuclei > 0").select("chunk", "roi", "edge_axes")
    edge = good.where("edge_axes > 0")
    corner = edge.where("edge_axes >= 2").select("chunk", "roi", _drawn(seed)["draw"].alias("_at")).orderBy("_at", "chunk").limit(1).select("chunk", "roi")
    rest = edge.join(F.broadcast(corner.select("chunk")), "chunk", "left_anti").withColumn("_at", _drawn(seed + 1))
    rest = rest.join(F.broadcast(corner.select("roi", F.lit(True).alias("_seen"))), "roi", "left")
    first = rest.where("_seen is null").groupBy("roi").agg(F.min("_at").alias("_first"))
    # A roi whose first tile comes last in the order: once it is seen, all are.
    last = first.agg(F.max("_first").alias("_all"))
    rest = rest.join(first, "roi", "left").join(F.broadcast(last))
    rest = rest.where((F.col("_at") == F.col("_first")) | F.col("_all").isNull() | (F.col("_at") > F.col("_all")))
    order = corner.select("chunk", F.lit(0).alias("_turn"), F.lit("").alias("_draw")).unionByName(rest.select("chunk", F.lit(1).alias("_turn"), F.col("_at.draw").alias("_draw")))
    edges_ = order.orderBy("_turn", "_draw", "chunk").limit(n_edge).select("chunk", F.lit(0).alias("rank"), F.lit(EDGE).alias("why"))
    inner = good.where("edge_axes = 0").withColumn("_at", _drawn(seed + 2)).orderBy("_at").limit(n_interior).select("chunk", F.lit(1).alias("rank"), F.lit(INTERIOR).alias("why"))
    flagged = _flagged(t).orderBy(F.desc("priority"), "chunk").limit(n_flagged).select("chunk", F.lit(2).alias("rank"), "why")
    every = edges_.unionByName(inner).unionByName(flagged)
    return every.groupBy("chunk").agg(F.min(F.struct("rank", "why"))["why"].alias("why"))


def detail_picks(t: DataFrame, picked: DataFrame, most: int = 150) -> DataFrame:
    """(chunk, why): flagged tiles that weren't drawn yet, ``most`` of the highest priority, then the densest and the sparsest tile with nuclei of all, where they weren't drawn either."""
    names = F.broadcast(picked.select("chunk"))  # a few picks
    flagged = _flagged(t.where("status = 'REVIEW'")).join(names, "chunk", "left_anti").orderBy(F.desc("priority"), "chunk").limit(most).select("chunk", F.lit(0).alias("rank"), "why")
    full = t.where("usable and has_output and n_nuclei > 0")
    ends = [full.orderBy(o, "chunk").limit(1).select("chunk", F.lit(k).alias("rank"), F.lit(w).alias("why")) for k, (o, w) in enumerate(((F.desc("nuclei_per_mvox"), DENSEST), (F.asc("nuclei_per_mvox"), SPARSEST)), 1)]
    every = flagged.unionByName(ends[0].unionByName(ends[1]).join(names, "chunk", "left_anti"))
    return every.groupBy("chunk").agg(F.min(F.struct("rank", "why"))["why"].alias("why"))
