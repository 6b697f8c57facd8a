"""Named queries on tile measurements, exemplars, grids and pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import wilson
from ..operators import graph, objects, predict, project, qc, tune
from ..sources import fixtures as X
from ..sources import tiles as tiles_
from .queries import _T, TILE, query

_NEAR = (
    "o as (select dz, dy, dx from (values (-128),(0),(128)) a(dz), (values (-128),(0),(128)) b(dy), (values (-128),(0),(128)) c(dx) where not (dz = 0 and dy = 0 and dx = 0)), "
    "nb as (select roi, z + dz as z, y + dy as y, x + dx as x, count(*) as n_neighbours, median(nuclei_per_mvox) as med from qc, o where usable and has_output and nuclei_per_mvox is not null group by 1, 2, 3, 4), "
    "dj as (select qc.*, coalesce(n_neighbours, 0) as n_neighbours, med, coalesce(usable and has_output and n_neighbours >= 3 and greatest(med, nuclei_per_mvox) >= 2 and (nuclei_per_mvox > 3 * greatest(med, 0.5) or nuclei_per_mvox < med / 3), false) as density_jump from qc left join nb using (roi, z, y, x))"
)


def _robust(col: str, flag: str, floor: str, expr: str, test: str, src: str) -> str:
    return (
        f"{flag}_m as (select median({expr}) as mid, count({expr}) as n from qc), {flag}_d as (select median(abs({expr} - mid)) as mad from qc, {flag}_m), "
        f"{flag}_t as (select s.*, case when n >= 8 then ({expr} - mid) / greatest(1.4826 * mad, {floor}) end as r_{flag}, coalesce(usable and has_output and n >= 8 and {test.format(s=f'(({expr} - mid) / greatest(1.4826 * mad, {floor}))')}, false) as {flag} from {src} s, {flag}_m, {flag}_d)"
    )


_ALL = ", ".join(
    [
        _NEAR,
        _robust("oversized_frac", "oversized_outlier", "0.05", "oversized_frac", "{s} > 4", "dj"),
        _robust("tiny_frac", "tiny_outlier", "0.05", "tiny_frac", "{s} > 4", "oversized_outlier_t"),
        _robust("median_vol_vox", "size_shift_outlier", "0.15", "ln(greatest(median_vol_vox, 1e-9))", "abs({s}) > 4", "tiny_outlier_t"),
        _robust("ratio_to_blobs", "ratio_outlier", "0.3", "ratio_to_blobs", "abs({s}) > 4", "size_shift_outlier_t"),
        "ru as (select *, ((y = min(y) over (partition by roi) or y = max(y) over (partition by roi))::int + (x = min(x) over (partition by roi) or x = max(x) over (partition by roi))::int) as edge_axes, not has_output as f0, coalesce(usable and exemplar_distance > 0.75, false) as f1, coalesce(usable and has_output and n_nuclei = 0 and contrast_p99 > 3, false) as f2 from ratio_outlier_t)",
        "pq as (select *, (f0::int * 10 + f1::int * 5 + f2::int * 5 + density_jump::int * 3 + oversized_outlier::int * 3 + tiny_outlier::int * 2 + size_shift_outlier::int * 2 + ratio_outlier::int * 2) as priority, "
        "concat_ws(';', case when f0 then 'missing_output' end, case when f1 then 'unlike_exemplars' end, case when f2 then 'no_nuclei_but_signal' end, case when density_jump then 'density_jump_vs_neighbors' end, case when oversized_outlier then 'oversized_outlier' end, case when tiny_outlier then 'tiny_outlier' end, case when size_shift_outlier then 'size_shift_outlier' end, case when ratio_outlier then 'ratio_outlier' end) as reasons, "
        "(f0::int + f1::int + f2::int + density_jump::int + oversized_outlier::int + tiny_outlier::int + size_shift_outlier::int + ratio_outlier::int) as n_reasons from ru)",
        "ass as (select *, case when not has_output then 'MISSING' when not usable then 'PADDING' when priority >= 5 or n_reasons >= 2 then 'REVIEW' when n_reasons = 1 then 'WATCH' else 'OK' end as status from pq)",
    ]
)


@query("select chunk from qc where not has_output", ("qc",))
def qc_missing(spark, sf):
    t = X.tile_measures(spark, sf)
    return qc.missing(t, t.where("has_output")).select("chunk")


@query("select chunk, usable and exemplar_distance > 0.75 as unlike_exemplars, coalesce(usable and has_output and n_nuclei = 0 and contrast_p99 > 3, false) as no_nuclei_but_signal from qc", ("qc",))
def qc_signal_rules(spark, sf):
    return X.tile_measures(spark, sf).select("chunk", *[c.alias(n) for n, c in qc.signal_rules().items()])


@query("with " + _NEAR + " select chunk, n_neighbours, density_jump from dj", ("qc",))
def qc_neighbour_density(spark, sf):
    return qc.density_jumps(X.tile_measures(spark, sf)).select("chunk", "n_neighbours", "density_jump")


@query("with " + _ALL + " select chunk, round(r_oversized_outlier, 5) + 0.0 as oversized, round(r_tiny_outlier, 5) + 0.0 as tiny, round(r_size_shift_outlier, 5) + 0.0 as size, round(r_ratio_outlier, 5) + 0.0 as ratio, oversized_outlier, tiny_outlier, size_shift_outlier, ratio_outlier from ass", ("qc",))
def qc_robust_outliers(spark, sf):
    t = qc.outlier_flags(X.tile_measures(spark, sf))
    names = {"oversized": "oversized_frac", "tiny": "tiny_frac", "size": "median_vol_vox", "ratio": "ratio_to_blobs"}
    return t.select("chunk", *[(F.round(f"robust_{c}", 5) + F.lit(0.0)).alias(n) for n, c in names.items()], "oversized_outlier", "tiny_outlier", "size_shift_outlier", "ratio_outlier")


@query("with " + _ALL + " select chunk, edge_axes, edge_axes > 0 as is_edge from ass", ("qc",))
def qc_edges(spark, sf):
    return qc.edges(X.tile_measures(spark, sf)).select("chunk", "edge_axes", "is_edge")


def _assessed(spark, sf):
    return qc.assessed(X.tile_measures(spark, sf))


@query("with " + _ALL + " select chunk, priority, reasons, status from ass", ("qc",))
def qc_status(spark, sf):
    return _assessed(spark, sf).select("chunk", "priority", "reasons", "status")


@query("with " + _ALL + " select chunk, priority, status from ass where status in ('REVIEW', 'MISSING', 'WATCH') order by priority desc, chunk", ("qc",))
def qc_review_list(spark, sf):
    return qc.review_list(_assessed(spark, sf)).select("chunk", "priority", "status")


_VERDICTS = "vd as (select case when toxic = 1 then 'major' when quality = 0 then 'minor' else ' OK ' end as verdict from labels), au as (select lower(trim(verdict)) as v from vd)"
_WILSON = "greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)) as low, least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)) as high"
_JUDGED = _VERDICTS + (
    ", jc as (select count(*) filter (v in ('ok', 'minor', 'major')) as judged, count(*) as of, count(*) filter (v = 'ok') as ok, count(*) filter (v = 'minor') as minor, count(*) filter (v = 'major') as major from au), "
    "jd as (select *, ok / judged::double as p, judged::double as n from jc where judged > 0), jw as (select judged, of, ok, minor, major, p as ok_frac, " + _WILSON + " from jd)"
)

# Edge tiles in the order they are drawn, with the rois seen before each; a tile is taken when its roi is new or when all rois were seen.
_PICKS = (
    ", ok as (select * from ass where usable and has_output and n_nuclei > 0), eg as (select chunk, roi, edge_axes from ok where edge_axes > 0), "
    "co as (select chunk, roi from eg where edge_axes >= 2 order by md5(chunk || '0'), chunk limit 1), "
    "rs as (select chunk, roi, row_number() over (order by md5(chunk || '1'), chunk) as pos from eg where chunk not in (select chunk from co)), "
    "sn as (select a.chunk, a.pos, count(*) filter (b.roi = a.roi) + (select count(*) from co where co.roi = a.roi) as own, "
    "count(distinct case when b.roi not in (select roi from co) then b.roi end) + (select count(*) from co) as seen from rs a left join rs b on b.pos < a.pos group by a.chunk, a.pos, a.roi), "
    "ed as (select chunk from (select chunk, 0 as pos from co union all select chunk, pos from sn where own = 0 or seen >= (select count(distinct roi) from eg)) order by pos limit 3), "
    "pk as (select chunk, 0 as rank, 'edge of volume' as why from ed union all select * from (select chunk, 1, 'random interior' from ok where edge_axes = 0 order by md5(chunk || '2'), chunk limit 3) "
    "union all select * from (select chunk, 2, 'flagged: ' || replace(reasons, ';', ', ') from ass where status in ('REVIEW', 'MISSING') and has_output order by priority desc, chunk limit 2)), "
    "mp as (select chunk, why from pk qualify row_number() over (partition by chunk order by rank) = 1)"
)


@query("with " + _ALL + _PICKS + ", " + _JUDGED + ", rc as (select r, count(*)::double as c from (select unnest(string_split(reasons, ';')) as r from ass where reasons <> '') group by r), "
       "tt as (select count(*) as n_chunks, count(*) filter (has_output) as n_with_output, count(*) filter (has_output) / count(*) as coverage, count(*) filter (status in ('REVIEW', 'MISSING', 'WATCH')) as n_flagged, coalesce(sum(n_nuclei), 0) as n_nuclei_total, "
       "count(*) filter (contains(reasons, 'unlike_exemplars')) as n_unlike, median(nuclei_per_mvox) filter (usable and has_output) as median_nuclei_per_mvox from ass), "
       "pc as (select count(*) filter (why = 'edge of volume') as n_edge_images, count(*) filter (why like 'flagged%') as n_main_flagged from mp), "
       "tm as (select count(*) as chunks, median(value) as median_s from events), "
       "lg as (select 'status' as section, list_position(['OK', 'WATCH', 'REVIEW', 'MISSING', 'PADDING'], status) as place, status as name, count(*)::double as value from ass group by status "
       "union all select 'reason', row_number() over (order by c desc, r), r, c from rc "
       "union all select 'total', k, n, v from (select unnest(range(1, 10)) as k, unnest(['n_chunks', 'n_with_output', 'coverage', 'n_flagged', 'n_nuclei_total', 'n_unlike', 'median_nuclei_per_mvox', 'n_edge_images', 'n_main_flagged']) as n, "
       "unnest([n_chunks::double, n_with_output, coverage, n_flagged, n_nuclei_total, n_unlike, median_nuclei_per_mvox, n_edge_images, n_main_flagged]) as v from tt, pc) "
       "union all select 'audit', k, n, v from (select unnest(range(1, 9)) as k, unnest(['judged', 'of', 'ok', 'minor', 'major', 'ok_frac', 'low', 'high']) as n, unnest([judged::double, of, ok, minor, major, ok_frac, low, high]) as v from jw) "
       "union all select 'timing', k, n, v from (select unnest([1, 2]) as k, unnest(['chunks', 'median_s']) as n, unnest([chunks::double, median_s]) as v from tm)) "
       "select section, place::int as place, name, round(value, 6) as value from lg", ("qc",))
def qc_summary(spark, sf):
    t = _assessed(spark, sf)
    timings = X.table(spark, sf, "events").select(F.col("value").alias("seconds"))
    return qc.summary(t, qc.main_picks(t), qc.audit_result(_sheet(spark, sf)), timings).withColumn("value", F.round("value", 6))


@query("with " + _ALL + " select count(*) as pool, least(count(*), greatest(20, ceil(0.05 * count(*))))::bigint as n from ass where usable and has_output", ("qc",))
def audit_size(spark, sf):
    t = _assessed(spark, sf)
    s = qc.audit_sample(t, least=20, share=0.05)
    return t.where("usable and has_output").agg(F.count("*").alias("pool")).join(s.agg(F.count("*").alias("n")))


def _sheet(spark, sf):
    return X.table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "major").when(F.col("quality") == 0, "minor").otherwise(" OK ").alias("verdict"))


@query("with " + _JUDGED + " select judged, of, ok, minor, major, round(ok_frac, 6) as ok_frac, round(low, 6) as low, round(high, 6) as high from jw")
def audit_result(spark, sf):
    return qc.audit_result(_sheet(spark, sf)).withColumns({c: F.round(c, 6) for c in ("ok_frac", "low", "high")})


@query("with c as (select r_regionkey as k, r_regionkey * 3 as hits, r_regionkey * 4::double as n0 from region), d as (select k, case when n0 > 0 then hits / n0 end as p, case when n0 > 0 then n0 end as n from c), w as (select k, p, " + _WILSON + " from d) select k, case when p is not null then round(low, 6) end as low, case when p is not null then round(high, 6) end as high from w")
def audit_wilson(spark, sf):
    r = X.table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), (F.col("r_regionkey") * 3).alias("hits"), (F.col("r_regionkey") * 4).alias("n"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    ok = F.col("n") > 0
    return r.select("k", F.when(ok, F.round(lo, 6)).alias("low"), F.when(ok, F.round(hi, 6)).alias("high"))


@query("with " + _ALL + _PICKS + " select chunk, why from mp", ("qc",))
def qc_picks(spark, sf):
    return qc.main_picks(_assessed(spark, sf))


@query("with " + _ALL + _PICKS + ", fl as (select * from (select chunk, 0 as rank, 'flagged: ' || replace(reasons, ';', ', ') as why from ass where status = 'REVIEW' and has_output and chunk not in (select chunk from mp) order by priority desc, chunk limit 150)), "
       "dn as (select chunk, 1 as rank, 'densest chunk' as why from ok order by nuclei_per_mvox desc, chunk limit 1), sp as (select chunk, 2 as rank, 'sparsest chunk with nuclei' as why from ok order by nuclei_per_mvox, chunk limit 1), "
       "un as (select * from fl union all select * from dn where chunk not in (select chunk from mp) union all select * from sp where chunk not in (select chunk from mp)) "
       "select chunk, why from un qualify row_number() over (partition by chunk order by rank) = 1", ("qc",))
def qc_detail_picks(spark, sf):
    t = _assessed(spark, sf)
    return qc.detail_picks(t, qc.main_picks(t))


# --- parameters ------------------------------------------------------------------------------------

_LN = "ln(greatest({}, 1e-6))"
_DIST = "sqrt(" + " + ".join(f"power({_LN.format('a.' + d)} - {_LN.format('b.' + d)}, 2)" for d in ("d0", "d1", "d2")) + ")"
_NE = f"ne as (select a.vec_id, b.vec_id as nearest, {_DIST} as distance from qu a, ex b qualify row_number() over (partition by a.vec_id order by {_DIST}, b.vec_id) = 1)"
KEYS = ["d0", "d1", "d2"]


@query("with " + _NE + " select vec_id, nearest, round(distance, 6) as distance, distance <= 0.75 as matched from ne", ("ex",))
def nearest_exemplar(spark, sf):
    ex, qu = X.exemplars(spark, sf)
    return tune.nearest_exemplar(qu, ex, KEYS).withColumn("distance", F.round("distance", 6))


@query("with " + _NE + ", u as (select vec_id, vec_id % 11 <> 0 as usable from qu), c as (select u.vec_id, case when usable then nearest end as nearest, case when usable then round(distance, 6) end as distance, case when usable and distance <= 0.75 then 'exemplar:' || nearest else 'global-default' end as source, "
       "case when not usable then 'chunk mostly zero padding' when distance <= 0.75 then 'within match distance' else 'nearest example too far away' end as reason from u join ne using (vec_id)) select * from c", ("ex",))
def config_choice(spark, sf):
    """Which settings each tile gets, and why."""
    ex, qu = X.exemplars(spark, sf)
    return tune.chosen(qu.withColumn("usable", F.col("vec_id") % 11 != 0), ex, KEYS, id_col="vec_id", name="vec_id").withColumn("distance", F.round("distance", 6))


@query("with " + _NE + " select case when vec_id % 11 <> 0 and distance <= 0.75 then 'exemplar:' || nearest else 'global-default' end as source, count(*) as n from ne group by 1", ("ex",))
def config_source_tally(spark, sf):
    ex, qu = X.exemplars(spark, sf)
    return tune.source_tally(tune.chosen(qu.withColumn("usable", F.col("vec_id") % 11 != 0), ex, KEYS, id_col="vec_id", name="vec_id"))


@query("select label as name, coalesce(case when label % 2 = 0 then 94e0 end, 90e0) as percentile, coalesce(case when label % 3 = 0 then 17 end, 12)::int as min_seed_distance, case when label % 4 = 0 then '2:8' end as mask_bandpass_um from ex", ("ex",))
def override_merge(spark, sf):
    ex, _ = X.exemplars(spark, sf)
    o = ex.select(F.col("label").alias("name"), F.expr("case when label % 2 = 0 then 94e0 end").alias("percentile"), F.expr("case when label % 3 = 0 then 17 end").alias("min_seed_distance"), F.expr("case when label % 4 = 0 then '2:8' end").alias("mask_bandpass_um"))
    return tune.merged_overrides({"percentile": 90.0, "min_seed_distance": 12, "mask_bandpass_um": "off"}, o)


@query("with old as (select 'e' || label as name, round(d0, 6) as d0 from ex), new as (select 'e' || (label + 5) as name, round(d1, 6) as d0, label % 3 <> 0 as usable from ex), good as (select name, d0 from new where usable) select * from old where name not in (select name from good) union all select * from good", ("ex",))
def exemplar_upsert(spark, sf):
    ex, _ = X.exemplars(spark, sf)
    old = ex.select(F.concat(F.lit("e"), F.col("label").cast("string")).alias("name"), F.round("d0", 6).alias("d0"))
    new = ex.select(F.concat(F.lit("e"), (F.col("label") + 5).cast("string")).alias("name"), F.round("d1", 6).alias("d0"), (F.col("label") % 3 != 0).alias("usable"))
    return tune.registered(old, new)


_GRID = (
    "g as (select (pi * 12 + si * 6 + mi * 3 + bi)::bigint as setting from (values (0), (1)) p(pi), (values (0), (1)) s(si), (values (0), (1)) m(mi), (values (0), (1), (2)) b(bi)), "
    "it as (select r_regionkey::bigint as item from region), gs as (select item, setting, round(0.5 + ((item * 31 + setting * 17) % 23) / 100e0, 2) as f1, round(0.4 + ((item * 13 + setting * 7) % 11) / 100e0, 2) as iou, (item * 5 + setting * 3) % 19 as fp, (item * 3 + setting * 5) % 7 as matched from it, g)"
)


def _grid(spark, sf):
    """Scores of 24 settings for five items: rounded functions of integers, so that ties exist."""
    import itertools

    settings = [(p * 12 + s * 6 + m * 3 + b,) for p, s, m, b in itertools.product(range(2), range(2), range(2), range(3))]
    g = spark.createDataFrame(settings, "setting long")
    it = X.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("item"))
    d = it.join(F.broadcast(g))
    return d.withColumns({"f1": F.expr("round(5e-1 + ((item * 31 + setting * 17) % 23) / 100e0, 2)"), "iou": F.expr("round(4e-1 + ((item * 13 + setting * 7) % 11) / 100e0, 2)"), "fp": F.expr("(item * 5 + setting * 3) % 19"), "matched": F.expr("(item * 3 + setting * 5) % 7")})


@query("with " + _GRID + ", a as (select setting, round(avg(f1), 6) as f1, round(avg(iou), 6) as iou, sum(fp)::bigint as fp from gs group by setting), b as (select *, f1 >= (select max(f1) from a) - 0.01 as near from a) select setting, f1, iou, fp, near, (select count(*) from b where near) as flatness from b order by f1 desc, iou desc, setting limit 10")
def tune_rank(spark, sf):
    a = _grid(spark, sf).groupBy("setting").agg(F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("iou"), 6).alias("iou"), F.sum("fp").alias("fp"))
    return tune.ranked(a)


@query("with " + _GRID + ", a as (select setting, round(avg(f1), 6) as f1, round(avg(iou), 6) as iou, sum(fp)::bigint as fp from gs group by setting) select setting, f1, iou, fp from a where f1 >= (select max(f1) from a) - 0.01 order by fp, f1 desc, setting limit 1")
def tune_conservative(spark, sf):
    a = _grid(spark, sf).groupBy("setting").agg(F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("iou"), 6).alias("iou"), F.sum("fp").alias("fp"))
    return tune.conservative(a)


@query(
    "with " + _GRID + ", nn as (select item, (item + 2) % 5 as other from it where item <> 3), bs as (select item, setting as best_setting, f1 as oracle from gs where setting <> 4 qualify row_number() over (partition by item order by f1 desc, matched desc, setting) = 1), gl as (select item, f1 as global from gs where setting = 4), "
    "di as (select nn.item, gs.f1 as dispatched from nn join bs on bs.item = nn.other join gs on gs.item = nn.item and gs.setting = bs.best_setting), "
    "sh as (select a.item, round(avg(gs.f1), 6) as shuffled from bs a join bs b on a.item <> b.item join gs on gs.item = a.item and gs.setting = b.best_setting group by a.item) "
    "select bs.item, global, oracle, coalesce(dispatched, global) as dispatch, shuffled, dispatched is not null as matched, case when oracle - global > 1e-9 then round((coalesce(dispatched, global) - global) / (oracle - global), 6) end as gap_closed from bs join gl using (item) left join di using (item) left join sh using (item)"
)
def dispatch_loo(spark, sf):
    g = _grid(spark, sf)
    near = g.select("item").distinct().where("item <> 3").withColumn("other", (F.col("item") + 2) % 5)
    return tune.dispatch(g, near, 4).withColumns({c: F.round(c, 6) for c in ("gap_closed", "shuffled")})


@query("with " + _GRID + " select a.item, a.f1 as preset, b.f1 as base, round(a.f1 - b.f1, 6) as gain from gs a join gs b on a.item = b.item and a.setting = 13 and b.setting = 0")
def preset_compare(spark, sf):
    return tune.compared(_grid(spark, sf), 13, 0).withColumns({c: F.round(c, 6) for c in ("preset", "base", "gain")})


@query("with " + _GRID + ", r as (select item, rank() over (partition by item order by f1) + (count(*) over (partition by item, f1) - 1) / 2.0 as ra, rank() over (partition by item order by iou) + (count(*) over (partition by item, iou) - 1) / 2.0 as rb from gs) select item, round(corr(ra, rb), 6) as spearman from r group by item")
def spearman(spark, sf):
    return tune.spearman(_grid(spark, sf), "f1", "iou", "item").withColumn("spearman", F.round("spearman", 6))


@query("with t as (select count(*) as n, sum((abs(doc_id * 2654435761) % 100 < 80)::int)::bigint as train from documents) select n, train, n - train as val from t")
def seeded_split(spark, sf):
    d = tiles_.split(X.table(spark, sf, "documents"), "doc_id")
    return d.agg(F.count("*").alias("n"), F.sum(F.when(F.col("train"), 1).otherwise(0)).alias("train")).withColumn("val", F.col("n") - F.col("train"))


# --- pictures --------------------------------------------------------------------------------------


@query("with " + _T + ", m as (select roi, tz, ty, tx, max(local) as m from t group by all), s as (select *, coalesce(sum(m) over (partition by roi order by tz, ty, tx rows between unbounded preceding and 1 preceding), 0)::bigint as shift from m) select roi, (local + shift)::bigint as label, count(*) as n from t join s using (roi, tz, ty, tx) group by 1, 2", ("gt",))
def mosaic_ids(spark, sf):
    return project.mosaic(graph.tiled(X.truth(spark, sf), TILE)).groupBy("roi", "label").agg(F.count("*").alias("n"))


@query("select roi, count(*) as tiles, max(z) + 128 as nz, max(y) + 128 as ny, max(x) + 128 as nx from qc group by roi", ("qc",))
def roi_extent(spark, sf):
    return project.extents(X.tile_measures(spark, sf))


@query("select roi, y, x, max(v)::bigint as v from raw group by roi, y, x", ("gt", "raw"))
def mip(spark, sf):
    return project.projection(X.raw(spark, sf))


@query("select roi, y, x, gt.label from raw join gt using (roi, z, y, x) qualify row_number() over (partition by roi, y, x order by v desc, z) = 1", ("gt", "raw"))
def brightest_label(spark, sf):
    return project.brightest_label(X.raw(spark, sf), X.truth(spark, sf))


@query("select roi, y, count(*) as n from gt where y >= 19 and y < 29 group by roi, y", ("gt",))
def section_slab(spark, sf):
    return project.section(X.truth(spark, sf), "y", 48, 10.0, 2.0).groupBy("roi", "y").agg(F.count("*").alias("n"))


@query(
    "with p as (select roi, floor((x - 24) * cos(radians(30.0)) - (z - 24) * sin(radians(30.0)) + 24)::bigint as u, y::bigint as w, round((x - 24) * sin(radians(30.0)) + (z - 24) * cos(radians(30.0)), 6) as depth, label from gt) "
    "select roi, u, w, label from p qualify row_number() over (partition by roi, u, w order by depth, label) = 1",
    ("gt",),
)
def point_splat(spark, sf):
    return project.splat(X.truth(spark, sf), 30.0, 24.0).select("roi", "u", "w", "label")


@query("select label, round(label * 0.6180339887498949::double - floor(label * 0.6180339887498949::double), 6) as hue from gt group by label", ("gt",))
def golden_colours(spark, sf):
    return project.coloured(X.truth(spark, sf).select("label").distinct())


@query("with s as (select roi, z, y, x, v / 6000e0 as p from raw union all select roi, z, y, x, v / 7000e0 from raw where z % 12 >= 9) select roi, z, count(*) as n from (select roi, z, y, x, max(p) as p from s group by roi, z, y, x) where p > 0.6 group by roi, z", ("gt", "raw"))
def tiled_merge(spark, sf):
    """Overlapping patches of a probability merged by maximum, then thresholded."""
    r = X.raw(spark, sf)
    a = r.select("roi", "z", "y", "x", (F.col("v") / F.lit(6000.0)).alias("p"))
    b = r.where("z % 12 >= 9").select("roi", "z", "y", "x", (F.col("v") / F.lit(7000.0)).alias("p"))
    return predict.merged(a.unionByName(b), 0.6).groupBy("roi", "z").agg(F.count("*").alias("n"))


# An axis of 48 voxels: order 1 to 60 voxels for y, and to 36 for z, which is smoothed by a Gaussian of 1/6 voxel (its radius is 1) first.
_RESIZE = (
    "wy as (select o, i, sum(w) as w from (select o, abs(floor(p)::int) as i, 1 - (p - floor(p)) as w from (select range as o, (range + 0.5) * 0.8 - 0.5 as p from range(60)) union all "
    "select o, case when floor(p)::int + 1 > 47 then 94 - floor(p)::int - 1 else floor(p)::int + 1 end, p - floor(p) from (select range as o, (range + 0.5) * 0.8 - 0.5 as p from range(60))) group by o, i), "
    "lz as (select o, floor(p)::int as i, 1 - (p - floor(p)) as w from (select range as o, (range + 0.5) * 4 / 3.0::double - 0.5 as p from range(36)) union all select o, floor(p)::int + 1, p - floor(p) from (select range as o, (range + 0.5) * 4 / 3.0::double - 0.5 as p from range(36))), "
    "gk as (select d, exp(-0.5 * power(d * 6.0::double, 2)) / (1 + 2 * exp(-18.0::double)) as g from (values (-1), (0), (1)) t(d)), "
    "wz as (select o, i2 as i, sum(w * g) as w from (select o, w, g, case when i + d < 0 then -(i + d) when i + d > 47 then 94 - (i + d) else i + d end as i2 from lz, gk) group by o, i2), "
    "rz as (select roi, o as z, y, x, sum(v * w) as v from raw join wz on wz.i = raw.z group by all), ry as (select roi, z, o as y, x, sum(v * w) as v from rz join wy on wy.i = rz.y group by all)"
)


@query("with " + _RESIZE + " select roi, z, round(sum(v), 3) as total, round(max(v), 3) as most from ry group by roi, z", ("gt", "raw"))
def resample(spark, sf):
    """Volumes at another voxel size: fewer slices, more rows."""
    r = predict.resampled(X.raw(spark, sf), (48, 48, 48), (36, 60, 48))
    return r.groupBy("roi", "z").agg(F.round(F.sum("v"), 3).alias("total"), F.round(F.max("v"), 3).alias("most"))


def _bright():
    """A model of one voxel: a logistic function of its value."""
    import numpy as np

    return lambda p: 1 / (1 + np.exp(-(p.astype(np.float64) - 3550) / 40))


@query("with m as (select *, v > 3550 as f, min(v) over (partition by roi, z // 4, y // 4, x // 4) > 3550 as whole from raw) select roi, z, count(*) as n from m where f and not whole group by roi, z", ("gt", "raw"))
def patch_inference(spark, sf):
    """A caller's model over patches of chunks; patches whose outputs are constant are left out."""
    return predict.predicted(X.raw(spark, sf), (48, 48, 48), _bright, chunk=24, patch=4).groupBy("roi", "z").agg(F.count("*").alias("n"))


@query("select label, round(avg(z) * 2.0 / 1.34, 6) as z, round(avg(y) * 0.5616 / 1.54, 6) as y, round(avg(x) * 0.528 / 2.0, 6) as x from gt group by label", ("gt",))
def centroid_rescale(spark, sf):
    s = objects.statistics(X.truth(spark, sf))
    scale = {"z": 2.0 / 1.34, "y": 0.5616 / 1.54, "x": 0.528 / 2.0}
    return s.select("label", *[F.round(F.col(f"c{a}") * F.lit(v), 6).alias(a) for a, v in scale.items()])

