"""Named queries over the fixtures, each with the SQL that an independent engine can run where there is one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exact, graph, masks, objects, project, qc, score, segment, tune
from ..operators.settings import Settings
from ..operators.shared import settled
from ..sources import files, tilefiles
from ..operators import kernels as K
from ..sources import fixtures as X
from ..sources import tiles as tiles_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TILE = 24
SHAPE = (48, 48, 48)
#: Settings for the small spheres of the fixtures: nuclei of 8 voxels on cubic voxels.
SMALL = Settings(nucleus_diameter_vox=8.0, voxel_size=(1.0, 1.0, 1.0), min_seed_distance=3, seed_prominence=0.0, seed_landscape_smooth_um=1.0, min_object_voxels=60, solidity_thresh=0.55)


def query(sql: str | None = None, fixtures: tuple[str, ...] = ()):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = X.ctes(*fixtures) if fixtures else ""
            body = sql.strip()
            if head and body.startswith("with recursive "):
                body = head.replace("with ", "with recursive ", 1) + ",\n" + body.removeprefix("with recursive ")
            elif head and body.startswith("with "):
                body = head + ",\n" + body.removeprefix("with ")
            elif head:
                body = head + "\n" + body
            SQL[f.__name__] = body
        return f

    return keep


# --- sources, discovery ----------------------------------------------------------------------------


@query("select regexp_extract(chunk, '^(.+)_z(\\d+)_y(\\d+)_x(\\d+)$', 1) as roi, z, y, x, chunk as name from qc", ("qc",))
def tile_keys(spark, sf):
    t = X.tile_measures(spark, sf).select(F.col("chunk").alias("name"))
    junk = X.table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    return tiles_.parsed(t.unionByName(junk)).select("roi", "z", "y", "x", "name")


@query("select chunk from qc where roi = (select roi from (select distinct roi from qc) order by roi limit 1 offset 1) and z >= 0 and z < 128 and y >= 128 and y < 512 and x >= 0 and x < 1024", ("qc",))
def tile_subset(spark, sf):
    return tiles_.subset(X.tile_measures(spark, sf), roi="1", box=((0, 128), (128, 512), (0, 1024))).select("chunk")


@query("with o as (select chunk, row_number() over (order by roi, z, y, x) - 1 as k, count(*) over () as n from qc) select chunk from o where k % greatest(1, n // 7) = 0 order by k limit 7", ("qc",))
def tile_even_sample(spark, sf):
    return tiles_.every_nth(X.tile_measures(spark, sf), 7).select("chunk")


@query("with o as (select chunk, row_number() over (order by roi, z, y, x) - 1 as k, count(*) over () as n from qc) select chunk from o where k in (select floor(i * (n - 1) / 4.0)::int from range(5) t(i))", ("qc",))
def tile_linear_spread(spark, sf):
    return tiles_.spread(X.tile_measures(spark, sf), 5).select("chunk")


@query("select chunk from qc where not has_output", ("qc",))
def tile_resume(spark, sf):
    t = X.tile_measures(spark, sf)
    return tiles_.unfinished(t, t.where("has_output")).select("chunk")


@query(
    "with l as (select distinct doc_id from documents), r as (select distinct doc_id from labels) "
    "select case when l.doc_id is null then 'right' when r.doc_id is null then 'left' else 'both' end as side, count(*) as n from l full join r on l.doc_id = r.doc_id group by 1"
)
def pair_check(spark, sf):
    a = X.table(spark, sf, "documents").select(F.col("doc_id").alias("name"))
    return tiles_.pairing(a, X.table(spark, sf, "labels").select(F.col("doc_id").alias("name")))


@query(
    "with m as (select r_name as region, unnest(range(r_regionkey * 10, r_regionkey * 10 + 8)) as id from region) "
    "select region, count(*) as tests, count(s.s_suppkey) as matched from m left join supplier s on s.s_suppkey = m.id group by region"
)
def manifest_link(spark, sf):
    r = X.table(spark, sf, "region")
    one = F.struct(F.array().cast("array<bigint>").alias("train"), F.sequence(F.col("r_regionkey").cast("long") * 10, F.col("r_regionkey").cast("long") * 10 + 7).alias("test"))
    m = r.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", one)))).alias("json"))
    return tiles_.manifest_test_set(m, X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))


@query("select roi, (z // 20) * 20 as tz, (y // 20) * 20 as ty, (x // 20) * 20 as tx, count(*) as voxels, sum(label)::bigint as labels, max(z % 20) as lz from gt group by 1, 2, 3, 4", ("gt",))
def volume_to_tiles(spark, sf):
    return tiles_.cut(X.truth(spark, sf), 20).groupBy("roi", "tz", "ty", "tx").agg(F.count("*").alias("voxels"), F.sum("label").alias("labels"), F.max("lz").alias("lz"))


@query("select roi, z, y, x, label as v from gt", ("gt",))
def tile_blob_round_trip(spark, sf):
    t = X.truth(spark, sf).select("roi", "z", "y", "x", F.col("label").alias("v"))
    return tiles_.from_blobs(tiles_.to_blobs(t, TILE)).withColumn("roi", F.col("roi").cast("long"))


@query("select roi::varchar as roi, z, y, x, label as v from gt where roi >= 0 and z >= 24 and x < 24", ("gt",))
def tile_files(spark, sf):
    """Tiles written as files and read back, those of a box only."""
    from ..operators.shared import scratch

    folder = scratch(spark)
    tilefiles.write_tiles(tiles_.to_blobs(X.truth(spark, sf).select("roi", "z", "y", "x", F.col("label").alias("v")), TILE), folder)
    return tiles_.from_blobs(tilefiles.read_tiles(spark, folder).where("z >= 24 and x < 24"))


@query("select roi, case when max(label) <= 255 then 'uint8' when max(label) <= 65535 then 'uint16' else 'uint32' end as dtype from pred group by roi", ("pred",))
def label_dtype(spark, sf):
    return tiles_.label_type(X.predicted(spark, sf))


@query("select event_id, case when value - floor(value) > 0.5 then 255 else 0 end as mask from events")
def probability_threshold(spark, sf):
    e = X.table(spark, sf, "events").withColumn("p", F.col("value") - F.floor("value"))
    return masks.above(e, 0.5).select("event_id", "mask")


@query("select vec_id, label, round(d0, 6) as d0, round(d1, 6) as d1, round(d2, 6) as d2 from ex", ("ex",))
def exemplar_json_round_trip(spark, sf):
    ex, _ = X.exemplars(spark, sf)
    js = ex.select(F.to_json(F.struct("vec_id", "label", F.struct("d0", "d1", "d2").alias("descriptors"))).alias("j"))
    p = F.from_json("j", "vec_id bigint, label int, descriptors struct<d0:double,d1:double,d2:double>")
    return js.select(p.alias("p")).select("p.vec_id", "p.label", *[F.round(f"p.descriptors.{d}", 6).alias(d) for d in ("d0", "d1", "d2")])


# --- masks -----------------------------------------------------------------------------------------

_FLOOR = "m as (select roi, z, median(v) as mid, count(*) as n from raw where v > 0 group by roi, z), d as (select roi, z, median(abs(v - mid)) as mad from raw join m using (roi, z) where v > 0 group by roi, z), fl as (select roi, z, n, case when n < 100 then '-Infinity'::double else mid + {k} * 1.4826 * mad end as f from m join d using (roi, z))"


@query("with " + _FLOOR.format(k="1.5e0") + " select roi, z, n as n_positive, round(f, 6) as floor from fl", ("gt", "raw"))
def slice_floor(spark, sf):
    return masks.background_floor(X.raw(spark, sf), 1.5).select("roi", "z", F.col("n_positive").cast("long").alias("n_positive"), F.round("floor", 6).alias("floor"))


@query(
    "with " + _FLOOR.format(k="1.5e0") + ", t as (select roi, z, quantile_cont(v, 0.9) as t, min(v) as lo, max(v) as hi from raw group by roi, z), "
    "k as (select r.roi, r.z, r.y, r.x from raw r join t on t.roi = r.roi and t.z = r.z join fl on fl.roi = r.roi and fl.z = r.z where lo < hi and v > greatest(t.t, fl.f)) select roi, z, count(*) as n, sum(y * 48 + x)::bigint as s from k group by roi, z",
    ("gt", "raw"),
)
def slice_percentile_mask(spark, sf):
    return masks.percentile_mask(X.raw(spark, sf), 90, 1.5).groupBy("roi", "z").agg(F.count("*").alias("n"), F.sum(F.col("y") * 48 + F.col("x")).alias("s"))


@query(
    "with t as (select roi, z, quantile_cont(v, 0.94) as t, min(v) as lo, max(v) as hi from raw where x < 46 group by roi, z), "
    "k as (select r.* from raw r join t on t.roi = r.roi and t.z = r.z where x < 46 and lo < hi and v > t.t) select roi, z, count(*) as n, sum(y * 48 + x)::bigint as s from k group by roi, z",
    ("gt", "raw"),
)
def valid_percentile_mask(spark, sf):
    return masks.percentile_mask(X.raw(spark, sf), 94, valid="x < 46").groupBy("roi", "z").agg(F.count("*").alias("n"), F.sum(F.col("y") * 48 + F.col("x")).alias("s"))


@query(
    "with h as (select roi, v, count(*) as c from raw group by roi, v), w as (select roi, v, sum(c) over u as w0, sum(c * v) over u as s0, sum(c) over a as w, sum(c * v) over a as s from h window u as (partition by roi order by v), a as (partition by roi)), "
    "b as (select roi, v, w0::double * (w - w0)::double * (s0::double / w0::double - (s - s0)::double / (w - w0)::double) * (s0::double / w0::double - (s - s0)::double / (w - w0)::double) as between_ from w where w0 < w) "
    "select roi, v as threshold, (select count(*) from raw r where r.roi = b.roi and r.v > b.v) as n from b qualify row_number() over (partition by roi order by between_ desc, v) = 1",
    ("gt", "raw"),
)
def otsu_mask(spark, sf):
    r = X.raw(spark, sf)
    n = masks.otsu_mask(r).groupBy("roi").agg(F.count("*").alias("n"))
    return masks.otsu_threshold(r).join(n, "roi")


def _gauss(name: str, sigma: float) -> str:
    """A table (o, i, w): weights of a Gaussian along an axis of 48 voxels, cut at four sigmas, edges reflected."""
    r = int(4 * sigma + 0.5)
    return (
        f"{name}_k as (select d, exp(-0.5 * power(d / {sigma}e0, 2)) as g from (select unnest(range({-r}, {r + 1})) as d)), "
        f"{name} as (select o, case when o + d < 0 then -(o + d) - 1 when o + d > 47 then 95 - (o + d) else o + d end as i, sum(g / (select sum(g) from {name}_k)) as w from (select range as o from range(48)), {name}_k group by all)"
    )


def _blurred(out: str, source: str, value: str, z: str | None, y: str, x: str) -> str:
    """``source`` smoothed along its axes by tables of weights."""
    steps, last, v = [], source, value
    for axis, w in (("z", z), ("y", y), ("x", x)):
        if w is None:
            continue
        keep = ", ".join(f"s.{a}" if a != axis else f"w.o as {a}" for a in "zyx")
        name = out if axis == "x" else f"{out}_{axis}"
        steps.append(f"{name} as (select s.roi, {keep}, sum(s.{v} * w.w) as b from {last} s join {w} w on w.i = s.{axis} group by all)")
        last, v = name, "b"
    return ", ".join(steps)


@query("with " + _gauss("gl", 50 / 6) + ", " + _blurred("bl", "raw", "v", None, "gl", "gl") + ", fs as (select roi, z from raw group by roi, z having min(v) < max(v)) select r.roi, r.z, count(*) as n from raw r join bl using (roi, z, y, x) semi join fs using (roi, z) where r.v > bl.b group by r.roi, r.z", ("gt", "raw"))
def local_mask(spark, sf):
    return segment.per_tile(X.raw_lines(spark, sf), lambda a: K.local_mask(a, 51), "fg", tile=TILE, margin=(0, 34, 34), shape=SHAPE).groupBy("roi", "z").agg(F.count("*").alias("n"))


@query()
def top_hat(spark, sf):
    return segment.per_tile(X.raw_lines(spark, sf), lambda a: K.top_hat(a, 8), "h", "double", tile=TILE, margin=16, shape=SHAPE).groupBy("roi", "z").agg(F.sum("h").alias("total"))


@query(
    "with " + _gauss("g1", 1.0) + ", " + _gauss("g4", 4.0) + ", rv as (select roi, z, y, x, v from raw where x < 46), " + _blurred("lo", "rv", "v", "g1", "g1", "g1") + ", " + _blurred("hi", "rv", "v", "g4", "g4", "g4")
    + ", bp as (select roi, z, y, x, lo.b - hi.b as b from lo join hi using (roi, z, y, x) where x < 46), lv as (select roi, quantile_cont(b, 0.9) as level from bp group by roi) select roi, z, count(*) as n from bp join lv using (roi) where b > level group by roi, z",
    ("gt", "raw"),
)
def bandpass_mask(spark, sf):
    """One percentile of the band-passed values of each roi, over those that are valid; a roi of the fixtures is one block, so values are compared where they are made."""
    valid = np.broadcast_to(np.arange(SHAPE[2]) < X.FULL, SHAPE)
    cut = lambda a: K.bandpass_mask(a, 1.0, 4.0, (1.0, 1.0, 1.0), 90.0, valid)
    return segment.per_tile(X.raw_lines(spark, sf), cut, "fg", shape=SHAPE).groupBy("roi", "z").agg(F.count("*").alias("n"))


_BALL = "(values (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx)"


@query(f"with e as (select roi, z + dz as z, y + dy as y, x + dx as x from gt, {_BALL} group by 1, 2, 3, 4 having count(*) = 7), d as (select distinct roi, z + dz as z, y + dy as y, x + dx as x from e, {_BALL}) select roi, z, count(*) as n, sum(y * 48 + x)::bigint as s from d group by roi, z", ("gt",))
def mask_opening(spark, sf):
    return masks.opened(X.truth(spark, sf), 1).groupBy("roi", "z").agg(F.count("*").alias("n"), F.sum(F.col("y") * 48 + F.col("x")).alias("s"))


@query("select roi, label, count(*) as n from gt where z >= 10 and z < 40 group by roi, label", ("gt",))
def z_window(spark, sf):
    return masks.z_window(X.truth(spark, sf), "10:40", 48).groupBy("roi", "label").agg(F.count("*").alias("n"))


@query("with s as (select roi, label, count(*) as n from gt group by roi, label) select roi, label, n from s where n >= 200", ("gt",))
def drop_small(spark, sf):
    return masks.drop_small(X.truth(spark, sf), 200).groupBy("roi", "label").agg(F.count("*").alias("n"))


@query("with s as (select roi, label, count(*) as n from gt group by roi, label having count(*) >= 150) select roi, label, dense_rank() over (partition by roi order by label) as new_label, n from s", ("gt",))
def reindex_dense(spark, sf):
    return masks.renumbered(X.truth(spark, sf), 150).groupBy("roi", "label", "new_label").agg(F.count("*").alias("n"))


@query(
    "with s as (select roi, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi, avg(v) as mean, stddev_samp(v) as sd from raw group by roi) "
    "select r.roi, round(avg(case when hi > lo then least(greatest((v - lo) / (hi - lo), 0), 1) else 0 end), 6) as unit, round(max((v - mean) / sd), 6) as standard from raw r join s on s.roi = r.roi group by r.roi",
    ("gt", "raw"),
)
def intensity_normalise(spark, sf):
    return masks.stretched(X.raw(spark, sf)).groupBy("roi").agg(F.round(F.avg("unit"), 6).alias("unit"), F.round(F.max("standard"), 6).alias("standard"))


@query("select roi, z - 12 as z, y - 12 as y, x - 12 as x, label from gt where z >= 12 and z < 36 and y >= 12 and y < 36 and x >= 12 and x < 36", ("gt",))
def centre_crop(spark, sf):
    return masks.cropped(X.truth(spark, sf), (24, 24, 24), (48, 48, 48)).select("roi", "z", "y", "x", "label")


@query("select roi, z, y, x, label from gt where (z % 24) % 3 = 0 and (y % 24) % 2 = 0 and (x % 24) % 2 = 0", ("gt",))
def strided_downsample(spark, sf):
    return masks.strided(X.truth(spark, sf), 3, 2).select("roi", "z", "y", "x", "label")


@query(
    "with o as (select dz, dy, dx from (values (-1),(0),(1)) a(dz), (values (-1),(0),(1)) b(dy), (values (-1),(0),(1)) c(dx)), r as (select * from raw), "
    "m as (select r.roi, r.z + dz as z, r.y + dy as y, r.x + dx as x, median(v) as m from r, o group by 1, 2, 3, 4) select r.roi, r.z, sum(m)::double as total from r join m using (roi, z, y, x) group by r.roi, r.z",
    ("gt", "raw"),
)
def denoise_median(spark, sf):
    m = masks.median_filter(X.raw_lines(spark, sf), masks.offsets(26), TILE, SHAPE)
    return m.groupBy("roi", "z").agg(F.sum("median").alias("total"))


# --- kernels ---------------------------------------------------------------------------------------


# Squared distances axis by axis: the least over a line of what is there and the squared step.
_EDT = (
    "with d0 as (select r.roi, r.z, r.y, r.x, case when g.label is null then 0 else 1000000 end as d from raw r left join gt g using (roi, z, y, x)), "
    "d1 as (select a.roi, a.z, a.y, a.x, min(b.d + (a.z - b.z) * (a.z - b.z) * 4) as d from d0 a join d0 b using (roi, y, x) where a.d > 0 group by all), e1 as (select * from d1 union all select * from d0 where d = 0), "
    "d2 as (select a.roi, a.z, a.y, a.x, min(b.d + (a.y - b.y) * (a.y - b.y)) as d from e1 a join e1 b using (roi, z, x) where a.d > 0 group by all), e2 as (select * from d2 union all select * from d0 where d = 0), "
    "d3 as (select a.roi, a.z, a.y, a.x, min(b.d + (a.x - b.x) * (a.x - b.x)) as d from e2 a join e2 b using (roi, z, y) where a.d > 0 group by all) select roi, z, y, x, round(sqrt(d), 6) as distance from d3"
)


@query(_EDT, ("gt", "raw"))
def distance_transform(spark, sf):
    """Line by line along each axis, so objects may be of any thickness."""
    return exact.distance(X.truth(spark, sf), SHAPE, (2.0, 1.0, 1.0), TILE).withColumn("distance", F.round("distance", 6))


@query("with " + _gauss("g1", 1.0) + ", " + _gauss("g15", 1.5) + ", " + _blurred("bl", "raw", "v", "g1", "g15", "g15") + " select roi, z, round(sum(b), 3) as total from bl group by roi, z", ("gt", "raw"))
def gaussian_smooth(spark, sf):
    return segment.per_tile(X.raw_lines(spark, sf), lambda a: K.gaussian(a, (1.0, 1.5, 1.5)), "s", "double", tile=TILE, margin=7, shape=SHAPE).groupBy("roi", "z").agg(F.round(F.sum("s"), 3).alias("total"))


@query(
    "with o as (select z.i - 8 as dz, y.i - 8 as dy, x.i - 8 as dx from ax z, ax y, ax x where z.i <= 16 and y.i <= 16 and x.i <= 16 and ((z.i - 8) * 2) * ((z.i - 8) * 2) + (y.i - 8) * (y.i - 8) + (x.i - 8) * (x.i - 8) <= 16), "
    "c as (select roi, z, y, x, label from gt where d2 = 0) select c.roi, c.label, count(*) as n, count(*) filter (g.label = c.label) as own from c cross join o join gt g on g.roi = c.roi and g.z = c.z + dz and g.y = c.y + dy and g.x = c.x + dx group by c.roi, c.label",
    ("gt",),
)
def sphere_footprint(spark, sf):
    """Labelled voxels in the physical sphere around each object's centre."""
    t = X.truth(spark, sf)
    near = masks.around(t.where("d2 = 0").select("roi", "z", "y", "x", "label"), t, K.sphere_offsets(4, (2.0, 1.0, 1.0)), "label")
    return near.groupBy("roi", "label").agg(F.count("*").alias("n"), F.count(F.when(F.col("near") == F.col("label"), 1)).alias("own"))


_SEEDS = (
    "with c as (select roi, z, y, x, v from raw where v > 3900), o as (select z.i - 2 as dz, y.i - 2 as dy, x.i - 2 as dx from ax z, ax y, ax x where z.i <= 4 and y.i <= 4 and x.i <= 4 and (z.i-2)*(z.i-2)+(y.i-2)*(y.i-2)+(x.i-2)*(x.i-2) <= 4), "
    "near as (select c.roi, c.z as cz, c.y as cy, c.x as cx, c.v as cv, c.z + dz as z, c.y + dy as y, c.x + dx as x from c cross join o), "
    "big as (select distinct n.roi, cz as z, cy as y, cx as x from near n join raw r on r.roi = n.roi and r.z = n.z and r.y = n.y and r.x = n.x where r.v > cv) select roi, z, y, x, v from c anti join big using (roi, z, y, x)"
)
_SEED_BALL = [(a, b, d) for a in range(-2, 3) for b in range(-2, 3) for d in range(-2, 3) if a * a + b * b + d * d <= 4]


@query(_SEEDS, ("gt", "raw"))
def seed_peaks(spark, sf):
    """Candidates without a larger voxel in their footprint: the definition as one grouping."""
    return masks.peaks(X.raw(spark, sf), 3900, _SEED_BALL)


@query(_SEEDS, ("gt", "raw"))
def seed_peaks_kernel(spark, sf):
    """The same peaks by the array kernel, tile by tile."""
    return segment.per_tile(X.raw_lines(spark, sf), lambda a: a * K.peaks(a, a > 3900, _SEED_BALL), "v", tile=TILE, margin=2, shape=SHAPE).select("roi", "z", "y", "x", "v")


@query()
def watershed_tiles(spark, sf):
    """Spheres flooded from their centres down the distance to the background, across tiles until no border changes."""
    t = X.truth(spark, sf)
    seeds = t.where("d2 = 0").select("roi", "z", "y", "x", F.col("label").alias("marker"))
    d = exact.distance(t, SHAPE, lines=TILE).select("roi", "z", "y", "x", (-F.round("distance", 6)).alias("height"))
    return exact.watershed(d.join(seeds.hint("merge"), ["roi", "z", "y", "x"], "left"), TILE).groupBy("roi", "label").agg(F.count("*").alias("n"))


@query()
def tiled_segmentation(spark, sf):
    """Tiles with halos to objects of whole rois: segmented, screened, owned, assembled."""
    labels, _ = segment.tiled_segmentation(X.raw_lines(spark, sf), SHAPE, TILE, 12, SMALL)
    return objects.statistics(labels.withColumnRenamed("gid", "label")).select("roi", F.col("label").alias("gid"), "area", *[F.round(f"c{a}", 6).alias(f"c{a}") for a in "zyx"])


@query()
def tune_sweep(spark, sf):
    """Every roi segmented and scored under four settings; the scores of the first two come from a memo."""
    raw, gt = X.raw_lines(spark, sf), X.truth(spark, sf)
    memo = settled(tune.swept(raw, gt, _settings(spark).where("setting < 2"), SHAPE, SMALL, z_range="2:46"))
    return tune.swept(raw, gt, _settings(spark), SHAPE, SMALL, memo, "2:46").withColumns({c: F.round(c, 6) for c in ("f1", "iou")})


def _settings(spark):
    """A grid of four settings, and the base itself as -1."""
    grid = [(k, p, d) for k, (p, d) in enumerate((p, d) for p in (85.0, 92.0) for d in (3, 5))]
    return spark.createDataFrame([*grid, (-1, None, None)], "setting long, target_foreground_percentile double, min_seed_distance int")


@query()
def dispatch_sweep(spark, sf):
    """Leave one out, end to end: every tile segmented under every setting, its accepted objects scored, its descriptors matched to the nearest other tile."""
    raw, gt = X.raw_lines(spark, sf), X.truth(spark, sf)
    scores = settled(tune.swept(raw, gt, _settings(spark), SHAPE, SMALL, z_range="2:46"))
    d = settled(objects.descriptors(X.raw(spark, sf)).join(segment.blob_density(raw, SHAPE, 8.0).hint("merge"), "roi").where("usable").withColumnRenamed("roi", "item"))  # one row a tile, read several times
    return tune.left_out(scores, d, -1).withColumns({c: F.round(c, 6) for c in ("global", "oracle", "dispatch", "shuffled", "gap_closed")})


@query(
    "with " + ", ".join([_gauss("g1", 1.0), _gauss("g3", 3.0), _blurred("ga", "raw", "v", "g1", "g1", "g1"), _blurred("gi", "raw", "v", None, "g1", "g1"), _blurred("gb", "raw", "v", "g3", "g3", "g3")])
    + ", nb as (select o, least(greatest(o + d, 0), 47) as i from (select range as o from range(48)), (values (-1), (0), (1)) t(d)), me as (select roi, o.o as z, p.o as y, q.o as x, median(v) as b from raw join nb o on o.i = z join nb p on p.i = y join nb q on q.i = x group by all), "
    "mi as (select roi, z, p.o as y, q.o as x, median(v) as b from raw join nb p on p.i = y join nb q on q.i = x group by all), "
    "un as (select 'gauss_um=1.0' as filter, roi, b from ga union all select 'gauss_inplane=1.0', roi, b from gi union all select 'median3', roi, b from me union all select 'median_inplane', roi, b from mi "
    "union all select 'bgsub=3', raw.roi, greatest(v - b, 0) from raw join gb using (roi, z, y, x) union all select 'gauss_inplane=1.0+bgsub=3', gi.roi, greatest(gi.b - gb.b, 0) from gi join gb using (roi, z, y, x)) "
    "select filter, roi, round(sum(b), 1) as total from un group by filter, roi",
    ("gt", "raw"),
)
def denoise_bank(spark, sf):
    """Every filter of the bank over every roi, by tile: a tile is read once, with the margin that the widest filter needs."""
    names = ("gauss_um=1.0", "gauss_inplane=1.0", "median3", "median_inplane", "bgsub=3", "gauss_inplane=1.0+bgsub=3")
    cols = [f"s{k}" for k in range(len(names))]
    v = segment.per_tile(X.raw_lines(spark, sf), lambda a: tuple(K.denoise(a, n, (1.0, 1.0, 1.0)) for n in names), tuple(cols), "double", tile=TILE, margin=13, shape=SHAPE)
    totals = v.groupBy("roi").agg(*[F.sum(c).alias(c) for c in cols])
    each = F.inline(F.array(*[F.struct(F.col(c).alias("total"), F.lit(n).alias("filter")) for c, n in zip(cols, names, strict=True)]))
    return totals.select("roi", each).select("roi", F.round("total", 1).alias("total"), "filter")


@query("select label as label_id, round(sum(z) / count(*), 6) as z, round(sum(y) / count(*), 6) as y, round(sum(x) / count(*), 6) as x, count(*) as voxel_count from gt group by roi, label", ("gt",))
def centroids_csv(spark, sf):
    """Centroids written as CSV files with headers and read back."""
    from ..operators.shared import scratch

    folder = scratch(spark)
    files.write_csv(files.centroids(objects.statistics(X.truth(spark, sf))), folder)
    return files.read_csv(spark, folder, files.CENTROIDS).withColumns({a: F.round(a, 6) for a in "zyx"})


@query()
def segment_tile(spark, sf):
    return objects.statistics(segment.segmented(X.raw_lines(spark, sf), percentile=90.0, floor_k=1.5, min_distance=3, min_voxels=60)).select("roi", "label", "area")


@query()
def landscape_variants(spark, sf):
    """Every roi segmented on each landscape; a roi is read once."""
    names = ("dt_smooth", "int_blend", "dt_from_smooth")
    cut = lambda a: tuple(K.segment(a, percentile=90.0, floor_k=1.5, min_distance=3, min_voxels=60, landscape=n)[1] for n in names)
    each = F.inline(F.array(*[F.struct(F.col(f"label{k}").alias("label"), F.lit(n).alias("landscape")) for k, n in enumerate(names)]))
    found = segment.per_tile(X.raw_lines(spark, sf), cut, tuple(f"label{k}" for k in range(len(names)))).select("roi", each).where("label > 0")
    return found.groupBy("roi", "landscape").agg(F.countDistinct("label").alias("n")).select("roi", "n", "landscape")


@query("with p as (select label, z, floor(x + tan(radians(7.0)) * z + 0.5)::bigint as x from gt) select label, min(x) as x0, max(x) as x1, sum(x)::bigint as s from p group by label", ("gt",))
def deskew_labels(spark, sf):
    return project.deskew_labels(X.truth(spark, sf)).groupBy("label").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.sum("x").alias("s"))


@query(
    "with p as (select roi, z, y, v, floor(x + tan(radians(7.0)) * z)::bigint as lo, x + tan(radians(7.0)) * z - floor(x + tan(radians(7.0)) * z) as w from raw), "
    "t as (select roi, z, y, v, lo as x, 1 - w as w from p union all select roi, z, y, v, lo + 1, w from p), g as (select roi, z, y, x, sum(v * w) as s, sum(w) as w from t where x >= 0 and x < 48 + ceil(tan(radians(7.0)) * 47) group by roi, z, y, x) "
    "select roi, z, count(*) as n, sum(case when w > 0.999 then 1 else 0 end)::bigint as valid, round(sum(s), 2) as total from g group by roi, z",
    ("gt", "raw"),
)
def deskew_volume(spark, sf):
    """Unrounded totals, which don't depend on ties; rounding has its test."""
    d = project.deskew_raw(X.raw(spark, sf), 48, 48, whole=False)
    return d.groupBy("roi", "z").agg(F.count("*").alias("n"), F.sum(F.when(F.col("valid"), 1).otherwise(0)).alias("valid"), F.round(F.sum("v"), 2).alias("total"))


@query("with o as (select label, avg(z) as z, avg(y) as y, avg(x) as x from gt group by label) select label, round(x + tan(radians(7.0)) * z, 6) as xd, round(x, 6) as xn from o", ("gt",))
def deskew_points(spark, sf):
    p = objects.statistics(X.truth(spark, sf)).select("label", F.col("cz").alias("z"), F.col("cx").alias("x"))
    return project.native_points(project.deskewed_points(p)).select("label", F.round("xd", 6).alias("xd"), F.round("xn", 6).alias("xn"))


@query(
    "with o as (select label, count(*) as n, covar_pop(x, z) as c, var_pop(z) as v from gt group by roi, label), s as (select c / v as slope from o where n >= 200 and v > 0) "
    "select count(*) as objects, round(avg(slope), 6) + 0.0 as mean, round(median(slope), 6) + 0.0 as median, round(stddev_pop(slope) / sqrt(count(*)), 6) + 0.0 as sem from s",
    ("gt",),
)
def residual_shear(spark, sf):
    return objects.residual_shear(X.truth(spark, sf)).select("objects", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean", "median", "sem")])


_T = "t as (select roi, (z // 24) * 24 as tz, (y // 24) * 24 as ty, (x // 24) * 24 as tx, z, y, x, label, dense_rank() over (partition by roi, z // 24, y // 24, x // 24 order by label) as local from gt)"


@query(
    "with o as (select dz, dy, dx from (values (-24),(0),(24)) a(dz), (values (-24),(0),(24)) b(dy), (values (-24),(0),(24)) c(dx)), h as (select roi, (z // 24) * 24 + dz as tz, (y // 24) * 24 + dy as ty, (x // 24) * 24 + dx as tx, z, y, x from gt, o) "
    "select roi, tz, ty, tx, count(*) as n from h where z >= tz - 5 and z < tz + 29 and y >= ty - 5 and y < ty + 29 and x >= tx - 5 and x < tx + 29 group by roi, tz, ty, tx",
    ("gt",),
)
def halo_build(spark, sf):
    return project.halo(X.truth(spark, sf), TILE, 5).groupBy("roi", "tz", "ty", "tx").agg(F.count("*").alias("n"))


_HALO = (
    "o as (select dz, dy, dx from (values (-24),(0),(24)) a(dz), (values (-24),(0),(24)) b(dy), (values (-24),(0),(24)) c(dx)), h as (select roi, (z // 24) * 24 + dz as tz, (y // 24) * 24 + dy as ty, (x // 24) * 24 + dx as tx, z, y, x, label from gt, o), "
    "hb as (select * from h where z >= tz - 5 and z < tz + 29 and y >= ty - 5 and y < ty + 29 and x >= tx - 5 and x < tx + 29), "
    "ob as (select roi, tz, ty, tx, label, avg(z) as cz, avg(y) as cy, avg(x) as cx from hb group by roi, tz, ty, tx, label), ord as (select roi, tz, ty, tx, row_number() over (order by roi, tz, ty, tx) - 1 as ordinal from (select distinct roi, tz, ty, tx from ob)), "
    "own as (select roi, tz, ty, tx, label, ordinal * 4096 + row_number() over (partition by roi, tz, ty, tx order by label) as gid from ob join ord using (roi, tz, ty, tx) where cz >= tz and cz < tz + 24 and cy >= ty and cy < ty + 24 and cx >= tx and cx < tx + 24)"
)


def _owned(spark, sf):
    h = project.halo(X.truth(spark, sf), TILE, 5)
    s = h.groupBy("roi", "tz", "ty", "tx", "label").agg(*[F.avg(a).alias(f"c{a}") for a in "zyx"])
    return h, project.owned(s, TILE)


@query("with " + _HALO + " select roi, tz, ty, tx, label, gid from own", ("gt",))
def halo_ownership(spark, sf):
    return _owned(spark, sf)[1].select("roi", "tz", "ty", "tx", "label", "gid")


@query(
    "with " + _HALO + ", p as (select hb.roi, hb.z, hb.y, hb.x, (hb.z // 24) * 10000 + (hb.y // 24) * 100 + (hb.x // 24) as target, (hb.tz // 24) * 10000 + (hb.ty // 24) * 100 + (hb.tx // 24) as source, gid from hb join own using (roi, tz, ty, tx, label)), "
    "w as (select roi, z, y, x, gid from p qualify row_number() over (partition by roi, z, y, x order by source <> target, source, gid) = 1) select roi, gid, count(*) as n from w group by roi, gid",
    ("gt",),
)
def halo_assemble(spark, sf):
    h, own = _owned(spark, sf)
    code = lambda a, b, c: F.floor(a / TILE) * 10000 + F.floor(b / TILE) * 100 + F.floor(c / TILE)
    p = h.join(own.select("roi", "tz", "ty", "tx", "label", "gid").hint("merge"), ["roi", "tz", "ty", "tx", "label"]).select("roi", "z", "y", "x", code(F.col("z"), F.col("y"), F.col("x")).alias("target"), code(F.col("tz"), F.col("ty"), F.col("tx")).alias("source"), "gid")
    return project.assembled(p).groupBy("roi", "gid").agg(F.count("*").alias("n"))


# --- graph -----------------------------------------------------------------------------------------


def _components_sql(near: str, gap: int) -> str:
    """Components of runs along x: far fewer than voxels, so that reachability stays small."""
    return (
        "with recursive s as (select distinct roi, z, y, x, x - row_number() over (partition by roi, z, y order by x) as k from gt), m as (select roi, z, y, min(x) as x0, max(x) as x1, ((roi * 48 + z) * 48 + y) * 48 + min(x) as id from s group by roi, z, y, k), "
        "o as (select dz, dy from (values (-1),(0),(1)) a(dz), (values (-1),(0),(1)) b(dy) where " + near + f"), mo as (select m.*, dz, dy from m cross join o), ee as (select a.id as a, b.id as b from mo a join m b on b.roi = a.roi and b.z = a.z + dz and b.y = a.y + dy where b.x0 <= a.x1 + {gap} and a.x0 <= b.x1 + {gap}), "
        "r(id, root) as (select id, id from m union select ee.b, r.root from r join ee on ee.a = r.id) select root, sum(x1 - x0 + 1)::bigint as n from (select id, min(root) as root from r group by id) join m using (id) group by root"
    )


def _component_sizes(spark, sf, connectivity):
    c = graph.components(X.truth(spark, sf), connectivity)
    return c.groupBy((((F.col("root.roi") * 48 + F.col("root.z")) * 48 + F.col("root.y")) * 48 + F.col("root.x")).alias("root")).agg(F.count("*").alias("n"))


@query(_components_sql("dz <> 0 or dy <> 0", 1), ("gt",))
def components_26(spark, sf):
    return _component_sizes(spark, sf, 26)


@query(_components_sql("abs(dz) + abs(dy) = 1", 0), ("gt",))
def components_6(spark, sf):
    return _component_sizes(spark, sf, 6)


_FACES = "f as (" + " union all ".join(
    f"select roi, tz, ty, tx, {k} as axis, {s} as side, {u} as u, {v} as v, local from t where {a} - t{a} = {23 * s}" for k, (a, u, v) in enumerate((("z", "y", "x"), ("y", "z", "x"), ("x", "z", "y"))) for s in (0, 1)
) + ")"
_EDGES = (
    _FACES + ", lo as (select roi, axis, u, v, local as a, tz as az, ty as ay, tx as ax_, tz + (case when axis = 0 then 24 else 0 end) as tz, ty + (case when axis = 1 then 24 else 0 end) as ty, tx + (case when axis = 2 then 24 else 0 end) as tx from f where side = 1), "
    "up as (select roi, tz, ty, tx, axis, u, v, local as b from f where side = 0), pr as (select roi, tz, ty, tx, axis, az, ay, ax_, a, b, count(*) as pixels from lo join up using (roi, tz, ty, tx, axis, u, v) group by all), "
    "na as (select roi, tz, ty, tx, axis, a, count(*) as na from lo group by all), nb as (select roi, tz, ty, tx, axis, b, count(*) as nb from up group by all), "
    "ed as (select *, pixels / least(na, nb) as containment from pr join na using (roi, tz, ty, tx, axis, a) join nb using (roi, tz, ty, tx, axis, b))"
)


@query("with " + _T + ", " + _FACES + " select axis, side, count(*) as n, sum(local)::bigint as s from f group by axis, side", ("gt",))
def face_planes(spark, sf):
    return graph.faces(graph.tiled(X.truth(spark, sf), TILE), TILE).groupBy("axis", "side").agg(F.count("*").alias("n"), F.sum("local").alias("s"))


@query("with " + _T + ", k as (select distinct roi, tz, ty, tx from t) select a.roi, 0 as axis, count(*) as n from k a join k b on b.roi = a.roi and b.tz = a.tz + 24 and b.ty = a.ty and b.tx = a.tx group by a.roi union all select a.roi, 1, count(*) from k a join k b on b.roi = a.roi and b.tz = a.tz and b.ty = a.ty + 24 and b.tx = a.tx group by a.roi union all select a.roi, 2, count(*) from k a join k b on b.roi = a.roi and b.tz = a.tz and b.ty = a.ty and b.tx = a.tx + 24 group by a.roi", ("gt",))
def face_adjacency(spark, sf):
    k = graph.tiled(X.truth(spark, sf), TILE).select("roi", "tz", "ty", "tx").distinct()
    out = None
    for i, a in enumerate(("tz", "ty", "tx")):
        one = k.withColumn(a, F.col(a) + TILE).join(k, ["roi", "tz", "ty", "tx"]).groupBy("roi").agg(F.count("*").alias("n")).withColumn("axis", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


@query("with " + _T + ", " + _EDGES + " select roi, axis, az, ay, ax_ as ax, a, b, pixels, round(containment, 6) as containment from ed where pixels >= 10 and containment >= 0.5", ("gt",))
def face_edges(spark, sf):
    return graph.face_edges(graph.tiled(X.truth(spark, sf), TILE), TILE).select("roi", "axis", "az", "ay", "ax", "a", "b", "pixels", F.round("containment", 6).alias("containment"))


# No box on this grid reaches the cap of 60, so there the capped merge is plain reachability.
_STITCH = (
    "with recursive " + _T + ", " + _EDGES + ", nd as (select distinct roi, tz, ty, tx, local, ((tz * 100 + ty) * 100 + tx) * 1000 + local as nid from t), "
    "ej as (select roi, ((az * 100 + ay) * 100 + ax_) * 1000 + a as p, ((tz * 100 + ty) * 100 + tx) * 1000 + b as q from ed where pixels >= 10 and containment >= 0.5), ee as (select roi, p, q from ej union all select roi, q, p from ej), "
    "r(roi, nid, root) as (select roi, nid, nid from nd union select ee.roi, ee.q, r.root from r join ee on ee.roi = r.roi and ee.p = r.nid), "
    "lb as (select roi, nid, min(root) as root from r group by roi, nid), gi as (select nd.*, dense_rank() over (order by nd.roi, root) as global_id from nd join lb on lb.roi = nd.roi and lb.nid = nd.nid)"
)


def _ids(spark, sf, cap=60.0):
    t = graph.tiled(X.truth(spark, sf), TILE)
    return t, graph.global_ids(graph.stitched(t, TILE, cap_um=cap))


@query()
def stitch_capped(spark, sf):
    return _ids(spark, sf, 9.0)[1].select("roi", "tz", "ty", "tx", "local", "global_id")


@query(_STITCH + " select roi, global_id, count(*) as voxels, count(distinct label) as labels from t join gi using (roi, tz, ty, tx, local) group by roi, global_id", ("gt",))
def stitch_relabel(spark, sf):
    t, ids = _ids(spark, sf)
    on = [*graph.KEY, "local"]
    n = t.groupBy(*on, "label").agg(F.count("*").alias("n"))  # counted before objects meet their ids: voxels are not shuffled
    return n.join(ids.select(*on, "global_id").hint("merge"), on).groupBy("roi", "global_id").agg(F.sum("n").alias("voxels"), F.countDistinct("label").alias("labels"))


@query(_STITCH + " select roi, global_id, round(avg(z), 6) as z, round(avg(y), 6) as y, round(avg(x), 6) as x, count(*) as voxel_count, greatest(max(z) + 1 - min(z), max(y) + 1 - min(y), max(x) + 1 - min(x))::double as longest_extent_um from t join gi using (roi, tz, ty, tx, local) group by roi, global_id", ("gt",))
def stitched_objects(spark, sf):
    t, ids = _ids(spark, sf)
    o = graph.stitched_objects(t, ids)
    return o.select("roi", "global_id", *[F.round(a, 6).alias(a) for a in "zyx"], "voxel_count", "longest_extent_um")


# --- objects ---------------------------------------------------------------------------------------

_STATS = "st as (select roi, label, count(*) as area, sum(z) / count(*) as cz, sum(y) / count(*) as cy, sum(x) / count(*) as cx, min(z) as z0, min(y) as y0, min(x) as x0, max(z) + 1 as z1, max(y) + 1 as y1, max(x) + 1 as x1 from gt group by roi, label)"
_ZED = "zs as (select *, case when count(*) over (partition by roi) > 2 then (area - avg(area) over (partition by roi)) / (stddev_pop(area) over (partition by roi) + 1e-6) else (area - 300.0) / 150.0 end as volume_z from st)"


@query("with " + _STATS + " select roi, label, area, round(cz, 6) as cz, round(cy, 6) as cy, round(cx, 6) as cx, z0, y0, x0, z1, y1, x1 from st", ("gt",))
def object_stats(spark, sf):
    return objects.statistics(X.truth(spark, sf)).withColumns({f"c{a}": F.round(f"c{a}", 6) for a in "zyx"})


@query("with " + _STATS + " select roi, label, (z0 = 0 or z1 = 48 or y0 = 0 or y1 = 48 or x0 = 0 or x1 = 48) as border from st", ("gt",))
def border_touch(spark, sf):
    return objects.touching(objects.statistics(X.truth(spark, sf)), (48, 48, 48)).select("roi", "label", "border")


@query("with " + _STATS + ", " + _ZED + " select roi, label, round(volume_z, 6) + 0.0 as volume_z from zs", ("gt",))
def volume_zscore(spark, sf):
    return objects.volume_zscores(objects.statistics(X.truth(spark, sf)), 300).select("roi", "label", (F.round("volume_z", 6) + F.lit(0.0)).alias("volume_z"))


_REASONS = (
    "rs as (select *, concat_ws(';', case when abs(volume_z) > 1.2 then 'volume_zscore' end, case when area < 0.5 * 300 then 'too_small' end, case when area > 2.0 * 300 then 'too_big' end, case when greatest((z1 - z0) * 2.0, y1 - y0, x1 - x0) > 20.0 then 'too_long' end) as reasons from zs)"
)


def _screened(spark, sf):
    return objects.reasons(objects.statistics(X.truth(spark, sf)), 300, z_limit=1.2, too_small=0.5, too_big=2.0, long_um=20.0, voxel=(2.0, 1.0, 1.0))


@query("with " + _STATS + ", " + _ZED + ", " + _REASONS + " select roi, label, reasons from rs", ("gt",))
def object_screen(spark, sf):
    return _screened(spark, sf).select("roi", "label", F.array_join("reasons", ";").alias("reasons"))


@query("with " + _STATS + ", " + _ZED + ", " + _REASONS + " select roi, label, (reasons = '' or (not contains(reasons, 'too_small') and not contains(reasons, 'too_long') and (not contains(reasons, 'volume_zscore') or volume_z > 0))) as accepted from rs", ("gt",))
def accept_policy(spark, sf):
    return objects.accepted(_screened(spark, sf)).select("roi", "label", "accepted")


@query()
def object_solidity(spark, sf):
    t = X.truth(spark, sf)
    return segment.solidity(t, objects.statistics(t), 0.55).select("roi", "label", F.round("solidity", 6).alias("solidity"), "solid")


@query(
    "with z as (select roi, avg(case when v = 0 then 1e0 else 0e0 end) as zero_frac, sum(case when v <> 0 then 1 else 0 end) as n from raw group by roi), m as (select roi, median(v) as mid, quantile_cont(v, 0.99) as p99 from raw where v <> 0 group by roi), "
    "s as (select roi, median(abs(v - mid)) * 1.4826 as sigma from raw join m using (roi) where v <> 0 group by roi) "
    "select roi, any_value(n)::bigint as n, round(any_value(zero_frac), 6) as zero_frac, round(any_value(mid), 6) as median, round(any_value(sigma), 6) as sigma, round(avg(case when v > mid + 2 * sigma then 1e0 else 0e0 end), 6) as fg_frac_k2, round(avg(case when v > mid + 3 * sigma then 1e0 else 0e0 end), 6) as fg_frac_k3, "
    "round(avg(case when v > mid + 5 * sigma then 1e0 else 0e0 end), 6) as fg_frac_k5, round(any_value((p99 - mid) / sigma), 6) as contrast_p99, any_value(n >= 1000) as usable from raw join m using (roi) join s using (roi) join z using (roi) where v <> 0 group by roi",
    ("gt", "raw"),
)
def descriptors(spark, sf):
    d = objects.descriptors(X.raw(spark, sf))
    return d.select("roi", F.col("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("zero_frac", "median", "sigma", "fg_frac_k2", "fg_frac_k3", "fg_frac_k5", "contrast_p99")], "usable")


@query()
def blob_density(spark, sf):
    """Blobs of every tile of the fixtures."""
    t = project.halo_lines(X.raw_lines(spark, sf), TILE, 0)
    return segment.blob_density(t, (TILE,) * 3, 8.0, ("roi", "tz", "ty", "tx")).withColumn("blobs_per_mvox", F.round("blobs_per_mvox", 6))


@query(
    "with " + _STATS + ", g as (select roi, count(*) as n_objects, sum(area)::bigint as labelled, median(area) as median_volume, avg(case when area > 3 * 150 then 1e0 else 0e0 end) as oversized_frac, avg(case when area < 0.2 * 150 then 1e0 else 0e0 end) as tiny_frac, avg(case when z0 = 0 or z1 = 48 or y0 = 0 or y1 = 48 or x0 = 0 or x1 = 48 then 1e0 else 0e0 end) as border_frac from st group by roi) "
    "select r.roi, coalesce(n_objects, 0) as n_objects, round(median_volume, 6) as median_volume, round(oversized_frac, 6) as oversized_frac, round(tiny_frac, 6) as tiny_frac, round(border_frac, 6) as border_frac, round(coalesce(n_objects, 0) / (valid / 1e6), 6) as per_mvox, round(coalesce(labelled, 0) / 110592e0, 6) as labelled_frac, round(case when n_objects > 0 and blobs > 0 then n_objects / blobs end, 6) as ratio_to_blobs "
    "from (select roi, count(*) filter (v > 0) as valid, count(*) filter (v > 4300) as blobs from raw group by roi) r left join g on g.roi = r.roi",
    ("gt", "raw"),
)
def tile_quality(spark, sf):
    """Densities over voxels that aren't padding; bright voxels stand for blobs here, so that SQL can count them (``blob_density`` has the real ones)."""
    rois = X.raw(spark, sf).groupBy("roi").agg(F.count(F.when(F.col("v") > 0, 1)).alias("valid"), F.count(F.when(F.col("v") > 4300, 1)).alias("blobs"))
    q = objects.tile_quality(X.truth(spark, sf), rois, 150, (48, 48, 48))
    return q.select("roi", "n_objects", *[F.round(c, 6).alias(c) for c in ("median_volume", "oversized_frac", "tiny_frac", "border_frac", "per_mvox", "labelled_frac", "ratio_to_blobs")])


@query(
    "with " + _STATS + ", u as (select z1 - z0 as ez, y1 - y0 as ey, x1 - x0 as ex from st where not (z0 = 0 or z1 = 48 or y0 = 0 or y1 = 48 or x0 = 0 or x1 = 48) and (z1 - z0) * (y1 - y0) * (x1 - x0) >= 30), "
    "c20 as (select count(*) as uncut from st where not (z0 = 0 or z1 = 48 or y0 = 0 or y1 = 48 or x0 = 0 or x1 = 48)), e as (select count(*) as n, (select uncut from c20) as uncut, avg(ez) as mz, avg(ey) as my, avg(ex) as mx, median(ez) as dz, median(ey) as dy, median(ex) as dx from u), r as (select 'z' as axis, n, uncut, mz as mean, dz as median, dy, 2.0::double as voxel from e union all select 'y', n, uncut, my, dy, dy, 1.0 from e union all select 'x', n, uncut, mx, dx, dy, 1.0 from e) "
    "select axis, n, round(mean, 6) as mean, round(median, 6) as median, case when uncut >= 20 then round(median * voxel / dy, 6) end as ratio, case when uncut >= 20 then round(dy / median, 6) end as implied_voxel, case when uncut >= 20 then abs(median * voxel / dy - 1) > 0.25 end as doubtful from r",
    ("gt",),
)
def voxel_scale_check(spark, sf):
    s = objects.scale_check(objects.statistics(X.truth(spark, sf)), (48, 48, 48), (2.0, 1.0, 1.0), 30)
    return s.select("axis", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "ratio", "implied_voxel")], "doubtful")


@query("with s as (select l_returnflag as roi, (l_orderkey % 97)::double as seconds from lineitem) select roi, count(*) as n, list_sort(list(seconds))[count(*) // 2 + 1] as upper_median, max(seconds) as slowest, round(sum(seconds) / count(*), 6) as mean from s group by roi")
def timing_summary(spark, sf):
    s = X.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("roi"), (F.col("l_orderkey") % 97).cast("double").alias("seconds"))
    return qc.timings(s).withColumn("mean", F.round("mean", 6))


@query("with g as (select label from gt), p as (select label from pred) select (select count(distinct label) from g) as gt_objects, (select count(distinct label) from p) as pred_objects, (select max(label) from p) as pred_max_id", ("gt", "pred"))
def distinct_objects(spark, sf):
    g = X.truth(spark, sf).agg(F.countDistinct("label").alias("gt_objects"))
    p = X.predicted(spark, sf).agg(F.countDistinct("label").alias("pred_objects"), F.max("label").alias("pred_max_id"))
    return g.join(p)


@query("select event_type, event_id, round(value, 6) as value from events qualify row_number() over (partition by event_type order by value desc, event_id) = 1")
def argmax_row(spark, sf):
    return tune.best_rows(X.table(spark, sf, "events"), "event_type", "value", "event_id").withColumn("value", F.round("value", 6))


# --- scoring ---------------------------------------------------------------------------------------

_PAIRS = (
    "ga as (select roi, label as gt, count(*) as gt_area from gt group by roi, label), pa as (select roi, label as pred, count(*) as pred_area from pred group by roi, label), "
    "cc as (select gt.roi, gt.label as gt, pred.label as pred, count(*) as both_ from gt join pred using (roi, z, y, x) group by gt.roi, gt.label, pred.label), ov as (select cc.roi, cc.gt, cc.pred, both_, gt_area, pred_area, both_ / (gt_area + pred_area - both_) as iou from cc join ga using (roi, gt) join pa using (roi, pred))"
)


def _greedy_sql(least: str, rounds: int = 6) -> str:
    parts = [f"e0 as (select roi, gt, pred, iou from ov where iou >= {least})"]
    for k in range(rounds):
        parts.append(f"b{k} as (select roi, gt, pred, iou from (select *, row_number() over (partition by roi, gt order by iou desc, gt, pred) as ra, row_number() over (partition by roi, pred order by iou desc, gt, pred) as rb from e{k}) where ra = 1 and rb = 1)")
        parts.append(f"e{k + 1} as (select * from e{k} e where not exists (select 1 from b{k} b where b.roi = e.roi and b.gt = e.gt) and not exists (select 1 from b{k} b where b.roi = e.roi and b.pred = e.pred))")
    return ", ".join(parts) + ", mt as (" + " union all ".join(f"select * from b{k}" for k in range(rounds)) + ")"


def _both(spark, sf):
    return X.truth(spark, sf), X.predicted(spark, sf)


@query("with " + _PAIRS + " select roi, gt, pred, both_ as both, gt_area, pred_area, round(iou, 6) as iou from ov", ("gt", "pred"))
def overlap_pairs(spark, sf):
    return score.overlaps(*_both(spark, sf)).withColumn("iou", F.round("iou", 6))


@query("with " + _PAIRS + ", " + _greedy_sql("0.01") + " select roi, gt, pred, round(iou, 6) as iou from mt", ("gt", "pred"))
def iou_greedy(spark, sf):
    return score.greedy(score.overlaps(*_both(spark, sf)), 0.01).select("roi", "gt", "pred", F.round("iou", 6).alias("iou"))


@query("with " + _PAIRS + " select roi, gt, pred, round(iou, 6) as iou from ov where iou > 0.5", ("gt", "pred"))
def iou_unique_match(spark, sf):
    """Above an IoU of 0.5 a match is unique, so it is a filter."""
    return score.overlaps(*_both(spark, sf)).where("iou > 0.5").select("roi", "gt", "pred", F.round("iou", 6).alias("iou"))


@query()
def hungarian_match(spark, sf):
    return score.hungarian(score.overlaps(*_both(spark, sf)), 0.25, 0.25).select("roi", "gt", "pred", F.round("iou", 6).alias("iou"))


_DET = (
    "with " + _PAIRS + ", " + _greedy_sql("0.5") + ", k as (select count(*) as tp, coalesce(avg(iou), 0) as mean_iou, coalesce(median(iou), 0) as median_iou, (select count(*) from (select distinct roi, label from gt)) as n_gt, (select count(*) from (select distinct roi, label from pred)) as n_pred from mt) "
    "select tp, n_pred - tp as fp, n_gt - tp as fn, n_gt, n_pred, n_pred - n_gt as count_error, round(tp / n_pred, 6) as precision, round(tp / n_gt, 6) as recall, round(2 * tp / (n_pred + n_gt), 6) as f1, round(mean_iou, 6) as mean_iou, round(median_iou, 6) as median_iou from k"
)


@query(_DET, ("gt", "pred"))
def detection_metrics(spark, sf):
    g, p = _both(spark, sf)
    d = score.detection(score.greedy(score.overlaps(g, p), 0.5), g, p)
    return d.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "mean_iou", "median_iou")})


@query("with " + _PAIRS + " select (select count(*) from (select roi, gt from ov where both_ >= 0.15 * gt_area group by roi, gt having count(*) >= 2)) as split, (select count(*) from (select roi, pred from ov where both_ >= 0.15 * pred_area group by roi, pred having count(*) >= 2)) as merged", ("gt", "pred"))
def split_merge(spark, sf):
    return score.splits_merges(score.overlaps(*_both(spark, sf)))


_INSTANCE = (
    "with " + _PAIRS + ", " + _greedy_sql("0.01") + ", v as (select coalesce(g.roi, p.roi) as roi, g.label as g, p.label as p from gt g full join pred p on g.roi = p.roi and g.z = p.z and g.y = p.y and g.x = p.x), "
    "ar as (select roi, count(g) as gt_voxels, count(p) as pred_voxels, 2 * count(case when g is not null and p is not null then 1 end) / (count(g) + count(p)) as dice, count(case when g is not null and p is not null then 1 end) / (count(g) + count(p) - count(case when g is not null and p is not null then 1 end)) as semantic_iou from v group by roi), "
    "nn as (select coalesce(a.roi, b.roi) as roi, coalesce(n_gt, 0) as n_gt, coalesce(n_pred, 0) as n_pred from (select roi, max(label) as n_gt from gt group by roi) a full join (select roi, max(label) as n_pred from pred group by roi) b on a.roi = b.roi), "
    "th as (select roi, n_gt, n_pred, threshold, (select count(*) from mt where mt.roi = nn.roi and iou >= threshold) as tp, (select coalesce(sum(iou), 0) from mt where mt.roi = nn.roi and iou >= threshold) as total from nn, (values (0.01::double), (0.5::double)) t(threshold)), "
    "im as (select th.roi, threshold, n_gt, n_pred, tp, n_pred - tp as fp, n_gt - tp as fn, n_pred - n_gt as count_error, abs(n_pred - n_gt) as absolute_count_error, gt_voxels, pred_voxels, round(dice, 6) as dice, round(semantic_iou, 6) as semantic_iou, round(case when n_pred = 0 then 1 else tp / n_pred end, 6) as precision, round(case when n_gt = 0 then 1 else tp / n_gt end, 6) as recall, round(case when n_pred + n_gt = 0 then 1 else 2 * tp / (n_pred + n_gt) end, 6) as f1, "
    "round(case when tp = 0 then 0 else total / tp end, 6) as mean_iou, round(case when n_gt + n_pred = 0 then 1 else total / (tp + 0.5e0 * (n_pred - tp) + 0.5e0 * (n_gt - tp)) end, 6) as panoptic from th join ar using (roi))"
)
_SCORES = ("precision", "recall", "f1", "mean_iou", "panoptic")


def _instance(spark, sf):
    g, p = _both(spark, sf)
    m = score.instance_metrics(score.overlaps(g, p), g, p)
    return m.withColumns({c: F.round(c, 6) for c in ("dice", "semantic_iou", *_SCORES)})


@query(_INSTANCE + " select * from im", ("gt", "pred"))
def instance_metrics(spark, sf):
    return _instance(spark, sf)


@query(_INSTANCE + " select roi, " + ", ".join(f"max(case when threshold = {t} then {c} end) as {c}_{n}" for t, n in (("0.01", "iou001"), ("0.5", "iou05")) for c in ("tp", *_SCORES)) + " from im group by roi", ("gt", "pred"))
def metrics_wide(spark, sf):
    m = _instance(spark, sf).withColumn("suffix", F.when(F.col("threshold") == 0.01, "iou001").otherwise("iou05"))
    w = m.groupBy("roi").pivot("suffix", ["iou001", "iou05"]).agg(*[F.max(c).alias(c) for c in ("tp", *_SCORES)])
    return w.select("roi", *[F.col(f"{n}_{c}").alias(f"{c}_{n}") for n in ("iou001", "iou05") for c in ("tp", *_SCORES)])


@query(_INSTANCE + ", rt as (select s_suppkey as roi, round(s_acctbal, 3) as runtime_seconds from supplier where s_suppkey % 2 = 0) select im.roi, im.f1, im.dice, rt.runtime_seconds from im left join rt on rt.roi = im.roi where threshold = 0.5", ("gt", "pred"))
def score_directory(spark, sf):
    run = X.table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("roi"), F.round("s_acctbal", 3).alias("runtime_seconds"))
    return _instance(spark, sf).where("threshold = 0.5").join(run, "roi", "left").select("roi", "f1", "dice", "runtime_seconds")


@query(_INSTANCE + " select threshold, round(avg(f1), 6) as f1, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(dice), 6) as dice from im group by threshold", ("gt", "pred"))
def region_summary(spark, sf):
    return _instance(spark, sf).groupBy("threshold").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("f1", "precision", "recall", "dice")])


@query(_INSTANCE + " select metric, " + ", ".join(f"round(avg(case when threshold = {t} then value end), 5) as {n}" for t, n in (("0.01", "loose"), ("0.5", "strict"))) + " from (unpivot (select threshold, f1, precision, recall from im) on f1, precision, recall into name metric value value) group by metric", ("gt", "pred"))
def prediction_table(spark, sf):
    m = _instance(spark, sf).unpivot(["threshold"], ["f1", "precision", "recall"], "metric", "value").withColumn("run", F.when(F.col("threshold") == 0.01, "loose").otherwise("strict"))
    w = m.groupBy("metric").pivot("run", ["loose", "strict"]).agg(F.avg("value"))
    return w.select("metric", F.round("loose", 5).alias("loose"), F.round("strict", 5).alias("strict"))


_CENT = "gc as (select roi, label as id, avg(z) as z, avg(y) as y, avg(x) as x from gt group by roi, label), pc as (select roi, label as id, avg(z) as z, avg(y) as y, avg(x) as x from pred group by roi, label)"


@query(
    "with " + _CENT + ", nn as (select a.roi, a.id, min(sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))) as d from gc a join gc b on a.roi = b.roi and a.id <> b.id group by a.roi, a.id), md as (select avg(d) as md from nn), "
    "fo as (select count(*) as found from gc a, md where exists (select 1 from pc b where b.roi = a.roi and sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) <= md)) "
    "select (select count(*) from gc) as n_gt, (select count(*) from pc) as n_pred, round(md, 6) as max_distance, round((select count(*) from pc) / (select count(*) from gc), 6) as count_ratio, round(found / (select count(*) from gc), 6) as detected from md, fo",
    ("gt", "pred"),
)
def centroid_detection(spark, sf):
    g, p = (objects.statistics(d).select("roi", F.col("label").alias("id"), *[F.col(f"c{a}").alias(a) for a in "zyx"]) for d in _both(spark, sf))
    d = score.centroid_detection(g, p)
    return d.select("n_gt", "n_pred", *[F.round(c, 6).alias(c) for c in ("max_distance", "count_ratio", "detected")])


@query(
    "with " + _PAIRS + ", b as (select roi, gt, iou from ov qualify row_number() over (partition by roi, gt order by both_ desc, pred) = 1), c as (select roi, pred, iou from ov qualify row_number() over (partition by roi, pred order by both_ desc, gt) = 1) "
    "select sum(case when iou > 0.8 then 1 else 0 end)::bigint as tp, (select count(*) from ga) - sum(case when iou > 0.8 then 1 else 0 end)::bigint as fn, (select sum(case when iou > 0.8 then 0 else 1 end)::bigint from c) as fp_overlapping from b",
    ("gt", "pred"),
)
def overlap_contingency(spark, sf):
    g, p = _both(spark, sf)
    return score.max_overlap_contingency(score.overlaps(g, p), g)


@query("select roi, round(2 * count(case when g is not null and p is not null then 1 end) / (count(g) + count(p)), 6) as dice from (select coalesce(g.roi, p.roi) as roi, g.label as g, p.label as p from gt g full join pred p on g.roi = p.roi and g.z = p.z and g.y = p.y and g.x = p.x) group by roi", ("gt", "pred"))
def mask_dice(spark, sf):
    return score.mask_dice(*_both(spark, sf)).withColumn("dice", F.round("dice", 6))


@query(
    "with v as (select coalesce(g.roi, p.roi) as roi, coalesce(g.z, p.z) as z, g.label is not null as g, p.label is not null as p from gt g full join pred p on g.roi = p.roi and g.z = p.z and g.y = p.y and g.x = p.x), "
    "c as (select z // 12 as batch, count(case when g and p then 1 end) as tp, count(case when p and not g then 1 end) as fp, count(case when g and not p then 1 end) as fn, count(*) as held from v group by 1), b as (select distinct z // 12 as batch, count(*) over (partition by z // 12) as voxels from rois, ax z0(z), ax y, ax x), d as (select batch, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, voxels - coalesce(held, 0) as tn from b left join c using (batch)) "
    "select round(100 * avg((tp + tn) / (tp + tn + fp + fn)), 6) as accuracy, round(100 * avg(case when tp + fp + fn = 0 then 0 else tp / (tp + fp + fn) end), 6) as jaccard, round(100 * avg(case when tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end), 6) as dice from d",
    ("gt", "pred", "raw"),
)
def pixel_metrics(spark, sf):
    """Batches are runs of twelve slices over all rois, with the voxels that neither mask holds."""
    rois = X.table(spark, sf, "supplier").selectExpr("s_suppkey div 25 as roi").distinct()
    batches = rois.select(F.explode(F.expr("array(0L, 1L, 2L, 3L)")).alias("batch")).groupBy("batch").agg((F.count("*") * 12 * 48 * 48).alias("voxels"))
    m = score.pixel_metrics(*_both(spark, sf), batches, "z div 12")
    return m.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "jaccard", "dice")])
