"""Raw volumes are made by roi: what groups, cuts or filters the voxels of a roi shuffles none of them."""

import numpy as np
from pyspark.sql import functions as F

from tests.oracle import SF
from voxloom.sources import fixtures as X

LARGE = "/root/testdata/sf0.1"  # several tasks, so that plans shuffle where they must


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_spheres_only(df) -> bool:
    """Whether spheres are dealt out by roi, and nothing else is shuffled, joined or written in between."""
    p = plan(df)
    return p.count("Exchange") == p.count("REPARTITION_BY_NUM") == 1 and p.count("FileScan") == 1 and "Join" not in p


def test_raw_voxels_are_made_where_their_roi_is(spark):
    assert shuffles_spheres_only(X.raw(spark, LARGE)) and shuffles_spheres_only(X.raw_lines(spark, LARGE).groupBy("roi", "z", "y").count())


def test_raw_follows_its_definition_for_repeated_and_negative_keys(spark, tmp_path):
    keys = [-60, -3, 0, 7, 7, 8, 1000049, 1000050]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {(r["roi"], r["z"], r["y"]): r["vs"] for r in X.raw_lines(spark, str(tmp_path)).collect()}
    quotient = lambda a, b: int(a / b)  # noqa: E731  towards 0, as div and % of Spark are
    rest = lambda a, b: a - b * quotient(a, b)
    z, y, x = np.indices((48, 48, 48))
    for roi in {quotient(k, 25) for k in keys}:
        nearest = np.full(z.shape, 10**6)
        for k in keys:
            if quotient(k, 25) == roi:
                d2, r = sum((i - rest(p * k, 40) - 4) ** 2 for i, p in ((z, 7), (y, 13), (x, 29))), 3 + rest(k, 4)
                nearest = np.where(d2 <= r * r, np.minimum(nearest, d2), nearest)
        noise = np.fmod(z * 7919 + y * 104729 + x * 1299709 + roi * 15485863, 601) + 3000
        want = np.where(x >= 46, 0, noise + np.where(nearest < 10**6, 1500 - 40 * nearest, 0))
        assert np.array_equal(np.array([[got[roi, a, b] for b in range(48)] for a in range(48)]), want)
    assert len(got) == 48 * 48 * len({quotient(k, 25) for k in keys})


def test_slices_find_their_level_without_a_join(spark):
    from voxloom.plans.queries import QUERIES

    assert shuffles_spheres_only(QUERIES["slice_percentile_mask"](spark, LARGE).select("roi", F.col("n"), "s"))


def test_medians_copy_lines_to_tiles_and_no_voxel_to_its_neighbours(spark):
    from voxloom.operators import masks
    from voxloom.plans.queries import QUERIES

    assert shuffles_spheres_only(masks.median_filter(X.raw_lines(spark, LARGE), masks.offsets(26), 24, (48, 48, 48)))
    assert "Generate explode(array(struct" not in plan(QUERIES["denoise_median"](spark, LARGE))
    rng = np.random.default_rng(4)
    a = {tuple(map(int, p)): int(rng.integers(-9, 9)) for p in np.argwhere(rng.random((5, 6, 9)) < 0.7)}
    v = spark.createDataFrame([("a", *p, k) for p, k in a.items()], "roi string, z long, y long, x long, v long")
    offs = masks.offsets(18)
    want = {p: float(np.median([k for o in [(0, 0, 0), *offs] if (k := a.get(tuple(np.add(p, o).tolist()))) is not None])) for p in a}
    for tile in (3, 64):
        assert {(r["z"], r["y"], r["x"]): r["median"] for r in masks.median_filter(v, offs, tile).collect()} == want


def test_faces_meet_where_their_roi_is_and_stitching_broadcasts_nothing(spark):
    from voxloom.operators import graph
    from voxloom.plans.queries import QUERIES

    assert shuffles_spheres_only(graph.face_edges(graph.tiled(X.truth(spark, LARGE), 24), 24))
    for name in ("stitch_relabel", "stitched_objects", "stitch_capped"):
        assert "Broadcast" not in plan(QUERIES[name](spark, LARGE))


def test_band_passed_values_are_compared_where_they_are_made(spark):
    from voxloom.plans.queries import QUERIES

    p = plan(QUERIES["bandpass_mask"](spark, LARGE))
    assert p.count("FileScan") == 1 and "Join" not in p  # neither written in between nor joined with their level


def test_peaks_shuffle_no_copies_of_candidates(spark):
    from voxloom.operators import masks

    offs = [(0, 0, 0), (0, 0, 1), (0, 1, 0), (-1, 0, 2)]  # not symmetric
    assert shuffles_spheres_only(masks.peaks(X.raw(spark, LARGE), 3900, offs))
    rng = np.random.default_rng(6)
    a = {tuple(map(int, p)): int(rng.integers(0, 9)) for p in np.argwhere(rng.random((5, 6, 9)) < 0.7)}
    v = spark.createDataFrame([("a", *p, k) for p, k in a.items()], "roi string, z long, y long, x long, v long")
    want = {p for p, k in a.items() if k > 3 and all(a.get(tuple(np.add(p, o).tolist()), 0) <= k for o in offs)}
    assert {(r["z"], r["y"], r["x"]) for r in masks.peaks(v, 3, offs).collect()} == want


def test_resampled_voxels_are_summed_where_their_roi_is(spark):
    from voxloom.plans import queries_qc  # noqa: F401
    from voxloom.plans.queries import QUERIES

    p = plan(QUERIES["resample"](spark, LARGE))
    assert p.count("Exchange hashpartitioning") == p.count("REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in p


def test_sweeps_read_lines_and_overlap_objects_where_they_are_found(spark):
    from voxloom.operators import tune
    from voxloom.plans.queries import SHAPE, SMALL

    s = spark.createDataFrame([(0, 85.0), (1, 92.0)], "setting long, target_foreground_percentile double")
    got = [sorted(map(tuple, tune.swept(v, X.truth(spark, SF), s, SHAPE, SMALL, z_range="2:46").collect())) for v in (X.raw_lines(spark, SF), X.raw(spark, SF))]
    assert got[0] == got[1] and len(got[0]) == 2 * X.raw(spark, SF).select("roi").distinct().count()


def test_descriptors_make_their_volume_once(spark):
    from voxloom.operators import objects

    d = objects.descriptors(X.raw(spark, LARGE))
    assert "FileScan" not in plan(d) and "Broadcast" not in plan(d)


def test_edges_alone_are_matched_without_a_search_for_components(spark, monkeypatch):
    from voxloom.operators import score

    seen = []
    real = score.component_ids
    monkeypatch.setattr(score, "component_ids", lambda links: seen.append(links.count()) or real(links))
    alone = [("1", "1", 0.3), ("2", "2", 0.9)]
    chain = [("3", "3", 0.5), ("3", "4", 0.8), ("4", "4", 0.5)]
    e = lambda rows: spark.createDataFrame(rows, "a string, b string, w double")
    assert sorted(map(tuple, score.heaviest(e(alone)).collect())) == [("1", "1"), ("2", "2")] and seen == []
    assert sorted(map(tuple, score.heaviest(e(alone + chain)).collect())) == [("1", "1"), ("2", "2"), ("3", "3"), ("4", "4")] and seen == [3]


def test_tiled_segmentation_deals_out_objects_not_voxels(spark, monkeypatch):
    from voxloom.operators import segment
    from voxloom.plans.queries import SHAPE, SMALL

    kept = []
    real = segment.settled
    monkeypatch.setattr(segment, "settled", lambda d: kept.append(real(d)) or kept[-1])
    labels, found = segment.tiled_segmentation(X.raw_lines(spark, SF), SHAPE, 24, 12, SMALL)
    n = found.count()
    assert [d.count() for d in kept[:2]] == [n, n] and "z" not in kept[0].columns  # a row for each object of each block
    assert found.agg(F.sum("area")).first()[0] == kept[0].agg(F.sum(F.size("voxels"))).first()[0]
    assert found.where("solid != coalesce(solidity >= 0.55, true)").count() == 0 and labels.select("roi", "z", "y", "x").distinct().count() == labels.count()
