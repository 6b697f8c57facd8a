"""Kernels by tile against whole volumes, tiled segmentation, scoring by the reference's rules, files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import graph, masks, objects, project, score, segment, tune
from voxloom.operators import kernels as K
from voxloom.operators.settings import Settings
from voxloom.sources import files, session

SHAPE = (20, 24, 28)


def rows(spark, a, roi=0, name="v"):
    at = np.argwhere(np.ones(a.shape, bool))
    return spark.createDataFrame([(roi, *map(int, p), float(a[tuple(p)])) for p in at], f"roi long, z long, y long, x long, {name} double")


def dense(df, name, shape=SHAPE):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r[name]
    return out


def spheres(centres, shape, radius=4, height=900, seed=1):
    z, y, x = np.indices(shape)
    a = np.random.default_rng(seed).integers(100, 140, shape).astype(float)
    for c in centres:
        d2 = (z - c[0]) ** 2 + (y - c[1]) ** 2 + (x - c[2]) ** 2
        a += np.where(d2 <= radius**2, height - 20 * d2, 0)
    return a


@pytest.mark.parametrize(
    ("kernel", "margin"),
    [(lambda a: K.gaussian(a, (1.0, 1.5, 1.5)), 6), (lambda a: K.top_hat(a, 2), 4), (lambda a: a * K.peaks(a, a > 200, [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]), 1), (lambda a: K.denoise(a, "median3", (1, 1, 1)), 1), (lambda a: K.local_mask(a, 7).astype(float), (0, 4, 4))],
)
def test_kernels_by_tile_equal_those_over_the_whole(spark, kernel, margin):
    a = spheres([(5, 5, 5), (10, 11, 12), (15, 19, 20)], SHAPE)
    v = rows(spark, a)
    got = dense(segment.per_tile(v, kernel, "r", "double", tile=8, margin=margin, shape=SHAPE), "r")
    assert np.allclose(got, kernel(a))


def test_sparse_tiles_keep_their_shape(spark):
    v = spark.createDataFrame([(0, 3, 4, 5, 1.0)], "roi long, z long, y long, x long, v double")
    got = segment.per_tile(v, lambda a: np.full(a.shape, a.size, float), "r", "double", shape=(6, 7, 8))
    assert got.count() == 6 * 7 * 8 and got.first()["r"] == 6 * 7 * 8


def test_an_object_cut_by_tiles_is_found_once(spark):
    centres = [(8, 8, 8), (8, 12, 20), (15, 18, 10)]  # the first lies on a corner of eight tiles
    shape = (24, 24, 28)
    v = rows(spark, spheres(centres, shape))
    # The floor keeps noise out of slices without objects.
    config = Settings(nucleus_diameter_vox=7.9, voxel_size=(1.0, 1.0, 1.0), target_foreground_percentile=70.0, background_floor_sigma=6.0, min_seed_distance=3, seed_prominence=0.0, seed_landscape_smooth_um=1.0, min_object_voxels=60, volume_zscore_thresh=9.0, min_volume_fraction_of_expected=0.5)
    labels, found = segment.tiled_segmentation(v, shape, 8, 8, config)
    o = objects.statistics(labels.withColumnRenamed("gid", "label")).collect()
    assert sorted((round(r["cz"]), round(r["cy"]), round(r["cx"])) for r in o) == sorted(centres)
    assert found.where("gid is not null and not accepted").count() == 0 and found.where("gid is not null").count() == 3
    part = segment.tiled_segmentation(v.where("x < 9"), (24, 24, 28), 8, 8, config.with_(min_volume_fraction_of_expected=0.9))[1]
    assert part.where("array_contains(reasons, 'too_small') and accepted").count() == 0


def test_kernel_definitions():
    r = np.random.default_rng(3)
    a = r.integers(0, 50, (9, 10, 11)).astype(float)
    for offs in (K.sphere_offsets(2.5, (2.0, 1.0, 1.0)), [(0, 0, 1), (1, 0, 0)], [(0, 0, -2), (0, 0, 2)]):
        want = a.copy()
        for o in offs:
            want = np.maximum(want, K.shifted(a, o, -np.inf))
        assert np.array_equal(K.footprint_max(a, offs), want)
    mask = r.random((7, 8, 9)) < 0.8
    inside = np.argwhere(~mask)
    d = K.distance(mask, (2.0, 1.0, 0.5))
    assert all(np.isclose(d[tuple(p)], np.sqrt((((inside - p) * (2.0, 1.0, 0.5)) ** 2).sum(axis=1).min())) for p in np.argwhere(mask))
    assert np.isinf(K.distance(np.ones((3, 3, 3), bool))).all()
    for seed in range(20):
        p = np.argwhere(np.random.default_rng(seed).random((6, 6, 6)) < 0.1 + 0.04 * seed)
        exact = len(p) / K.hull_volume(p.astype(float))
        assert not K.projections_clear(p, exact + 0.02)
    assert K.projections_clear(np.argwhere(np.ones((8, 8, 8), bool)), 0.8)
    assert K.ramp_padded(np.ones((3, 4, 5)), 4).shape == (4, 4, 8) and not K.without_constant(np.ones((2, 2, 2)), 0.5).any()
    assert np.array_equal(K.denoise(a, "none", (1, 1, 1)), a) and (K.denoise(a, "gauss_inplane=1+bgsub=2", (1, 1, 1)) >= 0).all()
    with pytest.raises(ValueError):
        K.denoise(a, "none+median3", (1, 1, 1))


def label(spark, cells):
    return spark.createDataFrame([(roi, 0, 0, x, n) for roi, xs, n in cells for x in xs], "roi long, z long, y long, x long, label long")


def test_counts_are_largest_labels_and_no_match_has_iou_0(spark):
    gt = label(spark, [(0, range(4), 2), (0, range(10, 14), 9), (1, range(3), 1)])
    pred = label(spark, [(0, range(4), 7), (1, range(5, 8), 4)])
    m = {(r["roi"], r["threshold"]): r for r in score.instance_metrics(score.overlaps(gt, pred), gt, pred).collect()}
    a, b = m[0, 0.5], m[1, 0.5]
    assert (a["n_gt"], a["n_pred"], a["tp"], a["fp"], a["fn"], a["count_error"], a["absolute_count_error"], a["gt_voxels"], a["pred_voxels"], a["mean_iou"]) == (9, 7, 1, 6, 8, -2, 2, 8, 4, 1.0)
    assert (b["tp"], b["mean_iou"], b["panoptic"], b["dice"]) == (0, 0.0, 0.0, 0.0)
    batches = spark.createDataFrame([(0, 20), (1, 10)], "batch long, voxels long")
    p = score.pixel_metrics(gt.where("roi = 0"), pred.where("roi = 0"), batches, "z div 12").first()
    assert p["accuracy"] == pytest.approx(100 * (16 / 20 + 1) / 2) and p["jaccard"] == pytest.approx(100 * 0.5 / 2)


def test_far_points_have_a_spacing(spark):
    p = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 0.0, 0.0, 5e7), (1, 3, 0.0, 0.0, 0.0)], "roi long, id long, z double, y double, x double")
    assert {(r["id"], r["d"]) for r in score.nearest_spacing(p).collect()} == {(1, 5e7), (2, 5e7)}


def test_sweep_uses_its_memo(spark):
    a = spheres([(6, 6, 6), (12, 16, 18)], SHAPE)
    v, z = rows(spark, a), np.indices(SHAPE)
    gt = np.zeros(SHAPE)
    for n, c in enumerate([(6, 6, 6), (12, 16, 18)], 1):
        gt[sum((i - k) ** 2 for i, k in zip(z, c, strict=True)) <= 16] = n
    g = rows(spark, gt, name="label").where("label > 0").withColumn("label", F.col("label").cast("long"))
    s = spark.createDataFrame([(0, 96.0, 3), (1, 20.0, 3), (2, 96.0, 3)], "setting long, target_foreground_percentile double, min_seed_distance int")
    s = s.withColumn("volume_zscore_thresh", F.when(F.col("setting") == 2, F.lit(0.0)))  # two objects of equal size: none is odd
    base = Settings(nucleus_diameter_vox=7.9, voxel_size=(1.0, 1.0, 1.0), background_floor_sigma=0.0, seed_prominence=0.0, seed_landscape_smooth_um=1.0, min_object_voxels=20, volume_zscore_thresh=9.0)
    first = tune.swept(v, g, s.where("setting = 0"), SHAPE, base).cache()
    assert first.first()["f1"] == 1.0 and first.first()["matched"] == 2
    memo = first.withColumn("f1", F.lit(0.123))
    both = {r["setting"]: r["f1"] for r in tune.swept(v, g, s, SHAPE, base, memo, spread=2).collect()}
    assert both[0] == 0.123 and set(both) == {0, 1, 2}
    # Scored are accepted objects inside the window: a screen that accepts nothing finds nothing, and a window over one sphere has one object.
    strict = base.with_(solidity_thresh=1.1)
    assert tune.swept(v, g, s.where("setting = 0"), SHAPE, strict).first()["matched"] == 0
    half = tune.swept(v, g, s.where("setting = 0"), SHAPE, base, z_range="0:8").first()
    assert (half["matched"], half["f1"]) == (1, 1.0)


def test_files_and_small_rules(spark, tmp_path):
    d = spark.createDataFrame([(1, 0.5, ["a", "b"]), (2, None, [])], "id long, x double, reasons array<string>")
    files.write_csv(d, str(tmp_path / "c"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), "id long, x double, reasons string").orderBy("id").collect()][0] == (1, 0.5, "a;b")
    files.write_csv(d.limit(0), str(tmp_path / "e"))
    assert any("id,x,reasons" in f.read_text() for f in (tmp_path / "e").glob("*.csv")) and files.read_csv(spark, str(tmp_path / "e"), "id long").count() == 0
    files.write_json(d, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), "id long, x double, reasons array<string>").where("x is null").first()["id"] == 2
    (tmp_path / "m.json").write_text('[{"name": "a",\n "gt": 3}, {"name": "b"}]')
    assert files.read_json(spark, str(tmp_path / "m.json"), "name string, gt long", whole=True).count() == 2
    assert [graph.cap_of(*x) for x in ((None, None), (None, 0), (None, 40), (0, 40), (5, 40))] == [60.0, 60.0, 40.0, 0.0, 5.0]
    t = spark.createDataFrame([(0, 0, 0, 0, 1, 1, 1, 2)], "roi long, tz long, ty long, tx long, z long, y long, x long, local long")
    assert project.mosaic(t, t).count() == 1
    with pytest.warns(UserWarning):
        project.mosaic(t, t.unionByName(t.withColumn("tx", F.lit(8).cast("long"))))
    with pytest.raises(FileNotFoundError):
        project.mosaic(t.limit(0), t)
    m = spark.createDataFrame([(0, z, y, x) for z in range(3) for y in range(3) for x in range(3) if (z, y, x) != (1, 1, 1)], "roi long, z long, y long, x long")
    assert masks.closed(m, 1).count() == 27 and masks.closed(m, 0).count() == 26
    import sys
    import zipfile

    path = session.archive(str(tmp_path))
    assert "voxloom/operators/kernels.py" in zipfile.ZipFile(path).namelist() and path not in sys.path
