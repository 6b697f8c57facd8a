"""The workload's rules as numbers worked out by hand from its definitions, not from the operators."""

import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tiles import SHAPE, dense, rows, spheres
from voxloom.operators import kernels as K
from voxloom.operators import masks, objects, qc, segment, tune
from voxloom.operators.quantiles import exact_quantiles
from voxloom.operators.settings import PRESETS, Settings


def test_floor_is_that_of_each_slice(spark):
    r = np.random.default_rng(0)
    a = np.zeros((2, 30, 30))
    for z, level in enumerate((100, 1000)):
        a[z] = level + r.integers(0, 10, (30, 30))
        a[z].flat[:20] += level  # 20 bright voxels on each level
    assert [m.sum() for m in K.slice_mask(a, 90, 1.5)] == [20, 20]
    got = masks.percentile_mask(rows(spark, a), 90, 1.5).groupBy("z").count().collect()
    assert {r["z"]: r["count"] for r in got} == {0: 20, 1: 20}
    # median 4, MAD 2 of 0..9 without zeros: 5 + k * 1.4826 * 2; fewer than 100 positive values have no floor.
    assert K.background_floor(np.repeat(np.arange(10.0), 20), 1.5) == pytest.approx(5 + 1.5 * 1.4826 * 2)
    assert K.background_floor(np.arange(100.0), 1.5) == -np.inf


def test_flat_slices_have_no_local_foreground():
    a = np.full((3, 60, 60), 3000.0)
    a[2, 30, 30] = 9000
    m = K.local_mask(a)
    assert not m[:2].any() and m[2, 30, 30]


def test_blobs_are_counted_over_non_zero_voxels():
    a = spheres([(8, 8, 8), (8, 8, 30), (24, 24, 20)], (32, 32, 40), radius=4)
    a[:, :, 36:] = 0
    n, density = K.blobs(a, 8.0)
    assert n == 3 and density == pytest.approx(3 / (32 * 32 * 36 / 1e6))
    assert K.blobs(np.where(np.arange(8000).reshape(20, 20, 20) < 999, 5.0, 0.0)) is None
    flat = np.zeros((12, 12, 12))
    flat[2:, 2:, 2:] = 7.0  # equal values: one plateau, whose peaks keep their distance
    assert K.blobs(flat, 6.0)[0] >= 0
    p = np.zeros((1, 1, 9), bool)
    p[0, 0, [1, 3, 8]] = True
    assert K.spaced(p, np.array([[[0, 5, 0, 9, 0, 0, 0, 0, 1.0]]]), 2)[:, 2].tolist() == [3, 8]


def test_blob_density_by_tile(spark):
    a = spheres([(8, 8, 8), (8, 8, 30)], (16, 16, 40), radius=4)
    v = rows(spark, a).withColumns({t: (F.floor(F.col(t[1]) / 20) * 20).cast("long") for t in ("tz", "ty", "tx")})
    got = segment.blob_density(v, (20, 20, 20), 8.0, ("roi", "tz", "ty", "tx")).collect()
    assert {r["tx"]: r["n_blobs"] for r in got} == {0: 1, 20: 1}
    assert all(r["blobs_per_mvox"] == pytest.approx(1e6 / (16 * 16 * 20)) for r in got)
    assert segment.blob_density(v.where("x < 2"), (20, 20, 20), 8.0).first()["n_blobs"] is None


def test_masks_are_smoothed_and_otsu_splits():
    m = np.zeros((9, 9, 12), bool)
    m[2:7, 2:7, 2:5] = m[2:7, 2:7, 6:9] = True
    m[4, 4, 11] = True  # a speck: gone after opening
    opened = K.smoothed_mask(m, 1, closing=False)
    assert not opened[4, 4, 11] and not opened[4, 4, 5]
    assert K.smoothed_mask(m, 1)[4, 4, 5] and K.smoothed_mask(m, 0) is m  # closing bridges the gap of one
    assert K.smoothed_mask(np.ones((4, 4, 4), bool), 1).all()
    a = np.where(m, 200.0, 10.0)
    assert np.array_equal(K.otsu_mask(a), m)
    assert K.segment(a, mode="global", min_distance=2, min_voxels=5, smooth_um=0.0)[0].sum() == m.sum()


def test_accepted_in_a_tile_are_those_of_the_relational_screen(spark):
    lab = np.zeros((24, 30, 30), np.int64)
    lab[1:4, 1:4, 1:4] = 1  # too small
    lab[6:16, 6:16, 6:16] = 2
    lab[18:20, 0:30, 0:2] = 3  # too long
    lab[0:9, 18:26, 18:26] = 4
    lab[10:14, 20:24, 20:24] = 5
    lab[20:23, 25, 25:29] = lab[22, 26:29, 25] = 6  # a hook
    s = Settings(nucleus_diameter_vox=10.0, voxel_size=(2.0, 1.0, 1.0), volume_zscore_thresh=1.5, solidity_thresh=0.7, max_extent_um=25.0, min_volume_fraction_of_expected=0.1)
    v = rows(spark, lab, name="label").where("label > 0").withColumn("label", F.col("label").cast("long"))
    for settings in (s, s.with_(accept_big_side_flags=False), s.with_(max_volume_fraction_of_expected=1.0, volume_zscore_thresh=9.0)):
        want = {r["label"] for r in segment.screened(v, settings).where("accepted").collect()}
        assert set(np.unique(K.accepted(lab, settings))) - {0} == want
    assert 1 not in want and 3 not in want and 2 in want


def test_settings_are_those_of_the_workload():
    s = Settings()
    assert round(s.expected_volume) == 1767 and s.kernel()["floor_k"] == 1.5 and s.screen()["too_small"] == 0.2 and s.screen()["long_um"] == 60.0
    assert s.with_(**PRESETS["hippocampus"]).kernel()["bandpass_um"] == (2.0, 8.0)


# --- quality control ---


def test_audit_counts_ok_alone(spark):
    r = qc.audit_result(spark.createDataFrame([("ok",)] * 4 + [(" Minor ",)] * 4 + [("major",)] * 2 + [("",), (None,)], "verdict string")).first()
    # Wilson for 4 of 10: centre (0.4 + 0.19208) / 1.38416, half 1.96 * sqrt(0.024 + 0.009604) / 1.38416.
    assert (r["judged"], r["of"], r["ok"], r["minor"], r["major"], r["ok_frac"]) == (10, 12, 4, 4, 2, 0.4)
    assert r["low"] == pytest.approx(0.1682, abs=1e-4) and r["high"] == pytest.approx(0.6873, abs=1e-4)


def _tiles(spark, rows_):
    fields = "chunk string, roi string, z long, y long, x long, usable boolean, has_output boolean, n_nuclei long, nuclei_per_mvox double, edge_axes int, status string, reasons string, priority int"
    return spark.createDataFrame(rows_, fields)


def test_picks_are_few_over_all_rois(spark):
    grid = [(f"r{r}y{y}x{x}", f"r{r}", 0, y, x, True, True, 5, 5.0 + r + y / 10 + x / 100, (y in (0, 3)) + (x in (0, 3)), "OK", "", 0) for r in range(5) for y in range(4) for x in range(4)]
    grid[5] = (*grid[5][:10], "REVIEW", "tiny_outlier;ratio_outlier", 4)
    grid[70] = (*grid[70][:10], "REVIEW", "no_nuclei_but_signal", 5)
    grid[71] = (*grid[71][:10], "REVIEW", "no_nuclei_but_signal", 5)
    t = _tiles(spark, grid)
    for n in (1, 3, 5, 9):
        picks = {r["chunk"]: r["why"] for r in qc.main_picks(t, n_edge=n).collect()}
        edge = [c for c, w in picks.items() if w == "edge of volume"]
        assert len(edge) == n and len({c[:2] for c in edge}) == min(n, 5)  # spread over rois first
        assert sum(r["edge_axes"] == 2 for r in t.where(F.col("chunk").isin(edge)).collect()) >= 1
        assert sum(w == "random interior" for w in picks.values()) == 3
        assert sum(w.startswith("flagged: ") for w in picks.values()) == sum(grid[k][0] not in edge for k in (70, 71))
    main = qc.main_picks(t)
    detail = {r["chunk"]: r["why"] for r in qc.detail_picks(t, main).collect()}
    names = {r["chunk"] for r in main.collect()}
    assert detail.get(grid[5][0]) == "flagged: tiny_outlier, ratio_outlier" or grid[5][0] in names
    assert detail.get("r4y3x3") == "densest chunk" or "r4y3x3" in names
    assert detail.get("r0y0x0") == "sparsest chunk with nuclei" or "r0y0x0" in names
    only = _tiles(spark, grid[:1])  # the one tile is densest and sparsest: it comes once, and not at all where it was drawn
    assert [r["why"] for r in qc.detail_picks(only, main.where("false")).collect()] == ["densest chunk"]
    assert qc.detail_picks(only, only).count() == 0
    assert qc.main_picks(t.limit(0)).count() == 0


def test_summary_counts(spark):
    t = _tiles(spark, [("a", "r", 0, 0, 0, True, True, 4, 4.0, 0, "OK", "", 0), ("b", "r", 0, 0, 1, True, True, 6, 8.0, 0, "WATCH", "tiny_outlier", 2), ("c", "r", 0, 0, 2, True, False, None, None, 0, "MISSING", "missing_output;unlike_exemplars", 15), ("d", "r", 0, 0, 3, False, True, 9, 90.0, 0, "PADDING", "", 0)])
    got = {(r["section"], r["name"]): (r["place"], r["value"]) for r in qc.summary(t, timings=spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "seconds double")).collect()}
    assert got["total", "median_nuclei_per_mvox"][1] == 6.0  # usable tiles with output only
    assert [got["total", n][1] for n in ("n_chunks", "n_with_output", "coverage", "n_flagged", "n_nuclei_total", "n_unlike")] == [4, 3, 0.75, 2, 19, 1]
    assert got["status", "OK"] == (1, 1) and got["status", "MISSING"] == (4, 1) and ("status", "REVIEW") not in got
    assert got["timing", "median_s"][1] == 3.0


@pytest.mark.parametrize("few", [3, 40, 10**6])
def test_exact_quantiles(spark, few):
    r = np.random.default_rng(7)
    values = {"skewed": np.exp(r.normal(0, 4, 3001)), "ties": r.integers(0, 3, 3001).astype(float), "one": np.full(3001, 2.5), "signed": r.normal(0, 1e-3, 3001) - 5}
    d = spark.createDataFrame([tuple(float(v[i]) for v in values.values()) + (None,) for i in range(3001)], ", ".join(f"{k} double" for k in values) + ", none double").repartition(5)
    for q in (0.5, 0.1, 0.9973):
        got = exact_quantiles(d, {k: (k, q) for k in [*values, "none"]}, few)
        assert got.pop("none") == (None, 0)
        assert all(got[k].value == pytest.approx(np.quantile(v, q), rel=1e-12) and got[k].rows == 3001 for k, v in values.items())


# --- settings by exemplar ---


def test_nearest_exemplar_by_rings_is_that_of_all_pairs(spark):
    r = np.random.default_rng(8)
    ex, qu = np.exp(r.normal(0, 2, (400, 3))), np.exp(r.normal(0, 2.5, (150, 3)))
    ex[1] = ex[0]  # a tie goes to the smaller id
    qu[0], qu[1] = ex[0], 1e9
    frame = lambda a, o: spark.createDataFrame([(o + i, *map(float, v)) for i, v in enumerate(a)], "vec_id long, d0 double, d1 double, d2 double")
    keys = ["d0", "d1", "d2"]
    q = frame(qu, 1000).unionByName(spark.createDataFrame([(5000, None, 1.0, 1.0)], "vec_id long, d0 double, d1 double, d2 double"))
    want = {x["vec_id"]: (x["nearest"], x["matched"]) for x in tune.nearest_exemplar(q, frame(ex, 0), keys).collect()}
    got = {x["vec_id"]: (x["nearest"], x["matched"]) for x in tune.nearest_exemplar(q, frame(ex, 0), keys, few=10).collect()}
    assert got == want and want[1000] == (0, True) and want[5000] == (None, False)
    d = np.sqrt(((np.log(qu)[:, None] - np.log(ex)[None]) ** 2).sum(axis=2))
    assert all(want[1000 + i][0] == k for i, k in enumerate(d.argmin(axis=1)))
    alone = tune.nearest_exemplar(frame(ex, 0), frame(ex, 0), keys, apart=True, few=10).where("nearest = vec_id").count()
    assert alone == 0


def test_config_choice_gives_its_reason(spark):
    t = spark.createDataFrame([("a", True, 1.0, 1.0, 1.0), ("b", False, 1.0, 1.0, 1.0), ("c", True, 9.0, 9.0, 9.0), ("d", False, None, None, None)], "chunk string, usable boolean, fg_frac_k3 double, blobs_per_mvox double, contrast_p99 double")
    ex = spark.createDataFrame([("pfc", 1.1, 1.0, 1.0)], "name string, fg_frac_k3 double, blobs_per_mvox double, contrast_p99 double")
    got = {r["chunk"]: (r["source"], r["reason"]) for r in tune.chosen(t, ex).collect()}
    assert got == {"a": ("exemplar:pfc", "within match distance"), "b": ("global-default", "chunk mostly zero padding"), "c": ("global-default", "nearest example too far away"), "d": ("global-default", "chunk mostly zero padding")}
    assert {r["reason"] for r in tune.chosen(t.where("usable"), ex.limit(0)).collect()} == {"no examples registered"}


def test_best_setting_ties_go_by_matched_objects(spark):
    s = spark.createDataFrame([(1, 0, 0.8, 0.9, 3), (1, 1, 0.8, 0.1, 5), (1, -1, 0.5, 0.5, 1), (2, 0, 0.3, 0.9, 1), (2, 1, 0.7, 0.9, 1), (2, -1, 0.6, 0.9, 1)], "item long, setting long, f1 double, iou double, matched long")
    near = spark.createDataFrame([(2, 1)], "item long, other long")
    got = {r["item"]: r for r in tune.dispatch(s, near, -1).collect()}
    assert got[2]["dispatch"] == 0.7 and got[2]["oracle"] == 0.7  # item 1's best is setting 1: five matched objects against three
    assert got[1]["dispatch"] == 0.5 and got[1]["gap_closed"] == pytest.approx(0.0) and got[1]["shuffled"] == 0.8
    assert tune.mean_gap(tune.dispatch(s, near, -1)).first()["mean_gap"] == pytest.approx(1.0)


# --- sessions ---


def test_operators_run_for_a_caller_elsewhere(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(segment.__file__.rsplit('/voxloom/', 1)[0])!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path / 'w')!r}).getOrCreate()
from voxloom.operators import kernels, segment
v = s.createDataFrame([(0, 0, 0, x, 1.0 + x) for x in range(5)], "roi long, z long, y long, x long, v double")
print("rows", segment.per_tile(v, kernels.local_mask, "m", "long").count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert "rows" in out.stdout, out.stderr[-2000:]
