import pytest
from pyspark.sql import functions as F

from voxloom.operators import graph, masks, objects, project, qc, score
from voxloom.sources import tiles
from voxloom.streaming import tiles as stream


def box(spark, roi, label, z, y, x):
    return spark.createDataFrame([(roi, a, b, c, label) for a in range(*z) for b in range(*y) for c in range(*x)], "roi long, z long, y long, x long, label long")


def test_perfect_and_split_prediction(spark):
    gt = box(spark, 0, 1, (2, 10), (2, 12), (2, 22)).cache()
    one = score.detection(score.greedy(score.overlaps(gt, gt)), gt, gt).first()
    assert one["f1"] == 1.0 and one["mean_iou"] == 1.0
    pred = box(spark, 0, 1, (2, 10), (2, 12), (2, 12)).unionByName(box(spark, 0, 2, (2, 10), (2, 12), (12, 22))).unionByName(box(spark, 0, 3, (20, 24), (20, 24), (20, 24)))
    o = score.overlaps(gt, pred)
    assert score.splits_merges(o).first()["split"] == 1
    assert score.detection(score.greedy(o), gt, pred).first()["fp"] >= 1
    empty = score.detection(score.greedy(score.overlaps(gt.limit(0), gt)), gt.limit(0), gt).first()
    assert (empty["tp"], empty["precision"], empty["recall"]) == (0, 0.0, 0.0)


def test_hungarian_maximises_total_and_greedy_does_not(spark):
    p = spark.createDataFrame([(0, 1, 1, 0.6), (0, 1, 2, 0.5), (0, 2, 1, 0.5)], "roi long, gt long, pred long, iou double")
    assert {(r["gt"], r["pred"]) for r in score.greedy(p, 0.25).collect()} == {(1, 1)}
    assert {(r["gt"], r["pred"]) for r in score.hungarian(p, 0.25, 0.25).collect()} == {(1, 2), (2, 1)}


def test_boundary_object_is_stitched_unless_too_long(spark):
    gt = box(spark, 0, 1, (2, 8), (5, 11), (2, 8))
    t = graph.tiled(gt, 8)
    assert t.select("tz", "ty", "tx", "local").distinct().count() == 2
    for cap, n in ((60.0, 1), (5.0, 2), (0.0, 1)):
        assert graph.global_ids(graph.stitched(t, 8, cap_um=cap)).select("global_id").distinct().count() == n


def test_z_window_and_limits(spark):
    gt = box(spark, 0, 1, (0, 4), (0, 2), (0, 2))
    assert masks.z_window(gt, "1:3", 4).count() == 8 and masks.z_window(gt, ":", 4).count() == 16
    for bad in ("3:2", "0:9"):
        with pytest.raises(ValueError):
            masks.z_window(gt, bad, 4)
    assert masks.drop_small(gt, 16).count() == 16 and masks.drop_small(gt, 17).count() == 0


def test_thresholds_are_strict(spark):
    s = objects.statistics(box(spark, 0, 1, (0, 2), (0, 5), (0, 5)))
    assert objects.reasons(s, 50, too_big=1.0, too_small=1.0, voxel=(1.0, 1.0, 1.0)).first()["reasons"] == []
    assert objects.reasons(s, 49, too_big=1.0, z_limit=9.0).first()["reasons"] == ["too_big"]


def test_names(spark):
    d = spark.createDataFrame([("a_b_z000128_y000000_x000256",), ("junk",)], "name string")
    assert [tuple(r) for r in tiles.parsed(d).select("roi", "z", "y", "x").collect()] == [("a_b", 128, 0, 256)]
    assert tiles.listed(spark, "/nowhere/at/all").count() == 0
    with pytest.raises(ValueError):
        tiles.check_pairs(d, d.limit(1))


def test_deskew_round_trip_and_valid(spark):
    p = spark.createDataFrame([(10.0, 30.0), (100.0, 77.0)], "z double, x double")
    assert all(abs(r["x"] - r["xn"]) < 1e-9 for r in project.native_points(project.deskewed_points(p)).collect())
    v = box(spark, 0, 9, (0, 4), (0, 2), (0, 4)).withColumnRenamed("label", "v")
    d = project.deskew_raw(v, 4, 4)
    assert d.where("valid and v <> 9").count() == 0 and d.where("not valid").count() > 0


def test_audit(spark):
    t = spark.createDataFrame([(f"c{i}", "r", 0, 0, i, True, True, "OK", "") for i in range(40)], "chunk string, roi string, z long, y long, x long, usable boolean, has_output boolean, status string, reasons string")
    s = qc.audit_sample(t)
    assert s.count() == 10 and qc.audit_sample(t, s.limit(3)).count() == 3
    assert qc.audit_result(s).count() == 0
    r = qc.audit_result(spark.createDataFrame([(" OK ",)] * 9 + [("major",)], "verdict string")).first()
    assert 0.59 < r["low"] < 0.61 and 0.98 < r["high"] < 0.99


def test_stream_handles_each_tile_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for part in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(c, 1) for c in part], "chunk string, n long").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        s = stream.tile_stream(spark, src, "chunk string, n long", 1)
        stream.process(s, lambda d: d.withColumn("done", F.lit(True)), out, ck).awaitTermination()
    assert sorted(r["chunk"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    spark.createDataFrame([("c", 9), ("d", 9)], "chunk string, n long").coalesce(1).write.mode("append").parquet(src)
    s = stream.tile_stream(spark, src, "chunk string, n long", 1)
    stream.process(s, lambda d: d.withColumn("done", F.lit(True)), out, ck).awaitTermination()
    assert sorted((r["chunk"], r["n"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1), ("c", 1), ("d", 9)]


def test_missing_neighbours_and_empty(spark):
    m = box(spark, 0, 1, (0, 3), (0, 3), (0, 3)).unionByName(box(spark, 0, 1, (5, 6), (5, 6), (5, 6)))
    c = graph.numbered(graph.components(m, 26))
    assert sorted(r["count"] for r in c.groupBy("label").count().collect()) == [1, 27]
    assert graph.components(m.limit(0)).count() == 0


def test_queries_without_sql_reach_every_roi(spark, monkeypatch):
    from voxloom.plans import queries

    cube = spark.createDataFrame([(roi, z, y, x, 5000 * (roi + 1) if (z, y, x) == (3, 3, 3) else 3000) for roi in (0, 1, 2) for z in range(7) for y in range(7) for x in range(7)], "roi long, z long, y long, x long, v long")
    monkeypatch.setattr(queries.X, "raw", lambda spark, sf: cube)
    monkeypatch.setattr(queries, "SHAPE", (7, 7, 7))  # the declared size of a roi is that of the cube
    got = {(r["roi"], r["z"]): r["total"] for r in queries.top_hat(spark, "").collect()}
    assert got == {(roi, 3): 5000.0 * (roi + 1) - 3000 for roi in (0, 1, 2)}
    seen = []
    real = queries.segment.segmented
    monkeypatch.setattr(queries.segment, "segmented", lambda v, **k: seen.append({r["roi"] for r in v.select("roi").distinct().collect()}) or real(v, **k))
    queries.landscape_variants(spark, "")
    assert seen == [{0, 1, 2}] * 3
