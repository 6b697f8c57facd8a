"""Tables of a few rows that make many voxels: who makes them, and that no side of a voxel join is collected for a broadcast."""

from pyspark.sql import functions as F

from voxloom.sources import fixtures as X

SF = "/root/testdata/sf0.1"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_voxels_of_spheres_are_made_by_many_tasks(spark):
    n = [r["count"] for r in X.truth(spark, SF).groupBy(F.spark_partition_id()).count().collect()]
    assert len(n) == 4 and max(n) < sum(n) / 2


def test_raw_volumes_broadcast_nothing(spark):
    r = X.raw(spark, SF)
    assert "Broadcast" not in plan(r)
    n = [r["count"] for r in r.groupBy(F.spark_partition_id()).count().collect()]
    assert len(n) == 4 and sum(n) == 40 * 48**3 and max(n) < sum(n) / 2


def test_joins_of_voxels_broadcast_no_volume(spark):
    from voxloom.operators import masks, project, score

    gt, pred, raw = X.truth(spark, SF), X.predicted(spark, SF), X.raw(spark, SF)
    assert "Broadcast" not in plan(score.overlaps(gt, pred))
    assert "Broadcast" not in plan(project.brightest_label(raw, gt))
    assert "Broadcast" not in plan(masks.peaks(raw, 3900, [(0, 0, 1), (0, 0, -1)]))
    assert "Broadcast" not in plan(masks.drop_small(gt, 200))
    assert "Broadcast" not in plan(masks.renumbered(gt, 200))


def test_levels_of_rois_meet_voxels_by_shuffle(spark):
    from voxloom.operators import masks, objects

    raw = X.raw(spark, SF)
    assert "Broadcast" not in plan(objects.descriptors(raw))
    assert "Broadcast" not in plan(masks.stretched(raw))
    assert "Broadcast" not in plan(masks.otsu_mask(raw))


def test_peaks_read_the_volume_for_candidates_only(spark):
    v = spark.createDataFrame([(0, 0, 0, 0, 5), (0, 0, 0, 1, 9), (0, 0, 0, 3, 5), (0, 0, 0, 4, 4), (0, 0, 0, 6, 3)], "roi int, z int, y int, x int, v int")
    from voxloom.operators import masks

    assert sorted(r["x"] for r in masks.peaks(v, 3, [(0, 0, 1), (0, 0, -1)]).collect()) == [1, 3]


def test_halo_pieces_meet_their_objects_by_shuffle(spark):
    from voxloom.plans.queries import QUERIES

    assert "BuildLeft" not in plan(QUERIES["halo_assemble"](spark, SF))


def test_audit_size_draws_a_twentieth_and_twenty_at_least(spark):
    from voxloom.plans.queries import QUERIES
    from voxloom.plans import queries_qc  # noqa: F401

    one = QUERIES["audit_size"](spark, "/root/testdata/sf0.001").first()
    assert one["pool"] > 20 and one["n"] == max(20, -(-one["pool"] // 20))


def test_median_filter_reads_its_volume_once(spark):
    from voxloom.operators import masks

    m = masks.median_filter(X.raw(spark, SF), masks.offsets(6))
    assert "Broadcast" not in plan(m) and plan(m).count("FileScan") == plan(X.raw(spark, SF)).count("FileScan")
    v = spark.createDataFrame([(0, 0, 0, 0, 5), (0, 0, 0, 1, 9), (0, 0, 0, 3, 5)], "roi int, z int, y int, x int, v int")
    assert sorted((r["x"], r["median"]) for r in masks.median_filter(v, [(0, 0, 1), (0, 0, -1)]).collect()) == [(0, 7.0), (1, 7.0), (3, 5.0)]


def test_lines_of_raw_volumes_hold_the_voxels_of_raw(spark):
    sf = "/root/testdata/sf0.001"
    lines = X.raw_lines(spark, sf)
    assert "Broadcast" not in plan(lines)
    back = lines.select("roi", "z", "y", F.inline(F.arrays_zip("xs", "vs"))).withColumnsRenamed({"xs": "x", "vs": "v"})
    raw = X.raw(spark, sf)
    assert back.count() == raw.count() and not back.exceptAll(raw).count()


def test_kernels_by_tile_copy_lines_not_voxels(spark):
    from voxloom.operators import segment

    raw = X.raw(spark, "/root/testdata/sf0.001")
    for voxels in (raw, X.raw_lines(spark, "/root/testdata/sf0.001")):
        blocks = segment._blocks(voxels, 24, 7, (48, 48, 48))[0]
        assert blocks.count() * 5 < raw.count()


def test_lines_and_voxels_make_the_same_blocks(spark):
    import numpy as np
    from voxloom.operators import project, segment
    from voxloom.sources import tiles

    rng = np.random.default_rng(3)
    rows = [("a", *map(int, p), int(rng.integers(1, 99))) for p in np.argwhere(rng.random((9, 10, 23)) < 0.2) if not 4 <= p[2] < 15]  # nothing lies in the middle
    v = spark.createDataFrame(rows, "roi string, z long, y long, x long, v long")
    kept = {r["tx"] for r in project.halo(v, 4, 2).select("tx").distinct().collect()}
    both = [segment.per_tile(d, lambda a: np.full(a.shape, a.sum()), "s", keep_zero=True, tile=4, margin=2, shape=(9, 10, 23)) for d in (v, tiles.lines(v), tiles.lines(v, size=4))]
    one = sorted(map(tuple, both[0].collect()))
    assert {x // 4 * 4 for _, _, _, x, _ in one} == {t for t in kept if 0 <= t < 23}  # a tile without voxels in reach has no block
    assert all(sorted(map(tuple, b.collect())) == one for b in both[1:])
    box = lambda z, y, x: sum(r[4] for r in rows if all(t - 2 <= c < t + 6 for c, t in zip(r[1:4], (z // 4 * 4, y // 4 * 4, x // 4 * 4), strict=True)))
    assert all(s == box(z, y, x) for _, z, y, x, s in one[::97])


def test_objects_of_tiles_meet_their_voxels_by_shuffle(spark):
    from voxloom.operators import segment
    from voxloom.plans.queries import SMALL

    labels, found = segment.tiled_segmentation(X.raw_lines(spark, "/root/testdata/sf0.001"), (48, 48, 48), 24, 12, SMALL)
    assert "BroadcastHashJoin" not in plan(labels) and "BroadcastHashJoin" not in plan(found)


def test_banks_read_their_volume_once(spark):
    from voxloom.plans.queries import QUERIES

    once = plan(X.raw_lines(spark, SF)).count("FileScan")
    for name in ("denoise_bank", "landscape_variants"):
        assert plan(QUERIES[name](spark, SF)).count("FileScan") == once


def test_deskewed_volumes_are_neither_collected_nor_shuffled(spark):
    from voxloom.plans.queries import QUERIES

    p = plan(QUERIES["deskew_volume"](spark, SF))
    assert "Broadcast" not in p and "hashpartitioning(roi" in p
    assert not [x for x in p.splitlines() if "Exchange hashpartitioning" in x and "ENSURE" in x and "x#" in x.split("ENSURE")[0]]  # the shares of voxels meet where their line is


def test_voxels_of_a_roi_are_counted_and_cut_without_a_shuffle(spark):
    from voxloom.operators import graph, masks, objects, project
    from voxloom.sources import tiles

    t = X.truth(spark, SF)
    blobs = tiles.to_blobs(t.select("roi", "z", "y", "x", F.col("label").alias("v")), 24)
    for d in (objects.statistics(t), masks.drop_small(t, 200), graph.tiled(t, 24), graph.faces(graph.tiled(t, 24), 24), project.splat(t, 30.0, 24.0), blobs, objects.volume_zscores(objects.statistics(t), 300)):
        p = plan(d)
        assert p.count("Exchange") == p.count("REPARTITION_BY_NUM") == 1 and p.count("FileScan") == 1 and "Join" not in p


def test_predicted_spheres_split_however_large_their_keys(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (7, 12, 200007, 200012)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(50,), (150,), (157,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    found = {r["label"] for r in X.predicted(spark, str(tmp_path)).select("label").distinct().collect()}
    assert found == {8, 100008, 13, 200008, 300008, 200013, 200050, 200150}


def test_centroids_are_made_once_before_they_are_searched(spark):
    from voxloom.operators import objects, score

    sf = "/root/testdata/sf0.001"
    g, p = (objects.statistics(d).select("roi", F.col("label").alias("id"), *[F.col(f"c{a}").alias(a) for a in "zyx"]) for d in (X.truth(spark, sf), X.predicted(spark, sf)))
    assert "FileScan" not in plan(score.centroid_detection(g, p))
    assert score._gathered(g).rdd.getNumPartitions() == 1
    assert "BroadcastHashJoin" not in plan(score.within(g, p, 9.0))


def test_no_task_holds_the_slopes_of_all_objects(spark):
    import numpy as np
    from voxloom.operators import objects

    rng = np.random.default_rng(5)
    rows = [(k % 3, int(z), 0, int(x), k) for k in range(9) for z, x in rng.integers(0, 20, (30, 2))]
    t = spark.createDataFrame(rows, "roi long, z long, y long, x long, label long")
    for kept in (t, t.where("label < 8"), t.where("label < 0")):
        r = objects.residual_shear(kept, 30)
        assert "percentile(" not in plan(r)
        slopes = [np.cov(p.T, bias=True)[0, 1] / np.var(p[:, 0]) for k in range(9) if len(p := np.array([(v[1], v[3]) for v in kept.collect() if v[4] == k]))]
        got = r.first()
        assert got["objects"] == len(slopes)
        if slopes:
            assert np.allclose([got["mean"], got["median"], got["sem"]], [np.mean(slopes), np.median(slopes), np.std(slopes) / len(slopes) ** 0.5])
        else:
            assert got["mean"] is None and got["median"] is None
