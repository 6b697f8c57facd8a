"""Resampling and patch inference against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tiles import dense, rows
from voxloom.operators import predict


def test_axis_weights():
    # Two voxels to four: centres at -0.25, 0.25, 0.75, 1.25, the ends mirrored.
    w = np.zeros((4, 2))
    for o, i, v in predict.axis_weights(2, 4):
        w[o, i] = v
    assert np.allclose(w, [[0.75, 0.25], [0.75, 0.25], [0.25, 0.75], [0.25, 0.75]])
    for n, m in ((9, 4), (5, 8), (7, 7), (1, 3), (10, 3)):
        s = np.zeros(m)
        for o, _, v in predict.axis_weights(n, m):
            s[o] += v
        assert np.allclose(s, 1)
    assert [i for _, i, _ in predict.axis_weights(6, 3, 0)] == [1, 3, 5]
    assert [i for _, i, _ in predict.axis_weights(3, 6, 0)] == [0, 0, 1, 1, 2, 2]
    assert predict.new_shape((10, 10, 10), (2.0, 1.0, 1.0), (1.0, 2.0, 1.0)) == (20, 5, 10)
    assert predict.new_shape((10, 10, 10), (1.0, 1.005, 1.0), (1.0, 1.0, 1.0)) == (10, 10, 10)


def test_resampled_volume(spark):
    a = np.random.default_rng(0).random((6, 5, 4))
    want = a
    for axis, (n, m) in enumerate(((6, 4), (5, 9), (4, 4))):
        if n != m:
            w = np.zeros((m, n))
            for o, i, v in predict.axis_weights(n, m):
                w[o, i] = v
            want = np.moveaxis(np.tensordot(w, want, (1, axis)), 0, axis)
    got = predict.resampled(rows(spark, a), a.shape, (4, 9, 4))
    assert np.allclose(dense(got, "v", (4, 9, 4)), want)
    flat = dense(predict.resampled(rows(spark, np.full((6, 5, 4), 3.0)), a.shape, (4, 9, 7)), "v", (4, 9, 7))
    assert np.allclose(flat, 3.0)
    labels = dense(predict.resampled(rows(spark, a), a.shape, (3, 10, 4), 0), "v", (3, 10, 4))
    assert np.array_equal(labels, a[[1, 3, 5]][:, [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]])
    p = predict.mapped_back(spark.createDataFrame([(4.0, 6.0, 8.0)], "z double, y double, x double"), (2.0, 1.0, 4.0), (1.0, 2.0, 4.0)).first()
    assert tuple(p) == (2.0, 12.0, 8.0)
    assert predict.resampled(rows(spark, a).limit(0), a.shape, (3, 3, 3)).count() == 0


def test_patches(spark):
    a = np.random.default_rng(1).random((7, 9, 10)) * 2
    a[0:4, 0:4, 0:4] = 5.0  # a patch that is all foreground counts as empty
    model = lambda p: p / 2
    m = predict.patch_mask(a.astype(np.float32), model, 4, 0.5)
    assert not m[:4, :4, :4].any()
    padded = np.pad(a, [(0, 1), (0, 3), (0, 2)], "linear_ramp")
    want = np.zeros(padded.shape, bool)
    for z in range(0, 8, 4):
        for y in range(0, 12, 4):
            for x in range(0, 12, 4):
                p = padded[z : z + 4, y : y + 4, x : x + 4] / 2 > 0.5
                want[z : z + 4, y : y + 4, x : x + 4] = p & (not p.all())
    assert np.array_equal(m, want[:7, :9, :10])
    # A model that looks at each voxel alone, over patches that overlap: one pass over the whole, but where every patch is constant.
    over = predict.patch_mask(a, model, 4, 0.5, step=2)
    assert np.array_equal(over[4:], (a > 1)[4:]) and not over[:2, :2, :2].any()
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return model

    v = rows(spark, a).repartition(3)
    got = dense(predict.predicted(v, a.shape, load, chunk=6, patch=3).withColumn("v", F.lit(1.0)), "v", a.shape)
    want = np.zeros(a.shape)
    for z in range(0, 7, 6):
        for y in range(0, 9, 6):
            for x in range(0, 10, 6):
                want[z : z + 6, y : y + 6, x : x + 6] = predict.patch_mask(a[z : z + 6, y : y + 6, x : x + 6].astype(np.float32), model, 3, 0.5)
    assert np.array_equal(got, want) and want.any()
    assert 1 <= loads.value <= 8
    assert predict.predicted(v.limit(0), a.shape, load).count() == 0
    with pytest.raises(Exception, match="no such model"):
        predict.predicted(v, a.shape, lambda: (_ for _ in ()).throw(ValueError("no such model")), 6, 3).collect()
