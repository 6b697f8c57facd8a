"""Results that don't depend on how a volume is cut: distances, components and floods, against whole volumes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tiles import dense, rows
from voxloom.operators import exact, graph
from voxloom.operators import kernels as K


def test_envelope_is_the_minimum_of_parabolas():
    r = np.random.default_rng(1)
    f = np.where(r.random((200, 23)) < 0.6, np.inf, r.integers(0, 60, (200, 23)).astype(float))
    f[0], f[1] = np.inf, 0.0
    p = np.arange(23)
    for s in (1.0, 0.528, 2.0):
        want = (f[:, None, :] + ((p[:, None] - p) * s) ** 2).min(axis=2)
        assert np.allclose(K.envelope(f, s), want)


@pytest.mark.parametrize("lines", [8, 64])
def test_distance_of_a_thick_slab(spark, lines):
    mask = np.ones((12, 64, 10), bool)  # thicker than any margin
    mask[3, 0, 4] = mask[11, 63, 0] = False
    v = rows(spark, mask.astype(float)).where("v > 0")
    got = exact.distance(v, mask.shape, (2.0, 1.0, 0.5), lines)
    bg = np.argwhere(~mask) * (2.0, 1.0, 0.5)
    at = np.argwhere(mask)
    want = np.zeros(mask.shape)
    want[mask] = np.sqrt(((at[:, None] * (2.0, 1.0, 0.5) - bg) ** 2).sum(axis=2)).min(axis=1)
    assert np.allclose(dense(got, "distance", mask.shape), want) and want.max() > 30
    full = rows(spark, np.ones((3, 3, 3)))
    assert {x["distance"] for x in exact.distance(full, (3, 3, 3)).collect()} == {float("inf")}
    assert exact.distance(v.limit(0), mask.shape).count() == 0


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_components_over_tiles(spark, connectivity):
    mask = np.random.default_rng(connectivity).random((13, 14, 15)) < {6: 0.33, 18: 0.16, 26: 0.12}[connectivity]
    mask[0:13, 7, 7] = True  # an object over several tiles
    v = rows(spark, mask.astype(float)).where("v > 0")
    want = K.components(mask, connectivity)
    for tile in (4, 64):
        got = dense(graph.numbered(graph.components(v, connectivity, tile)), "label", mask.shape)
        assert np.array_equal(got, want)
    links = exact.border_links(exact.local_components(v, connectivity, 4), connectivity, 4).count()
    assert links < mask.sum()


def slow_flood(height, markers, mask):
    """The rule of the flood, applied to every voxel until nothing changes."""
    state = {tuple(p): (height[tuple(p)], 0, markers[tuple(p)]) for p in np.argwhere(mask & (markers > 0))}
    fixed = set(state)
    cells = [tuple(p) for p in np.argwhere(mask)]
    while True:
        new = {}
        for p in cells:
            if p in fixed:
                new[p] = state[p]
                continue
            near = [state[q] for o in K.neighbours(6) if (q := tuple(np.add(p, o))) in state]
            if near:
                v, k, m = min(near)
                new[p] = (height[p], 0, m) if height[p] > v else (v, k + 1, m)
        if new == state:
            return state
        state = new


@pytest.mark.parametrize("seed", range(4))
def test_flood_follows_its_rule(seed):
    r = np.random.default_rng(seed)
    height = r.integers(0, 4 if seed % 2 else 40, (6, 7, 8)).astype(float)
    mask = r.random(height.shape) < 0.8
    markers = np.where(mask & (r.random(height.shape) < 0.03), r.integers(1, 9, height.shape), 0)
    level, hop, label = K.flood(height, markers, mask)
    want = slow_flood(height, markers, mask)
    assert {tuple(p): (level[tuple(p)], hop[tuple(p)], label[tuple(p)]) for p in np.argwhere(label > 0)} == want


def test_watershed_does_not_depend_on_tiles(spark):
    z, y, x = np.indices((10, 12, 34))
    height = np.round(np.abs(np.sin(x / 5.0)) * 6 + (y - 6) ** 2 / 9 + z / 7, 1)  # basins and plateaus
    mask = (y > 0) & (np.random.default_rng(3).random(height.shape) < 0.95)
    markers = np.zeros(height.shape, np.int64)
    markers[5, 6, 2], markers[5, 6, 31], markers[2, 3, 16] = 4, 2, 9  # one object spans several tiles
    mask[markers > 0] = True
    want = K.flood(height, markers, mask)[2]
    v = rows(spark, height, name="height").join(rows(spark, mask.astype(float), name="m").where("m > 0"), ["roi", "z", "y", "x"], "left_semi")
    v = v.join(rows(spark, markers.astype(float), name="marker").where("marker > 0"), ["roi", "z", "y", "x"], "left")
    for tile in (8, 64):
        got = dense(exact.watershed(v, tile), "label", height.shape)
        assert np.array_equal(got, want)
    assert len({*np.unique(want)} - {0}) == 3 and (want == 4).any(axis=(0, 1)).sum() > 8
    assert exact.watershed(v.where(F.col("marker").isNull()), 8).where("label > 0").count() == 0
    assert exact.watershed(v.limit(0), 8).count() == 0


# --- capped merging ---


def one_pass(boxes, edges, cap):
    box, root = dict(boxes), {k: k for k in boxes}
    find = lambda k: k if root[k] == k else find(root[k])
    for *_, a, b in sorted(edges):
        a, b = find(a), find(b)
        lo, hi = tuple(map(min, box[a][:3], box[b][:3])), tuple(map(max, box[a][3:], box[b][3:]))
        if a != b and max(h - x for h, x in zip(hi, lo, strict=True)) <= cap:
            root[b], box[a] = a, (*lo, *hi)
    return {k: find(k) for k in boxes}


@pytest.mark.parametrize(("most", "chain"), [(10**6, False), (1, True)])
def test_capped_merge_in_rounds_is_one_pass_in_order(spark, most, chain):
    r = np.random.default_rng(most + chain)
    n = 7 if chain else 40
    at = np.stack([np.arange(n) * 3 if chain else r.integers(0, 16, n), *r.integers(0, 4, (2, n))], axis=1)
    boxes = {f"n{i}": (*map(int, p), *map(int, p + r.integers(1, 4, 3))) for i, p in enumerate(at)}
    pairs = [(i, i + 1) for i in range(n - 1)] if chain else [(int(a), int(b)) for a, b in r.integers(0, n, (90, 2)) if a != b]
    edges = [(float(r.integers(0, 6)), float(k), f"n{a}", f"n{b}") for k, (a, b) in enumerate(pairs)]
    b = spark.createDataFrame([(k, *v) for k, v in boxes.items()], ["id", *graph.BOX])
    e = spark.createDataFrame([(a, c, o1, o2) for o1, o2, a, c in edges], "a string, b string, o0 double, o1 double").select("*", *[F.lit(0.0).alias(f"o{k}") for k in range(2, 8)])
    got = {x["id"]: x["root"] for x in graph.capped_merge(e, b, 14.0, most=most).collect()}
    want = one_pass(boxes, edges, 14.0)
    assert got == want and 1 < len(set(want.values())) < n
