"""Matchings of largest total, by components, heavy edges and auctions."""

import random

import numpy as np
import pytest

from voxloom.operators import score


def table(spark, edges):
    return spark.createDataFrame([(f"{a}", f"{b}", float(w)) for a, b, w in edges], "a string, b string, w double")


def total(edges, got):
    w = {(f"{a}", f"{b}"): x for a, b, x in edges}
    pairs = [(r["a"], r["b"]) for r in got.collect()]
    assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
    return sum(w[p] for p in pairs)


def best(edges):
    n, m = 1 + max(a for a, _, _ in edges), 1 + max(b for _, b, _ in edges)
    c = np.ones((n, m))
    for a, b, w in edges:
        c[a, b] = 1 - w
    return sum(1 - c[p] for p in score.assignment(c) if c[p] < 1)


def graph(seed, n, k):
    r = random.Random(seed)
    return sorted({(a, (a + d) % n): round(r.uniform(0.25, 1), 3) for a in range(n) for d in r.sample(range(n), k)}.items())


def ring(n, w):
    """Each a has two partners of equal weight: no edge outweighs its two neighbours."""
    return [(a, b % n, w) for a in range(n) for b in (a, a + 1)]


def test_small_components_and_heavy_edges_give_the_largest_total(spark):
    e = [(a, b, w) for (a, b), w in graph(1, 7, 2)]
    for most in (10_000, 4):
        assert total(e, score.heaviest(table(spark, e), 0.01, most)) == pytest.approx(best(e), abs=0.01 * 14)


def test_a_tree_is_folded(spark, monkeypatch):
    monkeypatch.setattr(score, "auction", None)
    r = random.Random(5)
    side, e = [("a", 0)], []
    for k in range(1, 16):  # each node hangs on an earlier one, on the other side
        up, at = side[r.randrange(len(side))]
        side.append(("b" if up == "a" else "a", k))
        e.append((at, k, round(r.uniform(0.4, 0.6), 3)) if up == "a" else (k, at, round(r.uniform(0.4, 0.6), 3)))
    assert total(e, score.heaviest(table(spark, e), 1e-3, 1)) == pytest.approx(best(e), abs=1e-9)


def test_a_long_chain_is_taken_apart_without_an_auction(spark, monkeypatch):
    monkeypatch.setattr(score, "auction", None)
    r = random.Random(3)
    e = [(k // 2 + k % 2, k // 2, round(r.uniform(0.25, 1), 4)) for k in range(16)]
    assert total(e, score.heaviest(table(spark, e), 1e-3, 4)) == pytest.approx(best(e), abs=1e-9)


def test_a_ring_needs_the_auction_and_is_matched_whole(spark):
    e = ring(3, 0.5)
    assert score._dominant(table(spark, e)).count() == 0
    assert total(e, score.heaviest(table(spark, e), 0.05, 1)) == pytest.approx(1.5, abs=0.05 * 6)


def test_more_bidders_than_things(spark):
    e = [(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.6), (2, 1, 0.6)]
    assert total(e, score.auction(table(spark, e), 0.01)) == pytest.approx(1.1, abs=0.01 * 5)


def test_no_edges(spark):
    assert score.heaviest(table(spark, [])).count() == 0


def test_hungarian_is_the_same_whole_or_in_rounds(spark):
    rows = [(r, a, b, w) for r in (1, 2) for (a, b), w in graph(r, 4, 2)]
    p = spark.createDataFrame(rows, "roi long, gt long, pred long, iou double")
    whole, rounds = (score.hungarian(p, 0.25, 0.25, 0.01, m) for m in (10_000, 4))
    assert rounds.columns == p.columns
    assert sum(r["iou"] for r in whole.collect()) == pytest.approx(sum(r["iou"] for r in rounds.collect()), abs=16 * 0.01)
