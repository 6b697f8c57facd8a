"""Overlap, matching and scoring of two label volumes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.session import importable
from .graph import component_ids, settled

VOXEL = ["roi", "z", "y", "x"]


def overlaps(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(roi, gt, pred, both, gt_area, pred_area, iou) of every overlapping pair: one join on the voxel, one count.

    Volumes made from few rows look small to the planner, so joins of voxels name the join by shuffle.
    """
    a = gt.groupBy("roi", F.col("label").alias("gt")).agg(F.count("*").alias("gt_area"))
    b = pred.groupBy("roi", F.col("label").alias("pred")).agg(F.count("*").alias("pred_area"))
    c = gt.select(*VOXEL, F.col("label").alias("gt")).join(pred.select(*VOXEL, F.col("label").alias("pred")).hint("merge"), VOXEL).groupBy("roi", "gt", "pred").agg(F.count("*").alias("both"))
    return c.join(a.hint("merge"), ["roi", "gt"]).join(b.hint("merge"), ["roi", "pred"]).select("roi", "gt", "pred", "both", "gt_area", "pred_area", (F.col("both") / (F.col("gt_area") + F.col("pred_area") - F.col("both"))).alias("iou"))


def greedy(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one pairs taken by falling IoU, ties by (gt, pred): pairs that are best on both sides are taken, round by round.

    Greedy is prefix-closed, so one run at the lowest threshold serves the higher ones by a filter.
    """
    left = settled(pairs.where(F.col("iou") >= least))
    taken = None
    order = [F.desc("iou"), F.asc("gt"), F.asc("pred")]
    while left.limit(1).count():
        best = left.withColumn("a", F.row_number().over(Window.partitionBy("roi", "gt").orderBy(*order))).withColumn("b", F.row_number().over(Window.partitionBy("roi", "pred").orderBy(*order)))
        best = settled(best.where("a = 1 and b = 1").drop("a", "b"))
        taken = best if taken is None else taken.unionByName(best)
        left = settled(left.join(best.select("roi", "gt").hint("merge"), ["roi", "gt"], "left_anti").join(best.select("roi", "pred").hint("merge"), ["roi", "pred"], "left_anti"))
    return left if taken is None else taken


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least total cost of a one-to-one assignment (shortest augmenting paths); every row or column of the smaller side is assigned."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = p[j0]
            free = ~used[1:]
            cur = c[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < low[1:])
            low[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, low[1:], np.inf))) + 1
            d = low[j1]
            u[p[used]] += d
            v[used] -= d
            low[~used] -= d
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    out = [(int(p[j]) - 1, j - 1) for j in range(1, m + 1) if p[j]]
    return [(b, a) for a, b in out] if flip else out


def _solved(g: pd.DataFrame) -> pd.DataFrame:
    """The edges (a, b, w) of one component that are in its assignment of largest total."""
    a, b = sorted(g["a"].unique()), sorted(g["b"].unique())
    cost = np.ones((len(a), len(b)))
    ia, ib = {x: i for i, x in enumerate(a)}, {x: i for i, x in enumerate(b)}
    rows = {}
    for k, (x, y, w) in enumerate(zip(g["a"], g["b"], g["w"], strict=True)):
        cost[ia[x], ib[y]] = 1 - w
        rows[ia[x], ib[y]] = k
    return g.iloc[[rows[p] for p in assignment(cost) if p in rows]][["a", "b"]]


#: Components of up to so many edges are assigned in one task each; its matrix has at most 4 million cells then.
GROUP_EDGES = 4_000


def heaviest(edges: DataFrame, epsilon: float = 1e-3, most: int = GROUP_EDGES) -> DataFrame:
    """(a, b): a matching of largest total weight over edges (a, b, w), ids as strings, 0 < w <= 1.

    1. Components of up to ``most`` edges are solved in one task each.
    2. In larger ones, an edge that weighs as much as the heaviest others at its two ends together is in some best matching: whoever leaves it out takes those two at most.  Such edges are taken, with what they touch.
       A node with one edge is then folded into its partner: the partner's other edges are worth what they weigh more, and where it takes none of them it takes the folded one in the end.  Both take components
       apart, round by round; a tree goes entirely.  Then the first step goes on with what is left.
    3. Where neither finds anything, ``auction`` decides the rest by rounds of joins.
    So the total is the largest there is, but for ``epsilon`` for each node of a component that came to step 3.
    """
    importable(edges.sparkSession)
    degree = {f"n{s}": F.count("*").over(Window.partitionBy(s)) for s in "ab"}
    left, folds = settled(edges.select("a", "b", "w").withColumns(degree)), []
    taken = left.where("na = 1 and nb = 1").select("a", "b")  # an edge alone is in every best matching
    left = left.where("na > 1 or nb > 1").select("a", "b", "w")

    def take(more: DataFrame) -> None:
        nonlocal taken
        taken = settled(taken.unionByName(more))

    stuck = False
    while not stuck and left.limit(1).count():
        comp = component_ids(left.select(F.concat(F.lit("a"), "a").alias("a"), F.concat(F.lit("b"), "b").alias("b")))
        of = settled(left.join(comp.where("id like 'a%'").select(F.expr("substr(id, 2)").alias("a"), "component").hint("merge"), "a"))
        small = settled(of.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("component"))
        take(settled(of.join(small.hint("merge"), "component", "left_semi").groupBy("component").applyInPandas(_solved, "a string, b string")))
        left = settled(of.join(small.hint("merge"), "component", "left_anti").select("a", "b", "w"))
        for _ in range(8):
            if not left.limit(1).count():
                break
            top = _dominant(left)
            rest = left.join(top.select("a"), "a", "left_anti").join(top.select("b"), "b", "left_anti")
            leaf, folded = _folded(rest)
            take(top)
            folds.append(leaf)
            if not top.unionByName(leaf).limit(1).count():
                take(auction(left, epsilon))
                stuck = True
                break
            left = folded
    for leaf in reversed(folds):  # the last fold is undone first
        free = leaf.join(taken.select("b"), "b", "left_anti").join(taken.select("a"), "a", "left_anti")
        take(free)
    return taken


def _folded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The heaviest edge to a node with no other, for each partner (a, b), and the edges left with what they are worth beyond it."""
    n = {s: F.count("*").over(Window.partitionBy(s)) for s in "ab"}
    e = settled(edges.withColumns({f"n{s}": c for s, c in n.items()}))
    # An edge alone in its component stays: it is heavy enough to be taken in the next round.
    tips = []
    for hub, tip in (("a", "b"), ("b", "a")):
        w = Window.partitionBy(hub).orderBy(F.desc("w"), tip)
        tips.append(e.where(f"n{tip} = 1 and n{hub} > 1").withColumn("k", F.row_number().over(w)).where("k = 1").select("a", "b", "w", F.lit(hub).alias("hub")))
    leaf = settled(tips[0].unionByName(tips[1]))
    left = e.where("(na > 1) = (nb > 1)").select("a", "b", "w")
    for hub in "ab":
        less = leaf.where(F.col("hub") == hub).select(hub, F.col("w").alias("_less"))
        left = left.join(less, hub, "left").withColumn("w", F.col("w") - F.coalesce("_less", F.lit(0.0))).drop("_less")
    return leaf.select("a", "b"), settled(left.where("w > 0").select("a", "b", "w"))


def _dominant(edges: DataFrame) -> DataFrame:
    """Edges at least as heavy as the heaviest others at both ends together; of two that touch (equal, with no third), the first by (a, b)."""
    e = edges
    for side, other in (("a", "b"), ("b", "a")):
        w = Window.partitionBy(side).orderBy(F.desc("w"), other)
        e = e.withColumns({f"r{side}": F.row_number().over(w), f"n{side}": F.coalesce(F.lead("w").over(w), F.lit(0.0))})
    # Only an edge that is first at both ends can be so heavy, or tie with one that is.
    return settled(e.where("ra = 1 and rb = 1 and w >= na + nb").select("a", "b"))


def auction(edges: DataFrame, epsilon: float = 1e-3, step: float = 5.0) -> DataFrame:
    """(a, b): a matching over edges (a, b, w) whose total is the largest there is, but for ``epsilon`` for each node.

    Nodes bid in rounds of joins.  Each edge is there twice, once from either side, and each node may also have its own twin at weight 0; so everyone can be served, and prices may start anywhere: they are found coarsely first, with
    large raises, then anew from there with raises smaller by ``step``, until they are ``epsilon``.  In a round everyone without a partner bids for what is worth most beyond its price, by the distance to the second
    best and the raise; the highest bid wins, the one who had it goes free.  No task sees more than one node's edges.
    """
    e = edges.select(F.concat(F.lit("a"), "a").alias("a"), F.concat(F.lit("b"), "b").alias("b"), "w")
    twin = lambda x: e.select(F.col(x).alias("bidder"), F.col(x).alias("thing"), F.lit(0.0).alias("w")).distinct()
    offers = e.select(F.col("a").alias("bidder"), F.col("b").alias("thing"), "w").unionByName(e.select(F.col("b").alias("bidder"), F.col("a").alias("thing"), "w"))
    offers = settled(offers.unionByName(twin("a")).unionByName(twin("b")))
    raises = [epsilon]
    while raises[-1] * step < 0.25:
        raises.append(raises[-1] * step)
    held = settled(offers.select("thing", F.lit(0.0).alias("price"), F.lit(None).cast("string").alias("owner")).distinct())
    best = Window.partitionBy("bidder").orderBy(F.desc("value"), F.xxhash64("bidder", "thing"))
    for least in reversed(raises):
        held = settled(held.withColumn("owner", F.lit(None).cast("string")))
        while held.where("owner is null").limit(1).count():
            free = offers.join(held.select(F.col("owner").alias("bidder")).where("bidder is not null"), "bidder", "left_anti")
            worth = free.join(held.select("thing", "price"), "thing").withColumn("value", F.col("w") - F.col("price"))
            worth = worth.withColumns({"k": F.row_number().over(best), "next": F.coalesce(F.lead("value").over(best), F.col("value"))}).where("k = 1")
            bids = worth.select("thing", (F.col("price") + F.col("value") - F.col("next") + least).alias("bid"), "bidder")
            won = bids.groupBy("thing").agg(F.max(F.struct("bid", "bidder")).alias("won"))
            held = held.join(won, "thing", "left").select("thing", F.coalesce("won.bid", "price").alias("price"), F.coalesce("won.bidder", "owner").alias("owner"))
            held = settled(held)
    return settled(held.where("owner like 'a%' and thing like 'b%'").select(F.expr("substr(owner, 2)").alias("a"), F.expr("substr(thing, 2)").alias("b")))


def hungarian(pairs: DataFrame, edge: float = 0.25, least: float = 0.5, epsilon: float = 1e-3, most: int = GROUP_EDGES) -> DataFrame:
    """Matching of largest total IoU over pairs of at least ``edge``, then those of at least ``least``; see ``heaviest``."""
    e = settled(pairs.where(F.col("iou") >= edge))
    node = lambda side: F.concat_ws(":", F.col("roi").cast("string"), F.col(side).cast("string"))
    e = e.withColumns({"a": node("gt"), "b": node("pred")})
    return e.join(heaviest(e.select("a", "b", F.col("iou").alias("w")), epsilon, most).hint("merge"), ["a", "b"]).where(F.col("iou") >= least).select(*pairs.columns)


def detection(matches: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 (0 where undefined), count error, mean and median IoU of matches, over all rois."""
    m = matches.agg(F.count("*").alias("tp"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"), F.coalesce(F.median("iou"), F.lit(0.0)).alias("median_iou"))
    g, p = (d.select("roi", "label").distinct().agg(F.count("*").alias(n)) for d, n in ((gt, "n_gt"), (pred, "n_pred")))
    one = m.join(g).join(p)  # three single rows
    one = one.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})
    return one.withColumns({
        "precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("n_gt")),
        "f1": ratio(2 * F.col("tp"), F.col("n_pred") + F.col("n_gt")), "count_error": F.col("n_pred") - F.col("n_gt"),
    })


def mask_dice(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(roi, dice) of the foregrounds of two label volumes; a roi with neither has no row."""
    g, p = (d.select(*VOXEL, F.lit(1).alias(n)).distinct() for d, n in ((gt, "g"), (pred, "p")))
    both = F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1))
    return g.join(p, VOXEL, "full_outer").groupBy("roi").agg((2 * both / (F.count("g") + F.count("p"))).alias("dice"))


def splits_merges(pairs: DataFrame, share: float = 0.15) -> DataFrame:
    """How many gt objects two predictions each cover by ``share`` of the object, and how many predictions merge two objects."""
    split = pairs.groupBy("roi", "gt").agg(F.sum(F.when(F.col("both") >= share * F.col("gt_area"), 1).otherwise(0)).alias("k")).where("k >= 2").agg(F.count("*").alias("split"))
    merge = pairs.groupBy("roi", "pred").agg(F.sum(F.when(F.col("both") >= share * F.col("pred_area"), 1).otherwise(0)).alias("k")).where("k >= 2").agg(F.count("*").alias("merged"))
    return split.join(merge)


def instance_metrics(pairs: DataFrame, gt: DataFrame, pred: DataFrame, thresholds: tuple[float, ...] = (0.01, 0.5)) -> DataFrame:
    """For each roi and threshold: counts by largest label and their error, foreground voxels, Dice and semantic IoU (1 where both are empty), TP, FP, FN, precision, recall, F1,
    panoptic quality (0/0 is 1), and mean IoU of matches (0 where there is none)."""
    voxels = gt.select(*VOXEL, F.lit(1).alias("g")).join(pred.select(*VOXEL, F.lit(1).alias("p")), VOXEL, "full_outer")
    area = voxels.groupBy("roi").agg(F.count("g").alias("ng"), F.count("p").alias("np"), F.sum(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("both"))
    area = area.select("roi", F.col("ng").alias("gt_voxels"), F.col("np").alias("pred_voxels"), ratio(2 * F.col("both"), F.col("ng") + F.col("np"), 1.0).alias("dice"), ratio(F.col("both"), F.col("ng") + F.col("np") - F.col("both"), 1.0).alias("semantic_iou"))
    n = gt.groupBy("roi").agg(F.max("label").alias("n_gt")).join(pred.groupBy("roi").agg(F.max("label").alias("n_pred")), "roi", "full_outer").na.fill(0)
    taken = greedy(pairs, min(thresholds))
    t = n.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    hit = t.select("roi", "threshold").join(taken.select("roi", "iou"), "roi").where("iou >= threshold").groupBy("roi", "threshold").agg(F.count("*").alias("tp"), F.sum("iou").alias("total"))
    out = t.join(hit, ["roi", "threshold"], "left").na.fill(0, ["tp"]).na.fill(0.0, ["total"]).join(area, "roi")
    out = out.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp"), "count_error": F.col("n_pred") - F.col("n_gt"), "absolute_count_error": F.abs(F.col("n_pred") - F.col("n_gt"))})
    return out.withColumns({
        "precision": ratio(F.col("tp"), F.col("n_pred"), 1.0), "recall": ratio(F.col("tp"), F.col("n_gt"), 1.0), "f1": ratio(2 * F.col("tp"), F.col("n_pred") + F.col("n_gt"), 1.0),
        "mean_iou": ratio(F.col("total"), F.col("tp")), "panoptic": ratio(F.col("total"), F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn"), 1.0),
    }).drop("total")


POINTS = 20_000  # centroids that a task reads


def centroid_detection(gt: DataFrame, pred: DataFrame, max_distance: float | None = None, fallback: float = 10.0) -> DataFrame:
    """Ratio of counts, and share of gt centroids (roi, id, z, y, x) with a prediction within the mean nearest-neighbour spacing of gt.

    Distance joins are equi-joins on grid cells of the distance's size and their neighbours, then refined.
    """
    gt, pred = _gathered(gt), _gathered(pred)
    if max_distance is None:
        near = nearest_spacing(gt).agg(F.avg("d")).first()[0]
        max_distance = float(near) if near is not None else fallback
    hit = within(gt, pred, max_distance).select("roi", "id").distinct().agg(F.count("*").alias("found"))
    n = gt.agg(F.count("*").alias("n_gt")).join(pred.agg(F.count("*").alias("n_pred"))).join(hit)
    return n.select("n_gt", "n_pred", F.lit(max_distance).alias("max_distance"), ratio(F.col("n_pred"), F.col("n_gt"), None).alias("count_ratio"), ratio(F.col("found"), F.col("n_gt"), None).alias("detected"))


def _gathered(points: DataFrame) -> DataFrame:
    """Points made once, as they are read many times, in a task for each ``POINTS`` of them: they are few where the voxels that they come from were many."""
    made = settled(points)
    return made.coalesce(max(1, -(-made.count() // POINTS)))


def _cells(df: DataFrame, size: float, spread: bool) -> DataFrame:
    out = df
    for a in "zyx":
        cell = F.floor(F.col(a) / size)
        out = out.withColumn(f"c{a}", F.explode(F.sequence(cell - 1, cell + 1)) if spread else cell)
    return out


def within(a: DataFrame, b: DataFrame, distance: float) -> DataFrame:
    """Pairs (roi, id, other, d) of points of a and b at most ``distance`` apart."""
    size = max(distance, 1e-9)
    right = _cells(b.select("roi", F.col("id").alias("other"), "z", "y", "x"), size, True).withColumnsRenamed({x: f"o{x}" for x in "zyx"})
    d = F.sqrt(sum((F.col(x) - F.col(f"o{x}")) * (F.col(x) - F.col(f"o{x}")) for x in "zyx"))
    return _cells(a, size, False).join(right.hint("merge"), ["roi", "cz", "cy", "cx"]).withColumn("d", d).where(F.col("d") <= distance).select("roi", "id", "other", "d")


def nearest_spacing(points: DataFrame, size: float = 8.0) -> DataFrame:
    """(roi, id, d): distance to the nearest other point of the roi; cells grow until every point with company has one, however far."""
    out, left = None, points
    many = points.groupBy("roi").agg(F.count("*").alias("n")).where("n > 1").select("roi")
    left = settled(points.join(many.hint("merge"), "roi", "left_semi"))
    while left.limit(1).count():
        near = settled(within(left, points, size).where("id <> other").groupBy("roi", "id").agg(F.min("d").alias("d")))
        out = near if out is None else out.unionByName(near)
        left = settled(left.join(near.hint("merge"), ["roi", "id"], "left_anti"))
        size *= 4
    return out if out is not None else points.select("roi", "id", F.lit(None).cast("double").alias("d")).limit(0)


def max_overlap_contingency(pairs: DataFrame, gt: DataFrame, least: float = 0.8) -> DataFrame:
    """TP, FN, FP where an object counts as found if its most overlapping prediction has IoU above ``least``."""
    best = pairs.groupBy("roi", "gt").agg(F.max(F.struct("both", (-F.col("pred")).alias("p"), "iou"))["iou"].alias("iou"))
    back = pairs.groupBy("roi", "pred").agg(F.max(F.struct("both", (-F.col("gt")).alias("g"), "iou"))["iou"].alias("iou"))
    n = gt.select("roi", "label").distinct().agg(F.count("*").alias("n"))
    tp = best.agg(F.coalesce(F.sum(F.when(F.col("iou") > least, 1).otherwise(0)), F.lit(0)).cast("long").alias("tp"))
    fp = back.agg(F.coalesce(F.sum(F.when(F.col("iou") > least, 0).otherwise(1)), F.lit(0)).cast("long").alias("fp_overlapping"))
    return n.join(tp).join(fp).select("tp", (F.col("n") - F.col("tp")).alias("fn"), "fp_overlapping")


def pixel_metrics(gt: DataFrame, pred: DataFrame, batches: DataFrame, batch: str) -> DataFrame:
    """Accuracy, Jaccard and Dice of masks (voxels of each side) by batch (0 where undefined), averaged over batches, in percent.

    ``batches`` has (batch, voxels) of every batch, those that hold no foreground included: voxels that neither mask holds agree.
    """
    both = gt.select(*VOXEL, F.lit(True).alias("g")).join(pred.select(*VOXEL, F.lit(True).alias("p")), VOXEL, "full_outer").na.fill(False, ["g", "p"])
    c = both.groupBy(F.expr(batch).alias("batch")).agg(*[F.sum(F.when(F.expr(e), 1).otherwise(0)).alias(n) for n, e in (("tp", "g and p"), ("fp", "p and not g"), ("fn", "g and not p"))])
    c = batches.join(c, "batch", "left").na.fill(0, ["tp", "fp", "fn"]).withColumn("tn", F.col("voxels") - F.col("tp") - F.col("fp") - F.col("fn"))
    m = c.select(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"), ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("jaccard"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("dice"))
    return m.agg(*[(100 * F.avg(x)).alias(x) for x in m.columns])
