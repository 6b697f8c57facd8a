"""Connected components and stitching of objects across tile faces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import importable
from .exact import border_links, local_components
from .shared import settled


def component_ids(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), by least labels of neighbours and labels of labels.

    Links made of few rows of a table look small to the planner, here and below, so joins name the join by shuffle: none is collected for a broadcast.
    """
    both = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"), F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("id").alias("b"), "component").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.select("id", "component").join(near.hint("merge"), "id").select("id", "component", F.least("component", "near").alias("next"))
        hop = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        step = step.join(hop.hint("merge"), "next").select("id", F.least("next", "far").alias("to"), "component")
        labels = settled(step.select("id", F.col("to").alias("component"), (F.col("to") < F.col("component")).alias("moved")))
    return labels.select("id", "component")


def components(mask: DataFrame, connectivity: int = 26, tile: int = 64) -> DataFrame:
    """(roi, z, y, x, root) of foreground voxels; root is the first voxel of the component in (z, y, x) order.

    Two levels: components inside each tile, then components of those by their links over faces, edges and corners of tiles.  So voxels inside tiles are shuffled once, and links are
    as many as touching pairs of components, not of voxels.
    """
    local = settled(local_components(mask, connectivity, tile))
    ids = component_ids(border_links(local, connectivity, tile))
    out = local.select("roi", "z", "y", "x", F.struct("roi", *[F.col(f"f{a}").alias(a) for a in "zyx"]).alias("id"))
    return out.join(ids.hint("merge"), "id", "left").select("roi", "z", "y", "x", F.coalesce("component", "id").alias("root"))


def numbered(comp: DataFrame) -> DataFrame:
    """Components as labels 1..n inside each roi, in order of their first voxel."""
    n = comp.select("roi", "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy("roi").orderBy("root")).cast("long"))
    return comp.join(n.hint("merge"), ["roi", "root"]).drop("root")


def tiled(labels: DataFrame, size: int) -> DataFrame:
    """Labels cut into tiles: origin (tz, ty, tx) and a label local to each tile, numbered by the old label."""
    t = labels.select("roi", *[(F.floor(F.col(a) / size) * size).cast("long").alias(f"t{a}") for a in "zyx"], "z", "y", "x", "label")
    w = Window.partitionBy("roi", "tz", "ty", "tx").orderBy("label")
    return t.select("roi", "tz", "ty", "tx", "label", "z", "y", "x", F.dense_rank().over(w).cast("long").alias("local"))


KEY = ["roi", "tz", "ty", "tx"]


def faces(tiles: DataFrame, size: int) -> DataFrame:
    """First and last planes of each tile and axis: (key, axis, side 0 first / 1 last, u, v, local); the rest is pruned at the scan."""
    some, planes = F.lit(False), []
    for axis, (a, u, v) in enumerate((("z", "y", "x"), ("y", "z", "x"), ("x", "z", "y"))):
        for side in (0, 1):
            on = (F.col(a) - F.col(f"t{a}")) == (size - 1 if side else 0)
            some = some | on
            planes.append(F.when(on, F.struct(F.lit(axis).alias("axis"), F.lit(side).alias("side"), F.col(u).alias("u"), F.col(v).alias("v"))))
    return tiles.where(some).withColumn("_on", F.explode(F.array_compact(F.array(*planes)))).select(*KEY, "_on.*", "local")


def face_edges(tiles: DataFrame, size: int, least_pixels: int = 10, least_share: float = 0.5) -> DataFrame:
    """Edges between objects of neighbouring tiles: common pixels of the touching planes over the smaller plane area.

    Both pixels of a place where two tiles touch are put under the upper tile, by one grouping in place of joins: where the voxels of a roi lie in one task, none is shuffled.
    """
    f, on = faces(tiles, size), [*KEY, "axis"]
    step = lambda axis: F.when(F.col("axis") == axis, size).otherwise(0)
    lower = F.col("side") == 1
    at = f.select("roi", *[F.when(lower, F.col(f"t{x}") + step(k)).otherwise(F.col(f"t{x}")).alias(f"t{x}") for k, x in enumerate("zyx")], "axis", "u", "v", F.when(lower, F.col("local")).alias("a"), F.when(~lower, F.col("local")).alias("b"))
    at = at.groupBy(*on, "u", "v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    # Plane areas count only where the other tile exists, which the crop to the common size means here.
    area = lambda side: F.count(side).over(Window.partitionBy(*on, side))
    both = at.withColumn("na", area("a")).withColumn("nb", area("b")).where("a is not null and b is not null")
    e = both.groupBy(*on, "a", "b").agg(F.count("*").alias("pixels"), F.first("na").alias("na"), F.first("nb").alias("nb")).withColumn("containment", F.col("pixels") / F.least("na", "nb"))
    e = e.where((F.col("pixels") >= least_pixels) & (F.col("containment") >= least_share)).withColumns({f"a{x}": F.col(f"t{x}") - step(k) for k, x in enumerate("zyx")})
    return e.withColumnsRenamed({"tz": "bz", "ty": "by", "tx": "bx"})


def tile_objects(tiles: DataFrame) -> DataFrame:
    """Statistics of each tile's objects with their node id."""
    s = tiles.groupBy(*KEY, "local").agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s{a}") for a in "zyx"], *[F.min(a).alias(f"{a}0") for a in "zyx"], *[(F.max(a) + 1).alias(f"{a}1") for a in "zyx"])
    return s.withColumn("node", node("tz", "ty", "tx", "local"))


def node(tz: str, ty: str, tx: str, local: str):
    return F.struct(F.col("roi"), F.col(tz).alias("tz"), F.col(ty).alias("ty"), F.col(tx).alias("tx"), F.col(local).alias("local"))


def cap_of(given: float | None, configured: float | None) -> float:
    """The length cap: a value given for the run, else the configuration's unless it is 0 or absent, else 60; a given 0 switches it off."""
    return float(given if given is not None else configured or 60.0)


BOX = [f"{a}{s}" for s in "01" for a in "zyx"]
#: Components of up to so many edges are merged in one task each.
GROUP_EDGES = 50_000


def _too_long(lo: tuple, hi: tuple, cap: float, voxel: tuple[float, float, float]) -> bool:
    return bool(cap) and max((h - x) * v for h, x, v in zip(hi, lo, voxel, strict=True)) > cap


def _merge(cap: float, voxel: tuple[float, float, float]):
    def run(o: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        """The edges of one component in their order: roots are merged unless their common box is too long."""
        box = {r[0]: (tuple(r[1:4]), tuple(r[4:])) for r in o[["id", *BOX]].itertuples(index=False, name=None)}
        root = {k: k for k in box}

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in g.sort_values(ORDER)[["a", "b"]].itertuples(index=False, name=None):
            ra, rb = find(a), find(b)
            if ra == rb:
                continue
            lo, hi = tuple(map(min, box[ra][0], box[rb][0])), tuple(map(max, box[ra][1], box[rb][1]))
            if not _too_long(lo, hi, cap, voxel):
                root[rb], box[ra] = ra, (lo, hi)
        return pd.DataFrame({"id": list(root), "root": [find(k) for k in root]})

    return run


#: The order of edges: falling containment, falling pixels, then tile, axis and labels.
ORDER = [f"o{k}" for k in range(8)]


def capped_merge(edges: DataFrame, boxes: DataFrame, cap: float, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), most: int = GROUP_EDGES) -> DataFrame:
    """(id, root) of every id of ``boxes`` (id, box) after its ``edges`` (a, b, order columns) were merged in order, but where the common box would be longer than ``cap`` (0: no cap).

    1. An edge whose two boxes are too long together is refused now, as boxes only grow.
    2. Components of the edges that are left, of up to ``most`` edges, are merged in one task each.
    3. In larger ones, an edge that is first in order among the edges of both its roots is decided: no earlier one can touch either root.  Such edges share no root, so all of them are decided at once,
       round by round; then the first step goes on with what is left.
    The result is that of one pass over all edges in order.  Rounds of step 3 are as many as edges in rising order hang together in one chain.
    """
    importable(edges.sparkSession)
    order = F.struct(*ORDER)
    roots = settled(boxes.select("id", F.col("id").alias("root")))
    boxes, edges = settled(boxes.select("id", *BOX)), settled(edges.select("a", "b", *ORDER))
    done = None

    def followed(table: DataFrame, moved: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            table = table.join(moved.select(F.col("id").alias(c), F.col("root").alias("_to")).hint("merge"), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        return table

    def fitting(edges: DataFrame, boxes: DataFrame) -> DataFrame:
        two = edges.where("a <> b")
        for side in "ab":
            two = two.join(boxes.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}{c}") for c in BOX]).hint("merge"), side)
        if cap:
            two = two.where(F.greatest(*[(F.greatest(f"a{c}1", f"b{c}1") - F.least(f"a{c}0", f"b{c}0")) * F.lit(float(v)) for c, v in zip("zyx", voxel, strict=True)]) <= cap)
        return two

    while True:
        edges = settled(fitting(edges, boxes).select("a", "b", *ORDER))
        if not edges.limit(1).count():
            return roots if done is None else settled(followed(roots, done, "root"))
        comp, roots = component_ids(edges), settled(roots)
        of = edges.join(comp.withColumnRenamed("id", "a").hint("merge"), "a")
        small = settled(of.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("component"))
        inside = boxes.join(comp.select("id", F.col("component").alias("part")).hint("merge"), "id").join(small.select(F.col("component").alias("part")).hint("merge"), "part", "left_semi")
        merged = settled(inside.groupBy("part").cogroup(of.join(small.hint("merge"), "component", "left_semi").groupBy("component")).applyInPandas(_merge(cap, voxel), "id string, root string"))
        done = merged if done is None else settled(done.unionByName(merged))
        edges = settled(of.join(small.hint("merge"), "component", "left_anti").select("a", "b", *ORDER))
        for _ in range(8):
            if not edges.limit(1).count():
                break
            first = edges.select(F.explode(F.array("a", "b")).alias("id"), order.alias("o")).groupBy("id").agg(F.min("o").alias("first"))
            take = edges.withColumn("o", order)
            for side in "ab":
                take = take.join(first.select(F.col("id").alias(side), F.col("first").alias(f"{side}_first")).hint("merge"), side)
            take = settled(fitting(take.where("o = a_first and o = b_first"), boxes))
            moved = take.select(F.col("b").alias("id"), F.col("a").alias("root"))
            grown = take.select(F.col("a").alias("id"), *[F.least(f"a{c}", f"b{c}").alias(c) if c[1] == "0" else F.greatest(f"a{c}", f"b{c}").alias(c) for c in BOX])
            gone = take.select(F.explode(F.array("a", "b")).alias("id"))
            boxes = settled(boxes.join(gone.hint("merge"), "id", "left_anti").unionByName(grown))
            roots = followed(roots, moved, "root")
            edges = settled(fitting(followed(edges, moved, "a", "b"), boxes).select("a", "b", *ORDER))


def stitched(tiles: DataFrame, size: int, cap_um: float = 60.0, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), least_pixels: int = 10, least_share: float = 0.5, most: int = GROUP_EDGES) -> DataFrame:
    """(roi, tz, ty, tx, local, rz, ry, rx, rlocal): objects merged across faces in order of falling containment, refused where the merged box would be longer than the cap (0: no cap)."""
    e = face_edges(tiles, size, least_pixels, least_share)
    order = [-F.col("containment"), -F.col("pixels"), F.col("az"), F.col("ay"), F.col("ax"), F.col("axis"), F.col("a"), F.col("b")]
    e = settled(e.select(F.to_json(node("az", "ay", "ax", "a")).alias("a"), F.to_json(node("bz", "by", "bx", "b")).alias("b"), *[c.cast("double").alias(n) for c, n in zip(order, ORDER, strict=True)]))
    objects = settled(tile_objects(tiles).withColumn("id", F.to_json("node")))
    linked = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    merged = capped_merge(e, objects.join(linked.hint("merge"), "id", "left_semi"), cap_um, voxel, most)
    roi = dict(tiles.dtypes)["roi"]
    top = F.from_json(F.col("root"), f"roi {roi}, tz long, ty long, tx long, local long")
    out = objects.join(merged.hint("merge"), "id", "left").withColumn("top", F.when(F.col("root").isNull(), F.col("node")).otherwise(top))
    return out.select(*KEY, "local", *[F.col(f"top.t{a}").alias(f"r{a}") for a in "zyx"], F.col("top.local").alias("rlocal"))


def global_ids(merged: DataFrame) -> DataFrame:
    """Adds global_id: continuous over rois, in order of first appearance by (tile, label)."""
    order = F.struct("roi", "tz", "ty", "tx", "local")
    first = merged.groupBy("roi", "rz", "ry", "rx", "rlocal").agg(F.min(order).alias("first"))
    # One row for each merged object; ranks inside rois, shifted by the counts of rois before.
    inside = first.withColumn("k", F.row_number().over(Window.partitionBy("roi").orderBy("first")))
    counts = first.groupBy("roi").agg(F.count("*").alias("n"))
    shift = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("roi").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ids = inside.join(shift.hint("merge"), "roi").select("roi", "rz", "ry", "rx", "rlocal", (F.col("k") + F.col("before")).cast("long").alias("global_id"))
    return merged.join(ids.hint("merge"), ["roi", "rz", "ry", "rx", "rlocal"])


def stitched_objects(tiles: DataFrame, ids: DataFrame, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Count-weighted centroid, box and longest extent of each global object."""
    s = tile_objects(tiles).drop("node").join(ids.select(*KEY, "local", "global_id").hint("merge"), [*KEY, "local"])
    g = s.groupBy("roi", "global_id").agg(F.sum("n").alias("voxel_count"), *[(F.sum(f"s{a}") / F.sum("n")).alias(a) for a in "zyx"], *[F.min(f"{a}0").alias(f"{a}0") for a in "zyx"], *[F.max(f"{a}1").alias(f"{a}1") for a in "zyx"])
    longest = F.greatest(*[(F.col(f"{a}1") - F.col(f"{a}0")) * F.lit(float(v)) for a, v in zip("zyx", voxel, strict=True)])
    return g.withColumn("longest_extent_um", longest).select("roi", "global_id", "z", "y", "x", "voxel_count", "longest_extent_um")
