"""Parameter selection: nearest exemplar, overrides, grid ranking, leave-one-out dispatch, rank correlation."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import log_distance, ratio
from ..sources.session import importable
from .kernels import accepted, segment
from ..sources.tiles import lines
from .masks import z_bounds, z_window
from .score import hungarian
from .segment import unpacked
from .settings import Settings
from .shared import settled

LIMIT = 0.75
#: The descriptors that tiles are compared by.
MATCH_KEYS = ("fg_frac_k3", "blobs_per_mvox", "contrast_p99")
#: As many exemplars as are compared with every query at once.
FEW = 1_000


def nearest_exemplar(queries: DataFrame, exemplars: DataFrame, keys: list[str], limit: float = LIMIT, id_col: str = "vec_id", apart: bool = False, few: int = FEW) -> DataFrame:
    """(id, nearest, distance, matched): the exemplar of least log distance, ties to the smaller id; ``apart`` leaves out an exemplar of the query's own id.

    Up to ``few`` exemplars are broadcast.  More are laid out in cells of log space; a query asks its own cell and those around it, and what it finds is final when no farther away than a cell is
    wide.  Queries without such an exemplar go on to cells of twice the width, so each meets about as many exemplars as its neighbourhood holds.
    A query with a null descriptor has no nearest exemplar.
    """
    ex = exemplars.select(F.col(id_col).alias("exemplar"), *[F.col(k).alias(f"e_{k}") for k in keys]).dropna()
    far = log_distance([F.col(k) for k in keys], [F.col(f"e_{k}") for k in keys])
    other = F.col(id_col) != F.col("exemplar") if apart else F.lit(True)
    ask = queries.select(id_col, *keys).dropna()
    best = lambda d: d.groupBy(id_col).agg(F.min(F.struct(far.alias("distance"), "exemplar")).alias("b"))
    if exemplars.limit(few + 1).count() <= few:
        found = best(ask.join(F.broadcast(ex)).where(other))
    else:
        found = _by_rings(ask, settled(ex), keys, id_col, other, best)
    found = found.select(id_col, F.col("b.exemplar").alias("nearest"), F.col("b.distance").alias("distance"))
    return queries.select(id_col).join(found, id_col, "left").withColumn("matched", F.coalesce(F.col("distance") <= limit, F.lit(False)))


def _by_rings(ask: DataFrame, ex: DataFrame, keys: list[str], id_col: str, other: Column, best: Callable[[DataFrame], DataFrame]) -> DataFrame:
    at = lambda c, side: F.floor(F.log(F.greatest(F.col(c).cast("double"), F.lit(1e-6))) / side)
    # Of exemplars with the same descriptors the smallest ids stay: two of them, as one may be the query's own.
    same = Window.partitionBy(*[f"e_{k}" for k in keys]).orderBy("exemplar")
    ex = settled(ex.withColumn("_k", F.row_number().over(same)).where("_k <= 2").drop("_k"))
    ends = ex.agg(*[f(F.log(F.greatest(F.col(f"e_{k}").cast("double"), F.lit(1e-6)))) for k in keys for f in (F.min, F.max)]).first()
    widest = max(hi - lo for lo, hi in zip(ends[::2], ends[1::2], strict=True))
    side, done = max(widest / 2 ** max(1.0, math.log2(ex.count()) / len(keys)), 1e-6), None
    while True:
        around = ex
        for k in keys:
            around = around.withColumn(f"c_{k}", F.explode(F.array(*[at(f"e_{k}", side) + d for d in (-1, 0, 1)])))
        cells = ask
        for k in keys:
            cells = cells.withColumn(f"c_{k}", at(k, side))
        found = best(cells.join(around, [f"c_{k}" for k in keys]).where(other))
        last = side > widest
        # Beyond the widest cell only queries outside the range of all exemplars are left: they are compared with all.
        found = settled(best(ask.join(ex).where(other)) if last else found.where(F.col("b.distance") <= side))
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        ask = settled(ask.join(found.select(id_col), id_col, "left_anti"))
        if not ask.limit(1).count():
            return done
        side *= 2


def chosen(tiles: DataFrame, exemplars: DataFrame, keys: tuple[str, ...] = MATCH_KEYS, limit: float = LIMIT, id_col: str = "chunk", name: str = "name") -> DataFrame:
    """(id, nearest, distance, source, reason): which settings each tile gets, and why.

    A usable tile within ``limit`` of an exemplar takes that exemplar's settings; one farther away, one of padding, or all of them without exemplars, the default ones.
    """
    ex = exemplars.select(F.col(name).alias(id_col), *keys)
    near = nearest_exemplar(tiles.where("usable").select(id_col, *keys), ex, list(keys), limit, id_col)
    out = tiles.select(id_col, "usable").join(near, id_col, "left")
    usable = F.coalesce("usable", F.lit(False))
    source = F.when(F.coalesce("matched", F.lit(False)), F.concat(F.lit("exemplar:"), F.col("nearest").cast("string"))).otherwise("global-default")
    reason = F.when(~usable, "chunk mostly zero padding").when(F.col("nearest").isNull(), "no examples registered").when(F.col("matched"), "within match distance").otherwise("nearest example too far away")
    return out.select(id_col, "nearest", "distance", source.alias("source"), reason.alias("reason"))


def source_tally(choices: DataFrame) -> DataFrame:
    """(source, n), most frequent first."""
    return choices.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def merged_overrides(base: dict, overrides: DataFrame) -> DataFrame:
    """Override columns over base values; a band-pass is off unless the override lists one."""
    out = overrides
    for k, v in base.items():
        given = F.col(k) if k in overrides.columns else F.lit(None)
        out = out.withColumn(k, given if k == "mask_bandpass_um" else F.coalesce(given, F.lit(v)))
    return out


def registered(exemplars: DataFrame, new: DataFrame) -> DataFrame:
    """Exemplars with usable new ones put in, replacing those of the same name."""
    good = new.where("usable").select(exemplars.columns)
    return exemplars.join(good.select("name"), "name", "left_anti").unionByName(good)


def swept(
    raw: DataFrame, gt: DataFrame, settings: DataFrame, shape: tuple[int, int, int], base: Settings = Settings(), memo: DataFrame | None = None, z_range: str = ":", edge: float = 0.25, spread: int = 1,  # noqa: B008
) -> DataFrame:
    """(item, setting, f1, iou, fp, matched) of every tile (roi) of ``raw`` segmented under every row of ``settings``; its *accepted* objects inside ``z_range`` are scored against ``gt``.

    ``settings`` has setting and, as further columns, fields of ``Settings`` to put in place of those of ``base`` (nulls leave them); it is hand-made, at most 10,000 rows.  A tile is read once and segmented
    under all its settings, or ``spread`` times under a part of them each.  Pairs that ``memo``, an earlier result, holds are not computed again.  Matching is of largest total IoU from ``edge`` on.
    """
    importable(raw.sparkSession)
    rows = settings.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 settings")
    grid = {r["setting"]: base.with_(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.asDict().items() if k != "setting" and v is not None}) for r in rows}
    kinds = dict(raw.dtypes)
    # Which pairs are left: settings are literals, and what the memo holds of a tile is one short list.
    done = memo.groupBy(F.col("item").alias("roi")).agg(F.collect_set("setting").alias("done")) if memo is not None else raw.select("roi", F.array().cast("array<long>").alias("done")).limit(0)
    items = raw.select("roi").distinct().join(done.hint("merge"), "roi", "left")
    todo = settled(items.select("roi", F.explode(F.array_except(F.array(*[F.lit(int(k)).cast("long") for k in grid]), F.coalesce("done", F.array().cast("array<long>")))).alias("setting")))
    keys, part = (["roi"], []) if spread == 1 else (["roi", "part"], [F.pmod("setting", F.lit(spread)).cast("long").alias("part")])
    parts = todo.groupBy("roi", *part).agg(F.collect_set("setting").alias("settings"))
    fields = T.StructType.fromDDL(f"roi {kinds['roi']}, setting long, gt long, pred long, both long, gt_area long, pred_area long, n_gt long, n_pred long")
    window, schema = slice(*z_bounds(z_range, shape[0])), to_arrow_schema(fields)

    def run(key: tuple, g: pa.Table, truth: pa.Table) -> pa.Table:
        """Overlaps of a tile's true objects with those found under each setting, and one row without a pair that counts both."""
        if not len(g):
            return schema.empty_table()
        (at, v), (where, own), a, out = unpacked(g), unpacked(truth), np.zeros(shape), []
        a[tuple(at)] = v
        ids, area = np.unique(own, return_counts=True)
        inside = np.all((where >= 0) & (where < np.array(shape)[:, None]), axis=0)
        where, own = tuple(where[:, inside]), own[inside]
        for k in sorted(g["settings"][0].as_py()):
            r = accepted(segment(a, **grid[k].kernel())[1], grid[k])
            found, size = np.unique(r[window][r[window] > 0], return_counts=True)
            hit = r[where]
            pairs, both = np.unique(np.stack((own[hit > 0], hit[hit > 0])), axis=1, return_counts=True)
            n, none = pairs.shape[1], [None]
            out.append({"setting": [k] * (n + 1), "gt": pairs[0].tolist() + none, "pred": pairs[1].tolist() + none, "both": both.tolist() + none, "gt_area": area[np.searchsorted(ids, pairs[0])].tolist() + none, "pred_area": size[np.searchsorted(found, pairs[1])].tolist() + none, "n_gt": [None] * n + [len(ids)], "n_pred": [None] * n + [len(found)]})
        whole = {c: [x for o in out for x in o[c]] for c in out[0]}
        return pa.Table.from_pydict({"roi": [key[0].as_py()] * len(whole["setting"])} | whole, schema=schema)

    runs = (raw if "xs" in raw.columns else lines(raw)).join(parts.hint("merge"), "roi").select(*keys, "z", "y", "xs", "vs", "settings")
    objects = lines(z_window(gt.select("roi", "z", "y", "x", F.col("label").alias("v")), z_range, shape[0]))
    objects = objects if spread == 1 else objects.withColumn("part", F.explode(F.array(*[F.lit(p).cast("long") for p in range(spread)])))
    seen = settled(runs.groupBy(*keys).cogroup(objects.groupBy(*keys)).applyInArrow(run, fields))
    run_of = F.to_json(F.struct("roi", "setting")).alias("roi")
    pairs = seen.where("gt is not null").select(run_of, "gt", "pred", (F.col("both") / (F.col("gt_area") + F.col("pred_area") - F.col("both"))).alias("iou"))
    hit = hungarian(pairs, edge, edge).groupBy("roi").agg(F.count("*").alias("matched"), F.avg("iou").alias("iou"))
    out = seen.where("gt is null").select(F.col("roi").alias("item"), "setting", run_of, "n_gt", "n_pred").join(hit.hint("merge"), "roi", "left").na.fill(0, ["matched"]).na.fill(0.0, ["iou"])
    out = out.select("item", "setting", ratio(2 * F.col("matched"), F.col("n_gt") + F.col("n_pred")).alias("f1"), "iou", (F.col("n_pred") - F.col("matched")).alias("fp"), "matched")
    return out if memo is None else out.unionByName(memo.select(out.columns))


def left_out(scores: DataFrame, described: DataFrame, default: int, keys: tuple[str, ...] = MATCH_KEYS, limit: float = LIMIT) -> DataFrame:
    """Leave-one-out dispatch from a sweep and the descriptors (item, keys) of its tiles: each tile takes the best setting of the nearest other tile."""
    near = nearest_exemplar(described, described, list(keys), limit, "item", apart=True).where("matched")
    return dispatch(scores, near.select("item", F.col("nearest").alias("other")), default)


def ranked(scores: DataFrame, top: int = 10) -> DataFrame:
    """The best settings by falling F1, then IoU, with how many settings are within 0.01 of the best."""
    best = scores.agg(F.max("f1").alias("best"))
    near = scores.join(F.broadcast(best)).withColumn("near", F.col("f1") >= F.col("best") - 0.01)
    flat = near.agg(F.sum(F.when(F.col("near"), 1).otherwise(0)).alias("flatness"))
    return near.join(F.broadcast(flat)).orderBy(F.desc("f1"), F.desc("iou"), "setting").limit(top).select("setting", "f1", "iou", "fp", "near", "flatness")


def conservative(scores: DataFrame) -> DataFrame:
    """Of the settings within 0.01 of the best F1, the one of fewest false positives."""
    best = scores.agg(F.max("f1").alias("best"))
    near = scores.join(F.broadcast(best)).where("f1 >= best - 1e-2")
    return near.orderBy("fp", F.desc("f1"), "setting").limit(1).select("setting", "f1", "iou", "fp")


def dispatch(scores: DataFrame, nearest: DataFrame, default: int) -> DataFrame:
    """Leave one out: F1 of the default setting, of the best own setting, of the nearest other item's best, and the share of the gap closed.

    scores: (item, setting, f1, matched), the best by F1, then by matched objects, then the first; the ``default`` setting is not of the grid that the best are searched in.
    nearest: (item, other), one row for each matched item; unmatched items take the default.
    ``shuffled`` is the mean F1 of the best settings of all other items: dispatch must beat it for the choice of item to matter.
    """
    w = Window.partitionBy("item").orderBy(F.desc("f1"), F.desc("matched"), "setting")
    own = scores.where(F.col("setting") != default).withColumn("k", F.row_number().over(w)).where("k = 1").select("item", F.col("setting").alias("best_setting"), F.col("f1").alias("oracle"))
    glob = scores.where(F.col("setting") == default).select("item", F.col("f1").alias("global"))
    given = nearest.join(own.select(F.col("item").alias("other"), "best_setting"), "other").select("item", F.col("best_setting").alias("setting"))
    disp = given.join(scores, ["item", "setting"]).select("item", F.col("f1").alias("dispatched"))
    # Each item meets the distinct best settings of all, which are few; its own best one counts less the item itself.
    best = own.groupBy("best_setting").agg(F.count("*").alias("n"))
    mixed = scores.join(best, F.col("setting") == F.col("best_setting")).join(own.select("item", F.col("best_setting").alias("mine")), "item").withColumn("n", F.col("n") - F.when(F.col("setting") == F.col("mine"), 1).otherwise(0))
    mixed = mixed.groupBy("item").agg(ratio(F.sum(F.col("f1") * F.col("n")), F.sum("n"), None).alias("shuffled"))
    out = own.select("item", "oracle").join(mixed, "item", "left").join(glob, "item").join(disp, "item", "left").withColumn("matched", F.col("dispatched").isNotNull()).withColumn("dispatch", F.coalesce("dispatched", "global"))
    room = F.col("oracle") - F.col("global")
    return out.select("item", "global", "oracle", "dispatch", "shuffled", "matched", F.when(room > 1e-9, (F.col("dispatch") - F.col("global")) / F.when(room > 1e-9, room)).alias("gap_closed"))


def best_rows(df: DataFrame, group: str, value: str, id_col: str) -> DataFrame:
    """(group, id, value): the row of the largest value of each group, ties to the smaller id; nulls don't count."""
    best = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(id_col)).alias("m"))).alias("b"))
    return best.select(group, (-F.col("b.m")).alias(id_col), F.col("b.v").alias(value))


def compared(scores: DataFrame, preset: int, base: int) -> DataFrame:
    """(item, preset, base, gain): F1 of a preset beside that of the base setting, for items scored under both."""
    one = lambda k, n: scores.where(F.col("setting") == k).select("item", F.col("f1").alias(n))
    return one(preset, "preset").join(one(base, "base"), "item").withColumn("gain", F.col("preset") - F.col("base"))


def mean_gap(dispatched: DataFrame) -> DataFrame:
    """(matched, items, mean_gap): the mean share of the gap closed over matched items only."""
    return dispatched.agg(F.sum(F.when(F.col("matched"), 1).otherwise(0)).alias("matched"), F.count("*").alias("items"), F.avg(F.when(F.col("matched"), F.col("gap_closed"))).alias("mean_gap"))


def spearman(df: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """Rank correlation by group, ties by average rank."""
    out = df
    for c in (a, b):
        w = Window.partitionBy(group).orderBy(c)
        out = out.withColumn(f"_r{c}", F.rank().over(w) + (F.count("*").over(Window.partitionBy(group, c)) - 1) / 2.0)
    return out.groupBy(group).agg(F.corr(f"_r{a}", f"_r{b}").alias("spearman"))
