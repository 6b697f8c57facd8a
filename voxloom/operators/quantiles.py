"""Exact quantiles of whole columns, without a task that holds all values."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many values between two brackets are few enough to sort in one task.
FEW = 1_000_000
ACCURACY = 2_000


class Quantile(NamedTuple):
    """A quantile (None without values) and how many values there were."""

    value: float | None
    rows: int


def exact_quantiles(df: DataFrame, asked: dict[str, tuple[str, float]], few: int = FEW) -> dict[str, Quantile]:
    """Linearly interpolated quantiles: name to (column, share) -> name to (value, number of non-null values).

    Brackets around each quantile come from mergeable sketches of bounded size, and are made narrower until they hold few values; ranks inside a bracket are exact, as values below it are
    counted.  A bracket of one value needs no sorting.  Only sketches, counts and at most two values for each quantile leave the tasks.
    """
    x = {k: F.col(c).cast("double") for k, (c, _) in asked.items()}
    seen = df.agg(*[f(x[k]).alias(f"{n}_{k}") for k in x for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    rows, bracket = {k: seen[f"n_{k}"] for k in x}, {k: (seen[f"lo_{k}"], seen[f"hi_{k}"]) for k in x}
    below, inside = dict.fromkeys(x, 0), dict(rows)
    rank = {k: asked[k][1] * (rows[k] - 1) for k in x}
    at = lambda k: F.when(x[k].between(*map(F.lit, bracket[k])), x[k])
    while wide := [k for k in x if inside[k] > few and bracket[k][0] < bracket[k][1]]:
        share = {k: [min(1.0, max(0.0, (rank[k] + d - below[k]) / inside[k] + e)) for d, e in ((0, -2 / ACCURACY), (1, 2 / ACCURACY))] for k in wide}
        guess = df.agg(*[F.percentile_approx(at(k), share[k], ACCURACY).alias(k) for k in wide]).first()
        guess = {k: tuple(guess[k]) for k in wide}
        counts = df.agg(*[F.count(F.when(c, 1)).alias(f"{n}_{k}") for k in wide for n, c in (("b", x[k] < guess[k][0]), ("i", x[k].between(*map(F.lit, guess[k]))))]).first()
        for k in wide:
            b, i = counts[f"b_{k}"], counts[f"i_{k}"]
            if b <= int(rank[k]) and int(-(-rank[k] // 1)) < b + i and i < inside[k]:
                bracket[k], below[k], inside[k] = guess[k], b, i
            else:  # no progress: values repeat so often that the bracket is as narrow as it gets; distinct values with counts are few
                few = max(few, inside[k])
    out = {}
    for k in x:
        if not rows[k] or bracket[k][0] == bracket[k][1]:
            out[k] = Quantile(bracket[k][0], rows[k])
            continue
        lo, hi = int(rank[k]), int(-(-rank[k] // 1))
        counted = df.select(at(k).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
        up = counted.selectExpr("v", "c", "sum(c) over (order by v) as up").select("v", (F.col("up") - F.col("c") + below[k]).alias("first"), (F.col("up") + below[k]).alias("after"))
        ends = up.agg(*[F.max(F.when((F.col("first") <= r) & (F.col("after") > r), F.col("v"))).alias(n) for n, r in (("a", lo), ("b", hi))]).first()
        out[k] = Quantile(ends["a"] + (ends["b"] - ends["a"]) * (rank[k] - lo), rows[k])
    return out
