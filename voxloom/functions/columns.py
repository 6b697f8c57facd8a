"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826
TILE_NAME = r"^(.+)_z(\d+)_y(\d+)_x(\d+)$"


def parse_tile_name(name: Column) -> dict[str, Column]:
    """roi, z, y, x of a tile's name; null where the name has another form."""
    ok = name.rlike(TILE_NAME)
    return {"roi": F.when(ok, F.regexp_extract(name, TILE_NAME, 1))} | {a: F.when(ok, F.regexp_extract(name, TILE_NAME, i).cast("long")) for i, a in enumerate("zyx", 2)}


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a proportion, clipped to [0, 1]; null where n is 0."""
    n = n.cast("double")
    p = F.when(n > 0, hits / n)
    d = 1 + z * z / F.when(n > 0, n)
    mid = (p + z * z / (2 * F.when(n > 0, n))) / d
    half = z * F.sqrt(p * (1 - p) / F.when(n > 0, n) + z * z / (4 * F.when(n > 0, n * n))) / d
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is 0."""
    return F.when(b != 0, a.cast("double") / F.when(b != 0, b)).otherwise(F.lit(otherwise).cast("double"))


def log_distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance of logarithms, values below 1e-6 taken as that."""
    ln = lambda c: F.log(F.greatest(c, F.lit(1e-6)))
    return F.sqrt(sum(((ln(x) - ln(y)) * (ln(x) - ln(y)) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def golden_hue(label: Column) -> Column:
    """Fractional part of label times the golden ratio's conjugate."""
    v = label * F.lit(0.6180339887498949)
    return v - F.floor(v)
