"""Rectangles as four columns x0, y0, x1, y1 with a name prefix, or as structs with these fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area(p: str = "") -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.col(f"{p}x1") - F.col(f"{p}x0")) * F.greatest(zero, F.col(f"{p}y1") - F.col(f"{p}y0"))


def overlaps(a: str, b: str) -> Column:
    """A common area that is not empty: touching edges do not count, empty rectangles never do; null sides never do."""
    c = lambda p, k: F.col(f"{p}{k}")
    real = (c(a, "x1") > c(a, "x0")) & (c(a, "y1") > c(a, "y0")) & (c(b, "x1") > c(b, "x0")) & (c(b, "y1") > c(b, "y0"))
    return real & (c(a, "x0") < c(b, "x1")) & (c(b, "x0") < c(a, "x1")) & (c(a, "y0") < c(b, "y1")) & (c(b, "y0") < c(a, "y1"))


def without_regions(rows: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """The rows (key, x0..y1) that overlap no region (key, x0..y1): an anti join on the key and the overlap test."""
    sides = ("x0", "y0", "x1", "y1")
    right = regions.select(*(F.col(k).alias(f"__k_{k}") for k in key), *(F.col(s).alias(f"__r_{s}") for s in sides))
    left = rows.withColumns({f"__l_{s}": F.col(s) for s in sides})
    same = overlaps("__l_", "__r_")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(right, same, "left_anti").select(*rows.columns)


def segment_kind(op: str = "op", long: float = 25.0, flat: float = 1.0, thin: float = 1.2) -> Column:
    """'h', 'v' or null of a drawing item with columns x1, y1, x2, y2."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    line, rect = F.col(op) == "l", F.col(op) == "re"
    return (
        F.when(line & (dx >= long) & (dy <= flat), "h").when(line & (dy >= long) & (dx <= flat), "v").when(rect & (dy <= thin) & (dx >= long), "h").when(rect & (dx <= thin) & (dy >= long), "v")
    )
