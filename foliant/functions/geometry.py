"""Rectangle arithmetic on columns (left, top, right, bottom; y upwards)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(left: Column, right: Column) -> Column:
    return right - left


def height(top: Column, bottom: Column) -> Column:
    return top - bottom


def center(a: Column, b: Column) -> Column:
    return (a + b) / 2.0


def vertical_gap(top_a: Column, bottom_a: Column, top_b: Column, bottom_b: Column) -> Column:
    """Distance between two rectangles; negative: how far they overlap."""
    return F.when(bottom_a > top_b, bottom_a - top_b).when(bottom_b > top_a, bottom_b - top_a).otherwise(-(F.least(top_a, top_b) - F.greatest(bottom_a, bottom_b)))


def union_of(prefix: str = "") -> list[Column]:
    """Aggregates for the smallest rectangle around a group's."""
    return [F.min(f"{prefix}left").alias("left"), F.max(f"{prefix}top").alias("top"), F.max(f"{prefix}right").alias("right"), F.min(f"{prefix}bottom").alias("bottom")]


def overlaps(a: str, b: str) -> Column:
    """Open-interval intersection of the rectangles with column prefixes ``a`` and ``b``."""
    c = F.col
    return (c(f"{a}left") < c(f"{b}right")) & (c(f"{a}right") > c(f"{b}left")) & (c(f"{a}bottom") < c(f"{b}top")) & (c(f"{a}top") > c(f"{b}bottom"))


def path_type(w: Column, h: Column) -> Column:
    return F.when((h < 2) & (w > 5), "Horizontal").when((w < 2) & (h > 5), "Vertical").when((w > 5) & (h > 5), "Rectangle").otherwise("Other")
