"""Joins on position without comparing all of a document with itself.

Points (a row's y) meet spans (low to high) in bins of a fixed width: a span is repeated for each
bin that it touches, a point is in one bin, and rows join on their keys and the bin. A pair meets in
the point's bin alone, so no pair comes twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(y: Column, width: float) -> Column:
    return F.floor(y / width).cast("long")


def interval_join(points: DataFrame, spans: DataFrame, keys: tuple[str, ...], y: str, low: str, high: str, width: float = 100.0, more: Column | None = None, how: str = "inner") -> DataFrame:
    """points with the spans (of the same keys) that hold their y: low < y < high; borders are for `more` to decide.

    The spans' columns other than keys must have other names than the points'. `more` is a further
    condition over both. how: inner, left_semi, left_anti or left. Both sides are shuffled: rows that
    come of `explode` are guessed far too small, and a broadcast of them would go through the driver.
    """
    bins = F.explode(F.sequence(bin_of(F.col(low), width), bin_of(F.greatest(F.col(low), F.col(high)), width)))
    s = spans.where(F.col(low).isNotNull() & F.col(high).isNotNull()).withColumn("__bin", bins)
    s = s.select("__bin", *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in spans.columns if c not in keys])
    p = points.withColumn("__at", bin_of(F.col(y), width))
    on = F.col("__at") == F.col("__bin")
    for k in keys:
        on &= F.col(k) == F.col(f"__{k}")
    on &= (F.col(y) >= F.col(low)) & (F.col(y) <= F.col(high))
    if more is not None:
        on &= more
    return p.join(s.hint("merge"), on, how).drop("__at", "__bin", *[f"__{k}" for k in keys])
