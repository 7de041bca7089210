"""Interval joins by bins: an equi-join on bins that both sides touch, then the exact test.

An interval is laid into every bin of `width` that it touches. A pair is kept only in the first bin that
both touch, so none is repeated and no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binned(rows: DataFrame, low: str, high: str, width: int) -> DataFrame:
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], keys: list[str], width: int, strict: bool = False) -> DataFrame:
    """Pairs whose ranges overlap; strict: by more than a shared end. Names other than keys must differ."""
    a, b = binned(left, *left_range, width), binned(right, *right_range, width)
    (l1, l2), (r1, r2) = left_range, right_range
    meets: Column = (F.col(l1) < F.col(r2)) & (F.col(r1) < F.col(l2)) if strict else (F.col(l1) <= F.col(r2)) & (F.col(r1) <= F.col(l2))
    first = F.col("bin") == F.floor(F.greatest(F.col(l1), F.col(r1)) / width)
    return a.join(b, [*keys, "bin"]).where(meets & first).drop("bin")


def overlap_anti(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], keys: list[str], ids: list[str], width: int) -> DataFrame:
    """Rows of left whose range meets no range of right."""
    met = overlap_join(left.select(*keys, *ids, *left_range), right.select(*keys, *right_range), left_range, right_range, keys, width).select(*keys, *ids).distinct()
    return left.join(met, [*keys, *ids], "left_anti")
