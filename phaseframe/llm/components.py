"""Connected components of an edge table, by alternating stars, without a driver-side or per-group collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm.common import materialize, release


ROWS_A_FILE = 500_000


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over their hashes: equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # u > v
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("m").alias("u"), "v")
    return tied.union(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()


def components(edges: DataFrame, most_files: int | None = None) -> DataFrame:
    """node, component (its smallest node) for all nodes of edges(u, v); u < v is not required.

    Stars shrink every component to a star around its smallest node in a logarithmic number of rounds; each
    round is two aggregations with partial sums and two joins that adaptive execution may split.
    """
    now = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), most_files)
    mark = _mark(now)
    while True:
        # a file for each ROWS_A_FILE edges: few edges shouldn't be spread over as many files as there are partitions
        last, now = now, materialize(_small_star(_large_star(now)).coalesce(1 + mark[0] // ROWS_A_FILE))
        release(last)
        seen = _mark(now)
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select("u", "u").distinct())
