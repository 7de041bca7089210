"""Windows, islands and orders over fragments and sites."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.operators.ranks import ranked


def block_windows(sites: DataFrame, length: int, density: float = 0.0005) -> DataFrame:
    """contig, block_id, l_site, r_site: overlapping windows of about `length` bases over irregular sites.

    The recurrence is sequential along a contig, so each contig's positions (not its reads) are one group.
    """

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("site")
        positions, names = group["pos"].tolist(), group["site"].tolist()
        rows = [(group["contig"].iloc[0], k, names[a], names[b]) for k, (a, b) in enumerate(split_ranges(positions, length, density))]
        return pd.DataFrame(rows, columns=["contig", "block_id", "l_site", "r_site"])

    kind = sites.schema["contig"].dataType.simpleString()
    return sites.groupBy("contig").applyInPandas(walk, f"contig {kind}, block_id int, l_site int, r_site int")


def split_ranges(positions: list[int], length: int, density: float) -> list[tuple[int, int]]:
    """Index ranges of windows: a new one starts about a third of a length before the last one's end."""
    out: list[tuple[int, int]] = []
    start, resume, last = 0, None, len(positions) - 1
    for i, position in enumerate(positions):
        reach = position - positions[start]
        if i == last:
            out.append((start, last))
            break
        if resume is None and reach > length - length // 3:
            resume = i
        if reach > length:
            if (i - start) / length > density:
                out.append((start, i - 1))
            far = resume + 1 <= last and positions[resume] + length < positions[resume + 1]
            start, resume = (resume if far else resume + 1), None
    return out


def fragment_order(frags: DataFrame) -> DataFrame:
    """Rank of each fragment in its contig: by first site, longest first, then id. No task has all of a contig."""
    return ranked(frags, ["contig"], [F.asc("first_site"), F.desc("last_site"), F.asc("frag_id")])


def split_gaps(frags: DataFrame, *keys: str) -> DataFrame:
    """frags with piece: a part breaks where a fragment starts after all before it have ended."""
    order = Window.partitionBy(*keys).orderBy("first_site", F.desc("last_site"), "frag_id")
    reach = F.max("last_site").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("first_site") > F.col("reach"), 1).otherwise(0)
    return frags.withColumn("reach", reach).withColumn("break", starts).withColumn("piece", F.sum("break").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("reach", "break")


def split_gaps_within(frags: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """frags(l_site, r_site: the range of their part) with piece, and keys, piece, l_site, r_site of the pieces.

    A part breaks where a fragment starts after all before it have ended, if the last site reached lies within the part's
    range but not at its end; a piece ends at the site reached, the next one begins after it, the first and the last one
    have the ends of the part. A fragment that starts a piece is in it.
    """
    order = Window.partitionBy(*keys).orderBy("first_site", F.desc("last_site"), "frag_id")
    reach = F.max("last_site").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when((F.col("first_site") > F.col("reach")) & (F.col("reach") >= F.col("l_site")) & (F.col("reach") < F.col("r_site")), F.col("reach"))
    marked = frags.withColumn("reach", reach).withColumn("cut", cut)
    placed = marked.withColumn("piece", F.count("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = placed.groupBy(*keys, "piece").agg(F.max("cut").alias("cut"), F.first("l_site").alias("l"), F.first("r_site").alias("r"))
    following = F.lead("cut").over(Window.partitionBy(*keys).orderBy("piece"))
    ranges = pieces.select(*keys, "piece", F.coalesce(F.col("cut") + 1, F.col("l")).cast("int").alias("l_site"), F.coalesce(following, F.col("r")).cast("int").alias("r_site"))
    return placed.drop("reach", "cut", "l_site", "r_site"), ranges


def runs(obs: DataFrame, *keys: str) -> DataFrame:
    """Runs of consecutive sites of a fragment as (start, alleles)."""
    island = obs.withColumn("run", F.col("site") - F.row_number().over(Window.partitionBy(*keys).orderBy("site")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site", "allele"))), lambda x: x["allele"].cast("string")), "")
    return island.groupBy(*keys, "run").agg(F.min("site").alias("start"), joined.alias("alleles")).drop("run")


def coverage_breaks(obs: DataFrame, reach: int, *keys: str) -> DataFrame:
    """Sites of a group with others within `reach` before them but none within reach after."""
    order = Window.partitionBy(*keys).orderBy("site")
    sites = obs.select(*keys, "site").distinct()
    before, after = F.count("*").over(order.rangeBetween(-reach + 1, -1)), F.count("*").over(order.rangeBetween(1, reach))
    return sites.withColumn("before", before).withColumn("after", after).where("before > 0 and after = 0").select(*keys, "site")


def merge_segments(segments: DataFrame, *keys: str) -> DataFrame:
    """keys, l_site, r_site: ranges after neighbouring segments of uneven depth have been joined.

    segments: keys, l_site (of the whole), r_site (of the whole), cut (the site after which the segment ends, null for
    the last one), n_reads. A cut goes where one side holds more than 95 % of both sides' reads, or at or before l_site.
    """
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("cut"))
    share = F.col("n_reads") / (F.col("n_reads") + F.lead("n_reads").over(order))
    left = segments.withColumn("share", share).where(F.col("cut").isNull() | ((F.col("cut") > F.col("l_site")) & (F.col("share") <= 0.95) & (F.col("share") >= 0.05)))
    return left.select(*keys, F.coalesce(F.lag("cut").over(order), F.col("l_site")).alias("l_site"), F.coalesce("cut", "r_site").alias("r_site"))
