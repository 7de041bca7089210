"""Columns of the genome: what alignments cover, every so-manieth covered base, and the bases that reads have there.

Positions are chosen before any read is laid out base by base. Covered bases are counted in cells of CELL bases, each
cell by itself, and a contig's cells are summed up by their totals; a read meets the few columns of the small cells that
it touches as an array, and only at those columns a base is taken from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.operators.filters import REJECTED, SECONDARY
from phaseframe.operators.pileup import indexed_quantile
from phaseframe.plans.storage import kept
from phaseframe.sources.files import read_places, reference_length

CELL = 1 << 16


def primary_spans(alignments: DataFrame) -> DataFrame:
    """alignments with `end` (the last base covered), without secondary, unmapped, duplicate and failed records and those
    without bases. Any mapping quality will do."""
    fine = F.col("flags").bitwiseAND(REJECTED | SECONDARY) == 0
    # a test of `end` itself would be pushed below it, and the CIGAR would be read again for it
    spans = alignments.where(fine & (F.col("cigar") != "*") & ~F.col("seq").isin("*", "") & F.col("cigar").rlike("[1-9][0-9]*[MDN=X]"))
    return spans.withColumn("end", F.col("pos") + reference_length("cigar") - 1)


def in_cells(spans: DataFrame, width: int) -> DataFrame:
    """spans with the cells that they touch."""
    return spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor(F.col("end") / width))))


def covered_runs(spans: DataFrame) -> DataFrame:
    """contig, start, n, ordinal: runs of covered bases, each base in one run; ordinal: covered bases of the contig before it.

    A cell has at most CELL different starts, however deep it is covered.
    """
    low, high = F.greatest("pos", F.col("cell") * CELL), F.least("end", F.col("cell") * CELL + CELL - 1)
    tops = in_cells(spans.select("contig", "pos", "end"), CELL).groupBy("contig", "cell", low.alias("low")).agg(F.max(high).alias("high"))
    order = Window.partitionBy("contig", "cell").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest("low", F.coalesce(F.max("high").over(order) + 1, F.col("low")))
    runs = tops.withColumn("start", start).withColumn("n", F.col("high") - F.col("start") + 1).where("n > 0")
    cells = runs.groupBy("contig", "cell").agg(F.sum("n").alias("n_cell"))
    before = F.coalesce(F.sum("n_cell").over(Window.partitionBy("contig").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = Window.partitionBy("contig", "cell").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("inside", F.coalesce(F.sum("n").over(own), F.lit(0))).join(cells.select("contig", "cell", before.alias("before")), ["contig", "cell"])
    return placed.select("contig", "start", "n", (F.col("before") + F.col("inside")).alias("ordinal"))


def sampled_columns(spans: DataFrame, every: int) -> DataFrame:
    """contig, ref_pos: the first covered base of each contig and every every-th one after it."""
    first, last = F.ceil(F.col("ordinal") / every), F.floor((F.col("ordinal") + F.col("n") - 1) / every)
    some = covered_runs(spans).withColumn("first", first).withColumn("last", last).where("first <= last")
    return some.select("contig", F.explode(F.transform(F.sequence("first", "last"), lambda k: F.col("start") + k * every - F.col("ordinal"))).alias("ref_pos"))


def column_bases(spans: DataFrame, columns: DataFrame, width: int = 8_000) -> DataFrame:
    """contig, ref_pos, base, length (of the read) of every read of spans at columns(contig, ref_pos); deletions have none.

    Both meet in cells of `width` bases; a read is compared with all columns of its cells, so there should be few in one.
    """
    by_cell = columns.groupBy("contig", F.floor(F.col("ref_pos") / width).alias("cell")).agg(F.collect_list("ref_pos").alias("columns"))
    met = in_cells(spans.select("contig", "pos", "end", "cigar", "seq"), width).join(by_cell, ["contig", "cell"])
    at = met.select("contig", "pos", "end", "cigar", "seq", F.explode("columns").alias("ref_pos")).where("ref_pos between pos and end")
    hit = at.select("contig", "ref_pos", "seq", F.explode(read_places("cigar", F.col("ref_pos") - F.col("pos"))).alias("place"))
    return hit.select("contig", "ref_pos", F.substring("seq", (F.col("place") + 1).cast("int"), F.lit(1)).alias("base"), F.length("seq").alias("length"))


def estimate_from_alignments(alignments: DataFrame, every: int = 1000, depth: int = 5, least_rate: float = 0.01, least_length: int = 500) -> DataFrame:
    """epsilon, block_length, one row: what all contigs' alignments say where neither is given.

    Of every every-th covered base of each contig, epsilon is the element at 66 % of the sorted ratios of other bases to
    the most frequent base, over columns with at least `depth` bases; sites where strains differ are few among all columns,
    so they hardly raise it. block_length is the element at 66 % of the lengths of the reads at these columns (a long read counts at
    each that it covers). Without such columns or reads the least values hold.
    """
    spans = primary_spans(alignments)
    bases = kept(column_bases(spans, sampled_columns(spans, every), 8 * every))
    counts = bases.groupBy("contig", "ref_pos", "base").agg(F.count("*").alias("n"))
    site = counts.groupBy("contig", "ref_pos").agg(F.max("n").alias("top"), F.sum("n").alias("depth")).where(F.col("depth") >= depth)
    ratio = indexed_quantile(site.select(((F.col("depth") - F.col("top")) / F.col("top")).alias("r")), "r", 66, 100)
    length = indexed_quantile(bases.select("length"), "length", 66, 100)
    # one row from each side, also where there is none
    one = ratio.agg(F.max("r").alias("r")).crossJoin(length.agg(F.max("length").alias("length")))
    return one.select(F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(least_rate)).alias("epsilon"), F.greatest(F.coalesce("length", F.lit(0)), F.lit(least_length)).cast("long").alias("block_length"))
