"""Mates and supplementary pieces of a read become one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.operators.filters import FIRST, MATE, SUPPLEMENTARY


def usable_pieces(pieces: DataFrame, most: int = 40_000) -> DataFrame:
    """The pieces that make up each read, with turn (later turns overwrite earlier ones) and mate.

    pieces: contig, name, piece, flags, pos, cigar, first_site, last_site, first_pos, last_pos (the bases of these sites; all
    null without observations), first_base, last_base (ends of the alignment). By read name: two pieces that are flagged as
    mates are a pair, the first in pair takes turn 0 and the other turn 1 and mate 1. One piece that is not supplementary
    stands alone. Otherwise all pieces join the primary one (the last by position, if several), unless the last site of
    one and the first site of the next lie more than `most` bases apart, where the primary stays alone; without a primary
    the read is dropped.
    """
    name = Window.partitionBy("contig", "name")
    has = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    order = ["pos", "cigar", "piece"]
    sites = name.orderBy(F.asc_nulls_last("first_site"), "last_site")
    marked = (
        pieces.withColumn("n", F.count("*").over(name))
        .withColumn("n_paired", F.count_if(has(MATE)).over(name))
        .withColumn("gap", F.lead("first_pos").over(sites) - F.col("last_pos"))
        .withColumn("wide", F.max(F.coalesce(F.col("first_site").isNotNull() & F.lead("first_site").over(sites).isNotNull() & (F.col("gap") > most), F.lit(False))).over(name))
        .withColumn("main", ~has(SUPPLEMENTARY))
        .withColumn("main_place", F.row_number().over(Window.partitionBy("contig", "name", "main").orderBy(*[F.desc(c) for c in order])))
        .withColumn("has_main", F.max("main").over(name))
        .withColumn("place", F.row_number().over(name.orderBy("flags", "first_site", F.desc("last_site"), "piece")))
        .withColumn("lead_flags", F.min_by("flags", "place").over(name))
    )
    mates = (F.col("n") == 2) & (F.col("n_paired") == 2)
    leads = F.col("lead_flags").bitwiseAND(FIRST) > 0
    base = F.when(leads, F.col("place") == 1).otherwise(F.col("place") == 2)
    primary = F.col("main") & (F.col("main_place") == 1)
    keep = F.when(mates, True).when(F.col("n") == 1, F.col("main")).otherwise(F.col("has_main") & (primary | ~F.col("wide")))
    by_place = F.row_number().over(name.orderBy(*order)).cast("int")
    turn = F.when(mates, F.when(base, 0).otherwise(1)).when(primary, 0).otherwise(by_place)
    out = marked.withColumn("turn", turn).withColumn("mate", F.when(mates & ~base, 1).otherwise(0)).where(keep)
    return out.select(*pieces.columns, "turn", "mate")


def combine_pieces(obs: DataFrame, usable: DataFrame) -> DataFrame:
    """contig, name, site, allele, qual, mate, seq_pos: of several observations of a site that of the latest turn wins.

    obs: contig, name, piece, site, allele, qual, seq_pos; usable: as usable_pieces gives it.
    """
    rows = obs.join(usable.select("contig", "name", "piece", "turn", "mate"), ["contig", "name", "piece"])
    last = rows.groupBy("contig", "name", "site").agg(F.max_by(F.struct("allele", "qual", "mate", "seq_pos"), "turn").alias("o"))
    return last.select("contig", "name", "site", "o.*")


def slots(usable: DataFrame, column: str) -> DataFrame:
    """contig, name, and an array of `column` (a string) of the primary piece or first mate, and of the second mate; an
    absent one, and one that is `*`, is empty. Supplementary pieces have no slot."""
    own = lambda k: F.max(F.when((F.col("turn") == k) & (F.col("mate") == k) & (F.col(column) != "*"), F.col(column)))
    return usable.groupBy("contig", "name").agg(F.array(*[F.coalesce(own(k), F.lit("")) for k in (0, 1)]).alias(column))


def combined_ranges(usable: DataFrame, strict: bool = False) -> DataFrame:
    """contig, name, is_paired, first_site, last_site, first_base, last_base of the combined reads.

    last_base is the largest of the pieces; with strict, the smallest.
    """
    last = (F.min if strict else F.max)("last_base").alias("last_base")
    return usable.groupBy("contig", "name").agg((F.max(F.col("flags").bitwiseAND(MATE)) > 0).alias("is_paired"), F.min("first_site").alias("first_site"), F.max("last_site").alias("last_site"), F.min("first_base").alias("first_base"), last)
