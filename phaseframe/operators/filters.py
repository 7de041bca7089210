"""Predicates over alignments, sites, contigs and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.plans.storage import dealt

#: Bits of the alignment flags.
FIRST, SECOND, SECONDARY, SUPPLEMENTARY, REJECTED = 64, 128, 256, 2048, 1796
#: A record is a mate of a pair if it is flagged as the first or the second one.
MATE = FIRST | SECOND


def filter_alignments(rows: DataFrame, mapq: int = 15, use_supplementary: bool = True, supplementary_mapq: int = 60) -> DataFrame:
    """Drops poor, secondary, duplicate and unmapped records; supplementary ones only count unpaired and at high quality."""
    has = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    bad_extra = has(SUPPLEMENTARY) & (has(MATE) | F.lit(not use_supplementary) | (F.col("mapq") < supplementary_mapq))
    return rows.where(~bad_extra & (F.col("mapq") >= mapq) & ~has(REJECTED) & ~has(SECONDARY))


def filter_snps(sites: DataFrame) -> DataFrame:
    """Records whose alleles are all single bases, in upper case."""
    return sites.where(F.forall("alleles", lambda a: a.rlike("^[ACGTacgt]$"))).withColumn("alleles", F.transform("alleles", F.upper))


def filter_contigs(sites: DataFrame, least: int = 100, only: list | None = None) -> DataFrame:
    """Contigs with at least `least` different positions."""
    chosen = sites if only is None else sites.where(F.col("contig").isin(only))
    return chosen.groupBy("contig").agg(F.count_distinct("pos").alias("n_sites")).where(F.col("n_sites") >= least)


def filter_span(frags: DataFrame, most: int = 10_000) -> DataFrame:
    """Fragments that do not span more than `most` sites (reads over the origin of circular contigs do)."""
    return frags.where(F.col("last_site") - F.col("first_site") <= most)


def filter_density(blocks: DataFrame, length: int, density: float = 0.0005) -> DataFrame:
    return blocks.where((F.col("r_site") - F.col("l_site") + 1) / F.lit(float(length)) > density)


def split_by_sites(names: DataFrame, obs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Reads with and without any observation. Both are counted first and dealt by the key, so that a task has about the same
    number of rows however many there are."""
    n = names.count() + obs.count()
    own, seen = dealt(names, n, key), dealt(obs.select(key), n, key)
    return own.join(seen, key, "left_semi"), own.join(seen, key, "left_anti")
