"""Pileups, consensus, coverage and error statistics: aggregations over observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.functions.scalars import chi_square_cdf3


def pileup(obs: DataFrame, *keys: str) -> DataFrame:
    """Summed weight and count of each allele at each site of each group."""
    return obs.groupBy(*keys, "site", "allele").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def consensus(piled: DataFrame, *keys: str, by: str = "weight") -> DataFrame:
    """The heaviest allele of each site; the smallest on ties."""
    return piled.groupBy(*keys, "site").agg(F.max_by("allele", F.struct(F.round(by, 9), -F.col("allele"))).alias("allele"), F.max(by).alias("top"), F.sum(by).alias("total"))


def allele_string(best: DataFrame, *keys: str) -> DataFrame:
    """Consensus alleles from the first to the last site of a group, `?` where there is none."""
    grouped = best.groupBy(*keys).agg(F.min("site").alias("l_site"), F.max("site").alias("r_site"), F.array_sort(F.collect_list(F.struct("site", F.col("allele").cast("string").alias("letter")))).alias("m"))
    skipped = lambda x, i: F.when(i == 0, 0).otherwise(x["site"] - F.element_at("m", i)["site"] - 1)
    letters = F.transform("m", lambda x, i: F.concat(F.repeat(F.lit("?"), skipped(x, i)), x["letter"]))
    return grouped.select(*keys, "l_site", "r_site", F.array_join(letters, "").alias("alleles"))


def mec_stats(piled: DataFrame, epsilon: float, *keys: str, by: str = "weight") -> DataFrame:
    """Bases = heaviest alleles; errors = all others, and epsilon for every site whose heaviest is at most 1."""
    site = piled.groupBy(*keys, "site").agg(F.max(by).alias("top"), F.sum(by).alias("total"))
    extra = F.when(F.col("top") <= 1, F.lit(epsilon)).otherwise(0.0)
    return site.groupBy(*keys).agg(F.sum("top").cast("double").alias("bases"), F.sum(F.col("total") - F.col("top") + extra).cast("double").alias("errors"))


def error_coverage(piled: DataFrame, *keys: str) -> DataFrame:
    """Coverage over covered sites, share of errors (null without support), errors and support, by counts."""
    site = piled.groupBy(*keys, "site").agg(F.max("n").alias("top"), F.sum("n").alias("support"))
    whole = site.groupBy(*keys).agg(F.sum("support").alias("support"), F.sum(F.col("support") - F.col("top")).alias("errors"), F.count("*").alias("covered"))
    return whole.select(*keys, F.expr("try_divide(support, covered)").alias("cov"), F.expr("try_divide(errors, support)").alias("err"), "errors", "support")


def indexed_quantile(values: DataFrame, column: str, numerator: int, denominator: int, *keys: str) -> DataFrame:
    """The element at floor(n * numerator / denominator), counted from 0, of the sorted values of each group.

    Equal values are counted first, so what is ordered in one place are a group's different values.
    """
    counted = values.groupBy(*keys, column).agg(F.count("*").alias("times"))
    order = Window.partitionBy(*keys).orderBy(column)
    ranked = counted.select(*keys, column, "times", F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("times").over(Window.partitionBy(*keys)).alias("rows_"))
    at = F.floor(F.col("rows_") * numerator / denominator)
    return ranked.where((F.col("upto") > at) & (F.col("upto") - F.col("times") <= at)).select(*keys, column)


def remove_monomorphic(obs: DataFrame, epsilon: float) -> DataFrame:
    """obs without sites that have one allele, or whose heaviest times epsilon exceeds the second."""
    ranked = pileup(obs, "contig").withColumn("r", F.row_number().over(Window.partitionBy("contig", "site").orderBy(F.desc("weight"), "allele")))
    tops = ranked.where("r <= 2").groupBy("contig", "site").agg(F.max(F.when(F.col("r") == 1, F.col("weight"))).alias("top"), F.max(F.when(F.col("r") == 2, F.col("weight"))).alias("second"))
    dull = tops.where(F.col("second").isNull() | (F.col("top") * epsilon > F.col("second"))).select("contig", "site")
    return obs.join(dull, ["contig", "site"], "left_anti")


def cooccurrence(obs: DataFrame, gap: int) -> DataFrame:
    """Pairs of alleles that fragments have at sites p and p + gap, with the count expected under independence."""
    a = obs.select("contig", "frag_id", "site", F.col("allele").alias("a"))
    b = obs.select("contig", "frag_id", (F.col("site") - gap).alias("site"), F.col("allele").alias("b"))
    seen = a.join(b, ["contig", "frag_id", "site"]).groupBy("contig", "site", "a", "b").agg(F.count("*").alias("observed"))
    by_site = lambda *c: F.sum("observed").over(Window.partitionBy("contig", "site", *c))
    return seen.withColumn("expected", by_site("a") * by_site("b") / by_site())


def error_correlation(obs: DataFrame, gap: int) -> DataFrame:
    """contig, site, deviation, chi_square, p_value: how far counts of allele pairs are from independence.

    All pairs of the alleles that are seen at either site count, also those that never occur together.
    """
    seen = cooccurrence(obs, gap).select("contig", "site", "a", "b", "observed")
    left = seen.groupBy("contig", "site", "a").agg(F.sum("observed").alias("n_a"))
    right = seen.groupBy("contig", "site", "b").agg(F.sum("observed").alias("n_b"))
    total = seen.groupBy("contig", "site").agg(F.sum("observed").alias("n"))
    every = left.join(right, ["contig", "site"]).join(total, ["contig", "site"]).join(seen, ["contig", "site", "a", "b"], "left")
    apart = F.coalesce("observed", F.lit(0)) - F.col("n_a") * F.col("n_b") / F.col("n")
    sums = every.groupBy("contig", "site").agg(F.sum(F.abs(apart)).alias("deviation"), F.sum(apart * apart * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("chi_square"))
    return sums.withColumn("p_value", 1 - chi_square_cdf3(F.col("chi_square")))


def estimate_parameters(piled: DataFrame, lengths: DataFrame, depth: int = 5, least_rate: float = 0.01, least_length: int = 500) -> DataFrame:
    """contig, epsilon, block_length: what the data say where neither is given.

    epsilon is the element at 66 % of the sorted ratios of other counts to the top count, over sites of piled(contig,
    site, allele, n) with at least `depth`; block_length that of the read lengths(contig, length).
    """
    site = piled.groupBy("contig", "site").agg(F.max("n").alias("top"), F.sum("n").alias("depth")).where(F.col("depth") >= depth)
    ratio = indexed_quantile(site.select("contig", ((F.col("depth") - F.col("top")) / F.col("top")).alias("r")), "r", 66, 100, "contig")
    length = indexed_quantile(lengths.select("contig", "length"), "length", 66, 100, "contig")
    return ratio.join(length, "contig").select("contig", F.greatest("r", F.lit(least_rate)).alias("epsilon"), F.greatest("length", F.lit(least_length)).cast("long").alias("block_length"))


def pileup_delta(before: DataFrame, added: DataFrame, removed: DataFrame, *keys: str) -> DataFrame:
    """A pileup after fragments come and go, in one aggregation; what falls to 0 disappears."""
    signed = added.select(*keys, "site", "allele", "weight").unionByName(removed.select(*keys, "site", "allele", (-F.col("weight")).alias("weight")))
    total = before.select(*keys, "site", "allele", "weight").unionByName(signed).groupBy(*keys, "site", "allele").agg(F.sum("weight").alias("weight"))
    return total.where("weight > 1e-9")
