"""Scalar expressions of phasing, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phred_weight(qual: Column) -> Column:
    """Probability that a base of this quality is right."""
    return 1 - F.pow(F.lit(10.0), -qual / 10.0)


def binom_logp(n: Column, k: Column, p: float, div: float = 0.25) -> Column:
    """Large-deviation log-probability of k errors in n at rate p; positive below the rate, 0 for n = 0."""
    share = k / n
    a = F.when(share == 0, 1e-7).when(share == 1, 0.9999999).otherwise(share)
    divergence = a * F.log(a / p) + (1 - a) * F.log((1 - a) / (1 - p))
    value = -(n / div) * divergence
    return F.when(n == 0, 0.0).when(a < p, -value).otherwise(value)


def overlap_percent(x1: Column, x2: Column, y1: Column, y2: Column) -> Column:
    """Share of [x1, x2] that [y1, y2] covers, by the shorter reach, at most 1."""
    return F.least(F.lit(1.0), F.least(x2 - y1 + 1, y2 - x1 + 1) / (x2 - x1 + 1))


def poisson(k: Column, rate: Column) -> Column:
    """Poisson probability of a whole number k, by logarithms."""
    factorial = F.when(k < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(2).cast("long"), F.greatest(k, F.lit(2)).cast("long")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double"))))
    return F.exp(-rate + k * F.log(rate) - factorial)


def coverage_distance(x: Column, y: Column) -> Column:
    """Negative log of the mean probability of each coverage under the other."""
    return -F.log((poisson(F.floor(y), x) + poisson(F.floor(x), y)) / 2)


def ploidy_threshold(ploidy: Column, epsilon: float, sensitivity: int) -> Column:
    """Ratio of errors at which one more cluster no longer pays."""
    grow = {1: F.sqrt(ploidy) + 1, 2: ploidy + F.lit(1) / 3, 3: ploidy + 1}[sensitivity]
    return 1 / (1 - F.lit(epsilon)) / (1 + 1 / grow)


def hapq_score(penalty: Column, reads: Column, bases: Column, block_length: float) -> Column:
    """Confidence of a part, 0 to 60; one read gives 0."""
    raw = F.floor(40 * (1 - penalty) * F.least(F.lit(1.0), reads / 3) * F.greatest(F.lit(0.0), F.log(bases / block_length + 1)))
    return F.when(reads == 1, 0).otherwise(F.least(F.lit(60), raw)).cast("int")


def reverse_complement(bases: Column) -> Column:
    return F.reverse(F.translate(bases, "ACGTacgt", "TGCAtgca"))


def allele_char(allele: Column) -> Column:
    return F.coalesce(allele.cast("string"), F.lit("?"))


def quality_byte(qual: Column) -> Column:
    """Printable quality code, saturating."""
    return F.least(qual + 33, F.lit(255))


def chi_square_cdf3(x: Column) -> Column:
    """Distribution function of the chi-square law with 3 degrees of freedom; erf by a rational approximation."""
    z = F.sqrt(x / 2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return erf - F.sqrt(2 * x / 3.141592653589793) * F.exp(-x / 2)
