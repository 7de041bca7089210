"""Parts (final groups of reads): ranges, scores, summaries, reassignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.functions.scalars import hapq_score, overlap_percent
from phaseframe.operators.distances import haplotype_distance, read_haplotype_distance
from phaseframe.operators.intervals import overlap_anti, overlap_join
from phaseframe.operators.pileup import error_coverage, indexed_quantile, pileup
from phaseframe.plans.storage import kept


def part_ranges(obs: DataFrame, sites: DataFrame | None = None, width: int = 64) -> DataFrame:
    """contig, part, l_site, r_site, l_base, r_base, n_reads.

    Where obs has l_site and r_site (the ranges of the paths that parts come from), these are the ranges, and bases are
    those of the first and the last of sites(contig, site, pos) in them; else they are what the reads cover.
    """
    if "l_site" in obs.columns:
        own = obs.groupBy("contig", "part").agg(F.first("l_site").alias("l_site"), F.first("r_site").alias("r_site"), F.count_distinct("frag_id").alias("n_reads"))
        known = (sites if sites is not None else obs.select("contig", "site", "pos").distinct()).select("contig", F.col("site").alias("from_"), F.col("site").alias("to_"), "pos")
        met = overlap_join(own, known, ("l_site", "r_site"), ("from_", "to_"), ["contig"], width)
        return met.groupBy("contig", "part", "l_site", "r_site", "n_reads").agg(F.min("pos").alias("l_base"), F.max("pos").alias("r_base")).select("contig", "part", "l_site", "r_site", "l_base", "r_base", "n_reads")
    return obs.groupBy("contig", "part").agg(
        F.min("site").alias("l_site"), F.max("site").alias("r_site"), F.min("pos").alias("l_base"), F.max("pos").alias("r_base"), F.count_distinct("frag_id").alias("n_reads")
    )


def within(piled: DataFrame, ranges: DataFrame) -> DataFrame:
    """The pileup of parts at the sites of their ranges; reads may reach further."""
    own = ranges.select("contig", "part", F.col("l_site").alias("l_"), F.col("r_site").alias("r_"))
    return piled.join(own, ["contig", "part"]).where("site between l_ and r_").drop("l_", "r_")


def part_order(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("index", F.row_number().over(Window.partitionBy("contig").orderBy("l_site", "r_site", "part")) - 1)


def gap_reads(reads: DataFrame, ranges: DataFrame, block_length: int, width: int = 4096) -> DataFrame:
    """Reads(contig, name columns, is_paired, first_base, last_base) that meet no part's range of bases.

    Paired reads are not cut to their part, so for them ranges reach a block length further on both sides.
    """
    names = [c for c in reads.columns if c not in ("contig", "is_paired", "first_base", "last_base")]
    pad = F.when(F.col("is_paired"), block_length).otherwise(0)
    wide = reads.withColumn("from_", F.col("first_base") - pad).withColumn("to_", F.col("last_base") + pad)
    return overlap_anti(wide, ranges.select("contig", "l_base", "r_base"), ("from_", "to_"), ("l_base", "r_base"), ["contig"], names, width).drop("from_", "to_")


def part_overlaps(ranges: DataFrame, cutoff: float = 0.05, width: int = 64) -> DataFrame:
    """Ordered pairs of parts that share more than an end and more than cutoff of the first one's range."""
    a = ranges.select("contig", "part", "l_site", "r_site")
    b = ranges.select("contig", F.col("part").alias("other"), F.col("l_site").alias("l_other"), F.col("r_site").alias("r_other"))
    pairs = overlap_join(a, b, ("l_site", "r_site"), ("l_other", "r_other"), ["contig"], width, strict=True).where("part <> other")
    share = overlap_percent(F.col("l_site"), F.col("r_site"), F.col("l_other"), F.col("r_other"))
    return pairs.select("contig", "part", "other", share.alias("overlap")).where(F.col("overlap") > cutoff)


def hapq(ranges: DataFrame, piled: DataFrame, block_length: float, cutoff: float = 0.05, width: int = 64) -> DataFrame:
    """contig, part, hapq, rel_err from part_ranges and the pileup by (contig, part)."""
    distance = haplotype_distance(piled, ["contig"], "part").withColumn("dist", F.col("diff") / (F.col("same") + F.col("diff")))
    both = distance.select("contig", "part", "other", "dist").union(distance.select("contig", "other", "part", "dist"))
    worst = part_overlaps(ranges, cutoff, width).join(both, ["contig", "part", "other"], "left").groupBy("contig", "part").agg(F.max(F.col("overlap") * (1 - F.coalesce("dist", F.lit(1.0)))).alias("penalty"))
    errors = error_coverage(within(piled, ranges), "contig", "part")
    overall = errors.groupBy("contig").agg((F.sum("errors") / F.sum("support")).alias("mean_err"))
    rows = ranges.join(worst, ["contig", "part"], "left").join(errors, ["contig", "part"]).join(overall, "contig")
    score = hapq_score(F.coalesce("penalty", F.lit(0.0)), F.col("n_reads"), F.col("r_base") - F.col("l_base"), block_length)
    return rows.select("contig", "part", score.alias("hapq"), F.expr("try_divide(err, mean_err)").alias("rel_err"))


def covered_sites(ranges: DataFrame) -> DataFrame:
    """contig, touched: sites that at least one part's range holds, from the ranges alone."""
    order = Window.partitionBy("contig").orderBy("l_site", "r_site", "part").rowsBetween(Window.unboundedPreceding, -1)
    own = ranges.withColumn("reach", F.coalesce(F.max("r_site").over(order), F.lit(0)))
    return own.groupBy("contig").agg(F.sum(F.greatest(F.lit(0), F.col("r_site") - F.greatest(F.col("l_site") - 1, F.col("reach")))).alias("touched"))


def contig_ploidy(ranges: DataFrame, piled: DataFrame, scores: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row for each contig: strain count (all parts, and from hapq 15, 30, 45), multiplicity, coverage, bases, error.

    scores: contig, part, hapq; contigs: contig, length, n_sites.
    """
    rows = ranges.join(error_coverage(within(piled, ranges), "contig", "part"), ["contig", "part"]).join(scores.select("contig", "part", "hapq"), ["contig", "part"])
    rows = rows.withColumn("n", F.col("r_site") - F.col("l_site") + 1).withColumn("bases", F.col("r_base") - F.col("l_base"))
    above = lambda q: F.sum(F.when(F.col("hapq") >= q, F.col("n")).otherwise(0))
    total = rows.groupBy("contig").agg(
        F.sum("n").alias("all_n"), F.sum("bases").alias("bases"), F.sum(F.col("cov") * F.col("n")).alias("weighted"), above(15).alias("n15"), above(30).alias("n30"), above(45).alias("n45"), F.sum("errors").alias("errors"), F.sum("support").alias("support")
    )
    joined = total.join(covered_sites(ranges), "contig").join(contigs.select("contig", "length", "n_sites"), "contig")
    return joined.select(
        "contig",
        (F.col("all_n") / F.col("n_sites")).alias("average_straincount"),
        (F.col("bases") / F.col("length")).alias("whole_contig_multiplicity"),
        (F.col("weighted") / F.col("touched")).alias("approximate_coverage_ignoring_indels"),
        F.col("bases").alias("total_vartig_bases_covered"),
        (F.col("n15") / F.col("n_sites")).alias("average_straincount_min15hapq"),
        (F.col("n30") / F.col("n_sites")).alias("average_straincount_min30hapq"),
        (F.col("n45") / F.col("n_sites")).alias("average_straincount_min45hapq"),
        (F.col("errors") / F.col("support")).alias("avg_err"),
    )


def node_pileup(membership: DataFrame, obs: DataFrame) -> DataFrame:
    """contig, col, cluster, site, allele, weight of membership(contig, col, cluster, frag_id, l_site, r_site): only
    sites within the node's range count."""
    rows = membership.join(obs.select("contig", "frag_id", "site", "allele", "weight"), ["contig", "frag_id"]).where("site between l_site and r_site")
    return pileup(rows, "contig", "col", "cluster")


def hap_nodes(membership: DataFrame, obs: DataFrame) -> DataFrame:
    """contig, col, cluster, block_id, l_site, r_site, node_id, n_reads, cov: one node for each cluster of a block.

    node_id counts nodes of a contig by (col, cluster); cov is the element at two thirds of the sorted weights of the
    node's alleles.
    """
    placed = numbered(membership)
    nodes = placed.groupBy("contig", "col", "cluster").agg(F.min("block_id").alias("block_id"), F.min("l_site").alias("l_site"), F.max("r_site").alias("r_site"), F.count("*").alias("n_reads"))
    nodes = nodes.withColumn("node_id", F.row_number().over(Window.partitionBy("contig").orderBy("col", "cluster")) - 1)
    cov = indexed_quantile(node_pileup(placed, obs).withColumn("cov", F.round("weight", 6)), "cov", 2, 3, "contig", "col", "cluster")
    return nodes.join(cov, ["contig", "col", "cluster"], "left")


def numbered(membership: DataFrame) -> DataFrame:
    """membership with col: blocks of a contig that have clusters, counted from 0."""
    columns = membership.select("contig", "block_id").distinct().withColumn("col", F.row_number().over(Window.partitionBy("contig").orderBy("block_id")) - 1)
    return membership.join(columns, ["contig", "block_id"])


def block_edges(membership: DataFrame, obs: DataFrame, least: int = 2) -> DataFrame:
    """Edges between clusters of neighbouring blocks by the reads they share; ambiguous reads are left out.

    membership: contig, block_id, cluster, frag_id, l_site, r_site. A read is ambiguous when its differences (whole
    numbers) from the two nearest clusters of the next block are the same.
    """
    placed = kept(numbered(membership))
    clusters = placed.select("contig", (F.col("col") - 1).alias("col"), "cluster").distinct().groupBy("contig", "col").agg(F.count("*").alias("n_next"))
    reads = kept(placed.select("contig", (F.col("col") + 1).alias("col"), "frag_id").distinct().join(obs.select("contig", "frag_id", "site", "allele", "weight"), ["contig", "frag_id"]))
    distance = read_haplotype_distance(reads, node_pileup(placed, obs), ["contig", "col"], "cluster")
    # a cluster that shares no site with a read differs from it by nothing
    near = distance.groupBy("contig", "col", "frag_id").agg(F.array_sort(F.collect_list("diff")).alias("d")).select("contig", (F.col("col") - 1).alias("col"), "frag_id", "d")
    a = placed.select("contig", "col", "frag_id", F.col("cluster").alias("row_from")).join(clusters, ["contig", "col"]).join(near, ["contig", "col", "frag_id"], "left")
    zeros = F.col("n_next") - F.coalesce(F.size("d"), F.lit(0))
    first, second = (F.when(zeros > k, 0).otherwise(F.get("d", k - zeros)) for k in (0, 1))
    a = a.where((F.col("n_next") == 1) | (first != second)).select("contig", "col", "frag_id", "row_from")
    b = placed.select("contig", (F.col("col") - 1).alias("col"), "frag_id", F.col("cluster").alias("row_to"))
    return a.join(b, ["contig", "col", "frag_id"]).groupBy("contig", "col", "row_from", "row_to").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def merge_pairs(ranges: DataFrame, piled: DataFrame, epsilon: float, cutoff: float = 0.95, width: int = 64) -> DataFrame:
    """contig, part, other: of the parts that a part overlaps by more than cutoff and differs from by less than epsilon
    (share of common sites), the one with which it spans most; the smallest on ties."""
    distance = haplotype_distance(piled, ["contig"], "part")
    both = distance.union(distance.select("contig", F.col("other"), F.col("part"), "same", "diff"))
    alike = part_overlaps(ranges, cutoff, width).join(both, ["contig", "part", "other"]).where(F.col("diff") / (F.col("same") + F.col("diff")) < epsilon)
    site = ranges.select("contig", "part", "l_site", "r_site")
    spans = alike.join(site, ["contig", "part"]).join(site.select("contig", F.col("part").alias("other"), F.col("l_site").alias("l2"), F.col("r_site").alias("r2")), ["contig", "other"])
    span = F.greatest("r_site", "r2") - F.least("l_site", "l2")
    return spans.groupBy("contig", "part").agg(F.max_by("other", F.struct(span, -F.col("other"))).alias("other"))


def merged_parts(ranges: DataFrame, pairs: DataFrame) -> DataFrame:
    """contig, part, merged: parts joined by pairs(contig, part, other) get the smallest part of their component."""
    names = ranges.select("contig", "part")
    edges = kept(pairs.union(pairs.select("contig", F.col("other"), F.col("part"))).distinct())
    label = kept(names.withColumn("merged", F.col("part")))
    while True:
        # the smallest label around, then the label of that label: components shrink in a logarithmic number of rounds
        near = edges.join(label.select("contig", F.col("part").alias("other"), "merged"), ["contig", "other"]).groupBy("contig", "part").agg(F.min("merged").alias("near"))
        step = label.join(near, ["contig", "part"], "left").select("contig", "part", F.least("merged", F.coalesce("near", "merged")).alias("merged"), F.col("merged").alias("old"))
        step = kept(step)
        jump = step.select("contig", F.col("part").alias("merged"), F.col("merged").alias("far"))
        label = kept(step.join(jump, ["contig", "merged"]).select("contig", "part", F.col("far").alias("merged"), "old"))
        if label.where("merged <> old").isEmpty():
            return label.select("contig", "part", "merged")
        label = label.select("contig", "part", "merged")
