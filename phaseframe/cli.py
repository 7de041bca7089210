"""Command line: `phase` takes alignments, variants and a reference to haplotypes, `vartig` pools each contig's reads, and
`haplotag` and `split` write BAM files by what phase has found."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseframe.functions.scalars import phred_weight
from phaseframe.operators import columns, combine, filters, parts, pileup, windows
from phaseframe.operators.sequences import trim_offsets, trimmed
from phaseframe.plans import phasing
from phaseframe.plans.storage import kept
from phaseframe.sources import bam, bamsource, files, sinks
from phaseframe.sources.bindings import frags_of


@dataclass(frozen=True)
class Options:
    """What phase() may be told; None: estimated from the data."""

    epsilon: float | None = None
    block_length: int | None = None
    beam: int = 10
    ploidy: int = 5
    density: float = 0.0005
    sensitivity: int = 2
    stop_heuristic: bool = True
    ignore_monomorphic: bool = False
    supplementary: bool = True
    supplementary_distance: int = 40_000
    mapq: int = 15
    least_sites: int = 100
    contigs: tuple[str, ...] = ()
    output_reads: bool = False
    gzip_reads: bool = False
    extra_trimming: bool = False
    hybrid: str | None = None
    reassign_short: bool = False
    bin_by_coverage: bool = False


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """Records of BAM or SAM files."""
    return bam.read_bam(spark, path) if path.endswith(".bam") else files.parse_sam(files.lines(spark, path))


def observations(records: DataFrame, sites: DataFrame, options: Options, reference: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Observations of combined reads (contig, frag_id, name, site, pos, allele, qual, mate, seq_pos, weight), and reads:
    contig, name, is_paired, first_base, last_base, seqs, quals (of both mates) of each usable read, also of those without
    a site."""
    good = filters.filter_alignments(records, options.mapq, options.supplementary).where("cigar <> '*'").withColumn("piece", F.xxhash64("flags", "pos", "cigar"))
    calls = files.allele_calls(good, sites, "piece", "seq")
    if reference is not None:
        placed = calls.join(sites, ["contig", "site"]).withColumnRenamed("read_pos", "seq_pos")
        calls = phasing.realign(placed, reference).withColumnRenamed("seq_pos", "read_pos").drop("alleles", "pos")
    obs = kept(calls.select("contig", F.col("qname").alias("name"), "piece", "site", "allele", F.col("qual").cast("int").alias("qual"), F.col("read_pos").alias("seq_pos")).dropDuplicates(["contig", "name", "piece", "site"]))
    at = sites.select("contig", "site", "pos")
    span = obs.join(at, ["contig", "site"]).groupBy("contig", "name", "piece").agg(F.min("site").alias("first_site"), F.max("site").alias("last_site"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    ends = good.select("contig", F.col("qname").alias("name"), "piece", "flags", "pos", "cigar", F.col("seq").alias("seqs"), F.array_join(F.transform("qual", lambda q: F.char(F.least(q + 33, F.lit(126)))), "").alias("quals"), F.col("pos").alias("first_base"), (F.col("pos") + files.reference_length("cigar") - 1).alias("last_base"))
    pieces = kept(combine.usable_pieces(ends.join(span, ["contig", "name", "piece"], "left"), options.supplementary_distance))
    merged = combine.combine_pieces(obs, pieces)
    ids = combine.combined_ranges(pieces).withColumn("frag_id", F.xxhash64("contig", "name"))
    named = merged.join(at, ["contig", "site"]).join(ids.select("contig", "name", "frag_id"), ["contig", "name"]).withColumn("weight", phred_weight(F.col("qual")))
    texts = combine.slots(pieces, "seqs").join(combine.slots(pieces, "quals"), ["contig", "name"])
    return kept(named), kept(ids.join(texts, ["contig", "name"]))


def run(spark: SparkSession, alignment_path: str, vcf_path: str, fasta_path: str | None, out: str, options: Options = Options(), mode: str = "errorifexists") -> DataFrame:
    """Phases everything and writes the reports below out; gives the vartigs."""
    sites = kept(files.parse_vcf(files.lines(spark, vcf_path)))
    wanted = filters.filter_contigs(sites, options.least_sites, list(options.contigs) or None)
    sites = kept(sites.join(wanted.select("contig"), "contig", "left_semi"))
    reference = kept(files.fasta_chunks(files.lines(spark, fasta_path))) if fasta_path else None
    records = alignments(spark, alignment_path)
    estimated = records
    if options.hybrid:
        records = records.unionByName(alignments(spark, options.hybrid))
    epsilon, length = options.epsilon, options.block_length
    if epsilon is None or length is None:
        found = columns.estimate_from_alignments(estimated).first()
        epsilon = found["epsilon"] if epsilon is None else epsilon
        length = found["block_length"] if length is None else length
    obs, reads = observations(records, sites, options, reference)
    short = None
    if options.hybrid:
        # pairs are the short reads, whichever file they come from
        named = obs.join(reads.select("contig", "name", "is_paired"), ["contig", "name"])
        obs, short = (kept(named.where(F.col("is_paired") == pairs).select(*obs.columns)) for pairs in (False, True))
    if options.ignore_monomorphic:
        obs = kept(pileup.remove_monomorphic(obs, epsilon))
    places = sites.select("contig", "site", "pos")
    phased = kept(phasing.phase(obs, length, epsilon, options.ploidy, options.beam, options.sensitivity, options.density, options.stop_heuristic, places, short, options.reassign_short, options.bin_by_coverage))
    ranges, piled = kept(parts.part_ranges(phased, places)), kept(pileup.pileup(phased, "contig", "part"))
    vartigs = kept(sinks.vartigs(ranges, piled, length))
    lengths = reference.groupBy("contig").agg(F.sum(F.length("seq")).alias("length")) if reference is not None else sites.groupBy("contig").agg(F.max("pos").alias("length"))
    counts = sites.groupBy("contig").agg(F.count("*").alias("n_sites")).join(lengths, "contig")
    name = phased.select("contig", "part", "frag_id", "name").distinct()
    haplosets = frags_of(phased).join(name, ["contig", "frag_id"])
    write = lambda lines, what, **k: sinks.write_lines(lines, f"{out}/{what}", mode, **k)
    write(sinks.vartig_lines(vartigs), "vartigs", together="part")
    write(sinks.vartig_info_lines(sinks.vartig_info(ranges, piled, places), ranges), "vartig_info", together="part")
    write(sinks.haploset_lines(vartigs, haplosets), "haplosets", together="part")
    write(sinks.ploidy_lines(parts.contig_ploidy(ranges, piled, vartigs, counts)), "contig_ploidy")
    seen = obs.select("contig", "name") if short is None else obs.select("contig", "name").union(short.select("contig", "name"))
    without = reads.join(seen.distinct(), ["contig", "name"], "left_anti")
    length_of = F.length(F.col("seqs")[0]) + F.length(F.col("seqs")[1])
    title = spark.createDataFrame([("", "READ_NAME\tREAD_LENGTH_IN_BASES")], "rn string, value string")
    write(title.union(without.select(F.col("name").alias("rn"), F.concat_ws("\t", "name", length_of.cast("string")).alias("value"))), "reads_without_sites")
    if options.output_reads:
        whole = reads.select("contig", "name", "seqs", "quals", "is_paired")
        placed = haplosets.select("contig", "part", "frag_id", "name", "first_site", "last_site").join(whole, ["contig", "name"])
        single = placed.where("not is_paired and seqs[0] <> ''").withColumn("seq", F.col("seqs")[0]).withColumn("qual", F.col("quals")[0])
        lengths = single.select("contig", "frag_id", F.length("seq").alias("length"))
        cuts = trim_offsets(phased, ranges, lengths, extend=not options.extra_trimming)
        fastq = lambda lines: lines.withColumn("part", F.col("rn.part"))
        write(fastq(sinks.fastq_lines(trimmed(single.join(cuts, ["contig", "part", "frag_id"])))), "long_reads", gzip=options.gzip_reads)
        inside = (F.col("first_site") <= F.col("r_site")) & (F.col("last_site") >= F.col("l_site"))
        paired = placed.where("is_paired").join(ranges.select("contig", "part", "l_site", "r_site"), ["contig", "part"]).where(inside)
        write(sinks.paired_fastq_lines(paired), "short_reads", gzip=options.gzip_reads)
        gaps = parts.gap_reads(reads.select("contig", "name", "is_paired", "first_base", "last_base"), ranges, length, max(4096, length)).join(whole.drop("is_paired"), ["contig", "name"])
        loose = gaps.select("contig", F.lit(-1).alias("part"), F.xxhash64("contig", "name").alias("frag_id"), "name", "seqs", "quals", "is_paired")
        write(sinks.fastq_lines(loose.where("not is_paired").withColumn("seq", F.col("seqs")[0]).withColumn("qual", F.col("quals")[0])), "long_reads_in_gaps", gzip=options.gzip_reads)
        write(sinks.paired_fastq_lines(loose.where("is_paired")), "short_reads_in_gaps", gzip=options.gzip_reads)
    return vartigs


def pooled(spark: SparkSession, alignment_path: str, vcf_path: str, out: str, mode: str = "errorifexists") -> DataFrame:
    """One allele string for all reads of each contig."""
    sites = kept(files.parse_vcf(files.lines(spark, vcf_path)))
    obs, _ = observations(alignments(spark, alignment_path), sites, Options(mapq=30, supplementary_distance=10**10))
    whole = kept(obs.withColumn("part", F.lit(0)))
    ranges = parts.part_ranges(whole)
    # counts decide, not qualities
    text = pileup.allele_string(pileup.consensus(pileup.pileup(whole, "contig", "part"), "contig", "part", by="n"), "contig", "part")
    found = kept(text.join(ranges.select("contig", "part", (F.col("l_base") + 1).alias("l_base"), (F.col("r_base") + 1).alias("r_base")), ["contig", "part"]))
    sinks.write_lines(sinks.pooled_lines(found), f"{out}/vartig", mode)
    return found


def read_parts(spark: SparkSession, phased: str, least_hapq: int) -> DataFrame:
    """contig, qname, part of the reads of phase's reports, parts from a confidence on."""
    rows = spark.read.text(f"{phased}/haplosets").withColumn("line_no", F.monotonically_increasing_id())
    below = files.carried(rows, F.when(F.col("value").startswith(">"), F.col("value")), "header").where("value not like '>%' and value <> ''")
    number = lambda pattern: F.regexp_extract("header", pattern, 1).cast("int")
    found = below.select("contig", F.split("value", "\t")[0].alias("qname"), number("HAP([0-9]+)").alias("part"), number("HAPQ:([0-9]+)").alias("hapq"))
    return found.where(F.col("hapq") >= least_hapq).drop("hapq")


def tag_or_split(spark: SparkSession, command: str, alignment_path: str, phased: str, out: str, least_hapq: int, mode: str) -> None:
    """haplotag: all alignments, with the part of their read as HP tag; split: the alignments of parts, a folder for each."""
    records = alignments(spark, alignment_path)
    heads = bam.bam_contigs(spark, alignment_path) if alignment_path.endswith(".bam") else files.sam_contigs(files.lines(spark, alignment_path))
    contigs = [(r["contig"], r["length"]) for r in heads.orderBy("ordinal").collect()]  # the header, which every file has
    parts = read_parts(spark, phased, least_hapq)
    made = bamsource.haplotagged(records, parts.withColumnRenamed("part", "hp")) if command == "haplotag" else bamsource.partitioned(records, parts)
    bamsource.write_split(made, contigs, out, mode)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phaseframe", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("phase", "vartig"):
        p = commands.add_parser(name)
        p.add_argument("-b", "--alignments", required=True)
        p.add_argument("-v", "--vcf", required=True)
        p.add_argument("-o", "--out", default="phaseframe_out")
        p.add_argument("--overwrite", action="store_true")
    p = commands.choices["phase"]
    p.add_argument("-r", "--reference")
    p.add_argument("-e", "--epsilon", type=float)
    p.add_argument("-l", "--block-length", type=int)
    p.add_argument("-n", "--beam", type=int, default=10)
    p.add_argument("-p", "--ploidy", type=int, default=5)
    p.add_argument("-d", "--density", type=float, default=0.0005)
    p.add_argument("-s", "--sensitivity", type=int, choices=(1, 2, 3), default=2)
    p.add_argument("-m", "--mapq", type=int, default=15)
    p.add_argument("-X", "--no-supplementary", action="store_true")
    p.add_argument("--supplementary-distance", type=int, default=40_000)
    p.add_argument("--snp-count-filter", type=int, default=100)
    p.add_argument("-G", "--contigs", nargs="*", default=())
    p.add_argument("-H", "--hybrid", help="alignments of short pairs, by which the reads are corrected")
    p.add_argument("--reassign-short", action="store_true")
    p.add_argument("--bin-by-cov", action="store_true")
    for name in ("haplotag", "split"):
        q = commands.add_parser(name)
        q.add_argument("-b", "--alignments", required=True)
        q.add_argument("-p", "--phased", required=True, help="the folder that phase has written")
        q.add_argument("-o", "--out", required=True)
        q.add_argument("--min-hapq", type=int, default=0)
        q.add_argument("--overwrite", action="store_true")
    for flag in ("--no-stop-heuristic", "--ignore-monomorphic", "--output-reads", "--gzip-reads", "--extra-trimming"):
        p.add_argument(flag, action="store_true")
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("phaseframe").getOrCreate()
    mode = "overwrite" if a.overwrite else "errorifexists"
    if a.command == "vartig":
        pooled(spark, a.alignments, a.vcf, a.out, mode)
        return
    if a.command in ("haplotag", "split"):
        tag_or_split(spark, a.command, a.alignments, a.phased, a.out, a.min_hapq, mode)
        return
    options = Options(a.epsilon, a.block_length, a.beam, a.ploidy, a.density, a.sensitivity, not a.no_stop_heuristic, a.ignore_monomorphic, not a.no_supplementary, a.supplementary_distance, a.mapq, a.snp_count_filter, tuple(a.contigs), a.output_reads, a.gzip_reads, a.extra_trimming, a.hybrid, a.reassign_short, a.bin_by_cov)
    run(spark, a.alignments, a.vcf, a.reference, a.out, options, mode)


if __name__ == "__main__":
    main()
