"""Results as tables and as the lines of text reports.

Every report is a DataFrame of lines with its contig and an order (rn), so that write_lines can lay out one folder for
each contig; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseframe.functions.scalars import reverse_complement
from phaseframe.operators.parts import hapq, within
from phaseframe.operators.pileup import allele_string, consensus, error_coverage

#: The columns of the contig report.
PLOIDY_COLUMNS = (
    "contig average_straincount whole_contig_multiplicity approximate_coverage_ignoring_indels total_vartig_bases_covered "
    "average_straincount_min15hapq average_straincount_min30hapq average_straincount_min45hapq avg_err"
).split()


def vartigs(ranges: DataFrame, piled: DataFrame, block_length: float) -> DataFrame:
    """One consensus string and its scores for each part; base ranges count from 1."""
    keys = ["contig", "part"]
    inside = within(piled, ranges)
    text = allele_string(consensus(inside, *keys), *keys)
    bases = ranges.select(*keys, F.col("l_site").alias("l"), F.col("r_site").alias("r"), (F.col("l_base") + 1).alias("l_base"), (F.col("r_base") + 1).alias("r_base"))
    gap = lambda n: F.repeat(F.lit("?"), n.cast("int"))
    whole = F.concat(gap(F.col("l_site") - F.col("l")), "alleles", gap(F.col("r") - F.col("r_site")))
    stats = error_coverage(inside, *keys).select(*keys, F.round("cov", 3).alias("cov"), F.round("err", 4).alias("err"))
    score = hapq(ranges, piled, block_length).withColumn("rel_err", F.round("rel_err", 3))
    # sites of a part's range that none of its reads covers are `?`, also at its ends
    strings = text.join(bases, keys).select(*keys, F.col("l").alias("l_site"), F.col("r").alias("r_site"), whole.alias("alleles"), "l_base", "r_base")
    return strings.join(stats, keys).join(score, keys)


def vartig_info(ranges: DataFrame, piled: DataFrame, sites: DataFrame) -> DataFrame:
    """contig, part, site, pos, consensus, counts for every site of each part's range: `?` and `NA` where nothing covers it."""
    every = ranges.select("contig", "part", F.explode(F.sequence("l_site", "r_site")).alias("site"))
    pairs = F.array_sort(F.collect_list(F.struct("allele", "n")))
    seen = piled.groupBy("contig", "part", "site").agg(F.max_by("allele", F.struct("n", -F.col("allele"))).alias("best"), F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["allele"].cast("string"), x["n"].cast("string"))), "|").alias("counts"))
    rows = every.join(seen, ["contig", "part", "site"], "left").join(sites, ["contig", "site"])
    return rows.select("contig", "part", "site", "pos", F.coalesce(F.col("best").cast("string"), F.lit("?")).alias("consensus"), F.coalesce("counts", F.lit("NA")).alias("counts"))


def alt_ratio(found: DataFrame, least_length: int = 1000, least_cov: float = 1.5, least_hapq: int = 1) -> DataFrame:
    """contig, part, l_base, r_base, cov, width, ratio: segments of vartigs() for a plot, with the share of alleles 1 and 2
    among 0, 1 and 2; width is 0 below least_hapq."""
    alt, known = F.length(F.regexp_replace("alleles", "[^12]", "")), F.length(F.regexp_replace("alleles", "[^012]", ""))
    rows = found.where((F.col("r_base") - F.col("l_base") >= least_length) & (F.col("cov") >= least_cov) & (known > 0))
    return rows.select("contig", "part", "l_base", "r_base", "cov", F.when(F.col("hapq") >= least_hapq, 4).otherwise(0).alias("width"), F.round(alt / known, 6).alias("ratio"))


def header(folder: str = "out") -> Column:
    """The line above a part of vartigs(), as all reports have it; null values are written nan."""
    number = lambda c, digits: F.when(c.isNull(), "nan").otherwise(F.format_string(f"%.{digits}f", c))
    return F.concat(
        F.format_string(">HAP%s.%s\tCONTIG:%s\tSNPRANGE:%s-%s\tBASERANGE:%s-%s\tCOV:", F.col("part").cast("string"), F.lit(folder), F.col("contig").cast("string"), *[F.col(c).cast("string") for c in ("l_site", "r_site", "l_base", "r_base")]),
        number(F.col("cov"), 3), F.lit("\tERR:"), number(F.col("err"), 4), F.lit("\tHAPQ:"), F.col("hapq").cast("string"), F.lit("\tREL_ERR:"), number(F.col("rel_err"), 3),
    )


def _lines(*parts: Column) -> Column:
    return F.posexplode(F.array(*parts)).alias("k", "value")


def _ordered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.select("contig", F.struct(*order).alias("rn"), "value")


def vartig_lines(found: DataFrame, folder: str = "out") -> DataFrame:
    """contig, rn, value: header and allele string of each part."""
    return _ordered(found.select("contig", "part", _lines(header(folder), F.col("alleles"))), "part", "k")


def pooled_lines(found: DataFrame, folder: str = "out") -> DataFrame:
    """contig, rn, value: title and allele string of all reads of each contig, both in one value."""
    title = F.format_string(">HAP0.%s\tCONTIG:%s\tSNPRANGE:%s-%s\tBASERANGE:%s-%s\n", F.lit(folder), F.col("contig").cast("string"), *[F.col(c).cast("string") for c in ("l_site", "r_site", "l_base", "r_base")])
    return found.select("contig", F.lit(0).alias("rn"), F.concat(title, "alleles").alias("value"))


def vartig_info_lines(info: DataFrame, ranges: DataFrame, folder: str = "out") -> DataFrame:
    """contig, rn, value: a title for each part, then site:pos, consensus and counts of each site."""
    title = F.format_string(">HAP%s.%s\tSNPRANGE:%s-%s", F.col("part").cast("string"), F.lit(folder), F.col("l_site").cast("string"), F.col("r_site").cast("string"))
    heads = ranges.select("contig", "part", F.lit(0).alias("site"), title.alias("value"))
    body = info.select("contig", "part", "site", F.concat(F.col("site").cast("string"), F.lit(":"), F.col("pos").cast("string"), F.lit("\t"), F.col("consensus"), F.lit("\t"), F.col("counts"), F.lit("\t")).alias("value"))
    return _ordered(heads.union(body), "part", "site")


def haploset_lines(found: DataFrame, reads: DataFrame, folder: str = "out") -> DataFrame:
    """contig, rn, value: the header of each part, then name, first and last site of its reads in fragment order.

    reads: contig, part, frag_id, name, first_site, last_site.
    """
    heads = found.select("contig", "part", F.lit(0).alias("k"), F.lit(0).alias("first_site"), F.lit(0).alias("back"), F.lit(0).cast("long").alias("frag_id"), header(folder).alias("value"))
    body = reads.select("contig", "part", F.lit(1).alias("k"), "first_site", (-F.col("last_site")).alias("back"), "frag_id", F.concat_ws("\t", "name", F.col("first_site").cast("string"), F.col("last_site").cast("string")).alias("value"))
    return _ordered(heads.union(body), "part", "k", "first_site", "back", "frag_id")


def ploidy_lines(ploidy: DataFrame) -> DataFrame:
    """rn, value: the header and one line for each contig of contig_ploidy()."""
    cells = [F.col("contig").cast("string"), *[F.format_string("%.4f" if c == "avg_err" else "%.3f", F.col(c).cast("double")) for c in PLOIDY_COLUMNS[1:]]]
    rows = ploidy.select(F.col("contig").cast("string").alias("rn"), F.concat_ws("\t", *cells).alias("value"))
    return rows.union(ploidy.sparkSession.createDataFrame([("", "\t".join(PLOIDY_COLUMNS))], "rn string, value string"))


def _record(name: Column, seq: Column, qual: Column) -> Column:
    """The four lines of a read in one value, so that no file begins within a record; an absent read is one N."""
    absent = F.coalesce(F.length(seq), F.lit(0)) == 0
    return F.concat(F.lit("@"), name, F.lit("\n"), F.when(absent, F.lit("N")).otherwise(seq), F.lit("\n+\n"), F.when(absent, F.lit("!")).otherwise(qual))


def _read_order(reads: DataFrame) -> list[Column]:
    """part, and fragment order where the reads have their sites, else their ids."""
    site = lambda c: F.col(c) if c in reads.columns else F.lit(0)
    return [F.col("part"), site("first_site").alias("first_site"), (-site("last_site")).alias("back"), F.col("frag_id")]


def fastq_lines(reads: DataFrame) -> DataFrame:
    """contig, rn, value: the records of reads(contig, part, frag_id, name, seq, qual), a record in a value."""
    return reads.select("contig", F.struct(*_read_order(reads)).alias("rn"), _record(F.col("name"), F.col("seq"), F.col("qual")).alias("value"))


def paired_fastq_lines(reads: DataFrame) -> DataFrame:
    """contig, part, mate (1 or 2), rn, value: two records of each of reads(contig, part, frag_id, name, seqs, quals), with the
    same rn, so that both mates' files have the same reads in the same places.

    The second mate is reverse complemented; its qualities stay in the order of the alignment. Reads without any sequence
    are left out.
    """
    some = reads.where("seqs[0] <> '' or seqs[1] <> ''")
    record = lambda k: _record(F.concat("name", F.lit(f"/{k + 1}")), reverse_complement(F.col("seqs")[k]) if k else F.col("seqs")[k], F.col("quals")[k])
    rows = some.select("contig", "part", F.struct(*_read_order(reads)).alias("rn"), F.posexplode(F.array(record(0), record(1))).alias("mate", "value"))
    return rows.withColumn("mate", F.col("mate") + 1)


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists", gzip: bool = False, together: str | None = None) -> None:
    """Lines in order (rn), one folder for each contig, part and mate where they have one. together: a field of rn whose
    lines stay in one file. Files with the same number in the folders of both mates match line by line."""
    keys = [c for c in ("contig", "part", "mate") if c in lines.columns]
    order = F.col("rn")[together] if together else F.col("rn")
    ordered = lines.repartitionByRange(*[c for c in keys if c != "mate"], order).sortWithinPartitions(*keys, "rn")
    writer = ordered.select(*keys, "value").write.mode(mode).option("compression", "gzip" if gzip else "none")
    (writer.partitionBy(*keys) if keys else writer).text(path)


def tagged_alignments(lines: DataFrame, tags: DataFrame) -> DataFrame:
    """SAM lines with an HP tag by read name where tags(qname, hp) has one; lines without one stay as they are."""
    named = lines.withColumn("qname", F.when(~F.col("value").startswith("@"), F.substring_index("value", "\t", 1)))
    return named.join(tags, "qname", "left").select("line_no", F.when(F.col("hp").isNotNull(), F.concat("value", F.lit("\tHP:i:"), F.col("hp").cast("string"))).otherwise(F.col("value")).alias("value"))


def split_alignments(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """part, rn, value: SAM lines of the reads in parts(qname, part), the first part where a read has several; headers go
    to every part. write_lines lays out a folder for each."""
    first = parts.groupBy("qname").agg(F.min("part").alias("part"))
    head = lines.where("value like '@%'").select("line_no", "value").crossJoin(first.select("part").distinct())
    body = lines.where("value not like '@%'").withColumn("qname", F.substring_index("value", "\t", 1)).join(first, "qname")
    return head.select("part", F.col("line_no").alias("rn"), "value").union(body.select("part", F.col("line_no").alias("rn"), "value"))
