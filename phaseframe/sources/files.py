"""Readers of the text formats of phasing, over DataFrames of lines (value) or paths.

Every parser takes lines, so files, compressed or not, come through spark.read.text and tests through any
DataFrame. File order is a column `line_no`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phaseframe.operators.ranks import ranked
from phaseframe.operators.sequences import CHUNK, joined
from phaseframe.plans.storage import spread


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def parse_vcf(rows: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """contig, site (from 1), pos (from 0), alleles: records whose alleles are all single bases; FILTER is ignored.

    contigs(contig): only those count, as where they are what the alignments name.
    """
    cells = [F.get(F.split("value", "\t"), F.lit(k)) for k in range(5)]
    found = rows.where("value not like '#%' and value <> ''").select("line_no", cells[0].alias("contig"), (cells[1].cast("long") - 1).alias("pos"), F.concat(F.array(cells[3]), F.split(cells[4], ",")).alias("alleles"))
    found = found if contigs is None else found.join(contigs.select("contig").distinct(), "contig", "left_semi")
    snps = found.where(F.forall("alleles", lambda a: a.rlike("^[ACGTacgt]$"))).withColumn("alleles", F.transform("alleles", F.upper))
    return ranked(snps, ["contig"], [F.asc("line_no")]).select("contig", (F.col("rank") + 1).alias("site"), "pos", "alleles")


def site_positions(rows: DataFrame) -> DataFrame:
    return parse_vcf(rows).groupBy("contig").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "site"))), lambda x: x["pos"]).alias("positions"))


def contigs_of_vcf(rows: DataFrame) -> DataFrame:
    return rows.where("value not like '#%' and value <> ''").select(F.split("value", "\t")[0].alias("contig")).distinct()


#: Lines of a stretch within which headers are carried down in one group.
STRETCH = 1 << 16


def carried(rows: DataFrame, header: Column, name: str) -> DataFrame:
    """rows with the last header (not null) at or above each line: first within stretches of lines, then from the
    stretches before, of which only the last headers are looked at together."""
    split = rows.withColumn("stretch", F.floor(F.col("line_no") / STRETCH)).withColumn("h", header)
    inside = Window.partitionBy("stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = split.groupBy("stretch").agg(F.max_by("h", F.when(F.col("h").isNotNull(), F.col("line_no"))).alias("end"))
    before = last.withColumn("above", F.last("end", ignorenulls=True).over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))).drop("end")
    return split.withColumn("h", F.last("h", ignorenulls=True).over(inside)).join(before, "stretch").withColumn(name, F.coalesce("h", "above")).drop("h", "above", "stretch")


def with_contig_headers(rows: DataFrame) -> DataFrame:
    """A VCF's lines in order (rn), with a ##contig line for each contig before the third line."""
    third = rows.select("line_no").orderBy("line_no").limit(3).agg(F.max("line_no").alias("third"))
    headers = contigs_of_vcf(rows).crossJoin(third).select(F.format_string("##contig=<ID=%s>", "contig").alias("value"), (F.col("third") - 0.5).alias("rn"))
    return rows.select("value", F.col("line_no").cast("double").alias("rn")).union(headers).orderBy("rn", "value")


def sam_contigs(rows: DataFrame) -> DataFrame:
    """contig, length, ordinal of the header's sequence lines, in order."""
    found = rows.where("value like '@SQ%'").select("line_no", F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("long").alias("length"))
    return found.select("contig", "length", (F.row_number().over(Window.orderBy("line_no")) - 1).alias("ordinal"))


def parse_sam(rows: DataFrame) -> DataFrame:
    """contig, qname, flags, mapq, pos (from 0), cigar, seq, qual (codes less 33); records that do not parse are skipped."""
    cells = F.split("value", "\t")
    c = [F.get(cells, F.lit(k)) for k in range(11)]  # null where a line has fewer
    codes = F.transform(F.split(c[10], ""), lambda x: F.ascii(x) - 33)
    found = rows.where("value not like '@%'").where(F.size(cells) >= 11)
    return found.select(c[2].alias("contig"), c[0].alias("qname"), c[1].try_cast("int").alias("flags"), c[4].try_cast("int").alias("mapq"), (c[3].try_cast("long") - 1).alias("pos"), c[5].alias("cigar"), c[9].alias("seq"), codes.alias("qual")).where("flags is not null and pos is not null")


def parse_fasta(rows: DataFrame) -> DataFrame:
    """contig, seq, length; headers are carried down to the lines that follow."""
    return joined(fasta_chunks(rows)).withColumn("length", F.length("seq").cast("long"))


def fasta_chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """contig, chunk, seq: the sequences in chunks of `size` bases. Where a line begins in its contig is summed up within
    stretches of lines, then over the stretches."""
    marked = carried(rows, F.when(F.col("value").startswith(">"), F.regexp_extract("value", "^>(\\S+)", 1)), "contig")
    body = marked.where("value not like '>%' and value <> ''").select("contig", "line_no", "value", F.floor(F.col("line_no") / STRETCH).alias("stretch"), F.length("value").cast("long").alias("n"))
    before = lambda keys, order, what: F.coalesce(F.sum(what).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = body.groupBy("contig", "stretch").agg(F.sum("n").alias("total")).select("contig", "stretch", before(["contig"], "stretch", "total").alias("ahead"))
    placed = body.withColumn("inside", before(["contig", "stretch"], "line_no", "n")).join(totals, ["contig", "stretch"]).withColumn("at", F.col("ahead") + F.col("inside"))
    cut = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))))
    low, high = F.greatest("at", F.col("chunk") * size), F.least(F.col("at") + F.col("n"), (F.col("chunk") + 1) * size)
    pieces = cut.select("contig", "chunk", "at", F.substring("value", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "piece")))
    return pieces.groupBy("contig", "chunk").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("seq"))


def parse_fragments(rows: DataFrame) -> DataFrame:
    """name, site, allele, qual from lines `blocks name (start alleles)... qualities`."""
    c = F.split(F.trim("value"), "\\s+")
    parsed = rows.select(c.alias("c"), c[0].cast("int").alias("blocks"), c[1].alias("name"))
    block = parsed.select("name", F.element_at("c", -1).alias("quals"), F.posexplode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.col("c")[2 * i + 2].cast("int").alias("start"), F.col("c")[2 * i + 3].alias("alleles")))).alias("k", "b"))
    cells = block.select("name", "quals", "k", "b.start", F.posexplode(F.split("b.alleles", "")).alias("i", "allele"))
    at = F.row_number().over(Window.partitionBy("name").orderBy("k", "i"))
    return cells.withColumn("at", at).select("name", (F.col("start") + F.col("i")).alias("site"), F.col("allele").cast("int").alias("allele"), (F.ascii(F.substring("quals", F.col("at"), F.lit(1))) - 33).alias("qual"))


def parse_haplosets(rows: DataFrame) -> DataFrame:
    """part, cov, l_base, r_base, hapq, read: header lines carried down to the read lines below them."""
    below = carried(rows, F.when(F.col("value").startswith(">"), F.col("value")), "header").where("value not like '>%' and value <> ''")
    number = lambda pattern, kind: F.regexp_extract("header", pattern, 1).cast(kind)
    return below.select(number("HAP([0-9]+)", "int").alias("part"), number("COV:([0-9.]+)", "double").alias("cov"), number("BASERANGE:([0-9]+)-", "long").alias("l_base"), number("BASERANGE:[0-9]+-([0-9]+)", "long").alias("r_base"), number("HAPQ:([0-9]+)", "int").alias("hapq"), F.split("value", "\t")[0].alias("read"))


def reference_length(cigar: str) -> Column:
    """Bases of the reference that an alignment covers."""
    lengths, kinds = (F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(k)) for k in (1, 2))
    return F.aggregate(F.zip_with(lengths, kinds, lambda n, k: F.when(k.isin(*"MDN=X"), n.cast("long")).otherwise(0)), F.lit(0).cast("long"), lambda s, n: s + n)


def read_places(cigar: str, offset: Column) -> Column:
    """Array of the place in the read (from 0) of the base aligned `offset` bases from the alignment's start; empty if there
    is none. Operations are gone through once, and none of them is kept."""
    lengths, kinds = (F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(k)) for k in (1, 2))
    zero = F.lit(0).cast("long")

    def step(done: Column, o: Column) -> Column:
        here = o["op"].isin("M", "=", "X") & (done["ref_at"] <= offset) & (offset < done["ref_at"] + o["len"])
        ref_at = done["ref_at"] + F.when(o["op"].isin(*"MDN=X"), o["len"]).otherwise(0)
        read_at = done["read_at"] + F.when(o["op"].isin(*"MIS=X"), o["len"]).otherwise(0)
        return F.struct(ref_at.alias("ref_at"), read_at.alias("read_at"), F.when(here, F.array(done["read_at"] + offset - done["ref_at"])).otherwise(done["places"]).alias("places"))

    ops = F.zip_with(lengths, kinds, lambda n, k: F.struct(n.cast("long").alias("len"), k.alias("op")))
    start = F.struct(zero.alias("ref_at"), zero.alias("read_at"), F.array().cast("array<bigint>").alias("places"))
    return F.aggregate(ops, start, step, lambda done: done["places"])


def placed_operations(alignments: DataFrame) -> DataFrame:
    """alignments with ops: len and op of each CIGAR operation, and where it begins in the reference and the read.

    CIGAR arithmetic stays in the JVM: starts are running sums over arrays.
    """
    lengths = F.transform(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast("long"))
    cut = alignments.withColumn("ops", F.arrays_zip(lengths.alias("len"), F.regexp_extract_all("cigar", F.lit("[0-9]+([MIDNSHP=X])"), F.lit(1)).alias("op")))
    zero = F.struct(F.lit(0).cast("long").alias("len"), F.lit("").alias("op"), F.lit(0).cast("long").alias("ref_at"), F.lit(0).cast("long").alias("read_at"))
    # each operation begins where the one before it ends; the first element is a stop
    goes = lambda o, kinds: F.when(o["op"].isin(*kinds), o["len"]).otherwise(0)
    step = lambda done, o: F.concat(done, F.array(F.struct(o["len"].alias("len"), o["op"].alias("op"), (F.element_at(done, -1)["ref_at"] + goes(F.element_at(done, -1), "MDN=X")).alias("ref_at"), (F.element_at(done, -1)["read_at"] + goes(F.element_at(done, -1), "MIS=X")).alias("read_at"))))
    return cut.withColumn("ops", F.slice(F.aggregate("ops", F.array(zero), step), F.lit(2), F.greatest(F.size("ops"), F.lit(1))))


def aligned_bases(alignments: DataFrame, *others: str) -> DataFrame:
    """One row for each aligned base: ref_pos, read_pos (leading hard clips count), base, base_qual, and other columns.

    Alignments are dealt by stretches of the reference before they are laid out, so that no task has the bases of a whole
    file, and those of a place are next to each other.
    """
    placed = placed_operations(spread(alignments, "contig", F.floor(F.col("pos") / CHUNK)))
    piece = placed.select("*", F.explode("ops").alias("p")).where(F.col("p.op").isin("M", "=", "X"))
    hard = F.when(F.col("ops")[0]["op"] == "H", F.col("ops")[0]["len"]).otherwise(0)
    base = piece.select("contig", "qname", "flags", "pos", "seq", "qual", *[c for c in others if c != "seq"], "p", hard.alias("hard"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p.len") - 1)).alias("i"))
    at = (F.col("p.read_at") + F.col("i")).cast("int")
    return base.select("contig", "qname", "flags", (F.col("pos") + F.col("p.ref_at") + F.col("i")).alias("ref_pos"), (at + F.col("hard")).cast("int").alias("read_pos"), F.upper(F.substring("seq", at + 1, F.lit(1))).alias("base"), F.col("qual")[at].alias("base_qual"), *others)


def allele_calls(alignments: DataFrame, sites: DataFrame, *others: str) -> DataFrame:
    """Observations: aligned bases that match an allele of a site, with other columns of the alignments."""
    # what the bases take is not what the file's size says, so they are not to be broadcast
    met = aligned_bases(alignments, *others).hint("merge").join(sites.withColumnRenamed("pos", "ref_pos"), ["contig", "ref_pos"])
    allele = F.array_position("alleles", F.col("base")) - 1
    return met.withColumn("allele", allele.cast("int")).where("allele >= 0").select("contig", "qname", "flags", "site", "allele", F.col("base_qual").alias("qual"), "read_pos", *others)


def natural_order(name: str) -> Column:
    """A key by which names sort with their numbers as numbers: digits padded, by a dozen at least."""
    parts = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 12, "0")).otherwise(x)), "")
