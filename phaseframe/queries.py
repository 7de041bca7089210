"""Named queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phaseframe.functions import scalars as X
from phaseframe.operators import columns as CO
from phaseframe.operators import combine as C
from phaseframe.operators import distances as D
from phaseframe.operators import filters as FL
from phaseframe.operators import intervals as I
from phaseframe.operators import parts as PT
from phaseframe.operators import pileup as P
from phaseframe.operators import ranks as R
from phaseframe.operators import sequences as SQ
from phaseframe.operators import windows as W
from phaseframe.plans import phasing
from phaseframe.plans.storage import kept
from phaseframe.sources import bindings as B
from phaseframe.sources import files as S
from phaseframe.sources import sinks as K

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

OBS_L = """obs AS (SELECT contig, frag_id, site, (site - 1) * 1000 AS pos, allele, qual, 1 - pow(10.0, -qual / 10.0) AS weight FROM (
 SELECT l_linestatus AS contig, l_orderkey AS frag_id, CAST(l_suppkey + 1 AS INT) AS site, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS allele, CAST(l_quantity AS INT) AS qual,
 row_number() OVER (PARTITION BY l_linestatus, l_orderkey, l_suppkey ORDER BY l_linenumber DESC, l_partkey DESC, l_shipdate DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1)"""
OBS_E = """ev AS (SELECT CAST(user_id % 4 AS INT) AS contig, CAST(user_id * 10000 + floor((floor(epoch(ts) / 3600) + 72) / 168) AS BIGINT) AS frag_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, CAST(floor(value * 40 / 490) AS INT) AS qual, event_id FROM events),
 one AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY contig, frag_id, hour ORDER BY event_id DESC) = 1),
 obs AS (SELECT contig, frag_id, CAST(dense_rank() OVER (PARTITION BY contig ORDER BY hour) AS INT) AS site, CAST((hour - min(hour) OVER (PARTITION BY contig)) * 60 AS BIGINT) AS pos, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS allele, qual, 1 - pow(10.0, -qual / 10.0) AS weight FROM one)"""
FRAGS = "frags AS (SELECT contig, frag_id, min(site) AS first_site, max(site) AS last_site, min(pos) AS first_base, max(pos) AS last_base, count(*) AS n_sites FROM obs GROUP BY ALL)"
PART_R = "pobs AS (SELECT *, CAST(frag_id % 3 AS INT) AS part FROM obs)"
PART_W = "pobs AS (SELECT *, CAST((frag_id // 10000) % 3 * 10000 + frag_id % 10000 AS INT) AS part FROM obs)"
PILE = "pile AS (SELECT contig, part, site, allele, sum(weight) AS weight, count(*) AS n FROM pobs GROUP BY ALL)"
BEST = "best AS (SELECT * FROM pile QUALIFY row_number() OVER (PARTITION BY contig, part, site ORDER BY round(weight, 9) DESC, allele) = 1)"
RANGES = "ranges AS (SELECT contig, part, min(site) AS l_site, max(site) AS r_site, min(pos) AS l_base, max(pos) AS r_base, count(DISTINCT frag_id) AS n_reads FROM pobs GROUP BY ALL)"
STATS = "per AS (SELECT contig, part, site, max(n) AS top, sum(n) AS support FROM pile GROUP BY ALL), stats AS (SELECT contig, part, sum(support) / count(*) AS cov, sum(support - top) / sum(support) AS err, CAST(sum(support - top) AS BIGINT) AS errors, CAST(sum(support) AS BIGINT) AS support FROM per GROUP BY ALL)"
OVER = "overs AS (SELECT a.contig, a.part, b.part AS other, least(1.0, least(a.r_site - b.l_site + 1, b.r_site - a.l_site + 1) / (a.r_site - a.l_site + 1)) AS overlap FROM ranges a JOIN ranges b ON a.contig = b.contig AND a.part <> b.part AND a.l_site < b.r_site AND b.l_site < a.r_site)"
DIST = "dist AS (SELECT a.contig, a.part, b.part AS other, count(*) FILTER (a.allele = b.allele) AS same, count(*) FILTER (a.allele <> b.allele) AS diff FROM best a JOIN best b ON a.contig = b.contig AND a.site = b.site AND a.part <> b.part GROUP BY ALL)"
BLOCK = 2880.0
HAPQ = f"""pen AS (SELECT o.contig, o.part, max(o.overlap * (1 - coalesce(d.diff / (d.same + d.diff), 1.0))) AS penalty FROM overs o LEFT JOIN dist d USING (contig, part, other) WHERE o.overlap > 0.05 GROUP BY ALL),
 hq AS (SELECT r.contig, r.part, CAST(CASE WHEN n_reads = 1 THEN 0 ELSE least(60, floor(40 * (1 - coalesce(penalty, 0.0)) * least(1.0, n_reads / 3) * greatest(0.0, ln((r_base - l_base) / {BLOCK} + 1)))) END AS INT) AS hapq, s.err / nullif(t.mean_err, 0) AS rel_err
 FROM ranges r LEFT JOIN pen USING (contig, part) JOIN stats s USING (contig, part) JOIN (SELECT contig, sum(errors) / sum(support) AS mean_err FROM stats GROUP BY ALL) t ON t.contig = r.contig)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


_L, _E = _with(OBS_L), _with(OBS_E)
_LP, _EP = _with(OBS_L, PART_R, PILE), _with(OBS_E, PART_W, PILE)
_ALL = _with(OBS_E, PART_W, PILE, BEST, RANGES, STATS, OVER, DIST, HAPQ)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of weights depend on order in their last digits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _l(s, d):
    return B.obs_from_lineitem(s, d)


def _e(s, d):
    return B.obs_from_events(s, d)


def _lp(s, d):
    return B.parts_by_remainder(_l(s, d))


def _ep(s, d):
    return B.parts_by_week(_e(s, d))


# sources: text made from tables, then parsed

#: Lines of a VCF from part: contig = size group, position = key, alleles by price.
_VCF = "SELECT p_partkey AS line_no, concat_ws('\t', concat('c', CAST(p_size % 5 AS STRING)), CAST(p_partkey * 7 AS STRING), '.', substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1), CASE WHEN p_partkey % 11 = 0 THEN 'AT' WHEN p_partkey % 7 = 0 THEN 'c,G' ELSE 'T' END, '50', 'PASS') AS value FROM part"
_VCF_SQL = "v AS (SELECT p_partkey AS line_no, 'c' || (p_size % 5) AS contig, p_partkey * 7 - 1 AS pos, substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1) AS ref, CASE WHEN p_partkey % 11 = 0 THEN 'AT' WHEN p_partkey % 7 = 0 THEN 'C,G' ELSE 'T' END AS alt FROM part), sites AS (SELECT contig, CAST(row_number() OVER (PARTITION BY contig ORDER BY line_no) AS INT) AS site, pos, ref || ',' || alt AS alleles FROM v WHERE alt <> 'AT')"


def _vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    B.read(spark, sf_dir, "part").createOrReplaceTempView("part_for_vcf")
    rows = spark.sql(_VCF.replace("FROM part", "FROM part_for_vcf"))
    return rows.union(spark.createDataFrame([(-2, "##fileformat=VCFv4.2"), (-1, "#CHROM\tPOS")], "line_no long, value string"))


def _sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alignment a part: position = key, 10 bases (or clipped, spliced ones), flags and quality by key."""
    p = B.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    cigar = F.when(k % 3 == 0, "2S3M1D2M1I2M").when(k % 3 == 1, "10M").otherwise("4M2N6M")
    flags = F.when(k % 13 == 0, 1024).when(k % 10 == 0, 2048).when(k % 9 == 0, 256).otherwise(16 * (k % 2))
    row = F.concat_ws("\t", F.concat(F.lit("r"), k), flags.cast("string"), F.concat(F.lit("c"), k % 3), (k * 3 + 1).cast("string"), (k % 61).cast("string"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGTACGTAC"), F.lit("ABCDEFGHIJ"))
    ends = p.groupBy((k % 3).alias("c")).agg((F.max("p_partkey") * 3 + 100).alias("n"))
    heads = ends.select((F.col("c") - 3).alias("line_no"), F.concat(F.lit("@SQ\tSN:c"), "c", F.lit("\tLN:"), "n").alias("value"))
    return p.select(k.alias("line_no"), row.alias("value")).union(heads)


_SAM_SQL = "a AS (SELECT p_partkey AS k, 'c' || (p_partkey % 3) AS contig, 'r' || p_partkey AS qname, CAST(CASE WHEN p_partkey % 13 = 0 THEN 1024 WHEN p_partkey % 10 = 0 THEN 2048 WHEN p_partkey % 9 = 0 THEN 256 ELSE 16 * (p_partkey % 2) END AS INT) AS flags, CAST(p_partkey % 61 AS INT) AS mapq, p_partkey * 3 AS pos, CASE p_partkey % 3 WHEN 0 THEN '2S3M1D2M1I2M' WHEN 1 THEN '10M' ELSE '4M2N6M' END AS cigar FROM part)"
#: Aligned (reference offset, read offset) of the three cigars.
_PAIRS_SQL = "offs AS (SELECT 0 AS m, unnest([0, 1, 2, 4, 5, 6, 7]) AS r, unnest([2, 3, 4, 5, 6, 8, 9]) AS q UNION ALL SELECT 1, unnest(range(10)), unnest(range(10)) UNION ALL SELECT 2, unnest([0, 1, 2, 3, 6, 7, 8, 9, 10, 11]), unnest(range(10))), bases AS (SELECT contig, qname, flags, pos + r AS ref_pos, CAST(q AS INT) AS read_pos, substr('ACGTACGTAC', q + 1, 1) AS base, CAST(q + 32 AS INT) AS base_qual FROM a JOIN offs ON k % 3 = m)"


@query(_with(_SAM_SQL) + "SELECT contig, qname, flags, mapq, pos, cigar, 'ACGTACGTAC' AS seq, CAST(CASE WHEN k % 4 > 0 THEN k % 5 END AS INT) AS hp FROM a WHERE contig = 'c1'")
def tagged_bam(s, d):
    """Alignments written as BAM files with tags and indexes, and one contig of them read back by its index."""
    import uuid

    from phaseframe.plans.storage import shared_folder
    from phaseframe.sources import bamsource as BS

    rows = S.parse_sam(_sam(s, d))
    k = F.regexp_extract("qname", "[0-9]+", 0).cast("int")
    tags = rows.where(k % 4 > 0).select("qname", (k % 5).alias("hp"))
    path = f"{shared_folder(s)}/bam-{uuid.uuid4().hex}"
    BS.write_split(BS.haplotagged(rows, tags), [(f"c{i}", 10**9) for i in range(3)], path)
    return BS.read_split(s, path, contig="c1").drop("qual")


#: Reads made from order lines: a part's lines lie over 20 bases of four contigs, a line's number gives its CIGAR; every
#: 25th base is a site where orders of odd keys have another base, and one base in 97 is wrong.
_DEEP_SQL = """deep AS (SELECT l_orderkey AS o, l_linenumber AS ln, 'g' || (l_partkey % 4) AS contig, (l_partkey // 4) * 20 + l_linenumber AS pos, l_linenumber % 3 AS kind, CASE l_linenumber % 3 WHEN 0 THEN 40 WHEN 1 THEN 29 ELSE 47 END AS reach, CASE l_linenumber % 3 WHEN 0 THEN 40 WHEN 1 THEN 30 ELSE 50 END AS length FROM lineitem WHERE l_orderkey % 19 <> 0),
 cover AS (SELECT DISTINCT contig, pos + unnest(range(reach)) AS p FROM deep), chosen AS (SELECT contig, p FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY p) - 1 AS n FROM cover) WHERE n % 50 = 0),
 col AS (SELECT c.contig, c.p, length, substr('ACGT', CAST((p * 7 + p // 3 + CASE WHEN p % 25 = 7 AND o % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN (o * 31 + p * 17) % 97 = 0 THEN 2 ELSE 0 END) % 4 + 1 AS BIGINT), 1) AS base FROM chosen c JOIN deep d ON d.contig = c.contig AND c.p BETWEEN pos AND pos + reach - 1 WHERE NOT (kind = 1 AND c.p - pos IN (20, 21)))"""


def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alignments as parse_sam gives them, up to 100 deep; lines of every 19th order are duplicates."""
    rows = B.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o", "l_partkey", "l_linenumber AS ln", "l_quantity", "l_linenumber % 3 AS kind", "l_partkey div 4 * 20 + l_linenumber AS pos")
    # the genome without strains and errors repeats itself after 12 bases; what differs are two sites and an error at most
    plain = "".join("ACGT"[(p * 7 + p // 3) % 4] for p in range(12))
    letter = "substr('ACGT', cast(({p} * 7 + {p} div 3 + if({p} % 25 = 7 AND o % 2 = 1, 1, 0) + if((o * 31 + {p} * 17) % 97 = 0, 2, 0)) % 4 + 1 AS int), 1)"
    rows = rows.selectExpr("*", f"substr(repeat('{plain}', 6), cast(pos % 12 + 1 AS int), 47) AS g", "pos + pmod(7 - pos, 25) AS site", "pos + pmod(-(o * 1240) - pos, 97) AS wrong")
    # each text is named once, or the optimizer writes it out again and again; letters behind the 47th are not read
    for p in ("site", "site + 25", "wrong"):
        rows = rows.withColumn("g", F.expr(f"overlay(g, {letter.format(p=f'({p})')}, cast({p} - pos + 1 AS int))"))
    by_kind = lambda *x: f"element_at(array({', '.join(map(repr, x))}), kind + 1)"
    seq = f"concat({by_kind('', 'AAA', '')}, substr(overlay(g, {by_kind('', '', 'AAA')}, {by_kind(1, 21, 11)}, {by_kind(0, 2, 0)}), 1, {by_kind(40, 27, 50)}))"
    # as an element of an array the text is made once: a test of it cannot be pushed below that and make it anew
    made = rows.selectExpr("concat('g', l_partkey % 4) AS contig", "concat('r', o, '.', ln, '.', l_partkey, '.', l_quantity) AS qname", "if(o % 19 = 0, 1024, 0) AS flags", "60 AS mapq", "cast(pos AS bigint) AS pos", "element_at(array('40M', '3S20M2D7M', '10M3I37M'), kind + 1) AS cigar", f"explode(array({seq})) AS seq")
    return made.withColumn("qual", F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: (i % 40).cast("int")))


@query("SELECT 'c' || (p_partkey % 3) AS contig, CAST(max(p_partkey) * 3 + 100 AS BIGINT) AS length, CAST(p_partkey % 3 AS INT) AS ordinal FROM part GROUP BY p_partkey % 3")
def scan_contigs(s, d):
    return S.sam_contigs(_sam(s, d))


@query(_with(_SAM_SQL) + "SELECT contig, qname, flags, mapq, pos, cigar, 'ACGTACGTAC' AS seq, 'c' || 32 AS q FROM a")
def scan_alignments(s, d):
    return S.parse_sam(_sam(s, d)).select("contig", "qname", "flags", "mapq", "pos", "cigar", "seq", F.concat(F.lit("c"), F.col("qual")[0]).alias("q"))


@query(_with(_SAM_SQL) + "SELECT contig, qname, flags, mapq FROM a WHERE NOT ((flags & 2048) > 0 AND mapq < 60) AND mapq >= 15 AND (flags & 1796) = 0")
def filter_alignments(s, d):
    return FL.filter_alignments(S.parse_sam(_sam(s, d))).select("contig", "qname", "flags", "mapq")


@query(_with(_SAM_SQL) + "SELECT qname, pos FROM a WHERE contig = 'c1'")
def fetch_contig(s, d):
    """One contig's records; lines that cannot be read are skipped."""
    broken = s.createDataFrame([(10**9, "x\t0\tc1\tnowhere\t60\t1M\t*\t0\t0\tA\tI"), (10**9 + 1, "y\t0\tc1")], "line_no long, value string")
    return S.parse_sam(_sam(s, d).union(broken)).where("contig = 'c1'").select("qname", "pos")


@query(_with(_VCF_SQL) + "SELECT * FROM sites WHERE contig IN ('c0', 'c1', 'c2')")
def sites_of_alignments(s, d):
    """Sites on the contigs that the alignments' header names."""
    return S.parse_vcf(_vcf(s, d), S.sam_contigs(_sam(s, d))).withColumn("alleles", F.array_join("alleles", ","))


@query(_with(_SAM_SQL, _PAIRS_SQL) + "SELECT contig, ref_pos, count(*) AS depth, count(*) FILTER (base = 'A') AS a FROM bases GROUP BY ALL")
def pileup_depth(s, d):
    return S.aligned_bases(S.parse_sam(_sam(s, d))).groupBy("contig", "ref_pos").agg(F.count("*").alias("depth"), F.count_if(F.col("base") == "A").alias("a"))


@query(_with(_SAM_SQL, _PAIRS_SQL, _VCF_SQL) + "SELECT b.contig, qname, flags, site, CAST(list_position(string_split(alleles, ','), base) - 1 AS INT) AS allele, base_qual AS qual, read_pos FROM bases b JOIN sites s ON b.contig = s.contig AND b.ref_pos = s.pos WHERE list_contains(string_split(alleles, ','), base)")
def allele_calls(s, d):
    return S.allele_calls(S.parse_sam(_sam(s, d)), S.parse_vcf(_vcf(s, d)))


@query(_with(_VCF_SQL) + "SELECT * FROM sites")
def scan_sites(s, d):
    return S.parse_vcf(_vcf(s, d)).withColumn("alleles", F.array_join("alleles", ","))


@query(_with(_VCF_SQL) + "SELECT contig, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM sites GROUP BY contig")
def site_positions(s, d):
    return S.site_positions(_vcf(s, d)).withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


@query(_with(_VCF_SQL) + "SELECT DISTINCT contig FROM v")
def distinct_contigs(s, d):
    return S.contigs_of_vcf(_vcf(s, d))


@query(_with(_VCF_SQL) + "SELECT contig, pos, ref || ',' || alt AS alleles FROM v WHERE alt <> 'AT'")
def filter_snps(s, d):
    c = F.split("value", "\t")
    raw = _vcf(s, d).where("value not like '#%'").select(c[0].alias("contig"), (c[1].cast("long") - 1).alias("pos"), F.concat(F.array(c[3]), F.split(c[4], ",")).alias("alleles"))
    return FL.filter_snps(raw).withColumn("alleles", F.array_join("alleles", ","))


@query("SELECT 'c' || n_regionkey AS contig, string_agg(upper(n_name), '' ORDER BY n_nationkey) AS seq, CAST(sum(length(n_name)) AS BIGINT) AS length FROM nation GROUP BY n_regionkey")
def scan_reference(s, d):
    n = B.read(s, d, "nation")
    body = n.select((F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).cast("long").alias("line_no"), F.upper("n_name").alias("value"))
    heads = n.select((F.col("n_regionkey") * 1000).cast("long").alias("line_no"), F.concat(F.lit(">c"), "n_regionkey", F.lit(" x")).alias("value")).distinct()
    return S.parse_fasta(body.union(heads))


@query("SELECT 'f' || s_suppkey AS name, CAST(unnest([s_suppkey + 1, s_suppkey + 2, s_suppkey + 9]) AS INT) AS site, CAST(unnest([0, 1, 2]) AS INT) AS allele, CAST(unnest([32, 33, 34]) AS INT) AS qual FROM supplier")
def scan_fragments(s, d):
    k = F.col("s_suppkey")
    return S.parse_fragments(B.read(s, d, "supplier").select(F.concat_ws(" ", F.lit("2"), F.concat(F.lit("f"), k), (k + 1).cast("string"), F.lit("01"), (k + 9).cast("string"), F.lit("2"), F.lit("ABC")).alias("value")))


_SETS = "SELECT CAST(s_suppkey % 7 AS INT) AS part, 1.5 AS cov, s_suppkey % 7 + 1 AS l_base, s_suppkey % 7 + 90 AS r_base, CAST(s_suppkey % 7 * 10 AS INT) AS hapq, 'r' || s_suppkey AS read FROM supplier"


def _haplosets(s, d) -> DataFrame:
    part = F.col("s_suppkey") % 7
    rows = B.read(s, d, "supplier")
    reads = rows.select((part * 1_000_000 + 1 + F.col("s_suppkey")).alias("line_no"), F.concat(F.lit("r"), "s_suppkey", F.lit("\t1\t9")).alias("value"))
    heads = rows.select((part * 1_000_000).alias("line_no"), F.concat(F.lit(">HAP"), part, F.lit("\tCONTIG:c\tSNPRANGE:1-9\tBASERANGE:"), part + 1, F.lit("-"), part + 90, F.lit("\tCOV:1.500\tERR:0.1\tHAPQ:"), part * 10, F.lit("\tREL_ERR:1.0")).alias("value")).distinct()
    return reads.union(heads)


@query(_SETS)
def parse_haplosets(s, d):
    return S.parse_haplosets(_haplosets(s, d))


@query(f"SELECT * FROM ({_SETS}) WHERE hapq >= 30")
def filter_hapq(s, d):
    return S.parse_haplosets(_haplosets(s, d)).where("hapq >= 30")


@query(f"WITH t AS ({_SETS}) SELECT 'r' || s_suppkey || '' AS qname, max(t.part) AS hp FROM (SELECT unnest([s_suppkey, s_suppkey + 50]) AS s_suppkey FROM supplier) LEFT JOIN t ON t.read = 'r' || s_suppkey GROUP BY ALL")
def haplotag(s, d):
    tags = S.parse_haplosets(_haplosets(s, d)).groupBy("read").agg(F.max("part").alias("hp"))
    rows = B.read(s, d, "supplier").select(F.explode(F.array("s_suppkey", F.col("s_suppkey") + 50)).alias("k")).select(F.concat(F.lit("r"), "k").alias("qname")).distinct()
    return rows.join(tags, F.col("qname") == F.col("read"), "left").select("qname", "hp")


@query(f"WITH t AS ({_SETS}) SELECT min(part) AS part, read AS qname FROM t GROUP BY read")
def partition_reads(s, d):
    return S.parse_haplosets(_haplosets(s, d)).groupBy(F.col("read").alias("qname")).agg(F.min("part").alias("part"))


# pileups and statistics


@query(_LP + "SELECT contig, part, site, allele, round(weight, 6) AS weight FROM pile")
def pileup_weighted(s, d):
    return _r(P.pileup(_lp(s, d), "contig", "part").drop("n"), "weight")


@query(_EP + "SELECT contig, part, site, allele, n FROM pile")
def pileup_counts(s, d):
    return P.pileup(_ep(s, d), "contig", "part").drop("weight")


_BEST_L = _with(OBS_L, PART_R, PILE, BEST)
_BEST_E = _with(OBS_E, PART_W, PILE, BEST)


@query(_BEST_L + "SELECT contig, part, site, allele FROM best")
def consensus(s, d):
    return P.consensus(P.pileup(_lp(s, d), "contig", "part"), "contig", "part").select("contig", "part", "site", "allele")


_STRING = "span AS (SELECT contig, part, min(site) AS l, max(site) AS r FROM best GROUP BY ALL), full_ AS (SELECT contig, part, l, r, unnest(range(l, r + 1)) AS site FROM span), strings AS (SELECT f.contig, f.part, CAST(l AS INT) AS l_site, CAST(r AS INT) AS r_site, string_agg(coalesce(b.allele::VARCHAR, '?'), '' ORDER BY f.site) AS alleles FROM full_ f LEFT JOIN best b ON b.contig = f.contig AND b.part = f.part AND b.site = f.site GROUP BY ALL)"


@query(_with(OBS_L, "pobs AS (SELECT *, 0 AS part FROM obs)", PILE, BEST, _STRING) + "SELECT contig, l_site, r_site, alleles FROM strings")
def alignment_vartig(s, d):
    return P.allele_string(P.consensus(P.pileup(_l(s, d), "contig"), "contig"), "contig")


@query(
    _with(OBS_E, "pobs AS (SELECT *, 0 AS part FROM obs)", PILE, "best AS (SELECT * FROM pile QUALIFY row_number() OVER (PARTITION BY contig, part, site ORDER BY n DESC, allele) = 1)", _STRING, RANGES)
    + "SELECT contig, '>HAP0.out' || chr(9) || 'CONTIG:' || contig || chr(9) || 'SNPRANGE:' || s.l_site || '-' || s.r_site || chr(9) || 'BASERANGE:' || (l_base + 1) || '-' || (r_base + 1) || chr(10) || alleles AS value FROM strings s JOIN ranges USING (contig, part)"
)
def alignment_vartig_lines(s, d):
    """All reads of a contig as one part: by counts, with the header that other reports have."""
    whole = _e(s, d).withColumn("part", F.lit(0))
    text = P.allele_string(P.consensus(P.pileup(whole, "contig", "part"), "contig", "part", by="n"), "contig", "part")
    found = text.join(PT.part_ranges(whole).select("contig", "part", (F.col("l_base") + 1).alias("l_base"), (F.col("r_base") + 1).alias("r_base")), ["contig", "part"])
    return K.pooled_lines(found).select("contig", "value")


@query(
    _with(OBS_E, PART_W, PILE, BEST, _STRING, RANGES, STATS, OVER, DIST, HAPQ)
    + "SELECT contig, part, s.l_site, s.r_site, l_base + 1 AS l_base, r_base + 1 AS r_base, round(cov, 3) AS cov, round(err, 4) AS err, hapq, round(rel_err, 3) AS rel_err, alleles FROM strings s JOIN ranges USING (contig, part) JOIN stats USING (contig, part) JOIN hq USING (contig, part)"
)
def vartigs(s, d):
    return _vartigs(_ep(s, d))


def _parts(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges and pileup of parts, each computed once."""
    return kept(PT.part_ranges(obs)), kept(P.pileup(obs, "contig", "part"))


def _vartigs(obs: DataFrame) -> DataFrame:
    return K.vartigs(*_parts(obs), BLOCK)


@query(
    _with(OBS_E, PART_W, PILE, RANGES, "best AS (SELECT * FROM pile QUALIFY row_number() OVER (PARTITION BY contig, part, site ORDER BY n DESC, allele) = 1)", "every AS (SELECT contig, part, unnest(range(l_site, r_site + 1)) AS site FROM ranges)", "places AS (SELECT DISTINCT contig, site, pos FROM obs)")
    + "SELECT e.contig, e.part, CAST(e.site AS INT) AS site, p.pos, coalesce(b.allele::VARCHAR, '?') AS consensus, coalesce(c.counts, 'NA') AS counts FROM every e JOIN places p ON p.contig = e.contig AND p.site = e.site LEFT JOIN best b ON b.contig = e.contig AND b.part = e.part AND b.site = e.site LEFT JOIN (SELECT contig, part, site, string_agg(allele || ':' || n, '|' ORDER BY allele) AS counts FROM pile GROUP BY ALL) c ON c.contig = e.contig AND c.part = e.part AND c.site = e.site"
)
def vartig_info(s, d):
    obs = _ep(s, d)
    return K.vartig_info(*_parts(obs), B.sites_of(obs))


@query(_with(OBS_E, PART_W, RANGES, FRAGS) + "SELECT f.contig, p.part, f.frag_id, first_site, last_site, l_site, r_site FROM frags f JOIN (SELECT DISTINCT contig, frag_id, part FROM pobs) p ON p.contig = f.contig AND p.frag_id = f.frag_id JOIN ranges r ON r.contig = f.contig AND r.part = p.part")
def haplosets(s, d):
    obs = _ep(s, d)
    named = B.frags_of(obs).join(obs.select("contig", "frag_id", "part").distinct(), ["contig", "frag_id"])
    return named.join(PT.part_ranges(obs).select("contig", "part", "l_site", "r_site"), ["contig", "part"]).select("contig", "part", "frag_id", "first_site", "last_site", "l_site", "r_site")


_MEC = "SELECT contig, part, round(sum(top), 6) AS bases, round(sum(total - top + CASE WHEN top <= 1 THEN 0.04 ELSE 0 END), 6) AS errors FROM (SELECT contig, part, site, max({v}) AS top, sum({v}) AS total FROM pile GROUP BY ALL) GROUP BY ALL"


@query(_EP + _MEC.format(v="n"))
def mec_stats(s, d):
    return _r(P.mec_stats(P.pileup(_ep(s, d), "contig", "part"), 0.04, "contig", "part", by="n"), "bases", "errors")


@query(_EP + _MEC.format(v="weight"))
def mec_stats_phred(s, d):
    return _r(P.mec_stats(P.pileup(_ep(s, d), "contig", "part"), 0.04, "contig", "part"), "bases", "errors")


@query(_with(OBS_E, PART_W, PILE, STATS) + "SELECT contig, part, round(cov, 6) AS cov, round(err, 6) AS err, errors, support FROM stats")
def part_error_cov(s, d):
    return _r(P.error_coverage(P.pileup(_ep(s, d), "contig", "part"), "contig", "part"), "cov", "err")


@query(_with(OBS_E, PART_W, PILE, STATS) + "SELECT contig, round(sum(errors) / sum(support), 9) AS total_err FROM stats GROUP BY ALL")
def contig_error(s, d):
    stats = P.error_coverage(P.pileup(_ep(s, d), "contig", "part"), "contig", "part")
    return stats.groupBy("contig").agg(F.round(F.sum("errors") / F.sum("support"), 9).alias("total_err"))


@query(_EP + "SELECT contig, part, round(weight, 6) AS cov FROM (SELECT *, row_number() OVER (PARTITION BY contig, part ORDER BY weight) AS rn, count(*) OVER (PARTITION BY contig, part) AS c FROM pile) WHERE rn - 1 = c * 2 // 3")
def node_coverage(s, d):
    return P.indexed_quantile(_r(P.pileup(_ep(s, d), "contig", "part"), "weight"), "weight", 2, 3, "contig", "part").withColumnRenamed("weight", "cov")


@query(_with(OBS_E, FRAGS) + "SELECT contig, span FROM (SELECT contig, last_site - first_site AS span, row_number() OVER (PARTITION BY contig ORDER BY last_site - first_site) AS rn, count(*) OVER (PARTITION BY contig) AS c FROM frags) WHERE rn - 1 = c * 2 // 3")
def span_quantile(s, d):
    return P.indexed_quantile(B.frags_of(_e(s, d)).withColumn("span", F.col("last_site") - F.col("first_site")), "span", 2, 3, "contig")


@query(_L + "SELECT contig, max(site) AS max_site FROM obs GROUP BY contig")
def max_site(s, d):
    return _l(s, d).groupBy("contig").agg(F.max("site").alias("max_site"))


@query(
    _with(
        OBS_L, FRAGS, "cols AS (SELECT contig, site, count(*) AS n FROM obs GROUP BY contig, site, allele)", "ratio AS (SELECT contig, (sum(n) - max(n)) / max(n) AS r FROM cols GROUP BY contig, site HAVING sum(n) >= 5)",
        "eps AS (SELECT contig, r FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY r) AS rn, count(*) OVER (PARTITION BY contig) AS c FROM ratio) WHERE rn - 1 = c * 66 // 100)", "len AS (SELECT contig, l FROM (SELECT contig, last_base - first_base + 1 AS l, row_number() OVER (PARTITION BY contig ORDER BY last_base - first_base) AS rn, count(*) OVER (PARTITION BY contig) AS c FROM frags) WHERE rn - 1 = c * 66 // 100)",
    )
    + "SELECT contig, round(greatest(r, 0.01), 6) AS epsilon, CAST(greatest(l, 500) AS BIGINT) AS block_length FROM eps JOIN len USING (contig)"
)
def estimate_params(s, d):
    obs = _l(s, d)
    lengths = B.frags_of(obs).select("contig", (F.col("last_base") - F.col("first_base") + 1).alias("length"))
    return _r(P.estimate_parameters(P.pileup(obs, "contig"), lengths), "epsilon")


@query(
    _with(_DEEP_SQL, "site AS (SELECT contig, p, sum(n) AS depth, max(n) AS top FROM (SELECT contig, p, base, count(*) AS n FROM col GROUP BY ALL) GROUP BY ALL HAVING sum(n) >= 5)", "eps AS (SELECT r FROM (SELECT (depth - top) / top AS r, row_number() OVER (ORDER BY (depth - top) / top) AS rn, count(*) OVER () AS c FROM site) WHERE rn - 1 = c * 66 // 100)", "len AS (SELECT length FROM (SELECT length, row_number() OVER (ORDER BY length) AS rn, count(*) OVER () AS c FROM col) WHERE rn - 1 = c * 66 // 100)")
    + "SELECT round(greatest(r, 0.001), 6) AS epsilon, CAST(length AS BIGINT) AS block_length FROM eps, len"
)
def estimate_from_alignments(s, d):
    """Every 50th covered base; every 25th base is a site that half of the reads have otherwise, which leaves epsilon near
    the share of wrong bases."""
    return _r(CO.estimate_from_alignments(_deep(s, d), every=50, least_rate=0.001, least_length=1), "epsilon")


@query(_with(_DEEP_SQL) + "SELECT contig, p AS ref_pos, base, CAST(length AS INT) AS length, count(*) AS n FROM col GROUP BY ALL")
def sampled_columns(s, d):
    """The bases at every 50th covered base."""
    spans = CO.primary_spans(_deep(s, d))
    return CO.column_bases(spans, CO.sampled_columns(spans, 50), 400).groupBy("contig", "ref_pos", "base", "length").agg(F.count("*").alias("n"))


@query(
    _with(OBS_L, "pl AS (SELECT contig, site, allele, sum(weight) AS weight FROM obs GROUP BY ALL)", "rk AS (SELECT *, row_number() OVER (PARTITION BY contig, site ORDER BY weight DESC, allele) AS r FROM pl)", "dull AS (SELECT contig, site FROM rk GROUP BY ALL HAVING max(weight) FILTER (r = 2) IS NULL OR max(weight) FILTER (r = 1) * 0.9 > max(weight) FILTER (r = 2))")
    + "SELECT contig, frag_id, site, allele FROM obs ANTI JOIN dull USING (contig, site)"
)
def remove_monomorphic(s, d):
    return P.remove_monomorphic(_l(s, d), 0.9).select("contig", "frag_id", "site", "allele")


@query(_EP + "SELECT contig, part, site, allele, round(sum(weight), 6) AS weight FROM pobs WHERE frag_id % 2 = 0 GROUP BY ALL HAVING sum(weight) > 1e-9")
def pileup_delta(s, d):
    obs, keys = _ep(s, d), ("contig", "part")
    return _r(P.pileup_delta(P.pileup(obs.where("frag_id % 4 <> 0"), *keys), obs.where("frag_id % 4 = 0"), obs.where("frag_id % 2 = 1"), *keys), "weight")


@query(
    _E + ", c AS (SELECT a.contig, a.site, a.allele AS a, b.allele AS b, count(*) AS observed FROM obs a JOIN obs b ON a.contig = b.contig AND a.frag_id = b.frag_id AND b.site = a.site + 1 GROUP BY ALL) "
    "SELECT *, round(sum(observed) OVER (PARTITION BY contig, site, a) * sum(observed) OVER (PARTITION BY contig, site, b) / sum(observed) OVER (PARTITION BY contig, site), 6) AS expected FROM c"
)
def allele_cooccurrence(s, d):
    return _r(P.cooccurrence(_e(s, d), 1), "expected")


@query(
    _E + ", c AS (SELECT a.contig, a.site, a.allele AS a, b.allele AS b, count(*) AS o FROM obs a JOIN obs b ON a.contig = b.contig AND a.frag_id = b.frag_id AND b.site = a.site + 1 GROUP BY ALL), l AS (SELECT contig, site, a, sum(o) AS n_a FROM c GROUP BY ALL), r AS (SELECT contig, site, b, sum(o) AS n_b FROM c GROUP BY ALL), t AS (SELECT contig, site, sum(o) AS n FROM c GROUP BY ALL), "
    "e AS (SELECT l.contig, l.site, n_a * n_b / n AS e, coalesce(o, 0) AS o FROM l JOIN r USING (contig, site) JOIN t USING (contig, site) LEFT JOIN c USING (contig, site, a, b)) SELECT contig, site, round(sum(abs(o - e)), 6) AS deviation, round(sum((o - e) * (o - e) / e), 6) AS chi_square FROM e GROUP BY ALL"
)
def error_correlation(s, d):
    return _r(P.error_correlation(_e(s, d), 1).drop("p_value"), "deviation", "chi_square")


@query(_EP + "SELECT contig, part, round(sum(top), 6) AS same, round(sum(total - top), 6) AS diff FROM (SELECT contig, part, site, max(weight) AS top, sum(weight) AS total FROM pile GROUP BY ALL) GROUP BY ALL")
def partition_stats(s, d):
    return _r(P.mec_stats(P.pileup(_ep(s, d), "contig", "part"), 0.0, "contig", "part"), "bases", "errors").withColumnsRenamed({"bases": "same", "errors": "diff"})


_LOGP = "CASE WHEN {n} = 0 THEN 0.0 ELSE (CASE WHEN a < {p} THEN 1 ELSE -1 END) * ({n} / 0.25) * (a * ln(a / {p}) + (1 - a) * ln((1 - a) / (1 - {p}))) END"


@query(_with(OBS_E, PART_W, PILE, STATS) + "SELECT contig, part, round(" + _LOGP.format(n="support", p="0.04") + ", 4) AS pem FROM (SELECT *, CASE errors WHEN 0 THEN 1e-7 WHEN support THEN 0.9999999 ELSE errors / support END AS a FROM stats)")
def pem_score(s, d):
    stats = P.error_coverage(P.pileup(_ep(s, d), "contig", "part"), "contig", "part")
    return stats.select("contig", "part", F.round(X.binom_logp(F.col("support"), F.col("errors"), 0.04), 4).alias("pem"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(" + _LOGP.format(n="l_quantity", p="0.3") + ", 6) AS logp FROM (SELECT *, CASE WHEN l_linenumber % 8 >= l_quantity THEN 0.9999999 WHEN l_linenumber % 8 = 0 THEN 1e-7 ELSE (l_linenumber % 8) / l_quantity END AS a FROM lineitem)")
def binom_logp(s, d):
    k = F.least(F.col("l_linenumber") % 8, F.col("l_quantity"))
    return B.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(X.binom_logp(F.col("l_quantity"), k, 0.3), 6).alias("logp"))


@query("SELECT l_orderkey, round(max(l_discount) + ln(sum(exp(l_discount - m))), 6) AS lse FROM (SELECT *, max(l_discount) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY l_orderkey")
def log_sum_exp(s, d):
    rows = B.read(s, d, "lineitem")
    top = rows.groupBy("l_orderkey").agg(F.max("l_discount").alias("m"))
    return rows.join(top, "l_orderkey").groupBy("l_orderkey").agg(F.round(F.max("m") + F.log(F.sum(F.exp(F.col("l_discount") - F.col("m")))), 6).alias("lse"))


@query("SELECT DISTINCT l_quantity AS qual, round(1 - pow(10.0, -l_quantity / 10), 9) AS weight, CAST(least(l_quantity + 33, 255) AS INT) AS code FROM lineitem")
def phred_weight(s, d):
    q = F.col("l_quantity")
    return B.read(s, d, "lineitem").select(q.alias("qual")).distinct().select("qual", F.round(X.phred_weight(F.col("qual")), 9).alias("weight"), X.quality_byte(F.col("qual").cast("int")).alias("code"))


@query("SELECT DISTINCT CAST(l_linenumber AS INT) AS k, round(1 / 0.96 / (1 + 1 / (sqrt(l_linenumber) + 1)), 9) AS low, round(1 / 0.96 / (1 + 1 / (l_linenumber + 1 / 3)), 9) AS mid, round(1 / 0.96 / (1 + 1 / (l_linenumber + 1)), 9) AS high FROM lineitem")
def ploidy_threshold(s, d):
    k = F.col("k")
    rows = B.read(s, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("k")).distinct()
    return rows.select("k", *[F.round(X.ploidy_threshold(k, 0.04, n), 9).alias(c) for n, c in ((1, "low"), (2, "mid"), (3, "high"))])


@query("WITH q AS (SELECT DISTINCT l_quantity AS x, l_linenumber * 3 + 0.5 AS y FROM lineitem) SELECT x, y, round(-ln((exp(-x + floor(y) * ln(x) - lgamma(floor(y) + 1)) + exp(-y + floor(x) * ln(y) - lgamma(floor(x) + 1))) / 2), 6) AS dist FROM q")
def coverage_concordance(s, d):
    rows = B.read(s, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 3 + F.lit(0.5)).cast("double").alias("y")).distinct()
    return rows.select("x", "y", F.round(X.coverage_distance(F.col("x"), F.col("y")), 6).alias("dist"))


@query("SELECT n_nationkey, reverse(translate(upper(n_name), 'ACGT', 'TGCA')) AS rc FROM nation")
def revcomp(s, d):
    return B.read(s, d, "nation").select("n_nationkey", X.reverse_complement(F.upper("n_name")).alias("rc"))


# orders, windows, islands


@query(_with(OBS_E, FRAGS) + "SELECT contig, frag_id, first_site, last_site, CAST(row_number() OVER (PARTITION BY contig ORDER BY first_site, last_site DESC, frag_id) - 1 AS INT) AS rank FROM frags")
def fragment_order(s, d):
    return W.fragment_order(B.frags_of(_e(s, d))).select("contig", "frag_id", "first_site", "last_site", "rank")


@query(_E + "SELECT DISTINCT contig, site, pos FROM obs")
def site_ordinals(s, d):
    return B.sites_of(_e(s, d))


@query(_L + "SELECT contig, count(DISTINCT pos) AS n_sites FROM obs GROUP BY contig HAVING count(DISTINCT pos) >= 5")
def filter_contigs(s, d):
    return FL.filter_contigs(_l(s, d), 5)


@query(_with(OBS_E, FRAGS) + "SELECT contig, frag_id, first_site, last_site FROM frags WHERE last_site - first_site <= 60")
def filter_span(s, d):
    return FL.filter_span(B.frags_of(_e(s, d)), 60).select("contig", "frag_id", "first_site", "last_site")


#: The same recurrence as a walk over sites; state: window start, first site beyond L - L div 3, what is emitted.
_WINDOWS = """RECURSIVE base AS (SELECT DISTINCT contig, site, pos FROM obs), p AS (SELECT contig, list(pos ORDER BY site) AS ps FROM base GROUP BY contig),
 walk AS (SELECT contig, ps, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS s, CAST(NULL AS BIGINT) AS r, CAST(NULL AS BIGINT) AS el, CAST(NULL AS BIGINT) AS er FROM p
  UNION ALL SELECT contig, ps, i + 1,
   CASE WHEN i < len(ps) AND ps[i] - ps[s] > 2880 THEN CASE WHEN rr + 1 <= len(ps) AND ps[rr] + 2880 < ps[rr + 1] THEN rr ELSE rr + 1 END ELSE s END,
   CASE WHEN i < len(ps) AND ps[i] - ps[s] > 2880 THEN NULL ELSE rr END,
   CASE WHEN i = len(ps) OR (ps[i] - ps[s] > 2880 AND (i - s) / 2880 > 0.0005) THEN s END,
   CASE WHEN i = len(ps) THEN i WHEN ps[i] - ps[s] > 2880 AND (i - s) / 2880 > 0.0005 THEN i - 1 END
  FROM (SELECT *, coalesce(r, CASE WHEN ps[i] - ps[s] > 1920 THEN i END) AS rr FROM walk) WHERE i <= len(ps)),
 blocks AS (SELECT contig, CAST(row_number() OVER (PARTITION BY contig ORDER BY i) - 1 AS INT) AS block_id, CAST(el AS INT) AS l_site, CAST(er AS INT) AS r_site FROM walk WHERE el IS NOT NULL)"""


def _blocks_sql(*more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([OBS_E, _WINDOWS.removeprefix("RECURSIVE "), *more]) + " "


@query(_blocks_sql() + "SELECT * FROM blocks")
def block_windows(s, d):
    return W.block_windows(B.sites_of(_e(s, d)), 2880)


@query(_blocks_sql() + "SELECT * FROM blocks WHERE (r_site - l_site + 1) / 2880 > 0.006")
def filter_density(s, d):
    return FL.filter_density(W.block_windows(B.sites_of(_e(s, d)), 2880), 2880, 0.006)


@query(_blocks_sql(FRAGS) + "SELECT f.contig, block_id, frag_id FROM frags f JOIN blocks b ON f.contig = b.contig AND last_site >= l_site AND first_site <= r_site")
def reads_in_blocks(s, d):
    obs = _e(s, d)
    return phasing.reads_in_blocks(B.frags_of(obs), W.block_windows(B.sites_of(obs), 2880)).select("contig", "block_id", "frag_id")


@query(_with(OBS_E, FRAGS, PART_W, "pf AS (SELECT DISTINCT f.*, part FROM frags f JOIN pobs USING (contig, frag_id))", "b AS (SELECT *, CASE WHEN first_site > max(last_site) OVER (PARTITION BY contig, part ORDER BY first_site, last_site DESC, frag_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS br FROM pf)") + "SELECT contig, part, frag_id, CAST(sum(br) OVER (PARTITION BY contig, part ORDER BY first_site, last_site DESC, frag_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS piece FROM b")
def split_gaps(s, d):
    obs = _ep(s, d)
    frags = B.frags_of(obs).join(obs.select("contig", "frag_id", "part").distinct(), ["contig", "frag_id"])
    return W.split_gaps(frags, "contig", "part").select("contig", "part", "frag_id", "piece")


@query(_E + ", r AS (SELECT *, site - row_number() OVER (PARTITION BY contig, frag_id ORDER BY site) AS run FROM obs) SELECT contig, frag_id, min(site) AS start, string_agg(allele::VARCHAR, '' ORDER BY site) AS alleles FROM r GROUP BY contig, frag_id, run")
def fragment_blocks(s, d):
    return W.runs(_e(s, d), "contig", "frag_id")


@query(_EP + ", s AS (SELECT DISTINCT contig, part, site FROM pobs), w AS (SELECT *, count(*) OVER (PARTITION BY contig, part ORDER BY site RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b, count(*) OVER (PARTITION BY contig, part ORDER BY site RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a FROM s) SELECT contig, part, site FROM w WHERE b > 0 AND a = 0")
def coverage_breaks(s, d):
    return W.coverage_breaks(_ep(s, d), 5, "contig", "part")


@query(_with(OBS_E, PART_W, PILE) + ", w AS (SELECT DISTINCT contig, part, site FROM pobs), k AS (SELECT *, count(*) OVER (PARTITION BY contig, part ORDER BY site RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b, count(*) OVER (PARTITION BY contig, part ORDER BY site RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a FROM w), br AS (SELECT contig, part, site FROM k WHERE b > 0 AND a = 0), seg AS (SELECT contig, part, coalesce(lag(site) OVER (PARTITION BY contig, part ORDER BY site), 0) + 1 AS lo, site AS hi FROM br), f AS (SELECT contig, part, frag_id, min(site) AS a, max(site) AS z FROM pobs GROUP BY ALL) SELECT f.contig, f.part, frag_id, CAST(hi AS INT) AS seg_end FROM f JOIN seg ON f.contig = seg.contig AND f.part = seg.part AND a <= hi AND z >= lo")
def split_by_breaks(s, d):
    """Reads by the segments between breaks that they touch; a read over a break is in both."""
    obs = _ep(s, d)
    cuts = W.coverage_breaks(obs, 5, "contig", "part")
    segments = cuts.select("contig", "part", (F.coalesce(F.lag("site").over(Window.partitionBy("contig", "part").orderBy("site")), F.lit(0)) + 1).alias("lo"), F.col("site").alias("hi"))
    frags = obs.groupBy("contig", "part", "frag_id").agg(F.min("site").alias("a"), F.max("site").alias("z"))
    return I.overlap_join(frags, segments, ("a", "z"), ("lo", "hi"), ["contig", "part"], 64).select("contig", "part", "frag_id", F.col("hi").alias("seg_end"))


@query("SELECT o_custkey, o_orderkey, r FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS r FROM orders) WHERE r <= 3")
def topk_per_group(s, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return B.read(s, d, "orders").withColumn("r", F.row_number().over(order)).where("r <= 3").select("o_custkey", "o_orderkey", "r")


@query(_with(OBS_E, PART_W, RANGES) + "SELECT contig, part, CAST(row_number() OVER (PARTITION BY contig ORDER BY l_site, r_site, part) - 1 AS INT) AS index FROM ranges")
def part_order(s, d):
    return PT.part_order(PT.part_ranges(_ep(s, d))).select("contig", "part", "index")


@query(_with(OBS_E, PART_W, RANGES) + "SELECT contig, part, CAST(l_site AS INT) AS l_site, CAST(r_site AS INT) AS r_site, l_base, r_base FROM ranges")
def lift_ranges(s, d):
    """Site ranges of parts lifted to bases by joining the sites twice."""
    obs = _ep(s, d)
    ranges, sites = PT.part_ranges(obs).select("contig", "part", "l_site", "r_site"), B.sites_of(obs)
    left = sites.select("contig", F.col("site").alias("l_site"), F.col("pos").alias("l_base"))
    right = sites.select("contig", F.col("site").alias("r_site"), F.col("pos").alias("r_base"))
    return ranges.join(left, ["contig", "l_site"]).join(right, ["contig", "r_site"]).select("contig", "part", "l_site", "r_site", "l_base", "r_base")


@query(_blocks_sql(PART_R) + "SELECT DISTINCT b.contig, CAST(dense_rank() OVER (PARTITION BY b.contig ORDER BY block_id) - 1 AS INT) AS col, part AS cluster FROM blocks b JOIN pobs o ON o.contig = b.contig AND o.site BETWEEN l_site AND r_site")
def node_ids(s, d):
    return PT.numbered(_membership(s, d)).select("contig", "col", "cluster").distinct()


def _membership(s, d, obs: DataFrame | None = None) -> DataFrame:
    obs = B.parts_by_remainder(kept(_e(s, d)) if obs is None else obs)
    placed = phasing.reads_in_blocks(B.frags_of(obs), W.block_windows(B.sites_of(obs), 2880)).select("contig", "block_id", "l_site", "r_site", "frag_id")
    return placed.join(obs.select("contig", "frag_id", "site", "part"), ["contig", "frag_id"]).where("site between l_site and r_site").select("contig", "block_id", F.col("part").alias("cluster"), "frag_id", "l_site", "r_site").distinct()


# joins


@query(_L + "SELECT o.contig, frag_id, o.site, o.pos, allele FROM obs o JOIN supplier ON s_suppkey + 1 = o.site WHERE s_acctbal > 0")
def join_sites(s, d):
    """Observations at known sites: those of suppliers with money, on both contigs."""
    known = B.read(s, d, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") + 1).cast("int").alias("site"), (F.col("s_suppkey") * 1000).cast("long").alias("pos"), F.explode(F.array(F.lit("F"), F.lit("O"))).alias("contig"))
    return _l(s, d).select("contig", "frag_id", "pos", "allele").join(known, ["contig", "pos"]).select("contig", "frag_id", "site", "pos", "allele")


@query("WITH o AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'A' GROUP BY ALL) SELECT o_orderkey, n > 0 AS has_sites FROM o")
def split_by_sites(s, d):
    names = B.read(s, d, "orders").select("o_orderkey")
    seen = B.read(s, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    with_, without = FL.split_by_sites(names, seen, "o_orderkey")
    return with_.withColumn("has_sites", F.lit(True)).union(without.withColumn("has_sites", F.lit(False)))


@query("SELECT o_orderkey AS name, length(o_orderpriority) + length(o_orderstatus) AS length FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'A') USING (o_orderkey)")
def reads_without_sites(s, d):
    seen = B.read(s, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    _, without = FL.split_by_sites(B.read(s, d, "orders"), seen, "o_orderkey")
    return without.select(F.col("o_orderkey").alias("name"), (F.length("o_orderpriority") + F.length("o_orderstatus")).cast("long").alias("length"))


#: Pieces of reads made from events: a user's week is a read, its days (for every fifth user: its halves) are pieces.
_PIECES_SQL = """raw AS (SELECT *, (hour + 72) // 24 % 7 AS day, frag_id // 10000 AS user FROM ev), pe AS (SELECT *, CAST(CASE WHEN user % 5 = 0 THEN day // 4 ELSE day END AS INT) AS piece FROM raw),
 po AS (SELECT pe.contig, frag_id, piece, o.site, o.pos, (SELECT count(DISTINCT event_type) FROM ev x WHERE x.event_type < pe.event_type) AS allele, event_id FROM pe JOIN (SELECT DISTINCT contig, site, pos, pos // 60 AS h FROM obs) o ON o.contig = pe.contig AND o.h = pe.hour - (SELECT min(hour) FROM ev m WHERE m.contig = pe.contig)),
 p1 AS (SELECT contig, frag_id, piece, min(site) AS fs, max(site) AS ls, min(pos) AS fb, max(pos) AS lb FROM po GROUP BY ALL),
 p2 AS (SELECT *, CASE WHEN (frag_id // 10000) % 5 = 0 THEN CASE WHEN frag_id % 7 = 0 THEN 1 WHEN (frag_id + piece) % 2 = 0 THEN 65 ELSE 129 END WHEN (frag_id + piece) % 3 = 0 THEN 0 ELSE 2048 END AS flags FROM p1),
 p3 AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (flags & 192 > 0) OVER w AS np, lead(fb) OVER (PARTITION BY contig, frag_id ORDER BY fs, ls) - lb AS gap, flags & 2048 = 0 AS main, row_number() OVER (PARTITION BY contig, frag_id, flags & 2048 ORDER BY fb DESC, piece DESC) AS mp, row_number() OVER (PARTITION BY contig, frag_id ORDER BY flags, fs, ls DESC, piece) AS pl, row_number() OVER (PARTITION BY contig, frag_id ORDER BY fb, piece) AS bp FROM p2 WINDOW w AS (PARTITION BY contig, frag_id)),
 p4 AS (SELECT *, coalesce(bool_or(gap > 2000) OVER w, false) AS wide, bool_or(main) OVER w AS has, first_value(flags) OVER (PARTITION BY contig, frag_id ORDER BY pl) AS lf FROM p3 WINDOW w AS (PARTITION BY contig, frag_id)),
 p5 AS (SELECT *, n = 2 AND np = 2 AS mates, (lf & 64 > 0 AND pl = 1) OR (lf & 64 = 0 AND pl = 2) AS base, main AND mp = 1 AS prim FROM p4),
 p6 AS (SELECT *, CASE WHEN mates THEN CASE WHEN base THEN 0 ELSE 1 END WHEN prim THEN 0 ELSE bp END AS turn FROM p5 WHERE CASE WHEN mates THEN true WHEN n = 1 THEN main ELSE has AND (prim OR NOT wide) END)"""


def _pieces(s, d) -> tuple[DataFrame, DataFrame]:
    """Pieces of reads, and their observations."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0)
    raw = B.read(s, d, "events").select(F.pmod("user_id", F.lit(4)).cast("int").alias("contig"), "user_id", (F.col("user_id") * 10000 + F.floor((hour + 72) / 168.0)).alias("name"), hour.alias("hour"), "event_id", "event_type")
    kinds = raw.select("event_type").distinct().agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    hours = raw.select("contig", "hour").distinct().withColumn("site", F.dense_rank().over(Window.partitionBy("contig").orderBy("hour"))).withColumn("start", F.min("hour").over(Window.partitionBy("contig")))
    day = F.floor((F.col("hour") + 72) / 24) % 7
    piece = F.when(F.col("user_id") % 5 == 0, F.floor(day / 4)).otherwise(day).cast("int")
    obs = raw.withColumn("piece", piece).join(hours, ["contig", "hour"]).crossJoin(kinds).select("contig", "name", "piece", "site", ((F.col("hour") - F.col("start")) * 60).alias("pos"), (F.array_position("kinds", F.col("event_type")) - 1).cast("int").alias("allele"), F.lit(30).alias("qual"), F.col("event_id").alias("seq_pos"))
    last = obs.groupBy("contig", "name", "piece", "site").agg(F.max_by(F.struct("pos", "allele", "qual", "seq_pos"), "seq_pos").alias("o")).select("contig", "name", "piece", "site", "o.*")
    k = F.col("name") + F.col("piece")
    paired = F.when(F.col("name") % 7 == 0, 1).when(k % 2 == 0, 65).otherwise(129)
    flags = F.when(F.floor(F.col("name") / 10000) % 5 == 0, paired).when(k % 3 == 0, 0).otherwise(2048)
    pieces = last.groupBy("contig", "name", "piece").agg(F.min("site").alias("first_site"), F.max("site").alias("last_site"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    # alignments reach far beyond their sites, which must not change what counts as a gap
    pieces = pieces.withColumn("first_base", F.col("first_pos") - 900).withColumn("last_base", F.col("last_pos") + 1300)
    return pieces.withColumn("flags", flags).withColumn("pos", F.col("first_pos")).withColumn("cigar", F.lit("*")), last


@query(_with(OBS_E, _PIECES_SQL) + "SELECT contig, frag_id AS name, site, CAST(arg_max(allele, turn * 1000000000 + event_id) AS INT) AS allele, CAST(arg_max(CASE WHEN mates AND turn = 1 THEN 1 ELSE 0 END, turn * 1000000000 + event_id) AS INT) AS mate FROM po JOIN p6 USING (contig, frag_id, piece) GROUP BY contig, frag_id, site")
def combine_reads(s, d):
    """Mates and supplementary pieces of a read merged; in one piece the last event of an hour is its observation."""
    pieces, obs = _pieces(s, d)
    return C.combine_pieces(obs, C.usable_pieces(pieces, 2000)).select("contig", "name", "site", "allele", "mate")


@query(_with(OBS_E, _PIECES_SQL) + "SELECT contig, frag_id AS name, bool_or(flags & 192 > 0) AS is_paired, CAST(min(fs) AS INT) AS first_site, CAST(max(ls) AS INT) AS last_site, min(fb - 900) AS first_base, max(lb + 1300) AS last_base FROM p6 GROUP BY contig, frag_id")
def combined_ranges(s, d):
    return C.combined_ranges(C.usable_pieces(_pieces(s, d)[0], 2000))


@query(_with(OBS_E, _PIECES_SQL) + "SELECT contig, frag_id AS name, coalesce(max('p' || piece) FILTER (turn = 0 AND NOT (mates AND turn = 1)), '') AS first, coalesce(max('p' || piece) FILTER (mates AND turn = 1), '') AS second FROM p6 GROUP BY contig, frag_id")
def mate_slots(s, d):
    """The sequences of a read's first and second mate: here the name of their pieces."""
    pieces = C.usable_pieces(_pieces(s, d)[0], 2000).withColumn("seq", F.concat(F.lit("p"), "piece"))
    return C.slots(pieces, "seq").select("contig", "name", F.col("seq")[0].alias("first"), F.col("seq")[1].alias("second"))


_EDGES = """mem AS (SELECT DISTINCT b.contig, block_id, part AS cluster, frag_id, l_site, r_site FROM blocks b JOIN pobs o ON o.contig = b.contig AND o.site BETWEEN l_site AND r_site),
 cols AS (SELECT contig, block_id, CAST(row_number() OVER (PARTITION BY contig ORDER BY block_id) - 1 AS INT) AS col FROM (SELECT DISTINCT contig, block_id FROM mem)), m AS (SELECT * FROM mem JOIN cols USING (contig, block_id)),
 pil AS (SELECT m.contig, col, cluster, site, allele, sum(weight) AS w FROM m JOIN obs o ON o.contig = m.contig AND o.frag_id = m.frag_id AND site BETWEEN l_site AND r_site GROUP BY ALL), tops AS (SELECT contig, col, cluster, site, max(w) AS top FROM pil GROUP BY ALL),
 prev AS (SELECT DISTINCT contig, col + 1 AS col, frag_id FROM m), every AS (SELECT p.contig, p.col, p.frag_id, c.cluster FROM prev p JOIN (SELECT DISTINCT contig, col, cluster FROM m) c ON c.contig = p.contig AND c.col = p.col),
 d0 AS (SELECT t.contig, t.col, p.frag_id, t.cluster, round(round(sum(CASE WHEN round(coalesce(x.w, 0), 9) = round(t.top, 9) THEN 0 ELSE o.weight END), 6)) AS d FROM prev p JOIN obs o ON o.contig = p.contig AND o.frag_id = p.frag_id JOIN tops t ON t.contig = p.contig AND t.col = p.col AND t.site = o.site LEFT JOIN pil x ON x.contig = t.contig AND x.col = t.col AND x.cluster = t.cluster AND x.site = t.site AND x.allele = o.allele GROUP BY ALL),
 d AS (SELECT contig, col, frag_id, cluster, coalesce(d, 0) AS d FROM every LEFT JOIN d0 USING (contig, col, frag_id, cluster)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY contig, col, frag_id ORDER BY d) AS r, min(d) OVER (PARTITION BY contig, col, frag_id) AS least FROM d), tied AS (SELECT contig, col - 1 AS col, frag_id FROM ranked WHERE r = 2 AND d = least)"""


@query(_blocks_sql(PART_R, _EDGES) + "SELECT a.contig, a.col, a.cluster AS row_from, b.cluster AS row_to, count(*) AS weight FROM m a JOIN m b ON a.contig = b.contig AND b.col = a.col + 1 AND a.frag_id = b.frag_id WHERE NOT EXISTS (SELECT 1 FROM tied t WHERE t.contig = a.contig AND t.col = a.col AND t.frag_id = a.frag_id) GROUP BY ALL HAVING count(*) >= 2")
def block_edges(s, d):
    obs = kept(_e(s, d))
    return PT.block_edges(_membership(s, d, obs), obs)


@query(
    _blocks_sql(PART_R, _EDGES)
    + ", nd AS (SELECT contig, col, cluster, min(block_id) AS block_id, min(l_site) AS l_site, max(r_site) AS r_site, count(*) AS n_reads FROM m GROUP BY ALL), cv AS (SELECT contig, col, cluster, w FROM (SELECT *, row_number() OVER (PARTITION BY contig, col, cluster ORDER BY w) AS rn, count(*) OVER (PARTITION BY contig, col, cluster) AS c FROM pil) WHERE rn - 1 = c * 2 // 3) "
    "SELECT nd.*, CAST(row_number() OVER (PARTITION BY nd.contig ORDER BY nd.col, nd.cluster) - 1 AS INT) AS node_id, round(w, 6) AS cov FROM nd LEFT JOIN cv USING (contig, col, cluster)"
)
def hap_nodes(s, d):
    return PT.hap_nodes(_membership(s, d), _e(s, d))


@query(_with(OBS_E, PART_W, RANGES, OVER) + "SELECT contig, part, other, round(overlap, 6) AS overlap FROM overs WHERE overlap > 0.05")
def part_overlaps(s, d):
    return _r(PT.part_overlaps(PT.part_ranges(_ep(s, d))), "overlap")


@query(_with(OBS_E, FRAGS, PART_W, RANGES, "wide AS (SELECT *, CASE WHEN frag_id // 10000 % 2 = 1 THEN 600 ELSE 0 END AS pad FROM frags)") + "SELECT f.contig, f.frag_id FROM wide f WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.contig = f.contig AND r.part % 2 = 0 AND f.first_base - pad <= r.r_base AND r.l_base <= f.last_base + pad)")
def gap_reads(s, d):
    """Reads of every second user are taken to be paired."""
    obs = _ep(s, d)
    ranges = PT.part_ranges(obs).where("part % 2 = 0")
    reads = B.frags_of(obs).select("contig", "frag_id", (F.floor(F.col("frag_id") / 10000) % 2 == 1).alias("is_paired"), "first_base", "last_base")
    return PT.gap_reads(reads, ranges, 600).select("contig", "frag_id")


@query(_with(OBS_E, PART_W, PILE, BEST, DIST) + "SELECT contig, part, other, same, diff FROM dist WHERE part < other")
def haplotype_distance(s, d):
    return D.haplotype_distance(P.pileup(_ep(s, d), "contig", "part"), ["contig"], "part")


_TOPS = "t AS (SELECT contig, part, site, max(weight) AS top FROM pile GROUP BY ALL), ties AS (SELECT p.contig, p.part, p.site, t.top, count(*) AS k FROM pile p JOIN t ON p.contig = t.contig AND p.part = t.part AND p.site = t.site AND round(p.weight, 9) = round(t.top, 9) GROUP BY ALL)"


@query(_with(OBS_L, PART_R, PILE, _TOPS) + "SELECT o.contig, o.frag_id, t.part, CAST(round(round(sum(CASE WHEN round(coalesce(p.weight, 0), 9) = round(t.top, 9) AND k = 1 THEN o.weight ELSE 0 END), 6)) AS BIGINT) AS same, CAST(round(round(sum(CASE WHEN round(coalesce(p.weight, 0), 9) = round(t.top, 9) THEN 0 ELSE o.weight END), 6)) AS BIGINT) AS diff FROM obs o JOIN ties t ON o.contig = t.contig AND o.site = t.site LEFT JOIN pile p ON p.contig = t.contig AND p.part = t.part AND p.site = t.site AND p.allele = o.allele GROUP BY ALL")
def read_hap_distance(s, d):
    obs = kept(_lp(s, d))
    return D.read_haplotype_distance(obs.drop("part"), P.pileup(obs, "contig", "part"), ["contig"], "part")


@query(_with(OBS_E, "pobs AS (SELECT *, CAST(frag_id % 3 AS INT) AS part FROM obs)", PILE, _TOPS, "g AS (SELECT DISTINCT contig, part FROM pile)") + "SELECT o.contig, o.frag_id, g.part, round(sum(CASE WHEN t.top IS NOT NULL AND round(coalesce(p.weight, 0), 9) = round(t.top, 9) THEN o.weight ELSE 0 END), 5) AS same, round(sum(CASE WHEN t.top IS NULL THEN 0.04 WHEN round(coalesce(p.weight, 0), 9) = round(t.top, 9) THEN 0 ELSE o.weight END), 5) AS diff FROM obs o JOIN g ON o.contig = g.contig LEFT JOIN ties t ON o.contig = t.contig AND g.part = t.part AND o.site = t.site LEFT JOIN pile p ON p.contig = t.contig AND p.part = t.part AND p.site = t.site AND p.allele = o.allele GROUP BY ALL")
def read_hap_distance_eps(s, d):
    obs = B.parts_by_remainder(_e(s, d))
    piled = P.pileup(obs, "contig", "part")
    out = D.read_haplotype_distance_eps(obs.drop("part"), piled, D.all_pairs(obs, piled, ["contig"], "part"), ["contig"], "part", 0.04)
    return out.withColumns({c: F.round(c, 5) for c in ("same", "diff")})


_RR = "SELECT a.contig, a.frag_id, b.frag_id AS other, CAST(sum(CASE WHEN a.allele = b.allele THEN round(a.weight * b.weight) ELSE 0 END) AS BIGINT) AS same, CAST(sum(CASE WHEN a.allele <> b.allele THEN round(a.weight * b.weight) ELSE 0 END) AS BIGINT) AS diff FROM obs a JOIN obs b ON a.contig = b.contig AND a.site = b.site AND a.frag_id < b.frag_id GROUP BY ALL"


@query(_E + _RR)
def read_read_distance(s, d):
    return D.read_read_distance(_e(s, d), ["contig"])


@query(_E + f"SELECT contig, frag_id, other, same + diff AS n FROM ({_RR}) WHERE same + diff > 0")
def pairwise_read_distance(s, d):
    return D.read_read_distance(_e(s, d), ["contig"], weighing=True).select("contig", "frag_id", "other", (F.col("same") + F.col("diff")).alias("n"))


@query(_E + "SELECT contig, site, string_agg(frag_id::VARCHAR, ',' ORDER BY frag_id) AS reads FROM obs GROUP BY contig, site")
def site_read_index(s, d):
    return _e(s, d).groupBy("contig", "site").agg(F.array_join(F.transform(F.array_sort(F.collect_set("frag_id")), lambda x: x.cast("string")), ",").alias("reads"))


@query(
    _E + ", lo AS (SELECT * FROM obs WHERE frag_id // 40000 % 2 = 0), sh AS (SELECT * FROM obs WHERE frag_id // 40000 % 2 = 1), v AS (SELECT l.contig, l.frag_id, s.frag_id AS short_id, sum(CASE WHEN l.allele = s.allele THEN round(l.weight * s.weight) ELSE 0 END) AS same, sum(CASE WHEN l.allele <> s.allele THEN round(l.weight * s.weight) ELSE 0 END) AS diff FROM lo l JOIN sh s ON l.contig = s.contig AND l.site = s.site GROUP BY ALL), "
    "o AS (SELECT lo.contig, lo.frag_id, lo.site, s.frag_id AS short_id, floor(same * 10 / (diff + 1)) AS score FROM lo JOIN sh s ON lo.contig = s.contig AND lo.site = s.site JOIN v ON v.contig = lo.contig AND v.frag_id = lo.frag_id AND v.short_id = s.frag_id), b AS (SELECT DISTINCT contig, frag_id, short_id FROM (SELECT *, row_number() OVER (PARTITION BY contig, frag_id, site ORDER BY score DESC, short_id) AS r FROM o) WHERE r = 1), "
    "f AS (SELECT b.contig, b.frag_id, s.site, min(allele) AS allele FROM b JOIN sh s ON s.contig = b.contig AND s.frag_id = b.short_id GROUP BY ALL HAVING min(allele) = max(allele)) SELECT contig, frag_id, site, coalesce(f.allele, lo.allele) AS allele FROM lo LEFT JOIN f USING (contig, frag_id, site)"
)
def hybrid_correct(s, d):
    """Users of four in eight as long reads, the others as short ones: both are on all contigs."""
    obs = _e(s, d)
    side = F.floor(F.col("frag_id") / 40000) % 2
    return D.hybrid_correct(obs.where(side == 0), obs.where(side == 1))


_MERGES = """cand AS (SELECT o.contig, o.part, o.other, greatest(a.r_site, b.r_site) - least(a.l_site, b.l_site) AS span FROM overs o JOIN dist d USING (contig, part, other) JOIN ranges a ON a.contig = o.contig AND a.part = o.part JOIN ranges b ON b.contig = o.contig AND b.part = o.other WHERE overlap > 0.95 AND diff / (same + diff) < 0.75),
 pairs AS (SELECT contig, part, other FROM cand QUALIFY row_number() OVER (PARTITION BY contig, part ORDER BY span DESC, other) = 1)"""


@query(_with(OBS_E, PART_W, RANGES, OVER, PILE, BEST, DIST, _MERGES) + "SELECT * FROM pairs")
def merge_candidates(s, d):
    return PT.merge_pairs(*_parts(_ep(s, d)), 0.75)


@query(
    _with(OBS_E, PART_W, RANGES, OVER, PILE, BEST, DIST, _MERGES, "both_ AS (SELECT contig, part, other FROM pairs UNION SELECT contig, other, part FROM pairs)").replace("WITH ", "WITH RECURSIVE ", 1)
    + ", reach AS (SELECT contig, part, part AS other FROM ranges UNION SELECT r.contig, r.part, b.other FROM reach r JOIN both_ b ON b.contig = r.contig AND b.part = r.other) SELECT contig, part, min(other) AS merged FROM reach GROUP BY ALL"
)
def merge_parts(s, d):
    ranges, piled = _parts(_ep(s, d))
    return PT.merged_parts(ranges, PT.merge_pairs(ranges, piled, 0.75))


_SEGMENTS = "w AS (SELECT DISTINCT contig, part, site FROM pobs), k AS (SELECT *, count(*) OVER (PARTITION BY contig, part ORDER BY site RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b, count(*) OVER (PARTITION BY contig, part ORDER BY site RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a FROM w), br AS (SELECT contig, part, site FROM k WHERE b > 0 AND a = 0), whole AS (SELECT contig, part, min(site) AS l_site, max(site) AS r_site FROM pobs GROUP BY ALL), seg AS (SELECT contig, part, coalesce(lag(site) OVER (PARTITION BY contig, part ORDER BY site), 0) + 1 AS lo, site AS hi FROM br), f AS (SELECT contig, part, frag_id, min(site) AS a, max(site) AS z FROM pobs GROUP BY ALL), cnt AS (SELECT seg.contig, seg.part, hi, count(*) AS n FROM f JOIN seg ON f.contig = seg.contig AND f.part = seg.part AND a <= hi AND z >= lo GROUP BY ALL)"


@query(
    _with(OBS_E, PART_W, _SEGMENTS, "sg AS (SELECT cnt.contig, cnt.part, l_site, r_site, CASE WHEN hi < r_site THEN hi END AS cut, n FROM cnt JOIN whole USING (contig, part))", "sh AS (SELECT *, n / (n + lead(n) OVER (PARTITION BY contig, part ORDER BY cut NULLS LAST)) AS share FROM sg)", "lf AS (SELECT * FROM sh WHERE cut IS NULL OR (cut > l_site AND share BETWEEN 0.05 AND 0.95))")
    + "SELECT contig, part, CAST(coalesce(lag(cut) OVER (PARTITION BY contig, part ORDER BY cut NULLS LAST), l_site) AS INT) AS l_site, CAST(coalesce(cut, r_site) AS INT) AS r_site FROM lf"
)
def merge_segments(s, d):
    """Segments between coverage breaks, joined where their depths are uneven."""
    obs = _ep(s, d)
    whole = obs.groupBy("contig", "part").agg(F.min("site").alias("l_site"), F.max("site").alias("r_site"))
    counts = split_by_breaks(s, d).groupBy("contig", "part", "seg_end").agg(F.count("*").alias("n_reads")).join(whole, ["contig", "part"])
    segments = counts.select("contig", "part", "l_site", "r_site", F.when(F.col("seg_end") < F.col("r_site"), F.col("seg_end")).alias("cut"), "n_reads")
    return W.merge_segments(segments, "contig", "part")


_CUTS = "bs AS (SELECT contig, part, site AS cut FROM br UNION ALL SELECT contig, part, NULL FROM whole), sg AS (SELECT *, lag(cut) OVER (PARTITION BY contig, part ORDER BY cut NULLS LAST) AS lo FROM bs), cn AS (SELECT sg.contig, sg.part, cut, count(*) AS n FROM sg JOIN f ON f.contig = sg.contig AND f.part = sg.part AND (lo IS NULL OR z >= lo) AND (cut IS NULL OR a <= cut) GROUP BY ALL), sh AS (SELECT *, n / (n + lead(n) OVER (PARTITION BY contig, part ORDER BY cut NULLS LAST)) AS share FROM cn JOIN whole USING (contig, part)), lf AS (SELECT * FROM sh WHERE cut IS NULL OR (cut > l_site AND share BETWEEN 0.05 AND 0.95)), rg AS (SELECT contig, part, coalesce(lag(cut) OVER (PARTITION BY contig, part ORDER BY cut NULLS LAST), l_site) AS l_site, coalesce(cut, r_site) AS r_site FROM lf), ix AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY part, l_site) - 1 AS block_id FROM rg)"


@query(
    _with(OBS_E, PART_W, _SEGMENTS, _CUTS)
    + "SELECT f.contig, CAST(block_id AS INT) AS block_id, CAST(frag_id % 2 AS INT) AS cluster, frag_id, CAST(l_site AS INT) AS l_site, CAST(r_site AS INT) AS r_site FROM f JOIN ix ON f.contig = ix.contig AND f.part = ix.part AND a <= r_site AND z >= l_site"
)
def cut_blocks(s, d):
    """Parts as blocks with two clusters each, cut at the breaks of their coverage."""
    obs = _ep(s, d).withColumnRenamed("part", "block_id")
    cuts = W.coverage_breaks(obs, 5, "contig", "block_id").groupBy("contig", "block_id").agg(F.sort_array(F.collect_list("site")).alias("cuts"))
    whole = obs.groupBy("contig", "block_id").agg(F.min("site").alias("l_site"), F.max("site").alias("r_site"))
    reads = obs.groupBy("contig", "block_id", "frag_id").agg(F.min("site").alias("first_site"), F.max("site").alias("last_site"))
    rows = reads.join(whole, ["contig", "block_id"]).join(cuts, ["contig", "block_id"], "left")
    return phasing.cut_blocks(kept(rows.withColumn("cluster", (F.col("frag_id") % 2).cast("int"))))


# set operations


@query(_with(OBS_E, PART_W) + "SELECT contig, part % 10000 AS week, count(DISTINCT frag_id) AS n FROM pobs GROUP BY ALL")
def union_path_reads(s, d):
    obs = _ep(s, d).select("contig", "frag_id", "part")
    parts = [obs.where(f"floor(part / 10000) = {k}") for k in range(3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("contig", (F.col("part") % 10000).alias("week"), "frag_id").distinct()
    return both.groupBy("contig", "week").agg(F.count("*").alias("n"))


@query(_L + "SELECT site FROM obs WHERE contig = 'F' AND allele = 0 INTERSECT SELECT site FROM obs WHERE contig = 'O' AND allele = 1")
def intersect_sites(s, d):
    obs = _l(s, d)
    return obs.where("contig = 'F' and allele = 0").select("site").intersect(obs.where("contig = 'O' and allele = 1").select("site"))


@query(_L + "SELECT frag_id FROM obs WHERE allele = 0 EXCEPT SELECT frag_id FROM obs WHERE allele = 2")
def except_reads(s, d):
    obs = _l(s, d)
    return obs.where("allele = 0").select("frag_id").exceptAll(obs.where("allele = 2").select("frag_id")).distinct().join(obs.where("allele = 2").select("frag_id"), "frag_id", "left_anti")


# scores and summaries


@query(_ALL + "SELECT contig, part, hapq, round(rel_err, 5) AS rel_err FROM hq")
def hapq(s, d):
    return PT.hapq(*_parts(_ep(s, d)), BLOCK).withColumn("rel_err", F.round("rel_err", 5))


@query(_ALL + "SELECT contig, part, round(rel_err, 5) AS rel_err FROM hq WHERE rel_err > 1")
def relative_error(s, d):
    return PT.hapq(*_parts(_ep(s, d)), BLOCK).where("rel_err > 1").select("contig", "part", F.round("rel_err", 5).alias("rel_err"))


@query(
    _ALL
    + """, j AS (SELECT *, r_site - l_site + 1 AS n, r_base - l_base AS bases FROM ranges JOIN stats USING (contig, part) JOIN hq USING (contig, part)), ns AS (SELECT contig, count(DISTINCT site) AS n_sites FROM obs GROUP BY ALL), tc AS (SELECT contig, count(DISTINCT s) AS touched FROM (SELECT contig, unnest(range(l_site, r_site + 1)) AS s FROM ranges) GROUP BY ALL)
 SELECT j.contig, round(sum(n) / any_value(n_sites), 5) AS average_straincount, round(sum(bases) / 50000, 5) AS whole_contig_multiplicity, round(sum(cov * n) / any_value(touched), 5) AS approximate_coverage_ignoring_indels, CAST(sum(bases) AS BIGINT) AS total_vartig_bases_covered,
 round(sum(CASE WHEN hapq >= 15 THEN n ELSE 0 END) / any_value(n_sites), 5) AS average_straincount_min15hapq, round(sum(CASE WHEN hapq >= 30 THEN n ELSE 0 END) / any_value(n_sites), 5) AS average_straincount_min30hapq, round(sum(CASE WHEN hapq >= 45 THEN n ELSE 0 END) / any_value(n_sites), 5) AS average_straincount_min45hapq, round(sum(errors) / sum(support), 5) AS avg_err FROM j JOIN ns USING (contig) JOIN tc USING (contig) GROUP BY j.contig"""
)
def contig_ploidy(s, d):
    obs = _ep(s, d)
    contigs = obs.groupBy("contig").agg(F.count_distinct("site").alias("n_sites"), F.lit(50000).alias("length"))
    ranges, piled = _parts(obs)
    out = PT.contig_ploidy(ranges, piled, PT.hapq(ranges, piled, BLOCK), contigs)
    return out.withColumns({c: F.round(c, 5) for c, t in out.dtypes if t == "double"})


_VARTIGS = _with(OBS_E, PART_W, PILE, BEST, _STRING, RANGES, STATS, OVER, DIST, HAPQ, "vt AS (SELECT contig, part, s.l_site, s.r_site, l_base + 1 AS l_base, r_base + 1 AS r_base, round(cov, 3) AS cov, round(err, 4) AS err, hapq, round(rel_err, 3) AS rel_err, alleles FROM strings s JOIN ranges USING (contig, part) JOIN stats USING (contig, part) JOIN hq USING (contig, part))")
_HEAD = "'>HAP' || part || '.out' || chr(9) || 'CONTIG:' || contig || chr(9) || 'SNPRANGE:' || l_site || '-' || r_site || chr(9) || 'BASERANGE:' || l_base || '-' || r_base || chr(9) || 'COV:' || printf('%.3f', cov) || chr(9) || 'ERR:' || printf('%.4f', err) || chr(9) || 'HAPQ:' || hapq || chr(9) || 'REL_ERR:' || coalesce(printf('%.3f', rel_err), 'nan')"


@query(_VARTIGS + "SELECT contig, part, l_base, r_base, cov, CAST(CASE WHEN hapq >= 1 THEN 4 ELSE 0 END AS INT) AS width, round((length(alleles) - length(replace(replace(alleles, '1', ''), '2', ''))) / nullif(length(alleles) - length(replace(replace(replace(alleles, '0', ''), '1', ''), '2', '')), 0), 6) AS ratio FROM vt WHERE r_base - l_base >= 1000 AND cov >= 1.2 AND length(alleles) > length(replace(replace(replace(alleles, '0', ''), '1', ''), '2', ''))")
def vartig_alt_ratio(s, d):
    """Segments for a plot; the test tables have less depth than the usual 1.5."""
    return K.alt_ratio(_vartigs(_ep(s, d)), least_cov=1.2)


@query(_VARTIGS + f"SELECT contig, part, CAST(unnest([0, 1]) AS INT) AS k, unnest([{_HEAD}, alleles]) AS value FROM vt")
def vartig_lines(s, d):
    return K.vartig_lines(_vartigs(_ep(s, d))).select("contig", "rn.part", "rn.k", "value")


@query(_VARTIGS + f", fr AS (SELECT DISTINCT contig, part, frag_id, min(site) OVER w AS a, max(site) OVER w AS z FROM pobs WINDOW w AS (PARTITION BY contig, frag_id)) SELECT contig, part, CAST(0 AS BIGINT) AS frag_id, {_HEAD} AS value FROM vt UNION ALL SELECT contig, part, frag_id, 'r' || frag_id || chr(9) || a || chr(9) || z FROM fr")
def haploset_lines(s, d):
    obs = _ep(s, d)
    reads = B.frags_of(obs).join(obs.select("contig", "frag_id", "part").distinct(), ["contig", "frag_id"]).withColumn("name", F.concat(F.lit("r"), "frag_id"))
    return K.haploset_lines(_vartigs(obs), reads).select("contig", "rn.part", "rn.frag_id", "value")


@query(_with("t AS (SELECT CAST(s_suppkey % 7 AS INT) AS part, s_suppkey AS frag_id FROM supplier)") + "SELECT frag_id, string_agg(v, chr(10) ORDER BY k) AS record FROM (SELECT frag_id, unnest([1, 2, 3, 4]) AS k, unnest(['@r' || frag_id, CASE WHEN frag_id % 5 = 0 THEN 'N' ELSE repeat('AC', CAST(part AS INT) + 1) END, '+', CASE WHEN frag_id % 5 = 0 THEN '!' ELSE repeat('II', CAST(part AS INT) + 1) END]) AS v FROM t) GROUP BY frag_id")
def fastq_records(s, d):
    k, n = F.col("s_suppkey"), (F.col("s_suppkey") % 7 + 1).cast("int")
    bases = lambda x: F.when(k % 5 == 0, F.lit("")).otherwise(F.repeat(F.lit(x), n))
    reads = B.read(s, d, "supplier").select(F.lit("c").alias("contig"), (n - 1).alias("part"), k.alias("frag_id"), F.concat(F.lit("r"), k).alias("name"), bases("AC").alias("seq"), bases("II").alias("qual"))
    return K.fastq_lines(reads).select("rn.frag_id", F.col("value").alias("record"))


@query("""WITH t AS (SELECT s_suppkey AS k, upper(s_name) AS a, reverse(upper(s_name)) AS b FROM supplier), m AS (SELECT k, CASE WHEN k % 5 = 0 THEN '' ELSE a END AS a, CASE WHEN k % 7 = 0 THEN '' ELSE b END AS b FROM t)
 SELECT k AS frag_id, CAST(mate AS INT) AS mate, '@r' || k || '/' || mate || chr(10) || CASE WHEN s = '' THEN 'N' WHEN mate = 2 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END || chr(10) || '+' || chr(10) || CASE WHEN s = '' THEN '!' ELSE s END AS record FROM (SELECT k, unnest([1, 2]) AS mate, unnest([a, b]) AS s FROM m WHERE a <> '' OR b <> '')""")
def paired_fastq_records(s, d):
    """Names of suppliers as mates; the first is absent for every fifth, the second for every seventh."""
    k = F.col("s_suppkey")
    mates = F.array(F.when(k % 5 == 0, "").otherwise(F.upper("s_name")), F.when(k % 7 == 0, "").otherwise(F.reverse(F.upper("s_name"))))
    reads = B.read(s, d, "supplier").select(F.lit("c").alias("contig"), F.lit(0).alias("part"), k.alias("frag_id"), F.concat(F.lit("r"), k).alias("name"), mates.alias("seqs"), mates.alias("quals"))
    return K.paired_fastq_lines(reads).select("rn.frag_id", "mate", F.col("value").alias("record"))


@query(_with(_VCF_SQL) + "SELECT '##contig=<ID=' || contig || '>' AS value, true AS early FROM (SELECT DISTINCT contig FROM v) UNION ALL SELECT '##fileformat=VCFv4.2', true UNION ALL SELECT '#CHROM' || chr(9) || 'POS', true")
def contig_headers(s, d):
    """The lines that come before the third line of a VCF after its contigs have been named there."""
    rows = S.with_contig_headers(_vcf(s, d))
    third = _vcf(s, d).select("line_no").orderBy("line_no").limit(3).agg(F.max("line_no").alias("third"))
    return rows.crossJoin(third).where("rn < third").select("value", F.lit(True).alias("early"))


@query("SELECT 'c' || p_partkey || 'x' || p_size AS name, CAST(row_number() OVER (ORDER BY p_partkey, p_size) AS INT) AS place FROM part")
def natural_order(s, d):
    names = B.read(s, d, "part").select(F.concat(F.lit("c"), "p_partkey", F.lit("x"), "p_size").alias("name"))
    return R.ranked(names, [], [S.natural_order("name")]).select("name", (F.col("rank") + 1).alias("place"))


@query(_with(OBS_E, PART_W, PILE, BEST) + "SELECT contig, site, max(allele) FILTER (part // 10000 = 0) AS c0, max(allele) FILTER (part // 10000 = 1) AS c1, max(allele) FILTER (part // 10000 = 2) AS c2 FROM best GROUP BY ALL")
def phasing_pivot(s, d):
    best = P.consensus(P.pileup(_ep(s, d), "contig", "part"), "contig", "part")
    return best.withColumn("c", F.concat(F.lit("c"), F.floor(F.col("part") / 10000))).groupBy("contig", "site").pivot("c", ["c0", "c1", "c2"]).agg(F.max("allele"))


@query(_with(OBS_L, "pobs AS (SELECT *, 0 AS part FROM obs)", PILE, BEST) + "SELECT contig, string_agg(substr('ACGT', allele + 1, 1), '' ORDER BY site) AS seq FROM best GROUP BY contig")
def swap_alleles(s, d):
    from phaseframe.operators.sequences import swap_alleles as swap

    obs = _l(s, d)
    best = P.consensus(P.pileup(obs, "contig"), "contig").select("contig", "site", F.substring(F.lit("ACGT"), F.col("allele") + 1, F.lit(1)).alias("base"))
    reference = B.sites_of(obs).groupBy("contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list("site")), lambda x: F.lit("N")), "").alias("seq"))
    ordinal = B.sites_of(obs).withColumn("at", F.row_number().over(Window.partitionBy("contig").orderBy("site")) - 1)
    return swap(reference, best.join(ordinal, ["contig", "site"]).select("contig", "at", "base"))


@query("SELECT 'c' || (p_size % 3) AS contig, string_agg(CASE WHEN p_partkey % 4 = 0 THEN 'NNN' || substr(p_brand, 4) ELSE p_brand END, '' ORDER BY p_partkey) AS seq FROM part GROUP BY ALL")
def swap_in_chunks(s, d):
    """Names of brands as the lines of three contigs, in chunks of 50 letters; the first three letters of every fourth part
    are replaced."""
    p = B.read(s, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("c"), "p_brand")
    lines = p.select((F.col("c") * 100_000_000 + F.col("p_partkey") + 1).alias("line_no"), F.col("p_brand").alias("value"))
    heads = p.select((F.col("c") * 100_000_000).alias("line_no"), F.concat(F.lit(">c"), F.col("c"), F.lit(" x")).alias("value")).distinct()
    before = Window.partitionBy("c").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1)
    starts = p.withColumn("start", F.coalesce(F.sum(F.length("p_brand")).over(before), F.lit(0))).where("p_partkey % 4 = 0")
    alleles = starts.select(F.concat(F.lit("c"), "c").alias("contig"), F.explode(F.sequence("start", F.col("start") + 2)).alias("at"), F.lit(None).cast("string").alias("base"))
    return SQ.joined(SQ.swap_in_chunks(S.fasta_chunks(lines.union(heads), 50), alleles, 50))


_TRIMS = """len AS (SELECT contig, frag_id, max(pos) - min(pos) + 41 AS length, min(pos) AS start FROM obs GROUP BY ALL), w AS (SELECT contig, part, l_site + 2 AS l_site, r_site - 2 AS r_site FROM ranges), so AS (SELECT p.contig, p.part, p.frag_id, p.site, p.pos - start + 20 AS q, length, l_site, r_site FROM pobs p JOIN len USING (contig, frag_id) JOIN w ON w.contig = p.contig AND w.part = p.part),
 e AS (SELECT contig, part, frag_id, min(site) AS f, max(site) AS z, any_value(l_site) AS l, any_value(r_site) AS r, any_value(length) AS length, arg_min(q, site) FILTER (site >= l_site) AS a, arg_max(q, site) FILTER (site <= r_site) AS b FROM so GROUP BY ALL),
 tr AS (SELECT contig, part, frag_id, CAST(CASE WHEN f > l THEN 0 ELSE greatest(0, a - 25) END AS BIGINT) AS "left", CAST(CASE WHEN z < r THEN length - 1 ELSE least(length - 1, b + 25) END AS BIGINT) AS "right" FROM e WHERE f <= r AND z >= l)"""


def _trimmed(s, d) -> DataFrame:
    from phaseframe.operators.sequences import trim_offsets as trim

    obs = _ep(s, d)
    lengths = B.frags_of(obs).select("contig", "frag_id", (F.col("last_base") - F.col("first_base") + 41).alias("length"), F.col("first_base").alias("start"))
    placed = obs.join(lengths.drop("length"), ["contig", "frag_id"]).withColumn("seq_pos", F.col("pos") - F.col("start") + 20)
    ranges = PT.part_ranges(obs).select("contig", "part", (F.col("l_site") + 2).alias("l_site"), (F.col("r_site") - 2).alias("r_site"))
    return trim(placed, ranges, lengths.drop("start"))


@query(_with(OBS_E, PART_W, RANGES, _TRIMS) + 'SELECT * FROM tr WHERE "left" <= "right"')
def trim_offsets(s, d):
    """Reads are taken to have their sites 20 bases and more from their ends, as far apart as on the contig."""
    return _trimmed(s, d)


@query(_with(OBS_E, PART_W, RANGES, _TRIMS) + """SELECT contig, part, frag_id, substr(repeat('ACGT', 3000), CAST("left" + 1 AS INT), CAST("right" - "left" + 1 AS INT)) AS seq FROM tr WHERE "left" <= "right\"""")
def trimmed_reads(s, d):
    from phaseframe.operators.sequences import trimmed

    return trimmed(_trimmed(s, d).withColumn("seq", F.repeat(F.lit("ACGT"), F.lit(3000)))).select("contig", "part", "frag_id", "seq")


# kernels: no SQL; tests hold them against brute force


def _small(s, d) -> DataFrame:
    """Two alleles of events, which phasing expects."""
    return _e(s, d).withColumn("allele", (F.col("allele") % 2).cast("int"))


def _graph(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, membership and flows, each computed once."""
    obs = kept(_e(s, d))
    membership = kept(_membership(s, d, obs))
    return obs, membership, kept(phasing.flow_edges(PT.block_edges(membership, obs)))


@query()
def phase_blocks(s, d):
    return phasing.phase_blocks(_small(s, d), 2880, 0.04)


@query()
def search_breaks(s, d):
    """Sites at which the search of a block lost two or more clusters."""
    found = phasing.searched_blocks(_small(s, d), 2880, 0.04).select("contig", "block_id", "cuts").distinct()
    return found.select("contig", "block_id", F.explode("cuts").alias("site"))


@query()
def block_ploidy(s, d):
    return phase_blocks(s, d).groupBy("contig", "block_id").agg((F.max("cluster") + 1).alias("ploidy"))


@query()
def flow_edges(s, d):
    return _graph(s, d)[2]


@query()
def disjoint_paths(s, d):
    return phasing.disjoint_paths(*_graph(s, d)[1:])


#: Paths that need no kernel: of each column's clusters the ones with one number; flows are the edges' weights.
_BY_CLUSTER = "ed AS (SELECT a.contig, a.col, a.cluster AS row_from, b.cluster AS row_to, count(*) AS weight FROM m a JOIN m b ON a.contig = b.contig AND b.col = a.col + 1 AND a.frag_id = b.frag_id WHERE NOT EXISTS (SELECT 1 FROM tied t WHERE t.contig = a.contig AND t.col = a.col AND t.frag_id = a.frag_id) GROUP BY ALL HAVING count(*) >= 2), nodes AS (SELECT DISTINCT contig, col, cluster, l_site, r_site FROM m)"


def _paths_by_cluster(s, d, obs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    membership = kept(_membership(s, d, obs))
    return membership, PT.numbered(membership).select("contig", F.col("cluster").alias("path"), "col", "cluster").distinct()


@query(_blocks_sql(PART_R, _EDGES, _BY_CLUSTER) + "SELECT n.contig, n.cluster AS path, round(avg(e.weight), 6) AS flow FROM nodes n LEFT JOIN ed e ON e.contig = n.contig AND e.col = n.col AND e.row_from = n.cluster GROUP BY ALL")
def path_flow_by_cluster(s, d):
    obs = kept(_e(s, d))
    membership, paths = _paths_by_cluster(s, d, obs)
    flows = PT.block_edges(membership, obs).withColumn("flow", F.col("weight").cast("double"))
    return _r(phasing.path_flow(paths, flows), "flow")


@query(_blocks_sql(PART_R, _EDGES, _BY_CLUSTER) + "SELECT contig, cluster AS path, min(l_site) AS l_site, max(r_site) AS r_site FROM nodes WHERE (contig + col) % 3 > 0 GROUP BY ALL")
def path_ranges(s, d):
    """Two in three columns of each contig."""
    membership, paths = _paths_by_cluster(s, d)
    return phasing.path_ranges(membership, paths.where("(contig + col) % 3 > 0"))


_WITHIN = """rg AS (SELECT contig, part, CAST(l_site + part % 5 * 7 AS INT) AS l_site, CAST(greatest(l_site + part % 5 * 7, r_site - part % 4 * 7) AS INT) AS r_site FROM ranges), fr AS (SELECT contig, part, frag_id, min(site) AS a, max(site) AS z FROM pobs GROUP BY ALL),
 o AS (SELECT fr.*, l_site, r_site, max(z) OVER (PARTITION BY contig, part ORDER BY a, z DESC, frag_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fr JOIN rg USING (contig, part)), c AS (SELECT *, CASE WHEN a > reach AND reach >= l_site AND reach < r_site THEN reach END AS cut FROM o),
 pc AS (SELECT *, count(cut) OVER (PARTITION BY contig, part ORDER BY a, z DESC, frag_id) AS piece FROM c), pr AS (SELECT contig, part, piece, max(cut) AS cut, any_value(l_site) AS l, any_value(r_site) AS r FROM pc GROUP BY ALL)"""


@query(_with(OBS_E, PART_W, RANGES, _WITHIN) + "SELECT pc.contig, pc.part, frag_id, pc.piece, CAST(coalesce(w.cut + 1, w.l) AS INT) AS l_site, CAST(coalesce(w.nxt, w.r) AS INT) AS r_site FROM pc JOIN (SELECT *, lead(cut) OVER (PARTITION BY contig, part ORDER BY piece) AS nxt FROM pr) w ON w.contig = pc.contig AND w.part = pc.part AND w.piece = pc.piece")
def split_gaps_within(s, d):
    """Breaks count only inside the ranges of parts, here narrower than what the reads of a part cover."""
    obs = _ep(s, d)
    low = F.col("l_site") + F.col("part") % 5 * 7
    ranges = PT.part_ranges(obs).select("contig", "part", low.cast("int").alias("l_site"), F.greatest(low, F.col("r_site") - F.col("part") % 4 * 7).cast("int").alias("r_site"))
    frags = B.frags_of(obs).join(obs.select("contig", "frag_id", "part").distinct(), ["contig", "frag_id"]).join(ranges, ["contig", "part"])
    reads, pieces = W.split_gaps_within(frags, "contig", "part")
    return reads.join(pieces, ["contig", "part", "piece"]).select("contig", "part", "frag_id", "piece", "l_site", "r_site")


@query()
def path_flow(s, d):
    _, membership, flows = _graph(s, d)
    return phasing.path_flow(phasing.disjoint_paths(membership, flows), flows)


@query()
def assign_reads(s, d):
    obs, membership, flows = _graph(s, d)
    paths = phasing.disjoint_paths(membership, flows)
    return phasing.assign_reads(obs, phasing.path_members(membership, paths), 0.04)


@query()
def bin_parts(s, d):
    ranges, piled = _parts(_ep(s, d))
    return phasing.bin_parts(ranges, P.error_coverage(piled, "contig", "part"), 2880)


@query(
    _with(OBS_E, "sh AS (SELECT * FROM obs WHERE frag_id // 40000 % 5 = 0)", "pobs AS (SELECT *, CAST((frag_id // 10000) % 3 * 10000 + frag_id % 10000 AS INT) AS part FROM obs WHERE frag_id // 40000 % 5 <> 0)", PILE, RANGES)
    + """, f AS (SELECT contig, frag_id, min(site) AS a, max(site) AS z FROM sh GROUP BY ALL), ends AS (SELECT f.contig, f.frag_id, part FROM f JOIN ranges r ON r.contig = f.contig AND (a BETWEEN l_site AND r_site OR z BETWEEN l_site AND r_site)), t AS (SELECT contig, part, site, max(weight) AS top FROM pile GROUP BY ALL),
 sc AS (SELECT e.contig, e.frag_id, e.part, round(sum(CASE WHEN t.top IS NOT NULL AND round(coalesce(p.weight, 0), 9) = round(t.top, 9) THEN o.weight ELSE 0 END), 6) AS same, round(sum(CASE WHEN t.top IS NULL THEN 0.04 WHEN round(coalesce(p.weight, 0), 9) = round(t.top, 9) THEN 0 ELSE o.weight END), 6) AS diff FROM ends e JOIN sh o ON o.contig = e.contig AND o.frag_id = e.frag_id LEFT JOIN t ON t.contig = e.contig AND t.part = e.part AND t.site = o.site LEFT JOIN pile p ON p.contig = e.contig AND p.part = e.part AND p.site = o.site AND p.allele = o.allele GROUP BY ALL),
 q AS (SELECT *, floor(round(diff * 10 + 1, 4)) AS d, floor(round(same * 10 + 1, 4)) AS s FROM sc), best AS (SELECT contig, frag_id, d, s FROM q QUALIFY row_number() OVER (PARTITION BY contig, frag_id ORDER BY d / s, d, s) = 1) SELECT DISTINCT q.contig, q.frag_id, q.part FROM q JOIN best USING (contig, frag_id, d, s)"""
)
def reassign_short(s, d):
    """A fifth of the users as short reads; the others' parts are by week."""
    obs = _ep(s, d)
    short = F.floor(F.col("frag_id") / 40000) % 5 == 0
    return phasing.reassign_short(obs.where(short).drop("part"), obs.where(~short), 0.04)


@query()
def realign_alleles(s, d):
    """Reads from parts: 48 bases by key, an edit by key, the site at place 20 of both."""
    k = F.col("p_partkey")
    letters = lambda n, f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)
    bases = F.array_join(letters(48, lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.hash(i, k), F.lit(4)) + 1).cast("int"), F.lit(1))), "")
    rows = B.read(s, d, "part").select(k.alias("id"), F.concat(F.lit("c"), k).alias("contig"), bases.alias("ref"))
    calls = rows.select("id", "contig", F.lit(20).cast("long").alias("pos"), F.lit(20).cast("long").alias("seq_pos"), F.expr("CASE id % 3 WHEN 0 THEN concat(substr(ref, 1, 12), substr(ref, 14)) WHEN 1 THEN concat(substr(ref, 1, 30), 'A', substr(ref, 31)) ELSE ref END").alias("seq"), F.array(F.lit("A"), F.lit("C"), F.lit("G"), F.lit("T")).alias("alleles"), F.lit(0).alias("allele"))
    return phasing.realign(calls, SQ.chunked(rows.select("contig", F.col("ref").alias("seq")))).select("id", "allele")


@query()
def phase(s, d):
    return _vartigs(phasing.phase(_small(s, d), 2880, 0.04))
