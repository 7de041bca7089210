"""From alignments, variants and a reference to reports, and back; BAM and SAM give the same."""

import gzip
import random
import struct

import pytest

from phaseframe import cli
from phaseframe.sources import bam, files, sinks

CONTIGS = [("c1", 6000), ("c2", 4000)]


def bam_bytes(rows):
    """A BAM file of (contig, qname, flags, mapq, pos, cigar [(n, op)], seq, qual), in small gzip members."""
    out = [bam.MAGIC, struct.pack("<i", 4), b"@HD\n", struct.pack("<i", len(CONTIGS))]
    for name, length in CONTIGS:
        out += [struct.pack("<i", len(name) + 1), name.encode() + b"\0", struct.pack("<i", length)]
    for contig, name, flags, mapq, pos, cigar, seq, qual in rows:
        codes = [bam.BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", [c for c, _ in CONTIGS].index(contig), pos, len(name) + 1, mapq, 0, len(cigar), flags, len(seq), -1, -1, 0)
        body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(o)) for n, o in cigar)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(qual)
        out.append(struct.pack("<i", len(body)) + body)
    raw = b"".join(out)
    return b"".join(gzip.compress(raw[k : k + 3000]) for k in range(0, len(raw), 3000)) + gzip.compress(b"")


def world(seed=1):
    """Two strains on two contigs: reference, sites and reads."""
    rng = random.Random(seed)
    reference = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in CONTIGS}
    sites, rows = [], []
    for contig, length in CONTIGS:
        at = sorted(rng.sample(range(50, length - 50), 120))
        other = {p: rng.choice([b for b in "ACGT" if b != reference[contig][p]]) for p in at}
        sites += [(contig, p + 1, reference[contig][p], other[p]) for p in at]
        strains = [{p for p in at if rng.random() < 0.5} for _ in range(2)]
        for k in range(140):
            start = rng.randrange(length - 700)
            bases = [other[p] if p in strains[k % 2] else reference[contig][p] for p in ()]
            bases = [other[p] if p in strains[k % 2] and p in other else reference[contig][p] for p in range(start, start + 700)]
            for _ in range(3):
                bases[rng.randrange(700)] = rng.choice("ACGT")
            read = "".join(bases)
            cigar = [(700, "M")] if k % 3 else [(300, "M"), (5, "D"), (395, "M")]
            read = read if k % 3 else read[:300] + read[305:]
            rows.append((contig, f"{contig}s{k % 2}_{k}", 0, 60, start, cigar, read, [rng.randint(20, 40) for _ in read]))
    rows.append(("c1", "bad", 1024, 60, 10, [(10, "M")], "ACGTACGTAC", [30] * 10))
    return reference, sites, rows


def sam_lines(rows):
    head = [f"@SQ\tSN:{c}\tLN:{n}" for c, n in CONTIGS]
    return head + ["\t".join([q, str(f), c, str(p + 1), str(m), "".join(f"{n}{o}" for n, o in cigar), "*", "0", "0", s, "".join(chr(x + 33) for x in qual)]) for c, q, f, m, p, cigar, s, qual in rows]


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("inputs")
    reference, sites, rows = world()
    (folder / "reads.bam").write_bytes(bam_bytes(rows))
    (folder / "reads.sam").write_text("\n".join(sam_lines(rows)) + "\n")
    (folder / "ref.fa").write_text("".join(f">{c} x\n" + "".join(s[k : k + 80] + "\n" for k in range(0, len(s), 80)) for c, s in reference.items()))
    (folder / "sites.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\n" + "".join(f"{c}\t{p}\t.\t{a}\t{b}\t9\tdn\n" for c, p, a, b in sites))
    return folder, reference, sites, rows


def test_bam_and_sam_are_the_same(spark, inputs):
    folder, _, _, rows = inputs
    a = sorted(map(tuple, bam.read_bam(spark, str(folder / "reads.bam")).collect()))
    assert a == sorted(map(tuple, files.parse_sam(files.lines(spark, str(folder / "reads.sam"))).select("contig", "qname", "flags", "mapq", "pos", "cigar", "seq", "qual").collect()))
    assert len(a) == len(rows)
    assert [tuple(r) for r in bam.bam_contigs(spark, str(folder / "reads.bam")).orderBy("ordinal").collect()] == [(c, n, k) for k, (c, n) in enumerate(CONTIGS)]
    whole = (folder / "reads.bam").read_bytes()
    broken = folder / "broken"
    broken.mkdir()
    (broken / "cut.bam").write_bytes(whole[: len(whole) // 2])
    (broken / "none.bam").write_bytes(b"not a file of this kind")
    assert 0 < bam.read_bam(spark, str(broken / "*.bam")).count() < len(rows)


def test_command_line(spark, inputs, tmp_path):
    folder, reference, sites, rows = inputs
    out = str(tmp_path / "out")
    cli.main(["phase", "-b", str(folder / "reads.bam"), "-v", str(folder / "sites.vcf"), "-r", str(folder / "ref.fa"), "-o", out, "-e", "0.04", "-l", "1500", "--output-reads"])
    found = files.parse_haplosets(spark.read.text(f"{out}/haplosets/contig=c1").selectExpr("value", "monotonically_increasing_id() as line_no")).collect()
    by_part = {}
    for r in found:
        by_part.setdefault(r["part"], []).append(r["read"])
    reads = [n for own in by_part.values() for n in own]
    assert sorted(reads) == sorted(q for c, q, *_ in rows if c == "c1" and q != "bad")
    pure = sum(max(sum("s0_" in n for n in own), sum("s1_" in n for n in own)) for own in by_part.values())
    assert pure > 0.95 * len(reads) and all(r["cov"] > 0 for r in found)
    lines = [r["value"] for r in spark.read.text(f"{out}/vartigs/contig=c2").collect()]
    assert len([x for x in lines if x.startswith(">HAP")]) * 2 == len(lines)
    ploidy = [r["value"].split("\t") for r in spark.read.text(f"{out}/contig_ploidy").collect()]
    assert sorted(r[0] for r in ploidy) == ["c1", "c2", "contig"] and {len(r) for r in ploidy} == {len(sinks.PLOIDY_COLUMNS)}
    fastq = [r["value"] for r in spark.read.text(f"{out}/long_reads/contig=c1").collect()]
    assert len(fastq) % 4 == 0 and len(fastq) > 0
    info = [r["value"] for r in spark.read.text(f"{out}/vartig_info/contig=c1").collect()]
    assert any(x.split("\t")[0].split(":")[1] == str(sites[0][1] - 1) for x in info if not x.startswith(">"))
    with pytest.raises(Exception, match="(?i)exists"):
        cli.main(["vartig", "-b", str(folder / "reads.sam"), "-v", str(folder / "sites.vcf"), "-o", str(folder)]) or cli.main(["vartig", "-b", str(folder / "reads.sam"), "-v", str(folder / "sites.vcf"), "-o", str(folder)])


def test_defaults_come_from_genome_columns(spark, inputs, tmp_path):
    """Without -e and -l: strains differ at every site, which must not pass for errors."""
    from phaseframe.operators.columns import estimate_from_alignments

    folder, _, _, rows = inputs
    records = bam.read_bam(spark, str(folder / "reads.bam"))
    found = estimate_from_alignments(records, every=10).first()
    assert found["epsilon"] < 0.06 and found["block_length"] in (695, 700)
    assert tuple(estimate_from_alignments(records.where("contig = 'none'")).first()) == (0.01, 500)
    out = str(tmp_path / "out")
    cli.main(["phase", "-b", str(folder / "reads.bam"), "-v", str(folder / "sites.vcf"), "-r", str(folder / "ref.fa"), "-o", out])
    for contig in ("c1", "c2"):
        sets = files.parse_haplosets(spark.read.text(f"{out}/haplosets/contig={contig}").selectExpr("value", "monotonically_increasing_id() as line_no")).collect()
        by_part = {}
        for r in sets:
            by_part.setdefault(r["part"], []).append(r["read"])
        n = sum(map(len, by_part.values()))
        assert n == sum(c == contig and q != "bad" for c, q, *_ in rows)
        assert sum(max(sum("s0_" in x for x in own), sum("s1_" in x for x in own)) for own in by_part.values()) > 0.95 * n and len(by_part) > 1


def planted_columns(rng, reads, length, wrong):
    """Reads of one contig of 300 bases, of which every fifth is a site of two strains, as alignments."""
    rows = []
    for k in range(reads):
        start = rng.randrange(300 - length)
        bases = ["ACGT"[(p + (k % 2 if p % 5 == 0 else 0)) % 4] for p in range(start, start + length)]
        for p in range(length):
            if rng.random() < wrong:
                bases[p] = rng.choice("ACGT".replace(bases[p], ""))
        rows.append(("c", f"r{k}", 0, 1, start, f"{length}M", "".join(bases)))
    return rows


def test_columns_by_brute_force(spark, monkeypatch):
    """Covered bases counted over cells, gaps, clips and deletions; 66 % of columns, not of sites."""
    from phaseframe.operators import columns

    rng = random.Random(7)
    rows = planted_columns(rng, 200, 60, 0.05)
    rows += [("c", "d1", 0, 0, 5000, "4H3S10M5D20M2I5M", "A" * 40), ("c", "d2", 1024, 60, 5200, "40M", "A" * 40), ("c", "d3", 256, 60, 5300, "40M", "A" * 40), ("c", "d4", 0, 60, 5400, "*", "A" * 40), ("c", "d5", 0, 60, 5500, "40M", "*"), ("d", "e", 0, 60, 77, "10M1000N10M", "C" * 20)]
    frame = spark.createDataFrame(rows, "contig string, qname string, flags int, mapq int, pos long, cigar string, seq string")
    reach = {"c": {}, "d": {}}
    for contig, name, flags, _, pos, cigar, seq in rows:
        if flags & 1796 or cigar == "*" or seq == "*":
            continue
        at, read = pos, 0
        for n, op in __import__("re").findall("([0-9]+)([MIDNSH])", cigar):
            for _ in range(int(n)):
                if op in "MDN":
                    reach[contig].setdefault(at, []).append((seq[read] if op == "M" else None, len(seq)))
                at, read = at + (op in "MDN"), read + (op in "MIS")
    for cell in (64, 1 << 16):
        monkeypatch.setattr(columns, "CELL", cell)
        spans = columns.primary_spans(frame)
        for every in (1, 7):
            chosen = {(c, p) for c in reach for p in sorted(reach[c])[::every]}
            picked = columns.sampled_columns(spans, every)
            assert sorted((r["contig"], r["ref_pos"]) for r in picked.collect()) == sorted(chosen)
            met = sorted((r["contig"], r["ref_pos"], r["base"], r["length"]) for r in columns.column_bases(spans, picked, cell).collect())
            assert met == sorted((c, p, b, n) for c, p in chosen for b, n in reach[c][p] if b)
    found = columns.estimate_from_alignments(frame, every=1, least_length=1).first()
    ratios = []
    for own in reach["c"].values():
        counts = [sum(b == x for b, _ in own) for x in "ACGT"]
        if sum(counts) >= 5:
            ratios.append((sum(counts) - max(counts)) / max(counts))
    lengths = sorted(n for c in reach.values() for own in c.values() for b, n in own if b)
    assert found["epsilon"] == pytest.approx(sorted(ratios)[len(ratios) * 66 // 100]) and found["epsilon"] < 0.15 < max(ratios)
    assert found["block_length"] == lengths[len(lengths) * 66 // 100]


def test_pairs_come_out_as_pairs(spark, tmp_path):
    """Both mates in two files of the same order; the second one reverse complemented, an absent one N; lengths of both."""
    rng = random.Random(3)
    reference = "".join(rng.choice("ACGT") for _ in range(4000))
    at = list(range(60, 3950, 30))
    other = {p: "ACGT"[("ACGT".index(reference[p]) + 1) % 4] for p in at}
    strains = [{p for p in at if rng.random() < 0.5} for _ in range(2)]
    rows, truth = [], {}
    for k in range(240):
        start = rng.randrange(3400)
        text = lambda a, n: "".join(other[p] if p in other and p in strains[k % 2] else reference[p] for p in range(a, a + n))
        mates = [(99, start, text(start, 150)), (147, start + 250, text(start + 250, 150))]
        if k % 11 == 0:
            mates = mates[k % 2 :][:1]  # one mate only
        for flags, pos, seq in mates:
            rows.append(("c1", f"p{k}", flags, 60, pos, [(150, "M")], seq, [30] * 150))
        truth[f"p{k}"] = {1 + (f == 147): s for f, _, s in mates}
    rows += [("c1", "far", 99, 60, 5000, [(40, "M")], "A" * 40, [30] * 40), ("c1", "far", 147, 60, 5100, [(30, "M")], "C" * 30, [30] * 30)]
    (tmp_path / "reads.sam").write_text("\n".join(sam_lines(rows)) + "\n")
    (tmp_path / "sites.vcf").write_text("##fileformat=VCFv4.2\n" + "".join(f"c1\t{p + 1}\t.\t{reference[p]}\t{other[p]}\t9\tdn\n" for p in at))
    out = str(tmp_path / "out")
    cli.main(["phase", "-b", str(tmp_path / "reads.sam"), "-v", str(tmp_path / "sites.vcf"), "-o", out, "-e", "0.02", "-l", "600", "--output-reads"])
    import glob

    back = str.maketrans("ACGT", "TGCA")
    seen = set()
    for folder in glob.glob(f"{out}/short_reads/contig=c1/part=*"):
        mates = []
        for mate in (1, 2):
            parts = sorted(glob.glob(f"{folder}/mate={mate}/part-*.txt"))
            mates.append([line for p in parts for line in open(p).read().splitlines()])
        assert len(mates[0]) == len(mates[1]) and len(mates[0]) % 4 == 0 and mates[0]
        for a, b, s, t in zip(mates[0][::4], mates[1][::4], mates[0][1::4], mates[1][1::4], strict=True):
            name = a[1:-2]
            assert (a, b) == (f"@{name}/1", f"@{name}/2")
            own = truth[name]
            if len(own) == 2:
                assert (s, t) == (own[1], own[2][::-1].translate(back))
            else:  # a lone mate takes the first place, whichever it is
                assert (s, t) == (next(iter(own.values())), "N")
            seen.add(name)
    assert seen == set(truth)
    without = [r["value"] for r in spark.read.text(f"{out}/reads_without_sites").collect()]
    assert sorted(without) == ["READ_NAME\tREAD_LENGTH_IN_BASES", "far\t70"]
    import os

    assert not os.path.exists(f"{out}/long_reads/contig=c1")


def test_haplotags(spark):
    lines = spark.createDataFrame([(0, "@SQ\tSN:c"), (1, "r1\t0\tc"), (2, "r2\t0\tc")], "line_no long, value string")
    tags = spark.createDataFrame([("r2", 4)], "qname string, hp int")
    assert [r["value"] for r in sinks.tagged_alignments(lines, tags).orderBy("line_no").collect()] == ["@SQ\tSN:c", "r1\t0\tc", "r2\t0\tc\tHP:i:4"]


def test_alignments_split_by_part(spark, tmp_path):
    lines = spark.createDataFrame([(0, "@SQ\tSN:c"), (1, "r1\t0\tc"), (2, "r2\t0\tc"), (3, "r3\t0\tc")], "line_no long, value string")
    parts = spark.createDataFrame([("r1", 5), ("r1", 2), ("r2", 5)], "qname string, part int")
    sinks.write_lines(sinks.split_alignments(lines, parts), str(tmp_path / "out"))
    read = lambda k: [r["value"] for r in spark.read.text(str(tmp_path / "out" / f"part={k}")).collect()]
    assert read(2) == ["@SQ\tSN:c", "r1\t0\tc"] and read(5) == ["@SQ\tSN:c", "r2\t0\tc"]


def test_scalars(spark):
    from pyspark.sql import functions as F

    from phaseframe.functions.scalars import chi_square_cdf3, poisson

    rows = spark.createDataFrame([(2.3660, 0.5), (7.8147, 0.95), (11.3449, 0.99), (0.3518, 0.05)], "x double, p double")
    assert all(abs(r["found"] - r["p"]) < 1e-4 for r in rows.select("p", chi_square_cdf3(F.col("x")).alias("found")).collect())
    total = spark.range(200).select(poisson(F.col("id"), F.lit(60.0)).alias("p")).agg(F.sum("p")).first()[0]
    assert total == pytest.approx(1)


def test_headers_carry_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(files, "STRETCH", 3)
    rows = [">a x", "AC", "GT", "AA", "CC", "GG", "TT", ">b", ">c", "A", "C", "G", "T"]
    found = files.parse_fasta(spark.createDataFrame(list(enumerate(rows)), "line_no long, value string"))
    assert sorted((r["contig"], r["seq"]) for r in found.collect()) == [("a", "ACGTAACCGGTT"), ("c", "ACGT")]


def test_hybrid_runs_and_bam_outputs(spark, inputs, tmp_path):
    """Long reads with many errors are corrected by short pairs, which join the parts; tags and splits say the same."""
    from phaseframe.sources import bamsource

    folder, reference, sites, _ = inputs
    rng = random.Random(11)
    other = {(c, p - 1): b for c, p, _, b in sites}
    strains = {c: [{p for (d, p) in other if d == c and rng.random() < 0.5} for _ in range(2)] for c, _ in CONTIGS}

    def text(contig, start, size, strain, wrong):
        bases = [other[contig, p] if p in strains[contig][strain] else reference[contig][p] for p in range(start, start + size)]
        return "".join(rng.choice("ACGT") if rng.random() < wrong else b for b in bases)

    long_rows, short_rows = [], []
    for contig, length in CONTIGS:
        for k in range(60):
            start = rng.randrange(length - 700)
            long_rows.append((contig, f"{contig}s{k % 2}_L{k}", 0, 60, start, [(700, "M")], text(contig, start, 700, k % 2, 0.12), [12] * 700))
        for k in range(length // 10):
            start = rng.randrange(length - 420)
            for flags, at in ((99, start), (147, start + 240)):
                short_rows.append((contig, f"{contig}s{k % 2}_S{k}", flags, 60, at, [(160, "M")], text(contig, at, 160, k % 2, 0.0), [38] * 160))
    (tmp_path / "long.sam").write_text("\n".join(sam_lines(long_rows)) + "\n")
    (tmp_path / "short.sam").write_text("\n".join(sam_lines(short_rows)) + "\n")
    out = str(tmp_path / "out")
    cli.main(["phase", "-b", str(tmp_path / "long.sam"), "-H", str(tmp_path / "short.sam"), "-v", str(folder / "sites.vcf"), "-o", out, "-e", "0.03", "-l", "1500", "--reassign-short", "--bin-by-cov"])
    parts = {}
    for r in cli.read_parts(spark, out, 0).collect():
        parts.setdefault((r["contig"], r["part"]), set()).add(r["qname"])
    long_names = [n for own in parts.values() for n in own if "_L" in n]
    assert sorted(long_names) == sorted(r[1] for r in long_rows)
    pure = sum(max(sum("s0_" in n for n in own), sum("s1_" in n for n in own)) for own in parts.values())
    total = sum(map(len, parts.values()))
    assert pure > 0.95 * total and total > 0.8 * len(short_rows) / 2
    cli.main(["haplotag", "-b", str(tmp_path / "long.sam"), "-p", out, "-o", str(tmp_path / "tagged")])
    tagged = bamsource.read_split(spark, str(tmp_path / "tagged")).collect()
    assert len(tagged) == len(long_rows)
    assert all(r["qname"] in parts[r["contig"], r["hp"]] for r in tagged)
    assert [c for c, _ in bamsource.header(bamsource.Stream(bamsource.Members(bamsource.bam_files(str(tmp_path / "tagged"))[0][0])))] == [c for c, _ in CONTIGS]
    cli.main(["split", "-b", str(tmp_path / "long.sam"), "-p", out, "-o", str(tmp_path / "split"), "--min-hapq", "1"])
    names = [p.name for p in (tmp_path / "split").iterdir()]
    assert names and all(n.startswith("part=") for n in names)
    for name in names:
        own = {(r["contig"], r["qname"]) for r in bamsource.read_split(spark, str(tmp_path / "split" / name)).collect()}
        assert own <= {(c, n) for (c, p), reads in parts.items() if p == int(name[5:]) for n in reads} and own
