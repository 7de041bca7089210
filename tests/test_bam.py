"""BAM files cut into tasks, found by index, and written with tags: the same rows whatever the cut."""

import random
import struct
import zlib

import pytest

from phaseframe.sources import bam
from phaseframe.sources import bamsource as B

CONTIGS = [("c1", 2_000_000), ("c2", 500_000), ("empty", 1000)]
COLUMNS = ["contig", "qname", "flags", "mapq", "pos", "cigar", "seq", "qual"]


def records(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        contig, length = CONTIGS[0] if rng.random() < 0.7 else CONTIGS[1]
        size = rng.choice([1, 30, 151, 151, 900, 70_000 if k % 97 == 0 else 151])
        cigar = f"{size}M" if k % 3 or size < 10 else f"2S{size - 5}M7D3I"
        rows.append((contig, f"read/{k}", 16 * (k % 2), rng.randrange(61), rng.randrange(length), cigar, "".join(rng.choice("ACGTN") for _ in range(size)), [rng.randrange(60) for _ in range(size)], k % 7 if k % 3 else None))
    rows += [("*", f"free{k}", 4, 0, -1, "*", "ACGTA", [9] * 5, None) for k in range(20)]
    rows += [("c1", "none", 0, 60, 17, "*", "*", [], 3)]
    return rows


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "out")
    rows = records(6000)
    frame = spark.createDataFrame(rows, B.FIELDS).repartition(3)
    B.write_split(frame, CONTIGS, path)
    return path, rows


def key(rows):
    return sorted((r[1], *r[:1], *r[2:7], tuple(r[7] or ()), r[8] if len(r) > 8 else None) for r in map(tuple, rows))


def test_round_trip_whatever_the_cut(spark, written):
    path, rows = written
    expected = key(rows)
    assert [r["contig"] for r in spark.createDataFrame(rows, B.FIELDS).select("contig").distinct().collect()]
    counts = set()
    for split in (20_000, 65_536, 1 << 30):
        frame = B.read_split(spark, path, split=split)
        counts.add(frame.rdd.getNumPartitions())
        assert key(frame.collect()) == expected
    assert max(counts) > 20 > min(counts)
    # an independent reader agrees, and every file ends as it should
    assert key((*r, None) for r in bam.read_bam(spark, f"{path}/*.bam").collect()) == key((*r[:8], None) for r in rows)
    assert all(open(p.removeprefix("file://"), "rb").read().endswith(B.END) for p, _ in B.bam_files(path))


def test_contigs_by_index(spark, written, tmp_path):
    path, rows = written
    for contig in ("c1", "c2", "empty", "missing"):
        found = B.read_split(spark, path, contig=contig)
        assert key(found.collect()) == key(r for r in rows if r[0] == contig)
    part = B.BamReader(B.read_split(spark, path).schema, {"path": path, "contig": "c2"})
    ranges = part.partitions()
    whole = sum(size for _, size in B.bam_files(path))
    assert all(p.start is not None for p in ranges) and sum(p.end[0] - p.start[0] for p in ranges) < 0.6 * whole
    # without an index the same rows come from all of the file
    import shutil

    bare = tmp_path / "bare"
    bare.mkdir()
    for k, (p, _) in enumerate(B.bam_files(path)):
        shutil.copy(p.removeprefix("file://"), bare / f"{k}.bam")
    assert key(B.read_split(spark, str(bare), contig="c2", split=30_000).collect()) == key(r for r in rows if r[0] == "c2")


def test_filters_and_columns_reach_the_reader(spark, written):
    path, rows = written
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        frame = B.read_split(spark, path, columns=["contig", "pos", "hp"]).where("contig = 'c2' and pos > 1000")
        assert sorted(map(tuple, frame.collect()), key=str) == sorted(((r[0], r[4], r[8]) for r in rows if r[0] == "c2" and r[4] > 1000), key=str)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert B.decoded(B.encoded(dict(zip([*COLUMNS, "hp"], rows[0], strict=True)), {"c1": 0, "c2": 1})[4:], CONTIGS, {"pos"}).keys() == {"contig", "flags", "mapq", "pos"}


def test_parts_and_overwriting(spark, tmp_path):
    rows = records(300, 4)
    frame = spark.createDataFrame(rows, B.FIELDS)
    parts = spark.createDataFrame([(f"read/{k}", p) for k in range(0, 300, 2) for p in (5 + k % 3, 9)], "qname string, part int")
    path = str(tmp_path / "split")
    B.write_split(B.partitioned(frame, parts), CONTIGS, path)
    for part in (5, 6, 7):
        assert key(B.read_split(spark, f"{path}/part={part}").collect()) == key(r for k, r in enumerate(rows[:300]) if k % 2 == 0 and 5 + k % 3 == part)
    assert not (tmp_path / "split" / "part=9").exists() and not list((tmp_path / "split").glob("_writing*"))
    with pytest.raises(Exception, match="exists"):
        B.write_split(frame, CONTIGS, path)
    B.write_split(frame, CONTIGS, path, mode="overwrite")
    assert key(B.read_split(spark, path).collect()) == key(rows)
    tags = spark.createDataFrame([("read/1", 4), ("read/1", 6), ("read/2", 1)], "qname string, hp int")
    tagged = {r["qname"]: r["hp"] for r in B.haplotagged(frame, tags).collect()}
    assert tagged["read/1"] == 6 and tagged["read/2"] == 1 and tagged["read/4"] is None and len(tagged) == len(rows)


def test_broken_and_foreign_files(spark, written, tmp_path):
    path, rows = written
    raw = open(B.bam_files(path)[0][0].removeprefix("file://"), "rb").read()
    (tmp_path / "cut.bam").write_bytes(raw[: len(raw) * 2 // 3])
    (tmp_path / "no.bam").write_bytes(b"not a file of this kind" * 50)
    (tmp_path / "none.bam").write_bytes(b"")
    whole, cut = B.read_split(spark, B.bam_files(path)[0][0]), B.read_split(spark, str(tmp_path), split=50_000)
    assert 0 < cut.count() < whole.count() and cut.exceptAll(whole).isEmpty()
    assert B.read_split(spark, str(tmp_path / "none.bam")).count() == 0


def test_bins_and_tags():
    # bins of the index, by their definition
    for start, end in ((0, 1), (16383, 16384), (16383, 16385), (131071, 131073), (1 << 26, (1 << 26) + 5), (0, 1 << 29)):
        level = next(k for k in range(6) if start >> (14 + 3 * k) == (end - 1) >> (14 + 3 * k))
        assert B.bin_of(start, end) == sum(8**j for j in range(5 - level)) + (start >> (14 + 3 * level))
    tags = b"NMC\x05" + b"MDZ10A3\0" + b"ZBBs" + struct.pack("<i", 2) + struct.pack("<hh", 1, 2) + b"HPc\xfe"
    assert B._tag(tags, 0) == -2 and B._tag(tags[:-4], 0) is None
    assert zlib.decompress(B.END, 31) == b""
