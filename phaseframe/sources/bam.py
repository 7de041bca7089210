"""BAM files as DataFrames of alignments.

A BAM file is a series of gzip members, so it is read through Spark's binaryFile source (any store that Spark knows) and
decoded in tasks, one file a row; a file may hold 2 GB, larger ones are split by contig beforehand. Records that cannot be
read are skipped, like lines that do not parse in SAM text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: the first bytes, codes of bases and of CIGAR operations.
MAGIC, BASES, OPERATIONS = b"BAM\1", "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: A member of the stream has 64 KB at most.
MEMBER = 1 << 17
_ROWS = 2_000
ALIGNMENTS = "contig string, qname string, flags int, mapq int, pos long, cigar string, seq string, qual array<int>"


class Reader:
    """Bytes of a BGZF stream in order; a broken member ends it."""

    def __init__(self, raw: bytes) -> None:
        self._raw, self._at, self._open = raw, 0, b""

    def take(self, n: int) -> bytes | None:
        """The next n bytes; None where the stream has fewer."""
        while len(self._open) < n and self._at < len(self._raw):
            piece, member = self._raw[self._at : self._at + MEMBER], zlib.decompressobj(31)
            try:
                self._open += member.decompress(piece)
            except zlib.error:
                member = None
            self._at = self._at + len(piece) - len(member.unused_data) if member and member.eof else len(self._raw)
        if len(self._open) < n:
            return None
        out, self._open = self._open[:n], self._open[n:]
        return out

    def number(self) -> int | None:
        raw = self.take(4)
        return None if raw is None else struct.unpack("<i", raw)[0]


def contigs(reader: Reader) -> list[tuple[str, int]] | None:
    """Names and lengths of the header, in order; None if this is no BAM file."""
    if reader.take(4) != MAGIC:
        return None
    text = reader.number()
    if text is None or reader.take(text) is None:
        return None
    out = []
    for _ in range(reader.number() or 0):
        name, length = reader.take(reader.number() or 0), reader.number()
        if name is None or length is None:
            return None
        out.append((name.rstrip(b"\0").decode(), length))
    return out


def records(reader: Reader, names: list[tuple[str, int]]) -> Iterator[tuple]:
    """contig, qname, flags, mapq, pos, cigar, seq, qual of the records."""
    while (size := reader.number()) is not None:
        raw = reader.take(size)
        if raw is None:
            return
        try:
            contig, pos, n_name, mapq, _, n_cigar, flags, n_seq = struct.unpack_from("<iiBBHHHi", raw)
            at = 32 + n_name
            cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", raw, at))
            at += 4 * n_cigar
            packed = raw[at : at + (n_seq + 1) // 2]
            seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq]
            qual = list(raw[at + len(packed) : at + len(packed) + n_seq])
            if len(packed) < (n_seq + 1) // 2 or len(qual) < n_seq:
                continue
            yield names[contig][0] if contig >= 0 else "*", raw[32 : at - 4 * n_cigar - 1].decode(), flags, mapq, pos, cigar or "*", seq or "*", qual
        except (struct.error, IndexError, UnicodeDecodeError):
            continue


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """contig, qname, flags, mapq, pos (from 0), cigar, seq, qual of all records under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ALIGNMENTS.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for raw in batch.column("content"):
                reader, rows = Reader(raw.as_py()), []
                found = contigs(reader)
                for row in records(reader, found) if found is not None else ():
                    rows.append(row)
                    if len(rows) == _ROWS:
                        yield give(rows)
                        rows = []
                if rows:
                    yield give(rows)

    return _files(spark, path).mapInArrow(run, ALIGNMENTS)


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """contig, length, ordinal of the headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                found = contigs(Reader(raw.as_py())) or []
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64()), pa.array(range(len(found)), pa.int32())], names=["contig", "length", "ordinal"])

    return _files(spark, path).mapInArrow(run, "contig string, length long, ordinal int").groupBy("contig", "length").agg(F.min("ordinal").alias("ordinal"))
