"""BAM files as a Spark data source, in both directions.

Reading: a file is a series of BGZF members, so it is cut every `split` bytes. A task looks for the first member at or
after its cut, and in the members from there for the first byte from which records follow one another; records belong
to the task in whose range the member lies in which they begin. With an index beside the file and a contig (as an
option, or as a filter where spark.sql.python.filterPushdown.enabled is set) only the ranges that the index names are
read. Columns that aren't in the schema asked for are not decoded.

Writing: each task writes files of its own with the same header, and an index for each if its rows are sorted by contig and
position; a column `part` gives a folder for each part, `hp` becomes an HP tag. Files get their names when all tasks are done.

Files are opened where the tasks run, through pyarrow's file systems (local or shared paths, s3://, gs://, hdfs://).
read_bam() of phaseframe.sources.bam reads stores that only Spark knows, a file a task.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, WriterCommitMessage

from phaseframe.sources.bam import ALIGNMENTS, BASES, MAGIC, OPERATIONS

FIELDS = f"{ALIGNMENTS}, hp int"
#: Fixed values of the format: how a member begins, the empty member at the end, the first bytes of an index.
MEMBER_MAGIC, END, INDEX_MAGIC = b"\x1f\x8b\x08\x04", bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"), b"BAI\1"
#: Most plain bytes of a member that is written, bytes that are read at once, records that must follow one another.
PLAIN, AHEAD, CHAIN = 65_280, 1 << 20, 20
_ROWS = 2_000
_PAIRS = [BASES[b >> 4] + BASES[b & 15] for b in range(256)]
_CODES = {b: k for k, b in enumerate(BASES)}
_TYPES = {"contig": pa.string(), "qname": pa.string(), "flags": pa.int32(), "mapq": pa.int32(), "pos": pa.int64(), "cigar": pa.string(), "seq": pa.string(), "qual": pa.list_(pa.int32()), "hp": pa.int32()}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def bam_files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of a file, or of all .bam files under a folder."""
    fs, place = file_system(path)
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    found = fs.get_file_info(pafs.FileSelector(place, recursive=True, allow_not_found=True))
    return sorted((prefix + x.path, x.size) for x in found if x.type == pafs.FileType.File and x.path.endswith(".bam") and "/_" not in x.path[len(place) :])


class Members:
    """A file's members from some place on: plain bytes with the place in the file where each member begins."""

    def __init__(self, path: str, at: int = 0) -> None:
        fs, place = file_system(path)
        self._file = fs.open_input_file(place)
        self.size = self._file.size()
        self._raw, self._raw_at, self.at = b"", at, at

    def _bytes(self, n: int) -> bytes:
        """n bytes at self.at, as far as there are."""
        start = self.at - self._raw_at
        if not 0 <= start or start + n > len(self._raw):
            self._raw, self._raw_at, start = self._file.read_at(max(n, AHEAD), self.at) if self.at < self.size else b"", self.at, 0
        return self._raw[start : start + n]

    def _member_size(self) -> int | None:
        """Bytes of the member at self.at, if one begins there."""
        head = self._bytes(18)
        if len(head) < 18 or head[:4] != MEMBER_MAGIC:
            return None
        extra = self._bytes(12 + struct.unpack_from("<H", head, 10)[0])[12:]
        k = 0
        while k + 4 <= len(extra):
            size = struct.unpack_from("<H", extra, k + 2)[0]
            if extra[k : k + 2] == b"BC" and size == 2 and k + 6 <= len(extra):
                return struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + size
        return None

    def seek_member(self) -> bool:
        """Goes to the first member at or after self.at: one that can be read and that another one, or the end, follows."""
        while self.at < self.size:
            found = self._bytes(AHEAD).find(MEMBER_MAGIC)
            if found < 0:
                self.at += max(1, min(AHEAD, self.size - self.at) - 3)
                continue
            self.at += found
            start, size = self.at, self._member_size()
            if size and self.next() is not None and (self.at >= self.size or self._bytes(4) == MEMBER_MAGIC):
                self.at = start
                return True
            self.at = start + 1
        return False

    def next(self) -> bytes | None:
        """Plain bytes of the member at self.at, and on to the next; None at the end and where it is broken."""
        size = self._member_size()
        raw = self._bytes(size) if size else b""
        if not size or len(raw) < size:
            return None
        try:
            plain = zlib.decompress(raw, 31)
        except zlib.error:
            return None
        self.at += size
        return plain


class Stream:
    """Plain bytes across members. marks: (offset in the buffer, place in the file) of the members in it."""

    def __init__(self, members: Members, skip: int = 0) -> None:
        self.members, self.buffer, self.at, self.marks = members, bytearray(), 0, []
        if skip:
            self.need(skip)
            self.at = skip

    def need(self, n: int) -> bool:
        """Whether n bytes are there from self.at on."""
        while len(self.buffer) - self.at < n:
            if self.at > 4 * AHEAD:  # what has been read goes
                keep = max((o for o, _ in self.marks if o <= self.at), default=0)
                self.marks = [(o - keep, p) for o, p in self.marks if o >= keep]
                del self.buffer[:keep]
                self.at -= keep
            place, plain = self.members.at, self.members.next()
            if plain is None:
                return False
            self.marks.append((len(self.buffer), place))
            self.buffer += plain
        return True

    def take(self, n: int) -> bytes | None:
        if n < 0 or not self.need(n):
            return None
        self.at += n
        return bytes(self.buffer[self.at - n : self.at])

    def place(self) -> tuple[int, int]:
        """Of the next byte: where its member begins in the file, and its offset in the member's plain bytes."""
        if not self.need(1):
            return self.members.at, 0
        offset, place = max(m for m in self.marks if m[0] <= self.at)
        return place, self.at - offset


def header(stream: Stream) -> list[tuple[str, int]] | None:
    """Names and lengths of the contigs; the stream goes on to the first record."""
    number = lambda: struct.unpack("<i", raw)[0] if (raw := stream.take(4)) else -1
    if stream.take(4) != MAGIC or stream.take(number()) is None:
        return None
    out = []
    for _ in range(number()):
        name = stream.take(number())
        if name is None:
            return None
        out.append((name.rstrip(b"\0").decode(), number()))
    return out


def plausible(raw: bytes | bytearray, at: int, contigs: list[tuple[str, int]]) -> int | None:
    """Bytes of a record that may begin at `at`; None if none can, 0 if there is too little to tell."""
    if at + 36 > len(raw):
        return 0
    size, contig, pos, n_name, _, _, n_cigar, flags, n_seq, other, other_pos, _ = struct.unpack_from("<iiiBBHHHiiii", raw, at)
    if not (-1 <= contig < len(contigs) and -1 <= other < len(contigs) and n_name > 1 and n_seq >= 0 and pos >= -1 and other_pos >= -1):
        return None
    if size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq or (contig >= 0 and pos > contigs[contig][1]) or flags >= 1 << 12:
        return None
    name = raw[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] != 0 or not all(32 < c < 127 for c in name[:-1])):
        return None
    return size + 4


def records_follow(stream: Stream, contigs: list[tuple[str, int]]) -> bool:
    """Whether CHAIN records, or all up to the end of the file, follow one another from the next byte on."""
    ahead = 0
    for good in range(CHAIN):
        if not stream.need(ahead + 36):
            return good > 0 and len(stream.buffer) - stream.at == ahead
        size = plausible(stream.buffer, stream.at + ahead, contigs)
        if not size:
            return False
        if not stream.need(ahead + size):
            return good > 0  # the file breaks off within a record
        if plausible(stream.buffer, stream.at + ahead, contigs) != size:
            return False
        ahead += size
    return True


def first_record(stream: Stream, contigs: list[tuple[str, int]], end: int) -> bool:
    """Goes to the first record that begins in a member before `end`, if there is one."""
    while stream.need(1) and stream.place()[0] < end:
        if records_follow(stream, contigs):
            return True
        stream.at += 1
    return False


@dataclass
class Part(InputPartition):
    """Records of a file that begin between two places (member, offset); start None: at the first record at or after `cut`."""

    path: str
    start: tuple[int, int] | None
    cut: int
    end: tuple[int, int]


def _tag(raw: bytes, at: int, wanted: bytes = b"HP") -> int | None:
    """The whole number of a tag."""
    sizes = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    kinds = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2], chr(raw[at + 2])
        at += 3
        if name == wanted and kind in kinds:
            return struct.unpack_from(kinds[kind], raw, at)[0]
        if kind in "ZH":
            at = raw.index(0, at) + 1
        elif kind == "B":
            at += 5 + sizes[chr(raw[at])] * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            at += sizes[kind]
    return None


def decoded(raw: bytes, contigs: list[tuple[str, int]], columns: set[str]) -> dict | None:
    """The wanted columns of a record; None if it cannot be read."""
    try:
        contig, pos, n_name, mapq, _, n_cigar, flags, n_seq = struct.unpack_from("<iiBBHHHi", raw)
        out: dict = {"contig": contigs[contig][0] if contig >= 0 else "*", "flags": flags, "mapq": mapq, "pos": pos}
        at = 32 + n_name
        if "qname" in columns:
            out["qname"] = raw[32 : at - 1].decode()
        if "cigar" in columns:
            out["cigar"] = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", raw, at)) or "*"
        at += 4 * n_cigar
        middle, last = at + (n_seq + 1) // 2, at + (n_seq + 1) // 2 + n_seq
        if last > len(raw):
            return None
        if "seq" in columns:
            out["seq"] = "".join(map(_PAIRS.__getitem__, raw[at:middle]))[:n_seq] or "*"
        if "qual" in columns:
            out["qual"] = list(raw[middle:last])
        if "hp" in columns:
            out["hp"] = _tag(raw, last)
        return out
    except (struct.error, IndexError, KeyError, ValueError, UnicodeDecodeError):
        return None


def index_ranges(path: str, contig: int) -> list[tuple[int, int]] | None:
    """(from, to) virtual places of a contig's records by the index beside a file; None without one."""
    for name in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
        fs, place = file_system(name)
        if fs.get_file_info(place).type == pafs.FileType.File:
            raw = fs.open_input_file(place).read()
            break
    else:
        return None
    if raw[:4] != INDEX_MAGIC:
        return None
    at, out = 8, []
    for ref in range(struct.unpack_from("<i", raw, 4)[0]):
        bins = struct.unpack_from("<i", raw, at)[0]
        at += 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", raw, at)
            if ref == contig and number != 37450:
                out += [struct.unpack_from("<QQ", raw, at + 8 + 16 * k) for k in range(chunks)]
            at += 8 + 16 * chunks
        at += 4 + 8 * struct.unpack_from("<i", raw, at)[0]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


_virtual = lambda v: (v >> 16, v & 0xFFFF)


class BamReader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.columns = [f.name for f in schema.fields]
        self.path, self.split = options["path"], int(options.get("split", 64 << 20))
        self.contig = options.get("contig")

    def partitions(self):
        out = []
        for path, size in bam_files(self.path):
            contigs = header(Stream(Members(path)))
            if contigs is None:
                continue
            names = [c for c, _ in contigs]
            if self.contig is not None and self.contig not in [*names, "*"]:
                continue
            ranges = index_ranges(path, names.index(self.contig)) if self.contig in names else None
            if ranges is not None:
                out += [Part(path, _virtual(a), 0, _virtual(b)) for a, b in ranges]
            else:
                out += [Part(path, None, k, (min(k + self.split, size), 0)) for k in range(0, size, self.split)]
        return out or [Part("", None, 0, (0, 0))]

    def records(self, part: Part) -> Iterator[bytes]:
        contigs = self.contigs
        if part.start is not None:
            stream = Stream(Members(part.path, part.start[0]), part.start[1])
        elif part.cut == 0:
            stream = Stream(Members(part.path))
            header(stream)
        else:
            members = Members(part.path, part.cut)
            if not members.seek_member() or members.at >= part.end[0]:
                return
            stream = Stream(members)
            if not first_record(stream, contigs, part.end[0]):
                return
        while stream.place() < part.end and (size := stream.take(4)) is not None:
            raw = stream.take(struct.unpack("<i", size)[0])
            if raw is None:
                return
            yield raw

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        self.contigs = header(Stream(Members(part.path)))
        wanted, rows = set(self.columns), []
        number = None if self.contig is None else next((k for k, (c, _) in enumerate(self.contigs) if c == self.contig), -1)
        give = lambda: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _TYPES[c]) for c in self.columns], names=self.columns)
        for raw in self.records(part):
            if number is not None and (len(raw) < 4 or struct.unpack_from("<i", raw)[0] != number):
                continue
            row = decoded(raw, self.contigs, wanted)
            if row is not None:
                rows.append(row)
                if len(rows) == _ROWS:
                    yield give()
                    rows = []
        if rows:
            yield give()


class FilteringBamReader(BamReader):
    """Takes a contig from a filter, too."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("contig",) and self.contig in (None, f.value):
                self.contig = f.value
            else:
                yield f


def encoded(row: dict, contigs: dict[str, int]) -> bytes:
    """The bytes of a record."""
    cigar = [] if row["cigar"] in (None, "*") else [(int(n), o) for n, o in _operations(row["cigar"])]
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = [_CODES.get(b, 15) for b in seq.upper()] + [0] * (len(seq) % 2)
    qual = bytes(q & 0xFF for q in row["qual"] or ())
    qual = qual if len(qual) == len(seq) else b"\xff" * len(seq)
    name, contig, pos = row["qname"].encode() + b"\0", contigs.get(row["contig"], -1), -1 if row["pos"] is None else row["pos"]
    end = pos + max(1, sum(n for n, o in cigar if o in "MDN=X"))
    body = struct.pack("<iiBBHHHiiii", contig, pos, len(name), row["mapq"] or 0, bin_of(max(pos, 0), end) if pos >= 0 else 4680, len(cigar), row["flags"] or 0, len(seq), -1, -1, 0)
    body += name + b"".join(struct.pack("<I", n << 4 | OPERATIONS.index(o)) for n, o in cigar) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + qual
    if row.get("hp") is not None:
        body += b"HPi" + struct.pack("<i", row["hp"])
    return struct.pack("<i", len(body)) + body


def _operations(cigar: str) -> Iterator[tuple[str, str]]:
    n = ""
    for c in cigar:
        if c.isdigit():
            n += c
        else:
            yield n, c
            n = ""


def bin_of(start: int, end: int) -> int:
    """The smallest bin of the index that holds start .. end - 1: levels of 2 ** 14 bases and eight times as many each."""
    first = 4681
    for shift in range(14, 29, 3):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
        first = (first - 1) // 8
    return 0


class BamFile:
    """A file that is being written, and its index."""

    def __init__(self, path: str, contigs: list[tuple[str, int]]) -> None:
        self.path, self.contigs, self.numbers = path, contigs, {c: k for k, (c, _) in enumerate(contigs)}
        fs, place = file_system(path)
        fs.create_dir(os.path.dirname(place), recursive=True)
        self.file, self.plain, self.at = fs.open_output_stream(place, compression=None), bytearray(), 0
        text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs)
        names = b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs)
        self.append(MAGIC + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs)) + names)
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in contigs]
        self.windows: list[dict[int, int]] = [{} for _ in contigs]
        self.last, self.sorted = (-1, -1), True

    def append(self, raw: bytes) -> None:
        self.plain += raw
        while len(self.plain) >= PLAIN:
            self._member(self.plain[:PLAIN])
            del self.plain[:PLAIN]

    def _member(self, plain: bytes | bytearray) -> None:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(bytes(plain)) + squeeze.flush()
        head = MEMBER_MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
        self.file.write(head + body + struct.pack("<II", zlib.crc32(bytes(plain)), len(plain)))
        self.at += len(head) + len(body) + 8

    def _place(self) -> int:
        return self.at << 16 | len(self.plain)

    def add(self, row: dict) -> None:
        raw, began = encoded(row, self.numbers), self._place()
        self.append(raw)
        contig, pos, *_ = struct.unpack_from("<ii", raw, 4)
        if contig < 0:
            self.last = (len(self.contigs), 0)
            return
        self.sorted &= (contig, pos) >= self.last
        self.last = (contig, pos)
        end = pos + max(1, sum(int(n) for n, o in _operations(row["cigar"] if row["cigar"] != "*" else "") if o in "MDN=X"))
        chunks = self.bins[contig].setdefault(bin_of(pos, end), [])
        if chunks and chunks[-1][1] == began:
            chunks[-1][1] = self._place()
        else:
            chunks.append([began, self._place()])
        for w in range(pos >> 14, ((end - 1) >> 14) + 1):
            self.windows[contig].setdefault(w, began)

    def close(self) -> list[str]:
        """Paths of what has been written."""
        if self.plain:
            self._member(self.plain)
        self.file.write(END)
        self.file.close()
        if not self.sorted:
            return [self.path]
        out = INDEX_MAGIC + struct.pack("<i", len(self.contigs))
        for bins, windows in zip(self.bins, self.windows, strict=True):
            out += struct.pack("<i", len(bins)) + b"".join(struct.pack("<Ii", b, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for b, c in sorted(bins.items()))
            linear, before = [], 0
            for w in range(max(windows, default=-1) + 1):
                before = windows.get(w, before)
                linear.append(before)
            out += struct.pack(f"<i{len(linear)}Q", len(linear), *linear)
        fs, place = file_system(f"{self.path}.bai")
        with fs.open_output_stream(place, compression=None) as f:
            f.write(out)
        return [self.path, f"{self.path}.bai"]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class BamWriter(DataSourceArrowWriter):
    """Files are written under _writing and moved when all tasks are done; those of tasks that ran twice stay out."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.contigs, self.overwrite = options["path"].rstrip("/"), [tuple(c) for c in json.loads(options["contigs"])], overwrite
        self.work = f"{self.path}/_writing-{uuid.uuid4().hex}"
        fs, place = file_system(self.path)
        self.there = fs.get_file_info(place).type != pafs.FileType.NotFound
        if self.there and not overwrite and any(True for _ in bam_files(self.path)):
            raise ValueError(f"{self.path} exists")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, key, name, done = None, None, uuid.uuid4().hex, []
        for batch in iterator:
            parts = batch.column("part").to_pylist() if "part" in batch.schema.names else [None] * batch.num_rows
            for part, row in zip(parts, batch.to_pylist(), strict=True):
                if out is None or part != key:
                    done += out.close() if out is not None else []
                    folder = "" if part is None else f"part={part}/"
                    key, out = part, BamFile(f"{self.work}/{folder}{name}-{len(done)}.bam", self.contigs)
                out.add(row)
        return Written(done + (out.close() if out is not None else []))

    def commit(self, messages) -> None:
        fs, work = file_system(self.work)
        _, place = file_system(self.path)
        if self.overwrite and self.there:
            for old, _ in bam_files(self.path):
                for path in (old, f"{old}.bai"):
                    if fs.get_file_info(file_system(path)[1]).type == pafs.FileType.File:
                        fs.delete_file(file_system(path)[1])
        for message in messages:
            for path in message.paths if message is not None else ():
                source = file_system(path)[1]
                target = place + source[len(work) :]
                fs.create_dir(os.path.dirname(target), recursive=True)
                fs.move(source, target)
        if fs.get_file_info(work).type == pafs.FileType.Directory:
            fs.delete_dir(work)

    def abort(self, messages) -> None:
        fs, work = file_system(self.work)
        if fs.get_file_info(work).type == pafs.FileType.Directory:
            fs.delete_dir(work)


class BamSource(DataSource):
    """Format "bam". Options: path; contig, split (bytes) and filters (whether they are pushed down) for reading; contigs (JSON of names and lengths) for writing."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema):
        # Spark refuses readers that take filters while that is switched off
        return (FilteringBamReader if self.options.get("filters") == "true" else BamReader)(schema, self.options)

    def writer(self, schema, overwrite):
        return BamWriter(self.options, overwrite)


def read_split(spark: SparkSession, path: str, contig: str | None = None, columns: list[str] | None = None, split: int = 64 << 20) -> DataFrame:
    """Alignments under path (columns as in FIELDS), of one contig if it is named; each file in as many tasks as its size asks for."""
    spark.dataSource.register(BamSource)
    kinds = dict(f.split(" ", 1) for f in FIELDS.split(", "))
    reader = spark.read.format("bam").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).option("split", split).option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader if contig is None else reader.option("contig", contig)).load(path)


def write_split(alignments: DataFrame, contigs: list[tuple[str, int]], path: str, mode: str = "errorifexists") -> None:
    """Sorted BAM files with an index for each, in a folder for each part where there is a column `part`; hp becomes a tag.

    contigs: the names and lengths of the header, in order; records of other contigs are unmapped ones at the end.
    """
    alignments.sparkSession.dataSource.register(BamSource)
    names = F.create_map(*[x for k, (c, _) in enumerate(contigs) for x in (F.lit(c), F.lit(k))]) if contigs else F.create_map().cast("map<string,int>")
    keys = ["part"] if "part" in alignments.columns else []
    placed = alignments.withColumn("contig_at", F.coalesce(names[F.col("contig")], F.lit(len(contigs))))
    ordered = placed.repartitionByRange(*keys, "contig_at", "pos", "qname").sortWithinPartitions(*keys, "contig_at", "pos", "qname").drop("contig_at")
    wanted = [c for c in (*_TYPES, "part") if c in alignments.columns]
    # "append" is what data sources in Python know besides overwriting; that nothing is overwritten is checked by the writer
    ordered.select(*wanted).write.format("bam").mode("overwrite" if mode == "overwrite" else "append").option("contigs", json.dumps(contigs)).save(path)


def _by_read(rows: DataFrame) -> list[str]:
    """Reads are told apart by name, and by contig where the table has one."""
    return [c for c in ("contig", "qname") if c in rows.columns]


def haplotagged(alignments: DataFrame, tags: DataFrame) -> DataFrame:
    """alignments with hp from tags(qname, hp, and contig if wanted), null where a read has none; of several tags the largest."""
    keys = _by_read(tags)
    return alignments.drop("hp").join(tags.groupBy(*keys).agg(F.max("hp").cast("int").alias("hp")), keys, "left")


def partitioned(alignments: DataFrame, parts: DataFrame) -> DataFrame:
    """Alignments of the reads in parts(qname, part, and contig if wanted), with their first part."""
    keys = _by_read(parts)
    return alignments.join(parts.groupBy(*keys).agg(F.min("part").alias("part")), keys)
