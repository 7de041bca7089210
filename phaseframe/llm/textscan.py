"""Whole-batch scanning of Arrow string columns with numpy.

Two views of a slice of texts: UTF-8 bytes with words between ASCII white space (hashes of words and
of runs of words), and code points with character classes (pieces of a byte-level tokenizer).
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are scanned together; larger slices cost memory and gain nothing.
SLICE_BYTES = 1 << 18

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def give_back() -> None:
    """Returns memory that this worker no longer needs to the machine: workers live on from task to task, several to an
    executor, and would keep what the largest of their tasks took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def thrifty(run: Callable) -> Callable:
    """run(batches), giving memory back at its end."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a piece hold about `most` bytes; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the offset of each text (one more than texts); null is empty."""
    array = pc.fill_null(array, "").cast(pa.large_binary())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_known: list[np.ndarray] = [np.ones(1, _U64), np.ones(1, _U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2**64; one table that grows."""
    if len(_known[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(n + n // 8, base, _U64)
            table[0] = 1
            _known[k] = np.multiply.accumulate(table)
    return _known[0], _known[1]


class Spans:
    """64-bit hashes of any spans of a sequence; equal content, equal hash, wherever it stands."""

    def __init__(self, values: np.ndarray) -> None:
        up, self._down = powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, _U64)
        terms = values.astype(_U64)
        terms += _U64(1)
        terms *= up[: len(values)]
        np.cumsum(terms, out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(_U64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(values).hashes(starts, ends)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a slice: spans in bytes, the first word of each text, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        if n:
            solid = ~_SPACE[data]
            edge = np.zeros(n + 1, bool)
            edge[offsets] = True
            first = solid.copy()
            first[1:] &= _SPACE[data[:-1]] | edge[1:n]
            last = solid.copy()
            last[:-1] &= _SPACE[data[1:]] | edge[1:n]
            self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        #: Index of the first word of each text, and one past the last.
        self.bounds = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


#: Odd multipliers, one for each place in a run of words.
_PLACES = mix(np.arange(1, 65, dtype=_U64) * _U64(_BASE)) | _U64(1)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes, by its first word; runs over the end of a text are among them."""
    if len(words) < k:
        return np.zeros(0, _U64)
    total = np.zeros(len(words) - k + 1, _U64)
    for j in range(k):
        total += words[j : len(words) - k + 1 + j] * _PLACES[j]
    return mix(total)


def run_starts(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of k words within one text, and the index of each run's text."""
    runs = np.maximum(np.diff(bounds) - k + 1, 0)
    text = np.repeat(np.arange(len(runs)), runs)
    before = np.cumsum(runs) - runs
    return np.arange(len(text)) - before[text] + bounds[:-1][text], text


LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

#: Unicode White_Space, fixed values.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_SAFE_TOP = 0x20C0


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, safety and lower case of code points below _SAFE_TOP. Safe ones have the same class in every
    version of Unicode since 2010, stay as they are under NFC, and have one code point as their lower case."""
    kind = np.full(_SAFE_TOP, OTHER, np.uint8)
    safe = np.zeros(_SAFE_TOP, bool)
    lower = np.arange(_SAFE_TOP, dtype=np.uint32)
    for c in range(_SAFE_TOP):
        name = unicodedata.category(chr(c))
        if chr(c) in WHITE_SPACE:
            kind[c] = SPACE
        elif name[0] in "LN":
            kind[c] = LETTER if name[0] == "L" else NUMBER
        safe[c] = c < 0x250 or 0x2010 <= c <= 0x2027 or 0x2030 <= c <= 0x205E or 0x20A0 <= c <= 0x20B8
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
        else:
            safe[c] = False
    return kind, safe, lower


KIND, SAFE, LOWER = _tables()


class CodePoints:
    """Code points of all texts of a slice, and where each text begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.values = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        #: Byte at which each code point begins, and the end.
        self.byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        self.offsets = np.searchsorted(self.byte_at, offsets)

    def unsafe_texts(self) -> np.ndarray:
        """For each text, whether it holds a code point that the tables say nothing certain about."""
        high = self.values >= _SAFE_TOP
        odd = high | ~SAFE[np.where(high, 0, self.values)]
        seen = np.zeros(len(odd) + 1, np.int64)
        np.cumsum(odd, out=seen[1:])
        return seen[self.offsets[1:]] > seen[self.offsets[:-1]]


def contractions(values: np.ndarray, open_before: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of 's 't 'm 'd 're 've 'll at apostrophes that may begin a piece; ends: of each code point's text."""
    at = np.flatnonzero((values == 39) & open_before)
    ahead = np.zeros(len(values) + 2, np.uint32)
    ahead[: len(values)] = values
    room = ends[at] - at
    one, two = np.where(room > 1, ahead[at + 1], 0), np.where(room > 2, ahead[at + 2], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    keep = short | long
    return at[keep], at[keep] + np.where(short, 2, 3)[keep]


def pieces(points: CodePoints, leading_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of safe texts, and the first piece of each text.

    With leading_space, the pieces of the pattern that keeps all characters and joins one space to what
    follows; else those of the pattern that drops white space and takes digits one by one.
    """
    values, n = points.values, len(points.values)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(points.offsets), np.int64)
    kinds = KIND[np.where(values < _SAFE_TOP, values, 0)]
    begins_text = np.zeros(n + 1, bool)
    begins_text[points.offsets] = True
    begins_text = begins_text[:n]
    before = np.empty(n, np.uint8)
    before[1:] = kinds[:-1]
    before[begins_text] = 9
    space = kinds == SPACE
    begin = kinds != before
    text_end = np.repeat(points.offsets[1:], np.diff(points.offsets))
    after_blank = np.zeros(n, bool)
    if leading_space:
        after_blank[1:] = (values[:-1] == 32) & ~begins_text[1:]
        begin &= space | ~after_blank
        last = space.copy()  # white space before something else in the same text
        last[:-1] &= ~space[1:] & ~begins_text[1:]
        last[-1] = False
        begin |= last
    else:
        begin |= kinds == NUMBER
    starts, stops = contractions(values, (before != OTHER) & ~after_blank, text_end)
    begin[starts] = True
    begin[starts + 1] = False
    inside = stops < text_end[starts]
    begin[stops[inside]] = True
    if leading_space:
        first = np.flatnonzero(begin)
        ends = np.append(first[1:], n)
    else:
        first = np.flatnonzero(begin & ~space)
        marks = np.append(np.flatnonzero(begin | begins_text), n)
        ends = marks[np.searchsorted(marks, first, "right")]
    return first, ends, np.searchsorted(first, points.offsets)
