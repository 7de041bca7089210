"""Benchmark decontamination (operator 10): template canonicalisation with a slot check.

Texts become sequences of template words: lower-cased words without punctuation, with numbers, units after
numbers, and names (capitalised inside a sentence) replaced by typed placeholders, whose values are kept as
slots. Windows of `window` template words are hash-joined between documents and benchmark items; windows with
fewer than two plain words (of numbers and names almost alone) are joined by their own words instead. Windows
of one alignment must agree on what each of the item's slot values has become in the document, so a question
asked with other numbers is caught, and chance meetings of placeholders are not: where they disagree, the
largest part of them that agrees counts and the others do not. Two of the item's values may have become one in
windows of which half or more are plain words, not in others. A document leaks an item if the windows that
count cover at least `coverage` of the item's words.

Windows of documents are first held against a table of FILTER_BITS bits, of fixed size whatever the benchmark
has, in which the hashes of its windows are set; those that pass take part in the join.

Defined results: null or wordless texts leak nothing and are leaked by nothing; an item with fewer words
than a window is one window of its own length, and one with under three words is not searched for; rows
with a null id are no candidates; rows that share an id are judged together; ids of another than an integer type are
an error; empty tables give an empty result; only the named columns take part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm import textscan
from phaseframe.llm.common import bounded_batches, materialize, whole_id

#: Bits of the table of window hashes that every task gets (4 MB).
FILTER_BITS = 1 << 25
LEAST = 3

#: Units that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars cent cents euro euros usd eur mph kmh kph hz khz mhz ghz kb mb gb tb w kw v"
).split()

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n")] = True
_NUMBER, _UNIT, _NAME, _WORDS = (textscan.mix(np.array([k], np.uint64))[0] for k in (11, 12, 13, 14))
_TYPES = "?#%@"


def _unit_hashes() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    ends = np.cumsum([len(u) for u in raw])
    return np.sort(textscan.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(u) for u in raw], ends))


_UNIT_HASHES = _unit_hashes()


class Templates:
    """Template words of a slice: their hashes, types (0 word, 1 number, 2 unit, 3 name) and spans."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(data)
        if not n:
            self.hashes, self.kinds = np.zeros(0, np.uint64), np.zeros(0, np.int8)
            self.literal = self.hashes
            self.starts = self.ends = np.zeros(0, np.int64)
            self.bounds = np.zeros(len(offsets), np.int64)
            self.low = data
            return
        ahead, behind = np.append(data[1:], 0).astype(np.uint8), np.append(0, data[:-1]).astype(np.uint8)
        solid = _WORD[data] | (((data == 46) | (data == 44)) & _DIGIT[ahead] & _DIGIT[behind])
        for lead, second, size in ((0xE2, lambda x: x == 0x80, 3), (0xC2, lambda x: x <= 0xBF, 2)):
            at = np.flatnonzero((data == lead) & second(ahead))
            for j in range(size):
                solid[np.minimum(at + j, n - 1)] = False
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last[:-1] &= ~solid[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        accented = (behind == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        self.low = np.where(accented, data + 32, textscan.lower_ascii(data)).astype(np.uint8)
        upper = (data >= 65) & (data <= 90)
        capital = upper | ((data == 0xC3) & (ahead >= 0x80) & (ahead <= 0x9E))
        self.hashes = self.literal = textscan.span_hashes(self.low, self.starts, self.ends)
        opens = np.zeros(len(self.starts), bool)
        opens[self.bounds[:-1][self.bounds[:-1] < len(opens)]] = True
        stops = np.append(0, np.cumsum(_STOP[data]))
        opens[1:] |= stops[self.starts[1:]] > stops[self.ends[:-1]]
        number = _DIGIT[data[self.starts]]
        after_number = np.append(False, number[:-1])[: len(number)] & ~self._first()
        at = np.minimum(np.searchsorted(_UNIT_HASHES, self.hashes), len(_UNIT_HASHES) - 1)
        unit = after_number & (_UNIT_HASHES[at] == self.hashes)
        caps = np.append(0, np.cumsum(upper))
        name = capital[self.starts] & ~opens & (caps[self.ends] - caps[self.starts] <= 1) & (self.ends - self.starts > 1)
        self.kinds = np.select([number, unit, name], [1, 2, 3], 0).astype(np.int8)
        self.hashes = np.select([self.kinds == 1, self.kinds == 2, self.kinds == 3], [_NUMBER, _UNIT, _NAME], self.hashes)

    def _first(self) -> np.ndarray:
        out = np.zeros(len(self.starts), bool)
        out[self.bounds[:-1][self.bounds[:-1] < len(out)]] = True
        return out

    def windows(self, size: int, item: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first word and text of each window, and whether the hash is of the words themselves.

        It is where fewer than two words are plain. A document has such a hash of every window, as the place
        in its sentence decides whether a word is a name.
        """
        start, text = textscan.run_starts(self.bounds, size)
        plain = np.append(0, np.cumsum(self.kinds == 0))
        keep = plain[start + size] - plain[start] >= min(2, size)
        if not len(start):
            return self.hashes[:0], start, text, keep
        by_words = ~keep if item else np.ones(len(start), bool)
        templates = textscan.run_hashes(self.hashes, size)[start[keep]]
        words = textscan.mix(textscan.run_hashes(self.literal, size)[start[by_words]] ^ _WORDS)
        literal = np.repeat([False, True], [len(templates), len(words)])
        return np.append(templates, words), np.append(start[keep], start[by_words]), np.append(text[keep], text[by_words]), literal

    def slots(self, start: int, size: int) -> list[str]:
        """Type and value of each placeholder of a window, with its place."""
        at = [k for k in range(start, start + size) if self.kinds[k]]
        return [f"{_TYPES[self.kinds[k]]}{self.low[self.starts[k] : self.ends[k]].tobytes().decode('utf-8', 'replace')}" for k in at]


_FIELDS = "key long, hash long, size int, place int, slots array<string>"


def _filter(known: DataFrame) -> np.ndarray:
    """The table of bits, as 64-bit words, of known(hash)."""
    bit = F.pmod("hash", F.lit(FILTER_BITS))
    words = known.select(F.floor(bit / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, int(pmod(hash, {FILTER_BITS}) % 64))").alias("bits"))
    found = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return table.view(np.uint64)


def _passing(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes % np.uint64(FILTER_BITS)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _window_rows(texts: DataFrame, window: int, sizes: list[int], among: np.ndarray | None, short: bool) -> DataFrame:
    """Windows of texts(key, text); among: only those that pass this table; short: texts under a window are one window."""
    shared = None if among is None else texts.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch):
                made = Templates(*textscan.utf8(part.column("text")))
                keys = part.column("key").to_numpy(zero_copy_only=False)
                counts = np.diff(made.bounds)
                for size in sizes:
                    hashes, start, text, literal = made.windows(size, short)
                    if short and size < window:
                        keep = counts[text] == size
                        hashes, start, text, literal = hashes[keep], start[keep], text[keep], literal[keep]
                    if shared is not None:
                        keep = _passing(shared.value, hashes)
                        hashes, start, text, literal = hashes[keep], start[keep], text[keep], literal[keep]
                    place = (start - made.bounds[:-1][text]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[text]), pa.array(hashes.astype(np.int64)), pa.array(np.full(len(text), size, np.int32)), pa.array(place), pa.array([[] if own else made.slots(s, size) for s, own in zip(start.tolist(), literal.tolist(), strict=True)], pa.list_(pa.string()))],
                        names=["key", "hash", "size", "place", "slots"],
                    )

    return texts.mapInArrow(textscan.thrifty(run), _FIELDS)


def _item_sizes(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch):
                counts = np.diff(Templates(*textscan.utf8(part.column("text"))).bounds)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(counts, pa.int64())], names=["item_id", "n_words"])

    return items.mapInArrow(textscan.thrifty(run), "item_id long, n_words long")


Met = tuple[int, tuple[tuple[str, str], ...]]

def _agreeing_most(windows: list[Met], own: list[int]) -> list[int]:
    """The most of these windows in which each slot has one value. Windows that no open slot ties together are looked at
    apart; in each group the slot that divides it most gets one value after another."""
    values: dict[str, Counter] = {}
    for k in own:
        for slot, value in set(windows[k][1]):
            values.setdefault(slot, Counter())[value] += 1
    lost = {s: sum(c.values()) - max(c.values()) for s, c in values.items() if len(c) > 1}
    groups: list[tuple[set[str], list[int]]] = []
    for k in own:
        slots = {s for s, _ in windows[k][1] if s in lost}
        tied = [g for g in groups if g[0] & slots]
        groups = [g for g in groups if not g[0] & slots] + [(slots.union(*(g[0] for g in tied)), [i for g in tied for i in g[1]] + [k])]
    out: list[int] = []
    for slots, group in groups:
        best = group if not slots else []
        slot = min(slots, key=lambda s: (-lost[s], s), default="")
        for value in sorted(values.get(slot, ()), key=lambda v: (-values[slot][v], v != slot, v)):
            left = [k for k in group if all(s != slot or v == value for s, v in windows[k][1])]
            if len(left) > len(best):  # else no better one is among them
                found = _agreeing_most(windows, left)
                best = found if len(found) > len(best) else best
        out += best
    return out


def largest_part(windows: list[Met], size: int) -> list[Met]:
    """The most windows (place, slot and value of each placeholder) in which each slot has one value."""
    alive = [windows[k] for k in sorted(_agreeing_most(windows, [k for k, w in enumerate(windows) if len(dict(w[1])) == len(set(w[1]))]))]
    mapped = {p for _, pairs in alive for p in pairs}
    shared = {v for v, n in Counter(v for _, v in mapped).items() if n > 1}
    return [w for w in alive if 2 * (size - len(w[1])) >= size or not any(v in shared for _, v in w[1])]


def _agreeing(met: str, size: str):
    """places of the largest part that agrees, and whether all its values are the item's own."""

    @F.pandas_udf("places array<int>, same boolean")
    def found(met: pd.Series, size: pd.Series) -> pd.DataFrame:
        out = []
        for rows, n in zip(met, size, strict=True):
            part = largest_part([(int(m["place"]), tuple(zip(m["slots"], m["values"], strict=True))) for m in rows], int(n))
            out.append((sorted({p for p, _ in part}), bool(part) and all(s == v for _, pairs in part for s, v in pairs)))
        return pd.DataFrame(out, columns=["places", "same"])

    return found(met, size)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 6, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, coverage, exact: one row for each document and item that it leaks.

    exact says whether all slot values are the item's own.
    """
    items = benchmark.select(whole_id(benchmark, item_col).alias("key"), F.col(item_text).alias("text")).where("key is not null")
    known = materialize(_window_rows(items, window, list(range(LEAST, window + 1)), None, True).distinct())
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    texts = bounded_batches(docs).select(whole_id(docs, id_col).alias("key"), F.col(text_col).alias("text")).where("key is not null")
    if not sizes:
        texts = texts.where(F.lit(False))
    met = _window_rows(texts, window, sizes or [window], _filter(known), False).withColumnRenamed("key", "doc_id").withColumnRenamed("place", "at").withColumnRenamed("slots", "values")
    pairs = met.join(known.withColumnRenamed("key", "item_id"), ["hash", "size"]).where("size(slots) = size(values)")
    aligned = (
        pairs.select("doc_id", "item_id", "size", (F.col("at") - F.col("place")).alias("shift"), F.struct("place", "slots", "values").alias("met"))
        .groupBy("doc_id", "item_id", "size", "shift")
        .agg(F.collect_set("met").alias("met"))
    )
    agreed = aligned.withColumn("part", _agreeing("met", "size")).select("doc_id", "item_id", "size", "part.places", "part.same")
    union = agreed.select("doc_id", "item_id", "size", "same", F.explode("places").alias("place")).groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_set("place")).alias("places"), F.max("size").alias("size"), F.max("same").alias("exact"))
    covered = F.expr("size + aggregate(zip_with(slice(places, 2, size(places)), slice(places, 1, size(places) - 1), (y, x) -> least(y - x, size)), 0, (s, x) -> s + x)")
    out = union.withColumn("words", covered).join(_item_sizes(items).groupBy("item_id").agg(F.max("n_words").alias("n_words")), "item_id")
    return out.withColumn("coverage", F.col("words") / F.col("n_words")).where(F.col("coverage") >= coverage).select("doc_id", "item_id", F.size("places").cast("long").alias("n_windows"), "coverage", "exact")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that leak no item, with their own columns."""
    found = leaks(docs, benchmark, id_col=id_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_anti").select(*docs.columns)
