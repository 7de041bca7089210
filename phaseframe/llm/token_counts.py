"""Token counts (operator 1): exact token counts of whole texts and of all their prefixes.

Prefix dynamic programming at two levels. Within a piece (what the tokenizer's pattern splits off), the
count of every prefix follows from the counts of shorter ones (Merges.prefix_counts); over a text, counts
at piece boundaries are running sums. Both together answer "how many tokens has this prefix" and "how long
may a prefix be within this budget" without encoding anything again.

Defined results: null is as empty text (0 tokens, 0 characters); a special string inside a text is one
token, as the library has it; rows with the same id, or equal texts, are counted each by itself; a text of
any length is counted whole; columns of the input with clashing names play no part, only the two that are
named do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm import textscan
from phaseframe.llm.common import bounded_batches
from phaseframe.llm.byte_bpe import Grid, Merges, at_code_points, grid, merges

CACHE = 1_000_000


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Counter:
    """Counts tokens with one vocabulary; keeps what it has found about pieces."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.merges: Merges = merges(path)
        self.grid: Grid = grid(path)
        self._counts: dict[int, int] = {}
        self._inner: dict[str, list[int]] = {}

    def inner(self, piece: str) -> list[int]:
        """Tokens of each non-empty prefix of a piece, by code point."""
        found = self._inner.get(piece)
        if found is None:
            found = at_code_points(piece, self.merges.prefix_counts(piece.encode()))
            if len(piece) <= 64:
                if len(self._inner) > CACHE // 8:
                    self._inner.clear()
                self._inner[piece] = found
        return found

    def split(self, text: str) -> list[tuple[str, bool]]:
        """Pieces of a text without special strings, and whether a piece is a contraction."""
        data = np.frombuffer(text.encode(), np.uint8)
        points = textscan.CodePoints(data, np.array([0, len(data)]))
        if points.unsafe_texts()[0]:
            spans = [x for _, x in _library(self.path).pre_tokenizer.pre_tokenize_str(text)]
        else:
            first, ends, _ = textscan.pieces(points, True)
            spans = list(zip(first.tolist(), ends.tolist(), strict=True))
        found = [text[a:b] for a, b in spans]
        return [(x, x in CONTRACTIONS and len(x) == 3) for x in found]

    def runs(self, text: str) -> Iterator[tuple[str, bool]]:
        """Ordinary stretches of a text and special strings, in order."""
        while text:
            at = [(k, s) for s in self.merges.special if (k := text.find(s)) >= 0]
            k, special = min(at, key=lambda x: (x[0], -len(x[1])), default=(len(text), ""))
            if k:
                yield text[:k], False
            if special:
                yield special, True
            text = text[k + len(special) :]

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i = 0 .. len(text): what the tokenizer gives for that prefix by itself."""
        out, base = [np.zeros(1, np.int64)], 0
        stretch = ""
        for run, special in self.runs(text):
            if special:  # its proper prefixes are ordinary text after what stands before
                tail = self._ordinary(stretch + run[:-1])[len(stretch) :]
                out.append(np.append(start + tail, base + 1) if stretch else np.append(base + tail, base + 1))
                stretch, base = "", base + 1
            else:
                stretch, start = run, base
                counts = self._ordinary(run)
                out.append(base + counts)
                base += int(counts[-1])
        return np.concatenate(out)

    def _ordinary(self, text: str) -> np.ndarray:
        """Tokens of each non-empty prefix of a text without special strings."""
        counts = np.zeros(len(text), np.int64)
        at = base = blanks = blank_base = 0
        for piece, contraction in self.split(text):
            inner = np.array(self.inner(piece), np.int64)
            if contraction:  # without its last letter it is an apostrophe and a letter
                inner[1] = 1 + self.inner(piece[1])[0]
            counts[at : at + len(piece)] = base + inner
            if piece[0].isspace() and at and text[at - 1].isspace():  # up to here the white space is one piece
                run = text[blanks : at + 1]
                counts[at] = blank_base + self.inner(run)[-1]
            elif piece[0].isspace():
                blanks, blank_base = at, base
            base += int(inner[-1])
            at += len(piece)
        return counts

    def fits(self, text: str, budget: int) -> int:
        """Length of the longest prefix with at most `budget` tokens."""
        return int(np.flatnonzero(self.prefixes(text) <= budget)[-1])

    def batch(self, data: np.ndarray, offsets: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text of a slice, and the length of the longest prefix within the budget."""
        points = textscan.CodePoints(data, offsets)
        slow = points.unsafe_texts()
        for special in self.merges.special:
            if special.encode() in data.tobytes():
                for k in range(len(slow)):
                    slow[k] |= special in self._text(points, k)
        first, ends, bounds = textscan.pieces(points, True)
        counts = self._piece_counts(data, points, first, ends)
        sums = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=sums[1:])
        tokens = sums[bounds[1:]] - sums[bounds[:-1]]
        lengths = np.diff(points.offsets)
        prefix = lengths.copy()
        for k in np.flatnonzero(slow):
            text = self._text(points, k)
            all_counts = self.prefixes(text)
            tokens[k], prefix[k] = all_counts[-1], np.flatnonzero(all_counts <= budget)[-1]
        for k in np.flatnonzero(~slow & (tokens > budget)):
            # the piece in which the budget ends, and its neighbours
            i = int(np.searchsorted(sums, sums[bounds[k]] + budget, "left")) - 1
            low, high = max(i - 1, int(bounds[k])), min(i + 3, int(bounds[k + 1]))
            text = self._slice(points, int(first[low]), int(ends[high - 1]))
            prefix[k] = int(first[low] - points.offsets[k]) + self.fits(text, budget - int(sums[low] - sums[bounds[k]]))
        return tokens, prefix

    @staticmethod
    def _slice(points: textscan.CodePoints, a: int, b: int) -> str:
        return points.values[a:b].tobytes().decode("utf-32-le")

    def _text(self, points: textscan.CodePoints, k: int) -> str:
        return self._slice(points, int(points.offsets[k]), int(points.offsets[k + 1]))

    def _piece_counts(self, data: np.ndarray, points: textscan.CodePoints, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes, at, back = np.unique(textscan.span_hashes(points.values, first, ends), return_index=True, return_inverse=True)
        if len(self._counts) > CACHE:
            self._counts.clear()
        known = self._counts
        found = [known.get(h, -1) for h in hashes.tolist()]
        totals = np.array(found, np.int64)
        new = np.flatnonzero(totals < 0)
        if len(new):
            starts, stops = points.byte_at[first[at[new]]], points.byte_at[ends[at[new]]]
            short = stops - starts <= Grid.LONGEST
            totals[new[short]] = self.grid.totals(data, starts[short], stops[short])
            for k in np.flatnonzero(~short):
                totals[new[k]] = self.merges.prefix_counts(data[starts[k] : stops[k]].tobytes())[-1]
            known.update(zip(hashes[new].tolist(), totals[new].tolist(), strict=True))
        return totals[back] if len(totals) else totals


#: What the pattern splits off after an apostrophe.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, budget: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (code points of the longest prefix within the budget).

    One narrow pass without a shuffle; what a task keeps is bounded by CACHE pieces and one slice of texts.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(tokenizer_path)
        for batch in batches:
            for part in textscan.slices(batch):
                data, offsets = textscan.utf8(part.column("text"))
                tokens, prefix = tool.batch(data, offsets, budget)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > budget), pa.array(prefix)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    picked = bounded_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return picked.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, prefix_tokens: element i is the number of tokens of the first i code points.

    tokens_at and fit_at answer questions from it inside the JVM.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(tokenizer_path)
        for batch in batches:
            for part in textscan.slices(batch):
                rows = [tool.prefixes(x or "").astype(np.int32) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    picked = bounded_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return picked.mapInArrow(run, f"doc_id {id_type}, prefix_tokens array<int>")


def tokens_at(prefix_tokens: str, length: int):
    """Tokens of the first `length` code points (of the whole text, if it is shorter)."""
    column = F.col(prefix_tokens)
    return F.element_at(column, F.least(F.lit(length + 1), F.size(column)))


def fit_at(prefix_tokens: str, budget: int):
    """Code points of the longest prefix with at most `budget` tokens."""
    column = F.col(prefix_tokens)
    return F.array_max(F.transform(column, lambda x, i: F.when(x <= budget, i)))
