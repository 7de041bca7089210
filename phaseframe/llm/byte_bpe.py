"""Byte-pair merges of a tokenizers .json file, and token counts of every prefix of a piece."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from phaseframe.llm.textscan import Spans, span_hashes


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level tokenizers: bytes that print stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in stands):
        stands[b] = chr(256 + k)
    return {c: b for b, c in stands.items()}


class Merges:
    """Vocabulary and merge ranks over byte strings; special holds the added strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda piece: bytes(alphabet[c] for c in piece)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for k, (a, b) in enumerate(pairs):
            self.rank.setdefault((raw(a), raw(b)), k)
        self.longest = max(map(len, self.ids))
        self._beside: dict[tuple[bytes, bytes], bool] = {}

    def encode(self, piece: bytes) -> list[bytes]:
        """Merges of lowest rank first, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.rank.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def beside(self, a: bytes, b: bytes) -> bool:
        """Whether a and b stay two tokens when they stand side by side (a empty: whether b is one token)."""
        known = self._beside.get((a, b))
        if known is None:
            if len(self._beside) > 2_000_000:
                self._beside.clear()
            known = self._beside[a, b] = self.encode(a + b) == ([a, b] if a else [b])
        return known

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for i = 0 .. len(piece).

        An encoding is right if and only if each two neighbours in it are; so the last token of a prefix
        is the one suffix in the vocabulary that may follow the last token of what is before it.
        """
        counts, last = [0], [b""]
        for end in range(1, len(piece) + 1):
            for size in range(min(self.longest, end), 0, -1):
                token = piece[end - size : end]
                if token in self.ids and self.beside(last[end - size], token):
                    counts.append(counts[end - size] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return counts


class Grid:
    """The same prefix counts for many pieces at once.

    Tokens are numbered by the merge that makes them (bytes first), so a larger number was made later. Two
    tokens stay two if, undoing merges from the last on, no pair at their border could have merged earlier.
    """

    #: Lengths of tokens, likelier ones first; pieces up to LONGEST bytes are handled here.
    LONGEST = 40

    def __init__(self, source: Merges) -> None:
        made = {bytes([b]): b for b in range(256)}
        left, right = list(range(256)), list(range(256))
        for (a, b), _ in sorted(source.rank.items(), key=lambda x: x[1]):
            if a + b not in made and a in made and b in made:
                made[a + b] = len(left)
                left.append(made[a])
                right.append(made[b])
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        n = self.n = len(left)
        pairs = sorted((made[a] * n + made[b], made[a + b]) for a, b in source.rank if a in made and b in made)
        self.pair_keys, self.pair_made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        whole = np.arange(n) < 256
        fits = self.apart(self.left[256:], self.right[256:], np.arange(256, n))
        for t in range(256, n):
            whole[t] = fits[t - 256] and whole[left[t]] and whole[right[t]]
        tokens = [(t, k) for t, k in made.items() if whole[k] and t in source.ids]
        data = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        ends = np.cumsum([len(t) for t, _ in tokens])
        hashes = span_hashes(data, np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashes)
        self.token_keys, self.token_ids = hashes[order], np.array([k for _, k in tokens], np.int64)[order]
        lengths = sorted({len(t) for t, _ in tokens if len(t) <= self.LONGEST}, key=lambda x: (abs(x - 3), x))
        self.sizes = lengths

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], 1 << 40)

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b next to each other stay as they are (merges below limit, if given, count)."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), 1 << 39, np.int64) if limit is None else limit.astype(np.int64)
        a, b = a.copy(), b.copy()
        while len(live):
            broken = self._merged(a, b) < limit
            good[live[broken]] = False
            go = ~broken & ((a >= 256) | (b >= 256))
            live, a, b = live[go], a[go], b[go]
            later = a > b
            limit = np.where(later, a, b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return good

    def totals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[start:end] of at most LONGEST bytes."""
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        most = int(sizes[0]) if len(sizes) else 0
        counts = np.zeros((len(starts), most + 1), np.int32)
        last = np.zeros((len(starts), most + 1), np.int64)
        sums = Spans(data)
        for end in range(1, most + 1):
            open_rows = np.arange(np.searchsorted(-sizes, -end, "right"))
            for size in self.sizes:
                if size > end or not len(open_rows):
                    continue
                to = starts[open_rows] + end
                hashes = sums.hashes(to - size, to)
                at = np.minimum(np.searchsorted(self.token_keys, hashes), len(self.token_keys) - 1)
                hit = self.token_keys[at] == hashes
                rows, token = open_rows[hit], self.token_ids[at[hit]]
                if end > size:
                    fine = self.apart(last[rows, end - size], token)
                    rows, token = rows[fine], token[fine]
                counts[rows, end] = counts[rows, end - size] + 1
                last[rows, end] = token
                open_rows = open_rows[counts[open_rows, end] == 0]
        out = np.zeros(len(starts), np.int64)
        out[order] = counts[np.arange(len(starts)), sizes]
        return out


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def grid(path: str) -> Grid:
    return Grid(merges(path))


def at_code_points(piece: str, counts: list[int]) -> list[int]:
    """Of counts by byte, those after each code point of the piece (without the one at 0)."""
    data = np.frombuffer(piece.encode(), np.uint8)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    return [counts[i] for i in [*heads[1:].tolist(), len(data)]]
