"""Language ID (operator 9): a bidirectional gated recurrent network over bytes, trained in numpy.

Every text is read whole, as one sequence in each direction; each byte gets a distribution over the languages
from the states of both directions, and a document's is the mean over its bytes. Texts of a slice run side by
side. One longer than SEGMENT bytes is cut into segments that run side by side too, each from the state that
its direction has after the WARM bytes before it: by then next to nothing is left of an earlier state (the
tests compare it with an uncut run).

Training is backpropagation through time on the driver over a bounded, documented sample of labelled rows: at
most `sample` of them by a hash of id and text, and at most `sample_bytes` of text (a row that would go beyond
is left out). Their whole texts are read as streams, STEP bytes at a time: the forward direction carries its
state on, the backward one begins STEP bytes further on.

Defined results: null texts and texts without a letter are `und` with score 0; with nothing to learn from,
all are `und`; documents with a null id or a null lang are predicted but never learnt from; a null id is not
held out; equal rows count once in learning and get equal predictions; tables may be empty; only id, text and
(to learn) lang take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm import textscan
from phaseframe.llm.common import bounded_batches, fold_of

HIDDEN = 8
#: Bytes of a training step and of the longest stretch that is read in one go; bytes run before such a stretch.
STEP, SEGMENT, WARM = 64, 2048, 256
#: Bytes of texts that run side by side.
TOGETHER = 2 << 20

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _squash(x: np.ndarray) -> np.ndarray:
    """tanh; by exp, which numpy has faster."""
    return 2 / (1 + np.exp(-2 * x)) - 1


class Direction:
    """A gated recurrent unit; inputs are rows of a table, one for each byte value."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.table = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        self.inner = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)

    def step(self, symbols: np.ndarray, h: np.ndarray) -> np.ndarray:
        x, g = self.table[symbols], h @ self.inner
        gates = x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new = _squash(x[:, 2 * HIDDEN :] + gates[:, HIDDEN:] * g[:, 2 * HIDDEN :])
        return new + gates[:, :HIDDEN] * (h - new)

    def states(self, data: np.ndarray, live: np.ndarray, h: np.ndarray, keep: list) -> np.ndarray:
        """States after each step of data (steps, rows) from h; those of steps that aren't live stay. keep gets what
        the way back needs."""
        out = np.empty((len(data), data.shape[1], HIDDEN), np.float32)
        for t, symbols in enumerate(data):
            x, g = self.table[symbols], h @ self.inner
            gates = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            update, reset = np.where(live[t][:, None], gates[:, :HIDDEN], np.float32(1)), gates[:, HIDDEN:]
            new = _squash(x[:, 2 * HIDDEN :] + reset * g[:, 2 * HIDDEN :])
            keep.append((h, g, update, reset, new))
            h = new + update * (h - new)
            out[t] = h
        return out

    def gradients(self, data: np.ndarray, keep: list, outer: np.ndarray) -> list[np.ndarray]:
        """Of table and inner, from the gradients of all states."""
        inner, all_x = np.zeros_like(self.inner), np.empty((*data.shape, 3 * HIDDEN), np.float32)
        carry = np.zeros(outer.shape[1:], np.float32)
        for t in reversed(range(len(data))):
            h, g, update, reset, new = keep[t]
            d = outer[t] + carry
            d_new = d * (1 - update) * (1 - new**2)
            d_update = d * (h - new) * update * (1 - update)
            d_reset = d_new * g[:, 2 * HIDDEN :] * reset * (1 - reset)
            all_x[t] = np.concatenate([d_update, d_reset, d_new], 1)
            d_g = np.concatenate([d_update, d_reset, d_new * reset], 1)
            inner += h.T @ d_g
            carry = d * update + d_g @ self.inner.T
        flat = all_x.reshape(-1, 3 * HIDDEN)
        table = np.stack([np.bincount(data.ravel(), flat[:, j], 256) for j in range(3 * HIDDEN)], 1).astype(np.float32)
        return [table, inner]


class Network:
    def __init__(self, names: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.names = names
        self.ways = [Direction(rng), Direction(rng)]
        self.out = rng.normal(0, 0.3, (2 * HIDDEN, len(names))).astype(np.float32)
        self.bias = np.zeros(len(names), np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.ways[0].table, self.ways[0].inner, self.ways[1].table, self.ways[1].inner, self.out, self.bias]

    def loss_gradients(self, data: np.ndarray, live: np.ndarray, labels: np.ndarray, h: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
        """Mean loss over the live bytes of the first STEP of data (steps, rows), its gradients, and the forward states there."""
        keeps: tuple[list, list] = ([], [])
        ahead = self.ways[0].states(data[:STEP], live[:STEP], h, keeps[0])
        behind = self.ways[1].states(data[::-1], live[::-1], np.zeros_like(h), keeps[1])[::-1]
        states = np.concatenate([ahead, behind[:STEP]], 2)
        z = states @ self.out + self.bias
        p = np.exp(z - z.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        inside = live[:STEP]
        n, rows = max(1, int(inside.sum())), np.arange(len(labels))
        loss = float(-(np.log(np.maximum(p[:, rows, labels], 1e-30)) * inside).sum()) / n
        p[:, rows, labels] -= 1
        p *= inside[:, :, None] / np.float32(n)
        outer = p @ self.out.T
        back = np.zeros(behind.shape, np.float32)
        back[:STEP] = outer[:, :, HIDDEN:]
        grads = self.ways[0].gradients(data[:STEP], keeps[0], outer[:, :, :HIDDEN]) + self.ways[1].gradients(data[::-1], keeps[1], back[::-1])
        return loss, [*grads, np.einsum("trh,trl->hl", states, p), p.sum((0, 1))], ahead[-1]

    def train(self, texts: list[bytes], labels: np.ndarray, least: int = 200, streams: int = 160, rate: float = 0.02) -> None:
        """Adam over the texts, each read whole; passes over all of them until there were `least` steps."""
        rng = np.random.default_rng(11)
        streams = min(streams, len(texts))
        a_pass = -(-sum(-(-len(t) // STEP) for t in texts) // streams)
        passes = max(1, -(-least // a_pass))
        order = np.concatenate([rng.permutation(len(texts)) for _ in range(passes)])
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        own, at, upcoming = order[:streams].copy(), np.zeros(streams, np.int64), streams
        h = np.zeros((streams, HIDDEN), np.float32)
        steps = passes * a_pass
        for step in range(1, steps + 1):
            data, live = np.zeros((2 * STEP, streams), np.uint8), np.zeros((2 * STEP, streams), bool)
            for k, (i, a) in enumerate(zip(own.tolist(), at.tolist(), strict=True)):
                piece = np.frombuffer(texts[i][a : a + 2 * STEP], np.uint8)
                data[: len(piece), k], live[: len(piece), k] = piece, True
            _, grads, h = self.loss_gradients(data, live, labels[own], h)
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for w, g, m, v in zip(self.weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            at += STEP
            h = h.copy()
            for k in np.flatnonzero(at >= [len(texts[i]) for i in own.tolist()]).tolist():
                own[k], at[k], h[k] = order[upcoming % len(order)], 0, 0
                upcoming += 1

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean distribution over the bytes of each text; zeros for empty ones."""
        sizes = np.diff(offsets)
        parts = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = offsets[:-1][text] + number * SEGMENT
        stops = np.minimum(starts + SEGMENT, offsets[1:][text])
        order = np.argsort(starts - stops, kind="stable")  # longest first: those still running come first
        text, starts, stops, ends = text[order], starts[order], stops[order], offsets[1:][text[order]]
        sums = self._sums(data, starts, stops, offsets[:-1][text], ends)
        total = np.zeros((len(sizes), len(self.names)))
        for j in range(len(self.names)):
            total[:, j] = np.bincount(text, sums[:, j], len(sizes))
        return total / np.maximum(sizes, 1)[:, None]

    def _sums(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Summed distributions over the bytes of stretches of texts (begins, ends), longest first."""
        ahead, behind = self.ways
        h, b = (np.zeros((len(starts), HIDDEN), np.float32) for _ in range(2))
        cut, open_ = np.flatnonzero(starts > begins), np.flatnonzero(stops < ends)
        for t in range(-WARM, 0) if len(cut) else ():
            h[cut] = ahead.step(data[starts[cut] + t], h[cut])
        for t in reversed(range(WARM)) if len(open_) else ():
            now = open_[stops[open_] + t < ends[open_]]
            b[now] = behind.step(data[stops[now] + t], b[now])
        lengths = stops - starts
        running = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")  # rows longer than t
        z = [np.empty((0, 0))] * len(running)
        for t in reversed(range(len(running))):
            n = running[t]
            b[:n] = behind.step(data[starts[:n] + t], b[:n])
            z[t] = b[:n] @ self.out[HIDDEN:] + self.bias
        total = np.zeros((len(starts), len(self.names)))
        for t, n in enumerate(running.tolist()):
            h[:n] = ahead.step(data[starts[:n] + t], h[:n])
            p = z[t] + h[:n] @ self.out[:HIDDEN]
            z[t] = p  # turned into distributions together with its neighbours
            if t % STEP == STEP - 1 or t == len(running) - 1:
                self._pool(z[t - t % STEP : t + 1], total)
                z[t - t % STEP : t + 1] = [np.empty((0, 0))] * (t % STEP + 1)
        return total

    @staticmethod
    def _pool(z: list[np.ndarray], total: np.ndarray) -> None:
        rows = np.concatenate([np.arange(len(x)) for x in z])
        p = np.concatenate(z)
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for j in range(p.shape[1]):
            total[:, j] += np.bincount(rows, p[:, j], len(total))


def train(docs: DataFrame, folds: int = 4, held_out_fold: int = 2, sample: int = 1_000, sample_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Fits on at most `sample` rows with at most `sample_bytes` of text outside the held-out fold."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("hash")).where("id is not null and lang is not null and length(text) > 0").where(fold_of("id", folds) != held_out_fold)
    order = F.xxhash64("id", "hash")
    few = usable.select("id", "hash", "lang", F.octet_length("text").cast("long").alias("size")).orderBy(order, "id", "hash", "lang").limit(sample).collect()
    chosen, left = [], sample_bytes
    for r in dict.fromkeys(few):
        if r["size"] <= left:
            left -= r["size"]
            chosen.append((r["id"], r["hash"], r["lang"]))
    picked = docs.sparkSession.createDataFrame(chosen, usable.select("id", "hash", "lang").schema)
    rows = usable.join(F.broadcast(picked), ["id", "hash", "lang"]).dropDuplicates(["id", "hash", "lang"])
    found = sorted((r["lang"], r["text"].encode()) for r in rows.select("lang", "text").collect())
    names = sorted({lang for lang, _ in found})
    network = Network(names)
    if len(names) > 1:
        network.train([text for _, text in found], np.array([names.index(lang) for lang, _ in found]))
    return network


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    seen = np.append(0, np.cumsum(_ASCII_LETTER[data]))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            for part in textscan.slices(batch, most=TOGETHER):
                data, offsets = textscan.utf8(part.column("text"))
                if network.names:
                    pooled = network.pooled(data, offsets)
                    best = pooled.argmax(1)
                    fine = _lettered(data, offsets)
                    langs = [network.names[b] if f else "und" for b, f in zip(best.tolist(), fine.tolist(), strict=True)]
                    score = np.where(fine, np.clip(pooled[np.arange(len(best)), best], 0, 1), 0.0)
                else:
                    langs, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
