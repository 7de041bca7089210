"""Toxicity (operator 12): a linear-chain conditional random field tags toxic words; their marginals score documents.

Labels come by document, so words are labelled first: among the prefixes and words of a bounded, documented sample
of labelled documents, those that tell toxic documents from clean ones best are taken one by one, each for the
documents that fewer than EXPLAINED before it are in, until what is left could be chance. Words of toxic documents that
hold one of them are labelled toxic, all other words clean (so one that occurs in clean documents too gets both).
The field is fitted to these labelled words on the driver: weights of hashed features of a word, of the start, and of
the four steps between two states. A document's score is a logistic function of what forward-backward marginals sum
up to, of the surest word and of the density, fitted on the sample.

Tagging is a narrow pass over the texts. Both directions of forward-backward over a slice of texts are chains of 2 x 2
matrices; the chain is cut into blocks that run side by side (products first, then states), which is exact, and texts
are separated by matrices that forget what came before. Offsets of spans count code points of the text.

Defined results: a null or empty text, or one without a letter, is scored as one without toxic words; documents
without a label, or with a null id, are scored but never learnt from; of several labels of one id the mean counts
(0.5 and more: 1), of rows with equal text one is learnt, with the mean of their labels; with no labels, or labels
of one kind, every score is the smoothed share of label 1; a null id is not held out; the table may be empty. Equal
texts get equal scores. lang, source and ids are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm import textscan
from phaseframe.llm.common import bounded_batches, fold_of

#: Bytes of the prefixes and of the suffix of a word that are features of it, besides the word.
PREFIXES, SUFFIX = (3, 4, 5, 6, 7, 8), 4
#: Slots of the table of weights, and the words of a block of a chain.
SLOTS, BLOCK = 1 << 20, 64
#: A prefix or word counts as a sign of toxic documents from this log-likelihood ratio and share of them on.
LEAST_RATIO, LEAST_SHARE = 20.0, 0.2
#: So many signs explain a toxic document; those after the first find further toxic words in it.
EXPLAINED = 3
#: The marginal from which a word is part of a span.
SPAN = 0.5

_LETTER = np.arange(256) >= 128
_LETTER[65:91] = _LETTER[97:123] = True
_SALTS = textscan.mix(np.arange(1, 10, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Tokens:
    """Words (runs of letters, bytes over 127 among them) of a slice of texts, and hashes of their features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, n = textscan.lower_ascii(data), offsets, len(data)
        solid = _LETTER[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1] & ~edge[1:n], solid[1:] & ~edge[1:n]
        self.starts, self.ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        #: Index of the first word of each text, and one past the last.
        self.bounds = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def first(self) -> np.ndarray:
        """Whether a word is the first of its text."""
        out = np.zeros(len(self.starts) + 1, bool)
        out[self.bounds[:-1]] = True
        return out[:-1]

    @property
    def text(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def features(self) -> np.ndarray:
        """A row of hashes for each kind of feature: the prefixes, the whole word, the suffix; 0 where a word is too short."""
        spans, size = textscan.Spans(self.data), self.ends - self.starts
        out = np.zeros((len(PREFIXES) + 2, len(size)), np.uint64)
        for k, n in enumerate(PREFIXES):
            own = np.flatnonzero(size >= n)
            out[k, own] = spans.hashes(self.starts[own], self.starts[own] + n) ^ _SALTS[0]
        out[-2] = spans.hashes(self.starts, self.ends) ^ _SALTS[1]
        own = np.flatnonzero(size > SUFFIX)
        out[-1, own] = spans.hashes(self.ends[own] - SUFFIX, self.ends[own]) ^ _SALTS[2]
        return out


def _states(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States a[t] ~ a[t - 1] @ m[t], each summing to 1, of a chain of positive matrices m (n, 2, 2) from (1/2, 1/2), and
    the sums before scaling. Blocks run side by side: their products first, which a shorter chain joins."""
    n = len(m)
    blocks = -(-n // BLOCK)
    whole = np.empty((blocks * BLOCK, 4))
    whole[:n] = m.reshape(n, 4)
    whole[n:] = (1, 0, 0, 1)
    p, q, r, s = np.ascontiguousarray(whole.reshape(blocks, BLOCK, 4).transpose(2, 1, 0))
    a = np.full((2, blocks), 0.5)
    if blocks > 1:
        w, x, y, z = p[0], q[0], r[0], s[0]
        for k in range(1, BLOCK):
            w, x, y, z = w * p[k] + x * r[k], w * q[k] + x * s[k], y * p[k] + z * r[k], y * q[k] + z * s[k]
            scale = 1 / (w + x + y + z)
            w, x, y, z = w * scale, x * scale, y * scale, z * scale
        joined, _ = _states(np.stack([w, x, y, z], 1)[:-1].reshape(-1, 2, 2))
        a[:, 1:] = joined.T
    states, sums = np.empty((BLOCK, blocks, 2)), np.empty((BLOCK, blocks))
    u, v = a
    for k in range(BLOCK):
        u, v = u * p[k] + v * r[k], u * q[k] + v * s[k]
        total = u + v
        u, v = u / total, v / total
        states[k, :, 0], states[k, :, 1], sums[k] = u, v, total
    return states.transpose(1, 0, 2).reshape(-1, 2)[:n], sums.T.reshape(-1)[:n]


class Field:
    """Two states, 0 clean and 1 toxic. steps: log weights from state to state; start: of the first state."""

    def __init__(self) -> None:
        self.steps, self.start = np.zeros((2, 2)), np.zeros(2)

    def chain(self, toxic: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The matrices of words whose toxic state has these log weights over the clean one."""
        clipped = np.clip(toxic, -60, 60)
        weight = np.stack([np.exp(-np.maximum(clipped, 0)), np.exp(np.minimum(clipped, 0))], 1)
        m = np.where(first[:, None, None], np.exp(self.start)[None, None, :], np.exp(self.steps)[None])
        return m * weight[:, None, :]

    def marginals(self, toxic: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probability of the toxic state of each word; and what learning needs: states from both sides, matrices."""
        m = self.chain(toxic, first)
        if not len(m):
            return np.zeros(0), np.zeros((0, 2)), np.zeros((0, 2)), m
        ahead, _ = _states(m)
        back = np.empty_like(m)
        back[0] = 1
        back[1:] = m[:0:-1].transpose(0, 2, 1)
        behind = _states(back)[0][::-1]
        both = ahead * behind
        return both[:, 1] / both.sum(1), ahead, behind, m

    def log_likelihood(self, toxic: np.ndarray, first: np.ndarray, states: np.ndarray) -> float:
        """Log probability of a labelling of the words."""
        _, sums = _states(self.chain(toxic, first))
        before = np.append(0, states[:-1])
        path = np.where(first, self.start[states], self.steps[before, states]) + np.clip(toxic, -60, 60) * states
        return float((path - np.maximum(np.clip(toxic, -60, 60), 0) - np.log(sums)).sum())


class Model(Field):
    """A field with a table of weights (found by the low bits of a feature's hash, proved by its high bits) and the
    logistic function of a document."""

    def __init__(self, share: float) -> None:
        super().__init__()
        self.weights, self.tags = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.uint32)
        self.document = np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0])

    def store(self, features: np.ndarray, weights: np.ndarray) -> None:
        for k in np.argsort(np.abs(weights), kind="stable").tolist():  # of two in one slot the heavier stays
            slot = int(features[k]) & (SLOTS - 1)
            self.weights[slot], self.tags[slot] = weights[k], int(features[k]) >> 32

    def emissions(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros(features.shape[1])
        for row in features:
            slot = (row & np.uint64(SLOTS - 1)).astype(np.int64)
            total += np.where(self.tags[slot] == (row >> np.uint64(32)).astype(np.uint32), self.weights[slot], 0)
        return total

    def scores(self, toxic: np.ndarray, tokens: Tokens) -> np.ndarray:
        """Of each text, from the marginals of its words."""
        return 1 / (1 + np.exp(-np.clip(summary(toxic, tokens) @ self.document, -40, 40)))


def summary(toxic: np.ndarray, tokens: Tokens) -> np.ndarray:
    """1, log(1 + expected toxic words), log odds of the surest word, expected toxic words in a hundred, of each text."""
    counts = tokens.counts
    expected = np.bincount(tokens.text, toxic, len(counts))
    surest, some = np.zeros(len(counts)), np.flatnonzero(counts)
    if len(some):
        surest[some] = np.maximum.reduceat(toxic, tokens.bounds[:-1][some])
    surest = np.clip(surest, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(counts)), np.log1p(expected), np.log(surest / (1 - surest)), 100 * expected / np.maximum(counts, 20)], 1)


def signs(pairs: list[np.ndarray], n: tuple[int, int], sizes: tuple[float, float]) -> np.ndarray:
    """Features that tell toxic documents, greedily. pairs: (document, feature index, rank) of clean and of toxic documents,
    distinct; n: documents of each; sizes: how many documents each stands for."""
    width = 1 + max((int(p[1].max()) for p in pairs if p.shape[1]), default=0)
    clean = np.bincount(pairs[0][1], minlength=width).astype(float)
    rank = np.zeros(width)
    rank[pairs[1][1]] = pairs[1][2]
    document, feature = pairs[1][0], pairs[1][1]
    found, times, taken = [], np.zeros(n[1], np.int64), np.zeros(width, bool)

    def part(k: np.ndarray, of: float) -> np.ndarray:
        return k * np.log(np.maximum(k, 1e-12) / of)

    while True:
        left = times < EXPLAINED
        toxic, total = np.bincount(feature[left[document]], minlength=width).astype(float), max(float(left.sum()), 1.0)
        held = toxic + clean
        whole = total + n[0]
        ratio = 2 * (part(toxic, total) + part(clean, n[0]) + part(total - toxic, total) + part(n[0] - clean, n[0]) - part(held, whole) - part(whole - held, whole))
        weighed = toxic * sizes[1]
        good = ~taken & (toxic / total > clean / n[0]) & (weighed >= LEAST_SHARE * (weighed + clean * sizes[0])) & (ratio >= LEAST_RATIO)
        if not good.any():
            break
        # of equally good ones the longest
        best = np.lexsort((rank, np.round(np.where(good, ratio, 0), 6)))[-1]
        found.append(best)
        taken[best] = True
        times[document[feature == best]] += 1
    return np.array(found, np.int64)


def fit_field(model: Field, index: np.ndarray, width: int, first: np.ndarray, states: np.ndarray, steps: int = 40, ridge: float = 0.02, rate: float = 0.3) -> np.ndarray:
    """Weights of `width` features (index: a row of them for each kind, 0 for none) by Adam over all labelled words."""
    weights, last = np.zeros(width), np.zeros(width + 6)
    second = np.zeros(width + 6)
    before = np.append(0, states[:-1])
    inner = ~first
    seen = np.bincount(2 * before[inner] + states[inner], minlength=4)
    began = np.bincount(states[first], minlength=2)
    for step in range(1, steps + 1):
        toxic = np.zeros(len(first))
        for row in index:
            toxic += weights[row]
        p, ahead, behind, m = model.marginals(toxic, first)
        pairs = m[1:] * ahead[:-1, :, None]
        pairs *= behind[1:, None, :]
        pairs = (pairs / pairs.sum((1, 2), keepdims=True))[inner[1:]].sum(0).ravel()
        start = np.array([(1 - p[first]).sum(), p[first].sum()])
        wrong = states - p
        own = np.zeros(width)
        for row in index:
            own += np.bincount(row, wrong, width)
        own[0] = 0
        g = np.concatenate([own - ridge * weights, seen - pairs, began - start])
        last += 0.2 * (g - last)
        second += 0.02 * (g * g - second)
        move = rate * min(1.0, 2 * (1 - step / (steps + 1))) * (last / (1 - 0.8**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-8)
        weights += move[:width]
        model.steps = np.clip(model.steps + move[width : width + 4].reshape(2, 2), -12, 12)
        model.start = np.clip(model.start + move[width + 4 :], -12, 12)
    return weights


def fit_document(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """A logistic function by Newton steps; the constant is not held back."""
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (weight * (y - p)) - hold * b)
        b = b + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return b


def fit(texts: list[bytes], y: np.ndarray, sizes: tuple[float, float] = (1.0, 1.0)) -> Model:
    """From whole texts with labels; sizes: how many documents a clean and a toxic text stand for."""
    n = (int((y == 0).sum()), int((y == 1).sum()))
    model = Model((n[1] * sizes[1] + 1) / (n[0] * sizes[0] + n[1] * sizes[1] + 2))
    if not all(n):
        model.steps[:, 1] = model.start[1] = -12  # no word is toxic
        return model
    data = np.frombuffer(b"".join(texts), np.uint8)
    tokens = Tokens(data, np.append(0, np.cumsum([len(t) for t in texts])))
    features = tokens.features()
    known, index, times = np.unique(features, return_inverse=True, return_counts=True)
    index = index.reshape(features.shape).astype(np.int32)
    # pairs of documents and the prefixes or words in them that occur more than once
    number = np.where(y == 1, np.cumsum(y == 1) - 1, np.cumsum(y == 0) - 1)
    held: list[list[np.ndarray]] = [[], []]
    for rank, row in enumerate(index[:-1]):
        for kind in (0, 1):
            own = np.flatnonzero((y[tokens.text] == kind) & (known[row] > 0) & (times[row] > 1))
            pair = np.unique(number[tokens.text[own]].astype(np.int64) << 32 | row[own])
            held[kind].append(np.stack([pair >> 32, pair & 0xFFFFFFFF, np.full(len(pair), rank)]))
    chosen = signs([np.concatenate(h, 1) for h in held], n, sizes)
    mark = np.zeros(len(known), bool)
    mark[chosen] = True
    states = (mark[index[:-1]].any(0) & (y[tokens.text] == 1)).astype(np.int64)
    # features that occur once or twice say nothing of other texts
    fine = (times > 2) & (known > 0)
    names = np.where(fine, np.cumsum(fine), 0).astype(np.int32)
    weights = fit_field(model, names[index], int(fine.sum()) + 1, tokens.first, states)
    model.store(known[fine], weights[1:])
    toxic = model.marginals(model.emissions(features), tokens.first)[0]
    model.document = fit_document(summary(toxic, tokens), y.astype(float), np.where(y == 1, *sizes[::-1]))
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out_fold: int = 2, sample: int = 2_000, sample_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most `sample` labelled documents with at most `sample_bytes` of text outside the held-out fold, half of
    either for each label, by a hash of the text; a document that would go beyond is left out."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").where(fold_of("id", folds) != held_out_fold)
    marked = usable.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.octet_length(F.col(text_col).cast("string")).cast("long").alias("size")).where("id is not null and size > 0")
    each = rows.join(marked, "id").groupBy("hash", "size").agg((F.avg("y") >= 0.5).cast("int").alias("y"), F.count("*").alias("times"))
    totals = {r["y"]: r["n"] for r in each.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen: list[tuple[int, int, int]] = []
    for y in (0, 1):
        left = sample_bytes // 2
        for r in each.where(F.col("y") == y).orderBy(F.xxhash64("hash"), "hash", "size").limit(sample // 2).collect():
            if r["size"] <= left:
                left -= r["size"]
                chosen.append((r["hash"], r["size"], y))
    picked = docs.sparkSession.createDataFrame(chosen, "hash long, size long, y int")
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("hash"), F.octet_length(F.col(text_col).cast("string")).cast("long").alias("size"))
    # at most sample_bytes of text
    found = sorted((r["text"].encode(), r["y"]) for r in texts.join(F.broadcast(picked), ["hash", "size"]).dropDuplicates(["hash", "size"]).select("text", "y").collect())
    y = np.array([label for _, label in found], np.int64)
    sizes = tuple(totals.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1))
    model = fit([text for text, _ in found], y, sizes)
    textscan.give_back()
    return model


def _spans(toxic: np.ndarray, tokens: Tokens, data: np.ndarray) -> pa.Array:
    """A list for each text of (start, end, score): runs of words with marginals of SPAN and more, in code points."""
    hit = toxic >= SPAN
    first = tokens.first
    goes_on = np.zeros(len(hit), bool)
    goes_on[1:] = hit[1:] & hit[:-1] & ~first[1:]
    begins = np.flatnonzero(hit & ~goes_on)
    last = np.ones(len(hit), bool)
    last[:-1] = ~goes_on[1:]
    ends = np.flatnonzero(hit & last)
    # code points before a byte
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    zero = points[tokens.offsets[:-1]][tokens.text[begins]] if len(begins) else points[:0]
    sums = np.append(0.0, np.cumsum(toxic))
    fields = [
        pa.array((points[tokens.starts[begins]] - zero).astype(np.int32)),
        pa.array((points[tokens.ends[ends]] - zero).astype(np.int32)),
        pa.array((sums[ends + 1] - sums[begins]) / np.maximum(ends + 1 - begins, 1)),
    ]
    bounds = np.searchsorted(begins, tokens.bounds)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "end", "score"]))


def tag(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans (array of start, end, score) of each document."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in textscan.slices(batch):
                data, offsets = textscan.utf8(part.column("text"))
                tokens = Tokens(data, offsets)
                toxic = known.marginals(known.emissions(tokens.features()), tokens.first)[0]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(known.scores(toxic, tokens)), _spans(toxic, tokens, data)], names=["doc_id", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(textscan.thrifty(run), f"doc_id {id_type}, score double, spans array<struct<start: int, end: int, score: double>>")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, spans of each document."""
    found = tag(docs, train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col), id_col, text_col)
    return found.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
