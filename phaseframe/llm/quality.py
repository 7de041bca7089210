"""Quality classifier (operator 4): histogram gradient-boosted trees over document statistics.

The model is fitted on the driver from statistics of a bounded, documented sample of labelled documents
(`sample` ids, chosen by a hash of the id, one row of each); everything else is one narrow pass over the text
column of all documents. Trees are flattened into arrays of fixed depth, so a batch walks all of them with a
few numpy gathers.

Defined results: a text that is null or empty has the statistics of an empty text and a score like any
other; documents without a label, or with a null id, are scored but never learnt from; of several labels of
one id the mean counts (0.5 and more: 1), of several documents of one id the one with the smallest statistics
is learnt; with no labels, or labels of one kind, every score is the smoothed share of label 1; a null id is
not held out; the table may be empty. lang, source and ids are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseframe.llm import textscan
from phaseframe.llm.common import bounded_batches, fold_of

BINS = 48


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_UPPER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_STOP, _MARK = _table(".,;:?'\"()-"), _table("!#$%&*+/<=>@[\\]^_`{|}~")
_LINE, _HIGH = _table("\n"), np.arange(256) >= 128


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text of a slice."""
    sizes = np.maximum(np.diff(offsets), 1)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=sums[1:], dtype=np.int32)
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / sizes

    words = textscan.Words(data, offsets)
    hashes, lengths, counts = words.hashes(), words.ends - words.starts, words.counts
    breaks = np.flatnonzero(_LINE[data])
    cuts = np.unique(np.concatenate([breaks, offsets[:-1]])) if len(data) else offsets[:0]
    cuts = cuts[cuts < len(data)]
    line_hash = textscan.span_hashes(data, cuts, np.append(cuts[1:], len(data))) if len(cuts) else hashes[:0]
    line_at = np.searchsorted(cuts, offsets)
    more = np.zeros((len(counts), 8))
    for k, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
        n = b - a
        if not n:
            continue
        own = hashes[a:b]
        _, times = np.unique(own, return_counts=True)
        share_of = times / n
        lines = line_hash[line_at[k] : line_at[k + 1]]
        pairs = own[1:] * np.uint64(3) + own[:-1]
        more[k] = (
            len(times) / n,
            share_of.max(),
            float(-(share_of * np.log(share_of)).sum()) / np.log(n + 1),
            np.mean(own[1:] == own[:-1]) if n > 1 else 0,
            len(np.unique(pairs)) / max(len(pairs), 1),
            len(np.unique(lines)) / max(len(lines), 1),
            n / max(len(lines), 1),
            lengths[a:b].mean(),
        )
    shares = [share(t) for t in (_UPPER, _DIGIT, _STOP, _MARK, _LINE, _HIGH)]
    return np.column_stack([np.log1p(np.diff(offsets)), np.log1p(counts), *shares, more])


class Trees:
    """Boosted trees of one depth; node k of a tree has its children at 2k + 1 and 2k + 2."""

    def __init__(self, edges: list[np.ndarray], base: float) -> None:
        self.edges, self.base = edges, base
        self.feature, self.cut, self.leaf = [], [], []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def margin(self, binned: np.ndarray) -> np.ndarray:
        total = np.full(len(binned), self.base)
        rows = np.arange(len(binned))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(binned), np.int64)
            while at.max(initial=0) < len(feature):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
                if len(at) == 0:
                    break
            total += leaf[at - len(feature)]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 2.0, least: float = 5.0) -> Trees:
    """Second-order boosting of the logistic loss over binned statistics."""
    rate_of_one = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = Trees(edges, float(np.log(rate_of_one / (1 - rate_of_one))))
    if len(np.unique(y)) < 2:
        return model
    binned = model.bins(x)
    width = BINS + 1
    flat = binned + np.arange(x.shape[1]) * width
    margin = np.full(len(y), model.base)
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, width)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            if len(own) >= 2:
                g, h = (np.bincount(flat[own].ravel(), np.repeat(v[own], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1) for v in (grad, hess))
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(h < least / 4) | (h[:, -1:] - h < least / 4)] = 0
                best = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[best] > 1e-9:
                    feature[node], cut[node] = best
            at[own] = 2 * node + 1 + (binned[own, feature[node]] > cut[node])
        leaf_of = at - inner
        g, h = np.bincount(leaf_of, grad, inner + 1), np.bincount(leaf_of, hess, inner + 1)
        leaf = -rate * g / (h + ridge)
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
        margin = margin + leaf[leaf_of]
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fits on at most `sample` labelled documents outside the held-out fold, chosen by a hash of the id."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").where(fold_of("id", folds) != held_out_fold)
    chosen = usable.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")
    width = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch):
                x = statistics(*textscan.utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    id_type = docs.schema[id_col].dataType.simpleString()
    # one row of each id, so that no more than `sample` come to the driver
    single = rows.mapInArrow(run, f"id {id_type}, y int, x array<double>").groupBy("id").agg(F.min(F.struct("x", "y")).alias("least")).select("id", "least.*")
    found = single.toPandas().sort_values("id", kind="stable")
    x = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, width))
    return fit(x, found["y"].to_numpy(np.float64))


def score_of(model: Trees, spark: SparkSession, text_col: str = "text") -> Column:
    """The probability of label 1; nothing but the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = textscan.slices(pa.RecordBatch.from_arrays([text], names=["text"]))
        found = [shared.value.scores(statistics(*textscan.utf8(part.column(0)))) for part in parts]
        return pa.array(np.concatenate([np.zeros(0), *found]))

    return score(F.col(text_col))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    scored = bounded_batches(docs).select("doc_id", score_of(train(docs, labels), docs.sparkSession).alias("score"))
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    return bounded_batches(docs).where(score_of(train(docs, labels, text_col=text_col), docs.sparkSession, text_col) >= threshold)
