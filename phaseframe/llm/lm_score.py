"""LM scoring (operator 5): masked pseudo-likelihood with a bidirectional window network in numpy.

The network predicts every word of a text from the `SIDE` words before and after it; a document's score is
the sum of these conditional log-probabilities.

1. Words are counted over all documents. The most frequent have a number each; how many grows with the square
   root of the number of different words. All others fall into classes by length and capital letter, and
   P(word) = P(class) * P(word | class), the latter being the word's share of its class's count. Counts give
   the output biases.
2. Texts become numbers of words and are dealt to shards by a hash of id and text. How many shards there are
   depends on the number of words alone. Each round, a copy of the network is trained on each shard, in the order of
   the hashes; the copies' mean, weighted by windows, is the next network. Every word of every text is a target:
   with a `stride` (as many as there are rounds) a round takes one word in so many, the next round the next ones, so
   that the rounds together take each once. Weights meet in blocks, not one by one; the driver gets one network.
3. All documents are scored in one pass. The output layer has two levels (group, word in the group). Shares of
   rare words come from the table of counts: a chunk of texts has a dictionary of its rare words, dictionaries
   meet the counts by word, and shares go back by place. A word is there once a chunk, so no key is hot.

Defined results: null or wordless texts have 0 words and score 0, mean null; words beyond a text's ends are
an edge word; equal rows get scores that agree to single precision; an empty table gives an empty result; only
the two named columns take part. How the input is split into tasks has no part in the network; scores may differ
by it in single precision, as words are scored in other batches (by less than 0.0001 in `mean_log_likelihood`).
Rows that are equal as a whole learn in one shard, which takes time for each but no memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from phaseframe.llm import textscan
from phaseframe.llm.common import bounded_batches, materialize, release

CLASSES = 64
SIDE, WIDTH = 2, 16
BATCH = 2048
#: Groups of the smallest vocabulary; a vocabulary is groups * groups words.
LEAST_GROUPS = 32
#: Weights that are averaged as one row.
BLOCK = 4096
#: Bytes of texts that share a dictionary of rare words.
CHUNK_BYTES = 16 << 20
#: Words that a shard has about, in large tables; in small ones a shard is not made for fewer than the second.
SHARD_WORDS, LEAST_SHARD_WORDS = 1 << 22, 1 << 15
#: Shards of a table that is between the two.
USUAL_SHARDS = 8


def groups_for(different: int) -> int:
    """Groups of a vocabulary for so many different words."""
    return max(LEAST_GROUPS, round(different**0.25))


def shards_for(words: int) -> int:
    """Shards of a table of so many words."""
    return max(1, min(USUAL_SHARDS, words // LEAST_SHARD_WORDS), words // SHARD_WORDS)


class Words:
    """Numbers of words: frequent ones by rank, then one for each class of others, then the edge."""

    def __init__(self, hashes: np.ndarray, groups: int) -> None:
        order = np.argsort(hashes)
        self.keys, self.numbers, self.groups = hashes[order], order, groups
        self.size = groups * groups
        self.first_class = self.size - CLASSES

    def of(self, words: textscan.Words, hashes: np.ndarray) -> np.ndarray:
        other = self.first_class + classes(words)
        if not len(self.keys):
            return other
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.numbers[at], other)


def classes(words: textscan.Words) -> np.ndarray:
    """Class of each word: length, and whether it begins with a capital letter."""
    first = words.data[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    return 2 * (np.minimum(words.ends - words.starts, CLASSES // 2) - 1) + ((first >= 65) & (first <= 90))


class Network:
    """Weights: embeddings (a row for each place and word), their bias, groups' and words' output layers."""

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.weights = weights
        self.groups = len(weights[3])
        self.edge = self.groups * self.groups

    @staticmethod
    def shapes(groups: int) -> list[tuple[int, ...]]:
        return [(2 * SIDE * (groups * groups + 1), WIDTH), (WIDTH,), (WIDTH, groups), (groups,), (groups, WIDTH, groups), (groups, groups)]

    @classmethod
    def fresh(cls, counts: np.ndarray, groups: int) -> Network:
        rng = np.random.default_rng(3)
        weights = [rng.normal(0, 0.1, s).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for s in cls.shapes(groups)]
        share = np.log((counts + 1.0) / (counts + 1.0).sum()).reshape(groups, groups)
        weights[3] = np.log(np.exp(share).sum(1)).astype(np.float32)
        weights[5] = (share - weights[3][:, None]).astype(np.float32)
        return cls(weights)

    def rows(self, context: np.ndarray) -> np.ndarray:
        """Rows of the embeddings for words around a place."""
        return context + np.arange(2 * SIDE) * (self.edge + 1)

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        total = self.weights[1] + self.weights[0].take(rows[:, 0], axis=0)
        for j in range(1, 2 * SIDE):
            total += self.weights[0].take(rows[:, j], axis=0)
        return np.tanh(total, out=total)

    def _by_group(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]:
        """Order of rows by group, h in it, starts of groups, (group, start, end) of each, and the outputs within groups."""
        order = _order(group, self.groups)
        group, h = group[order], h[order]
        starts = _starts(group)
        spans = list(zip(group[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True))
        z = self.weights[5].take(group, axis=0)
        for g, a, b in spans:
            z[a:b] += h[a:b] @ self.weights[4][g]
        return order, h, starts, spans, z

    def log_probabilities(self, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        h = self.hidden(self.rows(context))
        group, place, every = words // self.groups, words % self.groups, np.arange(len(words))
        z = h @ self.weights[2] + self.weights[3]
        out = z[every, group] - _log_sum(z)
        order, _, _, _, z = self._by_group(h, group)
        out[order] += z[every, place[order]] - _log_sum(z)
        return out

    def gradients(self, context: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Embedding rows of a batch, and the gradients of the mean loss: of those rows, then of all other weights."""
        rows = self.rows(context)
        h = self.hidden(rows)
        group, place, every = words // self.groups, words % self.groups, np.arange(len(words))
        grads = [np.zeros_like(w) for w in self.weights[1:]]
        p = _softmax(h @ self.weights[2] + self.weights[3])
        p[every, group] -= 1
        grads[1], grads[2] = h.T @ p, p.sum(0)
        back = p @ self.weights[2].T
        order, sorted_h, starts, spans, z = self._by_group(h, group)
        q = _softmax(z)
        q[every, place[order]] -= 1
        inner = np.empty_like(back)
        for g, a, b in spans:
            grads[3][g] = sorted_h[a:b].T @ q[a:b]
            inner[a:b] = q[a:b] @ self.weights[4][g].T
        grads[4][[g for g, _, _ in spans]] = np.add.reduceat(q, starts, axis=0)
        back[order] += inner
        back *= 1 - h * h
        grads[0] = back.sum(0)
        flat = rows.ravel()
        order = _order(flat, 2 * SIDE * (self.edge + 1))
        flat = flat[order]
        starts = _starts(flat)
        inner = np.add.reduceat(back.take(order // (2 * SIDE), axis=0), starts, axis=0)
        n = np.float32(len(words))
        return flat[starts], [inner / n, *(g / n for g in grads)]

    def learn(self, context: np.ndarray, words: np.ndarray, squares: list[np.ndarray], rate: float) -> None:
        """One step of Adagrad on a batch; embeddings of words that don't occur in it stay as they are."""
        used, grads = self.gradients(context, words)
        squares[0][used] += grads[0] * grads[0]
        self.weights[0][used] -= rate * grads[0] / (np.sqrt(squares[0][used]) + 1e-6)
        for w, g, s in zip(self.weights[1:], grads[1:], squares[1:], strict=True):
            s += g * g
            w -= rate * g / (np.sqrt(s) + 1e-6)


def _order(values: np.ndarray, size: int) -> np.ndarray:
    """Order of whole numbers below size, equal ones as they come; two-byte numbers are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if size <= 1 << 16 else values, kind="stable")


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.append(0, np.flatnonzero(values[1:] != values[:-1]) + 1)[: len(values)]


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(1)
    z = z - top[:, None]
    np.exp(z, out=z)
    return top + np.log(z @ np.ones(z.shape[1], z.dtype))


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1)[:, None]
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _contexts(numbers: np.ndarray, bounds: np.ndarray, at: np.ndarray, text: np.ndarray, edge: int) -> np.ndarray:
    """Words around each place; the edge word beyond the ends of its text."""
    out = np.full((len(at), 2 * SIDE), edge, np.int64)
    for j, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        to = at + step
        inside = (to >= bounds[:-1][text]) & (to < bounds[1:][text])
        out[inside, j] = numbers[to[inside]]
    return out


def _counts(texts: DataFrame) -> DataFrame:
    """hash, class, n: how often each word occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, most=1 << 20):
                words = textscan.Words(*textscan.utf8(part.column("text")))
                hashes, at, n = np.unique(words.hashes(), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(classes(words)[at].astype(np.int8)), pa.array(n)], names=["hash", "class", "n"])

    return texts.select("text").mapInArrow(run, "hash long, class byte, n long").groupBy("hash").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


def _numbered(texts: DataFrame, words: Words, shards: int) -> DataFrame:
    """shard, key, numbers: the numbers of the words of each text that has any; key is a hash of id and text."""
    shared = texts.sparkSession.sparkContext.broadcast(words)
    kind = _kind(words.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in textscan.slices(batch):
                found = textscan.Words(*textscan.utf8(part.column("text")))
                numbers = known.of(found, found.hashes()).astype(kind)
                own = np.flatnonzero(found.counts)
                rows = [numbers[a:b].tobytes() for a, b in zip(found.bounds[own].tolist(), found.bounds[own + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(own)), pa.array(rows, pa.binary())], names=["key", "numbers"])

    keyed = texts.select(F.xxhash64("id", "text").alias("key"), "text").mapInArrow(run, "key long, numbers binary")
    return keyed.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", "numbers")


def _kind(size: int) -> str:
    """How a number below size is stored."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _round(numbered: DataFrame, shards: int, network: Network, number: int, stride: int, rate: float) -> Network:
    shared = numbered.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network([w.copy() for w in shared.value.weights])
        kind = _kind(own.edge)
        squares = [np.full_like(w, 1e-4) for w in own.weights]
        seen, shard, waiting = 0, 0, []

        def learn(least: int) -> None:
            """Learns from what is waiting, in batches; under `least` windows wait for more."""
            nonlocal waiting
            context, target = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else (np.zeros((0, 4)), np.zeros(0))
            k = 0
            while len(target) - k >= least and k < len(target):
                own.learn(context[k : k + BATCH], target[k : k + BATCH], squares, rate)
                k += BATCH
            waiting = [(context[k:], target[k:])] if k < len(target) else []

        for batch in batches:
            for part in textscan.slices(batch, "numbers"):
                shard = part.column("shard")[0].as_py()
                rows = [np.frombuffer(x, kind) for x in part.column("numbers").to_pylist()]
                counts = np.array([len(x) for x in rows])
                numbers, bounds = np.concatenate(rows).astype(np.int64), np.append(0, np.cumsum(counts))
                text = np.repeat(np.arange(len(rows)), counts)
                at = np.flatnonzero((np.arange(len(numbers)) - bounds[:-1][text] + number) % stride == 0)
                waiting.append((_contexts(numbers, bounds, at, text[at], own.edge), numbers[at]))
                seen += len(at)
                learn(BATCH)
        learn(1)
        if seen:
            flat = np.concatenate([w.ravel() for w in own.weights]).astype(np.float32)
            blocks = [flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array([shard] * n, pa.int32()), pa.array(blocks, pa.binary()), pa.array(np.full(n, seen, np.int64))], names=["at", "shard", "weights", "n"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for at, weights, n in zip(*(batch.column(c).to_pylist() for c in ("at", "weights", "n")), strict=True):
                total = sums.setdefault(at, [0.0, 0])
                total[0] = total[0] + np.frombuffer(weights, np.float32).astype(np.float64) * n
                total[1] += n
        rows = [(at, (total / n).astype(np.float32).tobytes()) for at, (total, n) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["at", "weights"])

    dealt = numbered.repartitionById(shards, F.col("shard")).sortWithinPartitions("key", "numbers")
    copies = dealt.mapInArrow(run, "at int, shard int, weights binary, n long")
    rows = copies.repartition("at").sortWithinPartitions("at", "shard").mapInArrow(mean, "at int, weights binary").toPandas().sort_values("at")
    if not len(rows):
        return network
    flat, shapes = np.frombuffer(b"".join(map(bytes, rows["weights"])), np.float32), Network.shapes(network.groups)
    parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    return Network([p.reshape(s).copy() for p, s in zip(parts, shapes, strict=True)])


def train(texts: DataFrame, counts: DataFrame, rounds: int = 2, stride: int = 2, rate: float = 0.1) -> tuple[Words, Network, np.ndarray]:
    """The vocabulary, the network, and how often words of each class occur."""
    groups = groups_for(counts.count())
    top = counts.orderBy(F.desc("n"), "hash").limit(groups * groups - CLASSES).toPandas()
    words = Words(top["hash"].to_numpy(np.int64).astype(np.uint64), groups)
    known = np.zeros(words.size)
    known[: len(top)] = top["n"].to_numpy()
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        known[words.first_class + r["class"]] = r["n"]
    np.subtract.at(known, words.first_class + top["class"].to_numpy(np.int64), top["n"].to_numpy())
    network = Network.fresh(known, groups)
    shards = shards_for(int(known.sum()))
    numbered = materialize(_numbered(texts, words, shards))
    for number in range(rounds):
        network = _round(numbered, shards, network, number, stride, rate)
    release(numbered)
    return words, network, known[words.first_class :]


_SCORED = "chunk long, ids binary, n binary, sums binary, rare binary, places binary, place int, hash long, class byte"


def _scored(texts: DataFrame, words: Words, network: Network) -> DataFrame:
    """Rows of texts (ids, n, sums, rare, places: of several texts each) and of chunks' rare words (place, hash, class)."""
    shared = texts.sparkSession.sparkContext.broadcast((words, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = shared.value
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for part in textscan.slices(batch):
                data, offsets = textscan.utf8(part.column("text"))
                found = textscan.Words(data, offsets)
                hashes = found.hashes()
                numbers = known.of(found, hashes)
                text = np.repeat(np.arange(len(found.counts)), found.counts)
                values = np.zeros(len(numbers))
                for k in range(0, len(numbers), 4 * BATCH):
                    at = np.arange(k, min(k + 4 * BATCH, len(numbers)))
                    values[at] = net.log_probabilities(_contexts(numbers, found.bounds, at, text[at], net.edge), numbers[at])
                rare = np.flatnonzero(numbers >= known.first_class)
                held.append((part.column("id"), found.counts, np.bincount(text, values, len(found.counts)), np.bincount(text[rare], minlength=len(found.counts)), hashes[rare], numbers[rare] - known.first_class))
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield from _chunk(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield from _chunk(held, number)

    return texts.mapInArrow(run, _SCORED)


def _chunk(held: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _SCORED.split(", ")]
    kinds = dict(zip(names, [pa.int64(), *[pa.binary()] * 5, pa.int32(), pa.int64(), pa.int8()], strict=True))
    hashes, at, places = np.unique(np.concatenate([h[4] for h in held]), return_index=True, return_inverse=True)
    kind = np.concatenate([h[5] for h in held])[at]

    def rows(rows_: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(rows_, kinds[c]) for c in names], names=names)

    for k in range(0, len(hashes), 50_000):
        n = min(50_000, len(hashes) - k)
        yield rows(n, chunk=[number] * n, place=np.arange(k, k + n, dtype=np.int32), hash=hashes[k : k + n].astype(np.int64), **{"class": kind[k : k + n].astype(np.int8)})
    start = 0
    for ids, n, sums, rare, own, _ in held:
        raw = pa.RecordBatch.from_arrays([ids], names=["id"]).serialize().to_pybytes()
        yield rows(1, chunk=[number], ids=[raw], n=[n.astype("<i8").tobytes()], sums=[sums.astype("<f8").tobytes()], rare=[rare.astype("<i8").tobytes()], places=[places[start : start + len(own)].astype("<i4").tobytes()])
        start += len(own)


def score(docs: DataFrame, rounds: int = 2, stride: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_likelihood for each document."""
    texts = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = materialize(_counts(texts))
    words, network, totals = train(texts, counts, rounds, stride)
    scored = materialize(_scored(texts, words, network))
    of_class = F.element_at(F.array(*[F.lit(float(max(t, 1.0))) for t in totals]), F.col("class") + 1)
    shares = scored.where("hash is not null").select(F.col("chunk").alias("of"), "place", "hash", "class").join(counts.select("hash", "n"), "hash").withColumn("share", F.log(F.col("n") / of_class)).select("of", "place", "share")
    id_type, id_arrow = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        share = np.zeros(right.num_rows)
        share[right.column("place").to_numpy()] = right.column("share").to_numpy()
        ids, ns, sums = [], [], []
        for raw, n, own, rare, places in zip(*(left.column(c).to_pylist() for c in ("ids", "n", "sums", "rare", "places")), strict=True):
            rare = np.frombuffer(rare, "<i8")
            owner = np.repeat(np.arange(len(rare)), rare)
            ids.append(pa.ipc.read_record_batch(pa.py_buffer(raw), pa.schema([("id", id_arrow)])).column(0))
            ns.append(np.frombuffer(n, "<i8"))
            sums.append(np.frombuffer(own, "<f8") + np.bincount(owner, share[np.frombuffer(places, "<i4")], len(rare)))
        n, total = np.concatenate([np.zeros(0, np.int64), *ns]), np.concatenate([np.zeros(0), *sums])
        return pa.table({"doc_id": pa.chunked_array(ids, id_arrow), "n_words": n, "log_likelihood": total, "mean_log_likelihood": pa.array(total / np.maximum(n, 1), mask=n == 0)})

    left = scored.where("hash is null").select("chunk", "ids", "n", "sums", "rare", "places")
    return left.groupBy("chunk").cogroup(shares.groupBy("of")).applyInArrow(add, f"doc_id {id_type}, n_words long, log_likelihood double, mean_log_likelihood double")
