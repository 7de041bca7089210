"""Substring dedup (operator 7): seed and extend over winnowed anchors.

A window is `window` consecutive words. A word is removed when a window that covers it also starts in a
document with a smaller id.

1. Seeds: of the runs of `seed` words in a window, the one with the smallest hash (the first, on ties) is
   its anchor. Equal windows choose the same anchor at the same place, so joining documents on anchors
   finds every repeat of a window or more.
2. Extend: an anchor's surroundings, as far as any window that chose it reaches both ways, are compared as
   one hash. Where they agree with those of a smaller id, all windows of the anchor are repeats. Within a
   batch of documents this is settled before anything is sent, so a passage that very many documents share
   costs one row for each batch, not for each document.
3. Anchors that stand in different surroundings are extended both ways window by window: each surrounding,
   by its smallest id, gives the hashes of its windows from the first to the last, and each window learns the
   smallest id that it starts in. What is covered by windows with a smaller id merges into maximal repeats.
   (Extending pair by pair would be quadratic in the documents that share an anchor.)

Defined results: null or wordless texts have no words and lose none; a text shorter than a window loses
nothing; rows with a null id come last in the order of ids (with the largest long, if there is one) and only repeat
others; rows that share an id do not remove from each other; ids of another than an integer type are an error; a window of under 4 or over 256 words is an error; an empty table gives an empty result; columns other than the two named play no
part in the comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseframe.llm import textscan
from phaseframe.llm.common import bounded_batches, materialize, release, whole_id

LAST = (1 << 63) - 1
SEED = 4


def anchors(grams: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """For each window (by its first word), the place of the smallest of `span` grams from there on, first on ties."""
    best = grams[starts]
    at = starts.copy()
    for j in range(1, span):
        other = grams[starts + j]
        less = other < best
        best = np.where(less, other, best)
        at[less] = starts[less] + j
    return at


class Seeds:
    """Anchors of a slice of texts with the windows that chose them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int) -> None:
        self.words = textscan.Words(data, offsets)
        self.hashes = self.words.hashes()
        span = window - SEED + 1
        first, text = textscan.run_starts(self.words.bounds, window)
        if len(first):
            grams = textscan.run_hashes(self.hashes, SEED)
            place = anchors(grams, first, span)
            edge = np.flatnonzero(np.append(True, place[1:] != place[:-1]) | np.append(True, text[1:] != text[:-1]))
            #: The anchor's gram, its text, and the first and last window that chose it, as words of the slice.
            self.gram, self.text = grams[place[edge]], text[edge]
            self.low, self.high = first[edge], first[np.append(edge[1:], len(first)) - 1]
            offset = (place[edge] - self.low).astype(np.uint64)
            around = textscan.Spans(self.hashes).hashes(self.low, self.high + window)
            self.context = textscan.mix(around + offset * np.uint64(0x9E3779B97F4A7C15))
        else:
            self.gram = self.context = np.zeros(0, np.uint64)
            self.text = self.low = self.high = np.zeros(0, np.int64)


#: The tag is the text's 64-bit hash, which tells rows with one id (or none) apart. Places are packed: first
#: window and number of windows beyond it.
_TAG = "id long, tag long, place long"


def _pack(low: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (low.astype(np.int64) << 8) | more.astype(np.int64)


def _seed_rows(docs: DataFrame, window: int) -> DataFrame:
    """gram, context, id, tag, place of every anchor; context is null for those that a smaller id of the batch settles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch):
                seeds = Seeds(*textscan.utf8(part.column("text")), window)
                ids, tags = (part.column(c).to_numpy(zero_copy_only=False)[seeds.text] for c in ("id", "tag"))
                order = np.lexsort((ids, seeds.context, seeds.gram))
                gram, context = seeds.gram[order], seeds.context[order]
                head = np.append(True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]))[: len(order)]
                first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
                settled = np.zeros(len(order), bool)
                settled[order] = ids[order] > ids[order][first]
                low = seeds.low - seeds.words.bounds[:-1][seeds.text]
                # settled rows need no company: a key of their own spreads them
                key = np.where(settled, textscan.mix(seeds.gram + ids.astype(np.uint64)), seeds.gram).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(seeds.context.astype(np.int64), mask=settled), pa.array(ids), pa.array(tags), pa.array(_pack(low, seeds.high - seeds.low))],
                    names=["gram", "context", "id", "tag", "place"],
                )

    return docs.mapInArrow(textscan.thrifty(run), f"gram long, context long, {_TAG}")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """hash, id, tag, place of each window that docs.places name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch):
                words = textscan.Words(*textscan.utf8(part.column("text")))
                grams = textscan.run_hashes(words.hashes(), window)
                lists = part.column("places")
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                places = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
                more = places & 0xFF
                owner = np.repeat(np.repeat(np.arange(part.num_rows), sizes), more + 1)
                ahead = np.arange(len(owner)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                start = np.repeat(places >> 8, more + 1) + ahead
                ids, tags = (part.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("id", "tag"))
                hashes = grams[np.minimum(words.bounds[:-1][owner] + start, max(len(grams) - 1, 0))].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids), pa.array(tags), pa.array(_pack(start, np.zeros(len(start))))], names=["hash", "id", "tag", "place"])

    return docs.mapInArrow(textscan.thrifty(run), f"hash long, {_TAG}")


def _covered(words: int, places: np.ndarray, window: int) -> np.ndarray:
    """Which of a text's words windows at packed places cover: maximal repeats, as a mask."""
    low = np.minimum(places >> 8, words)
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, np.minimum(low + (places & 0xFF) + window, words), -1)
    return np.cumsum(change)[:words] > 0


def _cut(text: str, places: str, window: int) -> Column:
    """n_words, n_removed, kept_sha256, kept_text of a text without the words at its places."""
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    @F.arrow_udf("n_words long, n_removed long, kept_sha256 string, kept_text string")
    def cut(text: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for part in textscan.slices(pa.RecordBatch.from_arrays([text, places], names=["text", "places"])):
            data, offsets = textscan.utf8(part.column("text"))
            words = textscan.Words(data, offsets)
            for k, (own, whole) in enumerate(zip(part.column("places").to_pylist(), part.column("text").to_pylist(), strict=True)):
                a, n = int(words.bounds[k]), int(words.bounds[k + 1] - words.bounds[k])
                if own:
                    mask = _covered(n, np.array(own, np.int64), window)
                    at = a + np.flatnonzero(~mask)
                    kept = b" ".join([data[s:e].tobytes() for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)])
                    out.append((n, int(mask.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
                else:
                    out.append((n, 0, hashlib.sha256(b" ".join(data[offsets[k] : offsets[k + 1]].tobytes().split())).hexdigest(), whole))
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)] if out else [pa.array([], f.type) for f in kind], fields=list(kind))

    # so declared, it is evaluated once, also where a filter and a column both need it
    return cut.asNondeterministic()(F.col(text), F.col(places))


def _by_document(places: DataFrame) -> DataFrame:
    """Packed places of a document as one list; it is no longer than the document."""
    return places.groupBy("id", "tag").agg(F.collect_list("place").alias("places"))


def _tagged(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """id (null last), no_id, tag, text and others; white space and case stay as they are."""
    return bounded_batches(docs).select(F.coalesce(whole_id(docs, id_col), F.lit(LAST)).alias("id"), F.col(id_col).isNull().alias("no_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"), *others)


def repeated_places(docs: DataFrame, window: int) -> DataFrame:
    """id, tag, places for the documents of docs(id, tag, text) that repeat a smaller id somewhere."""
    if not SEED <= window <= 256:
        raise ValueError(f"a window has {SEED} to 256 words")
    seeds = _seed_rows(docs, window)
    # by partial sums and joins, not windows: a gram may stand in a third of all documents
    often = seeds.where("context is not null").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", F.lit(True).alias("often"))
    shared = materialize(seeds.join(often, "gram", "left").where("context is null or often").drop("often"))
    open_ = shared.where("context is not null")
    contexts = open_.groupBy("gram", "context").agg(F.min("id").alias("least"))
    several = contexts.groupBy("gram").agg(F.min("context").alias("one"), F.max("context").alias("two")).select("gram", (F.col("one") != F.col("two")).alias("several"))
    state = F.when(F.col("id") > F.col("least"), 0).when(F.col("several"), 1)
    rows = materialize(open_.join(contexts, ["gram", "context"]).join(several, "gram").withColumn("state", state).where("state is not null").select("state", "id", "tag", "place"))
    open_docs = docs.join(_by_document(rows.where("state = 1")), ["id", "tag"])
    windows = materialize(_windows(open_docs, window))
    least = windows.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("hash", "least")
    found = windows.join(least, "hash").where("id > least").select("id", "tag", "place")
    settled = shared.where("context is null").select("id", "tag", "place")
    places = materialize(_by_document(settled.union(rows.where("state = 0").select("id", "tag", "place")).union(found)))
    release(shared, rows, windows)
    return places


def dedup_substrings(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row for each of docs.

    kept_sha256 is of the kept words joined by single spaces. kept_text is those words joined so, or the text
    as it was where nothing is removed.
    """
    tagged = _tagged(docs, id_col, text_col)
    joined = tagged.join(repeated_places(tagged, window), ["id", "tag"], "left")
    return joined.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), _cut("text", "places", window).alias("cut")).select("doc_id", "cut.*")


def without_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeats taken out of their texts; a document that loses all its words goes. An n_chars column
    follows the text, other columns stay as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    others = [(n, c) for n, c in zip(names, docs.columns, strict=True) if c != text_col]
    tagged = _tagged(docs, id_col, text_col, *[F.col(c).alias(n) for n, c in others])
    places = repeated_places(tagged.select("id", "tag", "text"), window)
    cut = tagged.join(places, ["id", "tag"], "left").withColumn("cut", _cut("text", "places", window)).where("cut.n_removed = 0 or cut.n_removed < cut.n_words")
    back = dict((c, F.col(n)) for n, c in others) | {text_col: F.col("cut.kept_text")}
    if "n_chars" in docs.columns:
        back["n_chars"] = F.when(F.col("cut.n_removed") > 0, F.length("cut.kept_text")).otherwise(back["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[back[c].alias(c) for c in docs.columns])
