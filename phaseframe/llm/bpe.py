"""BPE encoding and decoding (operator 3) through a table of distinct words.

1. Split: texts are normalised and split into words; a chunk (about `chunk_bytes` of texts of one input
   partition) keeps a dictionary of its distinct words, and each text becomes a list of places in it.
2. Encode: the dictionaries' rows meet by word, so that each distinct word of the whole table is encoded once.
3. Join back: ids return to (chunk, place) and are put in for the places of each text.
4. Decode: ids are joined to their pieces (a table as large as the vocabulary, sent to every task), pieces
   of a text in order.

What is shuffled are dictionary rows and packed places, never one row for each word of each text. Hot words
occur once a chunk, so no key is hotter than the number of chunks; a group holds one chunk. The input must
give the same rows in the same order when it is read again, as files do; other inputs should be written first.

Defined results: null is as empty text (no ids, empty decoded text); special strings inside texts become
their one id; rows with the same id or text are each encoded; tables may be empty; texts of any length are
encoded whole; only the two named columns take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm import textscan
from phaseframe.llm.byte_bpe import byte_alphabet
from phaseframe.llm.common import bounded_batches

CHUNK_BYTES = 16 << 20


class Splitter:
    """Normalises and splits as the tokenizer file says; a special string comes out with a blank before it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {token.content: k for k, token in self.library.get_added_tokens_decoder().items()}
        self._printable = str.maketrans({chr(b): c for c, b in byte_alphabet().items()})

    def slow_words(self, text: str) -> list[str]:
        """By the library itself, for texts with rare characters or special strings."""
        out: list[str] = []
        while text:
            at = [(k, s) for s in self.special if (k := text.find(s)) >= 0]
            k, special = min(at, key=lambda x: (x[0], -len(x[1])), default=(len(text), ""))
            plain = self.library.normalizer.normalize_str(text[:k])
            out += [plain[a:b] for a, b in _outer(self.library.pre_tokenizer.pre_tokenize_str(plain))]
            out += [f" {special}"] * bool(special)
            text = text[k + len(special) :]
        return out

    @cached_property
    def pieces(self) -> dict[int, str]:
        """Pieces by id, those of special strings among them."""
        return {v: k for k, v in self.library.get_vocab().items()}

    def encode(self, word: str) -> list[int]:
        if word[0] == " ":
            return [self.special[word[1:]]]
        return [t.id for t in self.library.model.tokenize(word.encode().decode("latin-1").translate(self._printable))]


def _outer(found: list[tuple[str, tuple[int, int]]]) -> list[tuple[int, int]]:
    return [span for _, span in found]


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


class Chunk:
    """Distinct words of a chunk, numbered as they come, and the places of its texts."""

    def __init__(self, tool: Splitter) -> None:
        self.tool, self.bytes = tool, 0
        self.words: list[str] = []
        self._by_hash: dict[int, int] = {}
        self._by_word: dict[str, int] = {}

    def add(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words of a slice, and the number of words of each text."""
        self.bytes += len(data)
        points = textscan.CodePoints(data, offsets)
        slow = points.unsafe_texts()
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.tool.special):
            for k in range(len(slow)):
                slow[k] |= any(s.encode() in raw[offsets[k] : offsets[k + 1]] for s in self.tool.special)
        values = points.values
        points.values = np.where(values < len(textscan.LOWER), textscan.LOWER[np.minimum(values, len(textscan.LOWER) - 1)], values).astype(np.uint32)
        first, ends, bounds = textscan.pieces(points, False)
        hashes, at, back = np.unique(textscan.span_hashes(points.values, first, ends), return_index=True, return_inverse=True)
        # words of slow texts are looked up below and must not enter the dictionary here
        text_of = np.repeat(np.arange(len(slow)), np.diff(bounds))
        used = np.zeros(len(hashes), bool)
        used[back[~slow[text_of]]] = True
        places = np.full(len(hashes), -1, np.int64)
        order = np.flatnonzero(used)
        for k in order[np.argsort(at[order], kind="stable")].tolist():
            place = self._by_hash.get(int(hashes[k]))
            if place is None:
                place = self._by_hash[int(hashes[k])] = self._place(points.values[first[at[k]] : ends[at[k]]].tobytes().decode("utf-32-le"))
            places[k] = place
        found, counts = places[back], np.diff(bounds)
        if slow.any():
            parts = np.split(found, bounds[1:-1])
            for k in np.flatnonzero(slow):
                parts[k] = np.array([self._place(w) for w in self.tool.slow_words(raw[offsets[k] : offsets[k + 1]].decode())], np.int64)
            found, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return found, counts

    def _place(self, word: str) -> int:
        place = self._by_word.get(word)
        if place is None:
            place = self._by_word[word] = len(self.words)
            self.words.append(word)
        return place


_TEXTS = "chunk long, ids binary, counts binary, places binary"
_WORDS = "chunk long, place int, word string"


def _split(docs: DataFrame, path: str, chunk_bytes: int, dictionary: bool) -> DataFrame:
    """Rows of the chunks' dictionaries, or else of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, number = splitter(path), TaskContext.get().partitionId() << 24
        chunk = Chunk(tool)
        for batch in batches:
            for part in textscan.slices(batch):
                places, counts = chunk.add(*textscan.utf8(part.column("text")))
                if not dictionary:
                    ids = part.column("id")
                    packed = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in (places.astype("<u4").view(np.uint8).reshape(-1, 4).T,)] if len(places) else [b""]
                    raw_ids = pa.RecordBatch.from_arrays([ids], names=["id"]).serialize().to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([raw_ids]), pa.array([counts.astype("<i8").tobytes()]), pa.array([packed[0]])], names=["chunk", "ids", "counts", "places"])
                if chunk.bytes >= chunk_bytes:
                    if dictionary:
                        yield from _dictionary(chunk, number)
                    chunk, number = Chunk(tool), number + 1
        if dictionary:
            yield from _dictionary(chunk, number)

    return docs.mapInArrow(textscan.thrifty(run), _WORDS if dictionary else _TEXTS)


def _dictionary(chunk: Chunk, number: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(chunk.words), 50_000):
        words = chunk.words[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(words), pa.int64()), pa.array(np.arange(k, k + len(words), dtype=np.int32)), pa.array(words)], names=["chunk", "place", "word"])


def _packed_type(tool) -> str:
    """Ids of a word travel in two bytes each where the vocabulary allows."""
    return "<u2" if max(tool.pieces, default=0) < 1 << 16 else "<u4"


def _encoded(words: DataFrame, path: str) -> DataFrame:
    """chunk, place, ids; equal words stand together, and each is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, last, ids = splitter(path), None, b""
        kind = _packed_type(tool)
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, ids = word, np.array(tool.encode(word), kind).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("place"), pa.array(out, pa.binary())], names=["chunk", "place", "ids"])

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(textscan.thrifty(run), "chunk long, place int, ids binary")


def encode(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids token_ids; one row for each text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    picked = bounded_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    texts = _split(picked, tokenizer_path, chunk_bytes, False)
    ids = _encoded(_split(picked, tokenizer_path, chunk_bytes, True), tokenizer_path)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = {k: v.encode() for k, v in splitter(tokenizer_path).pieces.items()}
        order = np.argsort(right.column("place").to_numpy())
        per_word = right.column("ids").to_pylist()
        per_word = [per_word[k] for k in order.tolist()]
        kind = np.dtype(_packed_type(splitter(tokenizer_path)))
        lengths = np.array([len(x) // kind.itemsize for x in per_word], np.int64)
        flat = np.frombuffer(b"".join(per_word), kind).astype("<u4")
        ends = np.cumsum(lengths)
        decoded = np.array([b" ".join([pieces[i] for i in flat[e - n : e].tolist()]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], object)
        out: dict[str, list] = {"n": [], "ids": [], "decoded": [], "token_ids": []}
        doc_ids = []
        for raw_ids, counts, packed in zip(*(left.column(c).to_pylist() for c in ("ids", "counts", "places")), strict=True):
            counts = np.frombuffer(counts, "<i8")
            total = int(counts.sum())
            places = np.frombuffer(pa.decompress(packed, total * 4, "zstd"), np.uint8).reshape(4, total).T.copy().view("<u4").ravel().astype(np.int64) if total else np.zeros(0, np.int64)
            doc_ids.append(pa.ipc.read_record_batch(pa.py_buffer(raw_ids), pa.schema([("id", id_arrow)])).column(0))
            stop = 0
            for n in counts.tolist():
                own = places[stop : stop + n]
                stop += n
                sizes = lengths[own]
                to = np.repeat(ends[own] - np.cumsum(sizes), sizes) + np.arange(int(sizes.sum()))
                tokens = flat[to]
                out["n"].append(len(tokens))
                out["ids"].append(hashlib.sha256(tokens.tobytes()).hexdigest())
                out["decoded"].append(hashlib.sha256(b" ".join(decoded[own].tolist())).hexdigest())
                if keep_ids:
                    out["token_ids"].append(tokens.astype(np.int32))
        columns = {"doc_id": pa.chunked_array(doc_ids, id_arrow), "n_tokens": pa.array(out["n"], pa.int64()), "ids_sha256": pa.array(out["ids"], pa.string()), "decoded_sha256": pa.array(out["decoded"], pa.string())}
        if keep_ids:
            columns["token_ids"] = pa.array(out["token_ids"], pa.list_(pa.int32()))
        textscan.give_back()
        return pa.table(columns)

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(docs.schema[id_col].dataType)
    fields = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids
    return texts.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(join, fields)


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, decoded for tokens(doc_id, token_ids): ids joined to the table of pieces, pieces joined by blanks."""
    pieces = sorted(splitter(tokenizer_path).pieces.items())
    table = tokens.sparkSession.createDataFrame(pieces, "token_id int, piece string")
    placed = tokens.select("doc_id", F.posexplode("token_ids").alias("at", "token_id"))
    return placed.join(F.broadcast(table), "token_id").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), " ").alias("decoded"))
