"""MinHash near-duplicates (operator 6): signature-coordinate inverted join with exact confirmation.

1. Each text gets its set of distinct word shingles (64-bit hashes), a digest of that set, and a signature:
   the smallest value of the set under each of K hash functions. Texts with equal sets form a class, a node of
   what follows; classes that one id has are tied to each other.
2. Inverted join: representatives are posted under (coordinate, value) pairs. Two signatures with T or more
   equal coordinates share one among their first K - T + 1 pairs in any common order, so only those are
   posted, rarest first; how frequent a pair is comes from a counter table of fixed size over all
   representatives. (Rare first keeps passages that very many texts share out of the postings.)
3. Counting collisions: for pairs that meet in a posting list, the two signatures are merged coordinate by
   coordinate; a pair with sizes too different is skipped, one with fewer than T collisions dropped.
4. Survivors are confirmed on the full sets, in whole numbers: |A and B| >= similarity * |A or B|, where similarity
   is the decimal fraction that it is written as.

No posting list is expanded into all its pairs: first each list is tied to a few of its members (stars) and
the confirmed links are joined into components; then only pairs that stand in different components are
looked at. In lists where many such pairs are left, shingles that only one member has bound how similar it
can be to any other; pairs under the bound are skipped, which loses nothing.

T follows from the similarity: the most collisions that a pair just similar enough has with probability 1 - MISS
(33 of K = 64 at 0.8, 14 at 0.5). Similarities so small that T would be 0 are an error.

Defined results: a text that is null or has no words has an empty set and is linked with nothing; one with
fewer words than a shingle has its whole word sequence as its only shingle; rows with a null id stand alone
(component null, kept); rows that share an id are one document, linked by any of its texts; equal sets are
linked; an empty table gives an empty result; columns of the input other than the two named play no part; ids of
another than an integer type are an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm import textscan
from phaseframe.llm.common import bounded_batches, files_for, materialize, release, whole_id
from phaseframe.llm.components import components

K = 64
#: Probability at most that the signatures of a linked pair have too few collisions.
MISS = 1e-7
#: Counters of the table of pair frequencies; it is sent to every task.
COUNTERS = 1 << 17
#: Members beyond which a posting list's pairs are screened by their shingles before they are made.
LARGE = 64
#: Parts of the hash range in which shared shingles are counted for that.
PARTS = 32

_SEEDS = textscan.mix(np.arange(1, 2 * K + 1, dtype=np.uint64))
_ADD, _TIMES = _SEEDS[:K, None], _SEEDS[K:, None] | np.uint64(1)


def threshold_for(similarity: float, miss: float = MISS) -> int:
    """The largest T for which a pair of this similarity has fewer than T of K equal coordinates with probability miss at most."""
    below, t = 0.0, 0
    while t < K:
        below += math.comb(K, t) * similarity**t * (1 - similarity) ** (K - t)
        if below > miss:
            break
        t += 1
    if t < 1:
        raise ValueError(f"signatures of {K} values can't find pairs of similarity {similarity}")
    return t


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    words = textscan.Words(textscan.lower_ascii(data), offsets)
    hashes = words.hashes()
    runs = textscan.run_hashes(hashes, size)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            out.append(textscan.run_hashes(hashes[a:b], n) if n else hashes[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """K smallest values, one for each hash function."""
    best = np.full(K, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(shingles), 4096):
        best = np.minimum(best, ((((shingles[None, k : k + 4096] ^ _ADD) * _TIMES) >> np.uint64(32)).min(axis=1)))
    return best.astype(np.uint32)


def _scan(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch):
                sets = shingle_sets(*textscan.utf8(part.column("text")), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([_digest(x) for x in sets], pa.binary()),
                        pa.array([signature(x).tobytes() if len(x) else None for x in sets], pa.binary()),
                    ],
                    names=["id", "n", "digest", "sig"],
                )

    return docs.mapInArrow(textscan.thrifty(run), "id long, n long, digest binary, sig binary")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """id, members for texts(id, digest, text): the shingles of a node's text. (Of an id's texts one has the digest.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch):
                sets = shingle_sets(*textscan.utf8(part.column("text")), size)
                mine = np.array([_digest(x) == d for x, d in zip(sets, part.column("digest").to_pylist(), strict=True)], bool)
                yield pa.RecordBatch.from_arrays([part.column("id").filter(pa.array(mine)), pa.array([x.tobytes() for x, own in zip(sets, mine, strict=True) if own], pa.binary())], names=["id", "members"])

    return texts.mapInArrow(textscan.thrifty(run), "id long, members binary")


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _elements(sigs: list[bytes]) -> np.ndarray:
    """A 64-bit name of every (coordinate, value) pair, row by row."""
    values = np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), K).astype(np.uint64)
    return textscan.mix(values + (np.arange(1, K + 1, dtype=np.uint64) << np.uint64(32)))


def _frequencies(reps: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount((_elements(batch["sig"].tolist()) % np.uint64(COUNTERS)).ravel().astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    rows = reps.select("sig").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(COUNTERS, np.int64)
    table[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return np.minimum(table, (1 << 31) - 1).astype(np.int32)


def _postings(reps: DataFrame, frequencies: np.ndarray, threshold: int) -> DataFrame:
    """id, key for the first pairs of each signature, rarest first."""
    table = reps.sparkSession.sparkContext.broadcast(frequencies)
    most = K - threshold + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value.astype(np.uint64)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                names = _elements(part.column("sig").to_pylist())
                order = np.argsort((known[(names % np.uint64(COUNTERS)).astype(np.int64)] << np.uint64(32)) | (names >> np.uint64(32)), axis=1, kind="stable")[:, :most]
                keys = np.take_along_axis(names, order, 1).astype(np.int64)
                ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), most)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], names=["id", "key"])

    return reps.select("id", "sig").mapInArrow(textscan.thrifty(run), "id long, key long")


def _alike(pairs: DataFrame, sigs: DataFrame, threshold: int, share: Fraction) -> DataFrame:
    """Of pairs(a, b), those with enough equal coordinates and sizes that are close enough."""

    @F.pandas_udf("boolean")
    def enough(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        p, q = (np.frombuffer(b"".join(s), np.uint32).reshape(-1, K) for s in (x, y))
        return pd.Series((p == q).sum(axis=1) >= threshold)

    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("x"), F.col("n").alias("n_a"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("y"), F.col("n").alias("n_b"))
    close = f"{share.denominator} * least(n_a, n_b) >= {share.numerator} * greatest(n_a, n_b)"
    return pairs.join(left, "a").join(right, "b").where(close).where(enough("x", "y")).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), bool)
        for k, (p, q) in enumerate(zip(x, y, strict=True)):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out[k] = share.denominator * both >= share.numerator * (len(p) + len(q) - both)
        return pd.Series(out)

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(linked("x", "y")).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _stars(shared: DataFrame) -> DataFrame:
    """Pairs of each list's members with three of its members."""
    centre = shared.groupBy("key").agg(F.min("id").alias("c1"), F.max("id").alias("c2"), F.min_by("id", F.xxhash64("id")).alias("c3"))
    tied = shared.join(centre, "key").select("id", F.explode(F.array_distinct(F.array("c1", "c2", "c3"))).alias("c"))
    return tied.where("id <> c").select(*_ordered("id", "c")).distinct()


def _screened(sets: DataFrame) -> DataFrame:
    """id, n, met, parts for sets(id, members): how many shingles a set has, how many of them another set has too,
    and how many of the latter fall into each of PARTS parts of the hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                members = [np.frombuffer(x, np.int64) for x in part.column("members").to_pylist()]
                ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), [len(x) for x in members])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(members))], names=["id", "shingle"])

    spread = sets.mapInArrow(textscan.thrifty(run), "id long, shingle long")
    known = spread.groupBy("shingle").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    # shingles of one set alone are subtracted part by part
    every = spread.groupBy("id", F.pmod("shingle", F.lit(PARTS)).alias("part")).agg(F.count("*").alias("n"))
    alone = known.where("c = 1").groupBy("id", F.pmod("shingle", F.lit(PARTS)).alias("part")).agg(F.count("*").alias("own"))
    met = every.join(alone, ["id", "part"], "left").select("id", "n", F.col("part").cast("int"), (F.col("n") - F.coalesce("own", F.lit(0))).cast("int").alias("met"))
    by_part = F.map_from_entries(F.collect_list(F.struct("part", "met")))
    table = met.groupBy("id").agg(F.sum("n").alias("n"), F.sum("met").alias("met"), by_part.alias("m"))
    return table.select("id", "n", "met", F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0))).alias("parts"))


def _across(shared: DataFrame, labels: DataFrame, screened: DataFrame, share: Fraction, files: int) -> DataFrame:
    """All pairs of a list that stand in different components and could be similar enough."""
    placed = shared.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "key", "large", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    placed = materialize(placed.join(mixed, "key"), files)
    small = placed.where("not large")
    x = small.select("key", "id", F.col("component").alias("c"))
    y = small.select("key", F.col("id").alias("other"), F.col("component").alias("d"))
    pairs = x.join(y, "key").where("c < d").select(*_ordered("id", "other"))
    n, of = share.numerator, share.denominator
    # |A and B| <= the shingles that both share with anyone, part by part
    rows = placed.where("large").join(screened.where(f"{of} * met >= {n} * n"), "id")
    x = rows.select("key", "id", F.col("component").alias("c"), F.col("n").alias("n_x"), F.col("met").alias("m_x"), F.col("parts").alias("p_x"))
    y = rows.select("key", F.col("id").alias("other"), F.col("component").alias("d"), F.col("n").alias("n_y"), F.col("met").alias("m_y"), F.col("parts").alias("p_y"))
    bound = f"{of + n} * least(m_x, m_y) >= {n} * (n_x + n_y)"
    finer = f"{of + n} * aggregate(zip_with(p_x, p_y, (u, v) -> least(u, v)), 0, (s, u) -> s + u) >= {n} * (n_x + n_y)"
    return pairs.union(x.join(y, "key").where(f"c < d and {bound} and {finer}").select(*_ordered("id", "other"))).distinct()


def _nodes(known: DataFrame) -> DataFrame:
    """digest, first (its smallest id), node: a number of each class of equal sets, its first id unless that heads several."""
    classes = known.groupBy("digest").agg(F.min("id").alias("first"))
    several = classes.groupBy("first").agg(F.count("*").alias("c")).where("c > 1").select("first")
    return classes.join(several.withColumn("several", F.lit(True)), "first", "left").select("digest", "first", F.when(F.col("several"), F.xxhash64("first", "digest")).otherwise(F.col("first")).alias("node"))


def _same_id(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v: nodes of one id, tied to one of them."""
    several = known.groupBy("id").agg(F.min("digest").alias("one"), F.max("digest").alias("two")).where("one <> two").select("id", "one")
    rows = known.select("id", "digest").join(several, "id").distinct().join(nodes.select("digest", F.col("node").alias("v")), "digest")
    return rows.join(nodes.select(F.col("digest").alias("one"), F.col("node").alias("u")), "one").where("u <> v").select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs."""
    share, threshold = Fraction(str(similarity)), threshold_for(similarity)
    picked = bounded_batches(docs).select(whole_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    scanned = materialize(_scan(picked, shingle))
    files = files_for(docs, scanned.count())
    known = scanned.where("digest is not null and id is not null")
    nodes = materialize(_nodes(known), files)
    single = known.join(nodes.select(F.col("first").alias("id"), "digest", "node"), ["id", "digest"]).dropDuplicates(["id", "digest"])
    reps = materialize(single.select(F.col("node").alias("id"), "n", "sig"), files)
    ties = materialize(_same_id(known, nodes), files)
    repeated = not known.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()

    def sets_of(wanted: DataFrame) -> DataFrame:
        """id, members of these nodes."""
        where = nodes.select(F.col("node").alias("id"), F.col("first").alias("doc"), "digest").join(wanted, "id", "left_semi")
        texts = picked.withColumnRenamed("id", "doc").join(where, "doc").groupBy("doc", "digest", "id", F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"))
        found = _sets(texts.select("id", "digest", "text"), shingle)
        return found.groupBy("id").agg(F.first("members").alias("members")) if repeated else found

    postings = materialize(_postings(reps, _frequencies(reps), threshold), files)
    lists = postings.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", (F.col("c") > LARGE).alias("large"))
    shared = materialize(postings.join(lists, "key").select("key", "id", "large"), files)
    release(postings)
    stars = materialize(_alike(_stars(shared), reps, threshold, share), files)
    in_large = shared.where("large").select("id").distinct()
    needed = stars.select(F.explode(F.array("a", "b")).alias("id")).union(in_large).distinct()
    sets = materialize(sets_of(needed), files)
    links = materialize(_confirmed(stars, sets, share).union(ties), files)
    first = components(links, files)
    screened = materialize(_screened(sets.join(in_large, "id", "left_semi")), files)
    release(sets)
    rest = materialize(_alike(_across(shared, first, screened, share, files), reps, threshold, share).join(stars, ["a", "b"], "left_anti"), files)
    release(shared, screened, stars, reps)
    more_ids = rest.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    more_sets = materialize(sets_of(more_ids), files)
    more = materialize(_confirmed(rest, more_sets, share), files)
    release(more_sets)
    label = first if more.isEmpty() else components(links.union(more), files)
    linked = nodes.join(label, "node").select("digest", "first", "component")
    smallest = linked.groupBy("component").agg(F.min("first").alias("smallest"))
    named = nodes.select("digest", "first").join(linked.join(smallest, "component").select("digest", "smallest"), "digest", "left")
    named = materialize(named.select("digest", F.coalesce("smallest", "first").alias("smallest")), files)
    release(links, rest, more, ties, nodes)
    out = scanned.join(named, "digest", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """docs without near-duplicates: of each group the document with the smallest id stays, with its own columns.

    Rows with a null id stay; of rows that share an id all stay or go together.
    """
    gone = near_duplicates(docs, shingle, similarity, id_col=id_col).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
