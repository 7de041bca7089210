"""Approximate nearest neighbours (operator 8): cross-polytope hashing with multiprobe tables, exact reranking.

Each table turns unit vectors by a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) and hashes them to the nearest signed axis; further rotations, the last over fewer axes, follow
until a table has about rows ** (1 - FILL) buckets. A query looks into the `probes` buckets of each table that
its rotated vector is nearest to. How many those must be depends on the rows: the true neighbours of SAMPLE
queries are found by comparing them with every row, and probes are raised until the buckets hold RECALL of
them. All rows are indexed, and every query is answered; only the queries that probes are chosen by are a
sample.

Queries travel to the buckets, not candidates to the queries: each row is sent once a table, each query once
a probe, and both meet sorted by bucket. There they are compared block by block in double precision, and only
the best k of a bucket go on, with the exact cosine of the original vectors. What is shuffled is therefore
linear in the rows. Buckets with very many rows or queries are cut into a grid of groups of bounded size.

Equal vectors would fill one bucket: rows with the same vector form a class, of which the k + 1 smallest ids
take part (enough for an exact top k with ties to smaller ids).

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part as
query or candidate; vectors of another length than the most common one take no part; with fewer candidates
than k, all come out; for queries that meet fewer than k candidates probes are raised, up to all buckets; rows
with a null id take no part; of rows with one id each counts as a query and as a candidate, and a pair of ids
has its best score; ids of another than an integer type are an error; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.llm.common import materialize, release, whole_id

TABLES = 8
#: The least number of probes.
PROBES = 8
#: Share of true neighbours that the buckets must hold (0.9 is wanted, the rest is for the sample's error), and queries that it is measured by.
RECALL = 0.93
SAMPLE = 400
#: A bucket holds about the number of rows to this power.
FILL = 0.35
#: Rows and queries of a bucket that meet in one group; larger buckets are cut.
MOST_ROWS, MOST_QUERIES = 8192, 1024
_SALTS = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows; their length is a power of two."""
    n, size = x.shape[1], 1
    x = x.copy()
    while size < n:
        y = x.reshape(len(x), n // (2 * size), 2, size)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        size *= 2
    return x / np.sqrt(n)


class Hashes:
    """Rotations of all tables; sizes: axes of each table's hashes, one after another."""

    def __init__(self, width: int, rows: int, tables: int = TABLES, seed: int = 7) -> None:
        self.width = 1 << max(1, (width - 1).bit_length())
        wanted = max(2.0, rows ** (1 - FILL))
        self.axes: list[int] = []
        while wanted > 1:
            axes = int(min(self.width, max(1, round(wanted / 2))))
            self.axes.append(axes)
            wanted /= 2 * axes
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (tables, len(self.axes), 3, self.width))

    def rotated(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        padded = np.zeros((len(x), self.width))
        padded[:, : x.shape[1]] = x
        out = []
        for rounds, axes in zip(self.signs[table], self.axes, strict=True):
            y = padded
            for signs in rounds:
                y = hadamard(y * signs)
            out.append(y[:, :axes])
        return out

    def buckets(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The `probes` best buckets of each row, best first; fewer (repeated) if the table has fewer."""
        score, bucket = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for y, axes in zip(self.rotated(x, table), self.axes, strict=True):
            both = np.concatenate([y, -y], 1)
            top = np.argsort(-both, 1, kind="stable")[:, : min(probes, 2 * axes)]
            loss = both.max(1, keepdims=True) - np.take_along_axis(both, top, 1)
            total = (score[:, :, None] + (loss**2)[:, None, :]).reshape(len(x), -1)
            name = (bucket[:, :, None] * (2 * axes) + top[:, None, :]).reshape(len(x), -1)
            best = np.argsort(total, 1, kind="stable")[:, :probes]
            score, bucket = np.take_along_axis(total, best, 1), np.take_along_axis(name, best, 1)
        return bucket


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """id, raw (the components' bytes) of the rows that take part, and the components' numpy type."""
    narrow = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, dtype = ("float", "<f4") if narrow else ("double", "<f8")
    picked = vectors.select(whole_id(vectors, id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vec"))
    fine = picked.where("id is not null and vec is not null and size(vec) > 0").where("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")
    width = fine.groupBy(F.size("vec").alias("w")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(dtype)
            rows = [r.tobytes() for r in x.reshape(batch.num_rows, -1)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.binary())], names=["id", "raw"])

    return fine.where(F.size("vec") == (width["w"] if width else 0)).mapInArrow(run, "id long, raw binary").distinct(), dtype


def needed_probes(hashes: Hashes, queries: np.ndarray, neighbours: np.ndarray, owner: np.ndarray, least: int) -> tuple[int, float]:
    """Probes, `least` or more, whose buckets hold RECALL of the unit vectors `neighbours` of queries[owner], and their recall."""
    most = int(np.prod([2 * a for a in hashes.axes]))
    probes = least
    while len(owner):
        rank = np.full(len(owner), most)
        for t in range(len(hashes.signs)):
            own = hashes.buckets(neighbours, t, 1)[:, 0]
            step = _step(hashes, probes)
            asked = np.concatenate([hashes.buckets(queries[q : q + step], t, probes) for q in range(0, len(queries), step)])
            for of in np.array_split(np.arange(len(owner)), 1 + len(owner) * probes // 4_000_000):
                found = asked[owner[of]] == own[of][:, None]
                rank[of] = np.where(found.any(1), np.minimum(rank[of], found.argmax(1)), rank[of])
        recall = float((rank < probes).mean())
        if recall >= RECALL:
            enough = max(least, int(np.sort(rank)[int(np.ceil(RECALL * len(rank))) - 1]) + 1)
            return enough, float((rank < enough).mean())
        if probes >= most:
            return probes, recall
        probes = min(2 * probes, most)
    return probes, 1.0


def _measured_probes(members: DataFrame, ask: DataFrame, hashes: Hashes, k: int, least: int, dtype: str) -> int:
    """needed_probes by the k true neighbours of SAMPLE queries, each compared with every row."""
    asked = ask.orderBy(F.xxhash64("query_id"), "query_id", "q").limit(SAMPLE).collect()
    if not asked:
        return least
    queries = _units(_matrix([r["q"] for r in asked], dtype))
    shared = members.sparkSession.sparkContext.broadcast((queries, [r["query_id"] for r in asked]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = shared.value
        # the k best so far of each query: a task sends them once, whatever the number of its batches
        score, ids, raw = np.zeros((len(own), 0)), np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            more_ids = batch.column("id").to_numpy(zero_copy_only=False)
            vectors = np.array(batch.column("raw").to_pylist(), object)
            more = own @ _units(_matrix(vectors.tolist(), dtype)).T
            more[np.array(names)[:, None] == more_ids[None, :]] = -np.inf
            top = np.argsort(-more, 1, kind="stable")[:, :k]
            score, ids, raw = (np.concatenate(x, 1) for x in ((score, np.take_along_axis(more, top, 1)), (ids, more_ids[top]), (raw, vectors[top])))
            best = np.lexsort((ids, -score), 1)[:, :k]
            score, ids, raw = (np.take_along_axis(x, best, 1) for x in (score, ids, raw))
        q, r = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[q, r]), pa.array(score[q, r]), pa.array(raw[q, r].tolist(), pa.binary())], names=["query_id", "vec_id", "score", "raw"])

    near = members.select("id", "raw").mapInArrow(run, "query_id long, vec_id long, score double, raw binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query_id", "raw").collect()
    if not found:
        return least
    return needed_probes(hashes, queries, _units(_matrix([r["raw"] for r in found], dtype)), np.array([r["query_id"] for r in found]), least)[0]


def _step(hashes: Hashes, probes: int) -> int:
    """Rows whose probes are ranked together."""
    return max(1, 1_000_000 // (probes * 2 * min(probes, max(hashes.axes))))


def _posted(vectors: DataFrame, hashes: Hashes, probes: int, dtype: str) -> DataFrame:
    """place (table and bucket), id, raw of vectors(id, raw)."""
    shared = vectors.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        step = min(4096, _step(tool, probes))
        for batch in batches:
            for k, t in itertools.product(range(0, batch.num_rows, step), range(len(tool.signs))):
                part = batch.slice(k, step)
                found = tool.buckets(_units(_matrix(part.column("raw").to_pylist(), dtype)), t, probes)
                owner = pa.array(np.repeat(np.arange(part.num_rows), found.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array((found * len(tool.signs) + t).ravel()), part.column("id").take(owner), part.column("raw").take(owner)], names=["place", "id", "raw"])

    return vectors.select("id", "raw").mapInArrow(run, "place long, id long, raw binary")


def _matrix(raw: list[bytes], dtype: str) -> np.ndarray:
    """Rows in double precision."""
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of a with those of b. Rows are scaled by powers of two first, which is exact, so that no square leaves the
    range of a double."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def best_pairs(ask_ids: np.ndarray, ask: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and cosine of the k nearest rows of each query, and of all that lie as near as the last of them."""
    near = _units(ask) @ _units(rows).T
    near[ask_ids[:, None] == ids[None, :]] = -np.inf
    last = np.partition(near, -k, 1)[:, -k] if near.shape[1] > k else near.min(1)
    q, r = np.nonzero((near >= last[:, None] - 1e-9) & (near > -np.inf))
    return ask_ids[q], ids[r], cosines(ask[q], rows[r])


def _compared(posts: DataFrame, k: int, dtype: str) -> DataFrame:
    """query_id, vec_id, score from posts(place, a, b, kind, id, raw) that stand group by group, queries (kind 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ask_ids, ask = None, np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            place, a, b, kind, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "a", "b", "kind", "id"))
            x = _matrix(batch.column("raw").to_pylist(), dtype)
            first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            out = []
            for start, stop in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
                split = start + int(np.searchsorted(kind[start:stop], 1))
                if key == (place[start], a[start], b[start]):
                    ask_ids, ask = np.append(ask_ids, ids[start:split]), np.concatenate([ask, x[start:split]])
                else:
                    key, ask_ids, ask = (place[start], a[start], b[start]), ids[start:split], x[start:split]
                for k0 in range(split, stop if len(ask_ids) else split, 1024):
                    out.append(best_pairs(ask_ids, ask, ids[k0 : min(k0 + 1024, stop)], x[k0 : min(k0 + 1024, stop)], k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return posts.mapInArrow(run, "query_id long, vec_id long, score double")


def _met(members: DataFrame, ask: DataFrame, hashes: Hashes, probes: int, k: int, dtype: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of the buckets that each query of ask(id, raw) looks into."""
    rows, queries = _posted(members, hashes, 1, dtype), _posted(ask, hashes, probes, dtype)
    counts = [x.groupBy("place").agg(F.count("*").alias(n)).where(F.col(n) > most) for x, n, most in ((rows, "n_rows", MOST_ROWS), (queries, "n_queries", MOST_QUERIES))]
    parts = lambda n, most: F.greatest(F.lit(1), F.ceil(F.coalesce(n, F.lit(0)) / most)).cast("int")
    large = materialize(counts[0].join(counts[1], "place", "full").select("place", parts("n_rows", MOST_ROWS).alias("of_a"), parts("n_queries", MOST_QUERIES).alias("of_b")))
    one = F.lit(1)
    of_a, of_b = F.coalesce("of_a", one), F.coalesce("of_b", one)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    posted = rows.join(large, "place", "left").select("place", own(of_a).alias("a"), every(of_b).alias("b"), F.lit(1).alias("kind"), "id", "raw")
    posted = posted.union(queries.join(large, "place", "left").select("place", every(of_a).alias("a"), own(of_b).alias("b"), F.lit(0).alias("kind"), "id", "raw"))
    found = _compared(posted.repartition("place", "a", "b").sortWithinPartitions("place", "a", "b", "kind"), k, dtype)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, modulus: int = 50, k: int = 5, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by modulus, itself left out; probes is the least number."""
    usable, dtype = _usable(vectors, id_col, vector_col)
    rows = materialize(usable)
    # of each class of equal vectors the k + 1 smallest ids
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS))).withColumn("r", F.row_number().over(Window.partitionBy("raw", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    members = materialize(salted.withColumn("r", F.row_number().over(Window.partitionBy("raw").orderBy("id"))).where(F.col("r") <= k + 1).select("id", "raw"))
    ask = materialize(rows.where(F.col("id") % modulus == 0).select("id", "raw"))
    hashes = Hashes(_width(rows, dtype), members.count(), tables)
    release(rows)
    probes = _measured_probes(members, ask.select(F.col("id").alias("query_id"), F.col("raw").alias("q")), hashes, k, probes, dtype)
    best = materialize(_met(members, ask, hashes, probes, k, dtype))
    most = int(np.prod([2 * a for a in hashes.axes]))
    while probes < most:
        short = ask.select("id").distinct().join(best.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= k).select(F.col("query_id").alias("id")), "id", "left_anti")
        short = materialize(short)
        if short.isEmpty():
            break
        probes = min(8 * probes, most)
        again = _met(members, ask.join(short, "id", "left_semi"), hashes, probes, k, dtype)
        best = materialize(best.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").select(*best.columns).union(again))
    return best


def _width(rows: DataFrame, dtype: str) -> int:
    first = rows.select(F.octet_length("raw").alias("w")).first()
    return first["w"] // np.dtype(dtype).itemsize if first else 1
