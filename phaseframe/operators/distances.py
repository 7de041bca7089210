"""Distances between reads, reads and haplotypes, and haplotypes: equi-joins on sites, and blocks of reads that meet others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from phaseframe.operators.intervals import overlap_join
from phaseframe.operators.pileup import consensus
from phaseframe.operators.ranks import ranked
from phaseframe.plans.storage import dealt, kept, spread


def haplotype_distance(piled: DataFrame, scope: list[str], group: str) -> DataFrame:
    """same and diff of the consensus alleles of each two groups of a scope, over common sites."""
    best = consensus(piled, *scope, group).select(*scope, group, "site", "allele")
    other = best.select(*scope, F.col(group).alias("other"), "site", F.col("allele").alias("b"))
    return best.join(other, [*scope, "site"]).where(F.col(group) < F.col("other")).groupBy(*scope, group, "other").agg(F.count_if(F.col("allele") == F.col("b")).alias("same"), F.count_if(F.col("allele") != F.col("b")).alias("diff"))


def _tops(piled: DataFrame, scope: list[str], group: str) -> DataFrame:
    """scope, group, site, best (alleles that tie with the heaviest), nil (the heaviest weighs nothing, nor does any other)."""
    sites = piled.groupBy(*scope, group, "site").agg(F.max("weight").alias("top"), F.collect_list(F.struct("allele", "weight")).alias("w"))
    heaviest = F.transform(F.filter("w", lambda x: F.round(x["weight"], 9) == F.round("top", 9)), lambda x: x["allele"])
    return sites.select(*scope, group, "site", heaviest.alias("best"), (F.round("top", 9) == 0).alias("nil"))


#: Whether a read's allele weighs as much as the heaviest one of a row of _tops.
_BEST = "(coalesce(array_contains(best, allele), false) or nil)"


def read_haplotype_distance(obs: DataFrame, piled: DataFrame, scope: list[str], group: str) -> DataFrame:
    """same and diff (whole numbers, rounded) of each read against each group's pileup, over covered sites; alleles that
    tie with the heaviest count for neither.

    obs is counted first, so the caller keeps it; it meets the pileups by sites, and what comes of that is summed up by reads,
    in partitions of a number of rows that does not grow.
    """
    n = obs.count()
    rows = dealt(obs.select(*scope, "frag_id", "site", "allele", "weight"), n, *scope, "site").join(_tops(piled, scope, group), [*scope, "site"])
    same = F.when(F.expr(f"{_BEST} and size(best) = 1"), F.col("weight")).otherwise(0.0)
    diff = F.when(F.expr(f"not {_BEST}"), F.col("weight")).otherwise(0.0)
    whole = lambda x: F.round(F.round(F.sum(x), 6)).cast("long")
    found = dealt(rows.select(*scope, "frag_id", group, same.alias("s"), diff.alias("d")), n, *scope, "frag_id")
    return found.groupBy(*scope, "frag_id", group).agg(whole("s").alias("same"), whole("d").alias("diff"))


def all_pairs(obs: DataFrame, piled: DataFrame, scope: list[str], group: str) -> DataFrame:
    """scope, frag_id, group: each read with each group of its scope; where only some pairs are of interest, give those."""
    return obs.select(*scope, "frag_id").distinct().join(piled.select(*scope, group).distinct(), scope)


def read_haplotype_distance_eps(obs: DataFrame, piled: DataFrame, pairs: DataFrame, scope: list[str], group: str, epsilon: float) -> DataFrame:
    """The same for pairs(scope, frag_id, group) alone, where uncovered sites cost epsilon and ties with the heaviest
    allele count as same. Rows are the sites of the pairs' reads, however many groups a scope has."""
    reads = kept(obs.select(*scope, "frag_id", "site", "allele", "weight").join(pairs.select(*scope, "frag_id", group), [*scope, "frag_id"]))
    n = reads.count()
    rows = dealt(reads, n, *scope, group, "site").join(_tops(piled, scope, group), [*scope, group, "site"], "left")
    same = F.when(F.expr(f"nil is not null and {_BEST}"), F.col("weight")).otherwise(0.0)
    diff = F.when(F.col("nil").isNull(), F.lit(epsilon)).when(F.expr(f"not {_BEST}"), F.col("weight")).otherwise(0.0)
    found = dealt(rows.select(*scope, "frag_id", group, same.alias("same"), diff.alias("diff")), n, *scope, "frag_id")
    return found.groupBy(*scope, "frag_id", group).agg(F.sum("same").alias("same"), F.sum("diff").alias("diff"))


#: Sites of a bin in which reads meet blocks.
WIDTH = 64
#: Sums that are taken at once.
SUMS = 1 << 16


def packed(obs: DataFrame) -> DataFrame:
    """obs with a row for each read: sites, alleles and weights as arrays in the order of sites."""
    own = F.array_sort(F.collect_list(F.struct("site", "allele", "weight"))).alias("o")
    keys = [c for c in obs.columns if c not in ("site", "allele", "weight")]
    return obs.groupBy(*keys).agg(own).select(*keys, F.col("o.site").alias("sites"), F.col("o.allele").alias("alleles"), F.col("o.weight").alias("weights"))


def _spans(obs: DataFrame, scope: list[str]) -> DataFrame:
    rows = packed(obs.where("weight is not null and site is not null and frag_id is not null").select(*scope, "frag_id", "site", "allele", "weight"))
    return rows.withColumn("first_site", F.get("sites", F.lit(0))).withColumn("last_site", F.element_at("sites", -1))


def _blocks(obs: DataFrame, scope: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """Packed reads with their place along the contig and block (own) of `size` reads, and scope, block, l_site, r_site."""
    reads = ranked(_spans(obs, scope), scope, [F.asc("first_site"), F.asc("frag_id")], "at").withColumn("own", F.floor(F.col("at") / size))
    return reads, F.broadcast(reads.groupBy(*scope, F.col("own").alias("block")).agg(F.min("first_site").alias("l_site"), F.max("last_site").alias("r_site")))


class _Flat:
    """Packed reads of an Arrow table as flat arrays."""

    def __init__(self, rows: pa.Table) -> None:
        sites, alleles, weights = (rows[c].combine_chunks() for c in ("sites", "alleles", "weights"))
        self.sizes = pc.list_value_length(sites).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.read = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.site, self.allele, self.weight = (x.flatten().to_numpy(zero_copy_only=False) for x in (sites, alleles, weights))


class _Meeting:
    """Sums over the common sites of some reads (a) with others (b), which come in pieces.

    A weight counts by the products it gives with those of b: weights that give the same ones are one class. For a piece of
    b there is a row for each site, allele and class that a has, with what each read of b adds to a read that has it: the
    number of sites, the product, and the product again where alleles agree, side by side in one number.
    """

    def __init__(self, a: _Flat, b: _Flat) -> None:
        self.a, self.b = a, b
        known, mine = np.unique(a.weight, return_inverse=True)
        self.others, self.weight_b = np.unique(b.weight, return_inverse=True)
        product = known[:, None] * self.others
        product = (np.floor(product) + (product - np.floor(product) >= 0.5)).astype(np.int64)
        self.classes, kind = np.unique(product, axis=0, return_inverse=True)
        self.bits = int(max(1, product.max()) * min(a.sizes.max(), b.sizes.max())).bit_length()
        self.type = np.int16 if 3 * self.bits <= 15 else np.int32 if 3 * self.bits <= 31 else np.int64
        self.names, site = np.unique(a.site, return_inverse=True)
        self.letters = np.unique(np.concatenate([a.allele, b.allele]))
        self.letter_b = np.searchsorted(self.letters, b.allele)
        code = (site * len(self.letters) + np.searchsorted(self.letters, a.allele)) * len(self.classes) + kind.ravel()[mine]
        used, self.row = np.unique(code, return_inverse=True)
        self.class_of, rest = used % len(self.classes), used // len(self.classes)
        self.letter_of, site_of = rest % len(self.letters), rest // len(self.letters)
        self.low, self.high = (np.searchsorted(site_of, np.arange(len(self.names)), x) for x in ("left", "right"))
        at = np.searchsorted(self.names, b.site)
        self.site_b = np.where(self.names[np.minimum(at, len(self.names) - 1)] == b.site, at, -1)

    def table(self, first: int, last: int) -> np.ndarray:
        """What b's reads from first on, up to last, add to a read for each row of a."""
        own = np.arange(self.b.begins[first], self.b.ends[last - 1])
        own = own[self.site_b[own] >= 0]
        low, n = self.low[self.site_b[own]], self.high[self.site_b[own]] - self.low[self.site_b[own]]
        entry = np.repeat(own, n)
        row = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        value = self.classes[self.class_of[row], self.weight_b[entry]]
        table = np.zeros((len(self.class_of), last - first), self.type)
        table[row, self.b.read[entry] - first] = (1 << 2 * self.bits) + (value << self.bits) + np.where(self.letter_of[row] == self.letter_b[entry], value, 0)
        return table

    def parts(self, table: np.ndarray, reads: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some of these reads of a and their sums, a column for each of the table's; reads of one length are summed up at once,
        as many as need up to 1 MB and give up to 65,536 sums."""
        reads = reads[np.argsort(self.a.sizes[reads], kind="stable")]
        lengths, starts = np.unique(self.a.sizes[reads], return_index=True)
        bounds = [*starts.tolist(), len(reads)]
        for length, low, high in zip(lengths.tolist(), bounds[:-1], bounds[1:], strict=True):
            step = max(1, min(SUMS // table.shape[1], (1 << 20) // (length * table.shape[1] * table.itemsize)))
            for k in range(low, high, step):
                some = reads[k : min(k + step, high)]
                rows = self.row[self.a.begins[some][:, None] + np.arange(length)]
                yield some, np.add.reduce(table.take(rows, axis=0), axis=1, dtype=self.type)

    def sums(self, first: int, last: int) -> np.ndarray:
        """A row for each read of a, a column for each of b's from first on, up to last."""
        out = np.empty((len(self.a.sizes), last - first), self.type)
        for reads, sums in self.parts(self.table(first, last), np.arange(len(self.a.sizes))):
            out[reads] = sums
        return out

    def pieces(self, most: int) -> list[tuple[int, int]]:
        """Ranges of b's reads with tables of up to 64 MB."""
        step = max(1, min(most, (1 << 26) // (len(self.class_of) * np.dtype(self.type).itemsize)))
        return [(k, min(k + step, len(self.b.sizes))) for k in range(0, len(self.b.sizes), step)]

    def split(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """same and diff."""
        mask = (1 << self.bits) - 1
        same = sums & mask
        return same.astype(np.int64), (((sums >> self.bits) & mask) - same).astype(np.int64)


def read_read_distance(obs: DataFrame, scope: list[str], size: int = 8192, weighing: bool = False) -> DataFrame:
    """same and diff of each two reads with a common site; a site's product of weights is rounded. With `weighing`, only of
    those where one of the two is not 0.

    Reads lie in blocks of `size` along a contig. A task gets those reads of two blocks that reach into the other one's sites (or
    one block) and gives their pairs in batches; nothing of a pair is shuffled. No column is nullable, which rows of pairs are
    read faster for.
    """
    reads, blocks = _blocks(obs, scope, size)
    blocks = kept(blocks)
    met = overlap_join(reads, F.broadcast(blocks), ("first_site", "last_site"), ("l_site", "r_site"), scope, WIDTH)
    met = met.select(*scope, F.least("block", "own").alias("low"), F.greatest("block", "own").alias("high"), "own", "at", "frag_id", "sites", "alleles", "weights")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("at")
        mine, others = (rows.filter(pc.equal(rows["own"], rows[c])) for c in ("low", "high"))
        if not len(mine) or not len(others):
            return
        a, b = _Flat(mine), _Flat(others)
        meeting = _Meeting(a, b)
        at, all_at, ids, all_ids = (t[c].to_numpy() for c in ("at", "frag_id") for t in (mine, others))
        mask = (1 << meeting.bits) - 1
        kind = mine["frag_id"].type
        fixed = [pa.repeat(rows[c][0], SUMS) for c in scope]
        for first, last in meeting.pieces(1024):
            over = (a.site[a.begins] <= b.site[b.ends[first:last] - 1].max()) & (a.site[a.ends - 1] >= b.site[b.begins[first]]) & (at < all_at[last - 1])
            if not over.any():
                continue
            names = np.tile(all_ids[first:last], min(len(at), SUMS // (last - first)))
            for some, sums in meeting.parts(meeting.table(first, last), np.flatnonzero(over)):
                there = (sums & mask << meeting.bits if weighing else sums) != 0
                if at[some].max() >= all_at[first]:
                    there &= all_at[None, first:last] > at[some][:, None]
                pairs = np.flatnonzero(there)
                one, two = np.repeat(ids[some], np.count_nonzero(there, axis=1)), names.take(pairs)
                same, diff = meeting.split(sums.ravel().take(pairs))
                columns = [*(x.slice(0, len(pairs)) for x in fixed), pa.array(np.minimum(one, two), kind), pa.array(np.maximum(one, two), kind), pa.array(same), pa.array(diff)]
                yield pa.RecordBatch.from_arrays(columns, [*scope, "frag_id", "other", "same", "diff"])

    own = obs.schema["frag_id"].dataType
    types = {**{c: obs.schema[c].dataType for c in scope}, "frag_id": own, "other": own, "same": LongType(), "diff": LongType()}
    schema = StructType([StructField(c, t, False) for c, t in types.items()])
    cells = max(4 * blocks.count(), int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.repartition(cells, *scope, "low", "high").groupBy(*scope, "low", "high").applyInArrow(solve, schema)


def hybrid_correct(long_reads: DataFrame, short_reads: DataFrame, size: int = 2048) -> DataFrame:
    """Observations of long reads, corrected by short ones: contig, frag_id, site, allele.

    For each site of a long read, the short read over it that agrees best with the whole long read (10 * same over
    diff + 1, in whole numbers; the smallest id on ties) is chosen. Where all chosen reads that cover a site have one
    allele there, the long read gets it; elsewhere it keeps its own. Long reads lie in blocks of `size` along a contig;
    a block meets the short reads over it piece by piece and holds, of the reads chosen so far, the alleles at its own sites.
    """
    known = lambda obs: obs.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    reads, blocks = _blocks(known(long_reads), ["contig"], size)
    short = overlap_join(_spans(known(short_reads), ["contig"]), blocks, ("first_site", "last_site"), ("l_site", "r_site"), ["contig"], WIDTH)
    columns = ["contig", "block", "frag_id", "sites", "alleles", "weights"]
    rows = reads.withColumnRenamed("own", "block").select(*columns, F.lit(True).alias("long")).unionByName(short.select(*columns, F.lit(False).alias("long")))
    kinds = {c: long_reads.schema[c].dataType.simpleString() for c in ("contig", "frag_id", "site", "allele")}
    none = np.iinfo(np.int64).min

    def solve(group: pa.Table) -> pa.Table:
        mine = group.filter(group["long"])
        others = group.filter(pc.invert(group["long"])).sort_by("frag_id")
        a = _Flat(mine)
        score = np.full(len(a.site), -1)
        seen = [np.full((n, n), none) for n in a.sizes.tolist()]  # alleles of the read chosen for a site at all sites
        if len(others):
            b = _Flat(others)
            meeting = _Meeting(a, b)
            column = np.searchsorted(meeting.names, a.site)
            for first, last in meeting.pieces(2048):
                same, diff = meeting.split(meeting.sums(first, last))
                n = last - first
                key = (same * 10 // (diff + 1)) * n + np.arange(n - 1, -1, -1)  # of the same score the smallest id
                own = np.arange(b.begins[first], b.ends[last - 1])
                own = own[meeting.site_b[own] >= 0]
                own = own[np.argsort(meeting.site_b[own], kind="stable")]
                low, high = (np.searchsorted(meeting.site_b[own], np.arange(len(meeting.names)), x).tolist() for x in ("left", "right"))
                over = b.read[own] - first
                letters = np.full((n, len(meeting.names)), none)
                letters[over, meeting.site_b[own]] = b.allele[own]
                for k, (x, y) in enumerate(zip(a.begins.tolist(), a.ends.tolist(), strict=True)):
                    at = column[x:y]
                    there = [(i, low[c], high[c]) for i, c in enumerate(at.tolist()) if high[c] > low[c]]
                    if not there:
                        continue
                    starts = np.cumsum([0] + [q - p for _, p, q in there[:-1]])
                    top = np.maximum.reduceat(key[k, np.concatenate([over[p:q] for _, p, q in there])], starts)
                    place = np.array([i for i, _, _ in there])
                    best, which = top // n, n - 1 - top % n
                    # pieces come in the order of ids, so a later one must be better
                    better = best > score[x + place]
                    place, which = place[better], which[better]
                    score[x + place] = best[better]
                    seen[k][place] = letters[which[:, None], at[None, :]]
        allele = a.allele.copy()
        for x, y, known in zip(a.begins.tolist(), a.ends.tolist(), seen, strict=True):
            least = np.where(known == none, np.iinfo(np.int64).max, known).min(axis=0)
            agreed = (known.max(axis=0) == least) & (least < np.iinfo(np.int64).max)
            allele[x:y] = np.where(agreed, least, allele[x:y])
        own = [pa.repeat(group["contig"][0], len(a.site)), mine["frag_id"].combine_chunks().take(pa.array(a.read)), pa.array(a.site), pa.array(allele)]
        return pa.table(own, names=["contig", "frag_id", "site", "allele"])

    return spread(rows, "contig", "block").groupBy("contig", "block").applyInArrow(solve, ", ".join(f"{c} {k}" for c, k in kinds.items()))
