"""Bases of parts: alleles put into a reference, reads cut to a part's range.

A reference is a table of chunks(contig, chunk, seq) of CHUNK bases, the last one of a contig shorter, so that no row holds
a contig; chunks are joined only where a text is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 14


def chunked(reference: DataFrame, size: int = CHUNK) -> DataFrame:
    """contig, chunk, seq of whole sequences(contig, seq)."""
    last = F.floor((F.length("seq") - 1) / size)
    numbers = reference.where("length(seq) > 0").select("contig", "seq", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return numbers.select("contig", "chunk", F.substring("seq", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("seq"))


def joined(chunks: DataFrame) -> DataFrame:
    """contig, seq: the chunks of each contig one after another."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "seq")))
    return chunks.groupBy("contig").agg(F.array_join(F.transform(ordered, lambda x: x["seq"]), "").alias("seq"))


def with_margins(chunks: DataFrame, left: int, right: int) -> DataFrame:
    """chunks with seq reaching into the neighbouring chunks, and ahead: how many bases before the chunk it has. Margins
    are no longer than a chunk."""
    order = Window.partitionBy("contig").orderBy("chunk")
    sides = chunks.select("contig", "chunk", F.right("seq", F.lit(left)).alias("tail"), F.substring("seq", 1, right).alias("head"))
    beside = sides.select("contig", "chunk", F.coalesce(F.lag("tail").over(order), F.lit("")).alias("before"), F.coalesce(F.lead("head").over(order), F.lit("")).alias("after"))
    own = chunks.join(beside, ["contig", "chunk"])
    return own.select("contig", "chunk", F.concat("before", "seq", "after").alias("seq"), F.length("before").alias("ahead"))


def swap_in_chunks(chunks: DataFrame, alleles: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunks with the base of alleles(contig, at from 0, base) in its place; null base gives N, of several bases at one
    place the smallest. Places beyond the end are left out."""
    one = alleles.groupBy("contig", "at").agg(F.min(F.coalesce("base", F.lit("N"))).alias("base"))
    by_chunk = one.groupBy("contig", F.floor(F.col("at") / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct((F.col("at") % size).cast("int").alias("at"), "base"))).alias("m"))
    rows = chunks.join(by_chunk, ["contig", "chunk"], "left").withColumn("m", F.filter(F.coalesce("m", F.array().cast("array<struct<at: int, base: string>>")), lambda x: x["at"] < F.length("seq")))
    after = lambda i: F.when(i == 0, 0).otherwise(F.get("m", i - 1)["at"] + 1)
    pieces = F.transform("m", lambda x, i: F.concat(F.substring("seq", after(i) + 1, x["at"] - after(i)), x["base"]))
    tail = F.substring("seq", after(F.size("m")) + 1, F.length("seq"))
    return rows.select("contig", "chunk", F.concat(F.array_join(pieces, ""), tail).alias("seq"))


def swap_alleles(reference: DataFrame, alleles: DataFrame, size: int = CHUNK) -> DataFrame:
    """contig, seq: whole sequences(contig, seq) with alleles(contig, at, base) in their places."""
    return joined(swap_in_chunks(chunked(reference, size), alleles, size))


def trim_offsets(obs: DataFrame, ranges: DataFrame, lengths: DataFrame, margin: int = 25, extend: bool = True) -> DataFrame:
    """contig, part, frag_id, left, right (from 0, inclusive): what of each read lies in its part.

    obs: contig, part, frag_id, site, seq_pos; ranges: contig, part, l_site, r_site; lengths: contig, frag_id, length.
    The left end is at the first covered site at or after l_site, the right one at the last at or before r_site, both
    moved out by `margin` as far as the read goes. With extend, a read that starts (ends) inside the range is whole on
    that side. Reads beyond the range, and those whose left end comes after the right one, are left out.
    """
    rows = obs.drop("l_site", "r_site").join(ranges.select("contig", "part", "l_site", "r_site"), ["contig", "part"])
    ends = rows.groupBy("contig", "part", "frag_id").agg(
        F.min("site").alias("first"), F.max("site").alias("last"), F.first("l_site").alias("l_site"), F.first("r_site").alias("r_site"),
        F.min_by("seq_pos", F.when(F.col("site") >= F.col("l_site"), F.col("site"))).alias("a"), F.max_by("seq_pos", F.when(F.col("site") <= F.col("r_site"), F.col("site"))).alias("z"),
    )
    whole = ends.where("first <= r_site and last >= l_site").join(lengths, ["contig", "frag_id"])
    low, high = F.greatest(F.lit(0), F.col("a") - margin), F.least(F.col("length") - 1, F.col("z") + margin)
    left = F.when(F.lit(extend) & (F.col("first") > F.col("l_site")), 0).otherwise(low)
    right = F.when(F.lit(extend) & (F.col("last") < F.col("r_site")), F.col("length") - 1).otherwise(high)
    return whole.select("contig", "part", "frag_id", left.cast("long").alias("left"), right.cast("long").alias("right")).where("left <= right")


def trimmed(reads: DataFrame) -> DataFrame:
    """reads(seq, left, right and others) with seq, and qual where there is one, cut to left .. right (from 0)."""
    cut = lambda c: F.substring(F.col(c), (F.col("left") + 1).cast("int"), (F.col("right") - F.col("left") + 1).cast("int"))
    return reads.withColumns({c: cut(c) for c in ("seq", "qual") if c in reads.columns})
