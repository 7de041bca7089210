"""Phasing end to end: blocks, clusters, graph, flows, paths, reads, parts. Every step is keyed by contig."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.operators.distances import hybrid_correct, packed, read_haplotype_distance_eps
from phaseframe.operators.filters import filter_span
from phaseframe.operators.intervals import overlap_join
from phaseframe.operators.parts import block_edges, numbered, part_ranges
from phaseframe.operators.pileup import pileup
from phaseframe.operators.ranks import ranked
from phaseframe.operators.sequences import CHUNK, with_margins
from phaseframe.operators.windows import block_windows, fragment_order, merge_segments, split_gaps, split_gaps_within
from phaseframe.plans import kernels
from phaseframe.plans.storage import kept, spread
from phaseframe.sources.bindings import frags_of, sites_of


def _reads(group: pd.DataFrame) -> list[tuple[int, kernels.Read]]:
    """(fragment, observations) of packed reads in fragment order."""
    rows = group.sort_values("rank")
    return [(f, list(zip(s.tolist(), a.tolist(), w.tolist(), strict=True))) for f, s, a, w in zip(rows["frag_id"], rows["sites"], rows["alleles"], rows["weights"], strict=True)]


def reads_in_blocks(frags: DataFrame, blocks: DataFrame, width: int = 64) -> DataFrame:
    """Reads with the blocks that they touch; those that span too many sites (over the origin of a circle) are left out."""
    return overlap_join(filter_span(frags), blocks, ("first_site", "last_site"), ("l_site", "r_site"), ["contig"], width)


def searched_blocks(obs: DataFrame, length: int, epsilon: float, most: int = 5, beam: int = 10, sensitivity: int = 2, density: float = 0.0005, heuristic: bool = True, sites: DataFrame | None = None) -> DataFrame:
    """contig, block_id, cluster, frag_id, l_site, r_site, first_site, last_site, cuts: each block's reads in as many clusters
    as their errors call for, and the sites at which the search lost two or more of them.

    Blocks are windows over sites(contig, site, pos), by default those of obs. A read takes part in a block with all of its
    sites, also those beyond the block.
    """
    blocks = block_windows(sites if sites is not None else sites_of(obs), length, density)
    placed = reads_in_blocks(fragment_order(frags_of(obs)), blocks).select("contig", "block_id", "l_site", "r_site", "frag_id", "rank")
    rows = placed.join(packed(obs.select("contig", "frag_id", "site", "allele", "weight")), ["contig", "frag_id"])
    kind = obs.schema["contig"].dataType.simpleString()

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank").combine_chunks()
        flat = {k: group[k].combine_chunks() for k in ("sites", "alleles", "weights")}
        sizes = pc.list_value_length(flat["sites"]).to_numpy(zero_copy_only=False)
        sites, alleles, weights = (flat[k].flatten().to_numpy(zero_copy_only=False) for k in flat)
        clusters, cuts = kernels.phase_block(kernels.Grid(sizes, sites, alleles, weights), epsilon, most, beam, sensitivity, heuristic)
        names, ends = np.unique(clusters, return_inverse=True)[1], np.cumsum(sizes)
        own = [group[k] for k in ("contig", "block_id")] + [pa.array(names, pa.int32())] + [group[k] for k in ("frag_id", "l_site", "r_site")]
        own += [pa.array(sites[at], pa.int32()) for at in (ends - sizes, ends - 1)] + [pa.array([cuts] * len(sizes), pa.list_(pa.int32()))]
        return pa.table(own, names=["contig", "block_id", "cluster", "frag_id", "l_site", "r_site", "first_site", "last_site", "cuts"])

    return spread(rows, "contig", "block_id").groupBy("contig", "block_id").applyInArrow(solve, f"contig {kind}, block_id int, cluster int, frag_id long, l_site int, r_site int, first_site int, last_site int, cuts array<int>")


def phase_blocks(obs: DataFrame, length: int, epsilon: float, **options) -> DataFrame:
    """contig, block_id, cluster, frag_id, l_site, r_site of searched_blocks, which has the options."""
    return searched_blocks(obs, length, epsilon, **options).drop("first_site", "last_site", "cuts")


def cut_blocks(membership: DataFrame) -> DataFrame:
    """contig, block_id, cluster, frag_id, l_site, r_site: a block for each segment between the cuts of a block.

    membership: what searched_blocks gives; cuts, in ascending order, are the same for all reads of a block, none or null
    leave it whole. A read is in every segment that it touches, in both beside a cut that it reaches; neighbouring segments
    of uneven depth are joined. Blocks are numbered anew along the contig. It is read twice, so the caller keeps it.
    """
    keys = ["contig", "block_id"]
    known = membership.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    touched = F.expr("filter(sequence(0, size(cuts)), k -> (k = 0 or last_site >= get(cuts, k - 1)) and (k = size(cuts) or first_site <= get(cuts, k)))")
    counted = known.withColumn("k", F.explode(touched)).groupBy(*keys, "l_site", "r_site", F.expr("get(cuts, k)").alias("cut")).agg(F.count("*").alias("n_reads"))
    segments = ranked(merge_segments(counted, *keys), ["contig"], [F.asc("block_id"), F.asc("l_site")], "index")
    ranges = segments.select(*keys, "index", F.col("l_site").alias("from_"), F.col("r_site").alias("to_"))
    met = membership.join(ranges, keys).where("first_site <= to_ and last_site >= from_")
    return met.select("contig", F.col("index").alias("block_id"), "cluster", "frag_id", F.col("from_").alias("l_site"), F.col("to_").alias("r_site"))


def column_islands(crossed: DataFrame, columns: DataFrame) -> DataFrame:
    """contig, col, island: columns(contig, col) that edges leaving crossed(contig, col) tie together, with the first of them.

    An edge goes from a column to the next one, so between two columns that no edge joins the graph falls apart. There are
    as many rows as blocks.
    """
    tied = crossed.select("contig", (F.col("col") + 1).alias("col"), F.lit(True).alias("tied")).distinct()
    order = Window.partitionBy("contig").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.when(F.col("tied").isNull(), F.col("col"))
    return columns.select("contig", "col").distinct().join(tied, ["contig", "col"], "left").select("contig", "col", F.last(begins, ignorenulls=True).over(order).alias("island"))


def flow_edges(edges: DataFrame) -> DataFrame:
    """edges with a balanced flow. Parts of the graph that no edge joins are balanced apart."""
    kind = edges.schema["contig"].dataType.simpleString()
    both = edges.select("contig", "col").union(edges.select("contig", F.col("col") + 1))
    placed = edges.join(column_islands(edges, both), ["contig", "col"])

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        keys = list(zip(group["col"], group["row_from"], group["row_to"], strict=True))
        flows = kernels.balance(dict(zip(keys, group["weight"], strict=True)))
        return group.assign(flow=[flows[k] for k in keys])[["contig", "col", "row_from", "row_to", "weight", "flow"]]

    return placed.groupBy("contig", "island").applyInPandas(solve, f"contig {kind}, col int, row_from int, row_to int, weight long, flow double")


def disjoint_paths(membership: DataFrame, flows: DataFrame) -> DataFrame:
    """contig, path, col, cluster. Parts of the graph that no flow of LEAST_FLOW or more joins are peeled apart; paths are
    numbered along the contig by these, and within one by their width."""
    kind = membership.schema["contig"].dataType.simpleString()
    nodes = numbered(membership).select("contig", "col", "cluster").distinct()
    strong = flows.where(F.col("flow") >= kernels.LEAST_FLOW)
    islands = kept(column_islands(strong, nodes))

    def solve(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        flow = {(c, a, b): f for c, a, b, f in zip(right["col"], right["row_from"], right["row_to"], right["flow"], strict=True)}
        found = kernels.peel_paths(list(zip(left["col"], left["cluster"], strict=True)), flow)
        rows = [(key[0], key[1], k, c, r) for k, path in enumerate(found) for c, r in path]
        return pd.DataFrame(rows, columns=["contig", "island", "place", "col", "cluster"])

    left = nodes.join(islands, ["contig", "col"]).groupBy("contig", "island")
    right = strong.join(islands.withColumnRenamed("island", "isle"), ["contig", "col"]).groupBy("contig", "isle")
    found = kept(left.cogroup(right).applyInPandas(solve, f"contig {kind}, island int, place int, col int, cluster int"))
    order = Window.partitionBy("contig").orderBy("island").rowsBetween(Window.unboundedPreceding, -1)
    before = found.groupBy("contig", "island").agg((F.max("place") + 1).alias("n")).select("contig", "island", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return found.join(before, ["contig", "island"]).select("contig", (F.col("before") + F.col("place")).cast("int").alias("path"), "col", "cluster")


def path_members(membership: DataFrame, paths: DataFrame) -> DataFrame:
    """contig, part, frag_id: the union of the reads of each path's clusters."""
    return numbered(membership).join(paths, ["contig", "col", "cluster"]).select("contig", F.col("path").alias("part"), "frag_id").distinct()


def assign_reads(obs: DataFrame, members: DataFrame, epsilon: float) -> DataFrame:
    """contig, frag_id, part: exactly one part for each read.

    A read is placed by the reads before it that it shares sites with, so stretches of a contig that no read spans
    (islands) are solved apart.
    """
    kind = obs.schema["contig"].dataType.simpleString()
    islands = split_gaps(fragment_order(frags_of(obs)), "contig").select("contig", "frag_id", "rank", "piece")
    options = members.groupBy("contig", "frag_id").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    rows = packed(obs.select("contig", "frag_id", "site", "allele", "weight")).join(islands, ["contig", "frag_id"]).join(options, ["contig", "frag_id"])

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        choice = dict(zip(group["frag_id"], group["parts"], strict=True))
        found = kernels.assign(_reads(group), {k: list(v) for k, v in choice.items()}, epsilon)
        return pd.DataFrame({"contig": group["contig"].iloc[0], "frag_id": list(found), "part": list(found.values())})

    return rows.groupBy("contig", "piece").applyInPandas(solve, f"contig {kind}, frag_id long, part int")


def path_flow(paths: DataFrame, flows: DataFrame) -> DataFrame:
    """contig, path, flow: mean flow of all edges out of a path's nodes, null if there are none."""
    out = flows.select("contig", "col", F.col("row_from").alias("cluster"), "flow")
    return paths.join(out, ["contig", "col", "cluster"], "left").groupBy("contig", "path").agg(F.avg("flow").alias("flow"))


def path_ranges(membership: DataFrame, paths: DataFrame) -> DataFrame:
    """contig, path, l_site, r_site: from the first to the last site of the blocks of a path's nodes."""
    nodes = numbered(membership).groupBy("contig", "col", "cluster").agg(F.min("l_site").alias("l_site"), F.max("r_site").alias("r_site"))
    return nodes.join(paths, ["contig", "col", "cluster"]).groupBy("contig", "path").agg(F.min("l_site").alias("l_site"), F.max("r_site").alias("r_site"))


def final_parts(obs: DataFrame, chosen: DataFrame, ranges: DataFrame) -> DataFrame:
    """contig, frag_id, part, l_site, r_site: parts split at gaps within the ranges(contig, path, l_site, r_site) of their
    paths, and numbered by range."""
    own = frags_of(obs).join(chosen, ["contig", "frag_id"]).join(ranges.withColumnRenamed("path", "part"), ["contig", "part"])
    reads, pieces = split_gaps_within(own, "contig", "part")
    names = pieces.withColumn("index", F.row_number().over(Window.partitionBy("contig").orderBy("l_site", "r_site", "part", "piece")) - 1)
    return reads.join(names, ["contig", "part", "piece"]).select("contig", "frag_id", F.col("index").alias("part"), "l_site", "r_site")


def binned_paths(paths: DataFrame, flows: DataFrame, membership: DataFrame, sites: DataFrame, length: int) -> DataFrame:
    """paths with those joined to one that follow each other and carry about the same flow."""
    ends = path_ranges(membership, paths).join(sites.select("contig", F.col("site").alias("l_site"), F.col("pos").alias("l_base")), ["contig", "l_site"])
    ends = ends.join(sites.select("contig", F.col("site").alias("r_site"), F.col("pos").alias("r_base")), ["contig", "r_site"])
    bins = bin_parts(ends.withColumnRenamed("path", "part"), path_flow(paths, flows).select("contig", F.col("path").alias("part"), F.col("flow").alias("cov")), length)
    return paths.join(bins.select("contig", F.col("part").alias("path"), "bin"), ["contig", "path"]).select("contig", F.col("bin").alias("path"), "col", "cluster")


def corrected(obs: DataFrame, short: DataFrame) -> DataFrame:
    """Observations of long reads with the alleles that short reads over them agree on."""
    return obs.drop("allele").join(hybrid_correct(obs, short), ["contig", "frag_id", "site"]).select(*obs.columns)


def phase(
    obs: DataFrame, length: int, epsilon: float, most: int = 5, beam: int = 10, sensitivity: int = 2, density: float = 0.0005, heuristic: bool = True, sites: DataFrame | None = None, short: DataFrame | None = None, reassign: bool = False, binned: bool = False, breaks: bool = False
) -> DataFrame:
    """obs with the final part of each read, and the range of sites of that part (l_site, r_site).

    short: observations of short reads, by which the others are corrected; with reassign each of them also joins the parts
    that it fits best. binned: paths of about the same flow are joined. breaks: blocks are cut where the search lost clusters, so that
    a path goes on beyond such a site only by reads that reach it. What each step gives is kept, so that each is
    computed once.
    """
    obs = kept(obs if short is None else corrected(obs, short))
    places = sites if sites is not None else sites_of(obs)
    searched = kept(searched_blocks(obs, length, epsilon, most, beam, sensitivity, density, heuristic, places))
    membership = kept(cut_blocks(searched)) if breaks else searched.drop("first_site", "last_site", "cuts")
    flows = kept(flow_edges(block_edges(membership, obs)))
    paths = kept(disjoint_paths(membership, flows))
    if binned:
        paths = kept(binned_paths(paths, flows, membership, places, length))
    chosen = kept(assign_reads(obs, path_members(membership, paths), epsilon))
    placed = obs.join(kept(final_parts(obs, chosen, path_ranges(membership, paths))), ["contig", "frag_id"])
    if short is None or not reassign:
        return placed
    placed = kept(placed)
    more = reassign_short(short, placed, epsilon).join(placed.select("contig", "part", "l_site", "r_site").distinct(), ["contig", "part"])
    return placed.unionByName(short.join(more, ["contig", "frag_id"]).select(*placed.columns))


def bin_parts(ranges: DataFrame, coverage: DataFrame, length: int) -> DataFrame:
    """contig, part, bin for ranges(contig, part, l_base, r_base) and coverage(contig, part, cov), which may be null."""
    rows = ranges.join(coverage, ["contig", "part"]).select("contig", "part", "l_base", "r_base", "cov")
    kind = ranges.schema["contig"].dataType.simpleString()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        parts = [(p, a, b, None if pd.isna(c) else float(c)) for p, a, b, c in group[["part", "l_base", "r_base", "cov"]].itertuples(index=False, name=None)]
        found = kernels.bin_parts(parts, length)
        return pd.DataFrame({"contig": group["contig"].iloc[0], "part": list(found), "bin": list(found.values())})

    return rows.groupBy("contig").applyInPandas(solve, f"contig {kind}, part int, bin int")


def reassign_short(reads: DataFrame, placed: DataFrame, epsilon: float, width: int = 64) -> DataFrame:
    """contig, frag_id, part: each read goes to all parts that tie for the least diff / same among those it ends in."""
    ranges = part_ranges(placed).select("contig", "part", "l_site", "r_site")
    frags = frags_of(reads)
    touching = overlap_join(frags, ranges, ("first_site", "last_site"), ("l_site", "r_site"), ["contig"], width)
    ends = touching.where("first_site between l_site and r_site or last_site between l_site and r_site").select("contig", "frag_id", "part")
    score = read_haplotype_distance_eps(reads, pileup(placed, "contig", "part"), ends, ["contig"], "part", epsilon)
    pair = score.withColumn("d", F.floor(F.round(F.round("diff", 6) * 10 + 1, 4))).withColumn("s", F.floor(F.round(F.round("same", 6) * 10 + 1, 4))).withColumn("ratio", F.col("d") / F.col("s"))
    best = pair.groupBy("contig", "frag_id").agg(F.min(F.struct("ratio", "d", "s")).alias("b"))
    return pair.join(best, ["contig", "frag_id"]).where("d = b.d and s = b.s").select("contig", "frag_id", "part")


def realign(calls: DataFrame, chunks: DataFrame, flank: int = 16, size: int = CHUNK) -> DataFrame:
    """calls with the allele whose base, put into the reference around the site, aligns best with the read there.

    calls: contig, pos (from 0), seq_pos (from 0), seq, alleles (array), allele and others; chunks: contig, chunk, seq of the
    reference, as sequences.chunked gives it, so calls of a contig meet it chunk by chunk. The first of the best alleles
    counts. Calls nearer than `flank` to an end of the read or the reference stay as they are.
    """
    window = lambda text, at: F.substring(F.col(text), (F.col(at) - flank + 1).cast("int"), F.lit(2 * flank))
    inside = (F.col("local") >= flank) & (F.col("local") + flank < F.length("ref")) & (F.col("seq_pos") >= flank) & (F.col("seq_pos") + flank < F.length("seq"))

    @F.pandas_udf("int")
    def best(read: pd.Series, target: pd.Series, alleles: pd.Series, allele: pd.Series) -> pd.Series:
        out = allele.to_numpy(copy=True)
        own = np.flatnonzero(read.notna() & target.notna())
        if not len(own):
            return pd.Series(out)
        grid = lambda texts: np.array([list(x.encode()) for x in texts], np.uint8)
        reads, targets = grid(read.iloc[own]), grid(target.iloc[own])
        options = [list(a) for a in alleles.iloc[own]]
        top, score = np.zeros(len(own), np.int32), np.full(len(own), -(1 << 30))
        for k in range(max(map(len, options))):
            rows = np.flatnonzero([len(o) > k for o in options])
            tried = targets[rows].copy()
            tried[:, flank] = [ord(options[r][k]) for r in rows]
            found = kernels.realign_scores(reads[rows], tried)
            better = found > score[rows]
            top[rows[better]], score[rows[better]] = k, found[better]
        out[own] = top
        return pd.Series(out)

    reference = with_margins(chunks, flank, flank + 1).withColumnRenamed("seq", "ref")
    met = calls.withColumn("chunk", F.floor(F.col("pos") / size)).join(reference, ["contig", "chunk"], "left")
    near = met.withColumn("local", F.col("pos") - F.col("chunk") * size + F.col("ahead")).withColumn("read_window", F.when(inside, F.upper(window("seq", "seq_pos")))).withColumn("ref_window", F.when(inside, F.upper(window("ref", "local"))))
    return near.withColumn("allele", best("read_window", "ref_window", "alleles", "allele")).select(*calls.columns)
