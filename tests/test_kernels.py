"""Sequential kernels against brute force and invariants."""

import itertools
import random

import numpy as np

from phaseframe.operators.windows import split_ranges
from phaseframe.plans import kernels as K


def strains(seed, k=2, sites=40, reads=24, flip=0.02):
    rng = random.Random(seed)
    base = [[(s + j) % 2 if rng.random() < 0.8 else rng.randint(0, 1) for s in range(sites)] for j in range(k)]
    out, truth = [], []
    for _ in range(reads):
        j, start = rng.randrange(k), rng.randrange(sites - 12)
        truth.append(j)
        out.append([(s + 1, base[j][s] ^ (rng.random() < flip), 0.99) for s in range(start, start + 12)])
    order = sorted(range(reads), key=lambda i: out[i][0][0])
    return [out[i] for i in order], [truth[i] for i in order]


def test_planted_strains_are_found():
    for seed in range(4):
        reads, truth = strains(seed)
        found, _ = K.phase_block(reads, 0.04)
        agree = sum(a == b for a, b in zip(found, truth, strict=True))
        assert max(agree, len(truth) - agree) >= 0.85 * len(truth) or len(set(found)) > 2


def test_beam_search_is_near_the_best_partition():
    rng = random.Random(1)
    for _ in range(5):
        reads = [[(s, rng.randint(0, 1), 1.0) for s in range(1, 5)] for _ in range(6)]
        ours = K.refine(reads, K.beam_search(reads, 2, 0.04, 50), 2, 0.04)
        cost = lambda c: K.errors(K.piles_of(reads, list(c), 2), 0.0)[1]
        best = min(cost(c) for c in itertools.product(range(2), repeat=6))
        assert cost(ours) <= best + 2


def test_balanced_flows_are_optimal():
    rng = random.Random(2)
    for _ in range(20):
        weights = {(c, a, b): rng.randint(0, 3) for c in range(2) for a in range(2) for b in range(2) if rng.random() < 0.8}
        if not weights:
            continue
        flows = K.balance(weights)
        edges = sorted(weights)
        inner = {(c + 1, b) for c, _, b in edges} & {(c, a) for c, a, _ in edges}

        def kept(x, edges=edges, inner=inner):
            return all(sum(v for (c, _, b), v in zip(edges, x, strict=True) if (c + 1, b) == n) == sum(v for (c, a, _), v in zip(edges, x, strict=True) if (c, a) == n) for n in inner)

        cost = lambda x, edges=edges, weights=weights: sum(abs(v - weights[e]) for e, v in zip(edges, x, strict=True))
        ours = [flows[e] for e in edges]
        assert kept(ours)
        if len(edges) <= 7:
            assert cost(ours) == min(cost(x) for x in itertools.product(range(5), repeat=len(edges)) if kept(x))


def test_paths_cover_nodes_once():
    nodes = [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    paths = K.peel_paths(nodes, {(0, 0, 0): 9, (0, 1, 1): 4, (1, 0, 0): 9, (1, 1, 0): 3})
    assert sorted(n for p in paths for n in p) == nodes
    assert [(0, 0), (1, 0), (2, 0)] in paths


def test_each_read_gets_one_part():
    reads, _ = strains(3)
    named = list(enumerate(reads))
    found = K.assign(named, {i: [0, 1] for i, _ in named}, 0.04)
    assert set(found) == {i for i, _ in named} and set(found.values()) <= {0, 1}


def test_windows_cover_all_sites():
    rng = random.Random(4)
    for _ in range(20):
        at = sorted(rng.sample(range(20_000), 200))
        ranges = split_ranges(at, 1000, 0.0)
        assert ranges[-1][1] == len(at) - 1
        covered = {i for a, b in ranges for i in range(a, b + 1)}
        assert len(covered) >= 0.9 * len(at)
    assert split_ranges([], 10, 0.0) == [] and split_ranges([5], 10, 0.0) == [(0, 0)]


def affine(read, target):
    """The best global alignment over all ways, by recursion on the last column."""
    from functools import lru_cache

    @lru_cache(None)
    def best(i, j, gap):  # gap: 0 none open, 1 in the target, 2 in the read
        if i == 0 and j == 0:
            return 0 if gap == 0 else -(10**6)
        out = -(10**6)
        if gap == 0 and i and j:
            out = max(best(i - 1, j - 1, g) for g in range(3)) + (1 if read[i - 1] == target[j - 1] else -1)
        if gap == 1 and i:
            out = max(best(i - 1, j, g) - (1 if g == 1 else 2) for g in range(3))
        if gap == 2 and j:
            out = max(best(i, j - 1, g) - (1 if g == 2 else 2) for g in range(3))
        return out

    return max(best(len(read), len(target), g) for g in range(3))


def test_realignment_scores():
    rng = random.Random(9)
    pairs = [("".join(rng.choice("ACGT") for _ in range(9)), "".join(rng.choice("ACGT") for _ in range(9))) for _ in range(40)]
    pairs += [(a, a[2:] + "AC") for a, _ in pairs] + [(a, a) for a, _ in pairs[:3]]
    grid = lambda k: np.array([list(p[k].encode()) for p in pairs], np.uint8)
    assert K.realign_scores(grid(0), grid(1)).tolist() == [affine(a, b) for a, b in pairs]


def test_edges_to_weak_strains_are_cut():
    nodes = [(0, 0), (1, 0), (2, 0), (2, 1), (3, 0)]
    flows = {(0, 0, 0): 100, (1, 0, 0): 90, (1, 0, 1): 10, (2, 1, 0): 10}
    assert K.peel_paths(nodes, flows) == [[(0, 0), (1, 0), (2, 0)], [(2, 1), (3, 0)]]
    # two ways in: the weak edge is not cut, and its end doesn't start a path of its own
    nodes, flows = [(0, 0), (0, 1), (1, 0), (2, 0)], {(0, 0, 0): 50, (0, 1, 0): 40, (1, 0, 0): 5}
    paths = K.peel_paths(nodes, flows)
    assert sorted(n for p in paths for n in p) == nodes and [(2, 0)] in paths


def test_bins():
    along = [(0, 0, 100, 10.0), (1, 110, 200, 10.4), (2, 210, 300, 9.8), (3, 0, 300, 30.0), (4, 5000, 5100, 10.0), (5, 120, 220, None)]
    found = K.bin_parts(along, 50)
    assert found[0] == found[1] == found[2] and len({found[k] for k in (0, 3, 4, 5)}) == 4
    # a part with two candidates doesn't move first; ends meet from the outside
    assert K.bin_distance([(0, 10, 5.0, 0)], [(5, 20, 5.0, 1)], 50) == K.bin_distance([(0, 10, 5.0, 0)], [(500, 520, 5.0, 1)], 50) == float("inf")
    assert K.bin_distance([(0, 10, 5.0, 0)], [(10, 20, 5.0, 1)], 50) < 2


def test_equal_states_keep_the_better_one():
    rng = random.Random(12)
    for _ in range(5):
        reads = [[(s, rng.randint(0, 1), 1.0) for s in range(k, k + 3)] for k in range(1, 9)]
        ours = K.beam_search(reads, 2, 0.04, 40)
        cost = lambda c: sum(K.agreement(r, K.piles_of(reads[:k], list(c[:k]), 2)[c[k]], 0.04)[1] for k, r in enumerate(reads))
        assert cost(ours) <= min(cost(c) for c in itertools.product(range(2), repeat=8)) + 1.5


def graph(seed, columns=12):
    """Nodes (col, cluster) and weighted edges between neighbouring columns, with columns that nothing joins."""
    rng = random.Random(seed)
    nodes = [(c, r) for c in range(columns) for r in range(rng.randint(1, 3))]
    edges = {(c, a, b): rng.randint(1, 9) for c, a in nodes for d, b in nodes if d == c + 1 and rng.random() < 0.5 and c % 4 != 3}
    return nodes, edges


def test_parts_of_the_graph_are_solved_apart(spark):
    """Flows cost what those of the whole contig cost, paths are the same ones, and there are many groups."""
    from phaseframe.plans import phasing

    graphs = {f"c{k}": graph(k) for k in range(6)}
    edges = spark.createDataFrame([(c, *e, w) for c, (_, own) in graphs.items() for e, w in own.items()], "contig string, col int, row_from int, row_to int, weight long")
    found = {}
    for r in phasing.flow_edges(edges).collect():
        found.setdefault(r["contig"], {})[r["col"], r["row_from"], r["row_to"]] = r["flow"]
    assert {c: set(own) for c, own in found.items()} == {c: set(own) for c, (_, own) in graphs.items() if own}
    cost = lambda flows, own: sum(abs(flows[e] - w) for e, w in own.items())
    for c, (_, own) in graphs.items():
        if own:
            assert cost(found[c], own) == cost(K.balance(own), own)
    members = spark.createDataFrame([(c, 10 * col, r, 100 * col + r, col, col + 1) for c, (nodes, _) in graphs.items() for col, r in nodes], "contig string, block_id int, cluster int, frag_id long, l_site int, r_site int")
    flows = spark.createDataFrame([(c, *e, f) for c, own in found.items() for e, f in own.items()], "contig string, col int, row_from int, row_to int, flow double")
    paths = {}
    for r in phasing.disjoint_paths(members, flows).orderBy("contig", "path", "col").collect():
        paths.setdefault((r["contig"], r["path"]), []).append((r["col"], r["cluster"]))
    for c, (nodes, _) in graphs.items():
        ours = [p for (own, _), p in paths.items() if own == c]
        assert sorted(ours) == sorted(K.peel_paths(nodes, found.get(c, {})))
        assert [k for own, k in paths if own == c] == list(range(len(ours)))
    islands = phasing.column_islands(flows, members.withColumnRenamed("block_id", "b").selectExpr("contig", "b div 10 AS col"))
    assert islands.select("contig", "island").distinct().count() >= 3 * len(graphs)


def test_ranks_over_ranges(spark):
    from pyspark.sql import functions as F

    from phaseframe.operators.ranks import ranked

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 500), k) for k in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "key string, x int, id long").repartition(5)
        found = {r["id"]: r["rank"] for r in ranked(frame, ["key"], [F.desc("x"), F.asc("id")]).collect()}
        whole = {r["id"]: r["rank"] for r in ranked(frame, [], [F.asc("x"), F.asc("id")]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = {}
    for key in ("a", "b", None):
        expected |= {r[2]: k for k, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])))}
    assert found == expected and whole == {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    assert ranked(frame.limit(0), ["key"], [F.asc("x")]).count() == 0


def test_candidate_pairs_are_enough(spark):
    """Distances of given pairs are those of all pairs."""
    from pyspark.sql import functions as F

    from phaseframe.operators.distances import all_pairs, read_haplotype_distance_eps
    from phaseframe.operators.pileup import pileup

    rng = random.Random(6)
    obs = spark.createDataFrame([("c", f, s, rng.randint(0, 1), 0.5 + rng.random() / 2, f % 4) for f in range(30) for s in rng.sample(range(20), 6)], "contig string, frag_id long, site int, allele int, weight double, part int")
    piled = pileup(obs, "contig", "part")
    every = all_pairs(obs, piled, ["contig"], "part")
    some = every.where((F.col("frag_id") + F.col("part")) % 3 == 0)
    ours = lambda pairs: {(r["frag_id"], r["part"]): (round(r["same"], 6), round(r["diff"], 6)) for r in read_haplotype_distance_eps(obs.drop("part"), piled, pairs, ["contig"], "part", 0.04).collect()}
    whole, part = ours(every), ours(some)
    assert len(whole) == 120 and part == {k: v for k, v in whole.items() if sum(k) % 3 == 0}
    piles = {p: K.piles_of([[(r["site"], r["allele"], r["weight"]) for r in obs.where(f"part = {p}").collect()]], [0], 1)[0] for p in range(4)}
    for frag in (0, 7):
        read = [(r["site"], r["allele"], r["weight"]) for r in obs.where(f"frag_id = {frag}").collect()]
        for p in range(4):
            same, diff = K.agreement(read, piles[p], 0.04)
            assert whole[frag, p] == (round(same, 6), round(diff, 6))


def test_sequences_in_chunks(spark):
    """Chunks, margins and swapped bases are those of whole strings, whatever the size of a chunk."""
    from phaseframe.operators import sequences as S

    rng = random.Random(8)
    whole = {f"c{k}": "".join(rng.choice("ACGT") for _ in range(n)) for k, n in enumerate((1, 7, 20, 21, 200))}
    reference = spark.createDataFrame(list(whole.items()), "contig string, seq string")
    alleles = [(c, rng.randrange(len(t) + 3), rng.choice(["a", "g", None])) for c, t in whole.items() for _ in range(len(t) // 2)]
    one = {}
    for c, at, base in alleles:
        one[c, at] = min(one.get((c, at), "~"), base or "N")
    expected = {c: "".join(one.get((c, k), x) for k, x in enumerate(t)) for c, t in whole.items()}
    frame = spark.createDataFrame(alleles, "contig string, at long, base string")
    for size in (7, 20, 1 << 14):
        assert {r["contig"]: r["seq"] for r in S.swap_alleles(reference, frame, size).collect()} == expected
        for r in S.with_margins(S.chunked(reference, size), 3, 4).collect():
            text, start = whole[r["contig"]], r["chunk"] * size
            assert r["ahead"] == min(3, start) and r["seq"] == text[start - r["ahead"] : start + size + 4]
    assert S.swap_alleles(reference, frame.limit(0)).count() == len(whole)


def test_realigning_over_chunks(spark):
    from phaseframe.operators import sequences as S
    from phaseframe.plans.phasing import realign

    rng = random.Random(10)
    ref = "".join(rng.choice("ACGT") for _ in range(400))
    rows = [(k, "c", k, rng.randrange(40), "".join(rng.choice("ACGT") for _ in range(60)), ["A", "C", "G", "T"], 0) for k in range(0, 400, 3)] + [(999, "none", 50, 30, "A" * 60, ["A", "C"], 1)]
    calls = spark.createDataFrame(rows, "id int, contig string, pos long, seq_pos long, seq string, alleles array<string>, allele int")
    reference = spark.createDataFrame([("c", ref)], "contig string, seq string")
    found = [{r["id"]: r["allele"] for r in realign(calls, S.chunked(reference, size), size=size).collect()} for size in (40, 97, 1 << 14)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows) and found[0][999] == 1
    for k, _, pos, at, seq, alleles, own in rows[:40]:
        if pos >= 16 and pos + 16 < 400 and at >= 16 and at + 16 < 60:
            scores = [affine(seq[at - 16 : at + 16], ref[pos - 16 : pos] + a + ref[pos + 1 : pos + 16]) for a in alleles]
            assert found[0][k] == scores.index(max(scores))
        else:
            assert found[0][k] == own


def test_packed_pairs_of_reads(spark):
    """Pairs that meet over any number of bins have the sums over all their common sites."""
    from phaseframe.operators.distances import read_read_distance

    rng = random.Random(12)
    rows = [("c", f, s, rng.randint(0, 2), round(rng.random(), 3)) for f in range(25) for s in sorted(rng.sample(range(1, 60), rng.randint(1, 40)))] + [("d", 3, 5, 0, 1.0), ("d", 4, 5, 0, 0.9), ("d", 5, 6, 0, 0.9)]
    expected = {}
    for c, f, s, a, w in rows:
        for d, g, t, b, v in rows:
            if c == d and s == t and f < g:
                same, diff = expected.get((c, f, g), (0, 0))
                value = int(w * v + 0.5)
                expected[c, f, g] = (same + value * (a == b), diff + value * (a != b))
    obs = spark.createDataFrame(rows, "contig string, frag_id long, site int, allele int, weight double")
    for width in (1, 7, 64):
        found = {(r["contig"], r["frag_id"], r["other"]): (r["same"], r["diff"]) for r in read_read_distance(obs, ["contig"], width).collect()}
        assert found == expected


def test_breaks_of_a_search_from_all_reads_before():
    rng, seen = random.Random(31), 0
    for _ in range(200):
        ploidy, reach = rng.randint(1, 4), rng.choice([5, 50])
        starts = sorted(rng.choice([*range(1, 12), *range(40, 52), *range(120, 130)]) for _ in range(rng.randint(0, 14)))
        reads = [[(s, 0, 1.0) for s in sorted(rng.sample(range(a + 1, a + 14), rng.randint(0, 6)) + [a])] for a in starts]
        clusters = [rng.randrange(ploidy) for _ in reads]
        expected = {}
        for k in range(1, len(reads)):
            start, known = starts[k], starts[k - 1]
            for c in range(ploidy):
                sites = {s for r, own in zip(reads[:k], clusters, strict=False) if own == c for s, _, _ in r if s >= known}
                if any(start - reach < s < start for s in sites) and not any(start <= s < start + reach for s in sites):
                    expected.setdefault(start, set()).add(c)
        wanted = sorted(s for s, lost in expected.items() if len(lost) > 1)
        assert K.search_breaks(reads, clusters, ploidy, reach) == wanted
        seen += len(wanted)
    assert seen > 20
