"""Phasing end to end on planted strains: reads of one strain come out together."""

import random
from collections import Counter

import pytest

from phaseframe.plans import phasing

SITES = 200


def planted(strains, seed=42, reads=400, flip=0.02, gap=(95, 105)):
    """(frag, site, allele, qual) rows and each read's strain; strains differ at a fifth of the sites or more, and no read
    crosses the gap."""
    rng = random.Random(seed)
    while True:
        bases = [[rng.randint(0, 1) for _ in range(SITES)] for _ in range(strains)]
        apart = [sum(x != y for x, y in zip(a, b, strict=True)) / SITES for k, a in enumerate(bases) for b in bases[:k]]
        if min(apart) >= 0.2:
            break
    rows, truth = [], {}
    for frag in range(reads):
        strain, length = frag % strains, rng.randint(10, 40)
        while True:
            start = rng.randint(1, SITES - length + 1)
            if start + length <= gap[0] or start >= gap[1]:
                break
        truth[frag] = strain
        for site in range(start, start + length):
            rows.append(("c", frag, site, 100 * (site - 1), bases[strain][site - 1] ^ (rng.random() < flip), rng.randint(5, 40)))
    return rows, truth


@pytest.mark.parametrize("strains", [2, 3])
def test_planted_strains(spark, strains):
    from pyspark.sql import functions as F

    from phaseframe.functions.scalars import phred_weight
    from phaseframe.operators.parts import part_ranges
    from phaseframe.operators.pileup import pileup
    from phaseframe.plans.phasing import phase
    from phaseframe.sources.sinks import vartigs

    rows, truth = planted(strains)
    obs = spark.createDataFrame(rows, "contig string, frag_id long, site int, pos long, allele int, qual int").withColumn("weight", phred_weight(F.col("qual")))
    found = phase(obs, 3000, 0.04)
    placed = {r["frag_id"]: r["part"] for r in found.select("frag_id", "part").distinct().collect()}
    assert set(placed) == set(truth)
    sizes = Counter(placed.values())
    pure = sum(max(Counter(truth[f] for f in placed if placed[f] == p).values()) for p in sizes)
    assert pure / len(truth) > 0.95
    assert sum(n for _, n in sizes.most_common(2 * strains)) > 0.9 * len(truth)
    spans = {p: (min(s for _, f, s, *_ in rows if placed[f] == p), max(s for _, f, s, *_ in rows if placed[f] == p)) for p in sizes}
    assert all(b < 106 or a > 94 for a, b in spans.values())
    text = vartigs(part_ranges(found), pileup(found, "contig", "part"), 3000)
    assert text.count() == len(sizes) and all(len(r["alleles"]) == r["r_site"] - r["l_site"] + 1 for r in text.collect())


def test_reads_over_block_borders(spark):
    """Reads take part in a block with all their sites, parts have the ranges of their paths, and breaks lie within them."""
    from pyspark.sql import functions as F

    from phaseframe.functions.scalars import phred_weight
    from phaseframe.operators.parts import part_ranges
    from phaseframe.plans.phasing import phase

    rows, truth = planted(2, seed=7, reads=300)
    obs = spark.createDataFrame(rows, "contig string, frag_id long, site int, pos long, allele int, qual int").withColumn("weight", phred_weight(F.col("qual")))
    sites = spark.createDataFrame([("c", s, 100 * (s - 1)) for s in range(1, SITES + 1)], "contig string, site int, pos long")
    found = phase(obs, 1500, 0.04, sites=sites)  # blocks shorter than many reads
    placed = {r["frag_id"]: r["part"] for r in found.select("frag_id", "part").distinct().collect()}
    assert set(placed) == set(truth)
    sizes = Counter(placed.values())
    assert sum(max(Counter(truth[f] for f in placed if placed[f] == p).values()) for p in sizes) / len(truth) > 0.95
    ranges = {r["part"]: r for r in part_ranges(found, sites).collect()}
    assert set(ranges) == set(sizes)
    for r in ranges.values():
        assert (r["l_base"], r["r_base"]) == (100 * (r["l_site"] - 1), 100 * (r["r_site"] - 1)) and r["n_reads"] == sizes[r["part"]]
    # nobody's range spans the gap that no read crosses
    assert all(not (r["l_site"] < 95 and r["r_site"] > 105) for r in ranges.values())


def plain_pieces(reads, low, high):
    """Pieces of a part by walking along its reads: (first site, last site, id) lists and ranges."""
    reach, pieces, cuts = 0, [[]], []
    for a, z, k in sorted(reads, key=lambda r: (r[0], -r[1], r[2])):
        if pieces[-1] and a > reach and low <= reach < high:
            cuts.append(reach)
            pieces.append([])
        pieces[-1].append(k)
        reach = max(reach, z)
    starts, ends = [low, *(c + 1 for c in cuts)], [*cuts, high]
    return {k: (n, starts[n], ends[n]) for n, own in enumerate(pieces) for k in own}


def test_breaks_within_ranges(spark):
    from phaseframe.operators.windows import split_gaps_within

    rng, rows, expected = random.Random(5), [], {}
    for part in range(40):
        low = rng.randint(1, 60)
        high = low + rng.randint(0, 60)
        reads = [(a, a + rng.randint(0, 6), 1000 * part + k) for k in range(rng.randint(1, 14)) for a in [rng.randint(1, 120)]]
        rows += [("c", part, k, a, z, low, high) for a, z, k in reads]
        expected |= {(part, k): v for k, v in plain_pieces(reads, low, high).items()}
    frags = spark.createDataFrame(rows, "contig string, part int, frag_id long, first_site int, last_site int, l_site int, r_site int")
    reads, pieces = split_gaps_within(frags, "contig", "part")
    found = {(r["part"], r["frag_id"]): (r["piece"], r["l_site"], r["r_site"]) for r in reads.join(pieces, ["contig", "part", "piece"]).collect()}
    assert found == expected and max(v[0] for v in expected.values()) > 2


def test_blocks_are_cut_where_the_search_loses_clusters(spark):
    """Two strains, and no read over the middle of the contig: with breaks no part is on both sides. The one read that begins
    at the break is in both segments, which is too little for an edge."""
    rng = random.Random(41)
    base = [[rng.randint(0, 1) for _ in range(60)]]
    base.append([1 - a for a in base[0]])
    rows, side, truth = [], {}, {}
    for frag in range(80):
        half, strain = frag % 2, rng.randrange(2)
        start = 30 * half + (0 if frag == 1 else rng.randrange(1, 19))
        side[frag], truth[frag] = half, strain
        rows += [("c", frag, s + 1, 100 * s, base[strain][s] ^ (rng.random() < 0.01), 40, 0.99) for s in range(start, start + 12)]
    obs = spark.createDataFrame(rows, "contig string, frag_id long, site int, pos long, allele int, qual int, weight double")
    searched = phasing.searched_blocks(obs, 10_000, 0.02).cache()
    begin = min(r[2] for r in rows if side[r[1]] == 1)
    assert {c for r in searched.select("cuts").collect() for c in r["cuts"]} == {begin}
    cut = phasing.cut_blocks(searched).collect()
    for r in cut:
        assert (r["r_site"] <= begin) if side[r["frag_id"]] == 0 else (r["l_site"] >= begin or r["frag_id"] == 1)
    assert {r["frag_id"] for r in cut} == set(side)
    parts = {}
    for r in phasing.phase(obs, 10_000, 0.02, breaks=True).select("frag_id", "part").distinct().collect():
        parts.setdefault(r["part"], set()).add(r["frag_id"])
    assert sum(sorted(map(len, parts.values()))[-4:]) >= 78
    for own in parts.values():
        assert len({side[f] for f in own}) == 1 and len({truth[f] for f in own}) == 1


def test_cuts_by_brute_force(spark):
    """Segments, their joining and the reads in them against plain loops; blocks without cuts stay whole."""
    rng = random.Random(43)
    rows = []
    for contig in ("a", "b", None):
        for block in range(6):
            cuts = sorted(rng.sample(range(1, 40), rng.randint(0, 4))) if block else None
            rows += [(contig, block, rng.randrange(3), 100 * block + f, 1, 40, a, min(40, a + rng.randint(0, 20)), cuts) for f in range(rng.choice([1, 5, 60])) for a in [rng.randint(1, 40)]]
    schema = "contig string, block_id int, cluster int, frag_id long, l_site int, r_site int, first_site int, last_site int, cuts array<int>"
    named = [r for r in rows if r[0] is not None]
    found = {tuple(r) for r in phasing.cut_blocks(spark.createDataFrame(named, schema)).collect()}
    wanted = set()
    for contig in ("a", "b"):
        index = 0
        for block in range(6):
            own = [r for r in named if r[:2] == (contig, block)]
            cuts = own[0][8] or []
            touched = lambda r, k, cuts=cuts: (k == 0 or r[7] >= cuts[k - 1]) and (k == len(cuts) or r[6] <= cuts[k])
            counts = [(k, n) for k in range(len(cuts) + 1) if (n := sum(touched(r, k) for r in own))]
            left = []
            for (k, n), (_, m) in zip(counts, counts[1:], strict=False):
                if cuts[k] > 1 and 0.05 <= n / (n + m) <= 0.95:
                    left.append(cuts[k])
            ends = [1, *left, 40]
            if counts[-1][0] < len(cuts):  # no read behind the last cuts
                ends = [1, *left]
            for a, b in zip(ends, ends[1:], strict=False):
                wanted |= {(contig, index, r[2], r[3], a, b) for r in own if r[6] <= b and r[7] >= a}
                index += 1
    assert found == wanted and len({r[4:] for r in wanted}) > 5
    assert phasing.cut_blocks(spark.createDataFrame([], schema)).count() == 0
