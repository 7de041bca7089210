"""Reads that meet others block by block, in blocks of any size."""

import random

from phaseframe.operators.distances import _Flat, _Meeting, hybrid_correct, read_read_distance


def test_hybrid_correction_in_blocks_of_any_size(spark):
    rng = random.Random(31)
    make = lambda n, first: [("c", first + f, s, rng.randint(0, 2), round(rng.random(), 3)) for f in range(n) for s in sorted(rng.sample(range(1, 50), rng.randint(1, 20)))]
    long_, short = make(20, 0), make(30, 100)
    sums = {}
    for _, f, s, a, w in long_:
        for _, g, t, b, v in short:
            if s == t:
                same, diff = sums.get((f, g), (0, 0))
                value = int(w * v + 0.5)
                sums[f, g] = (same + value * (a == b), diff + value * (a != b))
    alleles = {(g, t): b for _, g, t, b, _ in short}
    chosen = {}
    for _, f, s, _, _ in long_:
        over = [(-(10 * sums[f, g][0] // (sums[f, g][1] + 1)), g) for g in range(100, 130) if (g, s) in alleles]
        if over:
            chosen.setdefault(f, set()).add(min(over)[1])
    expected = set()
    for _, f, s, a, _ in long_:
        votes = {alleles[g, s] for g in chosen.get(f, ()) if (g, s) in alleles}
        expected.add(("c", f, s, votes.pop() if len(votes) == 1 else a))
    schema = "contig string, frag_id long, site int, allele int, weight double"
    for size in (1, 6, 64):
        found = hybrid_correct(spark.createDataFrame(long_, schema), spark.createDataFrame(short, schema), size)
        assert {tuple(r) for r in found.collect()} == expected
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan.split("Initial Plan")[0]  # no table of pairs


def test_pieces_give_the_sums_of_the_whole():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(32)
    reads = [sorted(rng.sample(range(40), 9)) for _ in range(30)]
    rows = pa.table({"sites": reads, "alleles": [[s % 2 for s in r] for r in reads], "weights": [[rng.choice([0.2, 0.7, 0.99, 3.2]) for _ in r] for r in reads]})
    meeting = _Meeting(_Flat(rows), _Flat(rows))
    whole = meeting.sums(0, 30)
    assert np.array_equal(whole, np.concatenate([meeting.sums(k, min(k + 7, 30)) for k in range(0, 30, 7)], axis=1))
    same, diff = meeting.split(whole)
    assert np.array_equal(same, same.T) and not diff.any()


def test_pairs_of_one_deep_place_are_dealt_out(spark):
    """Tasks get two blocks at most, however many reads lie over a site."""
    import pyspark.sql.functions as F

    rng = random.Random(33)
    rows = [("c", f, s, rng.randint(0, 1), rng.choice([0.3, 0.8, 1.0])) for f in range(120) for s in sorted({0, rng.randint(1, 9)})]
    obs = spark.createDataFrame(rows, "contig string, frag_id long, site int, allele int, weight double")
    expected = {}
    for _, f, s, a, w in rows:
        for _, g, t, b, v in rows:
            if s == t and f < g:
                same, diff = expected.get((f, g), (0, 0))
                value = int(w * v + 0.5)
                expected[f, g] = (same + value * (a == b), diff + value * (a != b))
    found = read_read_distance(obs, ["contig"], 4).withColumn("task", F.spark_partition_id()).collect()
    assert {(r["frag_id"], r["other"]): (r["same"], r["diff"]) for r in found} == expected and len(found) == len(expected) == 120 * 119 // 2
    tasks = [r["task"] for r in found]
    assert max(tasks.count(t) for t in set(tasks)) < len(found) // 10
    assert not any(c.nullable for c in read_read_distance(obs, ["contig"], 4).schema)
    weighing = {(r["frag_id"], r["other"]): (r["same"], r["diff"]) for r in read_read_distance(obs, ["contig"], 50, weighing=True).collect()}
    assert weighing == {k: v for k, v in expected.items() if sum(v)} and 0 < len(weighing) < len(expected)


def test_sums_of_fifteen_bits():
    """31 common sites fit into numbers of two bytes."""
    import numpy as np
    import pyarrow as pa

    rows = pa.table({"sites": [list(range(31))] * 2 + [[5, 40]], "alleles": [[0] * 31, [0] * 30 + [1], [0, 0]], "weights": [[1.0] * 31] * 2 + [[1.0, 1.0]]})
    meeting = _Meeting(_Flat(rows), _Flat(rows))
    sums = meeting.sums(0, 3)
    assert sums.dtype == np.int16 and (sums > 0).all()
    same, diff = meeting.split(sums)
    assert same.tolist() == [[31, 30, 1], [30, 31, 1], [1, 1, 2]] and diff.tolist() == [[0, 1, 0], [1, 0, 0], [0, 0, 0]]
