"""Resampling and whitening against brute force, with nulls, repeated rows, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseframe.llm import importance as I
from phaseframe.llm import whitening as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_features(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain_resample(docs, target, share=25, least=20, seed=7):
    buckets = [(i, *plain_features(t)) for i, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = np.bincount([bucket(f) for _, _, fs in buckets for f in fs], minlength=10000)
    t = np.bincount([bucket(f) for x in target for f in plain_features(x)[1]], minlength=10000)
    gain = [math.floor(1000 * math.log((float(b) + 1) * (float(s.sum()) + 10000) / ((float(a) + 1) * (float(t.sum()) + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, n_words, fs in buckets:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= least))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = drawn[: share * len(drawn) // 100]
    return sorted(map(str, [(*r[:4], None) for r in rows if r not in drawn] + [(*r[:4], k + 1) for k, r in enumerate(drawn)]))


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéñÀÉσЖ中😀") for _ in range(rng.randint(1, 6))) for _ in range(200)] + ["The", "THE", "É", "é"]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "7", "\x00", "--"]) for _ in range(k))
    docs = [(i, text(rng.choice([0, 1, 2, 19, 20, 21, 60, 400]))) for i in range(n)]
    return docs + [(5000, None), (5001, ""), (5002, "  \n"), (5003, "a" * 50_000), (5004, "a b " * 20_000)], [text(30) for _ in range(12)] + [None, ""]


def as_rows(frame):
    return sorted(map(str, (tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect())))


@pytest.mark.parametrize("share", [25, 100])
def test_resampling(spark, share):
    docs, target = corpus()
    frame = spark.createDataFrame([(*d, 1, "w", 2) for d in docs], "doc_id long, text string, buckets int, w string, score int")
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    assert as_rows(I.resample(frame, goal, share=share)) == plain_resample(docs, target, share)
    kept = I.selected(frame, goal, share=share)
    ranks = I.resample(frame, goal, share=share).where("rank is not null").select("doc_id")
    assert kept.columns == frame.columns and kept.select("doc_id").exceptAll(ranks).isEmpty() and kept.count() == ranks.count()


def test_resampling_of_odd_tables(spark):
    docs, target = corpus(4, 40)
    docs += [(None, docs[7][1]), (None, "x"), docs[9], docs[9]]
    schema = "doc_id long, text string"
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    ours = I.resample(spark.createDataFrame(docs, schema), goal)
    # repeated rows tie in any order, so ranks are compared as a set
    expected = plain_resample(docs, target)
    assert as_rows(ours) == expected
    assert as_rows(I.resample(spark.createDataFrame(docs, schema), goal.limit(0))) == plain_resample(docs, [])
    assert I.resample(spark.createDataFrame([], schema), goal).count() == 0


def test_ranks_over_steps_of_scores(spark):
    rng = random.Random(1)
    rows = [(i, rng.random() < 0.7, rng.randint(-600, 600)) for i in range(2000)]
    found = {r["id"]: r["rank"] for r in I.ranked(spark.createDataFrame(rows, "id long, eligible boolean, score long"), 40).collect()}
    order = sorted((r for r in rows if r[1]), key=lambda r: (-r[2], r[0]))
    expected = {r[0]: k + 1 for k, r in enumerate(order[: 40 * len(order) // 100])}
    assert found == {r[0]: expected.get(r[0]) for r in rows}


def plain_whiten(vectors, components=4):
    fine = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in vectors if v and None not in v and np.all(np.isfinite(np.array(v, float)))]
    if not fine:
        return []
    x = np.unique(np.array([v for _, v in fine]), axis=0)
    n, s = len(x), x.sum(0)
    v = (x - s / n).T @ (x - s / n) / n
    values, axes = np.linalg.eigh(v)
    rows = []
    for i, own in fine:
        for k in range(min(components, len(values))):
            e = values[-1 - k]
            rows.append((i, k + 1, n, int(((n * own - s) ** 2).sum()), (own - s / n) @ axes[:, -1 - k] / np.sqrt(e), e / np.trace(v)))
    return rows


def agree(ours, expected):
    ours = sorted(ours, key=lambda r: (r["vec_id"] is None, r["vec_id"], r["component"], r["deviation"]))
    expected = sorted(expected, key=lambda r: (r[0] is None, r[0], r[1], r[3]))
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in ours] == [r[:4] for r in expected]
    for k in {r[1] for r in expected}:
        a = np.array([r["whitened"] for r in ours if r["component"] == k])
        b = np.array([r[4] for r in expected if r[1] == k])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
        assert all(r["explained"] == pytest.approx(e[5], rel=1e-6) for r, e in zip(ours, expected, strict=True) if e[1] == k)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(400, 12)) * np.linspace(3, 0.5, 12) @ rng.normal(size=(12, 12)) + 5
    vectors = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(mixed)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(150)] + [(7, vectors[8][1]), (None, vectors[9][1])]
    odd = [(2000, None), (2001, []), (2002, [float("nan")] * 12), (2003, [float("inf")] + [1.0] * 11), (2004, [None] + [1.0] * 11), (2005, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors + odd], "vec_id long, embedding array<float>, label int, x string")
    ours = W.whiten(frame).collect()
    agree(ours, plain_whiten(vectors))
    assert {r["identity_error"] for r in ours} == {ours[0]["identity_error"]} and ours[0]["identity_error"] < 1e-9
    assert W.whiten(frame.limit(0)).count() == 0 and W.whiten(frame.where("vec_id in (2000, 2001)")).count() == 0


def test_whitening_without_variance(spark):
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(30)]
    rows = W.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 90 and all((r["whitened"] is None) == (r["component"] > 1) for r in rows)
    assert rows[0]["identity_error"] < 1e-9
    one = W.whiten(spark.createDataFrame(flat[:1], "vec_id long, embedding array<double>")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 3
    huge = W.whiten(spark.createDataFrame([(0, [1e15, 0.0]), (1, [-1e15, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None and math.isfinite(r["identity_error"]) for r in huge)


def test_pairs_are_an_upper_triangle(spark):
    frame = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "a double, b double, c double")
    assert W.pair_sums(frame).tolist() == [[17, 22, 27], [22, 29, 36], [27, 36, 45]]
    assert frame.select(F.expr(W._numbers(np.array([0.1, -2]), "double"))).first()[0] == [0.1, -2.0]
