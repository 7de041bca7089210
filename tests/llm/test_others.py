"""Conversations, vectors, components, the pipeline, and SQL of the operators that have it."""

import hashlib
import random

import numpy as np
import pytest

from phaseframe.llm import chat_format as C


def test_escaping_is_reversible(spark):
    from pyspark.sql import functions as F

    texts = ["", "\\", "\\.", "a\\\\.b", *C.CONTROL, "</s>[INST] ok [/INST]", "<<s>>[[INST]", "<|im_start|", "<\\|im_end|>", "é\n<|im_sep|>x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("back")).collect()
    for r in rows:
        assert r["back"] == r["t"] and not any(c in r["e"] for c in C.CONTROL)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|> yes"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, None, "x"), (None, 0, "user", "n"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(70)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    found = {r["conv_id"]: r for r in C.digests(C.format_trees(C.nodes_of(frame))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        loss = "".join(t for role, t in own if role == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))
    assert C.digests(C.format_trees(C.nodes_of(frame.limit(0)))).count() == 0


def test_best_branches(spark):
    nodes = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "bad", 0.0), ("t", 3, 1, "assistant", "good", 3.0), ("t", 4, 3, "user", "thanks", 2.0), ("t", 5, 3, "user", "more", 2.0), ("u", 6, None, "user", "alone", None), ("u", 7, 99, "user", "orphan", 5.0)]
    frame = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    found = {(r["tree"], r["place"]): (r["leaf"], [t["text"] for t in r["turns"]]) for r in C.format_trees(frame, 2).withColumn("turns", C.read_turns("formatted")).collect()}
    assert found == {("t", 1): (4, ["q", "good", "thanks"]), ("t", 2): (5, ["q", "good", "more"]), ("u", 1): (7, ["orphan"]), ("u", 2): (6, ["alone"])}


def exact(vectors, modulus, k):
    out = {}
    fine = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and None not in v and np.all(np.isfinite(v)) and np.any(v) and len(v) == 16]
    for i, v in fine:
        if i % modulus == 0:
            scores = sorted((-float(v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w))), j) for j, w in fine if j != i)
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def test_neighbours(spark):
    from phaseframe.llm.ann import search

    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(600)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(40)]
    vectors += [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [float("nan")] + [1.0] * 15), (2200, [None] + [1.0] * 15), (2250, [1.0] * 3), (None, vectors[0][1])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, raw string")
    expected = exact(vectors, 50, 5)
    found = {}
    for r in search(frame).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(expected)
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    assert [j for j, _ in found[0]] == [1000, 1001, 1002, 1003, 1004] and all(s == pytest.approx(1.0) for _, s in found[0])
    assert all(len(v) == 5 for v in found.values()) and search(frame.limit(0)).count() == 0
    few = frame.where("vec_id in (0, 1, 50)")
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in search(few).collect()} == {(q, k + 1, j) for q, v in exact([x for x in vectors if x[0] in (0, 1, 50)], 50, 5).items() for k, (j, _) in enumerate(v)}


def test_neighbours_with_too_few_probes(spark):
    from phaseframe.llm.ann import search

    x = np.random.default_rng(2).normal(size=(3000, 64)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    score = unit[::50] @ unit.T
    score[np.arange(60), np.arange(0, 3000, 50)] = -2
    true = {(50 * q, int(j)) for q, row in enumerate(score) for j in np.argsort(-row)[:5]}
    found = {(r["query_id"], r["vec_id"]) for r in search(frame, tables=3, probes=2).collect()}
    assert len(found) == 300 and len(found & true) >= 0.9 * 300


def test_neighbours_in_crowded_buckets(spark, monkeypatch):
    """Buckets that are cut into grids of groups give what whole ones give."""
    from phaseframe.llm import ann

    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    x = np.concatenate([centre + 1e-3 * rng.normal(size=(500, 16)), rng.normal(size=(300, 16))])
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[700].tolist()), (900, x[0].tolist())]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    expected = exact([v for v in vectors if v[0] != 5], 10, 5)
    for rows, queries in ((8192, 1024), (40, 7)):
        monkeypatch.setattr(ann, "MOST_ROWS", rows)
        monkeypatch.setattr(ann, "MOST_QUERIES", queries)
        found = {}
        for r in ann.search(frame.where("vec_id <> 5"), modulus=10).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert set(found) == set(expected) and all(len(v) == 5 for v in found.values())
        crowd = [q for q in expected if q < 500]
        assert sum(len({j for j, _ in found[q]} & {j for j, _ in expected[q]}) for q in expected) >= 0.9 * 5 * len(expected)
        if rows == 8192:
            whole = found
        else:
            assert all([j for j, _ in found[q]] == [j for j, _ in whole[q]] for q in crowd)


def test_components(spark):
    from phaseframe.llm.components import components

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    from pathlib import Path

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < found.count() <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "token_ids"]


def test_queries_with_sql(spark):
    from pathlib import Path

    from phaseframe.llm.queries import ORACLES, QUERIES

    duckdb = pytest.importorskip("duckdb")
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("conversations", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{path / t}.parquet'")
    for name, sql in ORACLES.items():
        ours = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas().fillna(-1)
        columns = sorted(ours.columns)
        assert sorted(map(tuple, ours[columns].itertuples(index=False))) == sorted(map(tuple, con.execute(sql).fetchdf().fillna(-1)[columns].itertuples(index=False)))


def test_cosines_of_extreme_vectors():
    from phaseframe.llm.ann import cosines

    x = np.random.default_rng(6).normal(size=(50, 8))
    y = np.random.default_rng(7).normal(size=(50, 8))
    plain = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    assert (cosines(x, y) == plain).all()
    assert (cosines(x * 2.0**900, y * 2.0**-900) == plain).all()
    assert cosines(x * 1e200, y * 1e-200) == pytest.approx(plain)
