"""Every stage of the pipeline against brute force on a small fixture, each on what the stage before has kept."""

import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from test_texts import WORD, removed, smallest_of_groups  # noqa: E402

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(seed=21):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, f"A trader has {3 + k} sacks of {text(6)} and sells {20 + k} of them to Anna for {text(8)}") for k in range(4)]
    passage = text(40)
    rows = []
    for i in range(260):
        kind = i % 13
        body = text(rng.randint(30, 90))
        if kind == 1:
            body = "BUY NOW!!! " * rng.randint(5, 20)
        elif kind == 2:
            body = rows[i - 2][1] + (" extra" if i % 2 else "")
        elif kind == 3:
            body = f"{text(20)} {passage} {text(25)}"
        elif kind == 4:
            body = f"{text(15)}. {items[i % 4][1]}. {text(15)}"
        elif kind == 5:
            body = f"{text(15)}. {items[i % 4][1].replace(str(3 + i % 4), '57').replace(str(20 + i % 4), '91').replace('Anna', 'Bertha')}. {text(15)}"
        elif kind == 6:
            body = [None, "", "  ", passage][i // 13 % 4]
        rows.append((i, body))
    rows += [(None, text(40)), (None, passage), (7, text(50)), (None, None)]
    labels = [(i, int(t is not None and "BUY" not in t), 0) for i, t in rows if i is not None]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], labels, items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels, items = fixture()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def rows_of(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_stages_by_brute_force(spark, tables, tmp_path):
    folder, items = tables
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    first = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == first.columns and out.dtypes == first.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
    before = rows_of(first)

    after = rows_of(kept["quality"])
    junk = [i for i, t in before if t and "BUY" in t]
    assert set(after) <= set(before) and not {i for i, _ in after} & set(junk)
    assert sum(bool(t and len(t) > 100) for _, t in after) >= 0.97 * sum(bool(t and len(t) > 100 and "BUY" not in t) for _, t in before)

    roots = smallest_of_groups(after, 5)
    expected = sorted(((i, t) for i, t in after if i is None or roots[i] == i), key=str)
    assert rows_of(kept["near_duplicates"]) == expected and len(expected) < len(after)

    by_row = {(str(i), t): removed_words(expected, i, t) for i, t in expected}
    expected = sorted(((i, by_row[str(i), t][1]) for i, t in expected if not by_row[str(i), t][0] or by_row[str(i), t][1]), key=str)
    found = rows_of(kept["repeated_passages"])
    assert found == expected and any(by_row[str(i), t][0] for i, t in rows_of(kept["near_duplicates"]))

    leaky = [(i, t) for i, t in found if t and ("A trader has" in t)]
    assert leaky and rows_of(kept["decontamination"]) == [r for r in found if r not in leaky]

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    final = []
    for i, t in rows_of(kept["decontamination"]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        final.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), ids))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["token_ids"]) for r in kept["token_ids"].collect()) == sorted(final)


def removed_words(rows, own, text, window=13):
    """Whether a row loses words, and its text afterwards."""
    order = lambda i: (i is None, i or 0)
    words = WORD.findall(text or "")
    gone = set()
    for k in range(len(words) - window + 1):
        run = words[k : k + window]
        for i, t in rows:
            if order(i) < order(own) and t and " ".join(run) in " ".join(WORD.findall(t)):
                other = WORD.findall(t)
                if any(other[j : j + window] == run for j in range(len(other) - window + 1)):
                    gone.update(range(k, k + window))
                    break
    return bool(gone), " ".join(w for k, w in enumerate(words) if k not in gone) if gone else text


def test_run_gives_what_the_stages_give(spark, tables):
    folder, _ = tables
    found = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"} == set(found.columns) and found.count() > 100
    assert removed([(1, "a b"), (2, "a b")])[0][2] == 0
