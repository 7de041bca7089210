"""Rows without ids, and many texts under one id, keep their own repeats."""

import random

import pytest

pytest.importorskip("public_tokenizers")
from test_texts import docs, removed  # noqa: E402

from phaseframe.llm.substring import dedup_substrings, without_repeats  # noqa: E402


@pytest.mark.parametrize("own", [None, 7])
def test_many_texts_under_one_id(spark, own):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(20)]
    rows = [(1, " ".join(passage))]
    for k in range(5_000):
        text = [word() for _ in range(30)]
        if k % 2:
            at = rng.randrange(31)
            text[at:at] = passage if k % 4 == 1 else [*passage[:15], word()]
        rows.append((own, " ".join(text)))
    found = dedup_substrings(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removed(rows)
    clean = {t for k, (_, t) in enumerate(rows) if k % 2 == 1}
    assert clean <= {r["text"] for r in without_repeats(docs(spark, rows)).collect()}
