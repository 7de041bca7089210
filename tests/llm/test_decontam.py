"""Slots that disagree, values that fall together, items of numbers and names."""

import pytest

pytest.importorskip("public_tokenizers")
from test_texts import docs  # noqa: E402

from phaseframe.llm.decontam import largest_part, leaks  # noqa: E402

SHOP = "a farmer has 3 baskets of ripe apples and buys another 5 baskets of green pears today before he sells 3 baskets at the market"


def test_slots_that_disagree(spark):
    items = [(1, SHOP), (2, "Compute 12 + 7"), (3, "Anna Berta Clara Dora Emil Frida Gustav Hanna")]
    rows = [
        (1, SHOP.replace("3", "4").replace("5", "4")),  # two values become one
        (2, SHOP.replace("sells 3", "sells 8")),  # one of two occurrences
        (3, "so it says. Compute 12 + 7 and go on"),
        (4, "so it says. Compute 12 + 8 and go on"),
        (5, "list of names: Anna Berta Clara Dora Emil Frida Gustav Hanna and others"),
        (6, "list of names: Rosa Berta Udo Dora Karl Frida Max Hanna and others"),
        (7, SHOP),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["exact"], r["coverage"]) for r in leaks(docs(spark, rows), bench).collect()}
    assert set(found) == {(1, 1), (2, 1), (3, 2), (5, 3), (7, 1)}
    assert found[7, 1] == (True, 1.0) and not found[1, 1][0] and found[1, 1][1] == 1.0 and found[2, 1][1] < 1


def test_largest_part():
    same, other = ("#5", "#5"), ("#5", "#9")
    assert largest_part([(0, (other,)), (1, (same,)), (2, (same,)), (3, (same, other)), (4, ())], 6) == [(1, (same,)), (2, (same,)), (4, ())]
    both = (("#3", "#4"), ("#5", "#4"))
    assert largest_part([(0, both)], 6) == [(0, both)] and largest_part([(0, both)], 3) == []
    many = [(k, ((f"#{k % 12}", f"#{k // 12}"),)) for k in range(36)]
    assert len(largest_part(many, 6)) == 12


def agreeing(windows):
    own = {}
    return all(own.setdefault(s, v) == v for _, pairs in windows for s, v in pairs)


def test_largest_part_against_all_subsets():
    """Whatever the number of values, no part that agrees is larger."""
    import itertools
    import random

    rng = random.Random(8)
    for case in range(250):
        slots = [f"#{k}" for k in range(rng.randint(2, 7))]
        windows = [(k, tuple((s, f"#{rng.randint(0, 5)}") for s in rng.sample(slots, rng.randint(0, min(3, len(slots)))))) for k in range(rng.randint(1, 11))]
        most = next(n for n in range(len(windows), -1, -1) if any(agreeing(c) for c in itertools.combinations(windows, n)))
        found = [w for w in windows if len(dict(w[1])) == len(set(w[1]))]
        from phaseframe.llm.decontam import _agreeing_most

        part = [found[k] for k in _agreeing_most(found, list(range(len(found))))]
        assert agreeing(part) and len(part) == most, case


def test_many_values_stay_quick():
    import random

    rng = random.Random(9)
    windows = [(k, tuple((f"#{(k // 3 + j) % 30}", f"#{rng.choice([k // 3 + j, 77])}") for j in range(2))) for k in range(120)]
    assert agreeing(largest_part(windows, 6)) and len(largest_part(windows, 6)) > 40


def brute_force(rows, items, window=6, coverage=0.5):
    """(doc, item): windows found and share of the item's words under them, for texts of plain lower-case words."""
    out = {}
    for item, text in items:
        own = text.split()
        size = min(window, len(own))
        if size < 3:
            continue
        for doc in {d for d, _ in rows if d is not None}:
            runs = {tuple(w[k : k + size]) for d, t in rows if d == doc for w in [(t or "").split()] for k in range(len(w) - size + 1)}
            places = [k for k in range(len(own) - size + 1) if tuple(own[k : k + size]) in runs]
            covered = {x for k in places for x in range(k, k + size)}
            if places and len(covered) / len(own) >= coverage:
                out[doc, item] = (len(places), round(len(covered) / len(own), 6))
    return out


def test_plain_words_by_brute_force(spark):
    import random

    rng = random.Random(31)
    words = [f"w{chr(97 + k)}" for k in range(5)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randint(1, 16))) for k in range(40)]
    rows = [(k % 50, text(rng.randint(0, 60))) for k in range(60)] + [(60 + k, f"{text(9)} {items[k][1]} {text(9)}") for k in range(40)] + [(None, items[0][1]), (200, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_windows"], round(r["coverage"], 6)) for r in leaks(docs(spark, rows), bench).collect()}
    assert found == brute_force(rows, items) and len(found) > 50
