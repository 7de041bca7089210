"""Operators over texts against brute force and libraries, with nulls, ties, repeats, empty tables, odd columns."""

import hashlib
import random
import re

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ID string, `sig` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", " ", "\n\t", "a", "don't  stop's 'll x", "Été ça İstanbul ſ ﬁ", "<|endoftext|> <|endoftext|>a", "中文 текст 123 ½²", "áë   x", "!!!'s 'S 12ab"]


def docs(spark, rows):
    full = [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeTé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(30)
    out = [text(rng.randint(0, 80)) for _ in range(n)]
    for k in range(0, n, 4):
        out[k] = f"{out[k]} {passage} {text(3)}"
    for k in range(1, n, 9):
        w = out[0].split()
        w[rng.randrange(len(w))] = "edit"
        out[k] = " ".join(w)
    out[2] = out[0]
    return list(enumerate([*out, *ODD, None, None, "long " * 20_000], start=1)) + [(1, out[0]), (None, out[0])]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    docs(spark, corpus()).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(table):
    return [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]


def test_token_counts(table):
    from tokenizers import Tokenizer

    from phaseframe.llm.token_counts import count_tokens, fit_at, prefix_table, tokens_at

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    expected = sorted((str(i), len((t or "").encode()), count(t or "")) for i, t in rows_of(table))
    found = count_tokens(table, path, 20).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 20) for r in found)
    short = table.where("doc_id > 60 and length(text) < 60")
    for r in prefix_table(short, path).select("doc_id", "prefix_tokens", fit_at("prefix_tokens", 3).alias("fit"), tokens_at("prefix_tokens", 4).alias("four")).collect():
        text = dict(rows_of(short))[r["doc_id"]]
        counts = [count(text[:k]) for k in range(len(text) + 1)]
        assert r["prefix_tokens"] == counts and r["fit"] == max(k for k, c in enumerate(counts) if c <= 3) and r["four"] == counts[min(4, len(text))]
    assert count_tokens(table.limit(0), path).count() == 0


def test_bpe(table):
    from tokenizers import Tokenizer

    from phaseframe.llm.bpe import decode, encode

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected, texts = [], {}
    for i, t in rows_of(table):
        ids = library.encode(t or "", add_special_tokens=False).ids
        texts[i] = library.decode(ids, skip_special_tokens=False)
        expected.append((str(i), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[i].encode())))
    found = encode(table, path, keep_ids=True, chunk_bytes=5_000).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == sorted(expected)
    some = encode(table.where("doc_id between 5 and 9"), path, keep_ids=True)
    assert {r["doc_id"]: r["decoded"] for r in decode(some, path).collect()} == {i: texts[i] for i in range(5, 10) if texts[i]}
    assert encode(table.limit(0), path).count() == 0


def shingles(t, size):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def smallest_of_groups(rows, size=4):
    """Smallest id reachable over pairs with 100 * common >= 80 * all, by all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def test_near_duplicates(table):
    from phaseframe.llm.minhash import near_duplicates

    rows = rows_of(table)
    roots = smallest_of_groups(rows)
    found = near_duplicates(table, 4, 0.8).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None:
            assert r["component_id"] == roots[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] in {len(shingles(t, 4)) for i, t in rows if i == r["doc_id"]}
        else:
            assert r["kept"] and r["component_id"] is None
    assert near_duplicates(table.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    from phaseframe.llm.minhash import first_of_groups

    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"x{i}_{rng.random()}"
        rows.append((i, " ".join(w)))
    left = first_of_groups(docs(spark, rows), 4, 0.8)
    roots = smallest_of_groups(rows)
    assert left.columns == docs(spark, rows).columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(roots.values()))


def removed(rows, window=13):
    """Per row: kept words."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone.update(range(k, k + window))
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(table):
    from phaseframe.llm.substring import dedup_substrings, without_repeats

    found = dedup_substrings(table).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removed(rows_of(table))
    left = without_repeats(table)
    assert left.columns == table.columns and left.dtypes == table.dtypes
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.collect())
    assert dedup_substrings(table.limit(0)).count() == 0


def test_decontamination(spark, table):
    from phaseframe.llm.decontam import clean, leaks

    words = [f"q{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    item = "In town Anna bought 5 apples and Anna paid 7 dollars for 5 apples " + " ".join(words[:20])
    same = item.replace("Anna", "Bob").replace("5", "9").replace("7", "8")
    unlike = same.replace("for 9", "for 4")
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "two words", "x"), (5, " ".join(words[30:34]), "x")], "item_id long, text string, doc_id string")
    filler = " ".join(words[50:])
    rows = [(1, f"{filler}. {item} {filler}"), (2, f"{filler}. {same}"), (3, f"{filler}. {unlike[:66]}"), (4, filler), (5, None), (6, ""), (7, f"zz {' '.join(words[30:34])} yy"), (None, item), (1, filler)]
    found = {(r["doc_id"], r["item_id"]): r["exact"] for r in leaks(docs(spark, rows), bench).collect()}
    assert found == {(1, 1): True, (2, 1): False, (7, 5): True}
    left = clean(docs(spark, rows), bench)
    assert left.columns == table.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "4", "5", "6", "None"]
    assert leaks(docs(spark, rows), bench.limit(0)).count() == 0 and leaks(docs(spark, rows).limit(0), bench).count() == 0


def test_quality(spark):
    from phaseframe.llm.common import fold_of
    from phaseframe.llm.quality import accepted, classify

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        text = " ".join(rng.choice(words) for _ in range(40)) if good else "THE!! " * rng.randint(5, 30)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (None, "x"), (5, rows[5][1])]
    labels += [(None, 1, 0), (7, None, 0), (9, 0, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = classify(docs(spark, rows), marks).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(held) > 40 and sum(r["predicted"] == (r["doc_id"] % 3 != 0) for r in held) >= 0.97 * len(held)
    left = accepted(docs(spark, rows), marks)
    assert left.columns == docs(spark, rows).columns and left.where("doc_id < 400 and doc_id % 3 <> 0").count() >= 255
    assert classify(docs(spark, rows), marks.limit(0)).where("score <> 0.5").count() == 0
    assert classify(docs(spark, rows).limit(0), marks).count() == 0
    assert docs(spark, [(3, "")]).select(fold_of("doc_id", 5)).first()[0] == __import__("zlib").crc32(b"3") % 5


def test_language(spark):
    from phaseframe.llm.langid import identify

    rng = random.Random(3)
    kinds = {"aa": ["the", "ing", "tion", "her"], "bb": ["eau", "é", "que", "oi"], "cc": ["sch", "ung", "ü", "keit"]}
    rows = []
    for i in range(240):
        lang = sorted(kinds)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 40))), lang))
    rows += [(900, None, "aa"), (901, "12 !?", "aa"), (902, "", None), (None, "the tion", "bb"), (903, "sch", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in identify(frame).collect()}
    held = [r for i, r in found.items() if i is not None and i < 240 and r["held_out"]]
    assert len(held) > 30 and sum(r["lang_pred"] == sorted(kinds)[r["doc_id"] % 3] for r in held) >= 0.95 * len(held)
    assert [found[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in found.values())
    assert {r["lang_pred"] for r in identify(frame.where("doc_id = 900")).collect()} == {"und"} and identify(frame.limit(0)).count() == 0


def test_lm_scores(spark):
    from phaseframe.llm.lm_score import score

    rng = random.Random(4)
    follow = {w: [f"w{(w * 7 + k) % 40}" for k in range(2)] for w in range(40)}
    rows = []
    for i in range(150):
        w, out = rng.randrange(40), []
        for _ in range(120):
            out.append(f"w{w}")
            w = int(rng.choice(follow[w])[1:])
        rows.append((i, " ".join(out)))
    mixed = rows[0][1].split()
    rng.shuffle(mixed)
    rows += [(500, " ".join(mixed)), (501, None), (502, ""), (0, rows[0][1]), (None, "w1")]
    found = score(docs(spark, rows), rounds=3, stride=1).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[0]["mean_log_likelihood"] > by[500]["mean_log_likelihood"] + 0.2
    assert by[501]["n_words"] == 0 and by[502]["log_likelihood"] == 0 and by[501]["mean_log_likelihood"] is None
    twice = [r["log_likelihood"] for r in found if r["doc_id"] == 0]  # single precision, in different batches
    assert twice[0] == pytest.approx(twice[1], rel=1e-6) and score(docs(spark, rows).limit(0)).count() == 0


def test_lm_learns_from_short_texts(spark):
    from phaseframe.llm.lm_score import score

    rng = random.Random(6)
    pairs = [("red", "fox"), ("old", "cat"), ("big", "dog"), ("shy", "owl")]
    rows = [(i, " ".join(w for _ in range(rng.randint(1, 4)) for w in pairs[i % 4])) for i in range(4000)]
    rows += [(i, pairs[i % 4][0]) for i in range(4000, 4100)]
    rows += [(9000, "red fox"), (9001, "red dog")]
    by = {r["doc_id"]: r["mean_log_likelihood"] for r in score(docs(spark, rows)).where("doc_id >= 9000").collect()}
    assert by[9000] > by[9001] + 0.2


def test_near_duplicates_of_repeated_ids(spark):
    from phaseframe.llm.minhash import near_duplicates

    rng = random.Random(8)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (5, a + " z"), (6, b + " z"), (7, c), (9, c + " z"), (9, None), (9, c + " z"), (None, a), (None, c), (3, c), (3, "other words than those")]
    found = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_duplicates(docs(spark, rows), 4, 0.8).where("n_shingles > 0 or doc_id is null").collect())
    roots = smallest_of_groups(rows)
    assert found == sorted((str(i), roots.get(i), i is None or roots[i] == i) for i, t in rows if t)


def test_windows_of_other_sizes(spark):
    from phaseframe.llm.substring import dedup_substrings

    rows = corpus(3, 20)[:24]
    for window in (4, 200):
        found = dedup_substrings(docs(spark, rows), window).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removed(rows, window)
    for window in (3, 257):
        with pytest.raises(ValueError):
            dedup_substrings(docs(spark, rows), window)


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.8, 0.894])
def test_near_duplicates_at_other_similarities(spark, similarity):
    """Pairs at, above and under the line, at any similarity; 0.894 is not 0.89."""
    from fractions import Fraction

    from phaseframe.llm.minhash import near_duplicates, threshold_for

    rng = random.Random(5)
    rows, pairs, share = [], [], Fraction(str(similarity))
    for k in range(120):
        both = rng.randint(20, 120)
        total = int(both / share) + rng.choice([-2, -1, 0, 0, 1, 2])
        total = max(total, both)
        left = rng.randint(0, total - both)
        word = lambda j, k=k: f"w{k}x{j}"
        a = [word(j) for j in range(both + left)]
        b = [word(j) for j in range(both)] + [word(1000 + j) for j in range(total - both - left)]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        pairs.append(share.denominator * both >= share.numerator * total)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, rows), 1, similarity).collect()}
    assert [found[2 * k + 1] == 2 * k for k in range(120)] == pairs and 20 < sum(pairs) < 115
    assert threshold_for(0.8) == 33


def test_ids_of_other_types(spark):
    """An error that names the column, not a failure somewhere in a task; the largest id is an id like any other."""
    from phaseframe.llm.decontam import leaks
    from phaseframe.llm.minhash import near_duplicates
    from phaseframe.llm.substring import dedup_substrings

    texts = spark.createDataFrame([("a", "x y z")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    for call in (lambda: near_duplicates(texts), lambda: dedup_substrings(texts), lambda: leaks(texts, items)):
        with pytest.raises(ValueError, match="doc_id must be of an integer type"):
            call()
    last = (1 << 63) - 1
    found = dedup_substrings(docs(spark, [(last, "a b c"), (None, "d e")])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in found) == [(False, last), (True, None)]
