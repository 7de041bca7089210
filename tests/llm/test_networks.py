"""The trained models against plain walks: gradients by differences, distributions node by node and step by step."""

import math
import random

import numpy as np
import pytest

from phaseframe.llm import langid as L
from phaseframe.llm import lm_score as M
from phaseframe.llm import quality as Q


def small_network(seed=1):
    net = L.Network(["aa", "bb", "cc"], seed)
    rng = np.random.default_rng(seed)
    net.bias = rng.normal(size=3).astype(np.float32)
    return net


def plain_distribution(net, raw):
    """Mean distribution over the bytes, one byte at a time."""

    def walk(way, symbols):
        h, out = np.zeros(L.HIDDEN), []
        for s in symbols:
            x, g = way.table[s].astype(float), h @ way.inner.astype(float)
            n = L.HIDDEN
            z, r = 1 / (1 + np.exp(-(x[:n] + g[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + g[n : 2 * n])))
            new = np.tanh(x[2 * n :] + r * g[2 * n :])
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    ahead, behind = walk(net.ways[0], raw), walk(net.ways[1], raw[::-1])[::-1]
    total = np.zeros(3)
    for a, b in zip(ahead, behind, strict=True):
        z = np.concatenate([a, b]) @ net.out + net.bias
        total += np.exp(z) / np.exp(z).sum()
    return total / max(1, len(raw))


def test_pooled_distributions_step_by_step():
    net, rng = small_network(), random.Random(2)
    texts = [bytes(rng.choice(b"abcdef \xc3\xa9") for _ in range(n)) for n in (0, 1, 3, 64, 65, 700, 2047, 2048, 2049, 2300, 5000)]
    rng.shuffle(texts)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    found = net.pooled(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for row, text in zip(found, texts, strict=True):
        assert row == pytest.approx(plain_distribution(net, text), abs=1e-4)


def test_recurrent_gradients_by_differences():
    net, rng = small_network(3), np.random.default_rng(4)
    for way in net.ways:
        way.table, way.inner = way.table.astype(np.float64), way.inner.astype(np.float64)
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    data = rng.integers(97, 101, (2 * L.STEP, 4)).astype(np.uint8)
    live = np.arange(2 * L.STEP)[:, None] < np.array([128, 100, 40, 3])[None, :]
    labels, h = np.array([0, 1, 2, 1]), np.zeros((4, L.HIDDEN))
    _, grads, _ = net.loss_gradients(data, live, labels, h)
    for weight, grad in zip(net.weights, grads, strict=True):
        for at in [tuple(rng.integers(0, s) for s in weight.shape) for _ in range(6)] + [np.unravel_index(np.argmax(np.abs(grad)), grad.shape)]:
            kept, step = weight[at], 1e-3
            weight[at] = kept + step
            up = net.loss_gradients(data, live, labels, h)[0]
            weight[at] = kept - step
            down = net.loss_gradients(data, live, labels, h)[0]
            weight[at] = kept
            assert grad[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def test_trees_node_by_node():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x, y, trees=20)
    new = rng.normal(size=(50, 6))
    binned = model.bins(new)
    for row, score in zip(binned, model.scores(new), strict=True):
        margin = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            margin += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + math.exp(-margin)))
    assert ((model.scores(x) > 0.5) == (y > 0.5)).mean() > 0.95


def window_network(seed=7, groups=32):
    rng = np.random.default_rng(seed)
    return M.Network([rng.normal(0, 0.3, s) for s in M.Network.shapes(groups)])


def test_window_log_probabilities_by_plain_softmax():
    net, rng = window_network(), np.random.default_rng(8)
    words, context = rng.integers(0, net.edge, 40), rng.integers(0, net.edge + 1, (40, 2 * M.SIDE))
    found = net.log_probabilities(context, words)
    for w, c, value in zip(words, context, found, strict=True):
        h = np.tanh(net.weights[1] + sum(net.weights[0][j * (net.edge + 1) + x] for j, x in enumerate(c)))
        group = h @ net.weights[2] + net.weights[3]
        inner = [h @ net.weights[4][g] + net.weights[5][g] for g in range(net.groups)]
        every = np.concatenate([group[g] - np.log(np.exp(group).sum()) + z - np.log(np.exp(z).sum()) for g, z in enumerate(inner)])
        assert np.exp(every).sum() == pytest.approx(1) and value == pytest.approx(every[w])


def test_window_gradients_by_differences():
    net, rng = window_network(9), np.random.default_rng(10)
    words, context = rng.integers(0, net.edge, 30), rng.integers(0, net.edge + 1, (30, 2 * M.SIDE))
    used, grads = net.gradients(context, words)
    whole = [np.zeros_like(net.weights[0]), *grads[1:]]
    whole[0][used] = grads[0]
    for weight, grad in zip(net.weights, whole, strict=True):
        for at in [np.unravel_index(k, grad.shape) for k in np.argsort(-np.abs(grad), axis=None)[:3]]:
            kept = weight[at]
            values = []
            for step in (1e-5, -1e-5):
                weight[at] = kept + step
                values.append(-net.log_probabilities(context, words).mean())
            weight[at] = kept
            assert grad[at] == pytest.approx((values[0] - values[1]) / 2e-5, rel=1e-3)


def test_scores_of_a_table_one_word_at_a_time(spark, monkeypatch):
    """The score of each text is the sum of the network's log-probabilities and of shares of rare words in their classes."""
    from collections import Counter

    from phaseframe.llm import textscan

    seen = []
    train = M.train
    monkeypatch.setattr(M, "train", lambda *a, **k: seen.append(train(*a, **k)) or seen[-1])
    rng = random.Random(11)
    often = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(often) if rng.random() < 0.7 else f"{rng.choice('aB')}{rng.randrange(3000)}" for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in M.score(frame).collect()}
    words, net, totals = seen[0]
    counts = Counter(w for t in texts for w in (t or "").split())

    def number(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        one = textscan.Words(raw, np.array([0, len(raw)]))
        return int(words.of(one, one.hashes())[0])

    numbers = {w: number(w) for w in counts}
    rare = {w: n - words.first_class for w, n in numbers.items() if n >= words.first_class}
    assert len(rare) > 100 and sum(totals) == sum(counts[w] for w in rare)
    for i, t in enumerate(texts):
        own = (t or "").split()
        around = [[numbers[own[k + s]] if 0 <= k + s < len(own) else net.edge for s in (-2, -1, 1, 2)] for k in range(len(own))]
        total = sum(net.log_probabilities(np.array([c]), np.array([numbers[w]]))[0] for c, w in zip(around, own, strict=True))
        total += sum(math.log(counts[w] / totals[rare[w]]) for w in own if w in rare)
        assert found[i]["log_likelihood"] == pytest.approx(total, rel=1e-4, abs=1e-4) and found[i]["n_words"] == len(own)


def test_scores_do_not_depend_on_partitions(spark):
    """The network is the same however rows are split and ordered; scores agree to single precision."""
    rng = random.Random(12)
    often = [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choice(often) if rng.random() < 0.8 else f"x{rng.randrange(4000)}" for _ in range(rng.randint(0, 600))) for _ in range(700)]
    rows = [*enumerate(texts), (None, texts[3]), (None, None), (7, texts[7]), (7, "")]
    assert M.shards_for(sum(len(t.split()) for t in texts)) > 1

    def scored(rows, parts):
        found = M.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["mean_log_likelihood"] or 0.0) for r in found)

    first = scored(rows, 1)
    for parts in (8, 64):
        rng.shuffle(rows)
        for a, b in zip(first, scored(rows, parts), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-4)


def test_shards_follow_the_number_of_words():
    assert [M.shards_for(n) for n in (0, 1 << 15, 1 << 17, 1 << 20, 1 << 24, 1 << 26, 1 << 32)] == [1, 1, 4, 8, 8, 16, 1024]
