"""The recurrent network against a plain reading of its definition, numeric derivatives and planted words."""

import re
import zlib

import numpy as np
import pytest

from signalcontext.llm import toxic_gru as g
from signalcontext.llm import wordbytes as wb


def joined(texts):
    rows = [t.encode() for t in texts]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def small_net(texts, kind):
    data, offsets = joined(texts)
    at, to, hashes, before = g.tokens(data, offsets)
    some = g.Distinct.of(data, at, to, hashes)
    return g.Net(np.sort(np.unique(hashes)[::2]), 0.3, kind=kind), some, g.windows(before)


def plain_logit(net, words):
    """One window, word by word, with no batch and no shared inputs."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    vectors = []
    for w in words:
        b = w.encode()
        h = wb.spans(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), wb._LOWER)[0]
        own = np.flatnonzero(net.vocabulary == h)
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
        grams = []
        for i in range(len(low)):
            for reach in (1, 2):
                v = reach
                for j in range(i - reach, i + reach + 1):
                    v = (v << 8) + (low[j] if 0 <= j < len(low) else 0)
                grams.append(net.p["gram"][int(wb.mix(np.array([v], np.uint64))[0]) % g.GRAMS])
        vectors.append(np.concatenate([net.p["word"][own[0]] if len(own) else np.zeros(g.WORD), np.mean(grams, axis=0)]))
    sides = []
    for d, order in ((0, vectors), (1, vectors[::-1])):
        s, states = np.zeros(g.HIDDEN), []
        for x in order:
            a, u = x @ net.p["x"][d] + net.p["bias"][d], s @ net.p["h"][d]
            r, z = sigmoid(a[:8] + u[:8]), sigmoid(a[8:16] + u[8:16])
            s = (1 - z) * np.tanh(a[16:] + r * u[16:]) + z * s
            states.append(s)
        sides.append(states[:: -1 if d else 1])
    both = np.concatenate([np.array(sides[0]), np.array(sides[1])], axis=1)
    e = np.exp(np.tanh(both @ net.p["look"] + net.p["look_bias"]) @ net.p["weigh"])
    return (e / e.sum()) @ both @ net.p["out"] + net.p["out_bias"][0]


def test_scores_equal_a_plain_reading():
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice(["Ab", "cdé", "x1", "longer", "ñu", "q"], n)) for n in (1, 5, 48, 49, 84, 85, 200)] + ["", "... !", "A.b,c"]
    net, _, _ = small_net(texts, np.float64)
    data, offsets = joined(texts)
    found = net.scores(data, offsets)
    for text, score in zip(texts, found):
        words = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text)
        parts = [words[:48]] + [words[k : k + 48] for k in range(36, len(words), 36) if k + 12 < len(words)]
        best = max((plain_logit(net, p) for p in parts if p), default=None)
        assert score == pytest.approx(net.share if best is None else 1 / (1 + np.exp(-best)), abs=1e-9)


def test_every_word_lies_in_a_window():
    for n in range(1, 400):
        row, first, length = g.windows(np.array([0, n]))
        assert set().union(*(range(a, a + m) for a, m in zip(first, length))) == set(range(n))
        assert (length == g.WINDOW)[:-1].all() and not row.any()


def test_gradients_equal_differences():
    net, some, (_, first, length) = small_net(["a bc def gh a bc", "zz a yy", "q"], np.float64)
    which = g._places(some, first, length)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        _, gates = net.inputs(some)
        z = net.forward(gates, which, length)
        return np.log1p(np.exp(-z * (2 * y - 1))).sum()

    x, gates = net.inputs(some)
    keep = []
    z = net.forward(gates, which, length, keep)
    found = net.backward(some, x, which, keep, 1 / (1 + np.exp(-z)) - y)
    r = np.random.default_rng(2)
    for name, value in net.p.items():
        flat, grad = value.reshape(-1), found[name].reshape(-1)
        for i in {*r.integers(0, len(flat), 6), *np.argsort(-np.abs(grad))[:6]}:
            if name == "word" and i >= len(flat) - g.WORD:
                continue  # words without a vector of their own stay at zero
            before = flat[i]
            flat[i] = before + 1e-5
            up = loss()
            flat[i] = before - 1e-5
            down = loss()
            flat[i] = before
            assert grad[i] == pytest.approx((up - down) / 2e-5, abs=1e-7), (name, i)


@pytest.fixture(scope="module")
def planted(spark):
    """Documents with a bad word in a third of them, and their labels."""
    r = np.random.default_rng(3)
    plain = ["".join(r.choice(list("abcdeé"), r.integers(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        words = list(r.choice(plain, r.integers(20, 160)))
        bad = i % 3 == 0
        if bad:
            words[r.integers(0, len(words))] = r.choice(["Rotten", "vile"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_rows(planted):
    docs, labels, truth = planted
    rows = g.scored(docs, g.learn(docs, labels)).collect()
    assert len(rows) == 900 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_labels_of_the_held_out_fold_are_not_learned(planted):
    docs, labels, _ = planted
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = g.sample(docs, labels, 50), g.sample(docs, other, 50)
    assert a[0] == b[0] and (a[1] == b[1]).all() and len(a[0]) == 50


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (4, ". ?", "x"), (4, "a", "y"), (4, "a", "y"), (5, "word " * 400_000, "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in g.scored(docs, g.learn(docs, none)).collect()] == [0.0] * 7
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0), (2, 0)], "doc_id long, toxic int")
    net = g.train([b"a b", b"c d", b". ?", b"e"] * 3, np.array([1.0, 0, 0, 0] * 3))
    rows = g.scored(docs, net).collect()
    assert len(rows) == 7 and [r.score for r in rows if r.doc_id in (1, 2)] == [0.25, 0.25]
    assert len({r.score for r in rows if r.doc_id == 4}) == 2
    assert g.scored(docs.limit(0), g.learn(docs.limit(0), labels)).count() == 0
    assert g.train([b"...", b""], np.array([1.0, 0.0])).scores(*joined(["a", ""])).tolist() == [1.0, 1.0]
