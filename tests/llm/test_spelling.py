"""Spelling variants against all pairs of words on a small fixture."""

import random
import re
import zlib
from collections import Counter

from signalcontext.llm import spelling_variants as v

SCHEMA = "doc_id long, text string, n string, word string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, count = {}, {}
    for w in n:
        others = sorted((o for o in n if near(w, o)), key=lambda o: (-n[o], o))
        count[w] = len(others)
        form[w] = others[0] if others and n[others[0]] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in n}


def held(spark, rows):
    got = v.variants(spark.createDataFrame(rows, SCHEMA)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in got}) == len(got)
    assert {tuple(r) for r in got} == plain(rows)
    return {r.word: r for r in got}


def test_all_pairs(spark):
    r = random.Random(5)
    words = {"".join(r.choice("abé") for _ in range(r.randint(4, 9))) for _ in range(500)} | {"a" * k for k in range(4, 12)} | {"abcde" + "f" * k for k in range(6)}
    words = sorted(words)
    rows = [(i, " ".join(r.choice(words).upper() if r.random() < 0.1 else r.choice(words[: 40 + i]) for _ in range(60)), "x", "y") for i in range(150)]
    got = held(spark, rows)
    assert sum(x.n_near for x in got.values()) > 300 and any(x.form for x in got.values())


def test_chain_ties_and_letters(spark):
    text = "abcde " * 3 + "abcdef " * 6 + "abcdeff " * 12 + "Àbcde " * 3 + "àbcde " * 3 + "zzzzy " * 3 + "zzzzb " * 6 + "zzzza " * 6 + "a×÷bc " * 4
    got = held(spark, [(3, text, "x", "y")])
    assert got["abcde"].root == "abcdeff" and got["zzzzy"].form == "zzzza" and "Àbcde" in got and "a×÷bc" in got


def test_edges(spark):
    long = "q" * 70_000
    rows = [(None, "wordy wordy", "x", "y"), (1, None, "x", "y"), (2, "", "x", "y"), (3, "1 2 ...", "x", "y"), (None, "wordy", "x", "y"), (None, "wordy", "x", "y")]
    assert held(spark, rows)["wordy"].n == 4
    got = v.variants(spark.createDataFrame([(i, f"{long} {long}z", "x", "y") for i in range(4)], SCHEMA)).collect()
    assert [(len(r.word), r.n, r.n_near) for r in sorted(got, key=lambda r: r.word)] == [(70_000, 4, 1), (70_001, 4, 1)]
    assert v.variants(spark.createDataFrame([], SCHEMA)).count() == 0
