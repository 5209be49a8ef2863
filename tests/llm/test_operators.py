"""Operators against brute force on small tables with nulls, ties, repeats, long texts and clashing columns."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from signalcontext.llm import chat_snapshots, decontamination, encoding, jaccard_join, language_id, license_rules, masked_lm, packing, quality_trees, robust_outliers, token_counts
from signalcontext.llm import wordbytes as wb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", score double, component_id long, n long"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(3, 120)) for _ in range(25)]
    out = [(i, t, "en" if i % 3 else "fr", f"s{i % 2}", len(t)) for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):
        w = t.split()
        w[rng.randrange(len(w))] = "CHANGED"
        out.append((100 + i, " ".join(w), "en", "s0", 0))
        out.append((200 + i, t.upper(), None, None, 0))
    long = words(rng, 20000, 5000)
    return out + [(300, None, "en", "s0", 0), (301, "", "en", "s0", 0), (302, " \n\t ", "en", "s1", 0), (303, long, "en", "s1", 0), (304, long + " x", "en", "s1", 0), (304, long + " x", "en", "s1", 0), (None, base[0], "en", "s0", 0), (305, "one", None, "s0", 0), (307, "text <|endoftext|> and<|endoftext|>", "en", "s0", 0), (306, "one", None, "s0", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows], EXTRA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(d, shingle_set(t)) for d, t, *_ in rows if d is not None]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def test_jaccard(docs, rows, empty):
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute_components(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.jaccard_components(empty).collect() == []


def test_jaccard_group_of_near_copies(spark):
    rng = random.Random(2)
    base, rows = words(rng, 60).split(), []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_jaccard_lists_with_components_that_do_not_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW_PAIRS", 0)
    rng = random.Random(5)
    base, rows = words(rng, 120).split(), []
    for i in range(70):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 5, 6, 9])):
            w[rng.randrange(120)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w[: rng.choice([120, 120, 100, 90])]), "en", "s", 0))
    want = brute_components(rows)
    assert 1 < len({c for _, _, c in want}) < 60
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == want


def test_jaccard_beyond_sent_ids_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SENT_IDS", 0)
    rng = random.Random(12)
    base, rows = words(rng, 60).split(), []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    want = brute_components(rows)
    rows += [rows[3], rows[3]]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(set(map(tuple, got))) == want and len(got) == 42
    # One id on two texts is one document.
    a, b = words(rng, 30, 900), words(rng, 30, 900)
    twice = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, a + " x", "en", "s", 0), (3, b + " y", "en", "s", 0), (4, "", "en", "s", 0), (4, b + " z", "en", "s", 0)]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(twice, SCHEMA)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_light_boundary_is_the_cheapest():
    def p1(n):
        return n - (75 * n + 99) // 100 + 1

    rng = random.Random(3)
    for _ in range(30):
        histogram, mean = {rng.randrange(1, 400): rng.randrange(1, 50) for _ in range(20)}, rng.choice([0.5, 3, 20, 200])

        def cost(x):
            light = sum(c * (p1(n) + 1) * p1(n) // 2 for n, c in histogram.items() if n <= x)
            return light + sum(c * p1(n) * (1 + mean * (n > x)) for n, c in histogram.items() if 100 * n > 75 * x)

        assert cost(jaccard_join.light_boundary(histogram, mean)) == pytest.approx(min(cost(x) for x in [0, *histogram]))


def test_long_text_in_bounded_memory():
    """Hashing 20 MB in one row takes a small multiple of it."""
    import tracemalloc

    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"abcdefg hij klm", np.uint8), 20_000_000)
    tracemalloc.start()
    h, before = wb.words(data, np.array([0, len(data)]))
    s, _ = wb.shingles(h, before)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 260e6 and len(h) == len(data.tobytes().split())
    part = data[:700_001]
    near = np.array([0, 0, len(part)])
    assert (wb.words(part, near)[0] == wb.words(part, np.array([0, len(part)]))[0]).all() and set(wb.shingles(*wb.words(part, near))[0]) == set(wb.shingles(*wb.words(part, np.array([0, len(part)])))[0])
    long = np.concatenate([np.frombuffer(b"x " * 100_000, np.uint8), np.full(900_000, 97, np.uint8), np.frombuffer(b" yes", np.uint8)])
    assert wb.words(long, np.array([0, len(long)]))[0][-1] == wb.words(np.frombuffer(b"yes", np.uint8), np.array([0, 3]))[0][0]
    assert wb.words(long, np.array([0, len(long)]))[0][-2] == wb.words(np.full(900_000, 97, np.uint8), np.array([0, 900_000]))[0][0]


def test_keep_one_of_frames_with_few_and_odd_columns(spark):
    rows = [(1, "a b c d e f", {"k": 1}, 5), (1, "a b c d e f", {"k": 2}, 5), (2, "a b c d e f", {"k": 3}, 5), (None, None, None, None)]
    left = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, _one long"))
    assert left.columns == ["doc_id", "text", "m", "_one"] and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1]


def test_keep_one(docs):
    left = jaccard_join.keep_one(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert len(ids) == len(set(ids)) and 304 not in ids and 303 in ids and 300 in ids


def test_shingle_hash_does_not_depend_on_place():
    text = "Alpha beta\tgamma delta epsilon zeta"
    a = pa.array(["x " * 50, text, None, "", text])
    found = [set(h[r == i].tolist()) for _, _, d, o in wb.steps(a) for h, r in [wb.shingles(*wb.words(d, o))] for i in (1, 4)]
    assert found[0] == found[1] and len(found[0]) == 2


def test_encoding_is_the_tokenizers(rows):
    from tokenizers import Tokenizer

    path = encoding.public_vocabulary()
    rng = random.Random(1)
    signs = [" ", "\n", "\t", "a", "é", "'", "'s", "1", "²", ".", ",", "!", "日", "́", "　", " ", "_", "Ab", "<|endoftext|>", "»", "×"]
    texts = [r[1] for r in rows if r[1] is not None] + ["".join(rng.choice(signs) for _ in range(rng.randrange(15))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "x<|endoftext|><|endoftext|>\u3000y", "<|endoftext|>", "<|endoftext"]
    for named in (True, False):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = not named
        got = []
        for first, end, ids, before in encoding.encoded(pa.record_batch([pa.array(texts)], names=["text"]), path, named):
            got += [ids[before[i] : before[i + 1]].tolist() for i in range(end - first)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoding_of_a_long_text_in_parts(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    signs = [" ", "  ", "\n", "\n\n", "\t", "word", "Ünï", "'s", "12", ",", "!", "日本", "<|endoftext|>", " a"]
    text = "".join(rng.choice(signs) for _ in range(6000)) + "x" * 3000
    path = encoding.public_vocabulary()
    monkeypatch.setattr(encoding, "STEP_BYTES", 500)
    [(_, _, ids, _)] = encoding.encoded(pa.record_batch([pa.array([text])], names=["text"]), path)
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packing(docs, rows, empty):
    got = packing.pack(docs).toPandas()
    assert sorted(got.groupby("doc_id").length.sum()[lambda s: s.index != 304]) == sorted(got.drop_duplicates("doc_id").query("doc_id != 304 and doc_id == doc_id").doc_tokens)
    for _, w in got.groupby("sequence_id"):
        w = w.sort_values("offset")
        assert (w.offset == w.length.cumsum() - w.length).all() and w.length.sum() <= 1024
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.public_vocabulary())
    for d, text, *_ in rows:
        if d is None or d == 304:
            continue
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        mine = got[got.doc_id == d].sort_values("start")
        assert (mine.start == mine.length.cumsum() - mine.length).all() and mine.length.sum() == len(ids)
        for r in mine.itertuples():
            assert zlib.crc32(ids[int(r.start) : int(r.start + r.length)].tobytes()) == r.ids_crc32
    assert packing.pack(empty).count() == 0


def test_differencing():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 200) for _ in range(200)]
    found = packing.windows(sizes, 1024)
    assert sorted(i for w in found for i in w) == list(range(200))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) <= 1024 and max(sums) - min(sums) < 40 and len(found) <= -(-sum(sizes) // 1024) + 1


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.public_vocabulary())
    n = [len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    sums = token_counts.with_sums(token_counts.length_histogram(docs))
    for r in sums.collect():
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n) and r.docs_at_least == sum(x >= r.n_tokens for x in n) and r.tokens_total == sum(n)
    assert token_counts.truncated_total(sums, 77) == sum(min(x, 77) for x in n)
    assert token_counts.quantile(sums, 0.5) == sorted(n)[-(-len(n) // 2) - 1]
    assert token_counts.with_sums(token_counts.length_histogram(empty)).count() == 0


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination(spark, docs, empty):
    rng = random.Random(4)
    items = [(i, words(rng, 25, 3000)) for i in range(6)] + [(90, None), (91, ""), (92, "tiny item")]
    texts = []
    for i, t in items[:6]:
        for edits in (0, 3, 9, 14, 40):
            c = list(t)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice("abcdefgh ")
            texts.append((1000 * i + edits, words(rng, 30) + " " + "".join(c).upper() + ", " + words(rng, 30), "en", "s", 0))
    texts += [(7777, None, "en", "s", 0), (7778, "has a TINY, item in it", "en", "s", 0)]
    frame, bench = spark.createDataFrame(texts, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t, *_ in texts:
        for i, item in items:
            a, b = decontamination.normal(item), decontamination.normal(t)
            if a and b and (n := edit_distance(a, b)) <= decontamination.budget(a):
                want.append((d, i, n))
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontamination.matches(frame, bench).collect()) == sorted(want)
    gone = {d for d, _, _ in want}
    assert {r.doc_id for r in decontamination.apply(frame, bench).collect()} == {t[0] for t in texts} - gone
    assert decontamination.apply(docs, bench.limit(0)).count() == docs.count() and decontamination.matches(empty, bench).count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(6)
    vocab = {"aa": "kataro milu senki dopa", "bb": "strung vlecht prozd grumf"}
    make = lambda l, n: " ".join(rng.choice(vocab[l].split()) for _ in range(n))
    train = [(i, make("aa" if i % 2 else "bb", 20), "aa" if i % 2 else "bb", "s", 0) for i in range(60)]
    model = language_id.learn(spark.createDataFrame(train, SCHEMA))
    mixed = make("aa", 10) + " " + make("bb", 30)
    test = [(1, make("aa", 9), None, None, 0), (2, mixed, None, None, 0), (3, None, None, None, 0), (4, "12 345 !", None, None, 0), (5, "", None, None, 0), (6, "Ω", None, None, 0)] + [(10 + i, t, None, None, 0) for i, t in enumerate(("١٢٣ ٤٥٦", "१२३", "๑๒๓", "・・", "؟"))]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(test, SCHEMA), model, spans=True).collect()}
    assert got[1]._lang_pred == "aa" and got[2]._lang_pred == "bb" and [s.lang for s in got[2]._lang_spans] == ["aa", "bb"]
    assert [(got[k]._lang_pred, got[k]._lang_score) for k in (3, 4, 5, *range(10, 15))] == [("und", 0)] * 8 and got[6]._lang_pred in vocab and got[6]._lang_score < 0.55 and got[2]._lang_score < 1
    assert language_id.apply(docs).columns == docs.columns
    assert language_id.apply(empty).count() == 0


def test_viterbi():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s = rng.normal(0, 3, (7, 3))
        best = max((sum(s[i, p[i]] for i in range(7)) - 2.5 * sum(a != b for a, b in zip(p, p[1:])) for p in np.ndindex(*[3] * 7)))
        p = language_id.viterbi(s, 2.5)
        assert abs(sum(s[i, p[i]] for i in range(7)) - 2.5 * sum(a != b for a, b in zip(p, p[1:])) - best) < 1e-9


def test_labels_short_cut_agrees_with_viterbi():
    rng = np.random.default_rng(2)
    rows = np.repeat([0, 2, 3], [40, 5, 60])
    scores = rng.normal(0, 4, (105, 3)) + np.repeat(rng.normal(0, 2, (21, 3)), 5, axis=0)
    got = language_id._labels(scores, rows, 4)
    total = lambda s, p: s[np.arange(len(p)), p].sum() - language_id.PENALTY * (np.diff(p) != 0).sum()
    for r in (0, 2, 3):
        s = scores[rows == r]
        assert abs(total(s, got[rows == r]) - total(s, language_id.viterbi(s))) < 1e-9


def test_single_text_agrees_with_viterbi(monkeypatch):
    monkeypatch.setattr(wb, "BLOCK", 7)
    rng = np.random.default_rng(4)
    for k in range(40):
        s = (rng.normal(0, 1.5, (60, 3)) + np.repeat(rng.normal(0, 1, (6, 3)) * (k % 4), 10, axis=0)).astype(np.float32)
        total = lambda p: s[np.arange(60), p].sum() - language_id.PENALTY * (np.diff(p) != 0).sum()
        assert abs(total(language_id._labels(s, np.zeros(60, np.int64), 1)) - total(language_id.viterbi(s))) < 1e-4


def test_language_of_scripts_that_no_language_uses(spark):
    train = [(i, "ሰላም ለዓለም ደህና" if i % 2 else "𠀀𠀁 𠀂𠀃 𠀄", "am" if i % 2 else "zh", "s", 0) for i in range(40)]
    model = language_id.learn(spark.createDataFrame(train, SCHEMA))
    got = language_id.identify(spark.createDataFrame([(1, "ደህና ሰላም", None, None, 0), (2, "𠀄 𠀂𠀃", None, None, 0)], SCHEMA), model).collect()
    assert [(r._lang_pred, r._lang_score > 0.9) for r in sorted(got)] == [("am", True), ("zh", True)]


def test_language_against_plain_python(spark):
    """Script narrowing, n-gram sums and Viterbi once more, word by word."""
    rng = random.Random(12)
    vocab = {"aa": "kataro milu senki dopa ranel", "bb": "strung vlecht prozd grumf ranel", "cc": "мир снег поле"}
    make = lambda l, n: " ".join(rng.choice(vocab[l].split()) for _ in range(n))
    train = [(i, make(l, 12), l, "s", 0) for i in range(90) for l in [["aa", "bb", "cc"][i % 3]]]
    model = language_id.learn(spark.createDataFrame(train, SCHEMA))
    tests = [make("aa", 6) + " " + make("bb", 7) + " 12 " + make("cc", 5), make("cc", 3), "ranel", "x снег", "Kataro, milu!"]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(tests)], SCHEMA), model, spans=True).collect()}
    for i, text in enumerate(tests):
        scores, letters = [], []
        for w in text.split():
            data = np.frombuffer(w.encode(), np.uint8)
            s, n = model.word_scores(data, np.array([0]), np.array([len(data)]))
            assert n[0] == sum(c.isalpha() for c in w)
            scores.append(s[0]), letters.append(int(n[0]))
        path = language_id.viterbi(np.array(scores))
        weight = [sum(n for n, p in zip(letters, path) if p == l) for l in range(3)]
        top = int(np.argmax(weight))
        sums = np.array([sum(float(s[l]) for s, p in zip(scores, path) if p == top) for l in range(3)])
        odds = np.exp(sums - sums.max())
        assert got[i]._lang_pred == model.langs[top] and abs(got[i]._lang_score - weight[top] / sum(weight) * odds[top] / odds.sum()) < 1e-4
        runs = [k for k in range(len(path)) if k == 0 or path[k] != path[k - 1]]
        assert [x.lang for x in got[i]._lang_spans] == [model.langs[path[k]] for k in runs]


def test_quality_trees_as_arrays_and_as_trees():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, len(quality_trees.NAMES)))
    y = (x[:, 3] + 0.5 * x[:, 7] > 0.2).astype(float)
    model = quality_trees.grow(x, y)

    def down(f, t, leaf, row, node=0):
        inner = len(f)
        return leaf[node - inner] if node >= inner else down(f, t, leaf, row, 2 * node + (2 if row[f[node]] > t[node] else 1))

    for row, got in zip(x[:60], model.score(x[:60])):
        total = model.base + sum(down(*tree, row) for tree in zip(model.feature, model.threshold, model.leaf))
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.97


def test_statistics_of_texts_once_more(rows):
    texts = [r[1] for r in rows] + ["#a b\n#a b\n\nLonger wordsarehere, é 12"]
    [(_, _, d, o)] = list(wb.steps(pa.array(texts), 1 << 30))
    got = quality_trees.statistics(d, o)
    at = quality_trees.NAMES.index
    for t, x in zip(texts, got):
        b = (t or "").encode()
        w = [v for v in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if v]
        assert x[at("log_words")] == pytest.approx(np.log1p(len(w)))
        if b:
            assert x[at("distinct_words")] == pytest.approx(len(set(w)) / max(len(w), 1)) and x[at("high")] == pytest.approx(sum(c > 127 for c in b) / len(b))
            assert x[at("upper")] == pytest.approx(sum(65 <= c <= 90 for c in b) / len(b)) and x[at("word_length")] == pytest.approx(np.mean([len(v.encode()) for v in w]) if w else 0)


def test_quality(spark, docs, empty):
    rng = random.Random(7)
    rows = [(i, words(rng, 60) if i % 3 else words(rng, 60).replace(" ", " $$$ "), "en", "s", 0) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(rows, SCHEMA)
    got = quality_trees.scored(frame, quality_trees.learn(frame, labels)).toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert (got.predicted == (got.doc_id % 3 > 0).astype(int)).mean() > 0.98
    flat = quality_trees.learn(frame, labels.limit(0))
    assert quality_trees.scored(docs, flat).where("score = 0.5").count() == docs.count() and quality_trees.scored(empty, flat).count() == 0


def brute_counts(text):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)} if len(tri) < 500 else set()
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_outliers(spark, docs, rows, empty):
    extra = [(1, "a b c a b c\nx\nx\n \n\n", "en", "s", 0), (2, "a a a a #$ é<é", "en", "s", 0), (3, None, None, None, 0), (4, "\t\n", "en", None, 0)]
    got = {r.doc_id: r for r in robust_outliers.verdicts(spark.createDataFrame(extra, SCHEMA)).collect()}
    for d, t, *_ in extra:
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words) == brute_counts(t)
        assert got[d].base_failed and not got[d].kept
    out = robust_outliers.verdicts(docs).toPandas()
    assert len(out) == len(rows) and out.kept[out.doc_id.isin([303])].all()
    assert robust_outliers.verdicts(empty).count() == 0
    assert robust_outliers.apply(docs).columns == docs.columns


def test_outliers_reject_what_lies_far(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, 80, 9000), "en", "s", 0) for i in range(300)] + [(1000 + i, words(rng, 80, 9000).replace(" ", "$$ "), "en", "s", 0) for i in range(30)]
    got = robust_outliers.verdicts(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert (got.kept == (got.doc_id < 1000)).all()


def minimum_covariance(x, level):
    """Location and scatter by concentration on exact halves from many starts, reweighted."""
    floor = np.diag(np.array(robust_outliers.FLOORS) ** 2)
    rng, h, best = np.random.default_rng(0), -(-len(x) // 2), None
    for _ in range(60):
        near = rng.choice(len(x), 6, replace=False)
        for _ in range(30):
            m, c = x[near].mean(0), np.cov(x[near].T, bias=True) * robust_outliers.consistency(0.5) + floor
            near = np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m), kind="stable")[:h]
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c
    _, m, c = best
    use = x[np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) <= robust_outliers.quantile(robust_outliers.REWEIGHT)]
    return use.mean(0), np.cov(use.T, bias=True) * robust_outliers.consistency(robust_outliers.REWEIGHT), len(use)


def test_outliers_against_exact_halves(spark):
    rng = np.random.default_rng(3)
    groups = {("en", "a"): 400, ("en", "b"): 150, ("de", "a"): 300, ("de", None): 4}
    rows = []
    for k, ((lang, source), n) in enumerate(groups.items()):
        mix = rng.normal(0, 0.1, (4, 4)) + np.eye(4) * 0.2
        v = rng.normal(size=(n, 4)) @ mix + k
        v[: n // 5] += 8
        rows += [(lang, source, False, *map(float, x)) for x in v]
    frame = spark.createDataFrame(rows, "lang string, source string, _base_failed boolean, " + ", ".join(f"{c} double" for c in robust_outliers._V))
    found = robust_outliers.estimates(frame)
    got = robust_outliers.judged(frame, found).withColumnsRenamed({"_kept": "kept", "_d2": "d2"}).toPandas()
    x = got[robust_outliers._V].to_numpy()
    name = lambda *c: "\1".join("none" if v is None or v != v else v for v in c)
    raw = {}
    for keys in (lambda r: "all", lambda r: name("lang", r.lang), lambda r: name("pair", r.lang, r.source)):
        of = np.array([keys(r) for r in got.itertuples()])
        for g in set(of):
            raw[g] = minimum_covariance(x[of == g], None) if (of == g).sum() > 5 else (x[of == g].mean(0), None, 0)

    def leaning(own, up):
        m, c, n = own
        um, uc = up
        return ((n * m + um) / (n + 1), (n * c + robust_outliers.PRIOR * uc) / (n + robust_outliers.PRIOR)) if n else up

    every = raw["all"][:2]
    same = []
    for r, v in zip(got.itertuples(), x):
        m, c = leaning(raw[name("pair", r.lang, r.source)], leaning(raw[name("lang", r.lang)], every))
        d2 = (v - m) @ np.linalg.inv(c + np.diag(np.array(robust_outliers.FLOORS) ** 2)) @ (v - m)
        if r.source == r.source and r.source is not None:
            same.append((r.kept, d2 <= robust_outliers.CUT, abs(r.d2 - d2) / (1 + d2)))
    assert np.mean([a == b for a, b, _ in same]) > 0.995 and np.median([e for *_, e in same]) < 0.15
    assert abs(robust_outliers.chi_square(18.4668, 4) - 0.999) < 1e-5


def test_outliers_keep_columns_of_any_name(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 80, 9000), "en", "s", 7, 8.0, True, {"k": i}) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _n_words long, _v0 double, _kept boolean, m map<string,int>")
    out = robust_outliers.apply(frame)
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == list(range(40)) and {(r._n_words, r._v0, r._kept, r.m["k"] == r.doc_id) for r in out.collect()} == {(7, 8.0, True, True)}


def test_licenses(spark, empty):
    s = license_rules.SENTENCES
    cases = [
        (1, "Intro here.\nLicensed under the Apache License, Version 2.0.\nmore", "apache.notice", "Apache-2.0"),
        (2, "MIT License\n\n" + s["mit.grant"].upper() + ":\n" + s["mit.keep"] + ". " + s["mit.warranty"] + ".", "mit.title,mit.grant,mit.keep,mit.warranty", "MIT"),
        (3, None, "", ""), (4, "", "", ""), (5, "no license here", "", ""), (6, "Released under the MIT License. Licensed under CC BY-NC 4.0.", "mit.notice,ccbync.notice", "MIT,CC-BY-NC-4.0"),
        (7, s["apache.copy"], "apache.copy", ""),
    ]
    got = license_rules.recognised(spark.createDataFrame([(d, t, None, None, 0) for d, t, _, _ in cases], SCHEMA)).collect()
    assert sorted((r.doc_id, r.sentence_ids, r.licenses) for r in got) == [(d, i, l) for d, _, i, l in cases]
    assert all(any(k in text for k in license_rules.KEY_WORDS) for text in s.values())
    assert license_rules.recognised(empty).count() == 0


def test_licenses_over_lines(spark):
    import textwrap

    known = license_rules.SENTENCES
    rows = []
    for k, (i, text) in enumerate(sorted(known.items())):
        for j, sign in enumerate(("", "# ", " * ", "// ")):
            body = "\n".join(sign + x for x in textwrap.wrap(text + ".", 30))
            rows.append((4 * k + j, f"{sign}Some words before\n{sign}\n{body}\n{sign.rstrip()}\n{sign}and after", i))
    full = {
        1000: ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "apache.header,apache.comply", "Apache-2.0"),
        1001: ('Licensed under the Apache License, Version 2.0\n(the "License"); you may not use this file except in\ncompliance with the License.\n', "apache.header,apache.comply", "Apache-2.0"),
        1002: ("/* This Source Code Form is subject to the terms of the Mozilla Public\r\n * License, v. 2.0. If a copy is not there */", "mpl2.notice", "MPL-2.0"),
        1003: ("It is released under the MIT\n\nlicense and so on", "", ""),
        1004: ("| a | b |\nReleased under the MIT License.", "mit.notice", "MIT"),
    }
    docs = [(d, t, None, None, 0) for d, t, _ in rows] + [(d, t, None, None, 0) for d, (t, _, _) in full.items()]
    docs += [docs[0], (None, None, None, None, 0), (1005, "word " * 50_000 + "\n\nReleased under the MIT License.\n", None, None, 0)]
    frame = spark.createDataFrame([(*d, "x", 3) for d in docs], SCHEMA + ", licenses string, n_known long")
    got = {r.doc_id: r for r in license_rules.recognised(frame).collect()}
    assert got[1005].licenses == "MIT"
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    c.register("documents", pd.DataFrame([d[:2] for d in docs], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = c.sql(license_rules.oracle()).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.sentence_ids, r.licenses, r.n_known)) for r in license_rules.recognised(frame).collect())
    assert [(d, got[d].sentence_ids) for d, _, _ in rows] == [(d, i) for d, _, i in rows]
    assert {d: (got[d].sentence_ids, got[d].licenses) for d in full} == {d: (i, l) for d, (_, i, l) in full.items()}


def test_chat(spark):
    talk = [("user", "hi"), ("assistant", "yes"), ("user", None), ("assistant", "bye")]
    rows = [(c, i, *talk[i], "x") for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for i in range(n)]
    rows += [(5, 0, "user", "hi", "x"), (5, 1, "assistant", "no", "x"), (None, 0, "user", "hi", "x"), (6, None, None, None, "x"), (6, None, None, None, "x")]
    rows += [(7, i, "user", f"t{i}", "x") for i in range(600)] + [(8, i, "user", f"t{i}", "x") for i in range(599)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string")
    got = chat_snapshots.rendered(frame).collect()
    assert sorted({(r.conv_id, r.n_turns) for r in got}) == [(2, 4), (5, 2), (6, 1), (7, 600)]
    assert [r.chat for r in got if r.conv_id == 5] == ["<|user|>\nhi<|end|>\n<|assistant|>\nno<|end|>\n"]
    assert sorted((r.block, r.first_turn) for r in got if r.conv_id == 7) == [(0, 1), (1, 257), (2, 513)]
    assert chat_snapshots.rendered(frame.limit(0)).count() == 0


def test_decontamination_of_short_items_at_word_borders(spark):
    bench = spark.createDataFrame([(1, "ai"), (2, "The End")], "item_id long, text string")
    frame = spark.createDataFrame([(1, "the captain said"), (2, "AI!"), (3, "at the end, ai"), (4, "the endless"), (5, "x " * 300_000 + "ai")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.matches(frame.selectExpr("*", "1 as distance", "2 as budget"), bench).collect()) == [(2, 1), (3, 1), (3, 2), (5, 1)]


def test_decontamination_in_several_blocks(spark, monkeypatch):
    """Blocks of a few items, each written by itself, say what one block says; the plan holds no block's items."""
    texts = [f"the {w} ship sailed on to the far harbour at dawn {i}" for i, w in enumerate(["first", "second", "third", "fourth", "fifth", "sixth"])]
    bench = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (None, "an item that has no number but a text")], "item_id long, text string")
    frame = spark.createDataFrame([*((i, f"before {t} after") for i, t in enumerate(texts)), (10, "an item that has no number but a text"), (11, "clean"), (12, None)], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, decontamination.matches(frame, bench).collect()))
    one = rows()
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 120)
    assert len(list(decontamination.blocks(bench))) > 2 and rows() == one and len(one) >= 6
    clean = decontamination.apply(frame, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [11, 12] and "MapInArrow" not in clean._jdf.queryExecution().toString()


def test_decontamination_by_every_item(spark):
    rng = random.Random(21)
    texts = [words(rng, 30, 4000) for _ in range(4)]
    bench = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (None, texts[2])], "item_id long, text string")
    frame = spark.createDataFrame([(i, f"{words(rng, 20, 4000)} {t} {words(rng, 20, 4000)}", "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontamination.matches(frame, bench).collect()) == [(0, 7, 0), (1, 7, 0)]
    assert [r.doc_id for r in decontamination.apply(frame, bench).collect()] == [3]


def test_language_model(spark, docs, rows, empty):
    rng = random.Random(9)
    loop = "a b c d e f g h".split()
    train = [(i, " ".join(loop[(i + k) % 8] for k in range(200)), "en", "s", 0) for i in range(800)]
    frame = spark.createDataFrame(train, SCHEMA).repartition(2)
    net = masked_lm.learn(frame)
    odd = (2, " ".join(rng.choice(loop) for _ in range(200)), "en", "s", 0)
    got = {r.doc_id: r for r in masked_lm.scored(spark.createDataFrame([train[1], odd, (3, None, None, None, 0)], SCHEMA), net).collect()}
    assert got[1].mean_log_prob > got[2].mean_log_prob and (got[3].n_tokens, got[3].log_prob, got[3].mean_log_prob) == (0, 0.0, None)
    h, before = np.array([7, 8, 9], np.uint64), np.array([0, 3])
    ids = net.tokens(h)
    near = net.contexts(ids, before)
    assert near.tolist() == [[0, 0, ids[0]], [0, ids[0], ids[1]], [ids[1], ids[2], 0], [ids[2], 0, 0]]
    assert masked_lm.scored(empty, net).count() == 0


def test_language_model_trains_on_every_document(spark, docs, rows, monkeypatch):
    seen = []
    averaged = masked_lm.kept

    def kept(frame, name, *a):
        out = averaged(frame, name, *a)
        if name == "round":
            seen.append(sum(r.w for r in out.select("w").collect()))
        return out

    monkeypatch.setattr(masked_lm, "FAN_IN", 1 << 20)
    monkeypatch.setattr(masked_lm, "kept", kept)
    masked_lm.learn(docs.coalesce(1))
    # One result a round before averaging: the tokens of the rounds are those of all rows, a null id's included.
    assert len(seen) == masked_lm.ROUNDS and sum(seen) == sum(len((t or "").split()) for _, t, *_ in rows)


def test_language_model_gives_rare_words_their_own_probability(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "FREQUENT", 3)

    def bucket(w):
        return int(wb.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] % np.uint64(masked_lm.BUCKETS))

    same = next(v for v in ([w for w in (f"z{k}" for k in range(5000)) if bucket(w) == b] for b in range(256)) if len(v) > 3)
    often, seldom, never = same[:3]
    train = [(i, f"a b c a b c {often if i % 5 else seldom} a b c", "en", "s", 0) for i in range(100)]
    net = masked_lm.learn(spark.createDataFrame(train, SCHEMA))
    texts = [f"a b {w} c" for w in (often, seldom, never)] + [f"a {often} {seldom} {seldom}", "a b c", "", f"a b {often} c"]
    out = masked_lm.scored(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA), net).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(texts) and got[6].log_prob == got[0].log_prob and got[5].log_prob == 0
    assert got[0].log_prob - got[1].log_prob == pytest.approx(np.log(80 / 20)) and got[1].log_prob - got[2].log_prob == pytest.approx(np.log(20))
    # By the network and the shares alone.
    for r in (got[0], got[3], got[4]):
        t = texts[r.doc_id]
        h, before = wb.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        ids = net.tokens(h)
        share = sum(np.log({often: 80, seldom: 20}[w] / 101) for w in t.split() if w in same)
        assert r.log_prob == pytest.approx(net.forward(net.contexts(ids, before), ids)[3].sum() + share, rel=1e-5)


def test_pipeline_against_plain_python(spark, tmp_path):
    """Every stage's decision once more, on rows whose language, quality and copies are plain to see."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(11)
    item = words(rng, 30, 4000)
    rows = [(i, words(rng, 80, 4000), "en", "s", 0) for i in range(60)]
    rows += [(200, rows[0][1], "en", "s", 0), (201, words(rng, 80, 4000) + " " + item, "en", "s", 0), (202, None, "en", "s", 0), (203, "short text", "en", "s", 0), (204, "1 2 3", None, "s", 0)]
    rows += [(205, "", "en", None, 0), (206, words(rng, 80, 4000).replace(" ", "$$ "), "en", "s", 0), (207, " ".join(["same old words"] * 60), "en", "s", 0), (208, words(rng, 9000, 4000), "en", "s", 0)]
    near = rows[1][1].split()
    near[40] = "CHANGED"
    rows += [(209, " ".join(near), None, None, 0), rows[2], (None, words(rng, 80, 4000), "en", "s", 0), (None, words(rng, 80, 4000), "en", "s", 0)]
    spark.createDataFrame([(*r, 1.0, r[0]) for r in rows], SCHEMA + ", score double, _row long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def base(text):
        n, _, _, _, again = brute_counts(text)
        return n >= 50 and 100 * again <= 50 * n

    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    left = [r for r in left if base(r[1]) and "$$" not in r[1]]
    least = {d: c for d, _, c in brute_components(left)}
    left = [r for r in {(r[0], r[1]): r for r in left}.values() if r[0] is None or least[r[0]] == r[0]]
    left = [r for r in left if edit_distance(decontamination.normal(item), decontamination.normal(r[1])) > decontamination.budget(item)] if len(left) < 100 else left
    t = Tokenizer.from_file(encoding.public_vocabulary())
    want = sorted((-1 if d is None else d, zlib.crc32(np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4").tobytes())) for d, x, *_ in left)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas().fillna({"doc_id": -1})
    whole = []
    for d, pieces in got.groupby("doc_id"):
        if d == -1:
            assert pieces.length.sum() == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for n, x, *_ in left if n is None)
            continue
        pieces = pieces.sort_values("start")
        assert (pieces.start == pieces.length.cumsum() - pieces.length).all() and pieces.length.sum() == pieces.doc_tokens.iloc[0]
        text = next(x for n, x, *_ in left if n == d)
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert all(zlib.crc32(ids[int(a) : int(a + n)].tobytes()) == c for a, n, c in zip(pieces.start, pieces.length, pieces.ids_crc32))
        whole.append((int(d), zlib.crc32(ids.tobytes())))
    assert sorted(whole) == [w for w in want if w[0] >= 0]
    for _, w in got.groupby("sequence_id"):
        w = w.sort_values("offset")
        assert (w.offset == w.length.cumsum() - w.length).all() and w.length.sum() <= 1024


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scope_deletes_its_own_tables_alone(spark):
    from signalcontext.llm import common

    mine = common.kept(spark.range(5).toDF("a"), "mine")
    with common.scope(spark):
        gone = common.kept(spark.range(5).toDF("a"), "gone")
        assert gone.count() == 5
    assert mine.count() == 5
    with pytest.raises(Exception):
        gone.count()


def test_licences_after_many_line_ends(spark):
    text = "Released under the MIT License." + "\n" * 60_000 + "Licensed under the Apache License, Version 2.0" + "\n# \n" * 30_000
    from signalcontext.llm import license_rules

    assert license_rules.recognised(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses == "MIT,Apache-2.0"


def test_jaccard_links_of_every_set_of_an_id(spark):
    w, v, u = ("".join(f"{c}{i} " for i in range(40)) for c in "wvu")
    rows = [(1, w), (1, v), (2, w + "end"), (3, v), (4, u), (4, u), (5, u + "more"), (6, ""), (6, u), (7, "x y"), (None, w)]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7), (None, None)}
