"""Language identification of mixed text: script ranges narrow candidates, Viterbi labels spans of words.

A word's score for a language is the log-probability of its byte n-grams (with the word's ends) in that
language's training texts.  The script of a word's letters narrows the languages that it can be in to those
which use the script in training.  Viterbi then finds the labelling of a text's words with the largest sum of
scores less PENALTY for every change of language.

If the best single language leads every other by at least half the penalty's margin on every stretch of words -
no stretch gains another language more than PENALTY / 2 - no labelling with changes can be better, so the
recursion runs only over the other texts.

A document's score is the share of its letters in words of its language, times the confidence in those words: the
softmax, over the languages, of the sums of their scores.

Edge cases: a text that is null or has no letter (Unicode category L; digits, signs and marks are none) is ``und`` with
score 0; words without letters say nothing; a script that no training language uses narrows nothing, and n-grams alone
decide; ties go to the language that sorts first; without any training row every text is ``und``; repeated rows are
labelled each; a very long text is scored in blocks; identify() replaces columns that have the names of its own, apply()
passes every column through as it is.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import wordbytes as wb
from .common import arrow_map, fold

UNKNOWN = "und"
#: Documents of each language to learn from, at most about (a share of a hash is taken).
TRAIN_DOCS = 2500
HELD_OUT, FOLDS = 2, 4
GRAMS, BUCKET_BITS = (2, 3, 4), 16
PENALTY = 12.0
#: n-grams of a word overlap, so their sum counts for less.
WEIGHT = 0.5
#: A language uses a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.01

#: Fixed code point ranges of scripts, by number from 1.
SCRIPTS = [
    ("latin", [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)]), ("greek", [(0x370, 0x3FF)]), ("cyrillic", [(0x400, 0x52F)]),
    ("armenian", [(0x531, 0x58F)]), ("hebrew", [(0x590, 0x5FF)]), ("arabic", [(0x600, 0x77F)]), ("devanagari", [(0x900, 0x97F)]),
    ("bengali", [(0x980, 0x9FF)]), ("tamil", [(0xB80, 0xBFF)]), ("thai", [(0xE00, 0xE7F)]), ("georgian", [(0x10A0, 0x10FF)]),
    ("kana", [(0x3040, 0x30FF)]), ("han", [(0x3400, 0x9FFF)]), ("hangul", [(0xAC00, 0xD7A3)]),
]


#: Letters of other scripts; no letter has a code point beyond LAST.
OTHER, LAST = len(SCRIPTS) + 1, 0x33480


def _script_table() -> np.ndarray:
    """The script of each letter, 0 for what is no letter."""
    table = np.full(LAST, OTHER, np.uint8)
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for lo, hi in ranges:
            table[lo : hi + 1] = number
    table[[not chr(c).isalpha() for c in range(LAST)]] = 0
    return table


_SCRIPT = _script_table()


def _byte_scripts(data: np.ndarray) -> np.ndarray:
    """The script of the letter that begins at each byte, 0 elsewhere."""
    out = _SCRIPT[np.where(data < 0x80, data, 0)]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        end = len(data) - 1
        a, b, c, d = (data[np.minimum(at + k, end)].astype(np.int64) for k in range(4))
        two, three = (a & 0x1F) << 6 | b & 0x3F, (a & 0xF) << 12 | (b & 0x3F) << 6 | c & 0x3F
        point = np.where(a < 0xE0, two, np.where(a < 0xF0, three, (a & 7) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | d & 0x3F))
        out[at] = _SCRIPT[np.where(point < LAST, point, 0)]
    return out


def _word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word."""
    inside = ~wb._SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[rows] = inside[rows]
    ends[rows[1:] - 1] = inside[rows[1:] - 1]
    at = np.flatnonzero(begins)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(offsets, at, side="right") - 1


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each n-gram size, the bucket of the n-gram that ends at each byte of a padded copy of the words.

    The words stand one after another, each between two blanks; position i of word w is starts[w] + w + ... in
    that copy, which _padded() works out."""
    text, _ = _padded(data, starts, ends)
    low = wb._LOWER[text].astype(np.uint32)
    out, acc = [], np.zeros(len(low), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(max(GRAMS)):
            shifted = np.zeros(len(low), np.uint32)
            shifted[k:] = low[: len(low) - k]
            acc = acc + shifted * np.uint32((0x01000193, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)[k])
            if k + 1 in GRAMS:
                h = acc * np.uint32(0x27D4EB2F)
                h ^= h >> np.uint32(15)
                h = h * np.uint32(0x2C1B3C6D) + np.uint32(k)
                out.append(h >> np.uint32(32 - BUCKET_BITS))
    return out


def _padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each word between blanks, start of each word's leading blank)."""
    size = ends - starts + 2
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    place = np.arange(int((ends - starts).sum())) + np.repeat(starts - np.cumsum(ends - starts) + (ends - starts), ends - starts)
    to = place + np.repeat(begin + 1 - starts, ends - starts)
    out[to] = data[place]
    return out, begin


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # bucket x language, per n-gram size
    allowed: np.ndarray  # script x language

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each word for each language, letters of each word that begin in it), block by block."""
        total, letters = np.empty((len(starts), len(self.langs)), np.float32), np.empty(len(starts), np.int64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + wb.BLOCK, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            total[i:j], letters[i:j] = self._scores(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
            i = j
        return total, letters

    def _scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        script = _byte_scripts(data)
        code = np.maximum.reduceat(script, starts)
        letters = np.concatenate([[0], np.cumsum(script > 0)])
        letters = letters[ends] - letters[starts]
        begin = _padded(data, starts, ends)[1]
        each = None
        for w, bucket in zip(self.weights, _grams(data, starts, ends)):
            x = w[bucket]
            each = x if each is None else each + x
        total = np.add.reduceat(each, begin, axis=0).astype(np.float64) * WEIGHT
        total[code == 0] = 0
        total -= total.max(axis=1, keepdims=True)
        return np.where(self.allowed[code], np.maximum(total, -25.0), -50.0), letters


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word: the best path, a change costs the penalty; ties go to the first language, and to staying."""
    n, k = scores.shape
    best, back = scores[0].tolist(), array("i")
    for at in range(1, n, wb.BLOCK):
        for row in scores[at : at + wb.BLOCK].tolist():
            top = max(best)
            leader, jump = best.index(top), top - penalty
            back.extend([l if best[l] >= jump else leader for l in range(k)])
            best = [max(b, jump) + s for b, s in zip(best, row)]
    path = np.empty(n, np.int64)
    here = path[n - 1] = best.index(max(best))
    for i in range(n - 2, -1, -1):
        here = path[i] = back[i * k + here]
    return path


def _single(scores: np.ndarray) -> np.ndarray:
    """The language of each word of one text, block by block."""
    main = int(scores.sum(axis=0, dtype=np.float64).argmax())
    total, least = np.zeros(scores.shape[1]), np.zeros(scores.shape[1])
    for i in range(0, len(scores), wb.BLOCK):
        part = scores[i : i + wb.BLOCK].astype(np.float64)
        after = np.cumsum(part - part[:, main : main + 1], axis=0) + total
        # The lowest point before each word: of the blocks before and of this one.
        low = np.minimum.accumulate(np.concatenate([least[None], np.minimum(total, least)[None], after[:-1]]), axis=0)[1:]
        if (after - low).max(initial=0.0) > PENALTY / 2:
            return viterbi(scores)
        total, least = after[-1], np.minimum(low[-1], after[-1])
    return np.full(len(scores), main)


def _labels(scores: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """The language of each word of all rows."""
    if not len(scores):
        return np.zeros(0, np.int64)
    if n_rows == 1:
        return _single(scores)
    scores = scores.astype(np.float64)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    sums = np.add.reduceat(scores, first, axis=0)
    main = sums.argmax(axis=1)
    number = np.cumsum(np.concatenate([[0], (rows[1:] != rows[:-1]).astype(np.int64)]))
    label = main[number]
    gain = scores - scores[np.arange(len(scores)), label][:, None]
    after = np.cumsum(gain, axis=0)
    # Each row's sums lie far below those of the row before, so one running minimum serves all rows.
    deep = (np.abs(gain).max(initial=1.0) * np.diff(np.append(first, len(scores))).max() * 2 + 1) * number[:, None]
    base = np.concatenate([np.zeros((1, scores.shape[1])), after])[first][number]
    after = after - base - deep
    rise = after - np.minimum.accumulate(after - gain, axis=0)
    hard = np.flatnonzero(np.maximum.reduceat(rise.max(axis=1), first) > PENALTY / 2)
    ends = np.append(first[1:], len(scores))
    for r in hard:
        label[first[r] : ends[r]] = viterbi(scores[first[r] : ends[r]])
    return label


def _judged(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(place of each row's language, -1 for none; its score; start, end, row and language of each word)."""
    n, count = len(offsets) - 1, len(model.langs)
    none = np.zeros(0, np.int64)
    if not len(data) or not count:
        return np.full(n, -1), np.zeros(n), (none, none, none, none)
    starts, ends, rows = _word_bounds(data, offsets)
    scores, letters = model.word_scores(data, starts, ends)
    label = _labels(scores, rows, n)
    weight = np.bincount(rows * count + label, letters, n * count).reshape(n, count)
    total = weight.sum(axis=1)
    top = weight.argmax(axis=1)
    own = label == top[rows]
    sums = np.stack([np.bincount(rows[own], scores[own, l], n) for l in range(count)], axis=1)
    odds = np.exp(sums - sums.max(axis=1, keepdims=True))
    at = np.arange(n)
    sure = odds[at, top] / odds.sum(axis=1)
    known = total > 0
    return np.where(known, top, -1), np.where(known, weight[at, top] / np.maximum(total, 1) * sure, 0.0), (starts, ends, rows, label)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _identify(model: Model, spans: bool):
    """Adds the language, its score and, if asked, the labelled spans (byte offsets) to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in wb.steps(batch.column("text")):
                pred, score, (starts, ends, rows, label) = _judged(model, data, offsets)
                arrays = [pa.array([model.langs[t] if t >= 0 else UNKNOWN for t in pred.tolist()], pa.string()), pa.array(score)]
                if spans:
                    change = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (label[1:] != label[:-1])])) if len(label) else label
                    last = np.append(change[1:], len(label)) - 1
                    found: list[list[dict]] = [[] for _ in range(b - a)]
                    for i, j in zip(change.tolist(), last.tolist()):
                        r = int(rows[i])
                        found[r].append({"start": int(starts[i] - offsets[r]), "end": int(ends[j] - offsets[r]), "lang": model.langs[int(label[i])]})
                    arrays.append(pa.array(found, SPANS))
                out = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*out.columns, *arrays], names=[*out.schema.names, "_lang_pred", "_lang_score", *["_lang_spans"] * spans])

    return run


def _known(model: Model, least: float):
    """The rows of each batch with a language and a score of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in wb.steps(batch.column("text")):
                pred, score, _ = _judged(model, data, offsets)
                yield batch.slice(a, b - a).filter(pa.array((pred >= 0) & (score >= least)))

    return run


def _counted(langs: list[str]):
    """(kind, language, key, count): n-gram buckets (kind: the size's place) and scripts (kind -1) of a training partition."""
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(GRAMS), len(langs), 1 << BUCKET_BITS), np.int64)
        scripts = np.zeros((len(langs), OTHER + 1), np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, b, data, offsets in wb.steps(batch.column("text")):
                if not len(data):
                    continue
                starts, ends, rows = _word_bounds(data, offsets)
                if not len(starts):
                    continue
                i = 0
                while i < len(starts):
                    j = max(i + 1, int(np.searchsorted(ends, starts[i] + wb.BLOCK, side="right")))
                    lo, hi = int(starts[i]), int(ends[j - 1])
                    at, to, own = starts[i:j] - lo, ends[i:j] - lo, lang[a:b][rows[i:j]]
                    script, size = _byte_scripts(data[lo:hi]), to - at
                    inside = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
                    scripts += np.bincount(np.repeat(own, size) * (OTHER + 1) + script[inside], minlength=scripts.size).reshape(scripts.shape)
                    of = np.repeat(own, size + 2)
                    for k, bucket in enumerate(_grams(data[lo:hi], at, to)):
                        grams[k] += np.bincount(of * (1 << BUCKET_BITS) + bucket, minlength=grams[k].size).reshape(grams[k].shape)
                    i = j
        k, l, x = np.nonzero(grams)
        sl, sx = np.nonzero(scripts)
        values = [np.concatenate(z) for z in ((k, np.full(len(sl), -1)), (l, sl), (x, sx), (grams[k, l, x], scripts[sl, sx]))]
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in values], names=["kind", "lang", "key", "n"])

    return run


def learn(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> Model:
    """A model from docs(doc_id, text, lang): about per_lang documents of each language at most, by a hash of the id.

    What comes to the driver is a table of n-gram buckets by language; its size does not depend on the input."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {x.lang: x.c for x in rows.groupBy("lang").agg(F.count("*").alias("c")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((len(GRAMS), 0, 0)), np.ones((OTHER + 1, 0), bool))
    share = F.create_map(*(F.lit(x) for l in langs for x in (l, min(1.0, per_lang / counts[l]))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    table = arrow_map(chosen.select("text", "lang"), _counted(langs), "kind long, lang long, key long, n long")
    table = table.groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, lang, key, n = (table.column(c).to_numpy() for c in ("kind", "lang", "key", "n"))
    grams = np.zeros((len(GRAMS), 1 << BUCKET_BITS, len(langs)))
    g = kind >= 0
    grams[kind[g], key[g], lang[g]] = n[g]
    scripts = np.zeros((OTHER + 1, len(langs)))
    scripts[key[~g], lang[~g]] = n[~g]
    weights = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * (1 << BUCKET_BITS)))
    weights -= weights.mean(axis=2, keepdims=True)
    scripts[0] = 0
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(langs, weights.astype(np.float32), allowed)


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs with _lang_pred, _lang_score and, if asked, _lang_spans."""
    extra = StructType.fromDDL("_lang_pred string, _lang_score double" + ", _lang_spans array<struct<start:long,end:long,lang:string>>" * spans)
    docs = docs.drop(*extra.names)
    schema = StructType(docs.schema.fields + extra.fields)
    return arrow_map(docs, _identify(model, spans), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", FOLDS) != HELD_OUT)


def apply(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """The rows of docs with a language and a score of at least `least`; null and letterless texts go."""
    return arrow_map(docs, _known(learn(training_rows(docs)), least), docs.schema)
