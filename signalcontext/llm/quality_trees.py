"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics of whole texts are worked out on the UTF-8 bytes.  Trees are grown on a bounded sample of labelled
rows: per node and statistic, gradients and curvatures are summed in the bins of a histogram and the best split
is read from its prefix sums.  A tree has a fixed depth and is stored as flat arrays (statistic, threshold, leaf
values), so a batch goes down all its levels with one gather a level.

Edge cases: null and empty texts have all-zero statistics and get a score like any other; labels that are null
are not learned from; of several labels of a document the mean decides; without labels of both kinds the score
is their share (0.5 without any); repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbytes as wb
from .common import arrow_map, fold, kept

#: Labelled documents to learn from, at most.
TRAIN_MOST = 12_000
HELD_OUT, FOLDS = 0, 5
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 64, 0.15, 2.0, 10.0
LIKELY = 0.3

#: Fixed classes of bytes whose shares are statistics.
CLASSES = [("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("blank", [32]), ("line", [10]), ("other_white", [9, 11, 12, 13]),
           ("comma", [44]), ("stop", [46]), ("bang", [33, 63]), ("symbol", b"#*$%&|<>"), ("bracket", b"()[]{}/\\=_+@~^"), ("quote", b"\"'`:;-"), ("high", range(128, 256))]
_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, (_, _bytes) in enumerate(CLASSES):
    _CLASS[list(_bytes)] = _i

NAMES = ["log_bytes", "log_words", "word_length", "word_length_spread", "short_words", "long_words", "distinct_words", "repeated_pairs", "repeated_triples", "repeated_lines", "words_a_line", "log_longest_word", *(n for n, _ in CLASSES)]


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each row."""
    if not len(values):
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        _, first = np.unique(wb.mix(values + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(rows[first], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each row's text, one row of floats each."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(NAMES)))
    if not len(data):
        return out
    kinds = len(CLASSES) + 1
    shares = np.zeros(n * kinds, np.int64)
    for lo in range(0, len(data), wb.BLOCK):
        cut = np.clip(offsets, lo, lo + wb.BLOCK)
        shares += np.bincount(np.repeat(np.arange(n), np.diff(cut)) * kinds + _CLASS[data[lo : lo + wb.BLOCK]], minlength=n * kinds)
    shares = shares.reshape(n, kinds)[:, : len(CLASSES)]

    def row(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, at, side="right") - 1

    inside = ~wb._SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1][size > 0]
    begins[full] = inside[full]
    ends[full[1:] - 1] = inside[full[1:] - 1]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    length = (to - at).astype(np.float64)
    of = row(at)
    words = np.bincount(of, minlength=n)
    some = np.maximum(words, 1)
    mean = np.bincount(of, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(of, length * length, n) / some - mean * mean, 0))
    hashes = wb.spans(data, at, to)
    runs = []
    for k in (2, 3):
        m = max(len(hashes) - k + 1, 0)
        joined = np.zeros(m, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                joined = joined * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + m]
        whole = of[:m] == of[len(hashes) - m :]
        owner = of[:m][whole]
        total = np.bincount(owner, minlength=n)
        runs.append(1 - _distinct(wb.mix(joined[whole]), owner, n) / np.maximum(total, 1))
        runs[-1][total == 0] = 0
    breaks = data == 10
    breaks[full] = True
    la = np.flatnonzero(breaks)
    lt = np.append(la[1:], len(data))
    la = la + (data[la] == 10)
    lines = np.bincount(row(la[la < lt]), minlength=n)
    lines_distinct = _distinct(wb.spans(data, la[la < lt], lt[la < lt]), row(la[la < lt]), n)
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    columns = [
        np.log1p(size), np.log1p(words), mean, spread, np.bincount(of, length <= 3, n) / some, np.bincount(of, length >= 12, n) / some,
        _distinct(hashes, of, n) / some, *runs, 1 - lines_distinct / np.maximum(lines, 1), words / np.maximum(lines, 1), np.log1p(longest),
    ]
    out[:, : len(columns)] = np.stack(columns, axis=1)
    out[:, len(columns) :] = shares / np.maximum(size, 1)[:, None]
    out[size == 0] = 0
    return out


@dataclass
class Trees:
    feature: np.ndarray  # tree x inner node
    threshold: np.ndarray
    leaf: np.ndarray  # tree x leaf
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Label 1's likelihood for rows of statistics."""
        total = np.full(len(x), self.base)
        here = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[here, f[node]] > t[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels y (0 to 1) on statistics x."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    mean = float(y.mean()) if len(y) else 0.5
    if not len(y) or mean in (0.0, 1.0):
        mean = min(max(mean, 0.001), 0.999)
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(mean / (1 - mean))))
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(d) * BINS
    base = float(np.log(mean / (1 - mean)))
    total = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            start, width = 2**level - 1, 2**level
            slot = ((node - start)[:, None] * (d * BINS) + flat).ravel()
            shape = (width, d, BINS)
            sums = [np.bincount(slot, np.repeat(v, d), width * d * BINS).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n))]
            (gl, hl, cl), (gt, ht, ct) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(cl < LEAST) | (ct - cl < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for w in range(width):
                j, b = divmod(int(best[w]), BINS)
                if gain[w, j, b] > 1e-6 and b < len(edges[j]):
                    feature[start + w], threshold[start + w] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.stack(features), np.stack(thresholds), np.stack(values), base)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in wb.steps(batch.column("text")):
            x = statistics(data, offsets)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("y").slice(a, b - a), lists], names=["y", "x"])


def _scored(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in wb.steps(batch.column("text")):
                out = batch.slice(a, b - a).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(model.score(statistics(data, offsets)))], names=[*out.schema.names, "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_MOST) -> Trees:
    """Trees from docs(doc_id, text) and labels(doc_id, quality), outside the held-out fold; at most `most` labelled
    documents, those of the smallest hash.  Their statistics (most x 25 numbers) come to the driver."""
    usable = labels.where("quality is not null and doc_id is not null").where(fold("doc_id", FOLDS) != HELD_OUT)
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    chosen = kept(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")
    # At most `most` rows of two numbers: safe to send to every task.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("y", "text")
    got = arrow_map(rows, _measured, "y double, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
    order = np.lexsort(x.T)
    return grow(x[order], got.column("y").to_numpy()[order])


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = arrow_map(rows, _scored(model), "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= LIKELY).cast("int").alias("predicted"))
