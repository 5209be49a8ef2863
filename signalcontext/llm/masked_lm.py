"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Tokens are words (ASCII lower case).  The vocabulary holds the words that are most frequent in the whole corpus;
other words fall into hash buckets.  All words are counted in a table that stays distributed: a word of a bucket has
the bucket's probability times its own share of the bucket's tokens in the corpus (a word that is not in the corpus
counts as one more token of its bucket).  The network adds a vector for each of the two words on either side, by
place, squashes the sum, and predicts the token between as a class and a member of the class.  A document's score
is the sum over its tokens of the log-probability given both sides.

Training is spread over the tasks: every task starts a round from the same parameters, takes gradient steps over
its own share of the corpus (the rounds divide the documents among them: each is trained on in one round), and the
results are averaged by weight, a fixed number at a time, until one is left.

Edge cases: null, empty and wordless texts have no tokens, score 0 and a null mean; repeated rows are scored each;
an empty table trains nothing and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbytes as wb
from .common import arrow_map, kept

SIDE = 32
#: Vocabulary: id 0 pads; then frequent words; the last BUCKETS ids share all other words.
SIZE, BUCKETS = SIDE * SIDE, 256
FREQUENT = SIZE - 1 - BUCKETS
HIDDEN, REACH = 16, 2
ROUNDS, BATCH, RATE = 3, 2048, 0.3
#: Words are counted over so many at a time; so many results are averaged by one task.
COUNT_BLOCK, FAN_IN = 1 << 21, 32
OFFSETS = [o for o in range(-REACH, REACH + 1) if o]
SHAPES = {"near": (len(OFFSETS), SIZE, HIDDEN), "cw": (HIDDEN, SIDE), "cb": (SIDE,), "mw": (HIDDEN, SIDE), "mb": (SIDE, SIDE)}


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: list[np.ndarray] = []
    held = 0

    def counted() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(block), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    for batch in batches:
        for _, _, data, offsets in wb.steps(batch.column("text")):
            block.append(wb.words(data, offsets)[0])
            held += len(block[-1])
            if held >= COUNT_BLOCK:
                yield counted()
                block, held = [], 0
    if held:
        yield counted()


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c: the hash and the count of each distinct word of the corpus."""
    return arrow_map(docs.select("text"), _word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words of the whole corpus, most frequent first; at most FREQUENT."""
    return np.array([x.h for x in counts.orderBy(F.desc("c"), "h").limit(FREQUENT).collect()], np.int64).view(np.uint64)


def _buckets(words: np.ndarray):
    """Sums of a table of word counts by bucket, without the words of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, sums = Net(words), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            at = net.tokens(batch.column("h").to_numpy().view(np.uint64)) - (SIZE - BUCKETS)
            np.add.at(sums, at[at >= 0], batch.column("c").to_numpy()[at >= 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(sums)], names=["b", "c"])

    return run


def _take(target: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
    """Subtracts the rows of values from the target's rows of the ids, which may repeat."""
    order = np.argsort(ids, kind="stable")
    found, first = np.unique(ids[order], return_index=True)
    target[found] -= np.add.reduceat(values[order], first, axis=0)


class Net:
    """The vocabulary and the parameters; on the driver also the table of word counts and the tokens of each bucket."""

    counts: DataFrame | None = None
    totals = np.zeros(BUCKETS)

    def __init__(self, words: np.ndarray, flat: np.ndarray | None = None):
        order = np.argsort(words)
        self.sorted, self.ids = words[order], order + 1
        n = sum(int(np.prod(s)) for s in SHAPES.values())
        if flat is None:
            flat = np.random.default_rng(7).normal(0, 0.1, n).astype(np.float32)
            flat[-SIDE * SIDE :] = 0
        self.flat = flat.copy()
        at = 0
        for name, shape in SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        out = (SIZE - BUCKETS + (hashes % np.uint64(BUCKETS))).astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            known = self.sorted[at] == hashes
            out[known] = self.ids[at[known]]
        return out

    def contexts(self, ids: np.ndarray, before: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
        """The ids at each place around the tokens a to b, 0 beyond a token's document."""
        place = np.arange(a, len(ids) if b is None else min(b, len(ids)))
        row = np.searchsorted(before, place, side="right") - 1
        lo, hi = before[row], before[row + 1]
        out = np.zeros((len(OFFSETS), len(place)), np.int64)
        for k, o in enumerate(OFFSETS):
            at = place + o
            ok = (at >= lo) & (at < hi)
            out[k, ok] = ids[at[ok]]
        return out

    def forward(self, around: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hidden, class probabilities, member probabilities, log-probability of each token)."""
        h = self.near[0][around[0]]
        for k in range(1, len(OFFSETS)):
            h = h + self.near[k][around[k]]
        h = np.tanh(h)
        c, m = ids // SIDE, ids % SIDE
        here = np.arange(len(ids))
        x = h @ self.cw + self.cb
        y = h @ self.mw + self.mb[c]
        x -= x.max(axis=1, keepdims=True)
        y -= y.max(axis=1, keepdims=True)
        xc, ym = x[here, c], y[here, m]
        np.exp(x, out=x)
        np.exp(y, out=y)
        xs, ys = x.sum(axis=1), y.sum(axis=1)
        return h, x / xs[:, None], y / ys[:, None], xc - np.log(xs) + ym - np.log(ys)

    def step(self, around: np.ndarray, ids: np.ndarray, rate: float) -> None:
        """One gradient step on the tokens' mean log-probability."""
        h, x, y, _ = self.forward(around, ids)
        n = len(ids)
        here, c = np.arange(n), ids // SIDE
        x[here, c] -= 1
        y[here, ids % SIDE] -= 1
        dh = (x @ self.cw.T + y @ self.mw.T) * (1 - h * h)
        self.cw -= rate * (h.T @ x) / n
        self.cb -= rate * x.mean(axis=0)
        self.mw -= rate * (h.T @ y) / n
        _take(self.mb, c, rate * y / n * SIDE)
        for k in range(len(OFFSETS)):
            _take(self.near[k], around[k], rate * dh / n * SIDE)


def _trained(words: np.ndarray, flat: np.ndarray | None, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Net(words, flat), 0
        for batch in batches:
            for _, _, data, offsets in wb.steps(batch.column("text")):
                hashes, before = wb.words(data, offsets)
                ids = net.tokens(hashes)
                for a in range(0, len(ids), BATCH):
                    net.step(net.contexts(ids, before, a, a + BATCH), ids[a : a + BATCH], rate)
                seen += len(ids)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([net.flat.astype("<f4").tobytes()], pa.binary())], names=["w", "p"])

    return run


def _averaged(pdf: pd.DataFrame) -> pd.DataFrame:
    w = pdf["w"].to_numpy().astype(np.float64)
    p = sum(np.frombuffer(b, "<f4").astype(np.float64) * x for b, x in zip(pdf["p"], w)) / w.sum()
    return pd.DataFrame({"w": [int(w.sum())], "p": [p.astype("<f4").tobytes()]})


def in_round(docs: DataFrame, r: int) -> DataFrame:
    """The documents on which round r trains; each document is in one round of ROUNDS."""
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ROUNDS)) == r)


def learn(docs: DataFrame) -> Net:
    """The network after ROUNDS of local training and averaging.  The parameters alone come to the driver."""
    texts = docs.select("doc_id", "text")
    counts = kept(word_counts(texts), "words")
    words = vocabulary(counts)
    flat = None
    for r in range(ROUNDS):
        share = in_round(texts, r).select("text")
        parts = kept(arrow_map(share, _trained(words, flat, RATE * 0.6**r), "w long, p binary"), "round")
        n = parts.count()
        while n > 1:
            groups = -(-n // FAN_IN)
            parts = kept(parts.withColumn("g", F.pmod(F.xxhash64("p"), F.lit(groups))).groupBy("g").applyInPandas(_averaged, "w long, p binary"), "round")
            n = parts.count()
        got = parts.collect()
        flat = np.frombuffer(got[0].p, "<f4") if got else flat
    net = Net(words, flat)
    net.counts, net.totals = counts, np.zeros(BUCKETS)
    for x in arrow_map(counts, _buckets(words), "b long, c long").groupBy("b").agg(F.sum("c").alias("c")).collect():
        net.totals[x.b] = x.c
    return net


def _scored(words: np.ndarray, flat: np.ndarray, totals: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(words, flat)
        for batch in batches:
            for a, b, data, offsets in wb.steps(batch.column("text")):
                hashes, before = wb.words(data, offsets)
                ids = net.tokens(hashes)
                logs = np.empty(len(ids))
                for i in range(0, len(ids), 4 * BATCH):
                    logs[i : i + 4 * BATCH] = net.forward(net.contexts(ids, before, i, i + 4 * BATCH), ids[i : i + 4 * BATCH])[3]
                rare = ids >= SIZE - BUCKETS
                logs[rare] -= np.log(totals[ids[rare] - (SIZE - BUCKETS)] + 1)
                total = np.concatenate([[0.0], np.cumsum(logs)])
                some = np.concatenate([[0], np.cumsum(rare)])
                cut = lambda x: pa.array(x[before[1:]] - x[before[:-1]])
                cols = [batch.column("doc_id").slice(a, b - a).cast(pa.int64()), batch.column("key").slice(a, b - a), pa.array(np.diff(before).astype(np.int64)), cut(some), cut(total)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_tokens", "n_rare", "log_prob"])

    return run


def _rare_words(words: np.ndarray):
    """Each text's distinct words outside the vocabulary, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(words)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for a, b, data, offsets in wb.steps(batch.column("text")):
                hashes, before = wb.words(data, offsets)
                rare = net.tokens(hashes) >= SIZE - BUCKETS
                h, row = hashes[rare], np.repeat(np.arange(b - a), np.diff(before))[rare]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][row[first]]), pa.array(h[first].view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "h", "n"])

    return run


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob of every row of docs."""
    words = np.empty(len(net.ids), np.uint64)
    words[net.ids - 1] = net.sorted
    # Rows with the same text have the same words: their mean is that of each.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    rows = arrow_map(texts, _scored(words, net.flat, net.totals), "doc_id long, key long, n_tokens long, n_rare long, log_prob double")
    used = arrow_map(texts.select("key", "text"), _rare_words(words), "key long, h long, n long")
    logs = used.join(net.counts, "h", "left").groupBy("key").agg((F.sum(F.col("n") * F.log(F.coalesce("c", F.lit(1)).cast("double"))) / F.sum("n")).alias("rare"))
    log_prob = F.col("log_prob") + F.coalesce(F.col("n_rare") * F.col("rare"), F.lit(0.0))
    out = rows.join(logs, "key", "left").select("doc_id", "n_tokens", log_prob.alias("log_prob"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
