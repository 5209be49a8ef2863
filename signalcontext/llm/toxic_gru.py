"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows of words.

A word enters as its own vector, if the labelled sample has it in enough documents, and as the mean vector of its
character n-grams (three and five bytes), so words that were never seen are read by their characters.  What both give to the gates is worked
out once for each distinct word of a step; along the windows only the small recurrent products are left.  Attention weighs
the hidden states of both directions; the document has the score of its highest window, and every window of the
whole text is scored.

Training is multiple-instance: labels belong to documents, so in each pass the highest window of a document (under the
parameters so far) and one other window carry its label; a document without label 1 has it in no window.  Only that sample
comes to the driver: at most TRAIN_MOST rows of at most TRAIN_CHARS characters.

Words are maximal runs of ASCII letters, digits and bytes from 0x80 on, with A-Z lower-cased.

Edge cases: null and empty texts, and texts without such a word, get the share of label 1 in the sample; null labels
and ids are not learned from; of several labels of a document the greatest holds; without labels of both kinds every
score is the share (0 without any); repeated rows are scored each; very long texts are scored window by window in blocks;
an empty table gives no rows; other columns are ignored.
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

#: Labelled documents to learn from, at most, and their longest text in characters.
TRAIN_MOST, TRAIN_CHARS = 6_000, 20_000
HELD_OUT, FOLDS = 0, 5
LIKELY = 0.5
#: Words in a window, and from the begin of one to that of the next.
WINDOW, STEP = 48, 36
#: Size of a word's own vector, of an n-gram's, of a direction's state, of the attention.
WORD, CHAR, HIDDEN, LOOK = 12, 8, 8, 8
#: Words with vectors of their own, at most, and the documents that must hold them; places for n-grams (hashed).
VOCABULARY, IN_DOCS, GRAMS = 16_384, 3, 16_384
#: Passes over the sample: as many as give so many steps, but no fewer than PASSES; every few passes all windows are scored anew.
PASSES, LEAST_STEPS, BATCH, RATE, AGAIN = 8, 600, 128, 0.08, 3
#: Bytes of text in a step, and windows that are scored at a time.
STEP_BYTES = 1 << 20
BLOCK = 4_096

_WORDBYTE = np.zeros(256, bool)
_WORDBYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, 64-bit hash of each word, words before each row and after the last)."""
    inside = _WORDBYTE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    begins[full] = inside[full]
    ends[full[1:] - 1] = inside[full[1:] - 1]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return at, to, wb.spans(data, at, to, wb._LOWER), np.searchsorted(at, offsets, side="left")


def windows(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of all windows of rows with these word borders: one begins every STEP words, until
    one reaches the end; a row without words has none."""
    counts = np.diff(before)
    n = np.where(counts > 0, 1 + np.maximum(-(-(counts - WINDOW) // STEP), 0), 0)
    row = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = before[:-1][row] + k * STEP
    return row, first, np.minimum(WINDOW, before[1:][row] - first)


def grams(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each n-gram, n-grams before each word and after the last) of the words at..to: at every byte of a word
    the three and the five bytes around it, with zeros beyond its ends."""
    size = to - at
    before = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(before[-1]) + np.repeat(at - before[:-1], size)
    begin, end = np.repeat(at, size), np.repeat(to, size)
    low = wb._LOWER[data]
    joined = []
    for reach in (1, 2):
        value = np.full(len(place), reach, np.uint64)
        for shift in range(-reach, reach + 1):
            p = place + shift
            value = (value << np.uint64(8)) + np.where((p >= begin) & (p < end), low[np.clip(p, 0, len(low) - 1)], 0).astype(np.uint64)
        joined.append((wb.mix(value) % np.uint64(GRAMS)).astype(np.int64))
    return np.stack(joined, axis=1).ravel(), 2 * before


@dataclass
class Distinct:
    """The distinct words of some text: their hashes, which of them each word is, and their n-grams."""

    hashes: np.ndarray
    which: np.ndarray
    grams: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(data: np.ndarray, at: np.ndarray, to: np.ndarray, hashes: np.ndarray) -> Distinct:
        known, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        order = np.argsort(first)
        found, before = grams(data, at[first[order]], to[first[order]])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return Distinct(known[order], back[which], found, before)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _summed(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows that go to each of n places."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    order = np.argsort(to, kind="stable")
    to = to[order]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    if len(first):
        out[to[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Net:
    """The parameters, by name; vocabulary is the sorted hashes of the words with vectors of their own."""

    def __init__(self, vocabulary: np.ndarray, share: float, seed: int = 7, kind=np.float32) -> None:
        r = np.random.default_rng(seed)
        self.vocabulary, self.share = vocabulary, share
        wide = WORD + CHAR

        def normal(scale: float, *shape: int) -> np.ndarray:
            return r.normal(0, scale, shape).astype(kind)

        # Gates in the order reset, update, candidate, of the direction from the left and of that from the right.
        self.p = {
            "word": normal(0.3, len(vocabulary) + 1, WORD), "gram": normal(0.3, GRAMS, CHAR),
            "x": normal(wide**-0.5, 2, wide, 3 * HIDDEN), "bias": np.zeros((2, 3 * HIDDEN), kind), "h": normal(HIDDEN**-0.5, 2, HIDDEN, 3 * HIDDEN),
            "look": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN, LOOK), "look_bias": np.zeros(LOOK, kind), "weigh": normal(1.0, LOOK),
            "out": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN), "out_bias": np.zeros(1, kind),
        }
        self.p["word"][-1] = 0  # words that have no vector of their own

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        return np.where(known, at, len(self.vocabulary))

    def inputs(self, some: Distinct) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of the distinct words, what they give to the gates of both directions)."""
        if not len(some.hashes):
            return np.zeros((0, WORD + CHAR), self.p["word"].dtype), np.zeros((2, 0, 3 * HIDDEN), self.p["word"].dtype)
        size = np.diff(some.before)
        chars = np.add.reduceat(self.p["gram"][some.grams], some.before[:-1], axis=0) / size[:, None].astype(self.p["gram"].dtype)
        x = np.concatenate([self.p["word"][self.ids(some.hashes)], chars], axis=1)
        return x, np.stack([x @ self.p["x"][d] + self.p["bias"][d] for d in (0, 1)])

    def forward(self, gates: np.ndarray, which: np.ndarray, length: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The logit of each window: which has its distinct words (padded with any), length its words.  keep collects
        what backward() needs."""
        n, width = which.shape
        kind, h = gates.dtype, HIDDEN
        states = np.zeros((width, n, 2 * h), kind)
        inside = np.arange(width)[:, None] < length
        whole = inside.all(axis=1)
        words = np.ascontiguousarray(which.T)
        steps = []
        for d in (0, 1):
            s = np.zeros((n, h), kind)
            x_rz, x_g = (np.ascontiguousarray(gates[d][:, c]) for c in (slice(0, 2 * h), slice(2 * h, None)))
            u_rz, u_g = (np.ascontiguousarray(self.p["h"][d][:, c]) for c in (slice(0, 2 * h), slice(2 * h, None)))
            for t in range(width) if d == 0 else range(width - 1, -1, -1):
                rz = x_rz.take(words[t], axis=0)
                rz += s @ u_rz
                np.negative(rz, out=rz)
                np.exp(rz, out=rz)
                rz += 1
                np.reciprocal(rz, out=rz)
                r, z = rz[:, :h], rz[:, h:]
                c = s @ u_g
                g = x_g.take(words[t], axis=0)
                g += r * c
                np.tanh(g, out=g)
                if keep is not None:
                    steps.append((d, t, s, r, z, c, g))
                new = s - g
                new *= z
                new += g
                s = new if whole[t] else np.where(inside[t][:, None], new, s)
                states[t, :, d * h : (d + 1) * h] = s
        look = states.reshape(-1, 2 * h) @ self.p["look"]
        look += self.p["look_bias"]
        np.tanh(look, out=look)
        e = (look @ self.p["weigh"]).reshape(width, n)
        look = look.reshape(width, n, LOOK)
        e[~inside] = -np.inf
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", e, states)
        if keep is not None:
            keep.extend((steps, states, inside, look, e, pooled))
        return pooled @ self.p["out"] + self.p["out_bias"][0]

    def backward(self, some: Distinct, x: np.ndarray, which: np.ndarray, kept_: list, error: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of every parameter, for the derivative of the loss by each window's logit."""
        steps, states, inside, look, e, pooled = kept_
        h, n = HIDDEN, len(which)
        g = {"out": error @ pooled, "out_bias": error.sum(keepdims=True)}
        d_pool = error[:, None] * self.p["out"]
        d_states = e[:, :, None] * d_pool
        d_e = np.einsum("tnk,nk->tn", states, d_pool)
        d_e = e * (d_e - (e * d_e).sum(axis=0))
        g["weigh"] = np.einsum("tn,tnk->k", d_e, look)
        d_look = d_e[:, :, None] * self.p["weigh"] * (1 - look * look)
        g["look"] = np.einsum("tni,tnk->ik", states, d_look)
        g["look_bias"] = d_look.sum(axis=(0, 1))
        d_states += d_look @ self.p["look"].T
        d_gates = np.zeros((2, *which.T.shape, 3 * h), x.dtype)
        g["h"] = np.zeros_like(self.p["h"])
        carry = np.zeros((n, h), x.dtype)
        last = None
        for d, t, s, r, z, c, cand in reversed(steps):
            if d != last:
                carry, last = np.zeros((n, h), x.dtype), d
            d_s = carry + d_states[t, :, d * h : (d + 1) * h]
            m = inside[t][:, None]
            d_new = np.where(m, d_s, 0)
            d_z = d_new * (s - cand) * z * (1 - z)
            d_cand = d_new * (1 - z) * (1 - cand * cand)
            d_c = d_cand * r
            d_r = d_cand * c * r * (1 - r)
            d_x = np.concatenate([d_r, d_z, d_cand], axis=1)
            d_u = np.concatenate([d_r, d_z, d_c], axis=1)
            d_gates[d, t] = d_x
            g["h"][d] += s.T @ d_u
            carry = np.where(m, d_new * z, d_s) + d_u @ self.p["h"][d].T
        d_gates = np.stack([_summed(d_gates[d].reshape(-1, 3 * h), which.T.ravel(), len(x)) for d in (0, 1)])
        g["bias"] = d_gates.sum(axis=1)
        g["x"] = np.stack([x.T @ d_gates[d] for d in (0, 1)])
        d_x = d_gates[0] @ self.p["x"][0].T + d_gates[1] @ self.p["x"][1].T
        ids = self.ids(some.hashes)
        g["word"] = np.zeros_like(self.p["word"])
        g["word"][ids] = d_x[:, :WORD]
        g["word"][-1] = 0
        size = np.diff(some.before)
        g["gram"] = _summed(np.repeat(d_x[:, WORD:] / size[:, None].astype(x.dtype), size, axis=0), some.grams, GRAMS)
        return g

    def logits(self, some: Distinct, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The logit of each window of the text whose distinct words these are, in blocks."""
        _, gates = self.inputs(some)
        out = np.empty(len(first), gates.dtype)
        for lo in range(0, len(first), BLOCK):
            f, m = first[lo : lo + BLOCK], length[lo : lo + BLOCK]
            out[lo : lo + BLOCK] = self.forward(gates, _places(some, f, m), m)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each row's text."""
        n = len(offsets) - 1
        out = np.full(n, self.share)
        at, to, hashes, before = tokens(data, offsets) if len(data) else (*[np.zeros(0, np.int64)] * 3, np.zeros(n + 1, np.int64))
        if not len(at) or not 0 < self.share < 1:
            return out
        best = np.full(n, -np.inf)
        # A long text is taken in runs of whole windows, so its distinct words are few at a time.
        row, first, length = windows(before)
        for lo in range(0, len(row), BLOCK):
            f, m = first[lo : lo + BLOCK], length[lo : lo + BLOCK]
            a, b = f[0], (f + m).max()
            some = Distinct.of(data, at[a:b], to[a:b], hashes[a:b])
            np.maximum.at(best, row[lo : lo + BLOCK], self.logits(some, f - a, m))
        has = best > -np.inf
        out[has] = _sigmoid(best[has].astype(np.float64))
        return out


def _places(some: Distinct, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The distinct words of each window, padded with its last, as wide as the longest."""
    width = int(length.max())
    return some.which[first[:, None] + np.minimum(np.arange(width), length[:, None] - 1)]


def train(texts: list[bytes], labels: np.ndarray) -> Net:
    """A network for labels (0 or 1) of texts."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Net(np.zeros(0, np.uint64), share)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    at, to, hashes, before = tokens(data, offsets)
    if not len(at):
        return Net(np.zeros(0, np.uint64), 0.0 if share < 0.5 else 1.0)
    some = Distinct.of(data, at, to, hashes)
    doc = np.repeat(np.arange(len(texts)), np.diff(before))
    pairs = np.unique(doc * len(some.hashes) + some.which) % len(some.hashes)
    in_docs = np.bincount(pairs, minlength=len(some.hashes))
    order = np.lexsort((some.hashes, -in_docs))
    net = Net(np.sort(some.hashes[order[: min(VOCABULARY, int((in_docs >= IN_DOCS).sum()))]]), share)
    row, first, length = windows(before)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    r = np.random.default_rng(11)
    squares = {k: np.full_like(v, 1e-6) for k, v in net.p.items()}
    y, n = labels[row[starts]].astype(np.float64), np.diff(np.append(starts, len(row)))
    blind = 2  # before anything is learned the highest window means nothing: the first passes take windows at will
    top = None
    for turn in range(max(PASSES, -(-LEAST_STEPS * BATCH // (2 * len(starts))))):
        if turn >= blind and (turn - blind) % AGAIN == 0:
            top = np.lexsort((-net.logits(some, first, length), row))[starts]
        other = starts + (r.random(len(starts)) * n).astype(np.int64)
        chosen, target = np.concatenate([other if top is None else top, other]), np.concatenate([y, y])
        weight = np.concatenate([np.ones(len(y)), np.where(y == 0, 0.5, 1.0 if top is None else 0.0)])
        for part in np.array_split(r.permutation(len(chosen)), max(len(chosen) // BATCH, 1)):
            part = part[weight[part] > 0]
            if len(part):
                _descend(net, squares, some, first[chosen[part]], length[chosen[part]], target[part], weight[part])
    return net


def _descend(net: Net, squares: dict[str, np.ndarray], some: Distinct, first: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """One step on the logistic loss of a batch, each parameter at a rate by its own past gradients."""
    which = _places(some, first, length)
    used, local = np.unique(which, return_inverse=True)
    sizes = np.diff(some.before)[used]
    before = np.concatenate([[0], np.cumsum(sizes)])
    grams = some.grams[np.arange(before[-1]) + np.repeat(some.before[used] - before[:-1], sizes)]
    few = Distinct(some.hashes[used], np.zeros(0, np.int64), grams, before)
    which = local.reshape(which.shape)
    x, gates = net.inputs(few)
    keep: list = []
    z = net.forward(gates, which, length, keep)
    error = ((_sigmoid(z) - y) * weight / weight.sum()).astype(z.dtype)
    for name, g in net.backward(few, x, which, keep, error).items():
        squares[name] += g * g
        net.p[name] -= (RATE * g / np.sqrt(squares[name])).astype(z.dtype)


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_MOST) -> tuple[list[bytes], np.ndarray]:
    """The texts and labels to learn from: outside the held-out fold, of bounded length, those of the smallest hash."""
    usable = labels.where("toxic is not null and doc_id is not null").where(fold("doc_id", FOLDS) != HELD_OUT)
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    # Twice as many labels as rows to learn from: some belong to long texts, or to none.
    chosen = kept(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most), "labelled")
    # At most 2 x `most` rows of two numbers: safe to send to every task.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"length(text) between 1 and {TRAIN_CHARS}").join(F.broadcast(chosen), "doc_id")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).select("y", "text").toArrow()
    return [t.encode() for t in got.column("text").to_pylist()], got.column("y").to_numpy()


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_MOST) -> Net:
    """The network for docs(doc_id, text) and labels(doc_id, toxic)."""
    return train(*sample(docs, labels, most))


def _scored(net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in wb.steps(batch.column("text"), STEP_BYTES):
                out = batch.slice(a, b - a).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(net.scores(data, offsets))], names=[*out.schema.names, "score"])

    return run


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = arrow_map(rows, _scored(net), "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= LIKELY).cast("int").alias("predicted"))
