"""Benchmark decontamination by pigeonhole edit matching.

An item of length n may be altered by up to k = floor(n * RATE) edits.  Cut into k + 1 pieces, at least one piece
stands unaltered in any such copy, so exact hits of all pieces (one Aho-Corasick pass over the whole text) name
every place where a copy can stand; Myers' bit-parallel distance then verifies each place.  Texts and items are
compared in lower case, with ASCII signs and white space as single blanks.

The items are a stated query set: they go to the tasks in blocks of at most BLOCK_CHARS characters, one pass over
the documents a block, whatever the size of the benchmark.  Of several blocks each one's result is written before the
next is read, so the driver holds the items of one.

Edge cases: null or empty texts and items match nothing; an item shorter than SHORT characters (or too
short for one edit) must stand unaltered between word borders; repeated rows are matched each, and of items with one
id each text is searched; matches() has no rows of items without an id, whose copies apply() removes; whole texts are searched, however long; columns of the documents with names of the result are
not read; a null doc_id stays null; with an empty benchmark nothing matches and
apply() keeps every row; apply() passes other columns through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, kept

RATE, SHORT = 0.08, 25
#: Characters of items whose pieces one task holds at a time.
BLOCK_CHARS = 4_000_000

_BLANKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: str | None) -> str:
    """Lower case; ASCII signs and white space between words become one blank."""
    if not text:
        return ""
    return " ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).decode("utf-8").split())


def budget(item: str) -> int:
    """Edits that a copy of the normal item may have."""
    return int(len(item) * RATE) if len(item) >= SHORT else 0


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of the item's error-budget-plus-one pieces; an item without a budget stands between word borders."""
    n = budget(item) + 1
    if n == 1:
        return [(0, f" {item} ")]
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str) -> int:
    """The least edit distance between the item and any part of the text."""
    top, mask = 1 << (len(item) - 1), (1 << len(item)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score = mask, 0, len(item)
    best = score
    for c in text:
        eq = places.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph <<= 1
        mh <<= 1
        up = (mh | ~(xv | ph)) & mask
        down = ph & xv & mask
    return best


class Matcher:
    """Finds altered copies of items in texts."""

    def __init__(self, items: list[tuple[int | None, str]]):
        import ahocorasick

        # By place: several items may have one id, or none.
        self.ids = [i for i, t in items if t]
        self.items = dict(enumerate(t for _, t in items if t))
        at: dict[str, list[tuple[int, int]]] = {}
        for i, t in self.items.items():
            for offset, piece in pieces(t):
                at.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(place of the item, distance) of every item with a copy in the text."""
        t = normal(text)
        if not t or not self.items:
            return []
        t = f" {t} "
        hits: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(t):
            for i, offset in where:
                hits.setdefault(i, set()).add(end + 1 - size - offset)
        out = []
        for i, starts in sorted(hits.items()):
            item = self.items[i]
            k = budget(item)
            if not k:
                out.append((i, 0))
                continue
            best, low, high = k + 1, None, 0
            for s in [*sorted(starts), None]:
                if low is not None and (s is None or s - k > high):
                    window = t[max(low, 0) : high]
                    best = min(best, 0 if item in window else myers(item, window))
                    low = None
                if s is not None and low is None:
                    low = s - k
                if s is not None:
                    high = s + len(item) + k
            if best <= k:
                out.append((i, best))
        return out


def _matched(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Matcher(items)
        for batch in batches:
            docs = batch.column("doc_id").cast(pa.int64()).to_pylist()
            out = [(d, found.ids[i], n, budget(found.items[i])) for d, t in zip(docs, batch.column("text")) for i, n in found.matches(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, names=["doc_id", "item_id", "distance", "budget"])

    return run


def _without(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Matcher(items)
        for batch in batches:
            clean = np.fromiter((not found.matches(t.as_py()) for t in batch.column("text")), bool, batch.num_rows)
            yield batch.filter(pa.array(clean))

    return run


def blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int | None, str]], bool]]:
    """The normal items in blocks of at most about BLOCK_CHARS characters, each with whether there are several."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield sorted({(x.item_id, normal(x.text)) for x in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1])), n > 1


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, budget: one row for each item that each document has a copy of."""
    rows = docs.select("doc_id", "text")
    schema, parts = "doc_id long, item_id long, distance long, budget long", []
    for block, several in blocks(benchmark.where("item_id is not null")):
        part = arrow_map(rows, _matched(block), schema)
        parts.append(kept(part, "matches") if several else part)
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def apply(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold a copy of no item."""
    for block, several in blocks(benchmark):
        docs = arrow_map(docs, _without(block), docs.schema)
        docs = kept(docs, "clean") if several else docs
    return docs
