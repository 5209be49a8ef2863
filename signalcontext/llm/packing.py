"""Packing of tokenised documents by Karmarkar-Karp multiway differencing.

Every document is its ids and a closing id.  Whole multiples of the window fill windows of their own.  What is
left of each document goes to a block of about BLOCK documents (by a hash of a row number, so blocks are even
whatever the ids are); a fixed share of these rests is cut into small pieces, with which differencing can even
the windows out.  In a block, differencing over k windows merges the two partial partitions of the largest
imbalance, largest sums against smallest, until one is left; if its largest window exceeds the capacity, k rises.

Edge cases: a null or empty text is the closing id alone; the name of an added token is that token; a very long
text fills windows of its own but for its rest; repeated rows and rows with a null doc_id are packed as
rows of their own; an empty table gives no pieces; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, kept
from .encoding import encoded, public_vocabulary

WINDOW, CLOSING = 1024, 0
#: Documents whose rests are packed together.
BLOCK = 1024
#: One rest in so many is cut into pieces of so many ids.
FINE = ((4, 1, 64), (32, 6, 16))

PIECES = "row long, sequence long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, full boolean"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def cut_sizes(rest: int, number: int) -> list[int]:
    """Lengths of the pieces of a rest."""
    for every, at, size in FINE:
        if number % every == at and rest > size:
            return [size] * (rest // size) + ([rest % size] if rest % size else [])
    return [rest] if rest else []


def _pieces(path: str, window: int, named: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = filled = TaskContext.get().partitionId() << 36
        for batch in batches:
            all_ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for first, end, ids, before in encoded(batch, path, named):
                raw, out = memoryview(ids.astype("<u4").tobytes()), []
                closing = CLOSING.to_bytes(4, "little")
                bounds = before.tolist()
                for i in range(end - first):
                    lo, n = bounds[i], bounds[i + 1] - bounds[i] + 1
                    at = 0
                    for size in [window] * (n // window) + cut_sizes(n % window, number):
                        text = raw[4 * (lo + at) : 4 * min(lo + at + size, bounds[i + 1])]
                        crc = zlib.crc32(text)
                        if at + size == n:
                            crc = zlib.crc32(closing, crc)
                        out.append((number, filled, all_ids[first + i], at, size, crc, n, size == window))
                        filled += size == window
                        at += size
                    number += 1
                columns = list(zip(*out)) or [[]] * 8
                types = [pa.int64()] * 7 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp over k windows: the item numbers of each window.

    A partial partition is its non-empty windows as (sum, tree) in ascending order; a tree is an item number or
    a pair of trees.  Windows that are still empty are not written down.
    """
    heap = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    mark = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        # The smallest windows of a: first its empty ones, which take the largest of b, then its smallest sums.
        joined = []
        over = len(b) - free
        for j in range(max(over, 0)):
            (s, _, x), (t, _, y) = a[j], b[over - 1 - j]
            joined.append((s + t, mark, (x, y)))
            mark += 1
        rest = a[max(over, 0) :]
        if len(joined) + min(len(b), free) < 8:
            for w in joined + b[max(over, 0) :]:
                insort(rest, w)
        else:
            rest = sorted(rest + joined + b[max(over, 0) :])
        low = rest[0][0] if len(rest) == k else 0
        heapq.heappush(heap, (low - rest[-1][0], mark, rest))
        mark += 1
    out = []
    for _, _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most the capacity: the count rises until the largest fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        k += max(1, k // 500)


def _packed(window: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "start"], ignore_index=True)
        sizes = pdf["length"].tolist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        padded = np.zeros(len(sizes), np.int64)
        for number, items in enumerate(windows(sizes, window)):
            at = 0
            for i in sorted(items):
                sequence[i], offset[i] = 2 * ((int(key[0]) << 24) + number) + 1, at
                at += sizes[i]
            padded[items] = at if at & (at - 1) == 0 else window
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=sequence, offset=offset, padded_length=padded)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, named: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (even: a full window of one
    document; odd: a window of rests), offset, padded_length (the window, or a power of two as it is).

    named: the name of an added token in a text is that token, as `tokenizers` reads it."""
    path = vocabulary or public_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = kept(arrow_map(docs, _pieces(path, window, named), PIECES), "pieces")
    whole = pieces.where("full").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("sequence")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    whole = whole.withColumn("padded_length", F.lit(window).cast("long"))
    rests = pieces.where("not full")
    blocks = max(1, round(rests.agg(F.countDistinct("row")).first()[0] / BLOCK))
    packed = rests.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("block").applyInPandas(_packed(window), PACKED)
    return whole.unionByName(packed)
