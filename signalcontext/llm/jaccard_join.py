"""Size-aware heavy-light Jaccard self-join of word-shingle sets.

Two sets A, B with J(A, B) >= t share at least ceil(t * max(|A|, |B|)) elements.  With all elements in one
global order, the k smallest common ones lie in the first |A| - ceil(t|A|) + k elements of A, and likewise for B.

* light sets (size up to the boundary) enumerate the 2-subsets of their 2-prefix: two light sets that link
  have a 2-subset in common;
* heavy sets scan the inverted lists of the 1-prefix elements, in which every set of a size that can still
  link with a heavy one stands;
* the boundary is the size at which the rows that both ways make are fewest, from the size histogram.

The global order puts shingles that many documents share last, so that they hardly ever stand in a prefix.
That order is only a matter of speed: any order finds every link.  Equal sets form one class first, and only
class representatives are joined.  Two sets that meet in a list at places i and j of the global order, for the first
time, have at most min(|A| - i, |B| - j) elements in common; where that is too few, the list does not bring them
together.  Inside an inverted list, neighbours by size are verified first, then all members against the most
central ones, whose elements stand in the longest lists; pairs of one component need no further look, all other pairs of a list are then verified,
so no link is lost.

Edge cases: a null or wordless text has an empty set and is linked with nothing; rows whose doc_id is null come
back with component_id null; rows that repeat a doc_id are one document: where their sets differ, the document has
the links of each of them, and every row gets the document's component; an empty table gives an empty result; columns other than doc_id and text are ignored; a very long text is hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordbytes as wb
from .common import arrow_map, components, joined_components, kept, sized

WIDTH = 5
#: A link needs at least NUM / DEN of the union in common.
NUM, DEN = 75, 100
#: Shingles seen less often are not ordered by frequency; at most so many frequent ones are told apart (8 bytes each on the driver).
FREQUENT, FREQUENT_MOST = 8, 1 << 18
#: Local counts are taken over so many shingles at a time.
COUNT_BLOCK = 1 << 20
#: While the lists hold more than so many pairs of different components a row, the members of each list meet its
#: most central members first, so many of them in each round, before all such pairs are looked at.
FEW_PAIRS, HUBS = 1, (1, 4)
#: Up to so many ids of documents in candidate pairs are sent to the tasks instead of dealing out the texts.
SENT_IDS = 500_000
_LIGHT, _HEAVY = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)

PASS_SCHEMA = "kind int, doc_id long, n long, d1 long, d2 long, h long, c long"


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, set sizes, hashes by row and hash, row of each hash) in steps of bounded size."""
    ids = batch.column("doc_id").cast(pa.int64())
    for first, end, data, offsets in wb.steps(batch.column("text")):
        h, r = wb.shingles(*wb.words(data, offsets), WIDTH)
        yield ids.slice(first, end - first), np.bincount(r, minlength=end - first), h, r


def _sum_by_row(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _digest(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _sum_by_row(wb.mix(h), sizes)


def _digest_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document (kind 0: size and an order-free 128-bit digest) and one a locally repeated shingle (kind 1)."""
    block: list[np.ndarray] = []
    held = 0

    def counted() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(block), return_counts=True)
        h, c = h[c > 1], c[c > 1]
        null = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), null, null, null, null, pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=PASS_NAMES)

    for batch in batches:
        for ids, sizes, h, _ in _rows(batch):
            d1 = _digest(h, sizes)
            with np.errstate(over="ignore"):
                d2 = _sum_by_row(wb.mix(h ^ _LIGHT), sizes)
            null = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), ids, pa.array(sizes.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), null, null], names=PASS_NAMES)
            block.append(h)
            held += len(h)
            if held >= COUNT_BLOCK:
                yield counted()
                block, held = [], 0
    if held:
        yield counted()


PASS_NAMES = [x.split()[0] for x in PASS_SCHEMA.split(", ")]


def light_boundary(histogram: dict[int, int], mean_list: float) -> int:
    """The size up to which sets are light, of all sizes that occur: rows of 2-subsets against rows of inverted lists
    and the members that each of these meets there.  A row of a list meets mean_list members."""

    def p1(n: int) -> int:
        return n - (NUM * n + DEN - 1) // DEN + 1

    sizes = sorted(histogram)
    light = heavy = 0.0
    # With the boundary at x, lists hold the sets of sizes that can link with a larger set, and those beyond x scan them.
    scans = sum(c * p1(n) * mean_list for n, c in histogram.items())
    best, at = None, 0
    listed = sum(c * p1(n) for n, c in histogram.items())
    i = 0
    for x in [0, *sizes]:
        c, p = histogram.get(x, 0), p1(x) if x else 0
        light += c * (p + 1) * p // 2
        scans -= c * p * mean_list
        while i < len(sizes) and DEN * sizes[i] <= NUM * x:
            listed -= histogram[sizes[i]] * p1(sizes[i])
            i += 1
        heavy = listed + scans
        if best is None or light + heavy < best:
            best, at = light + heavy, x
    return at


def _prefix_pass(frequent: np.ndarray, often: np.ndarray, boundary: int):
    """Signatures of each document: an array of 64-bit tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, h, r in _rows(batch):
                digest = _digest(h, sizes)
                if len(frequent) and len(h):
                    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    rank = np.where(frequent[at] == h, often[at], 0)
                    if rank.any():
                        order = np.lexsort((rank, r))
                        h = h[order]
                place = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[r]
                n = sizes[r]
                need = (NUM * n + DEN - 1) // DEN
                heavy = (place < n - need + 1) & (DEN * n > NUM * boundary) & (n > 2)
                tokens, owners = [wb.mix(h[heavy] ^ _HEAVY)], [r[heavy]]
                small = (n <= boundary) & (n > 2) & (place < n - need + 2)
                if small.any():
                    ls, lr = h[small], r[small]
                    per = np.bincount(lr, minlength=len(sizes))
                    starts = np.cumsum(per) - per
                    for p in np.unique(per[per > 1]):
                        rows = np.flatnonzero(per == p)
                        block = ls[starts[rows][:, None] + np.arange(p)]
                        i, j = np.triu_indices(p, 1)
                        with np.errstate(over="ignore"):
                            tokens.append(wb.mix(block[:, i] * _LIGHT + wb.mix(block[:, j])).ravel())
                        owners.append(np.repeat(rows, len(i)))
                tok, own = np.concatenate(tokens), np.concatenate(owners)
                order = np.argsort(own, kind="stable")
                counts = np.bincount(own, minlength=len(sizes))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tok[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(digest.view(np.int64)), lists], names=["doc_id", "n", "d1", "tokens"])

    return run


def _set_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, again and set of the rows whose digest is the wanted one."""
    for batch in batches:
        at, wanted, nodes = 0, batch.column("d1").to_numpy().view(np.uint64), batch.column("node")
        for ids, sizes, h, r in _rows(batch):
            n = len(ids)
            ids = nodes.slice(at, n)
            mine = _digest(h, sizes) == wanted[at : at + n]
            offsets = np.concatenate([[0], np.cumsum(sizes[mine])]).astype(np.int32)
            again = batch.column("again").slice(at, n)
            at += n
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[mine[r]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(mine)), again.filter(pa.array(mine)), sets], names=["node", "again", "s"])


def _meet(xn: str, xpos: str, yn: str, ypos: str) -> str:
    """Whether sets of sizes xn, yn that share the elements at places xpos, ypos, and none before, can still link."""
    need = f"(({NUM} * ({xn} + {yn}) + {NUM + DEN - 1}) div {NUM + DEN})"
    return f"{DEN} * least({xn}, {yn}) >= {NUM} * greatest({xn}, {yn}) and least({xn} - {xpos}, {yn} - {ypos}) >= {need}"


def _plausible(pairs: DataFrame, lists: DataFrame, boundary: int) -> DataFrame:
    """The pairs that can still link, by the tokens that they share in their prefixes.

    Common elements outside one of the two prefixes all lie beyond the prefix of the same set, so there are at
    most ceil(t * larger size) - 1 of them; the shared tokens must make up the rest of the overlap that a link
    needs.  Two light sets share 2-subsets, not elements, and are passed on as they are."""
    one = lists.select(F.col("node").alias("a"), "token", F.col("n").alias("na"))
    two = lists.select(F.col("node").alias("b"), "token", F.col("n").alias("nb"))
    shared = pairs.join(one, "a").join(two, ["b", "token"]).groupBy("a", "b").agg(F.count("*").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    need = f"(({NUM} * (na + nb) + {NUM + DEN - 1}) div {NUM + DEN})"
    rest = f"(({NUM} * greatest(na, nb) + {DEN - 1}) div {DEN} - 1)"
    return shared.where(f"greatest(na, nb) <= {boundary} or s + {rest} >= {need}").select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link.  Only the texts of documents in pairs are taken.

    reps: node, the doc_id and d1 that stand for it, and whether several rows have both; only of those is one row
    picked from each group."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps, "node")
    wanted = kept(sized(wanted, 2 * pairs.count()), "wanted")
    # Few enough ids go to every task (25 bytes each); else texts and ids meet by key.
    ids = F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted
    found = arrow_map(docs.join(ids, "doc_id").select("doc_id", "text", "d1", "again", "node"), _set_pass, "node long, again boolean, s array<long>")
    sets = kept(found, "sets")
    sets = sets.where("not again").select("node", "s").unionByName(sets.where("again").groupBy("node").agg(F.first("s").alias("s")))
    a = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    full = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
    return kept(full.where(f"{DEN} * i >= {NUM} * (t - i)").select("a", "b"), "verified")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = kept(arrow_map(docs, _digest_pass, PASS_SCHEMA), "digests")
    rows = first.where("kind = 0").select("doc_id", "n", "d1", "d2")

    counts = kept(first.where("kind = 1").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    often = counts.where(f"c >= {FREQUENT}").orderBy(F.desc("c"), "h").limit(FREQUENT_MOST).collect()
    order = np.argsort(h := np.array([x.h for x in often], np.int64).view(np.uint64))
    frequent, counted = h[order], np.array([x.c for x in often], np.int64)[order]

    # The sets of each doc_id, nearly always one; a class is an equal set, and has a number of its own: several classes
    # may have one least doc_id.
    own = rows.where("n > 0 and doc_id is not null").groupBy("doc_id", "n", "d1", "d2").agg((F.count("*") > 1).alias("again"))
    own = kept(own, "documents")
    classes = own.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "again")).alias("m"))
    classes = kept(classes.select("n", "d1", "d2", F.col("m.doc_id").alias("rep"), "m.again", F.monotonically_increasing_id().alias("node")), "classes")
    histogram = {x.n: x.c for x in classes.groupBy("n").agg(F.count("*").alias("c")).collect()}
    # Prefixes hold rare shingles: a shingle that was never counted twice stands alone, a frequent one stands last.
    rare = counts.where(f"c < {FREQUENT}").agg(F.sum("c").alias("c"), F.sum(F.expr("c * c")).alias("q")).first()
    alone = max(sum(n * c for n, c in histogram.items()) - (rare.c or 0) - int(counted.sum()), 0)
    boundary = light_boundary(histogram, (alone + (rare.q or 0)) / max(alone + (rare.c or 0), 1))

    reps = classes.select(F.col("rep").alias("doc_id"), "d1", "again", "node")
    tokens = arrow_map(docs.where("doc_id is not null"), _prefix_pass(frequent, counted, boundary), "doc_id long, n long, d1 long, tokens array<long>")
    tokens = tokens.where(F.size("tokens") > 0).join(reps.where("not again"), ["doc_id", "d1"]).select("node", "n", "tokens")
    # Of rows that repeat a document, one.
    twice = reps.where("again")
    if not twice.isEmpty():
        more = arrow_map(docs.where("doc_id is not null"), _prefix_pass(frequent, counted, boundary), "doc_id long, n long, d1 long, tokens array<long>")
        more = more.where(F.size("tokens") > 0).join(twice, ["doc_id", "d1"])
        tokens = tokens.unionByName(more.groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    # An element's place is its index among the tokens; 2-subsets, which come last, count as met at the front.
    heavy_n = F.expr(f"if({DEN} * n > {NUM * boundary}, n - ({NUM} * n + {DEN - 1}) div {DEN} + 1, 0)")
    tokens = tokens.select("node", "n", heavy_n.alias("heavy_n"), F.posexplode("tokens").alias("i", "token"))
    # Size and place travel in one number, which also sorts a list by size.
    tokens = tokens.select("node", "token", F.expr("shiftleft(n, 31) | if(i < heavy_n, i, 0)").alias("np"))
    # A list's rows by size: its neighbours are verified first.
    w = Window.partitionBy("token").orderBy("np", "node")
    near = tokens.select("token", "np", "node", F.lag("node").over(w).alias("before"), F.lag("np").over(w).alias("before_np"), F.lead("np").over(w).alias("after_np"))
    split = [F.expr(f"shiftright({x}np, 31)").alias(f"{x}n") for x in ("", "before_", "after_")]
    split += [F.expr(f"{x}np & {(1 << 31) - 1}L").alias(f"{x}pos") for x in ("", "before_")]
    near = near.select("token", "node", "before", *split)
    lists = near.where(f"{DEN} * before_n >= {NUM} * n or {DEN} * n >= {NUM} * after_n").drop("after_n")
    lists = kept(lists, "lists")
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    chain = kept(lists.where(f"{_meet('n', 'pos', 'before_n', 'before_pos')} and node <> before").select(F.col("before").alias("x"), F.col("node").alias("y")).select(*pair).distinct(), "chain")
    links = _verified(kept(_plausible(chain, lists, boundary), "plausible"), docs, reps)
    # The classes of a document with several sets are one component.
    several = own.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    if not several.isEmpty():
        mine = own.join(several, "doc_id", "left_semi").join(classes.select("n", "d1", "d2", "node"), ["n", "d1", "d2"])
        links = links.unionByName(mine.groupBy("doc_id").agg(F.min("node").alias("a")).join(mine, "doc_id").select("a", F.col("node").alias("b")).where("a <> b"))
    found = components(links, links.count())

    tried = chain
    lengths = lists.groupBy("token").agg(F.count("*").alias("length"))
    central = lists.join(lengths, "token").groupBy("node").agg(F.sum("length").alias("weight"))
    central = kept(central, "central")
    for turn in range(len(HUBS) + 1):
        labelled = lists.select("token", "n", "pos", "node").join(found, "node", "left")
        labelled = labelled.select("token", "n", "pos", "node", F.coalesce("component", "node").alias("component"))
        mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
        labelled = kept(labelled.join(mixed, "token", "left_semi"), "mixed")
        each = labelled.groupBy("token", "component").agg(F.count("*").alias("c"))
        each = each.groupBy("token").agg(F.sum("c").alias("m"), F.sum(F.expr("c * c")).alias("q"), F.max(F.struct("c", "component")).alias("largest"))
        size = each.agg(F.sum("m").alias("rows"), F.sum(F.expr("(m * m - q) / 2")).alias("pairs")).first()
        last = turn == len(HUBS) or (size.pairs or 0) <= FEW_PAIRS * (size.rows or 0)
        y = labelled.select("token", F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("node").alias("y"), F.col("component").alias("yc"))
        if last:
            # One side leaves out each list's largest component, so a list in which nearly all are one costs no square.
            y = y.join(each.select("token", F.col("largest.component").alias("largest")), "token").where("yc <> largest")
            x = labelled.select("token", F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("node").alias("x"), F.col("component").alias("xc"))
            cross = x.join(y, "token").where(f"xc <> yc and {_meet('xn', 'xp', 'yn', 'yp')}")
        else:
            w = Window.partitionBy("token").orderBy(F.desc("weight"), "node")
            hubs = labelled.join(central, "node").select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= HUBS[turn])
            x = hubs.select("token", F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("node").alias("x"), F.col("component").alias("xc"))
            cross = y.join(x, "token").where(f"xc <> yc and {_meet('xn', 'xp', 'yn', 'yp')}")
        cross = kept(cross.select(*pair).distinct().join(tried, ["a", "b"], "left_anti"), "cross")
        if not cross.isEmpty():
            more = _verified(kept(_plausible(cross, lists, boundary), "plausible"), docs, reps)
            if not more.isEmpty():
                found = joined_components(found, more)
        tried = tried.unionByName(cross)
        if last:
            break

    labels = classes.join(found, "node", "left").select("n", "d1", "d2", "rep", F.coalesce("component", "node").alias("component"))
    least = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = own.join(labels.join(least, "component").select("n", "d1", "d2", "component_id"), ["n", "d1", "d2"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    # A row without words takes its document's component, if another row of the document has one.
    out = rows.select("doc_id", "n").join(labels, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, without all but one document of each component (the one with the smallest doc_id; of rows
    that repeat it, one with the smallest hash of its text).  Rows without a doc_id stay."""
    if "text" not in docs.columns:
        raise ValueError("keep_one needs the columns doc_id and text")
    labels = kept(jaccard_components(docs), "labels")
    stay = labels.where("doc_id = component_id").groupBy("doc_id").agg((F.count("*") > 1).alias("again"))
    stay = kept(stay, "stay")
    some = docs.where("doc_id is not null")
    out = some.join(stay.where("not again").select("doc_id"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    if stay.where("again").isEmpty():
        return out.select(*docs.columns)
    twice = some.join(stay.where("again").select("doc_id"), "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"))
    one = twice.groupBy(F.col("row.doc_id").alias("doc_id")).agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return out.select(*docs.columns).unionByName(one.select("row.*"))
