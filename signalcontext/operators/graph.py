"""Resolution, ranking, budgets, bounded traversal, fingerprints and deltas."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..query import doubled
from ..shared import written
from .store import permitted

#: Points of a resolution signal and whether it decides by itself.
SIGNALS = {"same_id": (100, True), "external_id": (95, True), "alias": (90, True), "name": (60, False), "token": (25, False)}
#: Weights of ranking factors; cost counts inverted.
FACTORS = {"confidence": 3, "corroboration": 2, "freshness": 2, "severity": 2, "relevance": 3, "quality": 1, "cost": 1}


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def name_tokens(name: Column) -> Column:
    """Distinct tokens of at least four bytes."""
    return F.filter(F.array_distinct(F.split(F.lower(name), r"[^\p{L}\p{N}]+")), lambda t: F.octet_length(t) >= 4)


#: One task pairs so many entities of a class with those of the linked class.
BLOCK = 512


def name_pairs(entities: DataFrame) -> DataFrame:
    """left_id, right_id, signal of each pair of entities of a kind with an equal normal name or else a shared token.

    Entities with equal names form a class; names are compared between classes, and the members of linked classes
    are paired a block of the left class at a time, so that a common name is dealt to many tasks."""
    own = entities.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("kind", "name"))).alias("names"))
    own = own.withColumn("class", F.to_json("names", {"ignoreNullFields": "false"}))
    sizes = own.groupBy("class").agg(F.first("names").alias("names"), F.count("*").alias("n"))
    each = sizes.select("class", F.explode("names").alias("x")).select("class", "x.kind", "x.name")
    normal = each.select("class", "kind", normal_name(F.col("name")).alias("key"))
    tokens = each.select("class", "kind", F.explode(name_tokens(F.col("name"))).alias("key"))

    def linked(rows: DataFrame, signal: str) -> DataFrame:
        l, r = rows.withColumnRenamed("class", "left_class"), rows.withColumnRenamed("class", "right_class")
        return l.join(r, ["kind", "key"]).select("left_class", "right_class", F.lit(-SIGNALS[signal][0]).alias("order"), F.lit(signal).alias("signal"))

    links = linked(normal, "name").unionByName(linked(tokens, "token")).groupBy("left_class", "right_class").agg(F.min_by("signal", "order").alias("signal"))
    blocks = F.ceil(F.col("n") / BLOCK)
    left = own.join(sizes.select("class", blocks.alias("blocks")), "class").select(F.col("class").alias("left_class"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.col("id").alias("left_id"))
    right = links.join(sizes.select(F.col("class").alias("left_class"), blocks.alias("blocks")), "left_class").join(own.select(F.col("class").alias("right_class"), F.col("id").alias("right_id")), "right_class")
    right = right.select("left_class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "right_id", "signal")
    # As many tasks as the session asks for: the pairs are many more than the rows by which tasks would be put together.
    n = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(n, "left_class", "block").join(right, ["left_class", "block"])
    return pairs.where("left_id < right_id").select("left_id", "right_id", "signal")


def resolve(entities: DataFrame, external: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """left_id, right_id, score, outcome of each pair of entities of a kind with a signal; blocks, never all pairs.

    external: id, namespace, value.  aliases: id, alias (declared name of another entity, normal)."""
    own = entities.select("id", "kind", "name", normal_name(F.col("name")).alias("normal"))
    found = name_pairs(entities)
    points, decides = F.lit(0), F.col("signal").isin([s for s, (_, d) in SIGNALS.items() if d])
    for s, (p, _) in SIGNALS.items():
        points = F.when(F.col("signal") == s, p).otherwise(points)
    if external is None and aliases is None:
        # Each pair stands once already.
        out = found.select("left_id", "right_id", points.cast("long").alias("score"), decides.alias("decisive"))
    else:
        if external is not None:
            keys = ["namespace", "value"]
            l, r = external.select(F.col("id").alias("left_id"), *keys), external.select(F.col("id").alias("right_id"), *keys)
            found = found.unionByName(l.join(r, keys).where("left_id < right_id").select("left_id", "right_id").distinct().withColumn("signal", F.lit("external_id")))
        if aliases is not None:
            hit = aliases.withColumnRenamed("id", "a").join(own, F.col("alias") == F.col("normal")).where("a <> id")
            found = found.unionByName(hit.select(F.least("a", "id").alias("left_id"), F.greatest("a", "id").alias("right_id"), F.lit("alias").alias("signal")).distinct())
        out = found.groupBy("left_id", "right_id").agg(F.max(points).cast("long").alias("score"), F.max(decides).alias("decisive"))
    return out.select("left_id", "right_id", "score", F.when(F.col("decisive"), "merged").otherwise("candidate").alias("outcome"))


def merge_roots(merges: DataFrame) -> DataFrame:
    """id, root: each merged id's survivor; merges (id, into), one row an id.

    Each round joins the pointers with themselves, so a chain of n merges takes about log2(n) rounds.  A chain that
    leads back into itself has no survivor and is refused."""
    found = written(merges.select("id", F.col("into").alias("root")), "merges")
    for _ in range(64):
        up = found.select(F.col("id").alias("root"), F.col("root").alias("up"))
        found = written(found.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "merges")
        if not found.where((F.col("id") == F.col("root"))).isEmpty():
            raise ValueError("merges lead in a circle")
        if found.where("moved").isEmpty():
            break
        found = found.select("id", "root")
    return found.select("id", "root")


def rank_score(factors: dict[str, Column]) -> Column:
    """Integer weighted mean of all factors; an absent one counts as 0, cost as 100 less itself."""
    total = F.lit(0)
    for name, weight in FACTORS.items():
        value = F.coalesce(factors.get(name, F.lit(None).cast("int")), F.lit(0))
        total = total + weight * (100 - value if name == "cost" else value)
    return F.floor(total / sum(FACTORS.values())).cast("long")


def rank_plan(candidates: DataFrame, keep: int) -> DataFrame:
    """candidates (id, score, protected, cluster_key) with representative, included, place: protected ones always
    stay, one of each cluster competes, the best `keep` of those stay."""
    # The best of each cluster by an aggregate that is combined before the shuffle; rows without a cluster need none.
    running = candidates.where("cluster_key is not null and not protected")
    best = running.groupBy("cluster_key").agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("_first"))
    rows = candidates.join(best, "cluster_key", "left")
    rows = rows.withColumn("representative", F.col("protected") | F.col("cluster_key").isNull() | (F.col("id") == F.col("_first"))).drop("_first")
    running = F.col("representative") & ~F.col("protected")
    # The best `keep` by a bounded top-k, not by a window over all rows.
    best = rows.where(running).orderBy(F.desc("score"), "id").limit(keep).select(F.col("id").alias("_best"))
    rows = rows.join(best, F.col("id") == F.col("_best"), "left")
    return rows.withColumn("included", F.col("protected") | F.col("_best").isNotNull()).drop("_best")


#: The columns of an item beside its pack, in the order in which items are looked at.
ITEM = ["turn", "place", "id", "section", "bytes", "tokens", "is_link", "required"]


def budget_rows(items: DataFrame, key: str, tokens: int, size: int, objects: int, links: int) -> DataFrame:
    """The key and ITEM with kept and dropped, how many copies of the item its pack takes and leaves.  Required
    items come first (turn 0), then the others by place; an item over a limit closes its section for those after it.

    items: key, place, id, section, bytes, tokens, is_link, required; lacking sizes count 0, lacking flags are false.
    An item without a section is dropped unless it is required.

    A section takes a prefix of its items, and a pack no more than `objects + links` in all, so one item more of each
    section decides: the rest is cut off before the shuffle by a ranked window.  What is left streams through the
    task of its pack in order; the task holds four sums and the closed sections.  Copies are counted, not ordered."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = items.select(F.col(key), F.when(F.col("required"), 0).otherwise(1).alias("turn"), "place", "id", "section", number("bytes"), number("tokens"), flag("is_link"), flag("required"))
    ranked = Window.partitionBy(key, "section").orderBy(*ITEM[1:])
    free = rows.where("not required and section is not null").withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= objects + links + 1).drop("_n")
    asked = free.unionByName(rows.where("required")).select(key, *ITEM)
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = asked.repartition(n, key).sortWithinPartitions(key, *ITEM).mapInArrow(_taken(tokens, size, objects, links), asked.schema)
    counted = rows.withColumn("_all", F.lit(1)).withColumn("_kept", F.lit(0)).unionByName(taken.withColumn("_all", F.lit(0)).withColumn("_kept", F.lit(1)))
    counted = counted.groupBy(key, *ITEM).agg(F.sum("_kept").alias("kept"), (F.sum("_all") - F.sum("_kept")).alias("dropped"))
    return counted


def _taken(tokens: int, size: int, objects: int, links: int):
    """Of rows that are sorted by pack and turn, those that their packs take."""

    def run(batches):
        pack, t, b, o, n, closed = (), 0, 0, 0, 0, set()
        for batch in batches:
            take = []
            for own, section, more_b, more_t, link, required in zip(*(c.to_pylist() for c in (batch.column(0), *map(batch.column, ("section", "bytes", "tokens", "is_link", "required"))))):
                if (own,) != pack:
                    pack, t, b, o, n, closed = (own,), 0, 0, 0, 0, set()
                fits = t + more_t <= tokens and b + more_b <= size and (n < links if link else o < objects)
                take.append(fits and (required or section not in closed))
                if take[-1]:
                    t, b, o, n = t + more_t, b + more_b, o + (not link), n + bool(link)
                elif not fits:
                    closed.add(section)
            yield batch.filter(pa.array(take, pa.bool_()))

    return run


def budget_fit(items: DataFrame, key: str, tokens: int, size: int, objects: int, links: int) -> DataFrame:
    """`budget_rows` as one row a pack: kept and dropped ids in their order, tokens and bytes of what is kept, and whether
    a required item is left out.  The lists are as long as the pack; packs of any size are for `budget_rows`."""
    rows = budget_rows(items, key, tokens, size, objects, links)

    def listed(copies: str) -> Column:
        cell = F.when(F.col(copies) > 0, F.struct(*ITEM, F.col(copies).alias("n")))
        return F.flatten(F.transform(F.array_sort(F.collect_list(cell)), lambda x: F.array_repeat(x["id"], x["n"].cast("int")))).alias(copies)

    return rows.groupBy(key).agg(listed("kept"), listed("dropped"), F.sum(F.col("tokens") * F.col("kept")).alias("tokens"), F.sum(F.col("bytes") * F.col("kept")).alias("bytes"), F.max(F.col("required") & (F.col("dropped") > 0)).alias("failed"))


def token_estimate(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


@dataclass
class Reach:
    nodes: DataFrame
    edges: DataFrame
    truncated: list[str]


def traverse(relationships: DataFrame, start: str, depth: int = 3, nodes: int = 500, edges: int = 2000, fan_out: int = 200, permitted: Column | None = None, stored: bool = False) -> Reach:
    """Level-synchronous bounded search from a node; the limits that fired are named.

    A hop reads the frontier's edges in (node, edge) order, fan_out at most from each node, and stops in front of
    the first new edge or node over its budget.  Where that is follows from how many new edges and nodes stand before
    each place: the hop's rows are dealt out by range, counted in each range and summed up over the ranges, so no
    row of a hop comes to the driver, which learns the place of the stop and two counts.  Every hop is written.  The
    edges are read once a hop; `stored` tells that they lie in files already, otherwise they are written first."""
    spark = relationships.sparkSession
    once = relationships.withColumn("_ok", permitted if permitted is not None else F.lit(True)).select("id", "source_ref", "target_ref", "_ok")
    links = doubled(once if stored else written(once, "links"))
    visited = written(spark.createDataFrame([(start, 0)], "node string, depth int"), "visited")
    taken = written(spark.createDataFrame([], "id string, depth int"), "taken")
    seen, used, flags = 1, 0, set()
    for level in range(1, depth + 1):
        front = visited.where(F.col("depth") == level - 1).select("node")
        # A frontier has no more nodes than the budget: safe to send to every task.
        ranked = links.join(F.broadcast(front), "node").withColumn("_k", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("_k") <= fan_out + 1)
        hop = written(ranked.repartitionByRange("node", "id").withColumn("_range", F.spark_partition_id()), "hop")
        marked = written(_new_places(hop.where((F.col("_k") <= fan_out) & F.col("_ok")), taken, visited), "marked")
        spent = _spent_before(marked)
        over_edges = (F.col("edge") == 1) & (F.col("edges_before") + used >= edges)
        over = over_edges | ((F.col("reached") == 1) & (F.col("nodes_before") + seen >= nodes))
        stop = spent.where(over).orderBy("node", "id").select("node", "id", over_edges.alias("by_edges")).first()
        before = F.lit(True) if stop is None else (F.struct("node", "id") < F.struct(F.lit(stop.node), F.lit(stop.id)))
        if not hop.where(F.col("_k") > fan_out).where(before).isEmpty():
            flags.add("fan_out")
        kept = marked.where(before)
        taken = written(taken.unionByName(kept.where("edge = 1").select("id", F.lit(level).alias("depth"))), "taken")
        visited = written(visited.unionByName(kept.where("reached = 1").select(F.col("other").alias("node"), F.lit(level).alias("depth"))), "visited")
        before_hop, seen, used = seen, visited.count(), taken.count()
        if stop is not None:
            flags.add("edges" if stop.by_edges else "nodes")
            break
        if seen == before_hop:
            break
        if level == depth:
            flags.add("depth")
    return Reach(visited, taken, sorted(flags))


def _new_places(rows: DataFrame, taken: DataFrame, visited: DataFrame) -> DataFrame:
    """node, id, _range, edge, reached, other: the places of a hop at which an edge or a node stands for the first time."""
    place = F.min(F.struct("node", "id", "_range")).alias("at")
    new_edges = rows.join(taken.select("id"), "id", "left_anti").groupBy(F.col("id").alias("edge_id")).agg(place)
    new_nodes = rows.join(visited.select(F.col("node").alias("other")), "other", "left_anti").groupBy("other").agg(place)
    both = new_edges.select("at.*", F.lit(1).alias("edge"), F.lit(0).alias("reached"), F.lit(None).cast("string").alias("other"))
    both = both.unionByName(new_nodes.select("at.*", F.lit(0).alias("edge"), F.lit(1).alias("reached"), "other"))
    return both.groupBy("node", "id", "_range").agg(F.max("edge").alias("edge"), F.max("reached").alias("reached"), F.max("other").alias("other"))


def _spent_before(marked: DataFrame) -> DataFrame:
    """marked with edges_before and nodes_before: prefix sums in (node, id) order, of ranges that are in that order."""
    totals = marked.groupBy("_range").agg(F.sum("edge").alias("e"), F.sum("reached").alias("n"))
    # One row a range: a bounded frame in one window.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("e").over(earlier), F.lit(0)).alias("_e"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("_range").orderBy("node", "id").rowsBetween(Window.unboundedPreceding, -1)
    counted = marked.select("*", F.coalesce(F.sum("edge").over(inside), F.lit(0)).alias("_ie"), F.coalesce(F.sum("reached").over(inside), F.lit(0)).alias("_in"))
    return counted.join(F.broadcast(totals), "_range").select("node", "id", "edge", "reached", "other", (F.col("_e") + F.col("_ie")).alias("edges_before"), (F.col("_n") + F.col("_in")).alias("nodes_before"))


def reachable(relationships: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """node, depth within `depth` hops of the starts (node), in either direction, without budgets: one join a hop."""
    # The edges are made once, whatever the depth, and stand there once; so does each hop, whose size then tells whether
    # it is sent to every task or the edges to it.
    links = doubled(written(relationships.select("source_ref", "target_ref"), "links")).select("node", "other")
    front = written(starts.select("node").distinct().withColumn("depth", F.lit(0)), "hop")
    seen = front
    for level in range(1, depth + 1):
        reached = links.join(front.select("node"), "node", "left_semi").select(F.col("other").alias("node")).distinct()
        front = written(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)), "hop")
        seen = seen.unionByName(front)
    return seen


def confidence_band(score: Column) -> Column:
    return F.when(score.isNull(), "unstated").when(score < 20, "0-19").when(score < 40, "20-39").when(score < 60, "40-59").when(score < 80, "60-79").otherwise("80+")


def fingerprint(*facets: Column) -> Column:
    """Digest of the digests of the facets, in their order."""
    return F.sha2(F.concat_ws("\x1e", *(F.sha2(F.coalesce(f.cast("string"), F.lit("")), 256) for f in facets)), 256)


class PlanRefused(ValueError):
    """A traversal or a comparison that is refused before it begins."""


def planned(relationships: DataFrame, entities: DataFrame, start: str, most_tlp: str | None = None, depth: int = 3, nodes: int = 500, edges: int = 2000, fan_out: int = 200) -> int:
    """The degree of the start of a traversal that may begin.  Refused: an empty budget, a start entity (entities: id
    and, with most_tlp, markings) that is not there or above the ceiling, and a start with more edges than the budget;
    observables have no rows and are not looked up."""
    for name, budget in (("depth", depth), ("nodes", nodes), ("edges", edges), ("fan-out", fan_out)):
        if budget <= 0:
            raise PlanRefused(f"the budget of {name} is empty")
    if not start.startswith("observable:"):
        row = entities.where(F.col("id") == start).withColumn("_ok", permitted(F.col("markings"), most_tlp) if most_tlp else F.lit(True)).select("_ok").first()
        if row is None:
            raise PlanRefused(f"{start} is not known")
        if not row._ok:
            raise PlanRefused(f"{start} is marked above the ceiling")
    degree = relationships.where((F.col("source_ref") == start) | (F.col("target_ref") == start)).count()
    if degree > edges:
        raise PlanRefused(f"{start} has {degree} edges, over the budget of {edges}")
    return degree


def shape(**question) -> str:
    """Digest of what a capture asked for: start, direction, filters, limits and policy."""
    return hashlib.sha256(json.dumps(question, sort_keys=True, default=str).encode()).hexdigest()


def compare(before: DataFrame, after: DataFrame, successors: DataFrame | None = None, shapes: tuple[str, str] | None = None) -> DataFrame:
    """key, category of two captures (key, digest, status): added, removed, merged, split, revoked, expired,
    reactivated, changed.  successors: key, successor of keys that later ones replace; one makes a merge, several make
    a split.  Captures of different shapes are refused."""
    if shapes is not None and shapes[0] != shapes[1]:
        raise PlanRefused("the captures did not ask the same question")
    return categorised(before, after, successors).where("category is not null")


def categorised(before: DataFrame, after: DataFrame, successors: DataFrame | None = None) -> DataFrame:
    """compare() with the keys that did not change, of null category."""
    b = before.select("key", F.col("digest").alias("b"), F.col("status").alias("bs"))
    a = after.select("key", F.col("digest").alias("a"), F.col("status").alias("as"))
    current = lambda c: F.col(c).isin("active", "deprecated")
    gone = F.when(F.size("successors") == 1, "merged").when(F.size("successors") > 1, "split").otherwise("removed")
    category = (
        F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), gone)
        .when((F.col("as") == "revoked") & (F.col("bs") != "revoked"), "revoked").when((F.col("as") == "expired") & (F.col("bs") != "expired"), "expired")
        .when(current("as") & ~current("bs"), "reactivated").when(F.col("a") != F.col("b"), "changed")
    )
    if successors is None:
        both = b.join(a, "key", "full_outer").withColumn("successors", F.array().cast("array<string>"))
    else:
        both = b.join(a, "key", "full_outer").join(successors.groupBy("key").agg(F.collect_set("successor").alias("successors")), "key", "left")
    return both.select("key", category.alias("category"))
