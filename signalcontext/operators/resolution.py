"""Entity resolution between classes of equal names, and the analysts' operations on identities.

A pair of entities is never made for its own sake: links stand between classes, and judge() looks up given pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import SIGNALS, name_tokens, normal_name

#: Fixed value: operations that are about two identities.
PAIRED = ("merge", "split", "reject", "alias")


@dataclass
class Standing:
    """What a sequence of operations leaves: merges (id, into), rejections (left_id, right_id), aliases (left_id,
    right_id), pins (id), and refused (seq, reason)."""

    merges: DataFrame
    rejections: DataFrame
    aliases: DataFrame
    pins: DataFrame
    refused: DataFrame


@dataclass
class Resolution:
    """members (layer, id, class) and links (layer, left_class, right_class, score, decisive, pairs): classes are
    named after their smallest id, and a link of a class with itself stands for the pairs inside it."""

    members: DataFrame
    links: DataFrame


def replay(operations: DataFrame, stop: bool = True) -> Standing:
    """operations (seq, kind, left_id, right_id, withdraws, actor, policy_context), seq unique.

    Refused: an operation without actor or policy context, a paired one without its second identity, a kind that is
    not known, and a merge of an identity that is pinned at that moment.  With stop, nothing after the first refusal
    counts.  The survivor of a merge is the smaller id; a split takes back whatever absorbed the greater one."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    static = (
        F.when(~F.coalesce(F.col("kind").isin(*PAIRED, "pin"), F.lit(False)), "unknown_kind").when(blank("actor"), "no_actor").when(blank("policy_context"), "no_policy_context")
        .when(F.col("left_id").isNull() | (F.col("kind").isin(*PAIRED) & F.col("right_id").isNull()), "needs_pair")
    )
    ops = operations.withColumn("reason", static).withColumn("withdraws", F.coalesce("withdraws", F.lit(False)))
    ops = ops.withColumn("first", F.least("left_id", "right_id")).withColumn("second", F.greatest("left_id", "right_id"))
    # Whether an id is pinned when it is to be merged: the last pin operation on it before that.
    pins = ops.where("kind = 'pin' and reason is null").select(F.col("left_id").alias("id"), "seq", (~F.col("withdraws")).alias("pinned"), F.lit(False).alias("asks"))
    asks = ops.where("kind = 'merge' and reason is null").select(F.explode(F.array("left_id", "right_id")).alias("id"), "seq", F.lit(None).cast("boolean").alias("pinned"), F.lit(True).alias("asks"))
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    stopped = pins.unionByName(asks).withColumn("now", F.last("pinned", ignorenulls=True).over(before)).where("asks and now").select("seq").distinct().withColumn("_pinned", F.lit(True))
    ops = ops.join(stopped, "seq", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("_pinned"), "pinned").otherwise(F.col("reason"))).drop("_pinned")
    refused = ops.where("reason is not null").select("seq", "reason")
    good = ops.where("reason is null")
    if stop:
        good = good.join(refused.agg(F.min("seq").alias("_stop"))).where("_stop is null or seq < _stop").drop("_stop")

    def last(kinds: list[str], *key: str) -> DataFrame:
        rows = good.where(F.col("kind").isin(*kinds))
        return rows.groupBy(*key).agg(F.max_by(F.struct("kind", "withdraws", "first"), "seq").alias("o"))

    merges = last(["merge", "split"], "second").where("o.kind = 'merge'").select(F.col("second").alias("id"), F.col("o.first").alias("into"))
    rejections = last(["reject"], "first", "second").where("not o.withdraws").select(F.col("first").alias("left_id"), F.col("second").alias("right_id"))
    aliases = last(["alias"], "second").where("not o.withdraws").select(F.col("o.first").alias("left_id"), F.col("second").alias("right_id"))
    return Standing(merges, rejections, aliases, last(["pin"], "left_id").where("not o.withdraws").select(F.col("left_id").alias("id")), refused)


def resolve_classes(entities: DataFrame, external: DataFrame | None = None) -> Resolution:
    """entities (id, kind, name), external (id, namespace, value).

    Entities of one kind and name are a class of the layer 'name', those with one external id a class of the layer
    'external'.  Classes of a kind are linked by an equal normal name or else by a token; a null name links with
    nothing.  A token's classes are paired once each, however many entities they hold."""
    own = entities.where("name is not null").select("id", "kind", "name").distinct()
    sizes = own.groupBy("kind", "name").agg(F.min("id").alias("class"), F.count("*").alias("n"))
    members = own.join(sizes.select("kind", "name", "class"), ["kind", "name"]).select(F.lit("name").alias("layer"), "id", F.concat_ws("\x1f", "kind", "name").alias("_key"), "class")
    # One entity may be the smallest of two classes (it has two names): the key keeps them apart.
    named = sizes.select(F.concat_ws("\x1f", "kind", "name").alias("_key"), "class", "kind", "n", normal_name(F.col("name")).alias("normal"), name_tokens(F.col("name")).alias("tokens"))

    def linked(rows: DataFrame) -> DataFrame:
        l, r = rows.select("kind", "key", F.col("_key").alias("_l")), rows.select("kind", "key", F.col("_key").alias("_r"))
        return l.join(r, ["kind", "key"]).where("_l < _r").select("_l", "_r")

    equal = linked(named.select("kind", F.col("normal").alias("key"), "_key")).withColumn("signal", F.lit("name"))
    token = linked(named.select("kind", F.explode("tokens").alias("key"), "_key")).distinct().withColumn("signal", F.lit("token"))
    both = equal.unionByName(token).groupBy("_l", "_r").agg(F.min("signal").alias("signal"))
    l, r = (named.select(F.col("_key").alias(k), F.col("class").alias(c), F.col("n").alias(n)) for k, c, n in (("_l", "left_class", "ln"), ("_r", "right_class", "rn")))
    between = both.join(l, "_l").join(r, "_r").select("_l", "_r", "left_class", "right_class", "signal", (F.col("ln") * F.col("rn")).alias("pairs"))
    inside = named.where("n > 1").select(F.col("_key").alias("_l"), F.col("_key").alias("_r"), F.col("class").alias("left_class"), F.col("class").alias("right_class"), F.lit("name").alias("signal"), F.expr("n * (n - 1) div 2").alias("pairs"))
    links = between.unionByName(inside).withColumn("layer", F.lit("name"))
    if external is not None:
        has = external.dropna().select("id", F.concat_ws("\x1f", "namespace", "value").alias("_key")).distinct()
        groups = has.groupBy("_key").agg(F.min("id").alias("class"), F.count("*").alias("n"))
        members = members.unionByName(has.join(groups.select("_key", "class"), "_key").withColumn("layer", F.lit("external")))
        same = groups.where("n > 1").select(F.lit("external").alias("layer"), F.col("_key").alias("_l"), F.col("_key").alias("_r"), F.col("class").alias("left_class"), F.col("class").alias("right_class"), F.lit("external_id").alias("signal"), F.expr("n * (n - 1) div 2").alias("pairs"))
        links = links.unionByName(same)
    points, decides = signal_points(F.col("signal"))
    return Resolution(members, links.withColumn("score", points).withColumn("decisive", decides))


def signal_points(signal: Column) -> tuple[Column, Column]:
    """(points, whether it decides alone) of the name of a signal."""
    points = F.lit(0)
    for s, (p, _) in SIGNALS.items():
        points = F.when(signal == s, p).otherwise(points)
    return points.cast("long"), signal.isin([s for s, (_, d) in SIGNALS.items() if d])


def judge(pairs: DataFrame, found: Resolution, standing: Standing | None = None) -> DataFrame:
    """left_id, right_id (smaller first), score, outcome of the given pairs: rejected, then distinct without a signal,
    pinned if either identity is, merged by a signal that decides alone, else candidate."""
    asked = pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()
    m, links = found.members, found.links
    side = lambda own, key: m.select("layer", F.col("id").alias(own), F.col("_key").alias(key))
    at = asked.where("left_id <> right_id").join(side("left_id", "_a"), "left_id").join(side("right_id", "_b"), ["layer", "right_id"])
    at = at.select("layer", "left_id", "right_id", F.least("_a", "_b").alias("_l"), F.greatest("_a", "_b").alias("_r"))
    signals = at.join(links.select("layer", "_l", "_r", "signal"), ["layer", "_l", "_r"]).select("left_id", "right_id", "signal")
    signals = signals.unionByName(asked.where("left_id = right_id").withColumn("signal", F.lit("same_id")))
    if standing is not None:
        signals = signals.unionByName(asked.join(standing.aliases, ["left_id", "right_id"]).withColumn("signal", F.lit("alias")))
    points, decides = signal_points(F.col("signal"))
    out = asked.join(signals.groupBy("left_id", "right_id").agg(F.max(points).alias("score"), F.max(decides).alias("decisive")), ["left_id", "right_id"], "left")
    pinned = rejected = F.lit(False)
    if standing is not None:
        out = out.join(standing.rejections.withColumn("_rejected", F.lit(True)), ["left_id", "right_id"], "left")
        for own in ("left_id", "right_id"):
            out = out.join(standing.pins.select(F.col("id").alias(own), F.lit(True).alias(f"_{own}")), own, "left")
        pinned, rejected = F.coalesce("_left_id", "_right_id", F.lit(False)), F.coalesce("_rejected", F.lit(False))
    outcome = F.when(rejected, "rejected").when(F.col("score").isNull(), "distinct").when(pinned, "pinned").when(F.col("decisive"), "merged").otherwise("candidate")
    return out.select("left_id", "right_id", F.when(rejected, 0).otherwise(F.coalesce("score", F.lit(0))).cast("long").alias("score"), outcome.alias("outcome"))


def merged_identities(roots: DataFrame, records: DataFrame) -> DataFrame:
    """id, markings, sources of each surviving identity: the union of those of all that were merged into it.

    roots: id, root (merge_roots); records: id, markings, sources, each id's own."""
    own = records.join(roots.select("id", "root"), "id", "left").withColumn("id", F.coalesce("root", "id"))
    union = lambda c: own.select("id", F.explode(c).alias("x")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("x")).alias(c))
    none = lambda c: F.coalesce(c, F.array().cast(records.schema[c].dataType)).alias(c)
    return own.select("id").distinct().join(union("markings"), "id", "left").join(union("sources"), "id", "left").select("id", none("markings"), none("sources"))


def loses_a_marking(left: Column, right: Column, merged: Column) -> Column:
    return F.size(F.array_except(F.array_union(left, right), merged)) > 0
