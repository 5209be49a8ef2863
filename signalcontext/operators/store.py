"""Policy, upserts, quarantine and retention over snapshot tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marking levels from open to closed.
TLP = ["clear", "green", "amber", "amber+strict", "red"]
PAP = ["clear", "green", "amber", "red"]


#: Fixed value: the former name of the lowest level.
FORMER = {"white": "clear"}
MARKING = "struct<kind:string,value:string>"


def level(name: Column, order: list[str]) -> Column:
    """Rank from 0, whatever the case and with or without the scheme's prefix; a name that is not known ranks above
    all, so that nobody is let see what cannot be read; null for null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "^(tlp|pap):", ""), "[-_]", "+")
    for old, new in FORMER.items():
        plain = F.when(plain == old, new).otherwise(plain)
    at = F.array_position(F.array(*(F.lit(x) for x in order)), plain)
    return F.when(name.isNotNull(), F.when(at > 0, (at - 1).cast("int")).otherwise(len(order)))


@dataclass(frozen=True)
class Identity:
    """Who asks: ceilings, handling caveats that are cleared, and what may be done."""

    most_tlp: str = "clear"
    most_pap: str = "clear"
    cleared: tuple[str, ...] = ()
    capabilities: tuple[str, ...] = ("read",)


def markings(tlp: Column | None = None, pap: Column | None = None, handling: Column | None = None, attribution: Column | None = None) -> Column:
    """array of (kind, value) of the columns that are not null; handling may be an array."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("value")).cast(MARKING)
    given = [F.when(c.isNotNull(), one(kind, c)) for kind, c in (("tlp", tlp), ("pap", pap), ("handling", handling), ("attribution", attribution)) if c is not None]
    return F.array_compact(F.array(*given)) if given else F.array().cast(f"array<{MARKING}>")


def decide(marks: Column, who: Identity, capability: str = "read") -> Column:
    """The reasons for which an item with these markings is withheld from an identity, one for each marking that
    refuses; an empty array lets it pass.  What is not understood refuses."""
    missing = F.array(F.lit("missing_capability")) if capability not in who.capabilities else F.array().cast("array<string>")

    def refusal(m: Column) -> Column:
        kind, value = m["kind"], F.coalesce(m["value"], F.lit(""))
        cleared = value.isin(*who.cleared) if who.cleared else F.lit(False)
        return (
            F.when((kind == "tlp") & (level(value, TLP) > TLP.index(who.most_tlp)), "tlp_above_ceiling")
            .when((kind == "pap") & (level(value, PAP) > PAP.index(who.most_pap)), "pap_above_ceiling")
            .when((kind == "handling") & ~cleared, "handling_not_cleared")
            .when((kind == "attribution") & F.lit(capability == "redistribute"), "attribution_required")
            .when(~kind.isin("tlp", "pap", "handling", "attribution") | kind.isNull(), "unknown_marking")
        )

    return F.concat(missing, F.array_compact(F.transform(F.coalesce(marks, F.array().cast(f"array<{MARKING}>")), refusal)))


def decision(tlp: Column, pap: Column, handling: Column, most_tlp: str, most_pap: str, cleared: list[str]) -> Column:
    """decide() for reading, from a column a kind of marking."""
    return decide(markings(tlp, pap, handling), Identity(most_tlp, most_pap, tuple(cleared)))


def partition(items: DataFrame, marks: Column, who: Identity, capability: str = "read") -> tuple[DataFrame, DataFrame]:
    """(what passes, what does not with its denials)."""
    judged = items.withColumn("denials", decide(marks, who, capability))
    return judged.where(F.size("denials") == 0).drop("denials"), judged.where(F.size("denials") > 0)


def permitted(marks: Column, most_tlp: str) -> Column:
    """Whether a traversal may pass: only TLP counts, and what is unmarked passes."""
    levels = F.transform(F.filter(marks, lambda m: m["kind"] == "tlp"), lambda m: F.coalesce(level(m["value"], TLP), F.lit(len(TLP))))
    return F.coalesce(F.array_max(levels), F.lit(-1)) <= TLP.index(most_tlp)


def marking_summary(items: DataFrame, key: str, marks: str = "markings") -> DataFrame:
    """key, tlp, pap (the highest level; 'unknown' above all), markings (the union, sorted)."""

    def highest(kind: str, order: list[str]) -> Column:
        top = F.max(F.when(F.col("m.kind") == kind, F.coalesce(level(F.col("m.value"), order), F.lit(len(order)))))
        return F.get(F.array(*(F.lit(x) for x in [*order, "unknown"])), top).alias(kind)

    each = items.select(key, F.explode_outer(marks).alias("m"))
    distinct = each.groupBy(key, "m").agg(F.lit(1).alias("_"))
    return distinct.groupBy(key).agg(highest("tlp", TLP), highest("pap", PAP), F.array_sort(F.collect_list("m")).alias("markings"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """kind, verdict, n of recorded decisions."""
    return decisions.groupBy("kind", "verdict").agg(F.count("*").alias("n"))


def last_writes(batch: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The last record of each key in a batch."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*(F.desc(c) for c in order))
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def document_hash(df: DataFrame, key: str) -> DataFrame:
    rest = sorted(c for c in df.columns if c != key)
    return df.withColumn("_doc", F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256))


def upsert_outcomes(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """key, outcome: inserted, updated or unchanged, by the whole document."""
    old = document_hash(stored, key).select(key, F.col("_doc").alias("_old"))
    new = document_hash(batch, key).select(key, "_doc")
    outcome = F.when(F.col("_old").isNull(), "inserted").when(F.col("_old") != F.col("_doc"), "updated").otherwise("unchanged")
    return new.join(old, key, "left").select(key, outcome.alias("outcome"))


def upserted(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The next snapshot: the batch, and what it does not replace."""
    return batch.unionByName(stored.join(batch.select(key), key, "left_anti"))


def dangling(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """id, end: edge ends that name no entity.  A task holds its share of the entities' ids and no edges: these, with the
    ends that very many of them have, pass by unsorted."""
    ends = relationships.select("id", F.explode(F.array("source_ref", "target_ref")).alias("end"))
    return ends.join(entities.select(F.col("id").alias("end")).hint("shuffle_hash"), "end", "left_anti").select("id", "end")


def quarantine_rollup(rejects: DataFrame, *key: str) -> DataFrame:
    """One row a key: first and last time, occurrences, the last reason."""
    return rejects.groupBy(*key).agg(F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"), F.count("*").alias("occurrences"), F.max_by("reason", F.struct("at", "reason")).alias("reason"))


def blobs(documents: DataFrame, most_bytes: int) -> DataFrame:
    """content_hash, byte_length, copies, outcome of content-addressed storage; too large ones are refused."""
    sized = documents.select(F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("byte_length"))
    out = sized.groupBy("content_hash", "byte_length").agg(F.count("*").alias("copies"))
    return out.withColumn("outcome", F.when(F.col("byte_length") > most_bytes, "refused").otherwise("stored"))


def sessions(sightings: DataFrame, gap_seconds: int) -> DataFrame:
    """subject, session, first_seen, last_seen, sightings: runs of sightings no further apart than the gap."""
    w = Window.partitionBy("subject").orderBy("at", "id")
    new = F.coalesce(F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(F.lag("at").over(w).cast("timestamp")) > gap_seconds, F.lit(True))
    rows = sightings.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w))
    return rows.groupBy("subject", "session").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("sightings"))


#: Classes of retention that an automatic release may take.
SWEPT = ("standard", "transient")


def release(blobs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays of blobs, audit) when the asked ones (content_hash, reason) are to go.

    blobs: content_hash, retention.  audit: content_hash, reason, outcome: released, absent, or refused for a class
    that somebody relies on."""
    rows = asked.join(blobs.select("content_hash", "retention"), "content_hash", "left")
    outcome = F.when(F.col("retention").isNull(), "absent").when(F.col("retention").isin(*SWEPT), "released").otherwise("refused")
    audit = rows.select("content_hash", "reason", outcome.alias("outcome"))
    return blobs.join(audit.where("outcome = 'released'").select("content_hash"), "content_hash", "left_anti"), audit


def integrity(blobs: DataFrame) -> DataFrame:
    """blobs (content_hash, content) with intact: whether the content still has its address."""
    return blobs.withColumn("intact", F.coalesce(F.sha2("content", 256) == F.col("content_hash"), F.lit(False)))


def quarantine_totals(rolled: DataFrame) -> DataFrame:
    """entries, occurrences of a quarantine; nothing counts as 0."""
    return rolled.agg(F.count("*").alias("entries"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"))


def invalid(df: DataFrame) -> Column:
    """The reasons for which a record is refused, by the columns that it has: an edge to itself, times in an order that
    cannot be, a score over 100, a text of more than 65536 bytes."""
    has = set(df.columns)
    after = lambda a, b: (F.col(a) > F.col(b)) if {a, b} <= has else F.lit(False)
    checks = [
        ("self_loop", (F.col("source_ref") == F.col("target_ref")) if {"source_ref", "target_ref"} <= has else F.lit(False)),
        ("seen_order", after("first_seen", "last_seen")), ("valid_order", after("valid_from", "valid_until")),
        ("score_range", ~F.col("score").between(0, 100) if "score" in has else F.lit(False)),
        ("text_bounds", F.octet_length("text") > 65536 if "text" in has else F.lit(False)),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks)))


def bounded_labels(observed: DataFrame, most: int = 64) -> DataFrame:
    """label, value, n of the values that a metric accepts: the first `most` different ones of each label by their first
    appearance (label, value, at); what comes later in new values is not counted."""
    values = observed.groupBy("label", "value").agg(F.min("at").alias("_at"), F.count("*").alias("n"))
    w = Window.partitionBy("label").orderBy("_at", "value")
    return values.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).select("label", "value", "n")


def newest_added(objects: DataFrame, *key: str) -> DataFrame:
    """key, added_after: the newest modified, or else created, of the objects; only instants in UTC ('Z') count."""
    at = F.coalesce("modified", "created")
    return objects.groupBy(*key).agg(F.max(F.when(at.endswith("Z"), at)).alias("added_after"))
