"""Deduplication, contradiction, corroboration, confidence and decay as window functions and CASE columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score by number of independent publishers (0 to 5 and more).
LADDER = [0, 25, 60, 80, 90, 100]
#: Score of a stance.
STANCES = {"observed": 100, "analyst": 90, "reported": 70, "inferred": 55}
#: Half-life in days and floor by observable kind.
DECAY = {
    "ipv4_address": (14, 5), "ipv6_address": (14, 5), "ip_range": (60, 10), "url": (30, 5), "domain_name": (45, 10),
    "email_address": (90, 10), "autonomous_system_number": (365, 20), "mutex_name": (365, 20), "registry_key": (365, 20),
}
USUAL_DECAY = (90, 10)
CONFLICT_COST, WITHDRAWN_COST, DORMANT_AT = 25, 40, 25
#: Weights of confidence components.
WEIGHTS = {"source_reliability": 3, "information_credibility": 3, "corroboration": 3, "recency": 2, "stance": 1}


def dedup_verdicts(observations: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """observations (record_id, content_hash, publisher, record_hash, arrival) with a verdict: in arrival order, only
    the first earlier observation with the same bytes and the first of the same publisher can decide.  `seen` are earlier
    ones that are given none: of those, the firsts of a record, of its bytes and of its publishers are enough."""
    known = observations.select("record_id", "content_hash", "publisher", "record_hash", "arrival")
    known = known if seen is None else known.unionByName(seen)
    # First arrivals are aggregates, combined before any shuffle: no task orders all observations of a record.
    first = lambda c, *k: known.groupBy("record_id", *k).agg(F.min("arrival").alias(f"_{c}_at"), F.min_by(c, "arrival").alias(f"_{c}"))
    same = lambda c: F.when(F.col(f"_{c}_at") < F.col("arrival"), F.col(f"_{c}"))
    rows = observations.join(first("content_hash").drop("_content_hash"), "record_id", "left")
    rows = rows.withColumn("_any", (F.col("_content_hash_at") < F.col("arrival")).cast("int")).drop("_content_hash_at")
    rows = rows.join(first("publisher", "content_hash"), ["record_id", "content_hash"], "left").withColumn("_bytes", same("publisher")).drop("_publisher_at", "_publisher")
    rows = rows.join(first("record_hash", "publisher"), ["record_id", "publisher"], "left").withColumn("_own", same("record_hash")).drop("_record_hash_at", "_record_hash")
    verdict = (
        F.when(F.col("_any") == 0, "independent_corroboration").when(F.col("_bytes") == F.col("publisher"), "exact_duplicate")
        .when(F.col("_bytes").isNotNull(), "syndicated_copy").when(F.col("_own") == F.col("record_hash"), "canonical_duplicate")
        .when(F.col("_own").isNotNull(), "update").otherwise("independent_corroboration")
    )
    return rows.withColumn("verdict", verdict).select(*observations.columns, "verdict")


def ladder(parties: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in LADDER)), F.least(parties, F.lit(len(LADDER) - 1)).cast("int") + 1)


def lineage(verdicts: DataFrame) -> DataFrame:
    """record_id, versions, revisions, parties (independent publishers), corroboration."""
    versions = F.count(F.when(F.col("verdict") == "update", 1)) + 1
    parties = F.countDistinct(F.when(F.col("verdict") == "independent_corroboration", F.col("publisher")))
    out = verdicts.groupBy("record_id").agg(versions.alias("versions"), (versions - 1).alias("revisions"), parties.alias("parties"))
    return out.withColumn("corroboration", ladder(F.col("parties")).cast("long"))


#: Relation of two claims; the first condition that holds decides.  {l} and {r} are the sides, {differ} tells whether their
#: instants differ.
RELATION = """CASE
  WHEN {l}.status = 'revoked' OR {r}.status = 'revoked' THEN 'revoked'
  WHEN {l}.status = 'superseded' OR {r}.status = 'superseded' THEN 'supersedes'
  WHEN {l}.value <> {r}.value AND {l}.publisher = {r}.publisher AND {differ} THEN 'supersedes'
  WHEN {l}.value <> {r}.value AND ({l}.stance = 'analyst') <> ({r}.stance = 'analyst') THEN 'analyst_override'
  WHEN {l}.value = {r}.value THEN 'agrees'
  WHEN {l}.slot = 'disposition' AND (({l}.value IN ('malicious', 'suspicious') AND {r}.value IN ('benign', 'allow_listed'))
    OR ({r}.value IN ('malicious', 'suspicious') AND {l}.value IN ('benign', 'allow_listed'))) THEN 'conflict'
  WHEN {l}.slot LIKE 'attribute:%' AND substring({l}.slot, 11) IN ({single}) THEN 'conflict'
  ELSE 'compatible' END"""


#: Claims that are equal in these differ to others at most in their instant.
ALIKE = ["subject", "slot", "status", "value", "publisher", "stance"]


def _relation(single_valued: list[str], differ: str) -> Column:
    single = ", ".join(f"'{s}'" for s in single_valued) or "''"
    return F.expr(RELATION.format(l="l", r="r", single=single, differ=differ))


def _null_safe(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


#: A subject's claims are paired in blocks of about so many.
BLOCK = 1024


def related_claims(claims: DataFrame, single_valued: list[str]) -> DataFrame:
    """left_id, right_id, subject, slot, relation of each pair of claims on one subject and slot (ids ascending).

    The pairs of a hot subject are dealt to many tasks: its left claims stand in blocks, and its claims meet each block.
    Only such subjects are sent to every task, at most one a BLOCK of claims."""
    hot = claims.groupBy("subject", "slot").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks")).where("_blocks > 1")
    dealt = claims.join(F.broadcast(hot), ["subject", "slot"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    left = dealt.withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    right = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    on = reduce(lambda a, b: a & b, (F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("subject", "slot", "_block")))
    pairs = left.alias("l").join(right.alias("r"), on & (F.col("l.id") < F.col("r.id")))
    return pairs.select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), "l.subject", "l.slot", _relation(single_valued, "l.asserted_at <> r.asserted_at").alias("relation"))


def claim_classes(claims: DataFrame, more: list[str] = ()) -> DataFrame:
    """Claims that are alike (and equal in the columns `more`) as one row: class_id (their least id), n, dated (those
    with an instant)."""
    return claims.groupBy(*ALIKE, *more).agg(F.min("id").alias("class_id"), F.count("*").alias("n"), F.count("asserted_at").alias("dated"))


def claim_members(claims: DataFrame, more: list[str] = ()) -> DataFrame:
    """id, class_id of every claim."""
    classes = claim_classes(claims, more)
    return claims.alias("l").join(classes.alias("r"), _null_safe("l", "r", [*ALIKE, *more])).select("l.id", "r.class_id")


def related_classes(claims: DataFrame, single_valued: list[str], more: list[str] = ()) -> DataFrame:
    """left_id, right_id (classes, ascending), subject, slot, relation, pairs, and both sides' value and `more` (left_,
    right_): how many pairs of claims on one subject and slot stand in each relation, without making the pairs.

    Claims are met as classes, so a subject costs the square of its different statements, whatever its claims.  The
    instant decides only between different values of one publisher: there the pairs of equal instants are counted by
    an equality join of instants and taken off."""
    columns = [*ALIKE, *more]
    classes = claim_classes(claims, more)
    on = reduce(lambda a, b: a & b, (F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("subject", "slot")))
    itself = F.col("l.class_id") == F.col("r.class_id")
    pairs = classes.alias("l").join(classes.alias("r"), on & (F.col("l.class_id") <= F.col("r.class_id")))
    total = F.when(itself, F.expr("l.n * (l.n - 1) div 2")).otherwise(F.col("l.n") * F.col("r.n"))
    sides = [F.col(f"{s}.{c}").alias(f"{side}_{c}") for c in ("value", *more) for s, side in (("l", "left"), ("r", "right"))]
    pairs = pairs.select(
        F.col("l.class_id").alias("left_id"), F.col("r.class_id").alias("right_id"), F.col("l.subject").alias("subject"), F.col("l.slot").alias("slot"),
        *sides, _relation(single_valued, "false").alias("_same"), _relation(single_valued, "true").alias("_apart"), total.alias("_total"), (F.col("l.dated") * F.col("r.dated")).alias("_dated"))
    # By instant: the classes of one publisher that spoke then, with the number of their claims.
    at = claims.where("asserted_at is not null").groupBy(*columns, "asserted_at").agg(F.count("*").alias("n"))
    at = at.alias("l").join(classes.alias("r"), _null_safe("l", "r", columns)).select("r.class_id", "l.subject", "l.slot", "l.publisher", "l.value", "l.asserted_at", "l.n")
    once = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("subject", "slot", "publisher", "asserted_at")]
    met = at.alias("l").join(at.alias("r"), reduce(lambda a, b: a & b, once) & (F.col("l.value") != F.col("r.value")) & (F.col("l.class_id") < F.col("r.class_id")))
    met = met.groupBy(F.col("l.class_id").alias("left_id"), F.col("r.class_id").alias("right_id")).agg(F.sum(F.col("l.n") * F.col("r.n")).alias("_met"))
    both = pairs.join(met, ["left_id", "right_id"], "left")
    apart = F.when(F.col("_same") != F.col("_apart"), F.col("_dated") - F.coalesce("_met", F.lit(0))).otherwise(0)
    each = F.explode(F.array(F.struct(F.col("_apart").alias("relation"), apart.alias("pairs")), F.struct(F.col("_same").alias("relation"), (F.col("_total") - apart).alias("pairs"))))
    out = both.withColumn("_x", each).where("_x.pairs > 0")
    return out.select("left_id", "right_id", "subject", "slot", "_x.relation", "_x.pairs", *(f"{side}_{c}" for c in ("value", *more) for side in ("left", "right")))


def relation_summary(claims: DataFrame, single_valued: list[str]) -> DataFrame:
    """relation, pairs, subjects over all pairs of claims on one subject and slot."""
    return related_classes(claims, single_valued).groupBy("relation").agg(F.sum("pairs").alias("pairs"), F.countDistinct("subject").alias("subjects"))


def slot(kind: Column, name: Column) -> Column:
    """The slot of a claim's predicate; a narrative has none."""
    return F.when(kind == "disposition", "disposition").when(kind == "attribute", F.concat(F.lit("attribute:"), name))


def lineage_of(verdicts: DataFrame) -> DataFrame:
    """record_id, versions (content hashes in order of arrival, of first arrivals and updates), publishers (those who
    corroborate, sorted), revisions."""
    first = verdicts.groupBy("record_id").agg(F.min("arrival").alias("_first"))
    rows = verdicts.join(first, "record_id")
    new = (F.col("verdict") == "update") | (F.col("arrival") == F.col("_first"))
    lists = rows.groupBy("record_id").agg(F.array_sort(F.collect_list(F.when(new, F.struct("arrival", "content_hash")))).alias("v"), F.array_sort(F.collect_set(F.when(F.col("verdict") == "independent_corroboration", F.col("publisher")))).alias("publishers"))
    return lists.select("record_id", F.transform("v", lambda x: x["content_hash"]).alias("versions"), "publishers", (F.size("v") - 1).cast("long").alias("revisions"))


#: The order in which a record's instants are tried.
ANCHORS = ["observed", "last_seen", "published", "modified", "created", "first_seen"]


def _epoch(at: Column) -> Column:
    """Seconds since 1970 as a double, with their fraction."""
    since = at.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    part = lambda name: F.extract(F.lit(name), since)
    whole = part("DAY").cast("long") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60
    return (whole * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")) / F.lit(1e6)


def decay_anchor(instants: dict[str, Column], now: Column, future: bool = False, order: list[str] = ANCHORS) -> Column:
    """struct(anchor, at, age): the first usable instant; one after now is passed over unless it is accepted.  The age is in
    whole days, by seconds with their fractions; instants without a time zone (timestamp_ntz, with such a now) hang on none."""
    age = lambda at: F.greatest(F.floor((_epoch(now) - _epoch(at)) / 86400), F.lit(0)).cast("long")
    tried = [F.when(instants[name].isNotNull() & (F.lit(future) | (instants[name] <= now)), F.struct(F.lit(name).alias("anchor"), instants[name].alias("at"), age(instants[name]).alias("age"))) for name in order if name in instants]
    return F.coalesce(*tried)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent; all of nothing is everything."""
    return F.when(whole == 0, 100).otherwise(F.floor(part * 100 / whole)).cast("long")


def decay_parameters(kind: Column) -> tuple[Column, Column]:
    """(half-life in days, floor) of an observable kind; a file hash never decays (null half-life)."""
    half, floor = F.lit(USUAL_DECAY[0]), F.lit(USUAL_DECAY[1])
    for k, (h, f) in DECAY.items():
        half, floor = F.when(kind == k, h).otherwise(half), F.when(kind == k, f).otherwise(floor)
    return F.when(kind != "file_hash", half), floor


def age_days(at: Column, now: Column) -> Column:
    return F.greatest(F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) / 86400), F.lit(0)).cast("long")


def standing(age: Column, half_life: Column, floor: Column) -> Column:
    """Integer decay: halves every half-life, straight in between, not below the floor."""
    whole = F.floor(age / half_life).cast("int")
    upper = F.when(whole >= 7, 0).otherwise(F.expr("100") / F.pow(F.lit(2), F.least(whole, F.lit(7)))).cast("int")
    upper = F.when(whole >= 7, 0).otherwise(F.floor(upper)).cast("long")
    lower = F.floor(upper / 2).cast("long")
    inside = F.floor((upper - lower) * (age % half_life) / half_life).cast("long")
    return F.when(half_life.isNull(), F.lit(100)).otherwise(F.greatest(upper - inside, floor)).cast("long")


def decay_state(status: Column, valid_until: Column, now: Column, exempt: Column, at: Column, figure: Column) -> Column:
    return (
        F.when(status == "revoked", "revoked").when(status == "superseded", "superseded")
        .when((status == "expired") | F.coalesce(valid_until < now, F.lit(False)), "expired")
        .when(exempt, "exempt").when(at.isNull(), "undated").when(figure <= DORMANT_AT, "dormant").otherwise("live")
    )


def ranking_input(asserted: Column, figure: Column) -> Column:
    """Asserted confidence times standing, at least 1 where something was asserted."""
    return F.when(asserted > 0, F.greatest(F.floor(asserted * figure / 100), F.lit(1))).otherwise(F.floor(asserted * figure / 100)).cast("long")


def transitions(states: DataFrame) -> DataFrame:
    """subject, at, previous, state, reactivated: rows of states (subject, at, state) where the state changes."""
    before = F.lag("state").over(Window.partitionBy("subject").orderBy("at", "id"))
    out = states.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col("previous") != F.col("state")))
    return out.withColumn("reactivated", (F.col("previous") != "live") & (F.col("state") == "live"))


def weighted_mean(parts: dict[str, Column]) -> Column:
    """Integer mean of the components that are present, by WEIGHTS; null without any."""
    total = sum((F.coalesce(c * WEIGHTS[k], F.lit(0)) for k, c in parts.items()), F.lit(0))
    weight = sum((F.when(c.isNotNull(), WEIGHTS[k]).otherwise(0) for k, c in parts.items()), F.lit(0))
    return F.when(weight > 0, F.floor(total / weight)).cast("long")


def confidence(parts: dict[str, Column], conflicts: Column, status: Column, override: Column | None = None) -> tuple[Column, Column]:
    """(overall, method): the mean less the costs, at least 0; an analyst's figure replaces it."""
    mean = weighted_mean(parts)
    cost = F.when(conflicts, CONFLICT_COST).otherwise(0) + F.when(status.isin("revoked", "superseded", "expired"), WITHDRAWN_COST).otherwise(0)
    derived = F.greatest(F.coalesce(mean, F.lit(0)) - cost, F.lit(0)).cast("long")
    method = F.when(mean.isNull(), "unknown").otherwise("derived")
    if override is None:
        return derived, method
    return F.coalesce(override, derived), F.when(override.isNotNull(), "analyst_override").otherwise(method)


#: Dispositions from weak to strong.
STRENGTH = ["unknown", "benign", "allow_listed", "suspicious", "malicious"]


def strongest_disposition(rows: DataFrame, key: str) -> DataFrame:
    """The strongest current disposition of each key."""
    names = F.array(*(F.lit(x) for x in STRENGTH))
    top = F.max(F.when(F.col("status").isin("active", "deprecated"), F.array_position(names, F.col("disposition"))))
    return rows.groupBy(key).agg(F.when(top > 0, F.get(names, top.cast("int") - 1)).alias("disposition"))


def quoted(pairs: DataFrame, left: Column, right: Column, left_level: Column, right_level: Column, ceiling: int) -> DataFrame:
    """pairs with evidence: both values without control characters, 200 characters at most each; null where the level
    of either side is above the ceiling."""
    plain = lambda c: F.left(F.regexp_replace(c, r"\p{Cc}", ""), F.lit(200))
    hidden = F.coalesce(left_level > ceiling, F.lit(False)) | F.coalesce(right_level > ceiling, F.lit(False))
    return pairs.withColumn("evidence", F.when(~hidden, F.concat_ws(" / ", plain(left), plain(right))))


def freshness(seen: Column, now: Column, horizon_days: int) -> Column:
    """100 now, 0 at the horizon, straight in between; 50 without an instant."""
    horizon = horizon_days * 86400
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(seen.cast("timestamp"))
    if horizon <= 0:
        return F.when(seen.isNull(), 50).otherwise(100).cast("long")
    return F.when(seen.isNull(), 50).when(age <= 0, 100).when(age >= horizon, 0).otherwise(F.floor((horizon - age) * 100 / horizon)).cast("long")


def candidate_factors(confidence: Column, sources: Column, seen: Column, now: Column, horizon_days: int, status: Column) -> dict[str, Column]:
    """The factors by which a claim is ranked: sources is the number of its different source objects."""
    return {
        "confidence": confidence, "corroboration": F.least(sources * 25, F.lit(100)), "freshness": freshness(seen, now, horizon_days),
        "quality": F.when(status.isin("active", "deprecated"), 100).otherwise(25),
    }
