"""STIX 2.x documents as canonical records: entities, claims, sightings, relationships and rejects.

A document is one row (doc, text); it is bounded in size.  Its objects are exploded and read with one schema, so
everything after that is joins and column expressions: marking definitions and references meet by (doc, id).  An object that
cannot be read whole is rejected whole, with a reason; the others go on.  Null and empty documents give a reject.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon, ids
from ..shared import written

#: Entity kinds by object type.
ENTITY_KINDS = {
    "threat-actor": "threat_actor", "malware": "malware_family", "tool": "tool", "campaign": "campaign", "intrusion-set": "intrusion_set",
    "vulnerability": "vulnerability", "attack-pattern": "attack_technique", "identity": "identity", "infrastructure": "infrastructure",
}
#: Types of observables, and relationship types that have a kind of their own.
OBSERVABLES = ["ipv4-addr", "ipv6-addr", "domain-name", "url", "email-addr", "file"]
RELATIONS = [
    "uses", "targets", "attributed-to", "indicates", "communicates-with", "resolves-to", "downloaded-from", "hosts", "mitigates", "exploits",
    "variant-of", "impersonates", "located-at", "part-of", "derived-from", "duplicate-of", "related-to",
]
#: Disposition by indicator type; levels by name.
DISPOSITIONS = {"malicious-activity": "malicious", "benign": "benign", "anomalous-activity": "suspicious", "compromised": "suspicious"}
TLP = {"clear": "clear", "white": "clear", "green": "green", "amber": "amber", "amber+strict": "amber+strict", "red": "red"}
MOST_FAN_OUT, MOST_PATTERN, MOST_ALTERNATIVES, MOST_TYPES, MOST_OBJECTS, MOST_DEPTH = 1024, 4096, 64, 64, 1024, 64

OBJECT = """type string, id string, name string, description string, aliases array<string>, x_mitre_aliases array<string>, revoked boolean,
  value string, hashes map<string,string>, pattern string, pattern_type string, pattern_version string, indicator_types array<string>, labels array<string>,
  valid_from string, valid_until string, first_observed string, last_observed string, number_observed bigint, created_by_ref string,
  objects map<string,struct<type:string,value:string,name:string,hashes:map<string,string>>>, object_refs array<string>,
  source_ref string, target_ref string, relationship_type string, object_marking_refs array<string>,
  definition struct<tlp:string,statement:string>, external_references array<struct<source_name:string,external_id:string>>"""

SAID = "struct<assertion:string,name:string,value:string>"
FOUND = "struct<kind:string,value:string>"
_PATH = r"[^\s'\[\]()=!<>,]+(?:'[^']*')?"
# Possessive groups: Java matches them in a loop, greedy ones by a call a turn, so that a long value ends the process.
_QUOTED = r"'(?:[^'\\]++|\\.)*+'"
_COMPARISON = rf"{_PATH}\s*=\s*{_QUOTED}"
#: A pattern that can be represented: comparisons for equality, joined by OR, in one pair of brackets.
PATTERN = rf"^\s*\[\s*{_COMPARISON}(?:\s+(?i:or)\s+{_COMPARISON})*+\s*\]\s*$"


@dataclass
class Parsed:
    entities: DataFrame
    claims: DataFrame
    sightings: DataFrame
    relationships: DataFrame
    rejects: DataFrame


def objects(docs: DataFrame) -> DataFrame:
    """doc, pos, raw and the fields of each object of a bundle, or of a bare object; unread is the reason for which a
    document or object cannot be read."""
    top = F.from_json("text", "type string, objects array<string>")
    deep = canon.json_depth(F.col("text")) > MOST_DEPTH
    rows = docs.select("doc", "text", top.alias("top"), deep.alias("deep"))
    items = F.when(F.col("top.type") == "bundle", F.coalesce("top.objects", F.array().cast("array<string>"))).otherwise(F.array("text"))
    unread = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty_document").when(F.coalesce(F.col("deep"), F.lit(False)), "nested_too_deeply").when(F.col("top.type").isNull(), "missing_type")
    each = rows.select("doc", unread.alias("unread"), F.posexplode_outer(F.when(unread.isNull(), items).otherwise(F.array("text"))).alias("pos", "raw")).where("pos is not null")
    each = each.withColumn("o", F.when(F.col("unread").isNull(), F.from_json("raw", OBJECT)))
    late = F.when(F.col("o.type").isNull(), "missing_type").when(F.col("o.type") == "bundle", "nested_bundle")
    return each.select("doc", "pos", "raw", "o.*", F.coalesce("unread", late).alias("unread"))


def tlp_level(name: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[-_]", "+"), "^tlp:", "")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in TLP.items() for x in pair)), plain)


def with_markings(rows: DataFrame) -> DataFrame:
    """rows with markings: the definitions of the document that an object refers to, as an array of (kind, value)."""
    level = F.coalesce(tlp_level(F.col("name")), tlp_level(F.col("definition.tlp")))
    marking = F.when(level.isNotNull(), F.struct(F.lit("tlp").alias("kind"), level.alias("value"))).when(F.col("definition.statement").isNotNull(), F.struct(F.lit("attribution").alias("kind"), F.col("definition.statement").alias("value")))
    defined = rows.where("type = 'marking-definition' and id is not null").select("doc", F.col("id").alias("ref"), marking.alias("m")).where("m is not null")
    asked = rows.where("object_marking_refs is not null").select("doc", "pos", F.explode("object_marking_refs").alias("ref"))
    found = asked.join(defined, ["doc", "ref"]).groupBy("doc", "pos").agg(F.array_sort(F.collect_set("m")).alias("markings"))
    return rows.join(found, ["doc", "pos"], "left").withColumn("markings", F.coalesce("markings", F.array().cast("array<struct<kind:string,value:string>>")))


def _observable(kind: Column, raw: Column, name: Column, hashes: Column) -> Column:
    """struct(kind, value) of an observable object, null where it has no canonical form."""
    made = lambda k, v: F.when(v.isNotNull(), F.struct(k.alias("kind"), v.alias("value")).cast(FOUND))
    address = canon.let(canon.ip_address(raw), lambda v: made(canon.address_kind(v), v))
    # A file is the first of its digests by the name of their kind, if that is usable, else its name; a file without
    # a name is none.
    digest = F.get(F.filter(F.transform(F.array_sort(F.map_entries(hashes)), lambda e: e["value"]), lambda v: v.isNotNull()), 0)
    hashed = canon.let(canon.file_hash(digest), lambda v: made(F.lit("file_hash"), v))
    return (
        F.when(kind.isin("ipv4-addr", "ipv6-addr"), address)
        .when(kind == "domain-name", made(F.lit("domain_name"), canon.domain(raw))).when(kind == "url", made(F.lit("url"), canon.url(raw)))
        .when(kind == "email-addr", made(F.lit("email_address"), canon.email(raw)))
        .when((kind == "file") & name.isNotNull(), F.coalesce(hashed, made(F.lit("file_name"), canon.file_name(name))))
    )


def pattern_observables(pattern: Column) -> Column:
    """array of (kind, value) that a pattern names, each once; null where the pattern cannot be represented whole."""
    parts = F.regexp_extract_all(pattern, F.lit(f"({_COMPARISON})"), 1)

    def one(text: Column) -> Column:
        path = F.regexp_replace(F.regexp_extract(text, rf"^({_PATH})\s*=", 1), "'", "")
        value = F.regexp_replace(F.regexp_extract(text, rf"=\s*'((?:[^'\\]++|\\.)*+)'$", 1), r"\\(['\\])", "$1")
        kind, field = F.substring_index(path, ":", 1), F.regexp_replace(path, "^[^:]*:", "")
        digest = F.when((kind == "file") & field.rlike("^hashes[.]"), canon.let(canon.file_hash(value), lambda v: F.when(v.isNotNull(), F.struct(F.lit("file_hash").alias("kind"), v.alias("value")).cast(FOUND))))
        name = F.when((kind == "file") & (field == "name"), _observable(F.lit("file"), value, value, F.lit(None).cast("map<string,string>")))
        plain = F.when((kind != "file") & (field == "value"), _observable(kind, value, value, F.lit(None).cast("map<string,string>")))
        return F.coalesce(digest, name, plain)

    ok = (F.octet_length(pattern) <= MOST_PATTERN) & pattern.rlike(PATTERN)
    found = canon.let(parts, lambda p: F.when(F.size(p) <= MOST_ALTERNATIVES, F.transform(p, one)))
    return F.when(ok, canon.let(found, lambda f: F.when(~F.exists(f, lambda x: x.isNull()), F.array_distinct(f))))


def attack_id(references: Column) -> Column:
    """The first technique id that a source named mitre... gives."""
    usable = F.filter(references, lambda r: r["source_name"].startswith("mitre") & canon.attack_id(r["external_id"]).isNotNull())
    return canon.attack_id(F.get(usable, 0)["external_id"])


def _node(observable: Column) -> Column:
    return ids.named_uuid("observable", observable["kind"], observable["value"])


def parse(docs: DataFrame) -> Parsed:
    """docs(doc, text) as canonical frames; every object of every document is in a frame or in rejects (doc, pos, id,
    type, reason), but for marking definitions, which are only referred to."""
    rows = objects(docs)
    kinds = F.create_map(*(F.lit(x) for pair in ENTITY_KINDS.items() for x in pair))
    observable = _observable(F.col("type"), F.col("value"), F.col("name"), F.col("hashes"))
    rows = with_markings(rows).withColumns({
        "kind": F.try_element_at(kinds, F.col("type")),
        "one": F.when(F.col("type").isin(*OBSERVABLES), observable),
        "many": F.when(F.col("type") == "indicator", pattern_observables(F.col("pattern"))),
        "status": F.when(F.coalesce("revoked", F.lit(False)), "revoked").otherwise("active"),
        "from": canon.rfc3339(F.col("valid_from")), "until": canon.rfc3339(F.col("valid_until")),
        "first": canon.rfc3339(F.col("first_observed")), "last": canon.rfc3339(F.col("last_observed")),
    })
    rows = written(rows, "stix")

    types = F.coalesce("indicator_types", "labels")
    bad_time = lambda raw, at: F.col(raw).isNotNull() & F.col(at).isNull()
    indicator = (
        F.when(F.col("pattern").isNull(), "missing_pattern").when(F.lower("pattern_type") != "stix", "unsupported_pattern_type")
        .when(~F.trim("pattern_version").startswith("2"), "unsupported_pattern_version").when(F.col("many").isNull(), "unrepresentable_pattern")
        .when(bad_time("valid_from", "from") | bad_time("valid_until", "until"), "unusable_timestamp").when(F.col("until") <= F.col("from"), "impossible_validity_window")
        .when(F.size(types) > MOST_TYPES, "indicator_types_exceeded").when(F.exists(types, lambda x: x.isNull()), "non_string_indicator_type")
    )
    observed = (
        F.when(F.col("first_observed").isNull(), "missing_first_observed").when(F.col("last_observed").isNull(), "missing_last_observed").when(F.col("first").isNull() | F.col("last").isNull(), "unusable_timestamp")
        .when(F.coalesce("number_observed", F.lit(1)) < 1, "unusable_number_observed").when(F.size("objects") > MOST_OBJECTS, "observed_objects_exceeded").when(F.col("last") < F.col("first"), "impossible_observation_window")
    )
    known = F.col("type").isin("marking-definition", "relationship", "indicator", "observed-data", *OBSERVABLES, *ENTITY_KINDS)
    reason = (
        F.when(F.col("unread").isNotNull(), F.col("unread")).when(~known, "unsupported_object_type").when(F.col("kind").isNotNull() & (F.coalesce(F.trim("name"), F.lit("")) == ""), "missing_name")
        .when(F.col("type").isin(*OBSERVABLES) & F.col("one").isNull(), "uncanonicalisable_observable").when(F.col("type") == "indicator", indicator).when(F.col("type") == "observed-data", observed)
        .when((F.col("type") == "relationship") & F.col("source_ref").isNull(), "missing_source_ref").when((F.col("type") == "relationship") & F.col("target_ref").isNull(), "missing_target_ref")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null")

    named = good.where("kind is not null").withColumn("entity", ids.named_uuid("entity", F.col("kind"), F.lower("name")))
    entities = named.select("doc", "pos", F.col("entity").alias("id"), "kind", "name", "description", F.coalesce("aliases", "x_mitre_aliases", F.array().cast("array<string>")).alias("aliases"), "status", "markings", attack_id(F.col("external_references")).alias("attack_id"))

    # What an identifier of the document stands for: an entity, or the observables of an object or indicator.
    seen = good.where("id is not null")
    of_objects = seen.where("one is not null").select("doc", "id", F.array("one").alias("found"))
    of_patterns = seen.where("type = 'indicator'").select("doc", "id", F.col("many").alias("found"))
    nodes = of_objects.unionByName(of_patterns).select("doc", F.col("id").alias("ref"), F.explode("found").alias("x")).select("doc", "ref", _node(F.col("x")).alias("node"))
    nodes = written(nodes.unionByName(named.where("id is not null").select("doc", F.col("id").alias("ref"), F.col("entity").alias("node"))).distinct(), "nodes")

    # Indicators: each observable with each assertion.
    cut = lambda c: F.left(c, F.lit(65_536))
    said = lambda name, value: F.struct(F.lit("attribute").alias("assertion"), F.lit(name).alias("name"), value.alias("value")).cast(SAID)
    verdicts = F.create_map(*(F.lit(x) for pair in DISPOSITIONS.items() for x in pair))
    each_type = F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.array(said("stix.indicator_type", t), canon.let(F.try_element_at(verdicts, F.lower(F.trim(t))), lambda v: F.when(v.isNotNull(), F.struct(F.lit("disposition").alias("assertion"), F.lit(None).cast("string").alias("name"), v.alias("value")).cast(SAID)))))
    fixed = [said("stix.indicator.pattern", cut(F.col("pattern"))), F.when(F.size("many") > 1, said("stix.indicator.alternatives", F.size("many").cast("string")))]
    fixed += [F.when(F.col(c).isNotNull(), said(f"stix.indicator.{c}", cut(F.col(c)))) for c in ("name", "description")]
    told = good.where("type = 'indicator'").select("doc", "pos", "status", "markings", "from", "until", F.explode("many").alias("x"), F.array_compact(F.concat(F.array(*fixed), F.flatten(each_type))).alias("told"))
    claim = lambda df, *more: df.select("doc", "pos", _node(F.col("x")).alias("subject"), F.col("x.kind").alias("kind"), F.col("x.value").alias("observable"), *more, "status", "markings", F.col("from").alias("valid_from"), F.col("until").alias("valid_until"))
    by_indicator = claim(told.select("*", F.explode("told").alias("a")), "a.assertion", "a.name", "a.value")
    by_object = claim(good.where("one is not null").withColumn("x", F.col("one")), F.lit("attribute").alias("assertion"), F.concat(F.lit("stix."), "type").alias("name"), F.col("one.value").alias("value"))

    # Observations: embedded objects and those referred to.
    watched = good.where("type = 'observed-data'").select("doc", "pos", "status", "markings", "first", "last", F.coalesce("number_observed", F.lit(1)).alias("count"), "created_by_ref", "objects", "object_refs")
    embedded = watched.select("doc", "pos", F.explode(F.map_values("objects")).alias("o")).select("doc", "pos", _observable(F.col("o.type"), F.col("o.value"), F.col("o.name"), F.col("o.hashes")).alias("x"))
    scos = of_objects.select("doc", F.col("id").alias("ref"), F.get("found", 0).alias("x"))
    referred = watched.select("doc", "pos", F.explode("object_refs").alias("ref")).join(scos, ["doc", "ref"]).select("doc", "pos", "x")
    things = written(embedded.unionByName(referred).where("x is not null").distinct(), "observed")
    by_observer = nodes.where("node like 'entity:%'").select("doc", F.col("ref").alias("created_by_ref"), F.col("node").alias("observer"))
    seen_at = watched.drop("objects", "object_refs").join(by_observer, ["doc", "created_by_ref"], "left").join(things, ["doc", "pos"])
    sightings = seen_at.select("doc", "pos", _node(F.col("x")).alias("subject"), "observer", "count", F.col("first").alias("first_seen"), F.col("last").alias("last_seen"), "status", "markings")
    by_observation = claim(seen_at.withColumns({"from": F.lit(None).cast("timestamp"), "until": F.lit(None).cast("timestamp")}), F.lit("attribute").alias("assertion"), F.lit("stix.observed_data").alias("name"), F.col("x.value").alias("value"))
    idle = watched.select("doc", "pos").join(things.select("doc", "pos").distinct(), ["doc", "pos"], "left_anti").withColumn("late", F.lit("no_mappable_observable"))

    # Relationships: the product of what both ends stand for, up to a fan-out in the order of the document.
    edge = good.where("type = 'relationship'").select("doc", "pos", "source_ref", "target_ref", F.coalesce("relationship_type", F.lit("related-to")).alias("stated"), "status", "markings")
    count = nodes.groupBy("doc", "ref").agg(F.count("*").alias("n"))
    end = lambda name: count.select("doc", F.col("ref").alias(f"{name}_ref"), F.col("n").alias(f"{name}_n"))
    edge = edge.join(end("source"), ["doc", "source_ref"], "left").join(end("target"), ["doc", "target_ref"], "left")
    made = F.coalesce(F.col("source_n") * F.col("target_n"), F.lit(0))
    edge = edge.withColumn("upto", F.sum(made).over(Window.partitionBy("doc", "source_ref").orderBy("pos")))
    late = F.when(F.col("source_n").isNull(), "unresolved_source_ref").when(F.col("target_n").isNull(), "unresolved_target_ref").when(F.col("upto") > MOST_FAN_OUT, "fan_out_exceeded")
    edge = written(edge.withColumn("late", late), "edges")
    exact = F.col("stated").isin(*RELATIONS)
    ends = lambda name: nodes.select("doc", F.col("ref").alias(f"{name}_ref"), F.col("node").alias(name))
    relationships = edge.where("late is null").join(ends("source"), ["doc", "source_ref"]).join(ends("target"), ["doc", "target_ref"]).select(
        "doc", "pos", F.when(exact, F.replace("stated", F.lit("-"), F.lit("_"))).otherwise("related_to").alias("kind"), F.col("source").alias("source_ref"), F.col("target").alias("target_ref"), F.when(~exact, F.col("stated")).alias("note"), "status", "markings")

    late = idle.unionByName(edge.where("late is not null").select("doc", "pos", "late"))
    rejects = rows.where("reason is not null").select("doc", "pos", "id", "type", "reason").unionByName(rows.join(late, ["doc", "pos"]).select("doc", "pos", "id", "type", F.col("late").alias("reason")))
    return Parsed(entities, by_indicator.unionByName(by_object).unionByName(by_observation), sightings, relationships, rejects)
