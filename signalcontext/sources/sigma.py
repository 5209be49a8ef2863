"""Detection rules in the Sigma format: rule and technique entities, claims on rules and observables, edges.

A file holds documents parted by marker lines; each is a row of its own and read to leaves (sources/leaves.py), and all
that follows is columns of that row, so that no task holds, sorts or sends more than it reads.  A document that cannot be read, or is no rule, is rejected alone.  Conditions are
not evaluated: every selection is read, also one that a condition negates.  Fields whose meaning does not hang on the
log source name observables; fields with a modifier, other fields and values that have no canonical form are named in
one claim a rule.  Null and empty files give a reject; a file of too many documents is refused whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon, ids
from ..shared import written
from . import leaves

MOST_DOCUMENTS, MOST_TAGS, MOST_FIELD = 256, 64, 65_536
#: Fields that name an observable, by its kind.
FIELDS = {
    "ip_address": ["DestinationIp", "SourceIp", "dst_ip", "src_ip", "DestinationAddress", "SourceAddress", "c-ip", "cs-ip"],
    "domain_name": ["DestinationHostname", "SourceHostname", "dns_query", "QueryName", "cs-host", "DestinationDomain"],
    "url": ["c-uri", "cs-uri", "cs-uri-query", "Url", "uri", "url"],
    "file_hash": ["md5", "sha1", "sha256", "Hash", "Hashes", "FileHash", "imphash"],
}
#: Fields of a rule that become claims, and the statuses that withdraw it.
FACTS = ["status", "level", "author", "date", "modified", "id"]
LOG_SOURCE = ["category", "product", "service"]
WITHDRAWN = {"deprecated": "deprecated", "unsupported": "revoked"}
_MARKER = r"(?m)^---(?=[ \t\r\n]|\z)[^\n]*+\n?"
_WHITE = " \t\r\n\x0b\x0c"


@dataclass
class Rules:
    entities: DataFrame
    claims: DataFrame
    relationships: DataFrame
    rejects: DataFrame


def documents(files: DataFrame) -> DataFrame:
    """doc, part, text, many of files(doc, text): the documents of each file that are not blank."""
    parts = F.filter(F.transform(F.split("text", _MARKER, -1), lambda s: F.btrim(s, F.lit(_WHITE))), lambda s: s != "")
    rows = files.select("doc", F.coalesce(parts, F.array().cast("array<string>")).alias("parts"))
    many = F.when(F.size("parts") == 0, "empty_document").when(F.size("parts") > MOST_DOCUMENTS, "documents_exceeded")
    return rows.withColumn("many", many).select("doc", "many", F.posexplode(F.when(F.col("many").isNull(), F.col("parts")).otherwise(F.array(F.lit("")))).alias("part", "text"))


def _cut(value: Column) -> Column:
    return F.left(value, F.lit(MOST_FIELD))


def _canonical(kind: Column, raw: Column) -> Column:
    """struct(kind, value), null where the value has no canonical form."""
    pairs = [("ip_address", canon.ip_address(raw)), ("domain_name", canon.domain(raw)), ("url", canon.url(raw)), ("file_hash", canon.file_hash(raw))]
    value = F.coalesce(*(F.when(kind == k, v) for k, v in pairs))
    return canon.let(value, lambda v: F.when(v.isNotNull(), F.struct(F.when(kind == "ip_address", canon.address_kind(v)).otherwise(kind).alias("kind"), v.alias("value"))))


def _step(leaf: Column, n: int) -> Column:
    return F.get(leaf["path"], F.lit(n))


def selections(found: Column) -> Column:
    """Of a document's leaves an array of field, value, the kind of observable that the field names, whether the value is a
    string and whether it is an empty list, of every field of every selection: a mapping under the detection, or an
    entry of a sequence of mappings there."""
    at = lambda x: F.when(_step(x, 2).startswith("["), 3).otherwise(2)
    inner = F.filter(found, lambda x: (_step(x, 0) == ".detection") & (F.size(x["path"]) > 2) & F.get(x["path"], at(x)).startswith("."))
    known = F.create_map(*(F.lit(x) for kind, names in FIELDS.items() for name in names for x in (name, kind)))

    def one(x: Column) -> Column:
        field = F.substring(F.get(x["path"], at(x)), F.lit(2), F.lit(MOST_FIELD))
        # The value itself, or an entry of its list; whatever is nested further is no string.
        flat = (F.size(x["path"]) == at(x) + 1) | ((F.size(x["path"]) == at(x) + 2) & F.get(x["path"], at(x) + 1).startswith("["))
        return F.struct(field.alias("field"), x["value"].alias("value"), (x["kind"] == "empty").alias("empty"), (flat & (x["kind"] == "string")).alias("text"), F.try_element_at(known, F.trim(field)).alias("observable"))

    return F.transform(inner, one)


def _judged(x: Column) -> Column:
    """Of a selection's field the observable that it names (seen), or the reason for which it names none (missed)."""
    modified = x["field"].contains("|")
    seen = F.when(x["text"] & ~modified, _canonical(x["observable"], x["value"]))

    def missed(seen: Column) -> Column:
        return (
            F.when(modified, F.concat(x["field"], F.lit(" (modifier)"))).when(x["observable"].isNull(), x["field"]).when(x["empty"], F.lit(None).cast("string"))
            .when(~x["text"], F.concat(x["field"], F.lit(" (not a string)"))).when(seen.isNull(), F.concat(x["field"], F.lit(" (not canonical)")))
        )

    return canon.let(seen, lambda s: F.struct(s.alias("seen"), missed(s).alias("missed")))


def parse(files: DataFrame) -> Rules:
    """files(doc, text) as canonical frames; rejects are doc, part, reason, detail."""
    parts = written(documents(files), "rules")
    found = leaves.rows(parts.where("many is null").select("doc", "part", "text"), leaves.yaml_leaves)

    def text(*path: str) -> Column:
        own = F.filter("leaves", lambda x: (x["path"] == F.array(*(F.lit("." + p) for p in path))) & (x["kind"] == "string"))
        return F.array_max(F.transform(own, lambda x: x["value"]))

    facts = {name: text(name) for name in (*FACTS, "title", "description")} | {f"logsource.{name}": text("logsource", name) for name in LOG_SOURCE}
    tags = F.filter("leaves", lambda x: (_step(x, 0) == ".tags") & _step(x, 1).startswith("["))
    # A document of comments alone has no leaf: it is no rule.
    rules = found.select(
        "doc", "part", "unread", F.exists("leaves", lambda x: F.coalesce(_step(x, 0), F.lit("")).startswith(".")).alias("mapping"), F.exists("leaves", lambda x: F.coalesce(_step(x, 0), F.lit("")) == ".detection").alias("detection"),
        F.size(F.array_distinct(F.transform(tags, lambda x: _step(x, 1)))).alias("n_tags"), F.transform(F.filter(tags, lambda x: (F.size(x["path"]) == 2) & (x["kind"] == "string")), lambda x: x["value"]).alias("tags"),
        F.transform(selections(F.col("leaves")), _judged).alias("fields"), *(v.alias(k) for k, v in facts.items()),
    )
    reason = (
        F.when(F.col("unread").isNotNull(), "invalid_yaml").when(~F.col("mapping"), "not_a_rule").when(F.col("title").isNull(), "missing_title")
        .when(~F.col("detection"), "missing_detection").when(F.btrim("title", F.lit(_WHITE)) == "", "unusable_title").when(F.col("n_tags") > MOST_TAGS, "tags_exceeded")
    )
    observed = F.array_distinct(F.transform(F.filter("fields", lambda x: x["seen"].isNotNull()), lambda x: x["seen"]))
    missed = F.array_sort(F.array_distinct(F.array_compact(F.transform("fields", lambda x: x["missed"]))))
    rules = rules.select("*", reason.alias("reason"), ids.named_uuid("sigma", F.coalesce("id", "title")).alias("rule"), observed.alias("observed"), F.when(F.size(missed) > 0, F.array_join(missed, ", ")).alias("missed"))
    rules = written(rules.drop("fields", "mapping", "detection", "n_tags"), "facts")
    good = rules.where("reason is null")
    none = F.lit(None).cast("string")
    rejects = parts.where("many is not null").select("doc", "part", F.col("many").alias("reason"), none.alias("detail"))
    rejects = rejects.unionByName(rules.where("reason is not null").select("doc", "part", "reason", F.coalesce("unread", "title").alias("detail")))

    state = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in WITHDRAWN.items() for x in pair)), F.col("status")), F.lit("active"))
    entities = good.select("doc", "part", F.col("rule").alias("id"), F.lit("detection_rule").alias("kind"), _cut(F.col("title")).alias("name"), _cut(F.col("description")).alias("description"), state.alias("status"))
    said = F.array_compact(F.array(*(F.when(F.col(f"`{k}`").isNotNull(), F.struct(F.lit(f"sigma.{k}").alias("name"), _cut(F.col(f"`{k}`")).alias("value"))) for k in (*FACTS, *(f"logsource.{x}" for x in LOG_SOURCE)))))
    claims = good.select("doc", "part", F.col("rule").alias("subject"), F.explode(said).alias("c")).select("doc", "part", "subject", "c.name", "c.value")

    tags = good.select("doc", "part", "rule", F.explode("tags").alias("value"))
    technique = F.when(F.col("value").startswith("attack."), canon.attack_id(F.upper(F.substring("value", 8, MOST_FIELD))))
    named = tags.select("doc", "part", "rule", technique.alias("name")).where("name is not null").select("*", ids.named_uuid("entity", F.lit("attack_technique"), F.lower("name")).alias("id"))
    entities = entities.unionByName(named.select("doc", "part", "id", F.lit("attack_technique").alias("kind"), "name", none.alias("description"), F.lit("active").alias("status")))
    claims = claims.unionByName(tags.select("doc", "part", F.col("rule").alias("subject"), F.lit("sigma.tag").alias("name"), _cut(F.col("value")).alias("value")))

    seen = good.select("doc", "part", "rule", F.explode("observed").alias("o")).select("doc", "part", "rule", "o.kind", "o.value").withColumn("node", ids.named_uuid("observable", F.col("kind"), F.col("value")))
    claims = claims.unionByName(seen.select("doc", "part", F.col("node").alias("subject"), F.lit("sigma.detection").alias("name"), _cut(F.col("value")).alias("value")))
    claims = claims.unionByName(good.where("missed is not null").select("doc", "part", F.col("rule").alias("subject"), F.lit("sigma.detection.unread").alias("name"), _cut(F.col("missed")).alias("value")))
    edge = lambda df, to: df.select("doc", "part", F.lit("indicates").alias("kind"), F.col("rule").alias("source_ref"), F.col(to).alias("target_ref"))
    return Rules(entities, claims, edge(named, "id").unionByName(edge(seen, "node")), rejects)
