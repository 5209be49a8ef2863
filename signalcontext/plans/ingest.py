"""From documents to canonical tables: detection, parsing, strict or permissive refusal, quarantine and one commit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators.snapshot import Snapshots
from ..operators.store import dangling, quarantine_rollup
from ..shared import written
from ..sources import flat, mapped, sigma, stix

#: How sure a parser is, from low to high.
LEVELS = ["declined", "weak", "strong", "certain"]
HEAD = 8192


class IngestRefused(ValueError):
    """A strict run with documents or records that are refused; nothing is written."""


class DanglingEdge(ValueError):
    """A relationship names an entity that is neither stored nor in the batch; nothing is written, in any mode."""


def votes(media: Column, name: Column, head: Column) -> dict[str, Column]:
    """Each parser's level (0 to 3) for a document by its media type, file name and first bytes."""
    low, ends = F.lower(F.coalesce(name, F.lit(""))), lambda *x: F.lower(F.coalesce(name, F.lit(""))).rlike(rf"\.(?:{'|'.join(x)})$")
    start = F.ltrim(F.coalesce(head, F.lit("")))
    bundle = start.startswith("{") & head.rlike(r'"type"\s*:\s*"bundle"')
    typed = start.startswith("{") & head.rlike(r'"spec_version"\s*:\s*"2\.')
    line = F.get(F.split(start, "\n"), 0)
    kind = F.lower(F.coalesce(media, F.lit("")))
    other = kind.rlike("json|stix|xml") | start.rlike(r"^[\[{]")
    rule = kind.isin("application/x-sigma+yaml", "text/x-sigma") | (~other & head.contains("logsource:") & head.contains("detection:"))
    return {
        "sigma": F.when(rule, 3).otherwise(0),
        "stix": F.when(bundle, 3).when(typed | (media == "application/stix+json"), 2).otherwise(0),
        "json_lines": F.when(ends("jsonl", "ndjson") | (media == "application/x-ndjson"), 2).when(start.rlike(r"^[\[{]"), 1).otherwise(0),
        "delimited": F.when(start.rlike(r"^[\[{<]"), 0).when(ends("csv", "tsv", "txt") | (media == "text/csv"), 2).when((low != "") & line.rlike("[,;\t]"), 1).otherwise(0),
    }


def detect(docs: DataFrame) -> DataFrame:
    """docs(doc, text, and if there media, name) with parser and refused: the surest parser, the first by name of equally
    sure ones; two that are certain are ambiguous, none is unknown."""
    col = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    level = votes(col("media"), col("name"), F.left("text", F.lit(HEAD)))
    found = F.array_sort(F.filter(F.array(*(F.struct((-v).alias("order"), F.lit(p).alias("parser")) for p, v in sorted(level.items()))), lambda x: x["order"] < 0))
    rows = docs.withColumn("_found", found)
    certain = F.size(F.filter("_found", lambda x: x["order"] == -3))
    refused = F.when(F.size("_found") == 0, "unknown_format").when(certain > 1, "ambiguous_format")
    return rows.withColumn("refused", refused).withColumn("parser", F.when(refused.isNull(), F.get("_found", 0)["parser"])).drop("_found")


@dataclass
class Report:
    documents: int = 0
    accepted: int = 0
    rejected: int = 0
    reasons: dict[str, int] = field(default_factory=dict)
    outcomes: dict[str, dict[str, int]] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return self.accepted + self.rejected


CLAIM = ["id", "doc", "subject", "kind", "observable", "assertion", "name", "value", "status", "_at"]


def _no_markings() -> Column:
    return F.array().cast("array<struct<kind:string,value:string>>").alias("markings")


def _at(pos: str) -> Column:
    """Where a record stands: of several of an id, that of the last document by name and the last place in it counts."""
    return F.struct(F.col("doc").cast("string").alias("doc"), F.col(pos).cast("long").alias("pos")).alias("_at")


def _claims(rows: DataFrame, parser: str) -> DataFrame:
    """The claims of a parser under one schema; an id is made of what a claim says and where it stands."""
    if parser == "stix":
        out = rows.select("doc", "subject", "kind", "observable", "assertion", "name", "value", "status", _at("pos"))
    elif parser == "sigma":
        none = F.lit(None).cast("string")
        out = rows.select("doc", "subject", none.alias("kind"), none.alias("observable"), F.lit("attribute").alias("assertion"), "name", "value", F.lit("active").alias("status"), _at("part"))
    else:
        subject = ids.named_uuid("observable", F.col("kind"), F.col("value"))
        name = F.col("name") if parser == "json_lines" else F.col("attribute")
        out = rows.where("kind is not null and value is not null").select("doc", subject.alias("subject"), "kind", F.col("value").alias("observable"), F.lit("attribute").alias("assertion"), name.alias("name"), "value", F.lit("active").alias("status"), _at("pos" if parser == "json_lines" else "line"))
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("doc", "subject", "assertion", "name", "value")]
    return out.withColumn("id", ids.named_uuid("claim", *text)).select(*CLAIM)


def ingest(docs: DataFrame, store: Snapshots, at: str, strict: bool = False) -> Report:
    """Parses docs(doc, text[, media, name]) and writes entities, claims, sightings, relationships and quarantine in the
    store, in one commit.  Records that a parser refuses are counted and kept in quarantine by (doc, pos, reason); a
    strict run raises before anything is written, and every run does where an edge names an entity that there is not.
    The same documents again change nothing but quarantine's occurrences."""
    found = written(detect(docs), "detected")
    own = lambda p: found.where(F.col("parser") == p).select("doc", "text")
    read = stix.parse(own("stix"))
    lines = mapped.json_lines(own("json_lines"))
    flat_rows = written(flat.claims(own("delimited").withColumnRenamed("doc", "file")).withColumnRenamed("file", "doc"), "flat")
    claims = _claims(read.claims, "stix").unionByName(_claims(lines.claims, "json_lines")).unionByName(_claims(flat_rows.where("outcome = 'claim'"), "delimited"))
    edges, entities = read.relationships, read.entities
    # A batch without rules, as most are, does not pay for reading them.
    rules = None if found.where("parser = 'sigma'").isEmpty() else sigma.parse(own("sigma"))
    if rules is not None:
        claims = claims.unionByName(_claims(rules.claims, "sigma"))
        edges = edges.unionByName(rules.relationships.select("doc", F.col("part").alias("pos"), "kind", "source_ref", "target_ref", F.lit(None).cast("string").alias("note"), F.lit("active").alias("status"), _no_markings()))
        technique = F.when(F.col("kind") == "attack_technique", F.col("name"))
        entities = entities.unionByName(rules.entities.select("doc", F.col("part").alias("pos"), "id", "kind", "name", "description", F.array().cast("array<string>").alias("aliases"), "status", _no_markings(), technique.alias("attack_id")))
    links = edges.withColumn("id", ids.named_uuid("relationship", F.col("doc"), F.col("kind"), F.col("source_ref"), F.col("target_ref")))
    seen = read.sightings.withColumn("id", ids.named_uuid("sighting", F.col("doc"), F.col("subject"), F.col("first_seen").cast("string"), F.col("last_seen").cast("string")))
    tables = {k: written(v, k) for k, v in {"entities": entities.withColumn("_at", _at("pos")).drop("doc", "pos"), "claims": claims, "relationships": links.withColumn("_at", _at("pos")).drop("pos"), "sightings": seen.withColumn("_at", _at("pos")).drop("pos")}.items()}
    at_place = lambda df, pos, reason: df.select("doc", pos.cast("long").alias("pos"), reason.alias("reason"))
    refused = at_place(found.where("refused is not null"), F.lit(0), F.col("refused"))
    for df, pos, reason in ((read.rejects, F.col("pos"), F.col("reason")), (lines.rejects, F.col("pos"), F.col("reason")), (flat_rows.where("outcome <> 'claim'"), F.col("line"), F.col("outcome"))):
        refused = refused.unionByName(at_place(df, pos, reason))
    if rules is not None:
        refused = refused.unionByName(at_place(rules.rejects, F.col("part"), F.col("reason")))
    refused = written(refused, "refused")

    report = Report(documents=found.count(), accepted=sum(t.count() for t in tables.values()), reasons={r.reason: r.n for r in refused.groupBy("reason").agg(F.count("*").alias("n")).collect()})
    report.rejected = sum(report.reasons.values())
    if strict and report.rejected:
        raise IngestRefused(f"{report.rejected} of {report.total} records are refused: {report.reasons}")
    stored = store.table("entities")
    known = tables["entities"].select("id") if stored is None else tables["entities"].select("id").unionByName(stored.select("id"))
    lost = dangling(tables["relationships"], known).where("end not like 'observable:%'").first()
    if lost is not None:
        raise DanglingEdge(f"{lost.id} names {lost.end}")
    # Records and quarantine are one commit; the counters of the buckets that are touched are read, no others.
    counters = {"quarantine": refused.select("doc", "pos", "reason", F.lit(at).alias("at"))} if report.rejected else {}
    report.outcomes = store.upsert(tables | counters, order="_at", keys=QUARANTINE, fold={"quarantine": quarantined})
    report.outcomes.pop("quarantine", None)
    return report


#: The key of the quarantine's counters.
QUARANTINE = {"quarantine": ["doc", "pos", "reason"]}


def quarantined(stored: DataFrame | None, refused: DataFrame) -> DataFrame:
    """The stored counters by (doc, pos, reason) with those of refused rows, each with its time `at`."""
    new = quarantine_rollup(refused.select("doc", "pos", F.col("reason").alias("why"), F.col("reason"), "at"), "doc", "pos", "why").drop("reason").withColumnRenamed("why", "reason")
    if stored is None:
        return new
    return stored.unionByName(new).groupBy("doc", "pos", "reason").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("occurrences").alias("occurrences"))
