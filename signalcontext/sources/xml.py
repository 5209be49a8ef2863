"""XML documents as rows of elements, and two formats over them: OpenIOC indicators and IODEF incidents.

A document is read by a streaming parser inside an Arrow batch, with bounds on nesting, elements, attributes and text;
one with a document type is refused before anything in it is read.  An element row holds the numbers of all elements
above it, so "the descendants of" is an equality of (document, number), and the first of a name is a minimum over
(depth, number).  Names are without their prefixes.  A document that cannot be read is rejected whole; an incident that
cannot be used is rejected alone.  Null and empty documents give a reject.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon, ids
from ..shared import written

MOST_DEPTH, MOST_ELEMENTS, MOST_TEXT, MOST_ATTRIBUTES, MOST_FIELD = 64, 100_000, 65_536, 64, 65_536
SCHEMA = "doc string, n int, depth int, above array<int>, name string, attributes map<string,string>, text string, unread string"
#: Element rows that are sent on at a time.
BATCH = 1024
#: Searches that name an observable, by its kind.
SEARCHES = {
    "domain_name": ["Network/DNS", "DnsEntryItem/Host", "DnsEntryItem/RecordName"], "url": ["Network/URI", "UrlHistoryItem/URL", "Network/String"],
    "ip_address": ["PortItem/remoteIP", "PortItem/localIP", "Network/IP", "RouteEntryItem/Destination"],
    "file_hash": ["FileItem/Md5sum", "FileItem/Sha1sum", "FileItem/Sha256sum", "DriverItem/Md5sum"],
    "file_name": ["FileItem/FileName", "DriverItem/DriverName", "ProcessItem/name"], "email_address": ["Email/From", "Email/To"],
}
#: Categories of addresses that are read, by kind.
CATEGORIES = {"ip_address": ["ipv4-addr", "ipv6-addr"], "ip_range": ["ipv4-net", "ipv6-net"], "email_address": ["e-mail"], "url": ["site-uri", "url"]}
READERS = {"domain_name": canon.domain, "url": canon.url, "ip_address": canon.ip_address, "ip_range": canon.any_range, "file_hash": canon.file_hash, "file_name": canon.file_name, "email_address": canon.email}


class Unreadable(ValueError):
    """The reason for which a document is refused."""


def _local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


def elements_of(text: str) -> list[tuple]:
    """(n, depth, above, name, attributes, text) of each element, in the order in which they end."""
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    done: list[tuple] = []
    open_: list[list] = []
    count = 0

    def begin(name: str, attributes: dict[str, str]) -> None:
        nonlocal count
        if count >= MOST_ELEMENTS:
            raise Unreadable("too many elements")
        if len(open_) >= MOST_DEPTH:
            raise Unreadable("nested too deeply")
        if len(attributes) > MOST_ATTRIBUTES:
            raise Unreadable("too many attributes")
        open_.append([count, _local(name), {_local(k): v for k, v in attributes.items()}, [], 0])
        count += 1

    def data(piece: str) -> None:
        here = open_[-1]
        here[4] += len(piece.encode())
        if here[4] > MOST_TEXT:
            raise Unreadable("a text that is too long")
        here[3].append(piece.strip())

    def end(_: str) -> None:
        n, name, attributes, pieces, _size = open_.pop()
        done.append((n, len(open_), [x[0] for x in open_], name, list(attributes.items()), "".join(pieces)))

    def refuse(*_: object) -> None:
        raise Unreadable("a document type")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = begin, end, data, refuse
    try:
        parser.Parse(text.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        raise Unreadable(f"not well-formed: {expat.errors.messages[e.code]}") from None
    return done


def elements(docs: DataFrame) -> DataFrame:
    """SCHEMA rows of docs(doc, text); a document that cannot be read has one row with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = pa.int32()
        kinds = [pa.string(), i, i, pa.list_(i), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]

        def batch(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for b in batches:
            for doc, text in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    done = [(doc, *x, None) for x in elements_of(text)]
                except Unreadable as e:
                    done = [(doc, *[None] * 6, str(e))]
                for lo in range(0, len(done), BATCH):
                    yield batch(done[lo : lo + BATCH])

    return docs.select(F.col("doc").cast("string").alias("doc"), "text").mapInArrow(run, SCHEMA)


@dataclass
class Parsed:
    entities: DataFrame
    claims: DataFrame
    relationships: DataFrame
    rejects: DataFrame


def _cut(value: Column) -> Column:
    return F.left(value, F.lit(MOST_FIELD))


def _first(name: str, value: Column) -> Column:
    """An aggregate: the value of the first element of a name, by depth and then by place."""
    return F.min(F.when(F.col("name") == name, F.struct("depth", "n", value.alias("v"))))["v"]


def _known(kinds: dict[str, list[str]], raw: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kind, names in kinds.items() for name in names for x in (name, kind))), F.trim(raw))


def _canonical(kinds: dict[str, list[str]], kind: Column, raw: Column) -> Column:
    value = F.coalesce(*(F.when(kind == k, READERS[k](raw)) for k in kinds))
    return F.when(value.isNotNull(), F.struct(F.when(kind == "ip_address", canon.address_kind(value)).otherwise(kind).alias("kind"), value.alias("value")))


def _read(docs: DataFrame, root: str, wrong: str) -> tuple[DataFrame, DataFrame]:
    """The elements of the documents whose root has this name, and the rejects (doc, n, reason, detail) of the others."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    none = F.lit(None).cast("string")
    found = written(elements(docs.where(~blank)), "elements")
    wrongs = found.where("n = 0").where(F.col("name") != root).select("doc", F.lit(0).alias("n"), F.lit(wrong).alias("reason"), F.col("name").alias("detail"))
    rejects = docs.where(blank).select(F.col("doc").cast("string").alias("doc"), F.lit(0).alias("n"), F.lit("empty_document").alias("reason"), none.alias("detail"))
    rejects = rejects.unionByName(found.where("unread is not null").select("doc", F.lit(0).alias("n"), F.lit("unreadable_document").alias("reason"), F.col("unread").alias("detail"))).unionByName(wrongs)
    return found.where("unread is null").join(wrongs.select("doc"), "doc", "left_anti"), rejects


def _observed(found: DataFrame, prefix: str, indicator: str, kind: str, outwards: bool) -> tuple[DataFrame, DataFrame]:
    """The claims and edges of found(doc, entity, seen, missed)."""
    found = written(found, "observed")
    seen = found.where("seen is not null").select("doc", "entity", "seen.kind", "seen.value").distinct().withColumn("node", ids.named_uuid("observable", F.col("kind"), F.col("value")))
    unread = found.where("missed is not null").groupBy("doc", F.col("entity").alias("subject")).agg(F.array_join(F.array_sort(F.collect_set("missed")), ", ").alias("value"))
    claims = seen.select("doc", F.col("node").alias("subject"), F.lit(f"{prefix}.{indicator}").alias("name"), _cut(F.col("value")).alias("value"))
    claims = claims.unionByName(unread.select("doc", "subject", F.lit(f"{prefix}.unread").alias("name"), _cut(F.col("value")).alias("value")))
    ends = ("entity", "node") if outwards else ("node", "entity")
    return claims, seen.select("doc", F.lit(kind).alias("kind"), F.col(ends[0]).alias("source_ref"), F.col(ends[1]).alias("target_ref"))


def _facts(rows: DataFrame, subject: str, names: dict[str, Column]) -> DataFrame:
    said = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("name"), _cut(v).alias("value"))) for k, v in names.items())))
    return rows.select("doc", F.col(subject).alias("subject"), F.explode(said).alias("c")).select("doc", "subject", "c.name", "c.value")


def _text(name: str) -> Column:
    return F.nullif(_first(name, F.col("text")), F.lit(""))


def openioc(docs: DataFrame) -> Parsed:
    """docs(doc, text) of indicators: a rule a document, the observables that its items look for by equality, and one
    claim that names the items that were not read; an item under another condition is one of those."""
    found, rejects = _read(docs, "ioc", "not_an_ioc")
    heads = found.groupBy("doc").agg(
        F.max(F.when(F.col("n") == 0, F.try_element_at("attributes", F.lit("id")))).alias("id"), _text("short_description").alias("title"), _text("description").alias("description"),
        *(_text(x).alias(x) for x in ("authored_by", "authored_date", "last-modified")),
    )
    heads = heads.withColumn("key", F.coalesce("id", "title")).withColumn("name", F.coalesce("title", "key"))
    heads = heads.withColumn("reason", F.when(F.col("key").isNull(), "missing_identifier").when(F.trim("name") == "", "unusable_title")).withColumn("entity", ids.named_uuid("openioc", F.col("key")))
    heads = written(heads, "iocs")
    good = heads.where("reason is null")

    items = found.where("name = 'IndicatorItem'").select("doc", F.col("n").alias("item"), F.coalesce(F.try_element_at("attributes", F.lit("condition")), F.lit("is")).alias("condition"))
    inner = found.where("name in ('Context', 'Content')").select("doc", F.explode("above").alias("item"), "depth", "n", "name", "text", "attributes").join(items, ["doc", "item"])
    inner = inner.groupBy("doc", "item", "condition").agg(_first("Context", F.try_element_at("attributes", F.lit("search"))).alias("search"), _first("Content", F.col("text")).alias("content"))
    inner = inner.where("search <> '' and content <> ''").join(good.select("doc", "entity"), "doc")
    equal, kind = F.lower("condition") == "is", _known(SEARCHES, F.col("search"))
    seen = F.when(equal, _canonical(SEARCHES, kind, F.col("content")))
    missed = F.when(~equal, F.concat("search", F.lit(" (condition `"), "condition", F.lit("`)"))).when(kind.isNull(), F.col("search")).when(seen.isNull(), F.concat("search", F.lit(" (not canonical)")))
    read = written(inner.select("doc", "entity", seen.alias("seen"), missed.alias("missed")), "items")
    claims, edges = _observed(read, "openioc", "indicator", "indicates", True)
    claims = claims.unionByName(_facts(good, "entity", {f"openioc.{x}": F.col(f"`{x}`") for x in ("authored_by", "authored_date", "last-modified")}))
    entities = good.select("doc", F.col("entity").alias("id"), F.lit("detection_rule").alias("kind"), _cut(F.col("name")).alias("name"), _cut(F.col("description")).alias("description"))
    rejects = rejects.unionByName(heads.where("reason is not null").select("doc", F.lit(0).alias("n"), "reason", F.col("key").alias("detail")))
    idle = good.join(read.select("doc").distinct(), "doc", "left_anti").select("doc", F.lit(0).alias("n"), F.lit("no_indicator_items").alias("reason"), F.left("key", F.lit(200)).alias("detail"))
    return Parsed(entities, claims, edges, rejects.unionByName(idle))


def iodef(docs: DataFrame) -> Parsed:
    """docs(doc, text) of incidents: an entity, its times, purpose and severity, and the addresses that are part of it."""
    found, rejects = _read(docs, "IODEF-Document", "not_iodef")
    incidents = found.where("name = 'Incident' and n > 0").select("doc", F.col("n").alias("incident"), F.try_element_at("attributes", F.lit("purpose")).alias("purpose"))
    below = found.select("doc", F.explode("above").alias("incident"), "depth", "n", "name", "text", "attributes").join(incidents, ["doc", "incident"])
    below = written(below, "below")
    attribute = lambda name: F.try_element_at("attributes", F.lit(name))
    heads = below.groupBy("doc", "incident").agg(
        _first("IncidentID", F.col("text")).alias("number"), _first("IncidentID", F.coalesce(attribute("name"), F.lit("unnamed-csirt"))).alias("authority"), _text("Description").alias("description"),
        _first("Impact", attribute("severity")).alias("severity"), *(_text(x).alias(x) for x in ("ReportTime", "StartTime", "EndTime")),
    )
    heads = incidents.join(heads, ["doc", "incident"], "left")
    heads = heads.withColumn("reason", F.when(F.col("number").isNull(), "missing_incident_id").when(F.col("number") == "", "empty_incident_id"))
    heads = written(heads.withColumn("entity", ids.named_uuid("iodef", F.lower("authority"), F.col("number"))), "incidents")
    good = heads.where("reason is null")

    rows = below.where("name = 'Address' and text <> ''").join(good.select("doc", "incident", "entity"), ["doc", "incident"])
    category = F.coalesce(attribute("category"), F.lit(""))
    kind = _known(CATEGORIES, category)
    seen = _canonical(CATEGORIES, kind, F.col("text"))
    missed = F.when(kind.isNull(), F.concat(F.lit("Address category `"), category, F.lit("`"))).when(seen.isNull(), F.concat(F.lit("Address `"), category, F.lit("` (not canonical)")))
    claims, edges = _observed(rows.select("doc", "entity", seen.alias("seen"), missed.alias("missed")), "iodef", "address", "part_of", False)
    facts = {"iodef.report_time": "ReportTime", "iodef.start_time": "StartTime", "iodef.end_time": "EndTime", "iodef.purpose": "purpose", "iodef.impact.severity": "severity"}
    claims = claims.unionByName(_facts(good, "entity", {k: F.col(v) for k, v in facts.items()}))
    name = F.concat("authority", F.lit(" incident "), "number")
    entities = good.select("doc", F.col("entity").alias("id"), F.lit("incident").alias("kind"), _cut(name).alias("name"), _cut(F.col("description")).alias("description"))
    rejects = rejects.unionByName(heads.where("reason is not null").select("doc", F.col("incident").alias("n"), "reason", F.lit(None).cast("string").alias("detail")))
    empty = found.where("n = 0").select("doc").join(incidents.select("doc").distinct(), "doc", "left_anti").select("doc", F.lit(0).alias("n"), F.lit("no_incidents").alias("reason"), F.lit(None).cast("string").alias("detail"))
    return Parsed(entities, claims, edges, rejects.unionByName(empty))
