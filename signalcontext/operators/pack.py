"""Context packs: what may be told about each of many subjects, with evidence, gaps and exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon, ids
from .evidence import STRENGTH, percent
from .store import MARKING, Identity, decide

#: Levels of detail that are served, those that hold no raw records, and the longest value of a claim there.
SERVED, SUMMARIES, SUMMARY_BYTES = ("L0", "L1", "L2", "L3"), ("L0", "L1", "L2"), 2048
#: The order in which what a pack says stands, the texts of gaps.
GAPS = {
    "store": "no record of this subject was found",
    "sightings": "never reported as seen, so the time of its last activity is open",
    "evidence": "its claims name no source that could be checked",
    "claims": "none of its claims is still in force",
    "policy": "part of the answer is held back by handling rules",
}


def _gathered(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of each subject by id: a subject's hot list is cut before it is shuffled."""
    w = Window.partitionBy("subject").orderBy("id")
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def packs(subjects: DataFrame, claims: DataFrame, edges: DataFrame, sightings: DataFrame, who: Identity, detail: str = "L2", objects: int = 50, links: int = 50) -> DataFrame:
    """One pack a subject.

    subjects: subject.  claims: id, subject, assertion, value, status, markings, sources (array).  edges: id, subject,
    kind, other, markings.  sightings: subject.  At most `objects` claims and `links` edges are read of each subject,
    then those that the identity may not read are withheld.  L0 has no graph; L4 and L5 are refused; a value that is
    too long for a summary makes the pack invalid (column problems).  Columns: subject, disposition, claims, relationships
    (graph), handles, evidence, gaps, exclusions, markings, restricted, exhausted, problems, fingerprint."""
    if detail not in SERVED:
        raise ValueError(f"{detail} is reached by expanding a handle")
    names, none, text = F.array(*(F.lit(x) for x in STRENGTH)), F.array().cast("array<string>"), F.col("value").cast("string")

    def allowed(rows: DataFrame, most: int) -> DataFrame:
        return _gathered(rows, most).withColumn("_ok", F.size(decide(F.col("markings"), who)) == 0)

    current = F.col("status").isin("active", "deprecated")
    kept = lambda x: F.when(F.col("_ok"), x)
    marks = lambda: F.flatten(F.collect_list(kept(F.col("markings"))))
    c = allowed(claims, objects).groupBy("subject").agg(
        F.array_sort(F.collect_list(kept(F.struct(F.col("id").cast("string").alias("id"), "assertion", text.alias("value"), "status")))).alias("claims"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(kept(F.col("sources")))))).alias("evidence"),
        F.max(kept(F.when(current & (F.col("assertion") == "disposition"), F.array_position(names, text)))).alias("_top"),
        F.max(kept(current)).alias("_current"), F.count(F.when(~F.col("_ok"), 1)).alias("_held"), marks().alias("_marks"),
        F.max(kept(F.octet_length(text))).alias("_longest"))
    e = allowed(edges, links).groupBy("subject").agg(
        F.array_sort(F.collect_list(kept(F.struct(F.col("id").cast("string").alias("id"), "kind", "other")))).alias("relationships"), F.count(F.when(~F.col("_ok"), 1)).alias("_edges_held"), marks().alias("_edge_marks"))
    rows = subjects.select("subject").distinct().join(c, "subject", "left").join(e, "subject", "left").join(sightings.select("subject").distinct().withColumn("_seen", F.lit(True)), "subject", "left")
    many = lambda name: F.coalesce(F.size(name), F.lit(0))
    held = F.coalesce("_held", F.lit(0)) + F.coalesce("_edges_held", F.lit(0))
    n, m, sources = many("claims"), many("relationships"), many("evidence")
    full_c, full_e = n >= objects, m >= links
    said = {
        "store": (n == 0) & (m == 0), "sightings": F.col("_seen").isNull(), "evidence": (sources == 0) & (n > 0),
        "claims": (n > 0) & ~F.coalesce("_current", F.lit(False)), "policy": held > 0,
    }
    out = [("claims:policy_restricted", held > 0), ("claims:budget_exhausted", full_c), ("relationships:budget_exhausted", full_e), ("graph:below_detail_level", F.lit(detail == "L0"))]
    listed = lambda items: F.array_compact(F.array(*(F.when(ok, F.lit(name)) for name, ok in items)))
    graph = lambda name, kind: (F.coalesce(name, F.array().cast(kind)) if detail != "L0" else F.array().cast(kind)).alias(name)
    long = (F.coalesce("_longest", F.lit(0)) > SUMMARY_BYTES) & F.lit(detail in SUMMARIES and detail != "L0")
    disposition = F.when(F.col("_top") > 0, F.get(names, F.col("_top").cast("int") - 1)).otherwise("unknown")
    noted = f"array<{MARKING}>"
    body = rows.select(
        "subject", F.lit(detail).alias("detail"), disposition.alias("disposition"),
        graph("claims", "array<struct<id:string,assertion:string,value:string,status:string>>"), graph("relationships", "array<struct<id:string,kind:string,other:string>>"),
        F.coalesce(F.transform("claims", lambda x: x["id"]), none).alias("handles"), F.coalesce("evidence", none).alias("evidence"),
        listed(said.items()).alias("gaps"), listed(out).alias("exclusions"),
        F.array_sort(F.array_distinct(F.concat(F.coalesce("_marks", F.array().cast(noted)), F.coalesce("_edge_marks", F.array().cast(noted))))).alias("markings"),
        (held > 0).alias("restricted"), (full_c | full_e).alias("exhausted"), listed([("summary_carries_long_value", long)]).alias("problems"))
    body = body.withColumn("finding", F.when(F.size("evidence") > 0, F.concat(F.lit("assessed as "), "disposition", F.lit("."))))
    return body.withColumn("fingerprint", fingerprint(body))


def fingerprint(packs: DataFrame) -> Column:
    """Digest of all that a pack says, in a fixed order of its fields; when and for whom it was made is no part of it."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(packs.columns) if c not in ("fingerprint", "problems"))), {"ignoreNullFields": "false"}), 256)


def problems(packs: DataFrame) -> Column:
    """The invariants that packs from elsewhere break: a finding without evidence, a restriction or a spent budget
    that no exclusion names, a fingerprint that is not theirs."""
    names = lambda reason: F.exists("exclusions", lambda x: x.endswith(reason))
    checks = {
        "finding_without_evidence": F.col("finding").isNotNull() & (F.size("evidence") == 0), "restricted_without_exclusion": F.col("restricted") & ~names("policy_restricted"),
        "exhausted_without_exclusion": F.col("exhausted") & ~names("budget_exhausted"), "fingerprint_differs": F.col("fingerprint") != fingerprint(packs),
    }
    return F.array_compact(F.array(*(F.when(bad, name) for name, bad in checks.items())))


def clear(packs: DataFrame, who: Identity, interchange: bool) -> tuple[DataFrame, DataFrame]:
    """(packs that may leave, those that may not with denials): a form for machines of others needs the right to
    redistribute, a form to be read the right to read."""
    judged = packs.withColumn("denials", decide(F.col("markings"), who, "redistribute" if interchange else "read"))
    return judged.where(F.size("denials") == 0).drop("denials"), judged.where(F.size("denials") > 0)


def as_json(packs: DataFrame) -> Column:
    """One line of JSON a pack."""
    return F.to_json(F.struct(*(F.col(c) for c in packs.columns if c != "problems")), {"ignoreNullFields": "false"})


def as_json_lines(packs: DataFrame) -> DataFrame:
    """subject, line: a line for the pack, then one for each claim, relationship and gap."""
    one = lambda kind, x: F.to_json(F.struct(F.lit(kind).alias("record"), F.col("subject"), x), {"ignoreNullFields": "false"})
    head = F.array(one("pack", F.struct("disposition", "detail", "fingerprint", "evidence").alias("pack")))
    each = lambda kind, c: F.transform(c, lambda x: one(kind, x.alias(kind)))
    return packs.select("subject", F.posexplode(F.concat(head, each("claim", "claims"), each("relationship", "relationships"), each("gap", "gaps")))).select("subject", F.col("pos").alias("place"), F.col("col").alias("line"))


def as_markdown(packs: DataFrame) -> Column:
    """A page a pack; whatever a source wrote is escaped."""
    esc = canon.markdown_escaped
    bullets = lambda c, f: F.concat_ws("\n", F.transform(c, lambda x: F.concat(F.lit("- "), f(x))))
    section = lambda title, c, f: F.when(F.size(c) > 0, F.concat(F.lit(f"## {title}\n\n"), bullets(c, f)))
    gap = lambda x: F.element_at(F.create_map(*(F.lit(v) for kv in GAPS.items() for v in kv)), x)
    return F.concat_ws(
        "\n\n", F.concat(F.lit("# "), esc(F.col("subject"))), F.concat(F.lit("Disposition: "), "disposition"),
        section("Claims", "claims", lambda x: F.concat(esc(x["assertion"]), F.lit(": "), esc(F.coalesce(x["value"], F.lit(""))), F.lit(" ("), x["status"], F.lit(")"))),
        section("Relationships", "relationships", lambda x: F.concat(x["kind"], F.lit(" "), esc(x["other"]))), section("Evidence", "evidence", esc), section("Gaps", "gaps", gap))


def quality(reports: DataFrame, least_evidence: int) -> DataFrame:
    """reports (canonical, included, clustered, dropped, source_bytes, output_bytes, evidence_before, evidence_after,
    contradictions_before, contradictions_after) with reduction, evidence_kept, contradictions_kept (percent),
    reconciles, acceptable: the counts add up, enough evidence and every contradiction is kept."""
    c = F.col
    out = reports.withColumn("reconciles", c("included") + c("clustered") + c("dropped") == c("canonical"))
    out = out.withColumn("reduction", percent(F.greatest(c("source_bytes") - c("output_bytes"), F.lit(0)), c("source_bytes")))
    out = out.withColumn("evidence_kept", percent(c("evidence_after"), c("evidence_before"))).withColumn("contradictions_kept", percent(c("contradictions_after"), c("contradictions_before")))
    return out.withColumn("acceptable", c("reconciles") & (c("evidence_kept") >= least_evidence) & (c("contradictions_kept") == 100))


def subject(kind: Column, value: Column) -> Column:
    """struct(kind, value): the observable that a caller names; null for a kind that is not known or a value that is not
    well formed.  A bare digest is told by its length (32, 40 or 64), a stated algorithm wins."""
    v = F.trim(value)
    of = lambda name, c: F.when(c.isNotNull(), F.struct(F.lit(name).alias("kind"), c.alias("value")))
    four, six, digest = canon.ipv4(v), canon.ipv6(v), canon.file_hash(v)
    stated = lambda name: of("file_hash", F.when(digest.startswith(name + ":"), digest))
    ipv4, ipv6 = of("ipv4_address", four), of("ipv6_address", six)
    return (
        F.when(kind == "ip", F.coalesce(ipv4, ipv6)).when(kind == "ipv4", ipv4).when(kind == "ipv6", ipv6).when(kind.isin("domain", "hostname"), of("domain_name", canon.domain(v)))
        .when(kind == "url", of("url", canon.url(v))).when(kind == "email", of("email_address", canon.email(v))).when(kind == "file_hash", of("file_hash", F.when(~digest.startswith("sha512:"), digest)))
        .when(kind == "md5", stated("md5")).when(kind == "sha1", stated("sha1")).when(kind == "sha256", stated("sha256"))
    )


#: Observable kinds with an object of their own in STIX 2.1 (type, key), and labels of indicators.
OBSERVED = {
    "ipv4_address": ("ipv4-addr", "value"), "ipv6_address": ("ipv6-addr", "value"), "domain_name": ("domain-name", "value"), "url": ("url", "value"),
    "email_address": ("email-addr", "value"), "file_name": ("file", "name"), "mac_address": ("mac-addr", "value"), "ip_range": ("ipv4-addr", "value"),
}
LABELS = {"malicious": "malicious-activity", "suspicious": "anomalous-activity", "benign": "benign"}


def as_stix(packs: DataFrame, kind: Column, value: Column, at: Column) -> Column:
    """A STIX 2.1 bundle a pack as JSON: the subject, an indicator of its disposition, and a note for what STIX has no
    field for.

    kind and value are the subject's; at is the instant of all objects as text.  Ids follow from contents.  A kind
    without an object of its own is an indicator with a pattern.  Lost: the budget, the structure of gaps and
    exclusions, the level of detail, handles, and the relationships of the pack."""
    of = lambda names: F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), kind)
    type_, key = of({k: t for k, (t, _) in OBSERVED.items()}), F.when(kind == "file_name", "name").otherwise("value")
    named = lambda t, *parts: F.concat(t, F.lit("--"), F.substring_index(ids.named_uuid("stix", *parts), ":", -1))
    times = [at.alias("created"), at.alias("modified")]
    head = lambda t, i: [t.alias("type"), F.lit("2.1").alias("spec_version"), i.alias("id")]
    quoted = F.concat(F.lit(" = '"), canon.pattern_escaped(value), F.lit("']"))
    pattern = F.when(type_.isNotNull(), F.concat(F.lit("["), type_, F.lit(":"), key, quoted)).otherwise(F.concat(F.lit("[x-unmapped:"), kind, quoted))
    sign, note, edge = F.lit("indicator"), F.lit("note"), F.lit("relationship")
    # Nulls are left out of the JSON: an object has the keys that its type has.
    own = F.when(type_.isNotNull(), named(type_, F.coalesce(type_, F.lit("")), value)).otherwise(named(sign, F.lit("subject"), pattern))
    plain = F.when(kind == "file_name", F.to_json(F.struct(*head(type_, own), value.alias("name")))).otherwise(F.to_json(F.struct(*head(type_, own), value.alias("value"))))
    bare = F.to_json(F.struct(*head(sign, own), *times, value.alias("name"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), at.alias("valid_from")))
    label = F.try_element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.col("disposition"))
    said = named(sign, F.lit("disposition"), F.coalesce(label, F.lit("")), pattern)
    indicator = F.to_json(F.struct(*head(sign, said), *times, F.concat_ws(" ", kind, value).alias("name"), F.col("finding").alias("description"), F.array(label).alias("indicator_types"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), at.alias("valid_from")))
    based = F.to_json(F.struct(*head(edge, named(edge, F.lit("based-on"), said, own)), *times, F.lit("based-on").alias("relationship_type"), said.alias("source_ref"), own.alias("target_ref")))
    gap = lambda g: F.concat(F.lit("Not known: "), F.element_at(F.create_map(*(F.lit(v) for kv in GAPS.items() for v in kv)), g))
    lines = F.concat(
        F.transform("claims", lambda c: F.concat(F.lit("Claim: "), c["assertion"], F.lit(" = "), F.coalesce(c["value"], F.lit("")), F.lit(" ("), c["status"], F.lit(")"))),
        F.transform("gaps", gap), F.transform("exclusions", lambda x: F.concat(F.lit("Withheld: "), x)))
    content = F.array_join(lines, "\n")
    noted = F.to_json(F.struct(*head(note, named(note, F.lit("note"), content)), *times, F.lit("context that STIX 2.1 has no field for").alias("abstract"), content.alias("content"), F.array(own).alias("object_refs")))
    objects = F.array_compact(F.array(F.when(type_.isNotNull(), plain).otherwise(bare), F.when(label.isNotNull(), indicator), F.when(label.isNotNull(), based), F.when(F.size(lines) > 0, noted)))
    bundle = named(F.lit("bundle"), F.lit("bundle"), F.col("fingerprint"))
    return F.concat(F.lit('{"type":"bundle","id":"'), bundle, F.lit('","objects":['), F.array_join(objects, ","), F.lit("]}"))
