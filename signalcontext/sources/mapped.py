"""JSON, JSON lines and CSV records as claims, by inference or by a declared mapping.

Records are VARIANT values: a path of a mapping is navigated by Spark's variant functions and a wildcard by a
transform over an array, so that a mapping is compiled to columns once and runs on every record in parallel.

A mapping: {"format": "json" | "jsonl" | "csv", "records": path, "filters": [{"path", "op", "value"}], "fields":
[{"path", "target", "name", "kind", "transforms"}]} where exactly one field has the target "subject".  A record that a
filter does not let pass is skipped; one without exactly one subject, or with a value that its target refuses, is
rejected whole.  Null and empty documents give no records.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon

MOST_SEGMENTS, MOST_WILDCARDS, MOST_PATH, MOST_FIELDS = 16, 2, 512, 64
OPERATORS = ("equals", "not_equals", "present", "absent", "starts_with", "contains")
TARGETS = ("subject", "observable", "infer", "attribute", "disposition", "ignore")
#: Words for malicious and for benign.
TRUTHY = ["true", "yes", "y", "1", "malicious", "bad", "block", "deny"]
FALSY = ["false", "no", "n", "0", "benign", "good", "allow", "clean"]
READERS = {
    "ip_address": canon.ip_address, "ip_range": canon.any_range, "domain_name": canon.domain, "url": canon.url, "email_address": canon.email, "file_hash": canon.file_hash,
    "file_name": canon.file_name, "file_path": canon.file_path, "network": canon.any_network, "mac_address": canon.mac, "cve": canon.cve, "cpe": canon.cpe, "package_url": canon.package_url,
    "container_image": canon.container_image, "cloud_resource": canon.cloud_resource, "kubernetes_resource": canon.kubernetes_resource,
}


class MappingError(ValueError):
    """A mapping or a path that is refused before any document is read."""


def segments(path: str) -> list[str]:
    """The parts of a path between its wildcards, each a path of its own: $.a[0].b[*].c -> $.a[0].b, $.c."""
    if len(path.encode()) > MOST_PATH or not re.fullmatch(r"\$(?:\.[A-Za-z_][A-Za-z0-9_-]*|\[\d{1,6}\]|\[\*\])*", path):
        raise MappingError(f"{path!r} is not a path")
    steps = re.findall(r"\.[A-Za-z_][A-Za-z0-9_-]*|\[\d+\]|\[\*\]", path)
    if len(steps) > MOST_SEGMENTS or steps.count("[*]") > MOST_WILDCARDS:
        raise MappingError(f"{path!r} has too many steps")
    parts = [""]
    for step in steps:
        if step == "[*]":
            parts.append("")
        else:
            parts[-1] += f"['{step[1:]}']" if step[0] == "." else step
    return ["$" + p for p in parts]


def nodes(value: Column, path: str) -> Column:
    """array<variant> of what a path leads to."""
    found = F.array(value)
    *inner, last = segments(path)
    for part in inner:
        found = F.flatten(F.transform(found, lambda x: F.coalesce(F.try_variant_get(x, part, "array<variant>"), F.expr("cast(array() as array<variant>)"))))  # noqa: B023
    return F.filter(F.transform(found, lambda x: F.try_variant_get(x, last, "variant")), lambda x: x.isNotNull())


def values(value: Column, path: str, steps: list[dict] = ()) -> Column:
    """array<string> of the scalars that a path leads to, transformed; blank ones are dropped."""
    scalars = F.filter(nodes(value, path), lambda x: ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)"))
    text = F.transform(scalars, lambda x: canon.transformed(F.try_variant_get(x, "$", "string"), list(steps)))
    return F.filter(text, lambda x: x.isNotNull() & (F.trim(x) != ""))


def validated(mapping: dict) -> dict:
    """The mapping, or a MappingError that names what is wrong."""
    if mapping.get("format") not in ("json", "jsonl", "csv"):
        raise MappingError("the format is json, jsonl or csv")
    fields = mapping.get("fields", [])
    if not 0 < len(fields) <= MOST_FIELDS:
        raise MappingError(f"a mapping has 1 to {MOST_FIELDS} fields")
    segments(mapping.get("records", "$"))
    seen = set()
    for f in fields:
        segments(f["path"])
        if f.get("target") not in TARGETS:
            raise MappingError(f"unknown target {f.get('target')!r}")
        if f["target"] in ("subject", "observable") and f.get("kind") not in READERS:
            raise MappingError(f"unknown kind {f.get('kind')!r}")
        if f["target"] == "attribute" and not f.get("name"):
            raise MappingError("an attribute needs a name")
        if len(f.get("transforms", [])) > canon.MOST_TRANSFORMS:
            raise MappingError("too many transforms")
        key = (f["path"], f["target"], f.get("name"), f.get("kind"))
        if key in seen:
            raise MappingError(f"{f['path']} is mapped twice")
        seen.add(key)
    if sum(f["target"] == "subject" for f in fields) != 1:
        raise MappingError("exactly one field is the subject")
    for x in mapping.get("filters", []):
        segments(x["path"])
        if x.get("op") not in OPERATORS:
            raise MappingError(f"unknown operator {x.get('op')!r}")
    return mapping


def explained(mapping: dict) -> list[str]:
    """What a mapping does, a line a rule."""
    m = validated(mapping)
    out = [f"each {m['format']} record at {m.get('records', '$')}"]
    out += [f"only if {x['path']} {x['op'].replace('_', ' ')} {x.get('value', '')}".rstrip() for x in m.get("filters", [])]
    return out + [f"{f['path']} -> {f['target']} {f.get('name') or f.get('kind') or ''}".rstrip() + "".join(f", {s['op']}" for s in f.get("transforms", [])) for f in m["fields"]]


def _csv_fields(line: Column) -> Column:
    """The trimmed fields of a CSV line; quotes may hold commas and doubled quotes.
    Possessive groups are matched in a loop, so a cell may be as long as a document."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',\s*+("(?:[^"]++|"")*+"|[^,]*+)'), 1)
    return F.transform(cells, lambda c: F.trim(F.when(c.startswith('"'), F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)))


def records(docs: DataFrame, kind: str, path: str = "$") -> DataFrame:
    """doc, pos, record (VARIANT; null where it cannot be read) of docs(doc, text)."""
    rows = docs.where("trim(text) <> ''").withColumn("text", F.regexp_replace("text", "^﻿", ""))
    if kind == "json":
        return rows.select("doc", F.posexplode_outer(nodes(F.try_parse_json("text"), path)).alias("pos", "record")).withColumn("pos", F.coalesce("pos", F.lit(0)))
    lines = rows.select("doc", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line")).where("trim(line) <> ''")
    if kind == "jsonl":
        return lines.select("doc", "pos", F.try_parse_json("line").alias("line")).select("doc", "pos", F.explode_outer(F.when(F.col("line").isNotNull(), nodes(F.col("line"), path))).alias("record"))
    heads = rows.select("doc", _csv_fields(F.element_at(F.filter(F.split("text", r"\r?\n", -1), lambda x: F.trim(x) != ""), 1)).alias("names"), F.split("text", r"\r?\n", -1).alias("all"))
    body = heads.select("doc", "names", F.posexplode("all").alias("pos", "line"), F.array_position("all", F.element_at(F.filter("all", lambda x: F.trim(x) != ""), 1)).alias("head")).where("trim(line) <> '' and pos >= head")
    cells = F.slice(F.concat(_csv_fields(F.col("line")), F.array_repeat(F.lit("").cast("string"), F.size("names"))), 1, F.size("names"))
    return body.select("doc", "pos", F.try_parse_json(F.to_json(F.map_from_entries(F.arrays_zip(F.col("names").alias("names"), cells.alias("cells"))))).alias("record"))


def passes(record: Column, filters: list[dict]) -> Column:
    """Whether a record meets every filter; starts_with and contains look at the first value alone."""
    out = F.lit(True)
    for x in filters:
        found, want = values(record, x["path"]), x.get("value", "")
        first = F.coalesce(F.get(found, 0), F.lit(""))
        tests = {
            "equals": lambda: F.array_contains(found, want), "not_equals": lambda: ~F.array_contains(found, want), "present": lambda: F.size(found) > 0, "absent": lambda: F.size(found) == 0,
            "starts_with": lambda: first.startswith(want), "contains": lambda: first.contains(want),
        }
        out = out & F.coalesce(tests[x["op"]](), F.lit(False))
    return out


@dataclass
class Mapped:
    claims: DataFrame
    rejects: DataFrame


CLAIM = "struct<field:int,target:string,name:string,kind:string,value:string>"


def apply(docs: DataFrame, mapping: dict) -> Mapped:
    """The claims (doc, pos, subject_kind, subject, assertion, name, kind, value) and rejects (doc, pos, reason) of docs."""
    m = validated(mapping)
    rows = records(docs, m["format"], m.get("records", "$"))
    bad = rows.where("record is null").select("doc", "pos", F.lit("unreadable_record").alias("reason"))
    rows = rows.where("record is not null").where(passes(F.col("record"), m.get("filters", [])))
    made, subject = [], None
    for i, f in enumerate(m["fields"]):
        found = values(F.col("record"), f["path"], f.get("transforms", []))
        target = f["target"]
        if target == "subject":
            subject, kind = F.transform(found, lambda x: READERS[f["kind"]](x)), f["kind"]
            stated = F.size(found)
        elif target != "ignore":
            made.append(F.transform(found, lambda x: _claim(x, i, f)))
    rows = rows.select("doc", "pos", subject.alias("subjects"), stated.alias("stated"), F.concat(F.array().cast(f"array<{CLAIM}>"), *made).alias("made"))
    reason = (
        F.when(F.col("stated") != 1, F.when(F.col("stated") == 0, "missing_subject").otherwise("several_subjects")).when(F.get("subjects", 0).isNull(), "unusable_subject")
        .when(F.exists("made", lambda x: x["value"].isNull() & (x["target"] == "disposition")), "unknown_disposition").when(F.exists("made", lambda x: x["value"].isNull()), "unusable_value")
    )
    rows = rows.withColumn("reason", reason)
    claims = rows.where("reason is null").select("doc", "pos", F.lit(kind).alias("subject_kind"), F.get("subjects", 0).alias("subject"), F.explode("made").alias("c"))
    claims = claims.select("doc", "pos", "subject_kind", "subject", F.col("c.target").alias("assertion"), "c.name", "c.kind", "c.value")
    return Mapped(claims, bad.unionByName(rows.where("reason is not null").select("doc", "pos", "reason")))


def _claim(x: Column, place: int, field: dict) -> Column:
    target, none = field["target"], F.lit(None).cast("string")
    name, kind, value = F.lit(field.get("name")).cast("string"), none, x
    if target == "observable":
        kind, value = F.lit(field["kind"]), READERS[field["kind"]](x)
    elif target == "infer":
        found = canon.infer(x)
        kind, value = found["kind"], found["value"]
    elif target == "disposition":
        word = F.lower(F.trim(x))
        value = F.when(word.isin(*TRUTHY), "malicious").when(word.isin(*FALSY), "benign")
    return F.struct(F.lit(place), F.lit(target), name, kind, value).cast(CLAIM)


def json_lines(docs: DataFrame) -> Mapped:
    """JSON arrays or lines without a mapping: each text field whose kind can be inferred is a claim; a line that
    cannot be read, or holds no object, is rejected and the others go on."""
    rows = docs.where("trim(text) <> ''")
    array = F.trim("text").startswith("[")
    whole = records(rows.where(array), "json", "$[*]")
    read = whole.unionByName(records(rows.where(~array), "jsonl"))
    fields = read.select("doc", "pos", F.try_variant_get("record", "$", "map<string,variant>").alias("fields"))
    bad = fields.where("fields is null").select("doc", "pos", F.lit("not_an_object").alias("reason"))
    each = fields.select("doc", "pos", F.explode("fields").alias("name", "v")).where(F.schema_of_variant("v") == "STRING")
    each = each.select("doc", "pos", "name", F.try_variant_get("v", "$", "string").alias("raw")).select("*", canon.infer(F.col("raw")).alias("found"))
    claims = each.where("found.outcome = 'confident'").select("doc", "pos", F.concat(F.lit("json."), "name").alias("name"), "found.kind", "found.value", "raw")
    return Mapped(claims, bad.unionByName(each.where("found.outcome = 'ambiguous'").select("doc", "pos", F.lit("ambiguous_inference").alias("reason"))))
