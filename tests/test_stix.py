"""STIX bundles, object by object."""

import json

import pytest
from pyspark.sql import functions as F

from signalcontext.sources import stix

MARK = {"type": "marking-definition", "id": "m--1", "definition": {"tlp": "amber"}}
CITE = {"type": "marking-definition", "id": "m--2", "definition": {"statement": "cite us"}}
TIMES = {"first_observed": "2024-01-01T00:00:00Z", "last_observed": "2024-01-02T00:00:00Z"}
BUNDLE = [
    MARK, CITE,
    {"type": "malware", "id": "malware--1", "name": "Frost", "aliases": ["F1"], "object_marking_refs": ["m--1", "m--2", "m--9"], "revoked": True},
    {"type": "attack-pattern", "id": "ap--1", "name": "Spear", "x_mitre_aliases": ["S"], "external_references": [{"source_name": "x", "external_id": "T1"}, {"source_name": "mitre-attack", "external_id": "t1566.001"}]},
    {"type": "identity", "id": "identity--1", "name": "Lab"}, {"type": "tool", "id": "tool--1"},
    {"type": "ipv4-addr", "id": "ipv4-addr--1", "value": "192.0.2.1"}, {"type": "ipv6-addr", "id": "i6", "value": "2001:DB8::0"}, {"type": "file", "id": "file--1", "name": "a.exe", "hashes": {"MD5": "A" * 32}},
    {"type": "domain-name", "id": "d", "value": "not a domain"},
    {"type": "indicator", "id": "indicator--1", "name": "two", "pattern": "[domain-name:value = 'A.example' OR file:hashes.'SHA-256' = '" + "b" * 64 + "' or domain-name:value='a.example']", "pattern_type": "stix", "indicator_types": ["malicious-activity", "odd"], "valid_from": "2024-01-01T00:00:00Z"},
    {"type": "indicator", "id": "indicator--2", "pattern": "[ipv4-addr:value = '192.0.2.1' AND url:value = 'x']"}, {"type": "indicator", "id": "indicator--3", "pattern": "[ipv4-addr:value = '192.0.2.1']", "pattern_type": "snort"},
    {"type": "indicator", "id": "indicator--4", "pattern": "[file:name = 'it\\'s']", "valid_from": "2024-01-02T00:00:00Z", "valid_until": "2024-01-01T00:00:00Z"}, {"type": "indicator", "id": "indicator--5"},
    {"type": "observed-data", "id": "od--1", **TIMES, "number_observed": 3, "created_by_ref": "identity--1", "objects": {"0": {"type": "url", "value": "http://Example.org"}, "1": {"type": "process"}}, "object_refs": ["ipv4-addr--1"]},
    {"type": "observed-data", "id": "od--2", **TIMES, "number_observed": 0}, {"type": "observed-data", "id": "od--3", **TIMES}, {"type": "observed-data", "id": "od--4"},
    {"type": "relationship", "id": "r--1", "relationship_type": "indicates", "source_ref": "indicator--1", "target_ref": "malware--1"}, {"type": "relationship", "id": "r--2", "relationship_type": "owns", "source_ref": "malware--1", "target_ref": "ap--1"},
    {"type": "relationship", "id": "r--3", "relationship_type": "uses", "source_ref": "malware--1", "target_ref": "nowhere"}, {"type": "note", "id": "note--1"}, {"type": "bundle", "id": "b"}, {"id": "typeless"},
]


@pytest.fixture(scope="module")
def parsed(spark):
    docs = [("a", json.dumps({"type": "bundle", "objects": BUNDLE})), ("b", json.dumps(BUNDLE[4])), ("c", None), ("d", "no json"), ("e", "[" * 70 + "]" * 70)]
    return stix.parse(spark.createDataFrame(docs, "doc string, text string"))


def test_entities(parsed):
    got = {(r.doc, r.name): r for r in parsed.entities.collect()}
    assert set(got) == {("a", "Frost"), ("a", "Spear"), ("a", "Lab"), ("b", "Lab")} and got["a", "Lab"].id == got["b", "Lab"].id
    frost = got["a", "Frost"]
    assert (frost.kind, frost.status, frost.aliases, [tuple(m) for m in frost.markings]) == ("malware_family", "revoked", ["F1"], [("attribution", "cite us"), ("tlp", "amber")])
    assert got["a", "Spear"].attack_id == "T1566.001" and got["a", "Spear"].aliases == ["S"]


def test_claims(parsed):
    got = sorted((r.observable, r.assertion, r.name or "", r.value) for r in parsed.claims.collect())
    two = [("attribute", "stix.indicator.alternatives", "2"), ("attribute", "stix.indicator.name", "two"), ("attribute", "stix.indicator_type", "malicious-activity"), ("attribute", "stix.indicator_type", "odd"), ("disposition", "", "malicious")]
    for x in ("a.example", "sha256:" + "b" * 64):
        assert [g[1:] for g in got if g[0] == x and g[2] != "stix.indicator.pattern"] == two
    assert [g for g in got if g[2].startswith("stix.") and "indicator" not in g[2]] == [("192.0.2.1", "attribute", "stix.ipv4-addr", "192.0.2.1"), ("192.0.2.1", "attribute", "stix.observed_data", "192.0.2.1"), ("2001:db8::", "attribute", "stix.ipv6-addr", "2001:db8::"), ("http://example.org/", "attribute", "stix.observed_data", "http://example.org/"), ("md5:" + "a" * 32, "attribute", "stix.file", "md5:" + "a" * 32)]


def test_sightings_and_edges(parsed):
    lab = next(r.id for r in parsed.entities.collect() if r.name == "Lab")
    got = parsed.sightings.collect()
    assert len(got) == 2 and {(r["count"], r.observer) for r in got} == {(3, lab)}
    edges = sorted((r.kind, r.note or "") for r in parsed.relationships.collect())
    assert edges == [("indicates", ""), ("indicates", ""), ("related_to", "owns")]


def test_rejects(parsed):
    got = sorted((r.doc, r.id or "", r.reason) for r in parsed.rejects.collect())
    assert got == sorted([
        ("a", "tool--1", "missing_name"), ("a", "d", "uncanonicalisable_observable"), ("a", "indicator--2", "unrepresentable_pattern"), ("a", "indicator--3", "unsupported_pattern_type"), ("a", "indicator--4", "impossible_validity_window"),
        ("a", "indicator--5", "missing_pattern"), ("a", "od--2", "unusable_number_observed"), ("a", "od--3", "no_mappable_observable"), ("a", "od--4", "missing_first_observed"), ("a", "r--3", "unresolved_target_ref"),
        ("a", "note--1", "unsupported_object_type"), ("a", "b", "nested_bundle"), ("a", "typeless", "missing_type"), ("c", "", "empty_document"), ("d", "", "missing_type"), ("e", "", "nested_too_deeply"),
    ])


def test_fan_out(spark):
    many = [{"type": "identity", "id": f"i{k}", "name": f"n{k}"} for k in range(1030)] + [{"type": "relationship", "id": f"r{k}", "source_ref": "i0", "target_ref": f"i{k}"} for k in range(1, 1030)]
    got = stix.parse(spark.createDataFrame([("a", json.dumps({"type": "bundle", "objects": many}))], "doc string, text string"))
    assert got.relationships.count() == 1024 and {(r.id, r.reason) for r in got.rejects.collect()} == {(f"r{k}", "fan_out_exceeded") for k in range(1025, 1030)}


def test_patterns(spark):
    cases = [("[url:value = 'http://a.example/x']", [("url", "http://a.example/x")]), ("[a:b = 'c']", None), ("[ipv4-addr:value != '192.0.2.1']", None), ("[ipv4-addr:value = '192.0.2.1'] AND [url:value = 'x']", None), ("[]", None), ("[file:name = 'it\\'s']", [("file_name", "it's")]), ("[ipv4-addr:value LIKE '1']", None)]
    got = spark.createDataFrame(cases, "p string, w array<struct<a:string,b:string>>").select("p", stix.pattern_observables(F.col("p")).alias("g"), "w").collect()
    assert [(r.p, r.g and [tuple(x) for x in r.g]) for r in got] == cases
