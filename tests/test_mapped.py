"""Mappings over JSON, JSON lines and CSV, and inference without one."""

import json

import pytest

from signalcontext.sources import mapped

MAPPING = {
    "format": "json", "records": "$.items[*]", "filters": [{"path": "$.state", "op": "not_equals", "value": "old"}, {"path": "$.host", "op": "present"}],
    "fields": [
        {"path": "$.host", "target": "subject", "kind": "domain_name", "transforms": [{"op": "undefang"}]}, {"path": "$.tags[*].name", "target": "attribute", "name": "tag", "transforms": [{"op": "uppercase"}]},
        {"path": "$.bad", "target": "disposition"}, {"path": "$.ips[*]", "target": "observable", "kind": "ip_address"}, {"path": "$.note", "target": "ignore"},
    ],
}


def claims(found):
    return sorted((r.doc, r.pos, r.subject, r.assertion, r.name or "", r.value) for r in found.claims.collect())


def rejects(found):
    return sorted((r.doc, r.pos, r.reason) for r in found.rejects.collect())


def test_json(spark):
    items = [
        {"host": "A[.]example", "tags": [{"name": "x"}, {"name": " "}, {"name": {"y": 1}}, {"name": 7}], "bad": True, "ips": ["192.0.2.1", "2001:DB8::1"]}, {"host": "b.example", "state": "old"}, {"host": ["a.example", "b.example"]}, {"other": 1},
        {"host": "no domain"}, {"host": "c.example", "bad": "perhaps"}, {"host": "d.example", "ips": ["nope"]}, {"host": "e.example", "bad": "Allow"},
    ]
    found = mapped.apply(spark.createDataFrame([("d", json.dumps({"items": items})), ("n", None), ("e", ""), ("x", "{")], "doc string, text string"), MAPPING)
    assert claims(found) == sorted([("d", 0, "a.example", "attribute", "tag", "X"), ("d", 0, "a.example", "attribute", "tag", "7"), ("d", 0, "a.example", "disposition", "", "malicious"), ("d", 0, "a.example", "observable", "", "192.0.2.1"), ("d", 0, "a.example", "observable", "", "2001:db8::1"), ("d", 7, "e.example", "disposition", "", "benign")])
    assert rejects(found) == [("d", 4, "unusable_subject"), ("d", 5, "unknown_disposition"), ("d", 6, "unusable_value"), ("x", 0, "unreadable_record")]


def test_csv_and_lines(spark):
    simple = {"fields": [{"path": "$.ip", "target": "subject", "kind": "ip_address"}, {"path": "$.why", "target": "attribute", "name": "why"}]}
    text = '\nip , why\n192.0.2.1,"a, ""b"""\n192.0.2.2\n\nx,y\n'
    found = mapped.apply(spark.createDataFrame([("c", text)], "doc string, text string"), {**simple, "format": "csv"})
    assert claims(found) == [("c", 2, "192.0.2.1", "attribute", "why", 'a, "b"')] and rejects(found) == [("c", 5, "unusable_subject")]
    found = mapped.apply(spark.createDataFrame([("l", '{"ip": "192.0.2.1", "why": 1}\n{\n{"ip": "192.0.2.2"}')], "doc string, text string"), {**simple, "format": "jsonl", "filters": [{"path": "$.ip", "op": "starts_with", "value": "192.0"}]})
    assert claims(found) == [("l", 0, "192.0.2.1", "attribute", "why", "1")] and rejects(found) == [("l", 1, "unreadable_record")]


def test_inference(spark):
    docs = [("a", '[{"h": "a.example", "n": 5}, 3]'), ("b", '{"x": "192.0.2.0/24"}\nbroken\n{"y": "free text"}')]
    found = mapped.json_lines(spark.createDataFrame(docs, "doc string, text string"))
    assert sorted((r.doc, r.name, r.kind, r.value) for r in found.claims.collect()) == [("a", "json.h", "domain_name", "a.example"), ("b", "json.x", "ip_range", "192.0.2.0/24")]
    assert rejects(found) == [("a", 1, "not_an_object"), ("b", 1, "not_an_object")]


@pytest.mark.parametrize("change", [{"format": "yaml"}, {"fields": []}, {"records": "$..a"}, {"filters": [{"path": "$.a", "op": "like"}]}, {"fields": MAPPING["fields"][1:]}, {"fields": MAPPING["fields"] + MAPPING["fields"][2:3]}, {"records": "$[*][*][*]"}, {"records": "$" + ".a" * 17}])
def test_refused(change):
    with pytest.raises(mapped.MappingError):
        mapped.validated({**MAPPING, **change})


def test_explained():
    assert mapped.explained(MAPPING)[:3] == ["each json record at $.items[*]", "only if $.state not equals old", "only if $.host present"]
