"""The reader of rules' YAML and the frames made of rules."""

import pytest

from signalcontext.sources import leaves, sigma

RULE = """
# by hand
title: "Odd \\"name\\" \\u00e9"
id: 3d1f
status: deprecated
date: 2024/01/02
description: |
    First line: with a colon
    # no comment

    last
author: Some One   # who
tags:
  - attack.t1059.001
  - attack.execution
  - 'plain''s'
  - 7
logsource: 
    product: windows
    category: dns_query
detection:
  selection:
    DestinationIp: 192.0.2.1
    dst_ip: ['198.51.100.7', "192.0.2.1", 7]
    QueryName:
    - Evil.Example
    - not a host
    QueryName|contains: evil
    Image: C:\\x.exe
    sha1: []
  other:
    - url: http://a.example/x
      Hash:
        deep: 1
    - keyword
  filter:
    c-ip: 203.0.113.9
  keywords:
    - a
    - b
  condition: selection and not filter
level: high
"""


def frame(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc string, text string")


def test_rule(spark):
    got = sigma.parse(frame(spark, RULE))
    assert got.rejects.count() == 0
    entities = {(r.kind, r.name): r for r in got.entities.collect()}
    rule = entities["detection_rule", 'Odd "name" é']
    assert rule.status == "deprecated" and rule.description == "First line: with a colon\n# no comment\n\nlast\n"
    assert set(entities) == {("detection_rule", 'Odd "name" é'), ("attack_technique", "T1059.001")}
    on_rule = sorted((r.name, r.value) for r in got.claims.collect() if r.subject == rule.id)
    assert on_rule == [
        ("sigma.author", "Some One"), ("sigma.date", "2024/01/02"),
        ("sigma.detection.unread", "Hash (not a string), Image, QueryName (not canonical), QueryName|contains (modifier), dst_ip (not a string)"),
        ("sigma.id", "3d1f"), ("sigma.level", "high"), ("sigma.logsource.category", "dns_query"), ("sigma.logsource.product", "windows"), ("sigma.status", "deprecated"),
        ("sigma.tag", "attack.execution"), ("sigma.tag", "attack.t1059.001"), ("sigma.tag", "plain's"),
    ]
    seen = sorted(r.value for r in got.claims.collect() if r.name == "sigma.detection")
    assert seen == ["192.0.2.1", "198.51.100.7", "203.0.113.9", "evil.example", "http://a.example/x"]  # the negated filter too
    assert {(r.kind, r.source_ref) for r in got.relationships.collect()} == {("indicates", rule.id)} and got.relationships.count() == 6


def test_documents_are_rejected_alone(spark):
    good = "title: a\ndetection:\n  s:\n    src_ip: 192.0.2.5\n"
    bad = ["title: [a\ndetection: 1", "- a\n- b", "id: x\ndetection:\n  a: 1", "title: t\nid: y", "title: ' '\ndetection: x", "title: t\ndetection:\n  a: 1\ntags: [" + ", ".join(f"a{i}" for i in range(65)) + "]", "a: &x 1", "title: a\ntitle: b", "a:\n\tb: 1", "just text", "# nothing"]
    file = "---\n" + "\n--- # next\n".join([good, *bad, good.replace("title: a", "title: b")]) + "\n---\n  \n"
    got = sigma.parse(frame(spark, file, None, "", " \n---\n", good + "\n---\n" * 3 + "----\n", "\n---\n".join(["x: 1"] * 257)))
    reasons = sorted((r.doc, r.part, r.reason) for r in got.rejects.collect())
    want = ["invalid_yaml", "not_a_rule", "missing_title", "missing_detection", "unusable_title", "tags_exceeded", "invalid_yaml", "invalid_yaml", "invalid_yaml", "not_a_rule", "not_a_rule"]
    assert reasons == sorted([("d0", i + 1, r) for i, r in enumerate(want)] + [(f"d{i}", 0, "empty_document") for i in (1, 2, 3)] + [("d4", 1, "not_a_rule"), ("d5", 0, "documents_exceeded")])
    assert sorted((r.doc, r.name) for r in got.entities.collect()) == [("d0", "a"), ("d0", "b"), ("d4", "a")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a: 1\nb: '1'\nc: true\nd: ~\ne:\nf: 1.5e3\ng: 0x1F\nh: 1.2.3\n", [(".a", "other"), (".b", "string"), (".c", "other"), (".d", "other"), (".e", "other"), (".f", "other"), (".g", "other"), (".h", "string")]),
        ("a:\n- b: x\n  c: y\n-\n  - z\n", [(".a[0].b", "string"), (".a[0].c", "string"), (".a[1][0]", "string")]),
        ("a: b c\n  d # x\nx: >-\n  one\n  two\n\n  three\n", [(".a", "string"), (".x", "string")]),
        ('"k: 1": v\nhttp://x: y\na b : c\n', [(".k: 1", "string"), (".http://x", "string"), (".a b", "string")]),
        ("[]", [("", "empty")]), ("", []),
    ],
)
def test_leaves(text, want):
    assert [("".join(p), k) for p, _, k in leaves.yaml_leaves(text)] == want


def test_values():
    assert [v for _, v, _ in leaves.yaml_leaves("a: b c\n  d # x\nx: >-\n  one\n  two\n\n  three\ny: a#b\nz: \"a # b\" # c")] == ["b c d", "one two\nthree", "a#b", "a # b"]


@pytest.mark.parametrize("text", ["a: {b: 1}", "a: *x", "a: !t x", "a: 'x", "a: [x", "a: [[x]]", "a: b: c", "a: x\n  b: 1", "- a\nb: 1", "a: \"\\q\"", "a: 1\n b: 2", "a:\n" + "\n".join(" " * (i + 1) + "a:" for i in range(70)), "a: 'x' y", "a: 1\n...\nb: 2"])
def test_refused(text):
    with pytest.raises(leaves.Unreadable):
        leaves.yaml_leaves(text)


def test_long(spark):
    """A file at the field limit and far beyond: one pass, whatever it is filled with."""
    for filler in ("x" * 300_000, " " * 300_000 + "x", "\n" * 100_000 + "  x", "a-b " * 60_000, "x:" * 100_000):
        text = f"title: t\ndescription: >\n  {filler}\ndetection:\n  s:\n    src_ip: 192.0.2.5\n"
        assert len(leaves.yaml_leaves(text)) == 3
        assert sigma.parse(frame(spark, text)).claims.count() == 1


def test_rules_are_read_where_they_lie(spark):
    """What a rule says is columns of its document: no frame sorts or sends leaves, so no task holds those of others."""
    got = sigma.parse(frame(spark, *[RULE] * 3))
    assert got.claims.groupBy("doc").count().select("count").distinct().count() == 1
    for df in (got.entities, got.claims, got.relationships, got.rejects):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "Aggregate" not in plan
