"""Operations on identities, judged pairs and context packs on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from signalcontext.operators import pack as pk
from signalcontext.operators import resolution as rs
from signalcontext.operators import store as st

OPS = "seq long, kind string, left_id string, right_id string, withdraws boolean, actor string, policy_context string"


def _ops(spark, *rows):
    return spark.createDataFrame([(i, k, l, r, w, "ann", "case") for i, (k, l, r, w) in enumerate(rows)], OPS)


def _set(df):
    return {tuple(r) for r in df.collect()}


def test_replay(spark):
    s = rs.replay(_ops(spark, ("merge", "b", "a", False), ("pin", "c", None, False), ("merge", "c", "a", False), ("pin", "c", None, True), ("merge", "a", "c", False), ("split", "a", "b", False), ("reject", "y", "x", False), ("alias", "q", "p", False), ("odd", "a", "b", False), ("merge", "a", None, False)), stop=False)
    assert _set(s.merges) == {("c", "a")} and _set(s.rejections) == {("x", "y")} and _set(s.aliases) == {("p", "q")} and _set(s.pins) == set()
    assert _set(s.refused) == {(2, "pinned"), (8, "unknown_kind"), (9, "needs_pair")}
    stopped = rs.replay(_ops(spark, ("merge", "b", "a", False), ("pin", "c", None, False), ("merge", "c", "a", False), ("reject", "y", "x", False)))
    assert _set(stopped.merges) == {("b", "a")} and _set(stopped.rejections) == set() and _set(stopped.pins) == {("c",)}
    blank = spark.createDataFrame([(0, "pin", "a", None, None, " ", "case"), (1, "pin", "a", None, None, "ann", None), (2, None, "a", None, None, "ann", "case")], OPS)
    assert _set(rs.replay(blank).refused) == {(0, "no_actor"), (1, "no_policy_context"), (2, "unknown_kind")}
    assert _set(rs.replay(spark.createDataFrame([], OPS)).merges) == set()


def test_judge(spark):
    e = spark.createDataFrame([("a", "k", "NORTH WIND"), ("b", "k", "north-wind"), ("c", "k", "wind gust"), ("d", "j", "north wind"), ("e", "k", None), ("f", "k", "NORTH WIND")], "id string, kind string, name string")
    ext = spark.createDataFrame([("a", "n", "1"), ("d", "n", "1"), ("e", "n", None)], "id string, namespace string, value string")
    s = rs.replay(_ops(spark, ("reject", "b", "a", False), ("pin", "c", None, False), ("alias", "e", "f", False)))
    pairs = spark.createDataFrame([("b", "a"), ("a", "c"), ("c", "f"), ("a", "d"), ("a", "f"), ("b", "f"), ("b", "d"), ("e", "f"), ("a", "a"), ("a", "gone")], "left_id string, right_id string")
    got = {(r.left_id, r.right_id): (r.score, r.outcome) for r in rs.judge(pairs, rs.resolve_classes(e, ext), s).collect()}
    assert got == {("a", "b"): (0, "rejected"), ("a", "c"): (25, "pinned"), ("c", "f"): (25, "pinned"), ("a", "d"): (95, "merged"), ("a", "f"): (60, "candidate"), ("b", "f"): (60, "candidate"), ("b", "d"): (0, "distinct"), ("e", "f"): (90, "merged"), ("a", "a"): (100, "merged"), ("a", "gone"): (0, "distinct")}
    # Without operations and without entities.
    assert [tuple(r) for r in rs.judge(pairs.limit(0), rs.resolve_classes(e.limit(0))).collect()] == []


def _pack(spark, detail="L2", value="malicious", red=False, who=st.Identity("amber", "red")):
    marks = st.markings(F.lit("red" if red else "green"))
    subjects = spark.createDataFrame([("x",), ("empty",), ("x",)], "subject string")
    claims = spark.createDataFrame([(1, "x", "disposition", value, "active", ["s2", "s1"]), (2, "x", "attribute", "*b*", "revoked", []), (3, "x", "disposition", "benign", "active", ["s1"])], "id long, subject string, assertion string, value string, status string, sources array<string>").withColumn("markings", marks)
    edges = spark.createDataFrame([("e1", "x", "uses", "y")], "id string, subject string, kind string, other string").withColumn("markings", st.markings())
    return pk.packs(subjects, claims, edges, spark.createDataFrame([("x",)], "subject string"), who, detail, objects=3)


def test_packs(spark):
    got = {r.subject: r for r in _pack(spark).collect()}
    x, empty = got["x"], got["empty"]
    assert len(got) == 2 and x.disposition == "malicious" and x.evidence == ["s1", "s2"] and x.handles == ["1", "2", "3"] and x.gaps == [] and x.exclusions == ["claims:budget_exhausted"] and x.finding == "assessed as malicious."
    assert empty.disposition == "unknown" and empty.gaps == ["store", "sightings"] and empty.claims == [] and empty.finding is None
    assert [r.why for r in _pack(spark).select(pk.problems(_pack(spark)).alias("why")).collect()] == [[], []]
    # A summary without graph keeps its handles; a withheld claim tells nothing but that it is withheld.
    l0 = _pack(spark, "L0").where("subject = 'x'").first()
    assert l0.claims == [] and l0.relationships == [] and l0.handles == ["1", "2", "3"] and "graph:below_detail_level" in l0.exclusions
    red = _pack(spark, red=True).where("subject = 'x'").first()
    assert red.restricted and red.claims == [] and red.evidence == [] and red.disposition == "unknown" and red.exclusions == ["claims:policy_restricted"] and red.gaps == ["policy"] and not red.exhausted
    assert _pack(spark, value="m" * 3000).where("subject = 'x'").first().problems == ["summary_carries_long_value"]
    assert _pack(spark, "L3", value="m" * 3000).where("subject = 'x'").first().problems == []
    with pytest.raises(ValueError):
        _pack(spark, "L4")


def test_pack_forms(spark):
    packs = _pack(spark)
    same, other = packs.where("subject = 'x'").first().fingerprint, _pack(spark, value="benign").where("subject = 'x'").first().fingerprint
    assert same == _pack(spark).where("subject = 'x'").first().fingerprint != other
    told = json.loads(packs.where("subject = 'x'").select(pk.as_json(packs).alias("j")).first().j)
    assert told["fingerprint"] == same and [c["id"] for c in told["claims"]] == ["1", "2", "3"]
    lines = [json.loads(r.line)["record"] for r in pk.as_json_lines(packs).where("subject = 'x'").orderBy("place").collect()]
    assert lines == ["pack", "claim", "claim", "claim", "relationship"]
    page = packs.where("subject = 'x'").select(pk.as_markdown(packs).alias("m")).first().m
    assert page.startswith("# x\n\nDisposition: malicious\n\n## Claims\n\n") and "\\*b\\*" in page and "*b* " not in page
    # Green packs may be read, but not passed on by one who may only read.
    ok, held = pk.clear(packs, st.Identity("green"), interchange=True)
    assert ok.count() == 0 and {r.denials[0] for r in held.collect()} == {"missing_capability"}
    assert pk.clear(packs, st.Identity("clear"), interchange=False)[0].select("subject").collect()[0].subject == "empty"


def test_release_and_labels(spark):
    blobs = spark.createDataFrame([("a", "hold"), ("b", "standard"), ("c", None)], "content_hash string, retention string")
    stays, audit = st.release(blobs, spark.createDataFrame([("a", "r"), ("b", "r"), ("z", "r")], "content_hash string, reason string"))
    assert {r.content_hash for r in stays.collect()} == {"a", "c"}
    assert {(r.content_hash, r.outcome) for r in audit.collect()} == {("a", "refused"), ("b", "released"), ("z", "absent")}
    seen = spark.createDataFrame([("l", "v1", 1), ("l", "v2", 2), ("l", "v3", 3), ("l", "v1", 9)], "label string, value string, at long")
    assert _set(st.bounded_labels(seen, 2)) == {("l", "v1", 2), ("l", "v2", 1)}


def test_bundle(spark):
    packs = _pack(spark).where("subject = 'x'")
    text = lambda kind, value: json.loads(packs.select(pk.as_stix(packs, F.lit(kind), F.lit(value), F.lit("2024-01-01T00:00:00Z")).alias("j")).first().j)
    b = text("domain_name", "a'b.example")
    assert [o["type"] for o in b["objects"]] == ["domain-name", "indicator", "relationship", "note"] and b["objects"][0]["value"] == "a'b.example"
    assert b["objects"][1]["pattern"] == "[domain-name:value = 'a\\'b.example']" and b["objects"][1]["indicator_types"] == ["malicious-activity"]
    assert b["objects"][2]["target_ref"] == b["objects"][0]["id"] == b["objects"][3]["object_refs"][0] and b["objects"][2]["source_ref"] == b["objects"][1]["id"]
    assert b == text("domain_name", "a'b.example") and "Claim: attribute = *b* (revoked)" in b["objects"][3]["content"]
    other = text("mutex_name", "m")
    assert other["objects"][0]["type"] == "indicator" and other["objects"][0]["pattern"] == "[x-unmapped:mutex_name = 'm']"
    assert text("file_name", "f")["objects"][0]["name"] == "f"
