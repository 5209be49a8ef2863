"""Ingest runs, snapshots, checkpoints and decisions."""

import json

import pytest

from signalcontext.operators import store as st
from signalcontext.operators.snapshot import Conflict, Snapshots
from signalcontext.plans import ingest

BUNDLE = {"type": "bundle", "objects": [{"type": "tool", "id": "t", "name": "T"}, {"type": "identity", "id": "i", "name": "I"}, {"type": "relationship", "id": "r", "source_ref": "i", "target_ref": "t", "relationship_type": "uses"}, {"type": "note"}]}
DOCS = [("a", json.dumps(BUNDLE), None, "a.json"), ("b", "ip,domain\n192.0.2.1,a.example\n", "text/csv", "b.csv"), ("c", '{"h": "b.example"}\n{', None, "c.jsonl"), ("d", "nothing at all", None, None)]
SCHEMA = "doc string, text string, media string, name string"


def test_detection(spark):
    got = {r.doc: (r.parser, r.refused) for r in ingest.detect(spark.createDataFrame(DOCS, SCHEMA)).collect()}
    assert got == {"a": ("stix", None), "b": ("delimited", None), "c": ("json_lines", None), "d": (None, "unknown_format")}


def test_run_and_replay(spark, tmp_path):
    docs, store = spark.createDataFrame(DOCS, SCHEMA), Snapshots(spark, str(tmp_path / "s"))
    with pytest.raises(ingest.IngestRefused):
        ingest.ingest(docs, store, "2024-01-01", strict=True)
    assert store.graph_version == 0 and store.table("claims") is None
    first = ingest.ingest(docs, store, "2024-01-01")
    assert first.reasons == {"unsupported_object_type": 1, "not_an_object": 1, "unknown_format": 1} and first.total == first.accepted + 3
    assert {k: v["inserted"] for k, v in first.outcomes.items()} == {"entities": 2, "claims": 3, "relationships": 1, "sightings": 0} and store.graph_version == 6
    again = ingest.ingest(docs, Snapshots(spark, str(tmp_path / "s")), "2024-01-02")
    assert {k: v["unchanged"] for k, v in again.outcomes.items()} == {"entities": 2, "claims": 3, "relationships": 1, "sightings": 0}
    later = Snapshots(spark, str(tmp_path / "s"))
    assert later.graph_version == 6 and {(r.occurrences, r.first_seen_at, r.last_seen_at) for r in later.table("quarantine").collect()} == {(2, "2024-01-01", "2024-01-02")}
    one = later.table("entities").where("name = 'T'").first()
    assert later.get("entities", "id", one.id)["kind"] == "tool" and later.get("entities", "id", "none") is None


def test_snapshots(spark, tmp_path):
    a = Snapshots(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string, n int")
    assert a.upsert({"t": rows((1, "a", 0), (2, "b", 0), (1, "z", 1))}, order="n")["t"] == {"inserted": 2, "updated": 0, "unchanged": 0}
    b = Snapshots(spark, str(tmp_path))
    assert b.upsert({"t": rows((2, "c", 0), (3, "d", 0), (1, "z", 0))}, order="n")["t"] == {"inserted": 1, "updated": 1, "unchanged": 1}
    assert (a.graph_version, b.graph_version) == (2, 4) and sorted(map(tuple, b.table("t").collect())) == [(1, "z"), (2, "c"), (3, "d")] and a.table("t").count() == 2
    with pytest.raises(Conflict):
        a.upsert({"t": rows((9, "x", 0))}, order="n")
    frame = spark.createDataFrame([("k", "d", "active")], "key string, digest string, status string")
    for name, at in (("x", "2024-01-01"), ("y", "2024-01-02"), ("x", "2024-01-03")):
        b.put_checkpoint(name, frame, "s", at)
    assert [r.name for r in b.checkpoints().collect()] == ["x", "y"] and b.checkpoint("x")[1].count() == 1 and b.checkpoint("none") is None
    assert b.drop_checkpoint("x") and not b.drop_checkpoint("x") and b.graph_version == 4
    ids = {b.record_decision("merge", "accepted", "e1", "me", "p1", "2024-01-01") for _ in range(2)}
    b.record_decision("merge", "refused", "e2", "me", "p1", "2024-01-02")
    assert len(ids) == 1 and [r.subject for r in b.decisions().collect()] == ["e1", "e2"]
    assert sorted(map(tuple, st.decision_counts(b.decisions()).collect())) == [("merge", "accepted", 1), ("merge", "refused", 1)]
    with pytest.raises(ValueError):
        b.record_decision("merge", "accepted", "e1", "", "p1", "2024-01-01")


RULE = "title: R\nid: r1\nlogsource:\n  product: windows\ntags: [attack.t1059]\ndetection:\n  s:\n    src_ip: 192.0.2.9\n    Image: x\n  condition: s\n"


def test_rules_and_one_commit(spark, tmp_path):
    docs = spark.createDataFrame([*DOCS, ("e", RULE + "---\ntitle: x\n", None, "r.yml")], SCHEMA)
    assert {r.doc: r.parser for r in ingest.detect(docs).collect()}["e"] == "sigma"
    store = Snapshots(spark, str(tmp_path / "s"))
    report = ingest.ingest(docs, store, "2024-01-01")
    assert store.number == 1 and report.reasons["missing_detection"] == 1 and store.table("quarantine").count() == 4
    assert {r.name for r in store.table("entities").where("kind in ('detection_rule', 'attack_technique')").collect()} == {"R", "T1059"}
    assert {r["name"] for r in store.table("claims").where("doc = 'e'").collect()} == {"sigma.id", "sigma.logsource.product", "sigma.tag", "sigma.detection", "sigma.detection.unread"}
    assert store.table("relationships").where("doc = 'e'").count() == 2
    ingest.ingest(docs, store, "2024-01-02")
    assert store.number == 2 and {r.occurrences for r in store.table("quarantine").collect()} == {2} and store.graph_version == sum(sum(v.values()) for v in report.outcomes.values())


def test_last_record_of_an_id_stays(spark, tmp_path):
    """Two documents, and two objects of one, say different things of one entity: the last document and place hold."""
    one = lambda *x: json.dumps({"type": "bundle", "objects": [{"type": "tool", "id": f"t{i}", "name": "T", "description": d} for i, d in enumerate(x)]})
    docs = [("b", one("b0", "b1"), None, "b.json"), ("a", one("a0", "z1"), None, "a.json")]
    for k in range(2):
        store = Snapshots(spark, str(tmp_path / str(k)))
        ingest.ingest(spark.createDataFrame(docs[:: 1 - 2 * k], SCHEMA).repartition(3), store, "2024-01-01")
        assert [r.description for r in store.table("entities").collect()] == ["b1"]


def test_dangling_edge_writes_nothing(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, str(tmp_path / "s"))
    parse = ingest.sigma.parse

    def lost(files):
        got = parse(files)
        got.entities = got.entities.where("kind <> 'attack_technique'")
        return got

    monkeypatch.setattr(ingest.sigma, "parse", lost)
    with pytest.raises(ingest.DanglingEdge):
        ingest.ingest(spark.createDataFrame([("e", RULE, None, "r.yml")], SCHEMA), store, "2024-01-01")
    assert store.number == 0 and store.table("entities") is None


def test_small_writes_touch_one_bucket(spark, tmp_path):
    """A record's write makes one file and its lookup reads one bucket; the rest of the table may as well not be there."""
    from pyspark.sql import functions as F

    s = Snapshots(spark, str(tmp_path), changes=4)
    s.upsert({"t": spark.range(2000).select("id", F.lit("a").alias("v"))})
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    assert s.upsert({"t": rows((7, "b"))})["t"] == {"inserted": 0, "updated": 1, "unchanged": 0}
    base, change = (p["path"] for p in s.state["tables"]["t"]["parts"])
    files = lambda path: sorted((tmp_path / path).glob("*/*.parquet"))
    assert len(files(base)) >= 16 and len(files(change)) == 1
    own = files(change)[0].parent.name
    for d in (tmp_path / base).glob("_bucket=*"):
        if d.name != own:
            d.rename(tmp_path / f"away-{d.name}")
    late = Snapshots(spark, str(tmp_path), changes=4)
    assert late.get("t", "id", 7) == {"id": 7, "v": "b"} and late.upsert({"t": rows((7, "b"))})["t"]["unchanged"] == 1
    for d in tmp_path.glob("away-*"):
        d.rename(tmp_path / base / d.name.removeprefix("away-"))
    assert late.number == 2 and late.table("t").count() == 2000


def test_changes_deletions_compaction_and_cleaning(spark, tmp_path):
    """Many small writes against a plain dict; changes are put together, the base takes them in, old files go."""
    rows = lambda x: spark.createDataFrame(sorted(x.items()), "id long, v string")
    s, plain = Snapshots(spark, str(tmp_path), buckets=4, changes=3), {i: "a" for i in range(100)}
    s.upsert({"t": rows(plain)})
    for k in range(5):
        write = {k: f"w{k}", 100 + k: "new", 50: f"x{k}"}
        assert s.upsert({"t": rows(write)})["t"] == {"inserted": 1, "updated": 2, "unchanged": 0}
        plain |= write
        assert len(s.state["tables"]["t"]["parts"]) <= 5
    assert s.delete("t", spark.createDataFrame([(50,), (3,), (999,)], "id long")) == 2 and s.delete("t", spark.createDataFrame([(50,)], "id long")) == 0
    del plain[50], plain[3]
    assert dict(map(tuple, s.table("t").collect())) == plain and s.get("t", "id", 50) is None
    assert s.upsert({"t": rows({50: "back"})})["t"]["inserted"] == 1
    plain[50] = "back"
    stale, version = Snapshots(spark, str(tmp_path)), s.graph_version
    s.compact("t")
    s.upsert({"t": rows({1: "last"})})
    plain[1] = "last"
    assert s.clean(keep=1) > 0 and s.clean(keep=1) == 0 and s.graph_version == version + 1
    assert dict(map(tuple, Snapshots(spark, str(tmp_path)).table("t").collect())) == plain
    assert len(list((tmp_path / "t").iterdir())) == len(s.state["tables"]["t"]["parts"]) == 2
    s.upsert({"u": rows({})})
    assert s.table("u").count() == 0 and s.upsert({"u": rows({1: "a"})})["u"]["inserted"] == 1 and s.table("u").count() == 1
    with pytest.raises(Conflict):
        stale.upsert({"v": rows({1: "a"})})


def test_null_keys_and_parts_of_a_key(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "doc string, pos long, v string")
    keys = {"t": ["doc", "pos"]}
    s.upsert({"t": rows((None, 1, "a"), ("d", None, "b"), ("d", 1, "c"))}, keys=keys)
    assert s.upsert({"t": rows((None, 1, "z"), ("d", None, "b"), ("e", 1, "c"))})["t"] == {"inserted": 1, "updated": 1, "unchanged": 1}
    assert sorted(map(str, map(tuple, s.table("t").collect()))) == ["('d', 1, 'c')", "('d', None, 'b')", "('e', 1, 'c')", "(None, 1, 'z')"]


def test_a_store_sends_rows_once(spark, tmp_path):
    """A first write keeps the last of each key, deals them by bucket and stores no hash; a deletion stores keys alone."""
    s = Snapshots(spark, str(tmp_path), buckets=2)
    rows = spark.createDataFrame([(i % 50, i // 50, f"v{i % 7}") for i in range(200)] + [(0, 3, "w"), (None, 0, "n")], "id long, at long, v string")
    assert s.upsert({"t": rows}, order="at")["t"] == {"inserted": 51, "updated": 0, "unchanged": 0}
    assert s.upsert({"t": rows}, order="at")["t"] == {"inserted": 0, "updated": 0, "unchanged": 51}
    assert s.delete("t", rows.where("id < 10").select("id")) == 10
    base, gone = (spark.read.parquet(f"{tmp_path}/{p['path']}") for p in s.state["tables"]["t"]["parts"])
    assert "_doc" not in base.columns and gone.where("v is not null").isEmpty()
    s.compact("t")
    assert {r.id: r.v for r in s.table("t").collect()} == {None: "n"} | {i: f"v{(150 + i) % 7}" for i in range(10, 50)}
    assert s.upsert({"t": rows.where("id = 3")}, order="at")["t"]["inserted"] == 1
