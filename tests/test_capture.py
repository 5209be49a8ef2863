"""Captures at a version, their refusals, and comparisons within limits against a plain walk over the keys."""

import random

import pytest

from signalcontext.operators import capture as cp
from signalcontext.operators import graph as g
from signalcontext.operators.snapshot import Snapshots

MARKS = "array<struct<kind:string,value:string>>"
ENTITY = f"id string, kind string, name string, status string, aliases array<string>, confidence int, markings {MARKS}, extra string"


def entity(i, name="N", status="active", aliases=None, confidence=None, tlp=None, extra=None):
    return (f"e{i}", "tool", name, status, aliases, confidence, None if tlp is None else [("tlp", tlp)], extra)


def stored(spark, path, rows, edges):
    s = Snapshots(spark, str(path))
    s.upsert({"entities": spark.createDataFrame(rows, ENTITY), "relationships": spark.createDataFrame(edges, "id string, kind string, source_ref string, target_ref string")})
    return s


def test_capture(spark, tmp_path, monkeypatch):
    edges = [("r1", "uses", "e1", "e2"), ("r2", "uses", "e2", "e3"), ("r3", "uses", "e1", "observable:domain_name:x"), ("r4", "uses", "e1", "e9"), ("r5", "uses", "e7", "e8")]
    s = stored(spark, tmp_path, [entity(1), entity(2, tlp="red"), entity(3), entity(7), entity(8)], edges)
    first = cp.capture(s, "e1", "2024-01-01", "amber")
    # e2 is above the ceiling, e9 has no record, e7 and e8 are out of reach.
    assert {r.key for r in first.records.collect()} == {"entity:e1", "entity:e3", "observable:domain_name:x", *(f"relationship:r{i}" for i in range(1, 5))}
    assert (first.withheld, first.version, first.truncated) == (1, 10, [])
    cp.save(s, "first", first)
    assert s.checkpoint("first")[0]["graph_version"] == 10 and s.checkpoint("first")[1].count() == 7
    # What is kept for itself does not move the graph; a record does.
    s.upsert({"entities": spark.createDataFrame([entity(3, status="revoked"), entity(1, extra="no facet"), entity(9)], ENTITY)})
    with pytest.raises(cp.Moved):
        cp.save(s, "late", first)
    second = cp.capture(s, "e1", "2024-01-02", "amber")
    told = cp.delta(first, second)
    assert {(r.key, r.category) for r in told.changes.collect()} == {("entity:e3", "revoked"), ("entity:e9", "added")} and (told.compared, told.unchanged, told.truncated) == (8, 6, [])
    assert cp.capture(s, "e1", "2024-01-02", "amber", edges=4, nodes=2).truncated == ["nodes"]
    with pytest.raises(g.PlanRefused):
        cp.delta(first, cp.capture(s, "e1", "2024-01-02", "red"))
    for ask in ({"start": "e0"}, {"start": "e1", "depth": 0}, {"start": "e2", "most_tlp": "green"}):
        with pytest.raises(g.PlanRefused):
            cp.capture(s, at="2024-01-02", **ask)
    # Another writer commits while the traversal runs.
    walk = cp.traverse

    def slow(*a):
        found = walk(*a)
        Snapshots(spark, str(tmp_path)).upsert({"entities": spark.createDataFrame([entity(4)], ENTITY)})
        return found

    monkeypatch.setattr(cp, "traverse", slow)
    with pytest.raises(cp.Moved) as e:
        cp.capture(s, "e1", "2024-01-03")
    assert (e.value.began, e.value.ended) == (13, 14)


def test_an_empty_store_is_refused(spark, tmp_path):
    with pytest.raises(g.PlanRefused):
        cp.capture(Snapshots(spark, str(tmp_path)), "e1", "2024-01-01")


def test_facets(spark):
    plain = entity(1, aliases=["b", "a"], confidence=41, tlp="green")
    rows = [plain, entity(1, aliases=["a", "b", "a", None], confidence=59, tlp="green", extra="x"), entity(1, aliases=["a"], confidence=41, tlp="green"), entity(1, aliases=["a", "b"], confidence=60, tlp="green"), entity(1, aliases=["a", "b"], confidence=41, tlp="red"), entity(1, name=None), entity(1, name="")]
    df = spark.createDataFrame(rows, ENTITY)
    got = [r.d for r in df.select(cp.material(df).alias("d")).collect()]
    # Order and repetition of aliases, the figure inside its band and columns that are no facets change nothing.
    assert got[0] == got[1] and len(set(got[1:5])) == 4 and None not in got


def walked(before, after, most_records, most_changes):
    changes, compared, unchanged, flags = [], 0, 0, []
    for key in sorted({*before, *after}):
        if compared >= most_records:
            flags = ["records"]
            break
        compared += 1
        kind = "added" if key not in before else "removed" if key not in after else "changed" if before[key] != after[key] else None
        if kind is None:
            unchanged += 1
        elif len(changes) >= most_changes:
            flags = ["changes"]
            break
        else:
            changes.append((key, kind))
    return changes, compared, unchanged, flags


@pytest.mark.parametrize(("most_records", "most_changes"), [(50_000, 10_000), (60, 10_000), (60, 5), (1, 1), (200, 40), (50, 26)])
def test_limits(spark, most_records, most_changes):
    r = random.Random(3)
    a, b = ({f"k{i:03}": r.choice("xy") for i in range(120) if r.random() < 0.7} for _ in range(2))
    made = [cp.Capture(spark.createDataFrame([(k, v, "active") for k, v in x.items()], "key string, digest string, status string"), "s", 1, "t") for x in (a, b)]
    got = cp.delta(*made, most_records=most_records, most_changes=most_changes)
    assert (sorted(map(tuple, got.changes.collect())), got.compared, got.unchanged, got.truncated) == walked(a, b, most_records, most_changes)


def test_limits_and_rules_that_are_refused(spark):
    none = spark.createDataFrame([], "key string, digest string, status string")
    a, b = cp.Capture(none, "s", 1, "t", ["depth"]), cp.Capture(none, "s", 1, "t", ["edges"], rules=2)
    with pytest.raises(g.PlanRefused):
        cp.delta(a, b)
    with pytest.raises(g.PlanRefused):
        cp.delta(a, a, most_changes=0)
    empty = cp.delta(a, cp.Capture(none, "s", 1, "t", ["edges"]))
    assert (empty.changes.count(), empty.compared, empty.inherited) == (0, 0, ["depth", "edges"])
