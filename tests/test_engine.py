"""The engine's queries against their SQL on the smallest tables, and units of the language and the canonical forms."""

import os

import pytest
from pyspark.sql import functions as F

from signalcontext import query as q
from signalcontext.functions import canon, ids
from signalcontext.operators import graph as g
from signalcontext.operators.store import dangling as g_dangling
from signalcontext.plans import queries as plans
from signalcontext.shared import written

plans.queries()

DIR = "/root/testdata/sf0.001"


def _rows(columns, rows):
    def text(v):
        return None if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(str(text(r[c])) for c in sorted(columns)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DIR)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, [r.asDict() for r in got.collect()]) == _rows(want.columns, [dict(zip(want.columns, r)) for r in want.fetchall()])


def test_language():
    assert q.values("kind = a and (status = active and kind = b)") == {"kind": {"a", "b"}, "status": {"active"}}
    for bad in ("kind != a", "kind = a or kind = b", "kind = a ;", "name = a", "kind =", "(kind = a", "kind = a b"):
        with pytest.raises(q.QueryError):
            q.values(bad)


def test_canonical(spark):
    cases = [
        (canon.ipv4, " 192.0.2.1 ", "192.0.2.1"), (canon.ipv4, "192.0.2.256", None), (canon.ip_range, "192.0.2.77/24", "192.0.2.0/24"), (canon.ip_range, "x/24", None),
        (canon.domain, "WWW.Example.ORG.", "www.example.org"), (canon.domain, "example", None), (canon.email, "Ab@EXAMPLE.org", "Ab@example.org"),
        (canon.file_hash, "MD5:" + "A" * 32, "md5:" + "a" * 32), (canon.file_hash, "a" * 33, None), (canon.cwe, "cwe-0079", "CWE-79"), (canon.attack_id, "t1059.001", "T1059.001"),
        (canon.url, "HTTP://Example.org:80", "http://example.org/"), (canon.undefang, "hxxps://example[.]org", "https://example.org"),
    ]
    for f, raw, want in cases:
        assert spark.range(1).select(f(F.lit(raw)).alias("v")).first().v == want, (f.__name__, raw)


def test_uuid(spark):
    import uuid

    got = spark.range(1).select(ids.named_uuid("entity", F.lit("tool"), F.lit("é")).alias("v")).first().v
    assert got == "entity:" + str(uuid.uuid5(uuid.uuid5(ids.ROOT, "entity"), "4:tool2:é"))


def test_traverse(spark):
    edges = spark.createDataFrame([("e1", "k", "a", "b"), ("e2", "k", "b", "c"), ("e3", "k", "c", "a"), ("e4", "k", "c", "d")], "id string, kind string, source_ref string, target_ref string")
    found = g.traverse(edges, "a", depth=1)
    assert {r.node for r in found.nodes.collect()} == {"a", "b", "c"} and found.truncated == ["depth"]
    assert g.traverse(edges, "a", nodes=2).truncated == ["nodes"]
    assert g.traverse(edges, "c", fan_out=1, depth=3).truncated == ["fan_out"]


def walked(rows, start, depth, nodes, edges, fan_out, refused):
    """The bounded search, one row after the other."""
    visited, taken, flags, front = {start: 0}, {}, set(), [start]
    for level in range(1, depth + 1):
        nxt, cut = [], False
        hop = []
        for node in sorted(front):
            mine = sorted((i, y if x == node else x) for i, _, x, y in rows if node in (x, y))
            hop += [(node, i, o, k) for k, (i, o) in enumerate(mine, 1)][: fan_out + 1]
        for node, i, other, k in hop:
            if k > fan_out:
                flags.add("fan_out")
            elif i not in refused:
                if i not in taken and len(taken) >= edges or other not in visited and len(visited) >= nodes:
                    flags.add("edges" if i not in taken and len(taken) >= edges else "nodes")
                    cut = True
                    break
                taken.setdefault(i, level)
                if other not in visited:
                    visited[other] = level
                    nxt.append(other)
        front = nxt
        if cut or not front:
            break
        if level == depth:
            flags.add("depth")
    return visited, taken, sorted(flags)


def test_traverse_against_a_walk(spark):
    import random

    r = random.Random(8)
    rows = [(f"e{i:03}", "k", f"n{min(r.randrange(40), r.randrange(40)):02}", f"n{r.randrange(40):02}") for i in range(140)]
    rows = [x for x in rows if x[2] != x[3]]
    refused = {x[0] for x in rows[::9]}
    edges = spark.createDataFrame(rows, "id string, kind string, source_ref string, target_ref string").repartition(7)
    for depth, nodes, most, fan_out in ((3, 500, 500, 50), (3, 12, 500, 50), (3, 500, 15, 50), (2, 500, 40, 3), (3, 18, 25, 4), (1, 1, 500, 2)):
        found = g.traverse(edges, "n00", depth, nodes, most, fan_out, ~F.col("id").isin(*refused))
        want = walked(rows, "n00", depth, nodes, most, fan_out, refused)
        assert ({x.node: x.depth for x in found.nodes.collect()}, {x.id: x.depth for x in found.edges.collect()}, found.truncated) == want


def test_resolve_whole_table(spark, tmp_path, monkeypatch):
    import random
    import re
    from collections import Counter

    monkeypatch.setattr(g, "BLOCK", 4)
    rng = random.Random(3)
    names = ["LARGE BRASS", "large-brass", "LARGEBRASS", "SMALL BRASS", "TIN", "tin", "A B", "", None, "SMALL STEEL"]
    rows = [(i, rng.randrange(1, 51), rng.choice(names)) for i in range(90)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    form = [(f"p:{i}", re.sub("[^a-z]+", "", t.lower()), {x for x in re.split("[^a-z]+", t.lower()) if len(x) >= 4}) for i, _, t in rows if t is not None]
    for l, n, x in form:
        for r, m, y in form:
            if l < r and (n == m or x & y):
                want[l, r] = (60 if n == m else 25, "candidate")
    # The pairs between the members of linked classes are all the pairs, each once.
    links = plans.QUERIES["resolve_outcomes"](spark, str(tmp_path)).collect()
    inside = {}
    for r in plans.QUERIES["resolve_members"](spark, str(tmp_path)).collect():
        inside.setdefault(r["class"], []).append(r.id)
    got = [(min(x, y), max(x, y), k.score, k.outcome) for k in links for x in inside[k.left_id] for y in inside[k.right_id] if k.left_id != k.right_id or x < y]
    assert Counter((l, r) for l, r, _, _ in got) == Counter(want.keys())
    assert {(l, r): (s, o) for l, r, s, o in got} == want and sum(k.pairs for k in links) == len(want)
    whole = g.resolve(spark.createDataFrame([(f"p:{i}", "tool", t) for i, _, t in rows], "id string, kind string, name string")).collect()
    assert {(r.left_id, r.right_id): (r.score, r.outcome) for r in whole} == want and len(whole) == len(want)
    # An id with two names: one row a pair, by its best signal; an external id decides.
    two = spark.createDataFrame([("a", "k", "NORTH WIND"), ("a", "k", "SOUTH"), ("b", "k", "south"), ("b", "k", "wind gust"), ("c", "j", "south"), ("a", "k", "SOUTH")], "id string, kind string, name string")
    assert [tuple(r) for r in g.resolve(two).collect()] == [("a", "b", 60, "candidate")]
    ext = spark.createDataFrame([("a", "n", "1"), ("b", "n", "1"), ("c", "n", "1")], "id string, namespace string, value string")
    assert sorted(tuple(r) for r in g.resolve(two, ext).collect()) == [("a", "b", 95, "merged"), ("a", "c", 95, "merged"), ("b", "c", 95, "merged")]


def test_strongest_disposition_of_all_documents(spark, tmp_path):
    labels = [(9, 1, 1), (1, 1, 0), (18, 0, 0), (2, 0, 0), (3, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(9, "a"), (1, "a"), (18, "b"), (2, "c"), (3, "c")], "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in plans.strongest_disposition(spark, str(tmp_path)).collect()) == [("a", "malicious"), ("b", "suspicious"), ("c", "suspicious")]


def test_budget_against_a_plain_fold(spark):
    """Required items, copies, items without a section or sizes, ties and packs that end at each limit."""
    import random

    from signalcontext.operators import graph as g

    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randrange(40), r.randrange(60), r.choice(["s", "t", "u", "v", None]), r.choice([None, 1, 5, 30]), r.choice([None, 1, 3, 20]), r.random() < 0.3, r.choice([None, False, False, False, True])) for _ in range(300)]
    rows += rows[:40]
    frame = spark.createDataFrame(rows, "pack string, place long, id long, section string, bytes long, tokens long, is_link boolean, required boolean").repartition(3)
    for limits in ((60, 10**6, 10**6, 10**6), (10**6, 90, 10**6, 10**6), (10**6, 10**6, 9, 4), (80, 200, 12, 5), (0, 0, 0, 0)):
        want = {}
        for pack in ("a", "b", None):
            own = sorted((0 if x[7] else 1, x[1], x[2], x[3] or "", x[4] or 0, x[5] or 0, x[6], bool(x[7])) for x in rows if x[0] == pack)
            sums, closed, kept, dropped, failed = [0, 0, 0, 0], set(), [], [], False
            for _, _, i, section, size, tokens, link, required in own:
                after = [sums[0] + tokens, sums[1] + size, sums[2] + (not link), sums[3] + link]
                over = any(x > y for x, y in zip(after, limits)) and (after[0] > limits[0] or after[1] > limits[1] or (after[3] > limits[3] if link else after[2] > limits[2]))
                if not over and (required or (section and section not in closed)):
                    sums = after
                    kept.append(i)
                else:
                    dropped.append(i)
                    closed |= {section} if over else set()
                    failed |= over and required
            want[pack] = (kept, dropped, sums[0], sums[1], failed)
        got = {x.pack: (x.kept, x.dropped, x.tokens, x.bytes, x.failed) for x in g.budget_fit(frame, "pack", *limits).collect()}
        assert got == want, limits


def test_budget_of_a_large_pack(spark):
    """A pack of two million items: the prefixes of its two sections are looked at, and every item has a verdict."""
    from pyspark.sql import functions as F

    from signalcontext.operators import graph as g

    i = F.col("id")
    rows = spark.range(2_000_000).select(F.lit("p").alias("pack"), i.alias("place"), i, (i % 2).cast("string").alias("section"), F.lit(3).alias("bytes"), F.lit(1).alias("tokens"), (i % 10 == 0).alias("is_link"), F.lit(False).alias("required"))
    got = g.budget_rows(rows, "pack", 10**6, 10**6, 50, 5).groupBy().agg(F.sum("kept"), F.sum("dropped"), F.max(F.when(F.col("kept") > 0, i))).first()
    assert tuple(got) == (50 + 5, 2_000_000 - 55, 59)


def test_edges_stand_once_however_far_a_search_goes(spark, monkeypatch):
    """A search writes each edge once, not from both of its ends, and none where the edges lie in files."""
    sizes = []

    def watched(df, name):
        out = written(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(g, "written", watched)
    edges = spark.createDataFrame([(f"e{i}", "k", f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)], "id string, kind string, source_ref string, target_ref string")
    assert {r.node: r.depth for r in g.reachable(edges, spark.createDataFrame([("n003",)], "node string"), 3).collect()} == {f"n{i:03d}": abs(i - 3) for i in range(7)}
    assert [n for name, n in sizes if name == "links"] == [40]
    sizes.clear()
    want = {(f"n{i:03d}", abs(i - 3)) for i in range(1, 6)}
    for stored, links in ((False, [40]), (True, [])):
        sizes.clear()
        assert {tuple(r) for r in g.traverse(edges, "n003", depth=2, stored=stored).nodes.collect()} == want
        assert [n for name, n in sizes if name == "links"] == links


def test_dangling_ends_are_not_sorted(spark):
    """A node of very many edges is met by hashing the entities, so no task orders its edges."""
    edges = spark.range(2000).selectExpr("concat('e', id) as id", "concat('c', id) as source_ref", "'hub' as target_ref")
    got = g_dangling(edges, spark.range(0, 2000, 2).selectExpr("concat('c', id) as id"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "ShuffledHashJoin" in plan
    assert sorted(tuple(r) for r in got.collect()) == sorted([(f"e{i}", f"c{i}") for i in range(1, 2000, 2)] + [(f"e{i}", "hub") for i in range(2000)])
