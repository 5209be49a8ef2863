"""Relations between classes of claims against all pairs, one by one."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from signalcontext.operators import evidence as ev

SCHEMA = "id long, subject string, slot string, status string, value string, publisher string, asserted_at long, stance string, extra string"


def relation(a, b, single):
    same = None if a["value"] is None or b["value"] is None else a["value"] == b["value"]
    if "revoked" in (a["status"], b["status"]):
        return "revoked"
    if "superseded" in (a["status"], b["status"]):
        return "supersedes"
    if same is False:
        own = a["publisher"] is not None and a["publisher"] == b["publisher"]
        if own and None not in (a["asserted_at"], b["asserted_at"]) and a["asserted_at"] != b["asserted_at"]:
            return "supersedes"
        if (a["stance"] == "analyst") != (b["stance"] == "analyst"):
            return "analyst_override"
    if same:
        return "agrees"
    bad, good = ("malicious", "suspicious"), ("benign", "allow_listed")
    if a["slot"] == "disposition" and ((a["value"] in bad and b["value"] in good) or (b["value"] in bad and a["value"] in good)):
        return "conflict"
    # A null value of a single-valued attribute conflicts with any other: nothing says that they are the same.
    return "conflict" if a["slot"] == f"attribute:{single}" else "compatible"


def claims(seed, n):
    r = random.Random(seed)
    for i in range(n):
        yield {
            "id": i, "subject": r.choice(["hot", "hot", "a", "b", None]), "slot": r.choice(["disposition", "attribute:os", "attribute:tag", None]), "status": r.choice(["active"] * 5 + ["revoked", "superseded"]),
            "value": r.choice(["malicious", "benign", "suspicious", "allow_listed", None]), "publisher": r.choice(["p", "q", None]), "asserted_at": r.choice([1, 2, None]), "stance": r.choice(["analyst", "reported"]), "extra": r.choice(["x", None]),
        }


@pytest.mark.parametrize("more", [[], ["extra"]])
def test_classes_stand_for_all_pairs(spark, more):
    rows = list(claims(5, 140))
    df = spark.createDataFrame([tuple(x[c.split()[0]] for c in SCHEMA.split(", ")) for x in rows], SCHEMA)
    alike = lambda x: tuple(x[c] for c in [*ev.ALIKE, *more])
    least = {}
    for x in rows:
        least.setdefault(alike(x), x["id"])
    assert {r.id: r.class_id for r in ev.claim_members(df, more).collect()} == {x["id"]: least[alike(x)] for x in rows}
    want = Counter()
    for x, y in combinations(rows, 2):
        if x["subject"] is not None and x["slot"] is not None and (x["subject"], x["slot"]) == (y["subject"], y["slot"]):
            want[(*sorted((least[alike(x)], least[alike(y)])), relation(x, y, "os"))] += 1
    got = ev.related_classes(df, ["os"], more).collect()
    assert {(r.left_id, r.right_id, r.relation): r.pairs for r in got} == dict(want) and len(got) == len(want)
    assert all(r.left_value == rows[r.left_id]["value"] and r.right_value == rows[r.right_id]["value"] for r in got)
    total = Counter()
    for (_, _, kind), n in want.items():
        total[kind] += n
    assert {r.relation: r.pairs for r in ev.relation_summary(df, ["os"]).collect()} == dict(total)


@pytest.mark.parametrize("block", [1024, 8])
def test_every_pair_of_claims(spark, monkeypatch, block):
    """Each two claims of a subject and slot once, also where the subject's pairs are dealt out in blocks."""
    monkeypatch.setattr(ev, "BLOCK", block)
    rows = list(claims(9, 140))
    df = spark.createDataFrame([tuple(x[c.split()[0]] for c in SCHEMA.split(", ")) for x in rows], SCHEMA)
    want = sorted((x["id"], y["id"], relation(x, y, "os")) for x, y in combinations(rows, 2) if x["subject"] is not None and x["slot"] is not None and (x["subject"], x["slot"]) == (y["subject"], y["slot"]))
    assert sorted((r.left_id, r.right_id, r.relation) for r in ev.related_claims(df, ["os"]).collect()) == want


def test_the_query_returns_every_pair(spark):
    """As many rows as there are pairs of orders of a customer, and as its classes count."""
    from signalcontext.plans import queries as q

    d = "/root/testdata/sf0.001"
    pairs = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").count().selectExpr("sum(count * (count - 1) div 2)").first()[0]
    assert q.contradiction_pairs(spark, d).count() == pairs == q.contradiction_classes(spark, d).agg(F.sum("pairs")).first()[0]


def test_no_claims(spark):
    assert ev.related_classes(spark.createDataFrame([], SCHEMA), ["os"]).count() == 0
    assert ev.related_claims(spark.createDataFrame([], SCHEMA), ["os"]).count() == 0


def test_a_hot_subject_is_met_as_classes(spark):
    """100,000 claims of one subject make five thousand million pairs and seven classes."""
    df = spark.range(100_000).selectExpr("id", "'hot' as subject", "'attribute:os' as slot", "'active' as status", "cast(id % 7 as string) as value", "'p' as publisher", "id as asserted_at", "'reported' as stance")
    rows = ev.related_classes(df, ["os"]).collect()
    assert sum(r.pairs for r in rows) == 100_000 * 99_999 // 2 and len(rows) == 28 and {r.relation for r in rows} == {"agrees", "supersedes"}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_ages_are_whole_days_to_the_microsecond(spark, zone):
    """A tenth of a second short of two days is one day, and no summer time makes a day shorter."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("2024-03-08 12:00:00.500000", "2024-03-10 12:00:00.400000"), ("2024-03-08 12:00:00.4", "2024-03-10 12:00:00.4"), ("2024-03-10 02:30:00", "2024-03-12 02:29:59.999999"), ("2024-03-12", "2024-03-11"), (None, "2024-03-11"), ("2099-01-01", "2099-01-02")]
        df = spark.createDataFrame(rows, "at string, now string").selectExpr("cast(at as timestamp_ntz) as at", "cast(now as timestamp_ntz) as now")
        got = df.select(ev.decay_anchor({"published": F.col("at")}, F.col("now"))["age"].alias("a"), ev.decay_anchor({"published": F.col("at")}, F.col("now"), future=True)["age"].alias("b")).collect()
        assert [tuple(r) for r in got] == [(1, 1), (2, 2), (1, 1), (None, 0), (None, None), (1, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
