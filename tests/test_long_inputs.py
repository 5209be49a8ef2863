"""Long values at the stated limits: no pattern takes a call a character, a line or an alternative."""

import json

from pyspark.sql import functions as F

from signalcontext.functions import canon
from signalcontext.sources import mapped, stix


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_json_depth(spark):
    for text, deep in [
        (json.dumps({"a": "x" * 60_000}), 1), (json.dumps({"a": '\\"{[' * 20_000}), 1), (json.dumps([{"a": [1, {"b": []}]}, {}]), 5), ("", 0), ('"[["', 0), ("[" * 70 + "]" * 70, 70),
        (json.dumps([{"a": i} for i in range(30_000)]), 2), ('{"a\n{": [[], [[]]]}', 4), ('["', 1),
    ]:
        assert one(spark, text, canon.json_depth) == deep


def test_long_cell(spark):
    cell = 'x,""y""' * 10_000
    got = one(spark, f'a.example, "{cell}" ,z,,', mapped._csv_fields)
    assert got == ["a.example", cell.replace('""', '"'), "z", "", ""]


def test_pattern_at_its_limit(spark):
    value = "a" * (stix.MOST_PATTERN - len("[file:name = '']"))
    # Longer than a file's name may be: it is read, and refused as a name.
    assert spark.createDataFrame([(f"[file:name = '{value}']",)], "v string").where(F.col("v").rlike(stix.PATTERN)).count() == 1
    assert one(spark, f"[file:name = '{value}']", stix.pattern_observables) is None
    many = " OR ".join(f"domain-name:value = '{'a' * 24}{i:03}.example'" for i in range(64))
    assert 3_800 < len(many) < stix.MOST_PATTERN - 2
    assert len(one(spark, f"[{many}]", stix.pattern_observables)) == 64
    assert one(spark, f"[{many} OR url:value = 'http://a.example/']", stix.pattern_observables) is None


def test_long_domain(spark):
    assert one(spark, "a." * 40_000 + "com", canon.domain) is None
    assert one(spark, "a." * 125 + "com", canon.domain) == "a." * 125 + "com"


def test_long_document(spark):
    text = json.dumps({"type": "bundle", "objects": [{"type": "malware", "id": "malware--1", "name": "m", "description": "d\\n" * 20_000}]})
    parsed = stix.parse(spark.createDataFrame([("d", text)], "doc string, text string"))
    assert parsed.entities.count() == 1 and parsed.rejects.count() == 0


def test_first_digest_by_kind(spark):
    """The digest of the first kind by name stands for a file, wherever the document has it."""
    text = json.dumps({"type": "file", "id": "file--1", "name": "n", "hashes": {"SHA-256": "a" * 64, "MD5": "b" * 32}})
    assert [r.observable for r in stix.parse(spark.createDataFrame([("d", text)], "doc string, text string")).claims.collect()] == ["md5:" + "b" * 32]


def test_words_of_dispositions(spark):
    mapping = {"format": "jsonl", "records": "$", "fields": [{"path": "$.d", "target": "subject", "kind": "domain_name"}, {"path": "$.v", "target": "disposition"}]}
    words = ["true", "yes", "y", "1", "malicious", "bad", "block", "deny", "false", "no", "n", "0", "benign", "good", "allow", "clean", "blocked", "allowed", "permit"]
    docs = spark.createDataFrame([("d", "\n".join(json.dumps({"d": f"a{i}.example", "v": w}) for i, w in enumerate(words)))], "doc string, text string")
    got = mapped.apply(docs, mapping)
    assert [r.value for r in got.claims.orderBy(F.length("subject"), "subject").collect()] == ["malicious"] * 8 + ["benign"] * 8
    assert {r.reason for r in got.rejects.collect()} == {"unknown_disposition"} and got.rejects.count() == 3


def test_addresses_in_long_runs(spark):
    """The linear pattern finds what the plain one finds, also after a match that ends inside a run, and long runs take no time."""
    import re
    import time

    from pyspark.sql import functions as F

    from signalcontext.plans import queries as qs

    texts = ["a@b.com_x@y.com", "a@b.com.c@d.org,e@f", "@@a@b.co", "x@y.z1@w.net", "..a@-.ab@cd.ef", "m" * 60_000, "m" * 60_000 + "@n", "u@" + "v." * 20_000, ("w@" * 20_000) + "x.com"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    began = time.time()
    got = {r.i: r.found for r in frame.select("i", F.regexp_extract_all("t", F.lit(qs._MAIL_ONCE), 0).alias("found")).collect()}
    assert time.time() - began < 20
    assert all(got[i] == re.findall(qs._MAIL, t) for i, t in enumerate(texts[:5])) and got[5] == got[6] == [] and got[8] == ["w@x.com"]
