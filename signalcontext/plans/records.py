"""Registered queries over sources, policy, canonical forms, ranking and snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bridge as b
from .. import query as q
from ..functions import canon, ids
from ..operators import evidence as ev
from ..operators import graph as g
from ..operators import store as st
from ..shared import written
from ..sources import flat, mapped, sigma, stix, xml
from .queries import ENTITIES, EDGES, OBSERVED, registered

_LEVEL = "([NULL, 'clear', 'TLP:GREEN', 'Amber', 'amber+strict', 'RED', 'black', 'white', 'tlp:amber_strict'])[o_orderkey % 9 + 1]"
_RANK = f"CASE {_LEVEL} WHEN 'clear' THEN 0 WHEN 'white' THEN 0 WHEN 'TLP:GREEN' THEN 1 WHEN 'Amber' THEN 2 WHEN 'amber+strict' THEN 3 WHEN 'tlp:amber_strict' THEN 3 WHEN 'RED' THEN 4 WHEN 'black' THEN 5 END"


def _pick(names: list, key):
    return F.get(F.array(*(F.lit(n).cast("string") for n in names)), (key % len(names)).cast("int"))


def _marked(spark, d):
    i = F.col("o_orderkey")
    tlp = _pick([None, "clear", "TLP:GREEN", "Amber", "amber+strict", "RED", "black", "white", "tlp:amber_strict"], i)
    marks = st.markings(tlp, F.when(i % 5 == 0, "purple"), F.when(i % 3 == 0, _pick(["legal_hold", "internal"], i)), F.when(i % 7 == 0, "cite"))
    return b.read(spark, d, "orders").select(i.alias("id"), F.col("o_custkey").alias("owner"), marks.alias("markings"))


@registered(f"""WITH m AS (SELECT o_orderkey AS id, {_RANK} AS r, o_orderkey % 5 = 0 AS pap, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS hold, o_orderkey % 7 = 0 AS cite FROM orders)
SELECT id, concat_ws(',', 'missing_capability', CASE WHEN r > 2 THEN 'tlp_above_ceiling' END, CASE WHEN pap THEN 'pap_above_ceiling' END, CASE WHEN hold THEN 'handling_not_cleared' END, CASE WHEN cite THEN 'attribution_required' END) AS denials FROM m""")
def policy_redistribution(spark, d):
    who = st.Identity("amber", "red", ("internal",), ("read",))
    return _marked(spark, d).select("id", F.array_join(st.decide(F.col("markings"), who, "redistribute"), ",").alias("denials"))


@registered(f"""WITH m AS (SELECT o_orderkey AS id, {_RANK} AS r, o_orderkey % 5 = 0 AS pap, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS hold FROM orders)
SELECT id, r IS NULL OR r <= 3 AS passes_traversal FROM m WHERE (r IS NULL OR r <= 3) AND NOT pap AND NOT hold""")
def policy_allowed(spark, d):
    who = st.Identity("amber+strict", "red", ("internal",))
    allowed, _ = st.partition(_marked(spark, d), F.col("markings"), who)
    return allowed.select("id", st.permitted(F.col("markings"), "amber+strict").alias("passes_traversal"))


@registered(f"""WITH m AS (SELECT o_custkey AS owner, {_RANK} AS r, CASE WHEN o_orderkey % 5 = 0 THEN 4 END AS p, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'legal_hold' ELSE 'internal' END END AS h FROM orders)
SELECT owner, ([ 'clear', 'green', 'amber', 'amber+strict', 'red', 'unknown'])[max(r) + 1] AS tlp, ([ 'clear', 'green', 'amber', 'red', 'unknown'])[max(p) + 1] AS pap, array_to_string(list_sort(list_distinct(list(h))), ',') AS handling FROM m GROUP BY 1""")
def marking_summary(spark, d):
    out = st.marking_summary(_marked(spark, d), "owner")
    handling = F.transform(F.filter("markings", lambda m: m["kind"] == "handling"), lambda m: m["value"])
    return out.select("owner", "tlp", "pap", F.array_join(handling, ",").alias("handling"))


@registered("SELECT o_orderpriority AS kind, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'refused' END AS verdict, count(*) AS n FROM orders GROUP BY 1, 2")
def decision_counts(spark, d):
    verdict = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "pending").otherwise("refused")
    return st.decision_counts(b.read(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), verdict.alias("verdict")))


@registered("""WITH t AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN ts END AS published, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 400 DAY END AS last_seen, CASE WHEN event_id % 5 > 0 THEN ts - INTERVAL 2 DAY END AS created, (SELECT max(ts) FROM events) AS now FROM events),
p AS (SELECT id, now, CASE WHEN last_seen <= now THEN 'last_seen' WHEN published <= now THEN 'published' WHEN created <= now THEN 'created' END AS anchor, CASE WHEN last_seen <= now THEN last_seen WHEN published <= now THEN published WHEN created <= now THEN created END AS "at" FROM t)
SELECT id, anchor, floor((epoch(now) - epoch("at")) / 86400)::BIGINT AS age FROM p""")
def decay_anchor(spark, d):
    e, i = b.read(spark, d, "events"), F.col("event_id")
    now = e.agg(F.max("ts").alias("now"))
    ts = F.col("ts").cast("timestamp_ntz")
    instants = {"published": F.when(i % 3 == 0, ts), "last_seen": F.when(i % 2 == 0, ts + F.expr("interval 400 days")), "created": F.when(i % 5 > 0, ts - F.expr("interval 2 days"))}
    rows = e.join(F.broadcast(now)).select(i.alias("id"), ev.decay_anchor(instants, F.col("now").cast("timestamp_ntz")).alias("a"))
    return rows.select("id", "a.anchor", "a.age")


@registered("""SELECT o_orderkey AS id, ((3 * (o_orderkey % 101) + 2 * (o_orderkey % 6) * 20 + 2 * (o_orderkey % 51) + 3 * CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 97 ELSE 0 END + (100 - o_orderkey % 90)) // 14)::BIGINT AS score,
CASE WHEN o_orderkey % 8 = 0 THEN 'unstated' WHEN o_orderkey % 101 < 20 THEN '0-19' WHEN o_orderkey % 101 < 40 THEN '20-39' WHEN o_orderkey % 101 < 60 THEN '40-59' WHEN o_orderkey % 101 < 80 THEN '60-79' ELSE '80+' END AS band FROM orders""")
def rank_scores(spark, d):
    i = F.col("o_orderkey")
    parts = {"confidence": i % 101, "corroboration": i % 6 * 20, "freshness": i % 51, "relevance": F.when(i % 4 > 0, i % 97), "cost": i % 90}
    return b.read(spark, d, "orders").select(i.alias("id"), g.rank_score(parts).alias("score"), g.confidence_band(F.when(i % 8 > 0, i % 101)).alias("band"))


@registered("""WITH w AS (SELECT o_custkey AS id, o_orderstatus AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders),
o AS (SELECT c_custkey AS id, c_mktsegment AS v FROM customer) SELECT id, v FROM w WHERE k = 1 UNION ALL SELECT id, v FROM o WHERE id NOT IN (SELECT id FROM w)""")
def upsert_snapshot(spark, d):
    stored = b.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    batch = b.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("v"), "o_orderkey")
    return written(st.upserted(stored, st.last_writes(batch, "id", "o_orderkey").drop("o_orderkey"), "id"), "snapshot")


@registered(f"WITH {ENTITIES} SELECT id, kind, status FROM entities WHERE kind IN ('identity', 'infrastructure') AND status IN ('expired') AND last_seen >= DATE '1995-06-01'")
def search_by_kind_status_and_day(spark, d):
    return b.entities(spark, d).where(q.entity_filter(["identity", "infrastructure"], ["expired"], seen_from="1995-06-01")).select("id", "kind", "status")


@registered(f"WITH {EDGES} SELECT id, kind, source_ref, target_ref FROM edges WHERE target_ref = 'p:5' AND kind = 'hosts'")
def edges_incoming(spark, d):
    return q.edges(b.relationships(spark, d), "p:5", "incoming", ["hosts"])


@registered(f"""WITH {OBSERVED}, f AS (SELECT record_id, min(arrival) AS first FROM verdicts GROUP BY 1)
SELECT record_id, array_to_string(list(content_hash ORDER BY arrival) FILTER (verdict = 'update' OR arrival = first), ',') AS versions, array_to_string(list_sort(list_distinct(list(publisher) FILTER (verdict = 'independent_corroboration'))), ',') AS publishers FROM verdicts JOIN f USING (record_id) GROUP BY 1""")
def lineage_lists(spark, d):
    out = ev.lineage_of(ev.dedup_verdicts(b.observations(spark, d)))
    return out.select("record_id", F.array_join("versions", ",").alias("versions"), F.array_join("publishers", ",").alias("publishers"))


@registered("""SELECT event_id AS id, CASE WHEN event_id % 65536 = 0 THEN 'fe80::' ELSE printf('fe80::%x', event_id % 65536) END AS address, lower(printf('2001:db8:0:%x::/64', event_id % 65535 + 1)) AS network FROM events""")
def ipv6_forms(spark, d):
    i = F.col("event_id")
    raw = F.upper(F.concat(F.lit("fe80:0000:0:00::"), F.lpad(F.hex(i % 65536), 4, "0")))
    net = F.concat(F.lit("2001:DB8:0000:"), F.hex(i % 65535 + 1), F.lit(":ffff::1/64"))
    return b.read(spark, d, "events").select(i.alias("id"), canon.ip_address(raw).alias("address"), canon.any_range(net).alias("network"))


@registered("""SELECT p_partkey AS id, 'cpe:2.3:a:V:p' || p_partkey || ':*:*:*:*:*:*:*:*' AS cpe, 'pkg:npm/P@' || p_partkey AS purl, 'reg.example:5000/app' || p_partkey || ':V1' AS image, 'arn:aws:s3:eu:1:Bucket/' || p_partkey AS cloud,
'pod/ns/P' || p_partkey AS kubernetes, 'windows:C:\\Dir\\f' || p_partkey || '.exe' AS path, 'f' || p_partkey || '.exe' AS name, 'CVE-2024-' || (10000 + p_partkey) AS cve, 'T' || (1000 + p_partkey % 9000) AS technique, 'https://a.example/' || p_partkey AS network FROM part""")
def identifier_forms(spark, d):
    k = F.col("p_partkey").cast("string")
    t = lambda before, after="": F.concat(F.lit(before), k, F.lit(after))
    return b.read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), canon.cpe(t("CPE:2.3:A:V:p", ":*:*:*:*:*:*:*:*")).alias("cpe"), canon.package_url(t("pkg://NPM/P@")).alias("purl"), canon.container_image(t("Reg.Example:5000/App", ":V1")).alias("image"),
        canon.cloud_resource(t("ARN:AWS:s3:EU:1:Bucket/")).alias("cloud"), canon.kubernetes_resource(t("Pod/ns/P")).alias("kubernetes"), canon.file_path(t("c:/Dir/f", ".exe")).alias("path"), canon.file_name(t(" f", ".exe")).alias("name"),
        canon.cve(F.concat(F.lit("cve-2024-"), (F.col("p_partkey") + 10000).cast("string"))).alias("cve"), canon.attack_id(F.concat(F.lit("t"), (F.col("p_partkey") % 9000 + 1000).cast("string"))).alias("technique"), canon.any_network(t("HTTPS://A.example:443/")).alias("network"))


def _bundles(spark, d):
    """A bundle a supplier: its identity, an indicator for two domains, an observation and two relationships, one dangling."""
    k = F.col("s_suppkey").cast("string")
    t = lambda before, after="": F.concat(F.lit(before), k, F.lit(after))
    lit = F.lit
    made = [
        F.struct(lit("marking-definition").alias("type"), lit("m1").alias("id"), F.struct(lit("green").alias("tlp")).alias("definition")),
        F.struct(lit("identity").alias("type"), lit("i1").alias("id"), F.col("s_name").alias("name"), F.array(lit("m1")).alias("object_marking_refs"), (F.col("s_acctbal") < 0).alias("revoked")),
        F.struct(lit("indicator").alias("type"), lit("n1").alias("id"), lit("stix").alias("pattern_type"), t("[domain-name:value = 'S", ".Example' OR ipv4-addr:value = '192.0.2.7']").alias("pattern"), F.array(F.when(F.col("s_suppkey") % 2 == 0, "malicious-activity").otherwise("benign")).alias("indicator_types")),
        F.struct(lit("relationship").alias("type"), lit("r1").alias("id"), lit("indicates").alias("relationship_type"), lit("n1").alias("source_ref"), lit("i1").alias("target_ref")),
        F.struct(lit("relationship").alias("type"), lit("r2").alias("id"), lit("uses").alias("relationship_type"), lit("i1").alias("source_ref"), lit("gone").alias("target_ref")),
        F.struct(lit("observed-data").alias("type"), lit("o1").alias("id"), lit("2024-01-01T00:00:00Z").alias("first_observed"), lit("2024-01-02T00:00:00Z").alias("last_observed"), (F.col("s_suppkey") + 1).alias("number_observed"), F.create_map(lit("0"), F.struct(lit("domain-name").alias("type"), t("o", ".example").alias("value"))).alias("objects")),
    ]
    text = F.concat(lit('{"type": "bundle", "objects": ['), F.concat_ws(",", *(F.to_json(x) for x in made)), lit("]}"))
    return b.read(spark, d, "supplier").select(k.alias("doc"), text.alias("text"))


@registered("""WITH s AS (SELECT s_suppkey::VARCHAR AS doc, s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'malicious-activity' ELSE 'benign' END AS t FROM supplier),
o AS (SELECT *, unnest(['s' || k || '.example', '192.0.2.7']) AS observable FROM s), x AS (SELECT *, '[domain-name:value = ''S' || k || '.Example'' OR ipv4-addr:value = ''192.0.2.7'']' AS pattern FROM o)
SELECT doc, observable, 'attribute' AS assertion, 'stix.indicator.pattern' AS name, pattern AS value FROM x UNION ALL SELECT doc, observable, 'attribute', 'stix.indicator.alternatives', '2' FROM x UNION ALL SELECT doc, observable, 'attribute', 'stix.indicator_type', t FROM x
UNION ALL SELECT doc, observable, 'disposition', NULL, CASE t WHEN 'benign' THEN 'benign' ELSE 'malicious' END FROM x UNION ALL SELECT doc, 'o' || k || '.example', 'attribute', 'stix.observed_data', 'o' || k || '.example' FROM s""")
def stix_claims(spark, d):
    return stix.parse(_bundles(spark, d)).claims.select("doc", "observable", "assertion", "name", "value")


@registered("""SELECT s_suppkey::VARCHAR AS doc, s_name AS name, 'identity' AS kind, CASE WHEN s_acctbal < 0 THEN 'revoked' ELSE 'active' END AS status, 'green' AS tlp, 2::BIGINT AS edges, 1::BIGINT AS rejects, s_suppkey + 1 AS seen FROM supplier""")
def stix_documents(spark, d):
    read = stix.parse(_bundles(spark, d))
    count = lambda df, name: df.groupBy("doc").agg(F.count("*").alias(name))
    out = read.entities.join(count(read.relationships.where("kind = 'indicates'"), "edges"), "doc").join(count(read.rejects.where("reason = 'unresolved_target_ref'"), "rejects"), "doc")
    out = out.join(read.sightings.groupBy("doc").agg(F.sum("count").alias("seen")), "doc")
    return out.select("doc", "name", "kind", "status", F.get("markings", 0)["value"].alias("tlp"), "edges", "rejects", "seen")


_MAPPING = {
    "format": "json", "records": "$.parts[*]", "filters": [{"path": "$.state", "op": "not_equals", "value": "old"}],
    "fields": [{"path": "$.host", "target": "subject", "kind": "domain_name", "transforms": [{"op": "undefang"}, {"op": "lowercase"}]}, {"path": "$.tags[*].name", "target": "attribute", "name": "tag", "transforms": [{"op": "split_take", "separator": "-", "index": 1}]}, {"path": "$.bad", "target": "disposition"}],
}


@registered("""WITH p AS (SELECT (p_partkey // 50)::VARCHAR AS doc, p_partkey AS k, p_size FROM part WHERE p_partkey % 10 > 0 AND p_partkey % 7 > 0)
SELECT doc, 'p' || k || '.example' AS subject, 'attribute' AS assertion, k || '' AS value FROM p UNION ALL SELECT doc, 'p' || k || '.example', 'attribute', 'plain' FROM p
UNION ALL SELECT doc, 'p' || k || '.example', 'disposition', CASE WHEN p_size > 25 THEN 'malicious' ELSE 'benign' END FROM p""")
def mapped_claims(spark, d):
    k = F.col("p_partkey").cast("string")
    # Each seventh record is out of date, each tenth has no subject.
    item = F.struct(F.when(F.col("p_partkey") % 10 > 0, F.concat(F.lit("P"), k, F.lit("[.]EXAMPLE"))).alias("host"), F.when(F.col("p_partkey") % 7 == 0, "old").alias("state"),
                    F.array(F.struct(F.concat(F.lit("t-"), k).alias("name")), F.struct(F.lit("plain").alias("name"))).alias("tags"), (F.col("p_size") > 25).alias("bad"))
    docs = b.read(spark, d, "part").groupBy(F.expr("string(p_partkey div 50)").alias("doc")).agg(F.to_json(F.struct(F.collect_list(item).alias("parts"))).alias("text"))
    return mapped.apply(docs, _MAPPING).claims.select("doc", "subject", "assertion", "value")


@registered("""SELECT (event_id // 100)::VARCHAR AS doc, 'json.host' AS name, 'domain_name' AS kind, 'e' || event_id || '.example' AS value FROM events WHERE event_id % 4 > 0""")
def json_line_claims(spark, d):
    line = F.when(F.col("event_id") % 4 > 0, F.to_json(F.struct(F.concat(F.lit("E"), F.col("event_id"), F.lit(".example")).alias("host"), F.col("value").alias("n"), F.lit("some words").alias("note")))).otherwise("{broken")
    docs = b.read(spark, d, "events").groupBy(F.expr("string(event_id div 100)").alias("doc")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return mapped.json_lines(docs).claims.select("doc", "name", "kind", "value")


@registered("""SELECT (c_custkey // 100)::VARCHAR AS doc, 'ipv4_address' AS kind, '192.0.' || (c_custkey // 256 % 256) || '.' || (c_custkey % 256) AS value, 'claim' AS outcome FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT (c_custkey // 100)::VARCHAR, 'domain_name', 'c' || c_custkey || '.example', 'claim' FROM customer UNION ALL SELECT (c_custkey // 100)::VARCHAR, NULL, NULL, 'unmappable_field' FROM customer WHERE c_custkey % 3 = 0""")
def delimited_claims(spark, d):
    k = F.col("c_custkey")
    ip = F.when(k % 3 > 0, F.concat_ws(".", F.lit("192.0"), F.floor(k / 256).cast("long") % 256, k % 256)).otherwise("none")
    docs = b.read(spark, d, "customer").groupBy(F.expr("string(c_custkey div 100)").alias("file")).agg(F.concat(F.lit("ip;domain\n"), F.array_join(F.collect_list(F.concat(ip, F.lit(";C"), k.cast("string"), F.lit(".example"))), "\n")).alias("text"))
    return flat.claims(docs).select(F.col("file").alias("doc"), "kind", "value", "outcome")


_SPACE = ids.uuid.uuid5(ids.ROOT, "entity").hex


@registered(f"""WITH {ENTITIES}, h AS (SELECT id, sha1(unhex('{_SPACE}') || encode(strlen(kind) || ':' || kind || strlen(lower(name)) || ':' || lower(name))) AS h FROM entities)
SELECT id, 'entity:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17])::INT % 4) + 1, 1) || h[18:20] || '-' || h[21:32] AS uuid FROM h""")
def entity_ids(spark, d):
    return b.entities(spark, d).select("id", ids.named_uuid("entity", F.col("kind"), F.lower("name")).alias("uuid"))


@registered("SELECT count(*)::BIGINT AS blobs, sum(n)::BIGINT AS stored_bytes FROM (SELECT DISTINCT sha256(text), strlen(text) AS n FROM documents) WHERE n <= 20000")
def blob_totals(spark, d):
    stored = st.blobs(b.read(spark, d, "documents").select(F.col("text").alias("content")), 20000).where("outcome = 'stored'")
    return stored.agg(F.count("*").alias("blobs"), F.sum("byte_length").alias("stored_bytes"))


@registered("SELECT n_name AS name, CASE WHEN count(c_custkey) = 0 THEN 100 ELSE (count(*) FILTER (c_acctbal >= 0) * 100) // count(c_custkey) END::BIGINT AS active_percent FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def quality_share(spark, d):
    c = b.read(spark, d, "customer")
    rows = b.read(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    n = rows.groupBy(F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("n"), F.count(F.when(F.col("c_acctbal") >= 0, 1)).alias("ok"))
    return n.select("name", ev.percent(F.col("ok"), F.col("n")).alias("active_percent"))


@registered("""WITH b AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderkey % 3 = 0), a AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderkey % 3 = 1),
s AS (SELECT key, CASE WHEN key % 4 = 0 THEN 1 WHEN key % 4 = 1 THEN 2 ELSE 0 END AS n FROM b)
SELECT coalesce(a.key, s.key) AS key, CASE WHEN s.key IS NULL THEN 'added' WHEN a.key IS NOT NULL THEN 'changed' WHEN n = 1 THEN 'merged' WHEN n = 2 THEN 'split' ELSE 'removed' END AS category FROM s FULL JOIN a USING (key)""")
def succession_delta(spark, d):
    o = b.read(spark, d, "orders")
    taken = lambda r, digest: o.where(F.col("o_orderkey") % 3 == r).select(F.col("o_custkey").alias("key"), F.lit(digest).alias("digest"), F.lit("active").alias("status")).distinct()
    before = taken(0, "b")
    heirs = F.when(F.col("key") % 4 == 0, F.array(F.lit("x"))).when(F.col("key") % 4 == 1, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    return g.compare(before, taken(1, "a"), before.select("key", F.explode(heirs).alias("successor")))


def _rules(spark, d):
    """A file a part: a rule with tags, a list, a modifier and a negated selection; each third has a second document, in
    turn one that is no YAML, one without a title and one that is withdrawn."""
    k = F.col("p_partkey").cast("string")
    t = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    ip = F.concat_ws(".", F.lit("192.0"), F.floor(F.col("p_partkey") / 256).cast("long") % 256, F.col("p_partkey") % 256)
    first = t("title: ", F.col("p_name"), "\nid: 'r", k, "'\nlevel: high # as found\nlogsource:\n  product: ", F.lower("p_type"), "\ntags:\n  - attack.t", (F.col("p_partkey") % 9000 + 1000).cast("string"), "\n  - attack.impact\ndetection:\n  pick:\n    dst_ip:\n      - ", ip,
              "\n      - '198.51.100.", (F.col("p_partkey") % 200).cast("string"), "'\n      - ", k, "\n    QueryName|endswith: .P", k, ".example\n  filter:\n    - QueryName: Ok", k, ".example\n      Image: x.exe\n    - Hash: none\n  condition: pick and not filter\n")
    second = F.when(F.col("p_partkey") % 9 == 0, "title: [").when(F.col("p_partkey") % 9 == 3, "id: a\ndetection:\n  a: b").when(F.col("p_partkey") % 9 == 6, t("title: old\nstatus: deprecated\ndetection:\n- x\nid: o", k))
    # Dealt out before the texts are made: a table of parts is a small file that one task would read alone.
    return b.read(spark, d, "part").select("p_partkey", "p_name", "p_type").hint("rebalance", "p_partkey").select(k.alias("doc"), F.concat_ws("\n---\n", first, second).alias("text"))


@registered("""WITH p AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS doc, lower(p_type) AS product, '192.0.' || (p_partkey // 256 % 256) || '.' || (p_partkey % 256) AS ip, '198.51.100.' || (p_partkey % 200) AS ip2 FROM part)
SELECT doc, 0 AS part, unnest(['sigma.id', 'sigma.level', 'sigma.logsource.product', 'sigma.tag', 'sigma.tag', 'sigma.detection', 'sigma.detection', 'sigma.detection', 'sigma.detection.unread']) AS name,
  unnest(['r' || k, 'high', product, 'attack.t' || (k % 9000 + 1000), 'attack.impact', ip, ip2, 'ok' || k || '.example', 'Hash (not canonical), Image, QueryName|endswith (modifier), dst_ip (not a string)']) AS value FROM p
UNION ALL SELECT doc, 1, unnest(['sigma.status', 'sigma.id']), unnest(['deprecated', 'o' || k]) FROM p WHERE k % 9 = 6""")
def sigma_claims(spark, d):
    return sigma.parse(_rules(spark, d)).claims.select("doc", "part", "name", "value")


@registered("""WITH p AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS doc, p_name FROM part)
SELECT doc, 0 AS part, 'rule' AS kind, p_name AS name, 'active' AS state, 4::BIGINT AS edges FROM p UNION ALL SELECT doc, 0, 'technique', 'T' || (k % 9000 + 1000), 'active', 0 FROM p
UNION ALL SELECT doc, 1, 'rule', 'old', 'deprecated', 0 FROM p WHERE k % 9 = 6 UNION ALL SELECT doc, 1, 'reject', NULL, CASE k % 9 WHEN 0 THEN 'invalid_yaml' ELSE 'missing_title' END, 0 FROM p WHERE k % 9 IN (0, 3)""")
def sigma_rules(spark, d):
    read = sigma.parse(_rules(spark, d))
    edges = read.relationships.groupBy("doc", "part", F.col("source_ref").alias("id")).agg(F.count("*").alias("n"))
    rules = read.entities.join(edges, ["doc", "part", "id"], "left").select("doc", "part", F.when(F.col("kind") == "detection_rule", "rule").otherwise("technique").alias("kind"), "name", F.col("status").alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("edges"))
    return rules.unionByName(read.rejects.select("doc", "part", F.lit("reject").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("reason").alias("state"), F.lit(0).cast("long").alias("edges")))


@registered("""WITH s AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS doc, s_name FROM supplier), o AS (SELECT * FROM s WHERE k % 7 > 0)
SELECT doc, 'detection_rule' AS kind, CASE WHEN k % 3 = 0 THEN 'i' || k ELSE s_name END AS value FROM o
UNION ALL SELECT doc, 'openioc.indicator', 's' || k || '.example' FROM o WHERE k % 5 > 0 UNION ALL SELECT doc, 'openioc.indicator', '198.51.100.' || (k % 200) FROM o
UNION ALL SELECT doc, 'openioc.unread', CASE WHEN k % 5 = 0 THEN 'Network/DNS (not canonical), ' ELSE '' END || 'Network/URI (condition `contains`), Registry/Path' FROM o
UNION ALL SELECT doc, 'indicates', count(*)::VARCHAR FROM (SELECT doc FROM o WHERE k % 5 > 0 UNION ALL SELECT doc FROM o) GROUP BY doc UNION ALL SELECT doc, 'unreadable_document', 'a document type' FROM s WHERE k % 7 = 0""")
def openioc_indicators(spark, d):
    k = F.col("s_suppkey").cast("string")
    item = lambda search, content, condition="is": F.concat(F.lit(f"<IndicatorItem condition='{condition}'><Context search='{search}'/><Content>"), content, F.lit("</Content></IndicatorItem>"))
    host = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("no host "), k)).otherwise(F.concat(F.lit("S"), k, F.lit(".Example")))
    title = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name"))
    items = F.concat(item("Network/DNS", host), item("PortItem/remoteIP", F.concat(F.lit("198.51.100."), (F.col("s_suppkey") % 200).cast("string"))), item("Network/URI", F.lit("x"), "contains"), item("Registry/Path", F.lit("x")))
    text = F.concat(F.when(F.col("s_suppkey") % 7 == 0, "<!DOCTYPE ioc []>").otherwise(""), F.lit("<i:ioc xmlns:i='urn:i' id='i"), k, F.lit("'><short_description>"), title, F.lit("</short_description><definition><Indicator>"), items, F.lit("</Indicator></definition></i:ioc>"))
    read = xml.openioc(b.read(spark, d, "supplier").select(k.alias("doc"), text.alias("text")))
    out = read.entities.select("doc", "kind", F.col("name").alias("value")).unionByName(read.claims.select("doc", F.col("name").alias("kind"), "value"))
    edges = read.relationships.groupBy("doc", "kind").agg(F.count("*").cast("string").alias("value"))
    return out.unionByName(edges).unionByName(read.rejects.select("doc", F.col("reason").alias("kind"), F.col("detail").alias("value")))


@registered("""WITH o AS (SELECT (c_custkey // 20)::VARCHAR AS doc, c_custkey AS k, lower(c_mktsegment) AS purpose, CASE WHEN c_acctbal < 0 THEN 'high' END AS severity FROM customer), g AS (SELECT * FROM o WHERE k % 11 > 0)
SELECT doc, 'incident' AS kind, 'csirt.example incident ' || k AS value FROM g UNION ALL SELECT doc, 'iodef.purpose', purpose FROM g UNION ALL SELECT doc, 'iodef.impact.severity', severity FROM g WHERE severity IS NOT NULL
UNION ALL SELECT doc, 'iodef.address', '192.0.2.' || (k % 250) FROM g UNION ALL SELECT doc, 'iodef.unread', 'Address category `asn`' FROM g UNION ALL SELECT doc, 'part_of', '192.0.2.' || (k % 250) FROM g
UNION ALL SELECT doc, 'missing_incident_id', NULL FROM o WHERE k % 11 = 0""")
def iodef_incidents(spark, d):
    k = F.col("c_custkey").cast("string")
    number = F.when(F.col("c_custkey") % 11 > 0, F.concat(F.lit("<IncidentID name='csirt.example'>"), k, F.lit("</IncidentID>"))).otherwise("")
    impact = F.when(F.col("c_acctbal") < 0, "<Assessment><Impact severity='high'/></Assessment>").otherwise("<Assessment/>")
    one = F.concat(F.lit("<Incident purpose='"), F.lower("c_mktsegment"), F.lit("'>"), number, impact, F.lit("<EventData><Node><Address category='ipv4-addr'> 192.0.2."), (F.col("c_custkey") % 250).cast("string"), F.lit("</Address><Address category='asn'>64500</Address></Node></EventData></Incident>"))
    docs = b.read(spark, d, "customer").groupBy(F.expr("string(c_custkey div 20)").alias("doc")).agg(F.concat(F.lit("<IODEF-Document>"), F.array_join(F.collect_list(one), "\n"), F.lit("</IODEF-Document>")).alias("text"))
    read = xml.iodef(docs)
    nodes = read.claims.where("name = 'iodef.address'").select("doc", F.col("subject").alias("source_ref"), "value").distinct()
    out = read.entities.select("doc", "kind", F.col("name").alias("value")).unionByName(read.claims.select("doc", F.col("name").alias("kind"), "value"))
    out = out.unionByName(read.relationships.join(nodes, ["doc", "source_ref"]).select("doc", "kind", "value"))
    return out.unionByName(read.rejects.select("doc", F.col("reason").alias("kind"), F.col("detail").alias("value")))
