"""The registered queries over the driver's tables, and the same in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import bridge as b
from .. import query as q
from ..functions import canon
from ..operators import capture as cp
from ..operators import evidence as ev
from ..operators import graph as g
from ..operators import store as st

NOW = "2001-01-01 00:00:00"

#: Shared pieces of the SQL.
ENTITIES = """entities AS (
  SELECT 'c:' || c_custkey AS id, 'identity' AS kind, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'expired' ELSE 'active' END AS status, last_seen
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_seen FROM orders GROUP BY 1) ON o_custkey = c_custkey
  UNION ALL SELECT 's:' || s_suppkey, 'infrastructure', s_name, CASE WHEN s_acctbal < 0 THEN 'expired' ELSE 'active' END, NULL FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, 'tool', p_name, 'active', NULL FROM part
  UNION ALL SELECT 'n:' || n_nationkey, 'location', n_name, 'active', NULL FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, 'sector', r_name, 'active', NULL FROM region)"""
EDGES = """edges AS (SELECT kind || '|' || source_ref || '|' || target_ref AS id, * FROM (
  SELECT 'located_at' AS kind, 'c:' || c_custkey AS source_ref, 'n:' || c_nationkey AS target_ref FROM customer
  UNION ALL SELECT 'located_at', 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT 'part_of', 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'hosts', 's:' || l_suppkey, 'p:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'targets', 'c:' || o_custkey, 'p:' || l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey))"""
BOTH = "doubled AS (SELECT id, source_ref AS node, target_ref AS other FROM edges UNION ALL SELECT id, target_ref, source_ref FROM edges)"
CLAIMS = """claims AS (SELECT o_orderkey AS id, 'c:' || o_custkey AS subject, 'attribute:order_status' AS slot, o_orderstatus AS value, o_orderpriority AS publisher,
  o_orderdate AS asserted_at, CASE WHEN o_orderkey % 17 = 0 THEN 'revoked' WHEN o_orderkey % 19 = 0 THEN 'superseded' ELSE 'active' END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN 'analyst' ELSE 'reported' END AS stance FROM orders)"""
OBSERVED = """obs AS (SELECT doc_id AS arrival, md5(lower(trim(split_part(text, chr(10), 1), ' '))) AS record_id, source AS publisher, md5(text) AS content_hash, md5(lower(trim(text, ' '))) AS record_hash FROM documents),
w AS (SELECT *, count(*) OVER a AS n, first_value(publisher) OVER (PARTITION BY record_id, content_hash ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bytes_by,
  first_value(record_hash) OVER (PARTITION BY record_id, publisher ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own
  FROM obs WINDOW a AS (PARTITION BY record_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
verdicts AS (SELECT *, CASE WHEN n = 0 THEN 'independent_corroboration' WHEN bytes_by = publisher THEN 'exact_duplicate' WHEN bytes_by IS NOT NULL THEN 'syndicated_copy'
  WHEN own = record_hash THEN 'canonical_duplicate' WHEN own IS NOT NULL THEN 'update' ELSE 'independent_corroboration' END AS verdict FROM w)"""
AGE = f"greatest(datediff('second', o_orderdate, TIMESTAMP '{NOW}') // 86400, 0)"
KIND = "CASE o_orderkey % 4 WHEN 0 THEN 'ipv4_address' WHEN 1 THEN 'domain_name' WHEN 2 THEN 'file_hash' ELSE 'mutex_name' END"
DECAYED = f"""aged AS (SELECT o_orderkey AS id, {KIND} AS kind, {AGE} AS age, o_orderdate AS at, CASE o_orderstatus WHEN 'F' THEN 'expired' ELSE 'active' END AS status FROM orders),
par AS (SELECT *, CASE kind WHEN 'ipv4_address' THEN 14 WHEN 'domain_name' THEN 45 WHEN 'mutex_name' THEN 365 END AS h, CASE kind WHEN 'ipv4_address' THEN 5 WHEN 'domain_name' THEN 10 WHEN 'mutex_name' THEN 20 ELSE 10 END AS f FROM aged),
up AS (SELECT *, CASE WHEN h IS NULL OR age // h >= 7 THEN 0 ELSE 100 >> (age // h)::INT END AS u FROM par),
stood AS (SELECT *, CASE WHEN h IS NULL THEN 100 ELSE greatest(u - ((u - u // 2) * (age % h)) // h, f) END AS standing FROM up)"""

#: The claims are all of one single-valued attribute, so different values conflict unless a status, a publisher's own later word or an analyst decides.
_RELATION = """CASE WHEN 'revoked' IN (l.status, r.status) THEN 'revoked' WHEN 'superseded' IN (l.status, r.status) THEN 'supersedes' WHEN l.value = r.value THEN 'agrees'
  WHEN l.publisher = r.publisher AND l.asserted_at IS DISTINCT FROM r.asserted_at THEN 'supersedes' WHEN list_sort([l.stance, r.stance]) = ['analyst', 'reported'] THEN 'analyst_override' ELSE 'conflict' END"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def current_with_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = q.doubled(b.relationships(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("degree"))
    rows = b.entities(spark, sf_dir).where(q.compile("status = active")).join(degree, F.col("id") == F.col("node"), "left")
    return rows.select("id", "kind", "name", F.coalesce("degree", F.lit(0)).alias("degree"))


@registered(f"WITH {ENTITIES}, {EDGES}, {BOTH} SELECT e.id, kind, name, coalesce(degree, 0) AS degree FROM entities e LEFT JOIN (SELECT node, count(*) AS degree FROM doubled GROUP BY 1) ON node = e.id WHERE status = 'active'")
def degree_by_node(spark, d):
    return current_with_degree(spark, d)


@registered(f"WITH {ENTITIES} SELECT id, kind, name, status FROM entities WHERE kind IN ('identity', 'infrastructure') AND status = 'expired' ORDER BY id LIMIT 1000")
def search_union_semantics(spark, d):
    return q.search(b.entities(spark, d), "kind = identity and kind = infrastructure and status = expired", 1000).select("id", "kind", "name", "status")


@registered(f"WITH {ENTITIES} SELECT id, last_seen FROM entities WHERE last_seen >= DATE '2001-01-01' AND date_trunc('day', last_seen) < DATE '2001-06-01'")
def search_last_seen_day(spark, d):
    return b.entities(spark, d).where(q.entity_filter(seen_from="2001-01-01", seen_before="2001-06-01")).select("id", "last_seen")


@registered(f"WITH {ENTITIES} SELECT id, kind, last_seen FROM entities ORDER BY last_seen DESC NULLS LAST, id LIMIT 50 OFFSET 25")
def list_entities_page(spark, d):
    return q.page(b.entities(spark, d).select("id", "kind", "last_seen"), 50, 25, F.col("last_seen").desc_nulls_last(), F.col("id"))


@registered(f"WITH {ENTITIES}, {EDGES} SELECT 'entities' AS what, kind, count(*) AS n FROM entities GROUP BY kind UNION ALL SELECT 'relationships', kind, count(*) FROM edges GROUP BY kind")
def stats_counts(spark, d):
    count = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(b.entities(spark, d), "entities").unionByName(count(b.relationships(spark, d), "relationships"))


@registered(f"WITH {EDGES}, {BOTH} SELECT node, count(*) AS degree FROM doubled GROUP BY node ORDER BY degree DESC, node LIMIT 20")
def degree_top_k(spark, d):
    return q.doubled(b.relationships(spark, d)).groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(20)


@registered(f"WITH {EDGES} SELECT id, kind, source_ref, target_ref FROM edges WHERE (source_ref = 'n:3' OR target_ref = 'n:3') AND kind IN ('located_at', 'part_of')")
def edges_either_kind(spark, d):
    return q.edges(b.relationships(spark, d), "n:3", "either", ["located_at", "part_of"])


@registered(f"WITH {EDGES} SELECT id, kind, source_ref, target_ref FROM edges WHERE source_ref = 's:1'")
def edges_outgoing(spark, d):
    return q.edges(b.relationships(spark, d), "s:1", "outgoing")


@registered(f"WITH {ENTITIES}, {EDGES} SELECT DISTINCT e.id, e.kind FROM edges x JOIN entities e ON e.id IN (x.source_ref, x.target_ref) WHERE x.kind = 'part_of'")
def endpoint_entities(spark, d):
    ends = b.relationships(spark, d).where("kind = 'part_of'").select(F.explode(F.array("source_ref", "target_ref")).alias("id"))
    return ends.join(b.entities(spark, d), "id").select("id", "kind").distinct()


@registered(f"WITH {ENTITIES}, {EDGES}, ends AS (SELECT id, source_ref AS \"end\" FROM edges UNION ALL SELECT id, target_ref FROM edges) SELECT id, \"end\" FROM ends WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.id = \"end\" AND e.status = 'active')")
def dangling_edges(spark, d):
    return st.dangling(b.relationships(spark, d), b.entities(spark, d).where("status = 'active'"))


@registered(f"WITH {CLAIMS} SELECT id, value, publisher FROM claims WHERE subject = 'c:7' ORDER BY id LIMIT 100")
def claims_about(spark, d):
    return b.claims(spark, d).where("subject = 'c:7'").orderBy("id").limit(100).select("id", "value", "publisher")


@registered("SELECT event_id AS id, event_type AS observer, ts AS at FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id LIMIT 50")
def sightings_of(spark, d):
    return b.sightings(spark, d).where("subject = 'u:3'").orderBy(F.desc("at"), "id").limit(50).select("id", "observer", "at")


@registered(f"WITH {OBSERVED} SELECT arrival, record_id, publisher, verdict FROM verdicts")
def dedup_verdicts(spark, d):
    return ev.dedup_verdicts(b.observations(spark, d)).select("arrival", "record_id", "publisher", "verdict")


@registered(f"""WITH {OBSERVED}, l AS (SELECT record_id, count(*) FILTER (verdict = 'update') + 1 AS versions, count(DISTINCT publisher) FILTER (verdict = 'independent_corroboration') AS parties FROM verdicts GROUP BY 1)
SELECT record_id, versions, versions - 1 AS revisions, parties, ([0, 25, 60, 80, 90, 100])[least(parties, 5) + 1]::BIGINT AS corroboration FROM l""")
def dedup_lineage(spark, d):
    return ev.lineage(ev.dedup_verdicts(b.observations(spark, d)))


#: Claims with the least id of those like them (in `more` too), and each two of one subject and slot once, in the order of their classes.
def _alike(more: str = "") -> str:
    return f"k AS (SELECT *, min(id) OVER (PARTITION BY subject, slot, status, value, publisher, stance{more}) AS class_id FROM claims)"


_MET = "k l JOIN k r ON l.subject = r.subject AND l.slot = r.slot AND (l.class_id < r.class_id OR (l.class_id = r.class_id AND l.id < r.id))"


@registered(f"WITH {CLAIMS} SELECT l.id AS left_id, r.id AS right_id, l.subject, l.slot, {_RELATION} AS relation FROM claims l JOIN claims r ON l.subject = r.subject AND l.slot = r.slot AND l.id < r.id")
def contradiction_pairs(spark, d):
    return ev.related_claims(b.claims(spark, d), ["order_status"])


@registered(f"WITH {CLAIMS}, {_alike()} SELECT l.class_id AS left_id, r.class_id AS right_id, l.subject, l.slot, {_RELATION} AS relation, count(*) AS pairs FROM {_MET} GROUP BY ALL")
def contradiction_classes(spark, d):
    return ev.related_classes(b.claims(spark, d), ["order_status"]).select("left_id", "right_id", "subject", "slot", "relation", "pairs")


@registered(f"WITH {CLAIMS}, {_alike()} SELECT id, class_id FROM k")
def contradiction_members(spark, d):
    return ev.claim_members(b.claims(spark, d))


_JUDGED = """claims AS (SELECT doc_id AS id, source AS subject, 'disposition' AS slot, CASE WHEN toxic = 1 THEN 'malicious' WHEN quality = 0 THEN 'suspicious' ELSE 'benign' END AS value, lang AS publisher,
  CASE WHEN doc_id % 4 > 0 THEN doc_id // 8 END AS asserted_at, CASE WHEN doc_id % 23 = 0 THEN 'revoked' ELSE 'active' END AS status, CASE WHEN doc_id % 11 = 0 THEN 'analyst' ELSE 'reported' END AS stance FROM labels JOIN documents USING (doc_id))"""


@registered(f"""WITH {_JUDGED}, {_alike()} SELECT l.class_id AS left_id, r.class_id AS right_id, l.subject, CASE WHEN 'revoked' IN (l.status, r.status) THEN 'revoked' WHEN l.value = r.value THEN 'agrees' WHEN l.publisher = r.publisher AND l.asserted_at <> r.asserted_at THEN 'supersedes'
  WHEN l.stance <> r.stance THEN 'analyst_override' WHEN 'benign' IN (l.value, r.value) THEN 'conflict' ELSE 'compatible' END AS relation, count(*) AS pairs FROM {_MET} GROUP BY ALL""")
def disposition_relations(spark, d):
    """How the judgements of each source's documents stand to each other; some have no instant, and a source may be hot."""
    i = F.col("doc_id")
    docs = b.read(spark, d, "documents").select("doc_id", F.col("source").alias("subject"), F.col("lang").alias("publisher"))
    claims = b.dispositions(spark, d).join(docs, "doc_id").select(
        i.alias("id"), "subject", ev.slot(F.lit("disposition"), F.lit(None)).alias("slot"), F.col("disposition").alias("value"), "publisher", F.when(i % 4 > 0, F.floor(i / 8)).alias("asserted_at"),
        F.when(i % 23 == 0, "revoked").otherwise("active").alias("status"), F.when(i % 11 == 0, "analyst").otherwise("reported").alias("stance"))
    return ev.related_classes(claims, []).select("left_id", "right_id", "subject", "relation", "pairs")


@registered(f"WITH {CLAIMS}, p AS (SELECT l.subject, {_RELATION} AS relation FROM claims l JOIN claims r ON l.subject = r.subject AND l.slot = r.slot AND l.id < r.id) SELECT relation, count(*) AS pairs, count(DISTINCT subject) AS subjects FROM p GROUP BY 1")
def contradiction_summary(spark, d):
    return ev.relation_summary(b.claims(spark, d), ["order_status"])


def _decayed(spark, d):
    k = F.col("id") % 4
    kind = F.when(k == 0, "ipv4_address").when(k == 1, "domain_name").when(k == 2, "file_hash").otherwise("mutex_name")
    rows = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", "expired").otherwise("active").alias("status"))
    rows = rows.withColumn("kind", kind).withColumn("age", ev.age_days(F.col("at"), F.lit(NOW)))
    half, floor = ev.decay_parameters(F.col("kind"))
    return rows.withColumn("standing", ev.standing(F.col("age"), half, floor))


@registered(f"WITH {DECAYED} SELECT id, kind, age, standing FROM stood")
def decay_standing(spark, d):
    return _decayed(spark, d).select("id", "kind", "age", "standing")


@registered(f"WITH {DECAYED} SELECT id, CASE WHEN status = 'expired' THEN 'expired' WHEN kind = 'mutex_name' THEN 'exempt' WHEN standing <= 25 THEN 'dormant' ELSE 'live' END AS state FROM stood")
def decay_state(spark, d):
    state = ev.decay_state(F.col("status"), F.lit(None).cast("timestamp"), F.lit(NOW).cast("timestamp"), F.col("kind") == "mutex_name", F.col("at"), F.col("standing"))
    return _decayed(spark, d).select("id", state.alias("state"))


@registered(f"WITH {DECAYED} SELECT id, CASE WHEN id % 101 > 0 THEN greatest((id % 101) * standing // 100, 1) ELSE 0 END AS ranking FROM stood")
def ranking_input(spark, d):
    return _decayed(spark, d).select("id", ev.ranking_input(F.col("id") % 101, F.col("standing")).alias("ranking"))


@registered("""WITH s AS (SELECT event_id AS id, 'u:' || user_id AS subject, ts AS "at", CASE WHEN value > 50 THEN 'live' ELSE 'dormant' END AS state FROM events),
p AS (SELECT *, lag(state) OVER (PARTITION BY subject ORDER BY "at", id) AS previous FROM s)
SELECT id, subject, "at", previous, state, previous <> 'live' AND state = 'live' AS reactivated FROM p WHERE previous IS NOT NULL AND previous <> state""")
def decay_transitions(spark, d):
    rows = b.read(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("subject"), F.col("ts").alias("at"), F.when(F.col("value") > 50, "live").otherwise("dormant").alias("state"))
    return ev.transitions(rows).select("id", "subject", "at", "previous", "state", "reactivated")


@registered("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 101 END AS rel, ([0, 25, 60, 80, 90, 100])[o_orderkey % 6 + 1] AS cor, CASE WHEN o_orderkey % 11 = 0 THEN 90 ELSE 70 END AS st,
  o_orderkey % 7 = 0 AS con, CASE WHEN o_orderkey % 17 = 0 THEN 'revoked' ELSE 'active' END AS status FROM orders),
m AS (SELECT *, (coalesce(rel * 3, 0) + cor * 3 + st) // (CASE WHEN rel IS NULL THEN 4 ELSE 7 END) AS mean FROM c)
SELECT id, greatest(mean - CASE WHEN con THEN 25 ELSE 0 END - CASE WHEN status = 'revoked' THEN 40 ELSE 0 END, 0)::BIGINT AS overall, 'derived' AS method FROM m""")
def confidence_assess(spark, d):
    i = F.col("id")
    rows = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    parts = {"source_reliability": F.when(i % 3 > 0, i % 101), "corroboration": ev.ladder(i % 6), "stance": F.when(i % 11 == 0, ev.STANCES["analyst"]).otherwise(ev.STANCES["reported"])}
    overall, method = ev.confidence(parts, i % 7 == 0, F.when(i % 17 == 0, "revoked").otherwise("active"))
    return rows.select("id", overall.alias("overall"), method.alias("method"))


@registered("WITH RECURSIVE m AS (SELECT p_partkey AS id, p_partkey // 3 AS into FROM part WHERE p_partkey >= 3), c(id, root, depth) AS (SELECT id, into, 1 FROM m UNION ALL SELECT c.id, m.into, c.depth + 1 FROM c JOIN m ON m.id = c.root) SELECT id, arg_max(root, depth) AS root FROM c GROUP BY id".replace("into", '"into"'))
def merge_roots(spark, d):
    merges = b.read(spark, d, "part").where("p_partkey >= 3").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 3").alias("into"))
    return g.merge_roots(merges)


@registered("""WITH c AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101)::BIGINT AS score, s_suppkey % 13 = 0 AS protected, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey // 10 END AS cluster_key FROM supplier),
z AS (SELECT *, count(*) FILTER (NOT protected) OVER (PARTITION BY cluster_key) AS n, row_number() OVER (PARTITION BY cluster_key, protected ORDER BY score DESC, id) AS k FROM c),
r AS (SELECT *, cluster_key IS NULL OR n < 2 OR protected OR k = 1 AS representative FROM z),
t AS (SELECT id FROM r WHERE representative AND NOT protected ORDER BY score DESC, id LIMIT 10)
SELECT id, score, protected, representative, protected OR id IN (SELECT id FROM t) AS included FROM r""")
def rank_plan(spark, d):
    i = F.col("s_suppkey")
    rows = b.read(spark, d, "supplier").select(i.alias("id"), (i * 37 % 101).alias("score"), (i % 13 == 0).alias("protected"), F.when(i % 2 == 0, F.expr("s_suppkey div 10")).alias("cluster_key"))
    return g.rank_plan(rows, 10).select("id", "score", "protected", "representative", "included")


_FOLDED = """WITH RECURSIVE i AS (SELECT source AS pack, doc_id AS id, lang AS section, (strlen(text) + 3) // 4 AS tokens, strlen(text)::BIGINT AS bytes, doc_id % 3 = 0 AS is_link,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT pack, 0 AS k, 0::BIGINT AS t, 0::BIGINT AS b, 0 AS o, 0 AS l, []::VARCHAR[] AS closed, []::BIGINT[] AS kept, []::BIGINT[] AS dropped FROM i WHERE k = 1
 UNION ALL SELECT f.pack, i.k, CASE WHEN take THEN t + tokens ELSE t END, CASE WHEN take THEN b + bytes ELSE b END, o + (take AND NOT is_link)::INT, l + (take AND is_link)::INT,
  CASE WHEN over AND NOT shut THEN list_append(closed, section) ELSE closed END, CASE WHEN take THEN list_append(kept, i.id) ELSE kept END, CASE WHEN take THEN dropped ELSE list_append(dropped, i.id) END
  FROM f JOIN i ON i.pack = f.pack AND i.k = f.k + 1, LATERAL (SELECT t + tokens > 9000 OR b + bytes > 30000 OR o + (NOT is_link)::INT > 20 OR l + is_link::INT > 8 AS over, list_contains(closed, section) AS shut) x, LATERAL (SELECT NOT x.over AND NOT x.shut AS take) y)"""


@registered(f"""{_FOLDED} SELECT pack, array_to_string(arg_max(kept, k), ',') AS kept, array_to_string(arg_max(dropped, k), ',') AS dropped, arg_max(t, k) AS tokens FROM f GROUP BY pack""")
def budget_fit(spark, d):
    fit = g.budget_fit(_packed(spark, d), "pack", 9000, 30000, 20, 8)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return fit.select("pack", joined("kept"), joined("dropped"), "tokens")


@registered(f"""{_FOLDED}, z AS (SELECT pack, arg_max(kept, k) AS kept FROM f GROUP BY pack)
SELECT i.pack, i.id, i.section, list_contains(z.kept, i.id)::INT::BIGINT AS kept, 1 - list_contains(z.kept, i.id)::INT::BIGINT AS dropped FROM i JOIN z ON i.pack IS NOT DISTINCT FROM z.pack""")
def budget_rows(spark, d):
    return g.budget_rows(_packed(spark, d), "pack", 9000, 30000, 20, 8).select("pack", "id", "section", "kept", "dropped")


def _packed(spark, d):
    text = F.coalesce("text", F.lit(""))
    return b.read(spark, d, "documents").select(
        F.col("source").alias("pack"), F.col("doc_id").alias("place"), F.col("doc_id").alias("id"), F.col("lang").alias("section"), g.token_estimate(text).alias("tokens"),
        F.octet_length(text).cast("long").alias("bytes"), (F.col("doc_id") % 3 == 0).alias("is_link"), F.lit(False).alias("required"))


@registered("SELECT doc_id, (strlen(coalesce(text, '')) + 3) // 4 AS tokens FROM documents")
def token_estimate(spark, d):
    return b.read(spark, d, "documents").select("doc_id", g.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


@registered(f"WITH {EDGES}, {BOTH}, h1 AS (SELECT DISTINCT other AS node FROM doubled WHERE node = 'r:1'), h2 AS (SELECT DISTINCT other AS node FROM doubled WHERE node IN (SELECT node FROM h1)), a AS (SELECT 'r:1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) SELECT node, min(depth) AS depth FROM a GROUP BY node")
def reach_depth(spark, d):
    return g.reachable(b.relationships(spark, d), spark.createDataFrame([("r:1",)], "node string"), 2)


def _traversal(start: str, depth: int, nodes: int, edges: int, fan_out: int, then: str = "") -> str:
    """A bounded search hop by hop: ranks, first places, what was spent before each, and the stop.  `then` reads the nodes
    of v and the edges of t."""
    steps = [f"v0 AS (SELECT '{start}' AS node, 0 AS depth)", "t0 AS (SELECT id FROM edges WHERE false)"]
    stops: list[str] = []
    for i in range(1, depth + 1):
        earlier = " AND ".join(f"NOT EXISTS (FROM s{j})" for j in range(1, i)) or "true"
        before = "OVER (ORDER BY node, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        steps += [
            f"k{i} AS (SELECT d.node, d.id, d.other, row_number() OVER (PARTITION BY d.node ORDER BY d.id) AS k FROM doubled d JOIN v{i - 1} f ON f.node = d.node AND f.depth = {i - 1} WHERE {earlier})",
            f"u{i} AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY node) = 1 AND id NOT IN (FROM t{i - 1}))::INT AS e, (row_number() OVER (PARTITION BY other ORDER BY node, id) = 1 AND other NOT IN (SELECT node FROM v{i - 1}))::INT AS n FROM k{i} WHERE k <= {fan_out})",
            f"p{i} AS (SELECT *, e = 1 AND (SELECT count(*) FROM t{i - 1}) + coalesce(sum(e) {before}, 0) >= {edges} AS x, n = 1 AND (SELECT count(*) FROM v{i - 1}) + coalesce(sum(n) {before}, 0) >= {nodes} AS y FROM u{i})",
            f"s{i} AS (SELECT node, id, CASE WHEN x THEN 'edges' ELSE 'nodes' END AS flag FROM p{i} WHERE x OR y ORDER BY node, id LIMIT 1)",
            f"a{i} AS (SELECT * FROM p{i} WHERE NOT EXISTS (SELECT 1 FROM s{i} s WHERE (p{i}.node, p{i}.id) >= (s.node, s.id)))",
            f"v{i} AS (FROM v{i - 1} UNION ALL SELECT other, {i} FROM a{i} WHERE n = 1)", f"t{i} AS (FROM t{i - 1} UNION ALL SELECT id FROM a{i} WHERE e = 1)",
        ]
        stops += [f"SELECT flag FROM s{i}", f"SELECT 'fan_out' FROM k{i} WHERE k > {fan_out} AND NOT EXISTS (SELECT 1 FROM s{i} s WHERE (k{i}.node, k{i}.id) > (s.node, s.id))"]
    if then:
        return f"WITH {EDGES}, {BOTH}, {ENTITIES}, {', '.join(steps)}, v AS (FROM v{depth}), t AS (FROM t{depth}) {then}"
    stops.append(f"SELECT 'depth' FROM v{depth} WHERE depth = {depth} AND NOT EXISTS (FROM s{depth})")
    return f"WITH {EDGES}, {BOTH}, {', '.join(steps)} SELECT node, depth, (SELECT coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), '') FROM ({' UNION ALL '.join(stops)}) f(flag)) AS truncated FROM v{depth}"


@registered(_traversal("r:1", 3, 200, 400, 20))
def traverse_bounded(spark, d):
    found = g.traverse(b.relationships(spark, d), "r:1", depth=3, nodes=200, edges=400, fan_out=20)
    return found.nodes.withColumn("truncated", F.lit(",".join(found.truncated)))


@registered(_traversal("n:3", 2, 5000, 300, 4000))
def traverse_edges_spent(spark, d):
    """The same where the edges run out within a hop."""
    found = g.traverse(b.relationships(spark, d), "n:3", depth=2, nodes=5000, edges=300, fan_out=4000)
    return found.nodes.withColumn("truncated", F.lit(",".join(found.truncated)))


def _capture(spark, d, until: str) -> DataFrame:
    o = b.read(spark, d, "orders").where(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz"))
    rows = o.groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return rows.select("key", F.sha2(F.concat_ws("|", F.col("n").cast("string"), "last"), 256).alias("digest"), F.when(F.col("last") == "F", "expired").otherwise("active").alias("status"))


_CAPTURE = "SELECT o_custkey AS key, count(*) AS n, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last FROM orders WHERE o_orderdate < TIMESTAMP '{}' GROUP BY 1"
_DELTA = f"""WITH b AS (SELECT key, n || '|' || last AS g, CASE WHEN last = 'F' THEN 'expired' ELSE 'active' END AS s FROM ({_CAPTURE.format('1996-01-01')})),
a AS (SELECT key, n || '|' || last AS g, CASE WHEN last = 'F' THEN 'expired' ELSE 'active' END AS s FROM ({_CAPTURE.format('1997-01-01')})),
d AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' WHEN a.s = 'expired' AND b.s <> 'expired' THEN 'expired' WHEN a.s = 'active' AND b.s <> 'active' THEN 'reactivated' WHEN a.g <> b.g THEN 'changed' END AS category FROM b FULL JOIN a USING (key))
"""


@registered(_DELTA + "SELECT key, category FROM d WHERE category IS NOT NULL")
def checkpoint_delta(spark, d):
    return g.compare(_capture(spark, d, "1996-01-01"), _capture(spark, d, "1997-01-01"))


@registered(_DELTA + """, k AS (SELECT *, row_number() OVER (ORDER BY key) AS k, count(category) OVER (ORDER BY key) AS c FROM d), z AS (SELECT coalesce(min(k) FILTER (c > 400), 700) AS last, min(k) FILTER (c > 400) IS NULL AS room FROM k WHERE k <= 700)
SELECT key, category, (SELECT count(*) FROM k WHERE k <= last) AS compared, (SELECT count(*) FROM k WHERE k <= last AND category IS NULL) AS unchanged, CASE WHEN NOT room THEN 'changes' WHEN (SELECT count(*) FROM k) > 700 THEN 'records' ELSE '' END AS truncated FROM k, z WHERE k <= last AND c <= 400 AND category IS NOT NULL""")
def delta_within_limits(spark, d):
    """The changes of checkpoint_delta as far as limits of 700 records and 400 changes go."""
    made = [cp.Capture(_capture(spark, d, until), "orders", 0, until) for until in ("1996-01-01", "1997-01-01")]
    found = cp.delta(*made, most_records=700, most_changes=400)
    return found.changes.select("key", "category", F.lit(found.compared).cast("long").alias("compared"), F.lit(found.unchanged).cast("long").alias("unchanged"), F.lit(",".join(found.truncated)).alias("truncated"))


@registered(_DELTA + "SELECT category, count(*) AS n FROM d WHERE category IS NOT NULL GROUP BY 1")
def delta_counts(spark, d):
    return checkpoint_delta(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@registered(f"WITH {ENTITIES} SELECT id, sha256(sha256(kind) || chr(30) || sha256(name) || chr(30) || sha256(status)) AS fingerprint FROM entities")
def fingerprint_entities(spark, d):
    return b.entities(spark, d).select("id", g.fingerprint(F.col("kind"), F.col("name"), F.col("status")).alias("fingerprint"))


_TLP = "([NULL, 'clear', 'green', 'amber', 'red'])[o_orderkey % 5 + 1]"


@registered(f"SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN {_TLP} = 'red' THEN 'tlp_above_ceiling' END, CASE WHEN o_orderkey % 3 = 0 THEN 'handling_not_cleared' END], lambda x: x IS NOT NULL), ',') AS denials FROM orders")
def policy_partition(spark, d):
    i = F.col("o_orderkey")
    tlp = F.get(F.array(F.lit(None).cast("string"), *(F.lit(x) for x in ("clear", "green", "amber", "red"))), (i % 5).cast("int"))
    why = st.decision(tlp, F.lit(None).cast("string"), F.when(i % 3 == 0, "legal_hold"), "amber", "amber", ["internal"])
    return b.read(spark, d, "orders").select(i.alias("id"), F.array_join(why, ",").alias("denials"))


@registered("WITH x AS (SELECT source, CASE WHEN toxic = 1 THEN 4 WHEN quality = 0 THEN 3 ELSE 1 END AS s FROM labels JOIN documents USING (doc_id)) SELECT source, ([ 'benign', 'allow_listed', 'suspicious', 'malicious'])[max(s)] AS disposition FROM x GROUP BY 1")
def strongest_disposition(spark, d):
    rows = b.dispositions(spark, d).join(b.read(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("status", F.lit("active"))
    return ev.strongest_disposition(rows, "source")


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: The same matches in linear time: one begins where a run of its characters does or where the match before ended.
_MAIL_ONCE = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_IP = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"


@registered(rf"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS raw FROM documents)
SELECT doc_id, 'email_address' AS kind, regexp_extract(raw, '^(.+)@', 1) || '@' || lower(regexp_extract(raw, '@([^@]*)$', 1)) AS value, count(*) AS hits FROM m
WHERE regexp_matches(lower(regexp_extract(raw, '@([^@]*)$', 1)), '{canon.DOMAIN}') GROUP BY ALL
UNION ALL SELECT doc_id, 'ipv4_address', raw, count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_IP}')) AS raw FROM documents) WHERE regexp_matches(raw, '{canon.IPV4}') GROUP BY ALL""")
def extract_observables(spark, d):
    docs = b.read(spark, d, "documents")

    def found(pattern: str, kind: str, form) -> DataFrame:
        rows = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("raw")).select("doc_id", F.lit(kind).alias("kind"), form(F.col("raw")).alias("value"))
        return rows.where("value is not null").groupBy("doc_id", "kind", "value").agg(F.count("*").alias("hits"))

    return found(_MAIL_ONCE, "email_address", canon.email).unionByName(found(_IP, "ipv4_address", canon.ipv4))


@registered(r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages")
def page_hosts(spark, d):
    pages = b.read(spark, d, "pages").select("page_id", canon.url(F.col("url")).alias("u"))
    return pages.select("page_id", F.regexp_extract("u", r"^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("u", r"^[a-z]+://([^/?#:]+)", 1).alias("host"))


@registered("SELECT event_id AS id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_props_claims(spark, d):
    return b.read(spark, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("value")).where("value is not null")


@registered("SELECT event_type, (user_id % 10)::BIGINT AS source, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS occurrences FROM events WHERE value < 20 GROUP BY ALL")
def quarantine_rollup(spark, d):
    rows = b.read(spark, d, "events").where("value < 20").select("event_type", (F.col("user_id") % 10).cast("long").alias("source"), F.col("ts").alias("at"), F.lit("too small").alias("reason"))
    return st.quarantine_rollup(rows, "event_type", "source").drop("reason")


@registered("WITH o AS (SELECT c_custkey AS id, c_mktsegment AS v FROM customer WHERE c_custkey % 3 > 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS v FROM customer) SELECT n.id, CASE WHEN o.id IS NULL THEN 'inserted' WHEN o.v <> n.v THEN 'updated' ELSE 'unchanged' END AS outcome FROM n LEFT JOIN o USING (id)")
def upsert_outcomes(spark, d):
    rows = b.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    return st.upsert_outcomes(rows.where("id % 3 > 0"), rows.withColumn("v", F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("v"))), "id")


@registered("SELECT sha256(text) AS content_hash, strlen(text)::BIGINT AS byte_length, count(*) AS copies, CASE WHEN strlen(text) > 20000 THEN 'refused' ELSE 'stored' END AS outcome FROM documents GROUP BY text")
def blob_dedup(spark, d):
    return st.blobs(b.read(spark, d, "documents").select(F.col("text").alias("content")), 20000)


@registered("""WITH w AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER x, ts) IS NULL OR epoch(ts)::BIGINT - 0 - epoch(lag(ts) OVER x)::BIGINT > 86400 THEN 1 ELSE 0 END AS fresh FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events) WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM w) SELECT 'u:' || user_id AS subject, session::BIGINT AS session, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS sightings FROM s GROUP BY user_id, session""")
def sighting_sessions(spark, d):
    return st.sessions(b.sightings(spark, d).withColumn("at", F.date_trunc("SECOND", "at").cast("timestamp_ntz")), 86400)


@registered(f"WITH {ENTITIES}, {EDGES} SELECT e.kind, count(*) AS n, (count(*) * 100) // (SELECT count(*) FROM entities) AS percent FROM entities e GROUP BY 1")
def quality_percent(spark, d):
    e = b.entities(spark, d)
    n = e.groupBy("kind").agg(F.count("*").alias("n"))
    return n.select("kind", "n", F.floor(F.col("n") * 100 / F.sum("n").over(Window.partitionBy())).cast("long").alias("percent"))


@registered(r"SELECT page_id, replace(replace(url, '.', '[.]'), 'http', 'hxxp') AS defanged, replace(url, 'hxxp', 'http') AS plain FROM pages")
def undefang(spark, d):
    bad = F.replace(F.replace(F.col("url"), F.lit("."), F.lit("[.]")), F.lit("http"), F.lit("hxxp"))
    return b.read(spark, d, "pages").select("page_id", bad.alias("defanged"), canon.undefang(bad).alias("plain"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import packs, records, writes  # noqa: F401  (they register their own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
