"""Registered queries over resolution, context packs, retention and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import bridge as b
from .. import query as q
from ..operators import evidence as ev
from ..operators import graph as g
from ..operators import pack as pk
from ..operators import resolution as rs
from ..operators import store as st
from .queries import _MET, CLAIMS, EDGES, ENTITIES, NOW, _alike, registered


def _text(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def _parts(spark, d) -> DataFrame:
    return b.read(spark, d, "part").select(_text("p:", F.col("p_partkey")).alias("id"), F.lit("tool").alias("kind"), F.col("p_type").alias("name"))


_CLASSES = "c AS (SELECT min('p:' || p_partkey) AS id, p_type AS name, count(*) AS n, regexp_replace(lower(p_type), '[^\\p{L}\\p{N}]+', '', 'g') AS normal, list_filter(list_distinct(string_split_regex(lower(p_type), '[^\\p{L}\\p{N}]+')), lambda t: strlen(t) >= 4) AS tokens FROM part WHERE p_type IS NOT NULL GROUP BY p_type)"


@registered(f"""WITH {_CLASSES} SELECT least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id, CASE WHEN a.normal = b.normal THEN 60 ELSE 25 END::BIGINT AS score, 'candidate' AS outcome, a.n * b.n AS pairs FROM c a JOIN c b ON a.name < b.name WHERE a.normal = b.normal OR list_has_any(a.tokens, b.tokens)
UNION ALL SELECT id, id, 60, 'candidate', n * (n - 1) // 2 FROM c WHERE n > 1""")
def resolve_outcomes(spark, d):
    links = rs.resolve_classes(_parts(spark, d)).links
    return links.select(F.least("left_class", "right_class").alias("left_id"), F.greatest("left_class", "right_class").alias("right_id"), "score", F.when(F.col("decisive"), "merged").otherwise("candidate").alias("outcome"), "pairs")


@registered("SELECT 'p:' || p_partkey AS id, min('p:' || p_partkey) OVER (PARTITION BY p_type) AS class FROM part WHERE p_type IS NOT NULL")
def resolve_members(spark, d):
    return rs.resolve_classes(_parts(spark, d)).members.select("id", "class")


def _standing(spark, d) -> rs.Standing:
    """Operations on neighbouring parts: pins, then merges, rejections and aliases, then withdrawals and splits."""
    k = F.col("p_partkey")
    op = lambda when, seq, kind, takes_back=False, actor="a": F.when(when, F.struct((k * 10 + seq).alias("seq"), F.lit(kind).alias("kind"), F.lit(takes_back).alias("withdraws"), F.lit(actor).alias("actor")))
    made = F.array_compact(F.array(op(k % 13 == 0, 0, "pin"), op(k % 26 == 0, 1, "pin", True), op(k % 5 == 0, 2, "merge"), op(k % 10 == 0, 3, "split"), op(k % 7 == 0, 4, "reject"), op(k % 14 == 0, 5, "reject", True), op(k % 11 == 0, 6, "alias"), op(k % 17 == 0, 7, "alias", False, " ")))
    rows = b.read(spark, d, "part").select(k, F.explode(made).alias("o")).select("o.seq", "o.kind", _text("p:", k).alias("left_id"), F.when(F.col("o.kind") != "pin", _text("p:", k + 1)).alias("right_id"), "o.withdraws", "o.actor", F.lit("test").alias("policy_context"))
    return rs.replay(rows, stop=False)


_OPERATIONS = """k AS (SELECT p_partkey AS k, least('p:' || p_partkey, 'p:' || (p_partkey + 1)) AS l, greatest('p:' || p_partkey, 'p:' || (p_partkey + 1)) AS r FROM part),
stands AS (SELECT *, k % 13 = 0 AND k % 26 > 0 AS is_pin FROM k),
merge_ops AS (SELECT k, l, r, is_pin AS stopped FROM stands WHERE k % 5 = 0),
absorbing AS (SELECT r, k * 10 + 2 AS seq, TRUE AS merges, l FROM merge_ops WHERE NOT stopped UNION ALL SELECT r, k * 10 + 3, FALSE, l FROM k WHERE k % 10 = 0)"""


@registered(f"""WITH {_OPERATIONS}
SELECT 'merge' AS what, r AS left_id, arg_max(l, seq) AS right_id FROM absorbing GROUP BY r HAVING arg_max(merges, seq) UNION ALL SELECT 'reject', l, r FROM k WHERE k % 7 = 0 AND k % 14 > 0
UNION ALL SELECT 'alias', arg_max(l, k), r FROM k WHERE k % 11 = 0 GROUP BY r UNION ALL SELECT 'pin', 'p:' || k, NULL FROM stands WHERE is_pin
UNION ALL SELECT 'pinned', (k * 10 + 2)::VARCHAR, NULL FROM merge_ops WHERE stopped UNION ALL SELECT 'no_actor', (k * 10 + 7)::VARCHAR, NULL FROM k WHERE k % 17 = 0""")
def identity_operations(spark, d):
    s, none = _standing(spark, d), F.lit(None).cast("string").alias("right_id")
    out = s.merges.select(F.lit("merge").alias("what"), F.col("id").alias("left_id"), F.col("into").alias("right_id"))
    for what, rows in (("reject", s.rejections), ("alias", s.aliases)):
        out = out.unionByName(rows.select(F.lit(what).alias("what"), "left_id", "right_id"))
    return out.unionByName(s.pins.select(F.lit("pin").alias("what"), F.col("id").alias("left_id"), none)).unionByName(s.refused.select(F.col("reason").alias("what"), F.col("seq").cast("string").alias("left_id"), none))


@registered(f"""WITH {_OPERATIONS}, e AS (SELECT 'p:' || p_partkey AS id, p_type AS name, p_name AS ext, p_partkey % 13 = 0 AND p_partkey % 26 > 0 AS pin FROM part), {_CLASSES},
q AS (SELECT l, r, k FROM k WHERE 'p:' || (k + 1) IN (SELECT id FROM e) UNION ALL SELECT 'p:' || p_partkey, 'p:' || p_partkey, NULL FROM part WHERE p_size = 1),
al AS (SELECT arg_max(l, k) AS l, r FROM k WHERE k % 11 = 0 GROUP BY r),
s AS (SELECT q.l AS left_id, q.r AS right_id, coalesce(k % 7 = 0 AND k % 14 > 0, FALSE) AS rejected, a.pin OR b.pin AS pin, greatest(CASE WHEN q.l = q.r THEN 100 ELSE 0 END, CASE WHEN a.ext = b.ext AND q.l < q.r THEN 95 ELSE 0 END,
  CASE WHEN EXISTS (SELECT 1 FROM al WHERE al.l = q.l AND al.r = q.r) THEN 90 ELSE 0 END, CASE WHEN q.l = q.r THEN 0 WHEN ca.normal = cb.normal THEN 60 WHEN list_has_any(ca.tokens, cb.tokens) THEN 25 ELSE 0 END) AS score
  FROM q JOIN e a ON a.id = q.l JOIN e b ON b.id = q.r LEFT JOIN c ca ON ca.name = a.name LEFT JOIN c cb ON cb.name = b.name)
SELECT left_id, right_id, CASE WHEN rejected THEN 0 ELSE score END::BIGINT AS score, CASE WHEN rejected THEN 'rejected' WHEN score = 0 THEN 'distinct' WHEN pin THEN 'pinned' WHEN score >= 90 THEN 'merged' ELSE 'candidate' END AS outcome FROM s""")
def resolve_judged(spark, d):
    p = b.read(spark, d, "part")
    found = rs.resolve_classes(_parts(spark, d), p.select(_text("p:", F.col("p_partkey")).alias("id"), F.lit("name").alias("namespace"), F.col("p_name").alias("value")))
    there = p.select((F.col("p_partkey") - 1).alias("p_partkey"))
    own = _text("p:", F.col("p_partkey"))
    pairs = p.join(there, "p_partkey").select(own.alias("left_id"), _text("p:", F.col("p_partkey") + 1).alias("right_id")).unionByName(p.where("p_size = 1").select(own.alias("left_id"), own.alias("right_id")))
    return rs.judge(pairs, found, _standing(spark, d))


@registered("""WITH m AS (SELECT p_partkey AS id, p_partkey - p_partkey % 6 AS root, p_brand FROM part)
SELECT root AS id, array_to_string(list_sort(list_distinct(list('tlp:' || CASE WHEN id % 4 = 0 THEN 'amber' ELSE 'green' END))), ',') AS markings, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS sources FROM m GROUP BY root""")
def merged_identity(spark, d):
    """All parts, merged in chains of six: each into the one before."""
    p = b.read(spark, d, "part")
    roots = g.merge_roots(p.where("p_partkey % 6 > 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - 1).alias("into")))
    own = p.select(F.col("p_partkey").alias("id"), F.array(F.when(F.col("p_partkey") % 4 == 0, "tlp:amber").otherwise("tlp:green")).alias("markings"), F.array("p_brand").alias("sources"))
    out = rs.merged_identities(roots, own)
    return out.select("id", F.array_join("markings", ",").alias("markings"), F.array_join("sources", ",").alias("sources"))


def _packs(spark, d, detail: str = "L2") -> DataFrame:
    i = F.col("o_orderkey")
    owner = _text("c:", F.col("o_custkey"))
    tlp = F.get(F.array(*(F.lit(x) for x in (None, "clear", "green", "amber", "red"))), (i % 5).cast("int"))
    verdict = F.when(F.col("o_orderstatus") == "F", "malicious").when(F.col("o_orderstatus") == "O", "benign").otherwise("suspicious")
    claims = b.read(spark, d, "orders").select(
        i.alias("id"), owner.alias("subject"), F.when(i % 2 == 0, "disposition").otherwise("attribute").alias("assertion"), F.when(i % 2 == 0, verdict).otherwise(F.col("o_orderpriority")).alias("value"),
        F.when(i % 17 == 0, "revoked").otherwise("active").alias("status"), st.markings(tlp).alias("markings"), F.when(i % 3 > 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("sources"))
    edges = b.relationships(spark, d).where("kind = 'targets'").select("id", F.col("source_ref").alias("subject"), "kind", F.col("target_ref").alias("other"), st.markings().alias("markings"))
    seen = b.read(spark, d, "events").select(_text("c:", F.col("user_id")).alias("subject"))
    subjects = b.read(spark, d, "customer").select(_text("c:", F.col("c_custkey")).alias("subject"))
    return pk.packs(subjects, claims, edges, seen, st.Identity("amber", "red"), detail, objects=12, links=20)


_PACKS = """c AS (SELECT o_orderkey AS id, 'c:' || o_custkey AS subject, o_orderkey % 2 = 0 AS disp, CASE o_orderstatus WHEN 'F' THEN 'malicious' WHEN 'O' THEN 'benign' ELSE 'suspicious' END AS v, o_orderkey % 17 = 0 AS gone, o_orderkey % 5 = 4 AS red,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
g AS (SELECT subject, count(*) FILTER (NOT red) AS n, count(*) FILTER (red) AS held, array_to_string(list_sort(list_distinct(list(source) FILTER (NOT red AND source IS NOT NULL))), ',') AS evidence, bool_or(NOT gone) FILTER (NOT red) AS standing,
  max(CASE v WHEN 'malicious' THEN 3 WHEN 'suspicious' THEN 2 ELSE 1 END) FILTER (NOT red AND disp AND NOT gone) AS top FROM c WHERE k <= 12 GROUP BY subject),
r AS (SELECT source_ref AS subject, least(count(*), 20) AS m FROM edges WHERE kind = 'targets' GROUP BY 1),
p AS (SELECT 'c:' || c_custkey AS subject, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(held, 0) AS held, coalesce(evidence, '') AS evidence, coalesce(standing, FALSE) AS standing, top, c_custkey IN (SELECT user_id FROM events) AS seen FROM customer LEFT JOIN g ON g.subject = 'c:' || c_custkey LEFT JOIN r ON r.subject = 'c:' || c_custkey)"""


@registered(f"""WITH {EDGES}, {_PACKS} SELECT subject, coalesce((['benign', 'suspicious', 'malicious'])[top], 'unknown') AS disposition, n AS claims, m AS relationships, evidence,
concat_ws(',', CASE WHEN n = 0 AND m = 0 THEN 'store' END, CASE WHEN NOT seen THEN 'sightings' END, CASE WHEN evidence = '' AND n > 0 THEN 'evidence' END, CASE WHEN n > 0 AND NOT standing THEN 'claims' END, CASE WHEN held > 0 THEN 'policy' END) AS gaps,
concat_ws(',', CASE WHEN held > 0 THEN 'claims:policy_restricted' END, CASE WHEN n >= 12 THEN 'claims:budget_exhausted' END, CASE WHEN m >= 20 THEN 'relationships:budget_exhausted' END) AS exclusions, held > 0 AS restricted, n >= 12 OR m >= 20 AS exhausted, '' AS problems FROM p""")
def context_packs(spark, d):
    p = _packs(spark, d)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return p.select("subject", "disposition", F.size("claims").cast("long").alias("claims"), F.size("relationships").cast("long").alias("relationships"), joined("evidence"), joined("gaps"), joined("exclusions"), "restricted", "exhausted", F.array_join(pk.problems(p), ",").alias("problems"))


@registered(f"""WITH {EDGES}, {_PACKS}, l AS (SELECT subject, 'claim' AS record, n FROM p UNION ALL SELECT subject, 'relationship', m FROM p UNION ALL SELECT subject, 'pack', 1 FROM p
UNION ALL SELECT subject, 'gap', (n = 0 AND m = 0)::INT + (NOT seen)::INT + (evidence = '' AND n > 0)::INT + (n > 0 AND NOT standing)::INT + (held > 0)::INT FROM p) SELECT subject, record, n::BIGINT AS n FROM l WHERE n > 0""")
def pack_lines(spark, d):
    lines = pk.as_json_lines(_packs(spark, d, "L3"))
    return lines.groupBy("subject", F.get_json_object("line", "$.record").alias("record")).agg(F.count("*").alias("n"))


@registered(f"""WITH {EDGES}, {_PACKS}, j AS (SELECT p.subject, coalesce(bool_or(o_orderkey % 5 = 3 AND k <= 12 AND NOT red), FALSE) AS amber, p.n, (['benign', 'suspicious', 'malicious'])[any_value(top)] AS disposition FROM p LEFT JOIN (SELECT *, id AS o_orderkey FROM c) x ON x.subject = p.subject GROUP BY p.subject, p.n)
SELECT subject, '# ' || subject AS title, 'Disposition: ' || coalesce(disposition, 'unknown') AS line FROM j WHERE NOT amber""")
def pack_pages(spark, d):
    cleared = pk.clear(_packs(spark, d, "L1"), st.Identity("green", "red", (), ("read", "redistribute")), interchange=True)[0]
    text = F.split(pk.as_markdown(cleared), "\n\n")
    return cleared.select("subject", F.get(text, 0).alias("title"), F.get(text, 1).alias("line"))


@registered("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 10 AS eb, greatest(o_orderkey % 10 - o_orderkey % 3, 0) AS ea, o_orderkey % 4 AS cb, greatest(o_orderkey % 4 - (o_orderkey % 5 = 0)::INT, 0) AS ca, o_orderkey % 7 > 0 AS reconciles FROM orders),
k AS (SELECT *, CASE WHEN eb = 0 THEN 100 ELSE ea * 100 // nullif(eb, 0) END::BIGINT AS evidence_kept, CASE WHEN cb = 0 THEN 100 ELSE ca * 100 // nullif(cb, 0) END::BIGINT AS contradictions_kept FROM r)
SELECT id, evidence_kept, contradictions_kept, reconciles, reconciles AND evidence_kept >= 60 AND contradictions_kept = 100 AS acceptable FROM k""")
def pack_quality(spark, d):
    i = F.col("o_orderkey")
    rows = b.read(spark, d, "orders").select(
        i.alias("id"), F.lit(10).alias("canonical"), F.lit(5).alias("included"), F.lit(3).alias("clustered"), F.when(i % 7 > 0, 2).otherwise(1).alias("dropped"), F.lit(100).alias("source_bytes"), F.lit(40).alias("output_bytes"),
        (i % 10).alias("evidence_before"), F.greatest(i % 10 - i % 3, F.lit(0)).alias("evidence_after"), (i % 4).alias("contradictions_before"), F.greatest(i % 4 - (i % 5 == 0).cast("int"), F.lit(0)).alias("contradictions_after"))
    return pk.quality(rows, 60).select("id", "evidence_kept", "contradictions_kept", "reconciles", "acceptable")


@registered("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'ipv4_address' WHEN 1 THEN 'domain_name' WHEN 2 THEN 'file_hash' WHEN 3 THEN 'email_address' WHEN 4 THEN 'file_hash' END AS kind,
CASE p_partkey % 6 WHEN 0 THEN '192.0.2.' || (p_partkey % 200) WHEN 1 THEN 'p' || p_partkey || '.example' WHEN 2 THEN 'md5:' || md5(p_partkey::VARCHAR) WHEN 3 THEN 'P@p' || p_partkey || '.example' WHEN 4 THEN 'sha256:' || sha256(p_partkey::VARCHAR) END AS value FROM part""")
def named_subjects(spark, d):
    k = F.col("p_partkey")
    s = k.cast("string")
    pick = lambda *options: F.get(F.array(*options), (k % 6).cast("int"))
    kind = pick(*(F.lit(x) for x in ("ip", "hostname", "file_hash", "email", "sha256", "mutex")))
    value = pick(F.concat(F.lit(" 192.0.2."), (k % 200).cast("string")), F.concat(F.lit("P"), s, F.lit(".EXAMPLE")), F.upper(F.md5(s)), F.concat(F.lit("P@P"), s, F.lit(".example")), F.concat(F.lit("sha256:"), F.sha2(s, 256)), s)
    return b.read(spark, d, "part").select(k.alias("id"), pk.subject(kind, value).alias("s")).select("id", "s.kind", "s.value")


@registered("""WITH h AS (SELECT DISTINCT p_partkey AS k, sha256('b' || p_partkey) AS content_hash FROM part)
SELECT 'kept' AS what, content_hash FROM h WHERE k % 3 > 0 OR k % 4 = 0 UNION ALL SELECT CASE WHEN k % 4 = 0 THEN 'refused' ELSE 'released' END, content_hash FROM h WHERE k % 3 = 0 UNION ALL SELECT 'absent', sha256('x' || k) FROM h WHERE k % 10 = 0""")
def blob_release(spark, d):
    k = F.col("p_partkey")
    held = b.read(spark, d, "part").select(k, F.sha2(_text("b", k), 256).alias("content_hash"), F.get(F.array(*(F.lit(x) for x in ("hold", "standard", "transient", "standard"))), (k % 4).cast("int")).alias("retention"))
    asked = held.where("p_partkey % 3 = 0").select("content_hash", F.lit("due").alias("reason")).unionByName(held.where("p_partkey % 10 = 0").select(F.sha2(_text("x", k), 256).alias("content_hash"), F.lit("due").alias("reason")))
    stays, audit = st.release(held.select("content_hash", "retention"), asked)
    return stays.select(F.lit("kept").alias("what"), "content_hash").unionByName(audit.select(F.col("outcome").alias("what"), "content_hash"))


@registered("SELECT doc_id, doc_id % 6 > 0 AND text IS NOT NULL AS intact FROM documents")
def blob_integrity(spark, d):
    rows = b.read(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.sha2(F.when(F.col("doc_id") % 6 > 0, F.col("text")).otherwise(F.concat("text", F.lit("x"))), 256).alias("content_hash"))
    return st.integrity(rows).select("doc_id", "intact")


@registered("SELECT count(*)::BIGINT AS entries, coalesce(sum(n), 0)::BIGINT AS occurrences FROM (SELECT event_type, user_id, count(*) AS n FROM events WHERE value < 20 GROUP BY ALL)")
def quarantine_totals(spark, d):
    rows = b.read(spark, d, "events").where("value < 20").select("event_type", "user_id", F.col("ts").alias("at"), F.lit("too small").alias("reason"))
    return st.quarantine_totals(st.quarantine_rollup(rows, "event_type", "user_id"))


@registered("""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey % 50 = l_suppkey % 50 AS a, l_partkey % 7 < 2 AS b, l_suppkey % 5 = 0 AS c, l_quantity * 3 > 100 AS d FROM lineitem)
SELECT id, line, concat_ws(',', CASE WHEN a THEN 'self_loop' END, CASE WHEN b THEN 'seen_order' END, CASE WHEN c THEN 'valid_order' END, CASE WHEN d THEN 'score_range' END) AS reasons FROM r WHERE a OR b OR c OR d""")
def record_validation(spark, d):
    later = lambda days: F.date_add(F.col("l_shipdate").cast("date"), days.cast("int"))
    rows = b.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 50).alias("source_ref"), (F.col("l_suppkey") % 50).alias("target_ref"), later(F.lit(0)).alias("first_seen"),
        later(F.col("l_partkey") % 7 - 2).alias("last_seen"), later(F.lit(1)).alias("valid_from"), later(F.col("l_suppkey") % 5).alias("valid_until"), (F.col("l_quantity") * 3).alias("score"))
    return rows.select("id", "line", F.array_join(st.invalid(rows), ",").alias("reasons")).where("reasons <> ''")


@registered("""WITH v AS (SELECT event_type AS label, 'u' || user_id AS value, min(ts) AS first, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY first, value) AS k FROM v) SELECT label, value, n FROM k WHERE k <= 64""")
def bounded_labels(spark, d):
    return st.bounded_labels(b.read(spark, d, "events").select(F.col("event_type").alias("label"), _text("u", F.col("user_id")).alias("value"), F.col("ts").alias("at")))


@registered("""SELECT event_type AS page, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) FILTER (event_id % 3 > 0) AS added_after FROM events GROUP BY 1""")
def newest_added(spark, d):
    at, i = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id")
    # Each third carries an offset, each fourth has only the time of its creation.
    at = F.concat(at, F.when(i % 3 > 0, "Z").otherwise("+09:00"))
    rows = b.read(spark, d, "events").select(F.col("event_type").alias("page"), F.when(i % 4 > 0, at).alias("modified"), at.alias("created"))
    return st.newest_added(rows, "page")


@registered(f"""WITH {CLAIMS}, {_alike(', id % 5')} SELECT l.class_id AS left_id, r.class_id AS right_id, CASE WHEN l.id % 5 <= 2 AND r.id % 5 <= 2 THEN l.value || ' / ' || r.value END AS evidence, count(*) AS pairs FROM {_MET} GROUP BY ALL""")
def contradiction_evidence(spark, d):
    """Of all subjects; a control character stands in each value, and claims of two levels of five are hidden."""
    claims = b.claims(spark, d).withColumn("value", F.concat("value", F.lit("\x07"))).withColumn("level", F.col("id") % 5)
    pairs = ev.related_classes(claims, ["order_status"], ["level"]).groupBy("left_id", "right_id", "left_value", "right_value", "left_level", "right_level").agg(F.sum("pairs").alias("pairs"))
    return ev.quoted(pairs, F.col("left_value"), F.col("right_value"), F.col("left_level"), F.col("right_level"), 2).select("left_id", "right_id", "evidence", "pairs")


@registered(f"""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 101 END AS conf, least(o_orderkey % 6 * 25, 100) AS cor, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END AS seen, o_orderkey % 17 = 0 AS gone FROM orders),
f AS (SELECT *, CASE WHEN seen IS NULL THEN 50 WHEN epoch(TIMESTAMP '{NOW}') - epoch(seen) <= 0 THEN 100 WHEN epoch(TIMESTAMP '{NOW}') - epoch(seen) >= 157680000 THEN 0 ELSE ((157680000 - (epoch(TIMESTAMP '{NOW}') - epoch(seen))::BIGINT) * 100) // 157680000 END AS fresh FROM c)
SELECT id, cor::BIGINT AS corroboration, fresh::BIGINT AS freshness, ((3 * coalesce(conf, 0) + 2 * cor + 2 * fresh + CASE WHEN gone THEN 25 ELSE 100 END + 100) // 14)::BIGINT AS score FROM f""")
def claim_candidates(spark, d):
    i = F.col("o_orderkey")
    parts = ev.candidate_factors(F.when(i % 4 > 0, i % 101), i % 6, F.when(i % 9 > 0, F.col("o_orderdate")), F.lit(NOW), 1825, F.when(i % 17 == 0, "revoked").otherwise("active"))
    return b.read(spark, d, "orders").select(i.alias("id"), parts["corroboration"].cast("long").alias("corroboration"), parts["freshness"].alias("freshness"), g.rank_score(parts).alias("score"))


@registered(f"WITH {ENTITIES}, p AS (SELECT id, kind FROM entities ORDER BY id LIMIT 100 OFFSET 200) SELECT id, kind, CASE WHEN (SELECT count(*) FROM p) >= 100 THEN 300 END::BIGINT AS next_offset FROM p")
def page_with_cursor(spark, d):
    return q.page_with_cursor(b.entities(spark, d).select("id", "kind"), 100, 200, F.col("id"))


@registered(f"""WITH {EDGES}, {_PACKS}, t AS (SELECT *, 'c' || subject[3:] || '.example' AS host FROM p)
SELECT subject, concat_ws(',', 'domain-name', CASE WHEN top IS NOT NULL THEN 'indicator,relationship' END, CASE WHEN n > 0 OR m = 0 OR NOT seen OR held > 0 OR m >= 20 THEN 'note' END) AS types,
CASE WHEN top IS NOT NULL THEN '[domain-name:value = ''' || host || ''']' END AS pattern, (['benign', 'anomalous-activity', 'malicious-activity'])[top] AS label, TRUE AS linked FROM t""")
def pack_bundles(spark, d):
    host = F.concat(F.lit("c"), F.substring("subject", 3, 20), F.lit(".example"))
    packs = _packs(spark, d)
    text = pk.as_stix(packs, F.lit("domain_name"), host, F.lit("2024-01-01T00:00:00Z"))
    item = "array<struct<type:string,id:string,pattern:string,indicator_types:array<string>,target_ref:string,object_refs:array<string>>>"
    rows = packs.select("subject", F.from_json(text, f"objects {item}")["objects"].alias("o"))
    said = F.get(F.filter("o", lambda x: x["type"] == "indicator"), 0)
    own = F.get("o", 0)["id"]
    linked = F.forall("o", lambda x: (F.coalesce(x["target_ref"], own) == own) & (F.coalesce(F.get(x["object_refs"], 0), own) == own))
    return rows.select("subject", F.array_join(F.transform("o", lambda x: x["type"]), ",").alias("types"), said["pattern"].alias("pattern"), F.get(said["indicator_types"], 0).alias("label"), linked.alias("linked"))
