"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_snapshots, conversation_repair, decontamination, jaccard_join, language_id, license_rules, masked_lm, packing, quality_trees, robust_outliers, spelling_variants, token_counts, toxic_gru
from .common import fold, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.recognised(table(spark, sf_dir, "documents"))


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked_lm.scored(docs, masked_lm.learn(docs))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op5_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.rendered(table(spark, sf_dir, "conversations"))


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_trees.scored(docs, quality_trees.learn(docs, table(spark, sf_dir, "labels")))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.verdicts(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(language_id.training_rows(docs))
    out = language_id.identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, spans=True)
    return out.select("doc_id", (fold("doc_id", language_id.FOLDS) == language_id.HELD_OUT).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"), F.size("_lang_spans").cast("long").alias("n_spans"))


def op11_toxic_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_gru.scored(docs, toxic_gru.learn(docs, table(spark, sf_dir, "labels")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_license_rules, op3_masked_lm, op4_token_counts, op5_chat_snapshots, op6_quality_trees, op7_robust_outliers, op8_packing, op9_jaccard_join, op10_language_id, op11_toxic_gru, op12_spelling_variants, op13_conversation_repair)}


#: Shingle sets, all links by brute force, and the smallest id reachable.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * i >= 75 * (len(a.sh) + len(b.sh) - i)),
g AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT g.y, r.root FROM r JOIN g ON g.x = r.node WHERE r.root < g.y)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, min(r.root)) AS component_id FROM s LEFT JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, s.sh
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_rules": license_rules.oracle(), "op5_chat_snapshots": chat_snapshots.ORACLE, "op9_jaccard_join": OP9_SQL, "op12_spelling_variants": spelling_variants.ORACLE, "op13_conversation_repair": conversation_repair.oracle()}
