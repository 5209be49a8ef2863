"""The driver's tables as canonical frames: entities, relationships, claims, sightings, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A task joins about so many lines with their orders.
TASK_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ref(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, status, last_seen."""
    seen = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_seen"))
    status = F.when(F.col("balance") < 0, "expired").otherwise("active")
    none = F.lit(None).cast("timestamp_ntz")
    cust = read(spark, sf_dir, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left").select(_ref("c", "c_custkey").alias("id"), F.lit("identity").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "last_seen")
    parts = [cust]
    for table, key, name, balance, prefix, kind in (("supplier", "s_suppkey", "s_name", "s_acctbal", "s", "infrastructure"), ("part", "p_partkey", "p_name", None, "p", "tool"), ("nation", "n_nationkey", "n_name", None, "n", "location"), ("region", "r_regionkey", "r_name", None, "r", "sector")):
        parts.append(read(spark, sf_dir, table).select(_ref(prefix, key).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"), (F.col(balance) if balance else F.lit(0.0)).alias("balance"), none.alias("last_seen")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "kind", "name", status.alias("status"), "last_seen")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, source_ref, target_ref; each edge once."""
    c, s, n = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    lines = read(spark, sf_dir, "lineitem")
    # Many lines are dealt to tasks by their number; that of a file of lines stands in its footer.
    tasks = lines.count() // TASK_ROWS
    dealt = lambda df, *key: df.repartition(tasks, *key) if tasks > 8 else df
    hosts = dealt(lines.select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct()
    ordered = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    targets = dealt(lines.select("l_orderkey", "l_partkey"), "l_orderkey").join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
    targets = dealt(targets.select("o_custkey", "l_partkey"), "o_custkey", "l_partkey").distinct()
    parts = [
        c.select(F.lit("located_at").alias("kind"), _ref("c", "c_custkey").alias("source_ref"), _ref("n", "c_nationkey").alias("target_ref")),
        s.select(F.lit("located_at").alias("kind"), _ref("s", "s_suppkey").alias("source_ref"), _ref("n", "s_nationkey").alias("target_ref")),
        n.select(F.lit("part_of").alias("kind"), _ref("n", "n_nationkey").alias("source_ref"), _ref("r", "n_regionkey").alias("target_ref")),
        hosts.select(F.lit("hosts").alias("kind"), _ref("s", "l_suppkey").alias("source_ref"), _ref("p", "l_partkey").alias("target_ref")),
        targets.select(F.lit("targets").alias("kind"), _ref("c", "o_custkey").alias("source_ref"), _ref("p", "l_partkey").alias("target_ref")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.concat_ws("|", "kind", "source_ref", "target_ref").alias("id"), "kind", "source_ref", "target_ref")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, subject, slot, value, publisher, asserted_at, status, stance: order statuses as attribute claims."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 17 == 0, "revoked").when(F.col("o_orderkey") % 19 == 0, "superseded").otherwise("active")
    stance = F.when(F.col("o_orderkey") % 11 == 0, "analyst").otherwise("reported")
    return o.select(F.col("o_orderkey").alias("id"), _ref("c", "o_custkey").alias("subject"), F.lit("attribute:order_status").alias("slot"), F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("publisher"), F.col("o_orderdate").alias("asserted_at"), status.alias("status"), stance.alias("stance"))


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, disposition, from labels."""
    label = F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 0, "suspicious").otherwise("benign")
    return read(spark, sf_dir, "labels").select("doc_id", label.alias("disposition"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arrival, record_id, publisher, content_hash, record_hash, from documents."""
    first = F.substring_index("text", "\n", 1)
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("arrival"), F.md5(F.lower(F.trim(first))).alias("record_id"), F.col("source").alias("publisher"), F.md5("text").alias("content_hash"), F.md5(F.lower(F.trim("text"))).alias("record_hash"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, subject, observer, at, from events."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), _ref("u", "user_id").alias("subject"), F.col("event_type").alias("observer"), F.col("ts").alias("at"))
