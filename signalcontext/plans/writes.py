"""Registered queries that write in a store of their own and read back what stands there, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import bridge as b
from ..operators import capture as cp
from ..operators.snapshot import Snapshots
from ..operators.store import markings
from ..shared import folder
from ..streaming import dedup
from .queries import OBSERVED, _traversal, registered


def _store(spark, **how) -> Snapshots:
    return Snapshots(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}", **how)


@registered("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 = 0 THEN 'again' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderstatus END AS status, o_totalprice AS price
FROM orders WHERE o_orderkey % 4 > 0 OR o_orderkey % 7 = 0""")
def store_read_back(spark, d):
    """Three writes and a deletion over all orders, read as they stand after them."""
    s = _store(spark)
    rows = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    s.upsert({"orders": rows})
    s.delete("orders", rows.where("id % 4 = 0"))
    s.upsert({"orders": rows.where("id % 7 = 0").withColumn("status", F.lit("changed"))})
    s.upsert({"orders": rows.where("id % 35 = 0").withColumn("status", F.lit("again"))})
    return s.table("orders")


@registered(f"WITH {OBSERVED} SELECT arrival, record_id, publisher, verdict FROM verdicts")
def dedup_streamed(spark, d):
    """The verdicts of all documents when they come in three batches."""
    s, rows = _store(spark), b.observations(spark, d)
    low, high = rows.agg(F.min("arrival"), F.max("arrival")).first()
    third = ((high or 0) - (low or 0)) // 3 + 1
    add = dedup.deduplicator(lambda: s)
    for n in range(3):
        add(rows.where(F.floor((F.coalesce("arrival", F.lit(low or 0)) - (low or 0)) / third) == n), n)
    return dedup.verdicts(s).select("arrival", "record_id", "publisher", "verdict")


_FACETS = "sha256(array_to_string([sha256(x) FOR x IN [{}]], chr(30)))"
_BAND = "CASE length(name) * 7 % 101 // 20 WHEN 0 THEN '0-19' WHEN 1 THEN '20-39' WHEN 2 THEN '40-59' WHEN 3 THEN '60-79' ELSE '80+' END"


@registered(_traversal("r:1", 2, 300, 900, 150, f"""SELECT 'entity:' || id AS key, {_FACETS.format(f"kind, '', name, status, '', {_BAND}, 'tlp:' || CASE WHEN length(name) % 3 = 0 THEN 'green' ELSE 'clear' END, ''")} AS digest, status FROM entities WHERE id IN (SELECT node FROM v)
UNION ALL SELECT 'relationship:' || id, {_FACETS.format("kind, source_ref || chr(31) || target_ref, '', '', '', 'unstated', '', ''")}, 'active' FROM edges WHERE id IN (FROM t)"""))
def capture_at_version(spark, d):
    """All entities and edges are stored; what a bounded traversal reaches is captured at that version and read back."""
    s = _store(spark)
    tlp = F.when(F.length("name") % 3 == 0, "green").otherwise("clear")
    entities = b.entities(spark, d).withColumn("confidence", F.length("name") * 7 % 101).withColumn("markings", markings(tlp))
    s.upsert({"entities": entities, "relationships": b.relationships(spark, d)})
    made = cp.capture(s, "r:1", "2024-01-01", most_tlp="green", depth=2, nodes=300, edges=900, fan_out=150)
    cp.save(s, "first", made)
    return s.checkpoint("first")[1]
