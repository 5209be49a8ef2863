"""Deduplication of a stream of observations, with what it has seen in a store of its own.

The state is the observations that came first: of a record, of a record's bytes, of a record's publisher.  It lies
in a bucketed table, of which a batch reads the buckets that its keys fall into and to which it adds its own
firsts.  A record with very many observations is thus spread over buckets and tasks by bytes and publisher; no task
holds all that is known of it.  Verdicts, state and the batch's number are one commit, so a batch that is run again
after a failure, or a stream that is begun again, doubles and loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evidence import dedup_verdicts
from ..operators.snapshot import Snapshots
from ..shared import written

FIRST = ["record_id", "what", "of"]
SEEN = ["record_id", "content_hash", "publisher", "record_hash", "arrival"]
KEYS = {"firsts": FIRST, "verdicts": ["batch", *SEEN, "verdict"]}


def _firsts(rows: DataFrame) -> DataFrame:
    """Each observation under the three things that it may be the first of."""
    kinds = F.array(*(F.struct(F.lit(w).alias("what"), c.alias("of")) for w, c in (("record", F.lit("")), ("bytes", F.col("content_hash")), ("publisher", F.col("publisher")))))
    return rows.select(*SEEN, F.explode(kinds).alias("k")).select("*", "k.what", "k.of").drop("k")


def deduplicator(store: Callable[[], Snapshots]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over observations (record_id, content_hash, publisher, record_hash, arrival): gives each a
    verdict as `dedup_verdicts` does.  What came in an earlier batch is earlier, whatever its arrival; within a batch
    arrival counts.  Rows that repeat in every column have one verdict and are counted; an empty batch leaves its number."""

    def add(batch: DataFrame, number: int) -> None:
        s = store()
        done = s.get("dedup_batches", "id", "last")
        if done is not None and done["number"] >= number:
            return
        order = F.struct(F.lit(number).cast("long").alias("batch"), F.col("arrival").cast("long").alias("at"))
        rows = written(batch.select(*SEEN[:-1], order.alias("arrival")), "observed")
        asked = written(_firsts(rows), "asked")
        known = s.beside("firsts", asked)
        known = None if known is None else written(known, "known")
        verdicts = dedup_verdicts(rows, None if known is None else known.select(*SEEN).distinct())
        counted = verdicts.select(F.lit(number).cast("long").alias("batch"), *SEEN[:-1], F.col("arrival.at").alias("arrival"), "verdict").groupBy("batch", *SEEN, "verdict").agg(F.count("*").alias("copies"))
        rest = [c for c in SEEN if c != "record_id"]
        new = asked.groupBy(*FIRST).agg(F.min_by(F.struct(*rest), "arrival").alias("x")).select(*FIRST, "x.*")
        if known is not None:
            held = known.select(*[F.col(c).alias(f"_{c}") for c in FIRST])
            new = new.join(held, F.col("record_id").eqNullSafe(F.col("_record_id")) & F.col("what").eqNullSafe(F.col("_what")) & F.col("of").eqNullSafe(F.col("_of")), "left_anti")
        marker = batch.sparkSession.createDataFrame([("last", number)], "id string, number long")
        s.upsert({"firsts": new, "verdicts": counted, "dedup_batches": marker}, versioned=False, keys=KEYS)

    return add


def verdicts(store: Snapshots) -> DataFrame | None:
    """The observations that came, each with its verdict."""
    rows = store.table("verdicts")
    return None if rows is None else rows.select(*SEEN, "verdict", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_n")).drop("_n")
