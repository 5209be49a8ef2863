"""The ledger over files that arrive one after another, against the batch form."""

import random

from signalcontext.operators import evidence as ev
from signalcontext.operators.snapshot import Snapshots
from signalcontext.streaming import ledger

SCHEMA = "subject string, id long, at timestamp, state string"


def test_transitions_as_a_stream(spark, tmp_path):
    rows = [("a", 1, "2024-01-01", "live"), ("a", 2, "2024-01-03", "dormant"), ("b", 3, "2024-01-01", "live"), ("a", 4, "2024-01-05", "live"), ("b", 5, "2024-01-02", "live"), ("b", 6, "2024-01-04", "expired"), (None, 7, "2024-01-01", "live")]
    frame = spark.createDataFrame(rows, "subject string, id long, at string, state string").withColumn("at", F_at())
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        q = ledger.transitions(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        q.awaitTermination()

    for part in ("id <= 3", "id > 3"):
        frame.where(part).coalesce(1).write.mode("append").parquet(src)
        run()
    key = lambda df: sorted((r.subject, r.id, r.previous, r.state, r.reactivated) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(ev.transitions(frame.where("subject is not null"))) != []


def F_at():
    from pyspark.sql import functions as F

    return F.to_timestamp("at")


def test_quarantine_counters_once_a_batch(spark, tmp_path):
    add = ledger.quarantine_counters(lambda: Snapshots(spark, str(tmp_path / "s")))
    batch = spark.createDataFrame([("d", 0, "bad", "2024-01-01"), ("d", 0, "bad", "2024-01-02"), ("e", 1, "odd", "2024-01-01")], "doc string, pos long, reason string, at string")
    for number in (0, 0, 1):
        add(batch, number)
    got = sorted((r.doc, r.occurrences, r.first_seen_at, r.last_seen_at) for r in Snapshots(spark, str(tmp_path / "s")).table("quarantine").collect())
    assert got == [("d", 4, "2024-01-01", "2024-01-02"), ("e", 2, "2024-01-01", "2024-01-01")]


def test_dedup_in_any_batching_and_after_a_restart(spark, tmp_path):
    """Observations in the order of arrival, cut into batches in two ways; each batch is run twice, as after a failure."""
    from signalcontext.streaming import dedup

    schema = "record_id string, content_hash string, publisher string, record_hash string, arrival long"
    r = random.Random(3)
    rows = [(*(r.choice([None, *(f"{c}{j}" for j in range(n))]) for c, n in (("r", 3), ("c", 8), ("p", 3), ("h", 2))), i) for i in range(60)]
    frame = spark.createDataFrame([*rows, rows[20]], schema)
    want = sorted(map(str, ev.dedup_verdicts(frame).select(*dedup.SEEN, "verdict").collect()))
    assert len({r.rsplit("verdict=")[-1] for r in want}) == 5
    for k, cuts in enumerate(([0, 61], [0, 1, 30, 30, 61])):
        root = str(tmp_path / str(k))
        for n, (a, z) in enumerate(zip(cuts, cuts[1:])):
            for _ in range(2):
                dedup.deduplicator(lambda: Snapshots(spark, root))(frame.where(f"arrival >= {a} and arrival < {z}"), n)
        assert sorted(map(str, dedup.verdicts(Snapshots(spark, root)).select(*dedup.SEEN, "verdict").collect())) == want


def test_dedup_as_a_stream(spark, tmp_path):
    from signalcontext.streaming import dedup

    schema = "record_id string, content_hash string, publisher string, record_hash string, arrival long"
    frame = spark.createDataFrame([("r", f"c{i % 3}", f"p{i % 2}", f"h{i % 3}", i) for i in range(8)], schema)
    src, root = str(tmp_path / "in"), str(tmp_path / "s")
    for part in ("arrival < 5", "arrival >= 5"):
        frame.where(part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src).writeStream.foreachBatch(dedup.deduplicator(lambda: Snapshots(spark, root)))
        stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(str, dedup.verdicts(Snapshots(spark, root)).select(*dedup.SEEN, "verdict").collect()))
    assert got == sorted(map(str, ev.dedup_verdicts(frame).select(*dedup.SEEN, "verdict").collect()))
