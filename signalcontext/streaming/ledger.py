"""Structured Streaming forms: the decay ledger as keyed state, and quarantine counters by batch.

The ledger keeps one small row a subject - its last instant, id and state - so a restart from the query's checkpoint
goes on where it ended.  Rows that lie before a subject's last row are late: the ledger has gone on and they are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.snapshot import Snapshots
from ..plans.ingest import QUARANTINE, quarantined

OUT = "subject string, id long, at timestamp, previous string, state string, reactivated boolean"


def _changes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else (None, None, None)
    out = []
    rows = pd.concat(list(parts)).sort_values(["at", "id"])
    for r in rows.itertuples(index=False):
        if last[0] is not None and (r.at, r.id) <= (last[0], last[1]):
            continue
        if last[2] is not None and last[2] != r.state:
            out.append((key[0], r.id, r.at, last[2], r.state, last[2] != "live" and r.state == "live"))
        last = (r.at, r.id, r.state)
    state.update(last)
    yield pd.DataFrame(out, columns=["subject", "id", "at", "previous", "state", "reactivated"])


def transitions(states: DataFrame) -> DataFrame:
    """The rows of a stream of states (subject, id, at, state) at which a subject's state changes; append mode."""
    rows = states.select(F.col("subject").cast("string").alias("subject"), F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at"), F.col("state").cast("string").alias("state"))
    rows = rows.where("subject is not null and at is not null and id is not null and state is not null")
    return rows.groupBy("subject").applyInPandasWithState(_changes, OUT, "at timestamp, id long, state string", "append", GroupStateTimeout.NoTimeout)


def quarantine_counters(store: Callable[[], Snapshots]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over rejects (doc, pos, reason, at): adds each batch to the stored counters once, also when the
    batch is run again after a failure."""

    def add(batch: DataFrame, number: int) -> None:
        s = store()
        done = s.get("quarantine_batches", "id", "last")
        if done is not None and done["number"] >= number:
            return
        rejects = batch.select("doc", "pos", "reason", F.col("at").cast("string").alias("at"))
        marker = batch.sparkSession.createDataFrame([("last", number)], "id string, number long")
        # Counters and marker are one commit.
        s.upsert({"quarantine": rejects, "quarantine_batches": marker}, versioned=False, keys=QUARANTINE, fold={"quarantine": quarantined})

    return add
