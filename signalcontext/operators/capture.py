"""Captures of a bounded traversal at one version of a store, and what changed between two of them.

A capture reads the commit that its store has open, so all of it is of one version; if another writer has made the
graph move by its end, it is refused.  A record's fingerprint is that of the facets by which a change is material.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .graph import PlanRefused, categorised, confidence_band, fingerprint, planned, shape, traverse
from .snapshot import Snapshots
from .store import permitted

#: Grows when the facets or their forms change: captures of different rules are not compared.
RULES = 1
#: So many records are compared, so many changes told.
MOST_RECORDS, MOST_CHANGES = 50_000, 10_000


class Moved(RuntimeError):
    """The graph changed while it was captured."""

    def __init__(self, began: int, ended: int):
        super().__init__(f"the graph went from version {began} to {ended} during the capture")
        self.began, self.ended = began, ended


@dataclass
class Capture:
    """records: key (class:id), digest, status.  truncated: the budgets that fired.  withheld: entities and edges above the ceiling."""

    records: DataFrame
    shape: str
    version: int
    at: str
    truncated: list[str] = field(default_factory=list)
    withheld: int = 0
    rules: int = RULES


@dataclass
class Delta:
    """changes: key, category, by key.  compared and unchanged: keys up to the stop.  truncated: 'records' or 'changes',
    the limit that stopped it.  inherited: budgets that had cut the captures."""

    changes: DataFrame
    compared: int
    unchanged: int
    truncated: list[str]
    inherited: list[str]


def _listed(*columns: Column) -> Column:
    """The different texts of columns (texts or arrays of texts), in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array(*columns))))), "\x1f")


def material(rows: DataFrame, kind: str = "kind") -> Column:
    """The fingerprint of records by eight facets: kind, endpoints, names, status, validity, confidence band, markings
    and sources.  Columns that the frame lacks, and null ones, are empty facets; other columns do not count."""
    has = set(rows.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has else F.lit("")
    none = F.array().cast("array<string>")
    texts = lambda c: F.coalesce(F.col(c).cast("array<string>"), none) if c in has else none
    pair = lambda a, b: F.concat_ws("\x1f", text(a), text(b)) if {a, b} & has else F.lit("")
    marks = none
    if "markings" in has:
        marks = F.coalesce(F.transform("markings", lambda m: F.concat_ws(":", m["kind"], m["value"])), none)
    names = _listed(F.array(F.col("name").cast("string")) if "name" in has else none, texts("aliases"))
    band = confidence_band(F.col("confidence")) if "confidence" in has else F.lit("unstated")
    return fingerprint(text(kind), pair("source_ref", "target_ref"), names, text("status"), pair("valid_from", "valid_until"), band, _listed(marks), _listed(texts("sources")))


def _records(prefix: str, rows: DataFrame) -> DataFrame:
    status = F.coalesce(F.col("status"), F.lit("active")) if "status" in rows.columns else F.lit("active")
    return rows.select(F.concat(F.lit(prefix), F.col("id")).alias("key"), material(rows).alias("digest"), status.alias("status"))


def capture(store: Snapshots, start: str, at: str, most_tlp: str | None = None, depth: int = 3, nodes: int = 500, edges: int = 2000, fan_out: int = 200) -> Capture:
    """The entities, observables and edges within a bounded traversal from `start`, of the commit that `store` has open.

    Tables `entities` and `relationships` are keyed by id.  Records are looked up in the buckets of what was reached,
    which the budgets bound.  A node without a record is left out; an observable has no record and is always the same.
    A start that is not known or not permitted, and an empty budget, raise PlanRefused; a graph that moved raises Moved."""
    entities, relationships = store.table("entities"), store.table("relationships")
    if entities is None or relationships is None:
        raise PlanRefused("the store has no entities or no relationships")
    planned(relationships, entities, start, most_tlp, depth, nodes, edges, fan_out)
    judged = lambda df: permitted(F.col("markings"), most_tlp) if most_tlp and "markings" in df.columns else F.lit(True)
    found = traverse(relationships, start, depth, nodes, edges, fan_out, judged(relationships), stored=True)
    seen = F.col("node").startswith("observable:")
    known = store.beside("entities", found.nodes.where(~seen).select(F.col("node").alias("id"))).withColumn("_ok", judged(entities))
    observables = found.nodes.where(seen).select(F.col("node").alias("key"), fingerprint(F.lit("observable")).alias("digest"), F.lit("active").alias("status"))
    taken = store.beside("relationships", found.edges.select("id"))
    records = _records("entity:", known.where("_ok").drop("_ok")).unionByName(observables).unionByName(_records("relationship:", taken))
    records = written(records, "capture")
    withheld = known.where(~F.col("_ok")).count()
    newest = store.newest_version()
    if newest != store.graph_version:
        raise Moved(store.graph_version, newest)
    asked = shape(start=start, most_tlp=most_tlp, depth=depth, nodes=nodes, edges=edges, fan_out=fan_out)
    return Capture(records, asked, store.graph_version, at, found.truncated, withheld)


def delta(before: Capture, after: Capture, successors: DataFrame | None = None, most_records: int = MOST_RECORDS, most_changes: int = MOST_CHANGES) -> Delta:
    """The changes from one capture to the other in the order of their keys, up to the limit that is met first.

    The first keys within `most_records` are taken by every task of its own and then of all; what is numbered in one
    window is no longer than that limit.  The key at which a change finds no more room is the last that is compared."""
    for name, limit in (("records", most_records), ("changes", most_changes)):
        if limit <= 0:
            raise PlanRefused(f"the budget of {name} is empty")
    if before.rules != after.rules:
        raise PlanRefused("the captures were made under different rules")
    if before.shape != after.shape:
        raise PlanRefused("the captures did not ask the same question")
    rows = categorised(before.records, after.records, successors).orderBy("key").limit(most_records + 1)
    upto = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = written(rows.select("key", "category", F.count("*").over(upto).alias("k"), F.count("category").over(upto).alias("c")), "delta")
    told = rows.agg(F.count("*").alias("n"), F.min(F.when((F.col("c") > most_changes) & (F.col("k") <= most_records), F.col("k"))).alias("full")).first()
    last = min(told.n, most_records) if told.full is None else told.full
    kept = rows.where((F.col("k") <= last) & (F.col("c") <= most_changes) & F.col("category").isNotNull())
    flags = ["changes"] if told.full is not None else ["records"] if told.n > most_records else []
    same = rows.where((F.col("k") <= last) & F.col("category").isNull()).count()
    return Delta(kept.select("key", "category"), last, same, flags, sorted({*before.truncated, *after.truncated}))


def save(store: Snapshots, name: str, made: Capture) -> None:
    """Keeps a capture of the store's open version under a name."""
    if made.version != store.graph_version:
        raise Moved(made.version, store.graph_version)
    store.put_checkpoint(name, made.records, made.shape, made.at)
