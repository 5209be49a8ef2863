"""The search language: ``kind = threat_actor and status = active``, compiled to a Column.

``and`` unites the values of one field; ``or`` and ``!=`` are read and refused; nothing else is known.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("kind", "status")
MOST_BYTES, MOST_TOKENS, MOST_DEPTH, MOST_PAGE = 4096, 256, 8, 1000
_TOKEN = re.compile(r'\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<op>!=|=|\(|\))|(?P<word>[A-Za-z0-9_.:-]+))')


class QueryError(ValueError):
    """The query cannot be read or is refused."""


def tokens(query: str) -> list[tuple[str, str]]:
    if len(query.encode()) > MOST_BYTES:
        raise QueryError("the query is too long")
    out, at = [], 0
    while query[at:].strip():
        m = _TOKEN.match(query, at)
        if not m:
            raise QueryError(f"unexpected character {query[at:].strip()[0]!r}")
        at = m.end()
        kind = m.lastgroup or ""
        value = m.group(kind)
        out.append((kind, re.sub(r"\\(.)", r"\1", value[1:-1]) if kind == "text" else value))
    if len(out) > MOST_TOKENS:
        raise QueryError("the query has too many tokens")
    return out


class _Reader:
    def __init__(self, query: str):
        self.left = tokens(query)

    def _word(self, *words: str) -> bool:
        if self.left and self.left[0][0] == "word" and self.left[0][1].lower() in words:
            self.left.pop(0)
            return True
        return False

    def either(self, depth: int = 0) -> dict[str, set[str]]:
        if depth > MOST_DEPTH:
            raise QueryError("the query is nested too deeply")
        found = self.both(depth)
        if self._word("or"):
            self.both(depth)
            raise QueryError("'or' is not supported")
        return found

    def both(self, depth: int) -> dict[str, set[str]]:
        found = self.one(depth)
        while self._word("and"):
            for field, values in self.one(depth).items():
                found.setdefault(field, set()).update(values)
        return found

    def one(self, depth: int) -> dict[str, set[str]]:
        if self.left and self.left[0] == ("op", "("):
            self.left.pop(0)
            found = self.either(depth + 1)
            if not self.left or self.left.pop(0) != ("op", ")"):
                raise QueryError("a bracket is not closed")
            return found
        if len(self.left) < 3:
            raise QueryError("a comparison is not complete")
        (_, field), (_, op), (kind, value) = self.left[:3]
        del self.left[:3]
        if field not in FIELDS or kind == "op":
            raise QueryError(f"unknown field {field!r}" if field not in FIELDS else "a value is missing")
        if op != "=":
            raise QueryError(f"{op!r} is not supported")
        return {field: {value}}


def values(query: str) -> dict[str, set[str]]:
    reader = _Reader(query)
    found = reader.either()
    if reader.left:
        raise QueryError("the query goes on after its end")
    return found


def compile(query: str) -> Column:
    """A predicate over kind and status."""
    out = F.lit(True)
    for field, wanted in sorted(values(query).items()):
        out = out & F.col(field).isin(*sorted(wanted))
    return out


def entity_filter(kinds: list[str] = (), statuses: list[str] = (), seen_from=None, seen_before=None) -> Column:
    """Empty sets do not constrain; times compare by UTC day; a missing last_seen never matches a bound."""
    out = F.lit(True)
    if kinds:
        out = out & F.col("kind").isin(*kinds)
    if statuses:
        out = out & F.col("status").isin(*statuses)
    if seen_from is not None:
        out = out & (F.date_trunc("DAY", "last_seen") >= F.date_trunc("DAY", F.lit(seen_from)))
    if seen_before is not None:
        out = out & (F.date_trunc("DAY", "last_seen") < F.date_trunc("DAY", F.lit(seen_before)))
    return F.coalesce(out, F.lit(False))


def page(df: DataFrame, limit: int, offset: int, *order) -> DataFrame:
    """limit is clamped to 1..1000; the order must end in an identifier."""
    return df.orderBy(*order).offset(offset).limit(min(max(limit, 1), MOST_PAGE))


def page_with_cursor(df: DataFrame, limit: int, offset: int, *order) -> DataFrame:
    """page() with next_offset: where the next page begins if this one is full (there may be more), else null."""
    limit = min(max(limit, 1), MOST_PAGE)
    n = F.count("*").over(Window.partitionBy())
    return page(df, limit, offset, *order).withColumn("next_offset", F.when(n >= limit, F.lit(offset + limit)).cast("long"))


def search(entities: DataFrame, query: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(entities.where(compile(query)), limit, offset, F.col("id"))


def doubled(relationships: DataFrame) -> DataFrame:
    """Each edge from both of its ends: node, other, and the edge's columns."""
    ends = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    both = relationships.withColumn("_end", F.explode(F.array(ends("source_ref", "target_ref"), ends("target_ref", "source_ref"))))
    return both.select(*relationships.columns, "_end.node", "_end.other")


def edges(relationships: DataFrame, node: str, direction: str = "either", kinds: list[str] = ()) -> DataFrame:
    ends = {"outgoing": F.col("source_ref") == node, "incoming": F.col("target_ref") == node, "either": (F.col("source_ref") == node) | (F.col("target_ref") == node)}
    out = relationships.where(ends[direction])
    return (out.where(F.col("kind").isin(*kinds)) if kinds else out).orderBy("id")
