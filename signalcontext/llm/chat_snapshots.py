"""Chat formatting with cumulative snapshots collapsed.

A logged conversation is often the beginning of a longer logged one.  Turns are placed in order; a prefix is
known by two rolling hashes, the running exclusive-or of hashes of (place, role, text).  A conversation whose
whole hash stands as a proper prefix of another is dropped by an anti-join; of equal ones the smallest conv_id
stays.  What remains is rendered in blocks of TURNS turns.

Only DataFrame functions run here.  Places and running hashes are worked out in blocks of a conversation and then
over its blocks, so no task holds a whole long conversation; prefixes are made distinct before they are joined.

Edge cases: rows without conv_id are left out; rows that repeat a turn in all columns are one; turns with the same
number are ordered by role and text; a null turn comes first; null roles and texts are empty; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

#: Turns of a block.
TURNS = 256


def _offsets(parts: DataFrame, value, name: str) -> DataFrame:
    """conv_id, block and the combined value of the conversation's blocks before it."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("conv_id", "block", *(F.coalesce(value(c).over(before), F.lit(0)).cast("long").alias(f"{name}{i}") for i, c in enumerate(c for c in parts.columns if c not in ("conv_id", "block"))))


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, and the prefix hashes p0, p1 up to each turn."""
    rows = turns.where("conv_id is not null").select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn") / TURNS))
    rows = kept(rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text"))), "turns")
    before = _offsets(rows.groupBy("conv_id", "block").agg(F.count("*").alias("c")), F.sum, "before")
    rows = rows.join(before, ["conv_id", "block"]).withColumn("place", F.col("before0") + F.col("rank"))
    rows = rows.withColumn("block", F.floor((F.col("place") - 1) / TURNS))
    rows = rows.withColumns({"h0": F.xxhash64("place", "role", "text"), "h1": F.xxhash64("text", "role", "place", F.lit(7))})
    w = Window.partitionBy("conv_id", "block").orderBy("place")
    rows = rows.select("conv_id", "block", "place", "role", "text", F.bit_xor("h0").over(w).alias("r0"), F.bit_xor("h1").over(w).alias("r1"), F.col("h0"), F.col("h1"))
    rows = kept(rows, "hashed")
    heads = _offsets(rows.groupBy("conv_id", "block").agg(F.bit_xor("h0").alias("x0"), F.bit_xor("h1").alias("x1")), F.bit_xor, "x")
    return rows.join(heads, ["conv_id", "block"]).select("conv_id", "block", "place", "role", "text", F.expr("r0 ^ x0").alias("p0"), F.expr("r1 ^ x1").alias("p1"))


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that stay."""
    ends = placed.groupBy("conv_id").agg(F.max("place").alias("place"), F.max_by(F.struct("p0", "p1"), "place").alias("p")).select("conv_id", "place", "p.p0", "p.p1")
    ends = kept(ends.groupBy("place", "p0", "p1").agg(F.min("conv_id").alias("conv_id")), "ends")
    last = placed.groupBy("conv_id").agg(F.max("place").alias("n"))
    inner = placed.select("conv_id", "place", "p0", "p1").join(last, "conv_id").where("place < n").select("place", "p0", "p1").distinct()
    return ends.join(inner, ["place", "p0", "p1"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, block, first_turn, chat: the maximal conversations, a row for every TURNS turns."""
    placed = kept(placed_turns(turns), "placed")
    stay = maximal(placed)
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    rows = placed.join(stay, "conv_id").select("conv_id", "n_turns", "block", "place", line.alias("line"))
    blocks = rows.groupBy("conv_id", "n_turns", "block").agg(F.min("place").alias("first_turn"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return blocks.select("conv_id", "n_turns", F.col("block").cast("long").alias("block"), F.col("first_turn").cast("long").alias("first_turn"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("chat"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM t),
c AS (SELECT conv_id, list(role || chr(1) || text ORDER BY place) AS ts FROM p GROUP BY conv_id),
m AS (SELECT a.conv_id, len(a.ts) AS n FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.ts[1] = a.ts[1] AND b.ts[1:len(a.ts)] = a.ts AND (len(b.ts) > len(a.ts) OR len(b.ts) = len(a.ts) AND b.conv_id < a.conv_id)))
SELECT conv_id, n::BIGINT AS n_turns, ((place - 1) // 256)::BIGINT AS block, min(place)::BIGINT AS first_turn,
  string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY place) AS chat
FROM p JOIN m USING (conv_id) GROUP BY 1, 2, 3
"""
