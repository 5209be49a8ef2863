"""Structure repair of conversations: the cheapest edits that make the turns' roles read s?(ua)+, or nothing.

Rows are dealt out by conversation once.  That dealing serves the window that marks repeated rows and the sort by turn;
one pass then reads the sorted rows and never holds a conversation.  It carries the least (cost, audit) of each of
four grammar states (nothing yet, system row, user row, assistant row) over the rows and closes each layer with at
most two insertions, as a third would only go round.  With its audit a state carries the hash of the rows that it
keeps, and what the audits of all states begin with is set aside, so a row costs the same in long and short conversations.

Two audits of equal cost in one layer never begin with each other (one would hold the same edits and further
insertions, so cost more), so the least audit of a layer leads to the least of the whole.  The audit fixes the roles that
Rerole and Insert give: after a user row the assistant, else the user.

Edge cases: nulls in any column are one space; a null conv_id is a conversation of its own; rows of one turn stand in
the order of their role and text before damage (a repeated row's copies adjacent); roles other than the three are
known by their first character; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a kept row leads to, by state and initial.
GRAMMAR = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state and role of a row whose role is given anew, by state.
ANEW = {NOTHING: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of turns(conv_id, turn, role, text) with nulls as one space and each row's damage: conv_id, turn, role,
    text, copy (0, or 1 for the second of a repeated row), gone (the row is dropped), was_role and was_text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    out = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("was_role"), text.alias("was_text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("_h"))
    out = out.withColumn("copy", F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return out.select(
        "conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("was_role")).alias("role"),
        F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("was_text", ".!?", "")).otherwise(F.col("was_text")).alias("text"),
        "copy", (F.col("_h") == 0).alias("gone"), "was_role", "was_text",
    )  # fmt: skip


def _first_faults(rows: DataFrame) -> DataFrame:
    """rows with fault: blank, duplicate, truncated or null, and in the order in which repair() reads them."""
    order = [F.col("turn").asc_nulls_first(), "was_role", "was_text", "copy"]
    # The text stands for itself by its hash among the keys of the window, so long texts are not compared row by row.
    rows = rows.repartition("conv_id").withColumn("_same", F.sha2("text", 256))
    seen = F.expr("row_number() over (partition by conv_id, role, _same, gone order by turn asc nulls first, was_role, was_text, copy)") > 1
    # The white space is cut off by translate and rtrim: no pattern runs over a text.
    bare = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = F.when(bare == "", "blank").when(seen, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    out = rows.select("conv_id", "turn", "role", "text", "gone", "copy", "was_role", "was_text", fault.alias("fault"))
    return out.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order).select("conv_id", "turn", "role", "text", "gone", "fault")


class _Path:
    """The cheapest edits that lead to a state: their cost, the audit since what all states share, and the hash of
    the rows kept so far."""

    __slots__ = ("cost", "audit", "hash", "rows")

    def __init__(self, cost: int, audit: str, hash, rows: bool) -> None:
        self.cost, self.audit, self.hash, self.rows = cost, audit, hash, rows

    def __lt__(self, other: _Path) -> bool:
        return (self.cost, self.audit) < (other.cost, other.audit)


class Repair:
    """One conversation, row by row."""

    def __init__(self) -> None:
        self.states: list[_Path | None] = [_Path(0, "", hashlib.sha256(), False), None, None, None]
        self.audit: list[str] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.initial = self.least = self.most = self.turn = None
        self.turns = 0
        self.some = False
        self._close()

    def _step(self, into: list, to: int, path: _Path, cost: int, letter: str, line: tuple[str, str] | None) -> None:
        # Whichever is cheaper: (cost, audit) decides before a hash is copied.
        rival, total = into[to], path.cost + cost
        if rival is None or (total, path.audit + letter) < (rival[0], rival[1]):
            into[to] = (total, path.audit + letter, path, line)

    def _settle(self, chosen: list) -> None:
        out: list[_Path | None] = []
        for found in chosen:
            if found is None:
                out.append(None)
            elif isinstance(found, _Path):
                out.append(found)
            else:
                total, audit, path, line = found
                made = path.hash
                if line is not None:
                    made = made.copy()
                    made.update((("\n" if path.rows else "") + line[0] + ":").encode())
                    made.update(line[1].encode())
                out.append(_Path(total, audit, made, path.rows or line is not None))
        self.states = out

    def _close(self) -> None:
        """Insertions within the layer: two rounds reach every state."""
        for _ in range(2):
            chosen: list = [None if p is None else (p.cost, p.audit, p, None) for p in self.states]
            for state, path in enumerate(self.states):
                if path is not None:
                    to, role = ANEW[state]
                    self._step(chosen, to, path, INSERT, "I", (role, ""))
            self._settle(chosen)
        shared = os.path.commonprefix([p.audit for p in self.states if p is not None])
        if shared:
            self.audit.append(shared)
            for p in self.states:
                if p is not None:
                    p.audit = p.audit[len(shared) :]

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        self.some = True
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.turn
            self.most = self.turn = turn
        initial = role[:1]
        if self.initial is not None:
            self.counts["illegal"] += self.initial + initial not in LEGAL
        self.initial = initial
        if fault:
            self.counts[fault] += 1
        more = TRUNCATED if fault == "truncated" else 0
        chosen: list = [None] * 4
        for state, path in enumerate(self.states):
            if path is None:
                continue
            self._step(chosen, state, path, DELETE, "D", None)
            if fault in ("blank", "duplicate"):
                continue
            to, anew = ANEW[state]
            self._step(chosen, to, path, REROLE + more, "R", (anew, text))
            if (state, initial) in GRAMMAR:
                self._step(chosen, GRAMMAR[state, initial], path, KEEP + more, "K", (role, text))
        self._settle(chosen)
        self._close()

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        if not self.some:
            return gaps, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
        best = min(p for p in (self.states[NOTHING], self.states[ASSISTANT]) if p is not None)
        return gaps, *self.counts.values(), best.cost, "".join(self.audit) + best.audit, best.hash.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

    now, at, done = None, None, []
    for b in batches:
        for conv, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or conv != at:
                if now is not None:
                    done.append((at, *now.result()))
                now, at = Repair(), conv
            if not gone:
                now.row(turn, role, text, fault)
        if len(done) >= 1000:
            yield batch(done)
            done = []
    if now is not None:
        yield batch([*done, (at, *now.result())])


def repaired(rows: DataFrame) -> DataFrame:
    """One row a conversation of rows as damaged() gives them (SCHEMA)."""
    return arrow_map(_first_faults(rows), _repaired, SCHEMA)


def repair(turns: DataFrame) -> DataFrame:
    """The repair of turns(conv_id, turn, role, text) as they stand, without damage."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return repaired(plain.withColumns({"copy": F.lit(0), "gone": F.lit(False), "was_role": F.col("role"), "was_text": F.col("text")}))


def oracle() -> str:
    """The same rows: a recursion over the places of all conversations at once, with four states of (cost, audit, text)."""
    none = "{'c': 1000000000, 'a': '', 't': ''}"

    def least(*paths: str) -> str:
        return f"list_sort([{', '.join(paths)}])[1]"

    def led(s: str, cost: str, letter: str, line: str) -> str:
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t || {line}}}"

    def closed(source: str) -> str:
        user, assistant = (f"chr(10) || '{role}:'" for role in ("user", "assistant"))
        s2 = least("s2", led("s0", "3", "I", user), led("s1", "3", "I", user), led("s3", "3", "I", user))
        return f"(SELECT * REPLACE ({s2} AS s2, {least('s3', led('s2', '3', 'I', assistant))} AS s3) FROM {source})"

    def kept(s: str, initial: str) -> str:
        return f"CASE WHEN whole AND left(role, 1) = '{initial}' THEN {led(s, 'more', 'K', 'chr(10) || role || chr(58) || txt')} ELSE {none} END"

    def anew(s: str, role: str) -> str:
        return f"CASE WHEN whole THEN {led(s, '3 + more', 'R', f"chr(10) || '{role}:' || txt")} ELSE {none} END"

    gone = {f"s{i}": led(f"s{i}", "4", "D", "''") for i in range(4)}
    step = {
        "s0": gone["s0"], "s1": least(gone["s1"], kept("s0", "s")),
        "s2": least(gone["s2"], *(kept(s, "u") for s in ("s0", "s1", "s3")), *(anew(s, "user") for s in ("s0", "s1", "s3"))),
        "s3": least(gone["s3"], kept("s2", "a"), anew("s2", "assistant")),
    }  # fmt: skip
    start = f"(SELECT ck, 0::BIGINT AS p, {{'c': 0, 'a': '', 't': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM (SELECT DISTINCT ck FROM faults))"
    moved = f"(SELECT w.ck, f.p, {', '.join(f'{e} AS {k}' for k, e in step.items())} FROM walk w JOIN faults f ON f.ck = w.ck AND f.p = w.p + 1)"
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS ck, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0,
  hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations),
h AS (SELECT r.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i+1])::BIGINT)), lambda s, b: xor(s >> 8, t[1 + (xor(s, b) & 255)]))) % 20 AS h FROM r, crc),
d AS (SELECT ck, turn, role0, text0, copy, CASE WHEN h = 4 THEN 'user' ELSE role0 END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS txt
  FROM (SELECT *, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role0, text0, copy) AS p, regexp_replace(txt, '[ 	-]+$', '') AS bare FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY ck, role, txt ORDER BY p) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(left(role, 1)) OVER (PARTITION BY ck ORDER BY p) || left(role, 1) AS pair FROM o),
faults AS (SELECT ck, p, turn, role, txt, fault, pair, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS whole, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM f),
walk AS (SELECT * FROM {closed(closed(start))} UNION ALL SELECT * FROM {closed(closed(moved))}),
ends AS (SELECT ck, {least('s0', 's3')} AS e FROM walk QUALIFY row_number() OVER (PARTITION BY ck ORDER BY p DESC) = 1),
sums AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY ck)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, ck FROM r) c LEFT JOIN ends USING (ck) LEFT JOIN sums USING (ck)
"""
