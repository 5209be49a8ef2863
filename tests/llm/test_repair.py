"""Conversation repair against all edits of short conversations, tried one by one."""

import hashlib
import itertools
import random
import re
import zlib

from signalcontext.llm import conversation_repair as c

SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_edits(rows, marks):
    """(cost, audit, repaired) of every way with at most two insertions in a row."""
    gaps = [tuple(x) for k in range(3) for x in itertools.product(("user", "assistant"), repeat=k)]
    best = None
    for ops in itertools.product(("K", "Ru", "Ra", "D"), repeat=len(rows)):
        if any(m in ("blank", "duplicate") and o != "D" for o, m in zip(ops, marks)):
            continue
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            cost = 3 * sum(map(len, ins))
            audit, lines = "I" * len(ins[0]), [(r, "") for r in ins[0]]
            for (_, role, text), op, mark, after in zip(rows, ops, marks, ins[1:]):
                cost += {"K": 0, "D": 4}.get(op, 3) + (3 if mark == "truncated" and op != "D" else 0)
                audit += op[0] + "I" * len(after)
                if op != "D":
                    lines.append((role if op == "K" else {"Ru": "user", "Ra": "assistant"}[op], text))
                lines += [(r, "") for r in after]
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    return best


def test_all_edits(spark):
    r = random.Random(4)
    rows = []
    for conv in range(45):
        for turn in range(r.choice([1, 2, 2, 3])):
            rows.append((conv, turn + r.choice([0, 0, 2]), r.choice(["user", "assistant", "system", "tool", "umpire"]), r.choice(["a.", "b", " \n", "c?", "d! \t"]), "x"))
    got = {x.conv_id: x for x in c.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    for conv in range(45):
        mine = sorted(((t, role, text) for k, t, role, text, _ in rows if k == conv))
        marks = faults(mine)
        cost, audit, text = all_edits(mine, marks)
        x = got[conv]
        assert (x.cost, x.audit, x.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), (mine, x, cost, audit)
        assert (x.blank, x.duplicate, x.truncated) == tuple(marks.count(k) for k in ("blank", "duplicate", "truncated"))
        assert x.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        turns = [t for t, *_ in mine]
        assert x.gaps == max(turns) - min(turns) + 1 - len(set(turns))


def test_damage(spark):
    rows = [(conv, turn, "assistant", "Hm. Yes! No? ok", "x") for conv in range(20) for turn in range(10)]
    got = {}
    for x in c.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((x.conv_id, x.turn), []).append(x)
    for conv, turn, *_ in rows:
        h = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        d = got[conv, turn]
        assert len(d) == (2 if h == 3 else 1) and d[0].gone == (h == 0) and d[0].role == ("user" if h == 4 else "assistant")
        assert d[0].text == {1: "", 2: "Hm Yes No ok"}.get(h, "Hm. Yes! No? ok")


def test_nulls_empty_and_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "a.", "x"), (None, None, None, None, "x"), (None, 5, "user", "b.", "x"), (None, None, "user", "a.", "x")]
    got = {x.conv_id: x for x in c.repaired(c.damaged(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(got) == {gone, None}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[None].gaps == 0 and got[None].blank == 1
    assert c.repaired(c.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_conversation_and_text(spark):
    """A conversation of many rows costs no more a row than a short one, and keeps its order over many batches."""
    n = 30_000
    rows = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text")
    x = c.repair(rows).collect()[0]
    text = "\n".join(f"{'assistant' if i % 2 else 'user'}:t{i}." for i in range(n))
    assert (x.cost, x.audit) == (0, "K" * n) and x.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    long = [(1, 0, "user", "w " * 2_000_000 + ".", "x"), (1, 1, "assistant", "ok" + " " * 500_000, "x")]
    x = c.repair(spark.createDataFrame(long, SCHEMA)).collect()[0]
    assert (x.cost, x.truncated, x.audit) == (3, 1, "KK")
