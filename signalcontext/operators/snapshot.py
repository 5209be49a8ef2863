"""Tables under one root as key-bucketed Parquet that is merged when it is read, with commits that name the current files.

A table is a base and the changes since, in order.  Each is a folder of buckets by the hash of the key, so a record is
looked up in one bucket and a small write joins and writes only the buckets that it touches.  A change holds the
records that it inserts, replaces or takes away; the last one of a key counts.  Changes of like size are put together when
there are many, and go into the base when they hold a quarter of its rows.

A commit is one small file: the tables' folders, the schemas' checksum and the graph version.  It is created without
overwriting, so of two writers that begin at the same commit one fails and may begin again.  Readers hold the frames
of the commit that they opened, until `clean` takes that commit away.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import last_writes

FORMAT = 3
#: Changes of so many rows in all are sent to every task when a table is read; more are joined by key.
SMALL = 100_000
#: A base is dealt into buckets of about so many rows when it is written anew.
BUCKET_ROWS = 1_000_000


class Conflict(RuntimeError):
    """Another writer has made the next commit."""


class Snapshots:
    """buckets: the fewest of a table; changes: so many folders of a table are read before some are put together."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, changes: int = 8):
        self.spark, self.root, self.buckets, self.most = spark, root.rstrip("/"), buckets, changes
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(f"{self.root}/_commits"))
        self._open()

    def _open(self) -> None:
        numbers = self._numbers()
        if not numbers:
            self.number, self.state = 0, {"format": FORMAT, "graph_version": 0, "tables": {}, "schemas": {}}
            return
        self.number, self.state = numbers[-1], self._read(numbers[-1])

    def _numbers(self) -> list[int]:
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(self.path(f"{self.root}/_commits")))

    def _at(self, number: int):
        return self.path(f"{self.root}/_commits/{number:012d}")

    def _read(self, number: int) -> dict:
        stream = self.fs.open(self._at(number))
        try:
            body = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if body["checksum"] != _checksum(body["state"]) or body["state"]["format"] != FORMAT:
            raise ValueError(f"commit {number} of {self.root} is not of this format")
        return body["state"]

    def _commit(self, state: dict) -> None:
        number = self.number + 1
        # A commit that has been cleaned away had successors: the number after it may be free and yet be taken.
        stale = lambda: self.number > 0 and not self.fs.exists(self._at(self.number))
        if stale():
            raise Conflict(f"commit {self.number} is no longer there")
        try:
            out = self.fs.create(self._at(number), False)
        except Exception as e:
            if self.fs.exists(self._at(number)):
                raise Conflict(f"commit {number} exists") from e
            raise
        out.write(bytearray(json.dumps({"state": state, "checksum": _checksum(state)}, sort_keys=True).encode()))
        out.close()
        if stale():
            self.fs.delete(self._at(number), False)
            raise Conflict(f"commit {self.number} is no longer there")
        self.number, self.state = number, state

    @property
    def graph_version(self) -> int:
        return self.state["graph_version"]

    def newest_version(self) -> int:
        """The graph version of the newest commit, which another writer may have made since this store was opened."""
        numbers = self._numbers()
        return self._read(numbers[-1])["graph_version"] if numbers else 0

    # Reading.

    def _files(self, state: dict, name: str, parts: list[dict], buckets: Column | None = None) -> DataFrame:
        """The folders' rows with _bucket, _was (what a change does) and _gen (its place)."""
        ddl = state["schemas"][name] + ", `_was` string, `_bucket` int"
        read = lambda i, p: self.spark.read.schema(ddl).parquet(f"{self.root}/{p['path']}").withColumn("_gen", F.lit(i))
        rows = reduce(DataFrame.unionAll, (read(i, p) for i, p in enumerate(parts)))
        return rows if buckets is None else rows.where(buckets)

    def _last(self, state: dict, name: str, parts: list[dict], buckets: Column | None = None) -> DataFrame:
        """Of changes, the last row of each key."""
        rows, key = self._files(state, name, parts, buckets), state["tables"][name]["key"]
        if len(parts) == 1:
            return rows
        rest = [c for c in rows.columns if c not in key]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_gen").alias("_x")).select(*[F.col(k) if k in key else F.col("_x")[k].alias(k) for k in rows.columns])

    def _merged(self, state: dict, name: str, buckets: Column | None = None) -> DataFrame:
        """The current rows with their inner columns; `buckets` restricts both sides to some of them."""
        entry = state["tables"][name]
        base, changes = self._files(state, name, entry["parts"][:1], buckets), entry["parts"][1:]
        if not changes:
            return base
        last = self._last(state, name, changes, buckets)
        gone = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(entry["key"])])
        if sum(p["rows"] for p in changes) <= SMALL:
            gone = F.broadcast(gone)
        return base.join(gone, _same(entry["key"]), "left_anti").unionByName(last.where("_was <> 'gone'"))

    def table(self, name: str) -> DataFrame | None:
        """The table of the open commit; None before its first write."""
        return None if name not in self.state["tables"] else self._merged(self.state, name).drop("_was", "_bucket", "_gen")

    def get(self, name: str, key: str, value) -> dict | None:
        """One record by its key, out of one bucket; by another column, by a scan."""
        if name not in self.state["tables"]:
            return None
        entry = self.state["tables"][name]
        kind = T.StructType.fromDDL(self.state["schemas"][name])[key].dataType
        bucket = F.col("_bucket") == _bucket([F.lit(value).cast(kind)], entry["buckets"]) if entry["key"] == [key] else None
        row = self._merged(self.state, name, bucket).where(F.col(key) == F.lit(value)).drop("_was", "_bucket", "_gen").first()
        return None if row is None else row.asDict(recursive=True)

    def beside(self, name: str, keys: DataFrame) -> DataFrame | None:
        """The records of the keys (the key's columns), out of the buckets that these fall into."""
        if name not in self.state["tables"]:
            return None
        entry = self.state["tables"][name]
        by = entry["key"]
        asked = keys.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]).distinct()
        touched = self._touched(keys.select(_bucket([F.col(k) for k in by], entry["buckets"]).alias("_bucket")))
        return self._merged(self.state, name, touched).join(asked, _same(by), "left_semi").drop("_was", "_bucket", "_gen")

    # Writing.

    def _put(self, name: str, rows: DataFrame) -> dict:
        path = f"{name}/{uuid.uuid4().hex}"
        # Rebalanced by bucket: small buckets share a task, one of many rows is dealt to several.
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{path}")
        return {"path": path}

    def _base(self, state: dict, name: str, rows: DataFrame, most: int, key: list[str], *order: Column) -> None:
        """Writes the last row of each key by `order` as the base, unless a change took it away; `most` bounds the rows.

        One shuffle by bucket does both: a bucket is sorted by key where it is written."""
        buckets = self.buckets
        while buckets * BUCKET_ROWS < most:
            buckets *= 2
        rows = rows.withColumn("_bucket", _bucket([F.col(k) for k in key], buckets))
        # Of a large table each bucket has a task to itself, or nearly so.
        rows = rows.repartition("_bucket") if most <= BUCKET_ROWS else rows.repartition(4 * buckets, "_bucket")
        last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_bucket", *key).orderBy(*order))).where("_n = 1")
        kept = last.where("_was is null or _was <> 'gone'") if "_was" in rows.columns else last
        columns = [f.name for f in T.StructType.fromDDL(state["schemas"][name])]
        put = {"path": f"{name}/{uuid.uuid4().hex}"}
        kept.select(*columns, F.lit(None).cast("string").alias("_was"), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{put['path']}")
        state["tables"][name] = {"key": key, "buckets": buckets, "parts": [put | {"rows": self._files(state, name, [put]).count()}]}

    def _change(self, state: dict, name: str, rows: DataFrame) -> dict[str, int]:
        """Writes rows (with _was, _bucket) as a change, if there are any; how many do what."""
        part = self._put(name, rows)
        entry = state["tables"][name]
        told = {r._was: r.n for r in self._files(state, name, [part]).groupBy("_was").agg(F.count("*").alias("n")).collect()}
        if not told:
            self.fs.delete(self.path(f"{self.root}/{part['path']}"), True)
            return told
        entry["parts"].append(part | {"rows": sum(told.values())})
        base, *changes = entry["parts"]
        held = sum(p["rows"] for p in changes)
        if held * 4 > base["rows"] and (len(changes) > self.most or held > SMALL):
            self._rewrite(state, name)
        elif len(changes) > self.most:
            # The newest ones, as long as the next is no more than twice those after it.
            first, total = len(changes), 0
            while first and (total == 0 or changes[first - 1]["rows"] <= 2 * total):
                first -= 1
                total += changes[first]["rows"]
            late = self._last(state, name, changes[first:]).drop("_gen")
            put = self._put(name, late)
            entry["parts"] = [base, *changes[:first], put | {"rows": self._files(state, name, [put]).count()}]
        if all(p["path"] != part["path"] for p in state["tables"][name]["parts"]):
            # Put together at once: no commit ever names the change itself.
            self.fs.delete(self.path(f"{self.root}/{part['path']}"), True)
        return told

    def _rewrite(self, state: dict, name: str) -> None:
        entry = state["tables"][name]
        self._base(state, name, self._files(state, name, entry["parts"]), sum(p["rows"] for p in entry["parts"]), entry["key"], F.desc("_gen"))

    def upsert(self, batches: dict[str, DataFrame], key: str = "id", order: str | None = None, versioned: bool = True, keys: dict[str, list[str]] | None = None, fold: dict[str, Callable[[DataFrame | None, DataFrame], DataFrame]] | None = None) -> dict[str, dict[str, int]]:
        """Outcomes (inserted, updated, unchanged) by table of one commit over all batches; of several records of a key
        the last by `order` counts, and of those that stand equally late that of the greatest content hash, so a run that
        is repeated keeps the same.  The graph version grows by the records that change.  `keys` names the keys of
        tables that have others than `key`.  `fold` makes a table's records out of the stored ones in the
        buckets that the batch touches, and the batch, as counters need; such tables are outside the graph version.
        A batch that changes nothing makes no commit."""
        state = json.loads(json.dumps(self.state))
        told, changed, scratch = {}, 0, f"{self.root}/_scratch/{uuid.uuid4().hex}"
        try:
            for name, batch in batches.items():
                entry = state["tables"].get(name)
                by = entry["key"] if entry else (keys or {}).get(name, [key])
                buckets = entry["buckets"] if entry else self.buckets
                place = _bucket([F.col(k) for k in by], buckets)
                if name in (fold or {}):
                    touched = None if entry is None else self._touched(batch.select(place.alias("_bucket")))
                    rows = fold[name](None if entry is None else self._merged(state, name, touched).drop("_was", "_bucket", "_gen"), batch)
                    rows = self._typed(state, name, rows)
                else:
                    late = [order] if order else []
                    rows = self._typed(state, name, batch, *late)
                    if entry is not None:
                        rows = last_writes(rows.withColumn("_doc", _content(rows.drop(*late), by)), by, *late, "_doc").drop(*late, "_doc")
                # What is written first is as the batch is: it may be costly, and is worked out once.
                rows.write.parquet(f"{scratch}/{name}")
                new = self.spark.read.schema(rows.schema).parquet(f"{scratch}/{name}")
                total = new.count()
                told[name] = {"inserted": 0, "updated": 0, "unchanged": 0}
                if entry is None:
                    late = [order] if order and name not in (fold or {}) else []
                    state["schemas"][name] = _ddl(new.drop(*late))
                    self._base(state, name, new, total, by, *(F.desc(c) for c in late), _content(new.drop(*late), by).desc())
                    told[name]["inserted"] = state["tables"][name]["parts"][0]["rows"]
                else:
                    new = new.withColumn("_bucket", place)
                    # Keys and hashes of the touched buckets alone are sent of what is stored.
                    old = self._merged(state, name, self._touched(new))
                    old = old.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], _content(old, by).alias("_old"), F.lit(True).alias("_there"))
                    was = F.when(F.col("_there").isNull(), "inserted").when(F.col("_old") != _content(new, by), "updated")
                    rows = new.join(old, _same(by), "left").withColumn("_was", was).where("_was is not null").select(*new.columns, "_was")
                    told[name] |= self._change(state, name, rows)
                    told[name]["unchanged"] = total - told[name]["inserted"] - told[name]["updated"]
                changed += 0 if name in (fold or {}) else told[name]["inserted"] + told[name]["updated"]
        finally:
            self.fs.delete(self.path(scratch), True)
        if state != self.state:
            state["graph_version"] += changed if versioned else 0
            self._commit(state)
        return told

    def _typed(self, state: dict, name: str, batch: DataFrame, *more: str) -> DataFrame:
        """The batch in the table's columns and types, with the columns that order it."""
        if name in state["tables"]:
            batch = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(state["schemas"][name])], *more)
        return batch

    def _touched(self, rows: DataFrame) -> Column:
        """The condition that a bucket is one of those of the rows: as many numbers as the table has buckets at most."""
        return F.col("_bucket").isin([r[0] for r in rows.select("_bucket").distinct().collect()])

    def delete(self, name: str, keys: DataFrame) -> int:
        """Takes the records of the keys (the key's columns) away, in one commit; how many there were."""
        if name not in self.state["tables"]:
            return 0
        state = json.loads(json.dumps(self.state))
        entry = state["tables"][name]
        by = entry["key"]
        gone = keys.select(*by).distinct().withColumn("_bucket", _bucket([F.col(k) for k in by], entry["buckets"]))
        right = gone.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)])
        # A row that takes a record away has its key alone.
        rows = self._merged(state, name, self._touched(gone)).select(*by, "_bucket").join(right, _same(by), "left_semi").withColumn("_was", F.lit("gone"))
        rows = rows.select(*[F.col(f.name) if f.name in by else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(state["schemas"][name])], "_was", "_bucket")
        n = self._change(state, name, rows).get("gone", 0)
        if n:
            self._commit(state)
        return n

    def compact(self, name: str) -> None:
        """The table as one base, in one commit; its buckets are as many as its rows ask for."""
        state = json.loads(json.dumps(self.state))
        self._rewrite(state, name)
        self._commit(state)

    def clean(self, keep: int = 2) -> int:
        """Takes away all commits but the last `keep`, and the folders that only those name; how many folders.  Folders
        that no commit names may belong to a writer at work and stay."""
        numbers = self._numbers()
        if keep < 1 or len(numbers) <= keep:
            return 0
        named = lambda state: {p["path"] for entry in state["tables"].values() for p in entry["parts"]}
        held = set().union(*(named(self._read(n)) for n in numbers[-keep:]))
        lost = set()
        for n in numbers[:-keep]:
            lost |= named(self._read(n)) - held
            self.fs.delete(self._at(n), False)
        for path in lost:
            self.fs.delete(self.path(f"{self.root}/{path}"), True)
        return len(lost)

    # Checkpoints and decisions are tables like others, outside the graph version.

    def put_checkpoint(self, name: str, captured: DataFrame, shape: str, at: str) -> None:
        """A capture (key, digest, status) under a name; an earlier one of the name is replaced."""
        path = f"_checkpoints/{uuid.uuid4().hex}"
        captured.write.parquet(f"{self.root}/{path}")
        row = self.spark.createDataFrame([(name, at, shape, self.graph_version, path)], "name string, captured_at string, shape string, graph_version long, path string")
        self.upsert({"checkpoints": row}, key="name", versioned=False)

    def checkpoints(self) -> DataFrame | None:
        """The list, latest first."""
        df = self.table("checkpoints")
        return None if df is None else df.orderBy(F.desc("captured_at"), "name")

    def checkpoint(self, name: str) -> tuple[dict, DataFrame] | None:
        row = self.get("checkpoints", "name", name)
        return None if row is None else (row, self.spark.read.parquet(f"{self.root}/{row['path']}"))

    def drop_checkpoint(self, name: str) -> bool:
        return self.delete("checkpoints", self.spark.createDataFrame([(name,)], "name string")) > 0

    def record_decision(self, kind: str, verdict: str, subject: str, actor: str, context: str, at: str) -> str:
        """The id of a decision, which its content names: recorded twice it is one."""
        if not actor or not context:
            raise ValueError("a decision names its actor and the policy that it was made under")
        name = hashlib.sha256("\x1f".join((kind, verdict, subject, actor, context, at)).encode()).hexdigest()
        row = self.spark.createDataFrame([(name, kind, verdict, subject, actor, context, at)], "id string, kind string, verdict string, subject string, actor string, context string, decided_at string")
        self.upsert({"decisions": row}, versioned=False)
        return name

    def decisions(self) -> DataFrame | None:
        df = self.table("decisions")
        return None if df is None else df.orderBy("decided_at", "id")


def _bucket(key: Iterable[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _content(rows: DataFrame, key: list[str]) -> Column:
    """The hash of a record's content, of all but its key and the inner columns; it is worked out where it is asked for."""
    rest = sorted(c for c in rows.columns if c not in (*key, "_was", "_bucket", "_gen"))
    return F.unhex(F.sha2(F.to_json(F.struct(*(rest or key)), {"ignoreNullFields": "false"}), 256))


def _same(key: list[str]) -> Column:
    """The key equal to the other side's _k0, _k1 ...; a null is equal to a null."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)))


def _checksum(state: dict) -> str:
    return hashlib.sha256(json.dumps(state, sort_keys=True).encode()).hexdigest()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
