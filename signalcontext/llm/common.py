"""What the operators of this subpackage share: reading, intermediate tables, hash folds, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that kept() wrote, by the scope in which it was called.
_scopes: list[list[str]] = []
#: Bytes of one Arrow batch, where the session leaves Spark's own size.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only a local session that names none gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: its lineage ends here, no executor's
    loss costs more than a re-read, and Spark knows its size when it picks join strategies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that kept() wrote inside it, and no others; frames built on them end with it."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def arrow_map(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes, unless the session has set a size of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name) in ("67108864", "67108864b"):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once for each row, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold that a contract fixes (null id: 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


#: Rows of a few ids that one task writes.
ROWS_A_TASK = 200_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as `rows`, a bound on its rows, asks for: a small frame does not pay for a task and
    a file a shuffle partition, a large one keeps them all."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_A_TASK))


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of the undirected links (a, b), a != b.
    rows: a bound on the links, where it is known.

    Each round maps a node to the smallest of its closed neighbourhood and contracts the links, so the nodes
    left at least halve or become stars that the next round closes.
    """
    links = links.select("a", "b").where("a <> b").distinct()
    links = kept(links if rows is None else sized(links, rows), "links")
    left = first = links.count()
    labels = None
    while left:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component"))
        parent = kept(sized(parent, 2 * left), "parent")
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("node").alias("component"), F.col("component").alias("up"))
            labels = labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
            labels = kept(sized(labels, 2 * first), "labels")
        a = parent.select(F.col("node").alias("a"), F.col("component").alias("pa"))
        b = parent.select(F.col("node").alias("b"), F.col("component").alias("pb"))
        nxt = links.join(a, "a").join(b, "b").where("pa <> pb")
        nxt = nxt.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        links = kept(sized(nxt, left), "links")
        left = links.count()
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) of what `found` describes and further links (a, b): only the links between
    different components are contracted."""
    a = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    raised = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = components(raised, links.count())
    new = up.join(found.select("node"), "node", "left_anti")
    old = found.join(up.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return kept(sized(old.unionByName(new), found.count() + up.count()), "joined")
