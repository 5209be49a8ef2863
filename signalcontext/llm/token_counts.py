"""Exact length histogram of encoded documents.

Documents are aggregated by their number of ids; suffix sums over the distinct lengths then answer, for every
context limit, how many documents reach it and how many ids are left when each is cut there:
truncated(L) = tokens of the documents shorter than L + L * documents of at least L.

Edge cases: null and empty texts have length 0; the name of an added token counts as that token; repeated rows count as often as they stand; an empty table gives
an empty histogram; columns other than text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, kept
from .encoding import encoded, public_vocabulary

#: Distinct lengths are summed in spans of so many ids, then over the spans.
SPAN = 1024


def _counted(path: str, named: bool):
    """(length, documents) of each step: the histogram is begun where the texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, before in encoded(batch, path, named):
                n, c = np.unique(np.diff(before), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(c.astype(np.int64))], names=["n_tokens", "n_docs"])

    return run


def length_histogram(docs: DataFrame, vocabulary: str | None = None, named: bool = True) -> DataFrame:
    """n_tokens, n_docs: one row a distinct length.  named: the name of an added token in a text is that token."""
    path = vocabulary or public_vocabulary()
    return arrow_map(docs.select("text"), _counted(path, named), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with docs_at_least, tokens_at_least (suffix sums), docs_at_most, tokens_total and
    truncated_tokens (ids left when every document is cut to n_tokens)."""
    spans = kept(histogram.withColumn("span", F.expr(f"n_tokens div {SPAN}")).withColumn("tokens", F.expr("n_tokens * n_docs")), "lengths")
    sums = spans.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    sums = sums.select("span", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    inside = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    out = spans.join(sums, "span")
    out = out.select("n_tokens", "n_docs", (F.sum("n_docs").over(inside) + F.col("d_after")).alias("docs_at_least"), (F.sum("tokens").over(inside) + F.col("t_after")).alias("tokens_at_least"), "d_all", "t_all")
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        F.expr("d_all - docs_at_least + n_docs").alias("docs_at_most"), F.col("t_all").alias("tokens_total"),
        F.expr("t_all - tokens_at_least + n_tokens * docs_at_least").alias("truncated_tokens"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Ids left when every document is cut to the limit, for any limit."""
    row = sums.agg(
        F.sum(F.when(F.col("n_tokens") < limit, F.col("n_tokens") * F.col("n_docs")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("n_tokens") >= limit, F.col("n_docs")).otherwise(0)).alias("reach"),
    ).first()
    return int((row.below or 0) + limit * (row.reach or 0))


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least the share q of the documents does not exceed."""
    return sums.where(F.col("docs_at_most") >= F.lit(q) * (F.col("docs_at_most") + F.col("docs_at_least") - F.col("n_docs"))).agg(F.min("n_tokens")).first()[0]
