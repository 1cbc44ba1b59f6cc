"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer for every context limit.

For a limit of L ids, a document of n ids keeps min(n, L). With the histogram, the kept total is the ids of all
documents of at most L plus L for each longer one; both are running sums over lengths. These sums are taken in
blocks of lengths, so no task sees the whole histogram.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.store import Workspace, tidied
from pactum.llm.units import Encoder, in_runs, slices

#: Lengths in a block of the running sums.
BLOCK = 1024


@functools.cache
def _library(path: str, pattern: str) -> Encoder:
    import tiktoken

    with open(path, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    lengths[list(table.values())] = [len(token) for token in table]
    return Encoder(in_runs(lambda texts: [encode(t) for t in texts], lengths))


def lengths(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row; null and empty texts have 0. Other columns are not read."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(parts):
        encoder = _library(path, pattern)
        for batch in parts:
            for lo, hi in slices(batch.column(1)):
                _, ends = encoder.ids(batch.column(1)[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(ends, prepend=0), pa.int64())], names=["id", "n_tokens"])

    return rows.mapInArrow(tidied(run), f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long").withColumnRenamed("id", id_col)


def histogram(counted: DataFrame) -> DataFrame:
    """Rows (limit, docs, docs_longer, tokens, tokens_kept): one for each length that occurs.

    docs: documents of exactly that length; docs_longer: of more; tokens: ids of all documents of at most the limit;
    tokens_kept: ids that remain when all documents are cut at the limit. Answers for limits in between follow from
    the next length below, see truncated(). An empty table gives an empty histogram.
    """
    by = counted.groupBy("n_tokens").agg(F.count("*").alias("docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    # Three steps below read the histogram; written, it is counted once.
    by = Workspace(counted.sparkSession, "counts").cut(by, "histogram")
    sums = by.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    # One row for each 1024 lengths; blocks of blocks keep this step small as well.
    sums = sums.withColumn("over", F.floor(F.col("block") / BLOCK))
    whole = sums.groupBy("over").agg(F.sum("d").alias("od"), F.sum("t").alias("ot"))
    before = Window.orderBy("over").rowsBetween(Window.unboundedPreceding, -1)  # a row for each million lengths
    whole = whole.select("over", F.coalesce(F.sum("od").over(before), F.lit(0)).alias("od"), F.coalesce(F.sum("ot").over(before), F.lit(0)).alias("ot"), F.sum("od").over(Window.orderBy("over").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("every"))
    inside = Window.partitionBy("over").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("over", "block", F.coalesce(F.sum("d").over(inside), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(inside), F.lit(0)).alias("t")).join(whole, "over")
    run = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = by.select("block", "n_tokens", "docs", F.sum("docs").over(run).alias("rd"), F.sum(F.col("docs") * F.col("n_tokens")).over(run).alias("rt")).join(sums, "block")
    longer, tokens = F.col("every") - F.col("od") - F.col("d") - F.col("rd"), F.col("ot") + F.col("t") + F.col("rt")
    return out.select(
        F.col("n_tokens").alias("limit"), "docs", longer.alias("docs_longer"), tokens.alias("tokens"), (tokens + F.col("n_tokens") * longer).alias("tokens_kept")
    )


def truncated(hist: DataFrame, limit: int) -> int:
    """Ids that remain when all documents are cut at any limit."""
    low = hist.where(F.col("limit") <= limit).agg(F.max_by("tokens", "limit").alias("t"), F.max_by("docs_longer", "limit").alias("d")).first()
    if low.t is None:
        return limit * int(hist.agg(F.sum("docs")).first()[0] or 0)
    return int(low.t + limit * low.d)


def quantile(hist: DataFrame, share: float) -> int | None:
    """The smallest length that at least that share of the documents does not exceed."""
    every = hist.agg(F.sum("docs")).first()[0]
    return None if not every else hist.where(every - F.col("docs_longer") >= share * every).agg(F.min("limit")).first()[0]
