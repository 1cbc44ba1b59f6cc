"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the rows by their normalised text, the external sort of each range puts equal
texts next to each other, and neighbours are compared in full. Splitters and the leading sort columns are the
first bytes of the text and a hash of the whole, so a sample row is small however long the texts are, and long
common openings still spread over ranges; whether two texts are equal is decided by the texts.

A text that holds more than 1 / (4 * ranges) of all rows is hot. Its rows get a salt, one for each so many rows, and
so lie in several ranges; each (text, salt) run is reduced to one head, and only the heads of hot texts are sorted
again. Hot texts have at most 8 * ranges heads in all, which bounds the broadcast lists of their hashes and heads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.store import Workspace, keyed

KEY_CHARS = 24


def _runs(docs: DataFrame, id_col: str, text_col: str, normalise, keep: str, ranges: int, carried: dict) -> DataFrame:
    """The rows in content order with their place in, and the head and size of, their (text, salt) run; carried: more
    columns by name."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    text = (lambda c, plain=text: normalise(plain(c))) if normalise else text
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_raw"), *(c.alias(name) for name, c in carried.items()))
    hashes = rows.select(F.xxhash64(text(F.col("_raw"))).alias("_hash"))
    least = max(1, -(-docs.count() // (4 * ranges)))
    hot = hashes.groupBy("_hash").agg(F.count("*").alias("_n")).where(F.col("_n") > least).select("_hash", F.ceil(F.col("_n") / least).alias("_salts"))
    rows = rows.withColumn("_hash", F.xxhash64(text(F.col("_raw")))).join(F.broadcast(hot), "_hash", "left")
    rows = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_id"), "_salts"), F.lit(0))).withColumn("_hot", F.col("_salts").isNotNull()).drop("_salts")
    ranged = rows.withColumn("_lead", F.substring(text(F.col("_raw")), 1, KEY_CHARS)).repartitionByRange(ranges, "_lead", "_hash", "_salt")
    ranged = ranged.withColumn("_text", text(F.col("_raw")))
    run = Window.partitionBy("_lead", "_hash", "_salt", "_text")
    first = run.orderBy(_rank("_id", keep))
    return ranged.select("*", F.first("_id").over(first).alias("_head"), F.row_number().over(first).alias("_place"), F.count("*").over(run).alias("_size"))


def _rank(name: str, keep: str):
    return F.col(name).asc_nulls_last() if keep == "smallest" else F.col(name).desc_nulls_last()


def _check(keep: str) -> None:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    normalise: Column -> Column, identity when None. Null texts count as empty, so nulls and empty texts are one
    group. keep: 'smallest' or 'largest' identifier stays. Repeated identifiers: each row counts in group_size and
    just one of them is kept. Other columns of docs are not read, whatever their names. An empty table gives none.
    """
    _check(keep)
    spark = docs.sparkSession
    runs = _runs(docs, id_col, text_col, normalise, keep, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), {})
    runs = runs.select("_id", "_hot", "_salt", "_head", "_place", "_size", F.sha2(F.col("_text"), 256).alias("text_sha256"), F.when(F.col("_hot") & (F.col("_place") == 1), F.col("_text")).alias("_text"))
    runs = Workspace(spark, "dedup").cut(runs, "runs")

    again = Window.partitionBy("text_sha256", "_text")
    heads = runs.where(F.col("_hot") & (F.col("_place") == 1))
    named = heads.select(
        "text_sha256", "_salt",
        F.first("_head").over(again.orderBy(_rank("_head", keep))).alias("_all_head"),
        F.sum("_size").over(again).alias("_all_size"),
        (F.row_number().over(again.orderBy(_rank("_head", keep), "_salt")) == 1).alias("_chosen"),
    )
    out = runs.drop("_text").join(F.broadcast(named), ["text_sha256", "_salt"], "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_hot"), F.col("_all_head")).otherwise(F.col("_head")).alias("keep_id"),
        F.when(F.col("_hot"), F.col("_all_size")).otherwise(F.col("_size")).alias("group_size"),
        ((F.col("_place") == 1) & F.coalesce(F.col("_chosen"), F.lit(True))).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "smallest") -> DataFrame:
    """The rows of docs, all columns, of which one of each group of equal texts stays: one with the kept identifier.

    A null identifier comes after all others; rows with null or repeated identifiers count as rows of their own. The
    rows are shuffled once, with all their columns; what a run drops is dropped there.
    """
    _check(keep)
    work = Workspace(docs.sparkSession, "dedup")
    rows, key = keyed(docs, id_col, keep, work)
    keep = keep if key == id_col else "smallest"
    carried = {f"_c{k}": F.col(f"`{c}`") for k, c in enumerate(docs.columns) if c not in (text_col, key)}
    runs = _runs(rows, key, text_col, normalise, keep, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), carried)
    runs = work.cut(runs.where("_place = 1").select("_id", "_raw", "_hot", "_salt", *carried), "heads")
    hot = runs.where("_hot")
    text = F.coalesce(F.col("_raw").cast("string"), F.lit(""))
    again = Window.partitionBy(normalise(text) if normalise else text).orderBy(_rank("_id", keep))
    gone = hot.select("_id", F.row_number().over(again).alias("_place")).where("_place > 1").select("_id")
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)} | {text_col: "_raw"} | ({id_col: "_id"} if key == id_col else {})
    return work.lend(runs.join(F.broadcast(gone), "_id", "left_anti").select([F.col(names[c]).alias(c) for c in docs.columns]))
