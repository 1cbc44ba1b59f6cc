"""Connected components of an edge table.

Few edges go to one task, which joins them in a forest; so many as SMALL take it a fraction of a second. More are
closed by alternating large-star and small-star steps. Each step is a grouped minimum, combined before the shuffle,
and an equi-join, so a vertex with very many neighbours is neither collected nor expanded into pairs. Stars close in
two rounds, paths in about log2 of their length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.store import Workspace

#: Edges that one task takes.
SMALL = 1 << 17


def _stars(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star, on edges (a > b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Every neighbour above a vertex hangs on the least of the vertex and its neighbours.
    large = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u")
    large = large.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    # Every neighbour below a vertex, and the vertex, hang on the least of them.
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _forest(parts):
    """(id, component) of all edges of a task."""
    above: dict = {}

    def root(x):
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for batch in parts:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    ids = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, rows: int, work: Workspace, label: str = "stars") -> DataFrame:
    """(id, component) for every vertex that isn't the least of its component; edges has long columns a and b, and at
    most so many rows."""
    if rows <= SMALL:
        return work.cut(edges.select("a", "b").repartition(1).mapInArrow(_forest, "id long, component long").where("id <> component"), label)
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    seen, before = None, None
    while True:
        edges = work.cut(_stars(edges), label, before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a", "a").cast("decimal(38,0)"))).first()
        if now == seen:
            out = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
            out._pactum_path = edges._pactum_path
            return out
        seen, before = now, edges
