"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, settle


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).withColumnRenamed("a", "at")
    return edges.join(low, F.col("b") == F.col("at")).select("a", F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low.withColumnRenamed("a", "at"), F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").unionByName(low.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) of longs; root is the smallest node that it reaches.

    Alternating large-star and small-star: every step is a group-by with map-side partial minima and an
    equi-join that adaptive execution can split, so a hub needs no single task. Each round is written to the
    shared folder. Self-edges and repeated edges are harmless; no edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = settle(edges, "edges")
    state = _state(edges)
    while state[0]:
        after = settle(_small_star(_large_star(edges)), "edges")
        discard(edges)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
