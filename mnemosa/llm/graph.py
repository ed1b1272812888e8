"""Connected components by alternating star contractions, with every round's edges in a shared table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(tables: Tables, edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, label) of every node of edges (a, b); label is the smallest node reachable.

    Large-star then small-star until the edges are stars.  A round is two
    aggregates by node with map-side partial minima and two joins by node; the
    minima are written first, so that a hub with very many neighbours is on a side
    of a join that adaptive execution splits.  No edges give no rows; loops,
    repeated edges and nulls are ignored.  Rounds grow with the logarithm of the
    number of nodes, squared at worst; over `rounds` of them raise an error, and
    no link is lost.
    """
    now = tables.write(f"{name}-0", edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark, step = _mark(now), 0
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = tables.write(f"{name}-low", both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = tables.write(f"{name}-large", both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        tables.drop(f"{name}-low")
        low = tables.write(f"{name}-low", large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        step += 1
        now = tables.write(f"{name}-{step}", small)
        tables.drop(f"{name}-{step - 1}", f"{name}-low", f"{name}-large")
        if (after := _mark(now)) == mark:
            break
        if step >= rounds:
            raise RuntimeError("components did not settle")
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
