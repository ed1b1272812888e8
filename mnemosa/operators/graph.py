"""Edges between facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(edges: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """src < dst; weights of repeated edges added up."""
    rows = edges if new is None else edges.unionByName(new)
    rows = rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "kind", "weight").where("src <> dst")
    return rows.groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"))


def without_orphans(edges: DataFrame, ids: DataFrame) -> DataFrame:
    known = ids.select("id")
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")


def neighbours(edges: DataFrame, ids: DataFrame, most: int = 512) -> DataFrame:
    """The `most` heaviest edges at any of ids, ties by src, dst and kind."""
    known = ids.select("id")
    at = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")).distinct()
    return at.orderBy(F.desc("weight"), "src", "dst", "kind").limit(most)


def co_occurrence(rows: DataFrame, group: str, most: int = 50) -> DataFrame:
    """All pairs of the first `most` ids of each group: the operator's own bound, so a group gives 1225 pairs at most."""
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy("id"))).where(F.col("_n") <= most).groupBy(group).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("src"), y.alias("dst")))))
    return first.select(F.explode(pairs).alias("p")).select("p.src", "p.dst", F.lit("cooc").alias("kind"), F.lit(1.0).alias("weight"))
