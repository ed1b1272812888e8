"""Whole-store operations: deletion of a project, drift of the embedder, sizes, capture throttles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec


def delete_project(tables: dict[str, DataFrame], project: str, with_senses: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the project's rows, and a table of name, removed.

    Tables with project_key lose its rows (sensory only on request); cursors those
    whose key begins with the project; edges those whose end is no fact any more.
    """
    left, counts = {}, None
    for name, df in tables.items():
        if name == "cursors":
            left[name] = df.where(~F.col("cursor_key").startswith(f"{project}:"))
        elif name != "edges" and "project_key" in df.columns and (name != "sensory" or with_senses):
            left[name] = df.where(~F.col("project_key").eqNullSafe(F.lit(project)))
        else:
            left[name] = df
    if "edges" in tables and "facts" in left:
        ids = left["facts"].select("id")
        left["edges"] = tables["edges"].join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n")).crossJoin(left[name].agg(F.count("*").alias("m"))).select(F.lit(name).alias("name"), (F.col("n") - F.col("m")).alias("removed"))
        counts = n if counts is None else counts.unionByName(n)
    return left, counts


def drift(pinned: DataFrame, current: DataFrame, least: float = 0.95) -> DataFrame:
    """status and similarity of an embedder: pinned and current are (id, model, vec) of the same canary texts."""
    both = pinned.select("id", F.col("model").alias("_m"), F.col("vec").alias("_v")).join(current, "id", "full")
    one = both.agg(
        F.count("_v").alias("pinned"), F.max(F.when(F.size("_v") != F.size("vec"), 1).otherwise(0)).alias("dim"), F.max(F.when(F.col("_m") != F.col("model"), 1).otherwise(0)).alias("other"),
        F.avg(F.when(F.size("_v") == F.size("vec"), vec.cosine(F.col("_v"), F.col("vec")))).alias("similarity"),
    )
    status = F.when(F.col("pinned") == 0, "unpinned").when(F.col("dim") == 1, "dim_changed").when(F.col("other") == 1, "model_changed").when(F.col("similarity") < least, "drift").otherwise("ok")
    return one.select(status.alias("status"), F.round("similarity", 6).alias("similarity"))


def bytes_per_fact(vectors: DataFrame) -> DataFrame:
    """Mean bytes of the quantised vector and its sign bits."""
    return vectors.agg(F.avg(F.size("vec") + F.ceil(F.size("vec") / 8)).alias("bytes"))


def due_for_summary(cursors: DataFrame, sizes: DataFrame, least: int = 8000, force: bool = False) -> DataFrame:
    """Sessions (cursor_key, size) that grew by at least `least` since their cursor; a smaller file was replaced and counts whole."""
    seen = sizes.join(cursors.select("cursor_key", "offset"), "cursor_key", "left").withColumn("offset", F.coalesce("offset", F.lit(0)))
    start = F.when(F.col("offset") > F.col("size"), 0).otherwise(F.col("offset"))
    grown = seen.select("cursor_key", start.cast("long").alias("start"), F.col("size").alias("end"))
    return grown if force else grown.where(F.col("end") - F.col("start") >= least)
