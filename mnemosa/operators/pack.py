"""Packing of ranked rows into a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _running(by: list[str], order: list, cost: str):
    return F.sum(cost).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def prefix(rows: DataFrame, by: list[str], order: list, cost: str, most: int, head: int = 0, first_free: bool = False) -> DataFrame:
    """Rows up to the first that overflows the budget; the first row always if first_free."""
    kept = rows.withColumn("used", _running(by, order, cost) + head)
    number = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    fits = F.col("used") <= most
    return kept.withColumn("_n", number).where(fits | (F.col("_n") == 1) if first_free else fits).drop("_n")


def _can_fit(rows: DataFrame, by: list[str], order: str, cost: str, most: int, id_: str) -> DataFrame:
    """All rows that skip() can keep: of each cost c the first most / c.

    A row of cost c that fits has before it only kept rows of the same cost, as each
    met no more used than it did.  So later ones never fit, however large the group.
    The first row stays, as the first of its cost; costs over the budget count as
    one.  Each input partition leaves its own first rows before a cost is one task.
    """
    size = F.least(F.col(cost).cast("long"), F.lit(most + 1))
    places = F.when(size <= 0, F.lit(2**62)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(most) / size)).cast("long"))
    kept = rows.withColumns({"_size": size, "_part": F.spark_partition_id()}).withColumn("_places", F.coalesce(places, F.lit(1)))
    for keys in ([*by, "_size", "_part"], [*by, "_size"]):
        at = F.row_number().over(W.partitionBy(*keys).orderBy(F.struct(order, id_, cost)))
        kept = kept.withColumn("_n", at).where(F.col("_n") <= F.col("_places"))
    return kept.drop("_size", "_part", "_places", "_n")


def skip(rows: DataFrame, by: list[str], order: str, cost: str, most: int, id_: str = "id") -> DataFrame:
    """by, id and used of rows that fit, leaving out those that don't; the first always.  Of any group the fold holds at most most / c rows of each cost c (all of cost 0, which always fit)."""
    kind = rows.schema[id_].dataType.simpleString()
    rows = _can_fit(rows, by, order, cost, most, id_)
    items = F.array_sort(F.collect_list(F.struct(order, id_, F.col(cost).cast("long").alias("cost"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<id:{kind},used:bigint>>").alias("kept"))

    def take(acc, x):
        used = acc["used"] + x["cost"]
        fits = (used <= most) | (F.size(acc["kept"]) == 0)
        more = F.concat(acc["kept"], F.array(F.struct(x[id_].alias("id"), used.alias("used"))))
        return F.struct(F.when(fits, used).otherwise(acc["used"]).alias("used"), F.when(fits, more).otherwise(acc["kept"]).alias("kept"))

    folded = rows.groupBy(*by).agg(items.alias("items")).select(*by, F.aggregate("items", start, take)["kept"].alias("kept"))
    return folded.select(*by, F.explode("kept").alias("k")).select(*by, "k.id", "k.used")


def scaffold(rows: DataFrame, by: list[str], order: list, cost: str, most: int, title: str = "title") -> DataFrame:
    """Rows under headings in order of first appearance ("Notes" without a title); an overflowing row ends its own heading only."""
    named = rows.withColumn("heading", F.coalesce(title, F.lit("Notes")))
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    named = named.withColumn("_at", place).withColumn("_first", F.min("_at").over(W.partitionBy(*by, "heading")))
    used = F.sum(cost).over(W.partitionBy(*by).orderBy("_first", "_at").rowsBetween(W.unboundedPreceding, 0))
    over = F.max(F.when(F.col("used") > most, 1).otherwise(0)).over(W.partitionBy(*by, "heading").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    return named.withColumn("used", used).withColumn("_over", over).where("_over = 0").drop("_over", "_first", "_at")


def block(rows: DataFrame, by: list[str], order: str, text: str, header: str) -> DataFrame:
    """One text for each group: the header and a line for each row."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.concat(F.lit("- "), x[text]))
    return rows.groupBy(*by).agg(F.array_join(F.concat(F.array(F.lit(header)), lines), "\n").alias("block"))


def diverse(rows: DataFrame, by: list[str], score: str, path: str, cap: int) -> DataFrame:
    """Scores halved for each better row of the same path; rows beyond cap of a path go."""
    n = F.row_number().over(W.partitionBy(*by, path).orderBy(F.desc(score), F.asc("id"))) - 1
    return rows.withColumn("_n", n).where(F.col("_n") < cap).withColumn("diverse", F.round(F.col(score) * F.pow(F.lit(0.5), F.col("_n")), 6)).drop("_n")
