"""Counts of projects, observations, ledgers and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _count(where: Column) -> Column:
    return F.sum(F.when(where, 1).otherwise(0))


def projects(facts: DataFrame) -> DataFrame:
    active = F.col("status") == "active"
    return facts.groupBy("project_key").agg(_count(active).alias("facts"), _count(active & (F.col("tier") == "stm")).alias("stm"), _count(active & (F.col("tier") == "ltm")).alias("ltm"), F.max("created_at").alias("newest"))


def cards(facts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Observations, newest first, a page of them: card, newest, and their facts (id, text, title, type, tier, created_at) in order of time."""
    name = F.coalesce("observation_id", F.col("id").cast("string")).alias("card")
    page = facts.groupBy("project_key", name).agg(F.max("created_at").alias("newest"), F.count("*").alias("n")).orderBy(F.desc("newest"), "card", "project_key").offset(offset).limit(limit)
    own = facts.withColumn("card", name).join(F.broadcast(page.select("project_key", "card")), ["project_key", "card"], "left_semi")
    rows = own.groupBy("project_key", "card").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "text", "title", "type", "tier"))).alias("facts"))
    return page.join(rows, ["project_key", "card"]).orderBy(F.desc("newest"), "card", "project_key")


def observation_cards(facts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Groups by observation, newest first, a page of them; ids of each in order."""
    name = F.coalesce("observation_id", F.col("id").cast("string")).alias("card")
    cards = facts.groupBy("project_key", name).agg(F.count("*").alias("n"), F.max("created_at").alias("newest"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    return cards.orderBy(F.desc("newest"), "card", "project_key").offset(offset).limit(limit)


def consolidation_counts(facts: DataFrame, queue: DataFrame) -> DataFrame:
    """Archived facts and queue rows by project, added up."""
    rows = facts.where("status <> 'active'").select("project_key").unionByName(queue.select("project_key"))
    return rows.groupBy("project_key").agg(F.count("*").alias("n"))


def supersede_counts(facts: DataFrame) -> DataFrame:
    return facts.where("superseded_by is not null").groupBy(F.col("superseded_by").alias("id")).agg(F.count("*").alias("n"))


def disambiguated(labels: DataFrame) -> DataFrame:
    """label (key, label, parent): with the parent where several keys share the label."""
    shared = F.count("*").over(W.partitionBy("label")) > 1
    return labels.withColumn("shown", F.when(shared, F.concat("label", F.lit(" ("), "parent", F.lit(")"))).otherwise(F.col("label")))


def recall_stats(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("project_key").agg(F.count("*").alias("total"), *(_count(F.col("verdict") == v).alias(v) for v in ("ok", "low_confidence", "no_memory", "embedding_mismatch")))


def usage_stats(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("project_key", "kind").agg(F.count("*").alias("n"), F.sum(F.coalesce("bytes_in", F.lit(0))).alias("bytes_in"), F.sum(F.coalesce("bytes_saved", F.lit(0))).alias("bytes_saved"))


def usage_summary(ledger: DataFrame) -> DataFrame:
    """Tokens spent and saved by project; four characters are a token, cut after each sum."""
    chars = lambda c, *kinds: F.floor(F.sum(F.when(F.col("kind").isin(*kinds), F.coalesce(c, F.lit(0))).otherwise(0)) / 4)
    g = ledger.groupBy("project_key").agg(
        chars("bytes_in", "inject_prompt").alias("cost_prompt"), chars("bytes_in", "inject_core").alias("cost_core"), _count(F.col("kind") == "inject_core").alias("n_core"),
        F.count("*").alias("recalls"), chars("bytes_saved", "pull_symbol", "pull_doc", "read_bounded").alias("saved_measured"), (_count(F.col("verdict") == "ok") * 1200).alias("saved_estimated"),
    )
    each = F.when(F.col("n_core") > 0, F.col("cost_core") / F.col("n_core")).otherwise(0.0)
    g = g.withColumn("cost", F.col("cost_prompt") + F.col("cost_core")).withColumn("adjusted", F.bround(F.col("cost_prompt") + 1.25 * F.col("cost_core") + 0.1 * each * F.col("recalls"), 0).cast("long"))
    return g.withColumn("net_measured", F.col("saved_measured") - F.greatest("cost", "adjusted")).withColumn("net", F.col("saved_measured") + F.col("saved_estimated") - F.col("cost"))


def chunk_projects(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Chunks and distinct sources by project, with the label of meta (project_key, label) where there is one."""
    g = chunks.groupBy("project_key").agg(F.count("*").alias("chunks"), F.countDistinct("source_path").alias("sources"), *([F.max("indexed_at").alias("indexed_at")] if "indexed_at" in chunks.columns else []))
    return g.join(meta, "project_key", "left").withColumn("label", F.coalesce("label", "project_key"))
