"""Search over chunks: two fused channels, the prompt's index block, freshness of what was indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from . import pack
from .retrieve import fuse, top, with_similarity


def search(chunks: DataFrame, vector: Column | DataFrame, hits: DataFrame, k: int = 10, c: Config = DEFAULT, counted: bool = False) -> DataFrame:
    """id, source_path, score (and matched, the number of chunks in the pools, if counted) of chunks (id, source_path, vec) by similarity and keyword hits (id, bm25), spread over sources.

    Each channel gives its pool of the best 4k, at least 40; equal similarities come by id from the largest.
    """
    pool = max(4 * k, 40)
    near = with_similarity(chunks.select("id", "vec"), vector).orderBy(F.desc("sim"), F.desc("id")).limit(pool)
    near = near.select(F.lit("similarity").alias("channel"), "id", F.row_number().over(W.orderBy(F.desc("sim"), F.desc("id"))).alias("rank"))
    words = hits.orderBy("bm25", "id").limit(pool)
    words = words.select(F.lit("fts").alias("channel"), "id", F.row_number().over(W.orderBy("bm25", "id")).alias("rank"))
    fused = fuse(near.unionByName(words), c.index_weights, c.smoothing).join(chunks.select("id", "source_path"), "id")
    spread = pack.diverse(fused.withColumn("all", F.lit(0)), ["all"], "score", "source_path", c.per_file_cap)
    best = top(spread, "diverse", k).select("id", "source_path", "score", "diverse", "rank")
    return best.crossJoin(fused.agg(F.count("*").alias("matched"))) if counted else best


def prompt_block(chunks: DataFrame, vector: Column | DataFrame, hits: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The few lines that a prompt gets: keyword hits, best by similarity over the gate, within the budget, lines cut at 200."""
    pool = hits.orderBy("bm25", "id").limit(max(c.index_top_k * 6, 12)).select("id")
    near = with_similarity(chunks.join(F.broadcast(pool), "id"), vector).where(F.col("sim") >= c.index_min_sim)
    best = top(near, "sim", c.index_top_k).withColumn("line", F.substring("title", 1, 200)).withColumn("cost", F.length("line") + 3).withColumn("all", F.lit(0))
    return pack.prefix(best, ["all"], ["rank"], "cost", c.index_max_chars, first_free=True).select("id", "sim", "line", "used")


def freshness(chunks: DataFrame, live: DataFrame, now: float, snapshot_age: float = 86_400) -> DataFrame:
    """chunks with `state`: of a file section fresh, edited, gone (its anchor) or stale (its file); of a snapshot fresh or stale by age.

    live: source_path, anchor, content_hash of the files as they are.
    """
    files = live.select("source_path").distinct().withColumn("_file", F.lit(1))
    sections = live.select("source_path", "anchor", F.col("content_hash").alias("_now"))
    out = chunks.join(files, "source_path", "left").join(sections, ["source_path", "anchor"], "left")
    of_file = F.when(F.col("_file").isNull(), "stale").when(F.col("_now").isNull(), "gone").when(F.col("_now") == F.col("content_hash"), "fresh").otherwise("edited")
    of_page = F.when(F.col("indexed_at") >= now - snapshot_age, "fresh").otherwise("stale")
    return out.withColumn("state", F.when(F.col("kind") == "snapshot", of_page).otherwise(of_file)).drop("_file", "_now")


def warnings(actions: DataFrame, rules: DataFrame, least: int = 2, most: int = 600) -> DataFrame:
    """action_id, id, shared of rules (id, text, tokens) that share at least `least` tokens with actions (action_id, tokens), within the budget.

    Joined by token, so an action meets only rules with a word in common.
    """
    a = actions.select("action_id", F.explode(F.array_distinct("tokens")).alias("t"))
    r = rules.select("id", F.explode(F.array_distinct("tokens")).alias("t"))
    shared = a.join(r, "t").groupBy("action_id", "id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    cost = shared.join(rules.select("id", (F.length("text") + 3).alias("cost")), "id")
    return pack.prefix(cost, ["action_id"], [F.desc("shared"), F.asc("id")], "cost", most, first_free=True).select("action_id", "id", "shared")
