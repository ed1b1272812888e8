"""Evaluation: retrieval quality, intervals and exact tests, tool-call sweeps, token accounts."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .config import DEFAULT, Config
from .functions import rules
from .operators import retrieve


def _quality() -> list[Column]:
    """Aggregates of `best`, the rank of the first relevant hit, null where there is none; one before the first (a copy that comes before its query) counts without end, as in the SQL."""
    within = lambda n: F.round(F.avg(F.when(F.col("best") <= n, 1.0).otherwise(0.0)), 6).alias(f"recall_{n}")
    share = F.when(F.col("best") == 0, float("inf")).otherwise(1.0 / F.col("best"))
    return [within(1), within(3), F.round(F.avg(F.when(F.col("best") <= 10, share).otherwise(0.0)), 6).alias("mrr_10")]


def retrieval_quality(queries: DataFrame, gold_hits: DataFrame) -> DataFrame:
    """queries, recall_1, recall_3 and mrr_10 from the relevant hits (qid, rank from 1) of queries (qid)."""
    best = gold_hits.groupBy("qid").agg(F.min("rank").alias("best"))
    return queries.select("qid").join(best, "qid", "left").agg(F.count("*").alias("queries"), *_quality())


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the interval for a share of k, taken to the nearest whole number within 0 and n; 0 and 0 without trials."""
    p, zz = F.greatest(F.lit(0.0), F.least(n.cast("double"), F.bround(k.cast("double"), 0))) / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return tuple(F.when(n > 0, x).otherwise(0.0) for x in (F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)))


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided p of discordant counts."""
    n = b + c
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0


def wilcoxon_exact(differences: list[float]) -> tuple[float, float]:
    """The rank sum of the negative differences and its two-sided exact p; zeros left out, ties with mean ranks.

    Under the null each rank is negative or not with equal chance, so the number of
    ways to a sum is a coefficient of the product of 1 + x^rank over all ranks
    (ranks doubled, as means of two may be halves).
    """
    d = pd.Series([x for x in differences if x], dtype=float)
    if d.empty:
        return 0.0, 1.0
    ranks = (2 * d.abs().rank()).astype(int)
    ways = np.ones(1, object)
    for r in ranks:
        gap = np.zeros(r, object)
        ways = np.concatenate([ways, gap]) + np.concatenate([gap, ways])
    negative = int(ranks[d < 0].sum())
    tail = sum(ways[: min(negative, int(ranks.sum()) - negative) + 1])
    return negative / 2, min(1.0, float(Fraction(2 * tail, 2 ** len(d))))


def bootstrap_ci(values: list[float], rounds: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of 95% of the mean, from draws of Python's generator with this seed; 0 and 0 without values."""
    x, n, draw = np.asarray(values, float), len(values), random.Random(seed)
    if not n:
        return 0.0, 0.0
    means = np.array([x[np.fromiter((draw.randrange(n) for _ in range(n)), np.int64, n)].mean() for _ in range(rounds)])
    low, high = np.partition(means, [int(0.025 * rounds), int(0.975 * rounds)])[[int(0.025 * rounds), int(0.975 * rounds)]]
    return float(low), float(high)


def composite_tokens(fresh: Column, created: Column, read: Column, out: Column) -> Column:
    return fresh + 1.25 * created + 0.1 * read + out


def sweeps(calls: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least `least` consecutive search calls (session, at, search, bytes)."""
    w = W.partitionBy("session").orderBy("at")
    runs = calls.withColumn("_run", F.sum(F.when(F.col("search"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))).where("search")
    return runs.groupBy("session", "_run").agg(F.min("at").alias("first"), F.count("*").alias("calls"), F.sum("bytes").alias("bytes")).where(F.col("calls") >= least).drop("_run")


#: Tools whose calls make a sweep, bytes of a token, bytes that a call costs beside its answer.
SWEEP_TOOLS, TOKEN_BYTES, CALL_BYTES = ("Grep", "Glob", "Read"), 4, 200


def is_sweep_call(name: Column, limit: Column) -> Column:
    """Whether a call searches: one of the tools, and a Read only if it reads the whole file."""
    return name.isin(*SWEEP_TOOLS) & ((name != "Read") | limit.isNull())


def landed_sweeps(calls: DataFrame, least: int = 2) -> DataFrame:
    """session, first, calls, cost_bytes, landing, query of sweeps of calls (session, at, name, limit, file_path, pattern, path, bytes) that end up in a file.

    landing is the file of the last Read, and a sweep without one is left out.
    query is what was looked for: the distinct patterns or paths in order, and the
    landing's name without its suffix, cut at 200.
    """
    w = W.partitionBy("session").orderBy("at")
    search = is_sweep_call(F.col("name"), F.col("limit"))
    runs = calls.withColumn("_run", F.sum(F.when(search, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))).where(search)
    sought = F.coalesce(F.when(F.col("pattern") != "", F.col("pattern")), F.when(F.col("path") != "", F.col("path")))
    found = runs.groupBy("session", "_run").agg(
        F.min("at").alias("first"), F.count("*").alias("calls"), F.sum("bytes").alias("cost_bytes"), F.max_by("file_path", F.when((F.col("name") == "Read") & F.col("file_path").isNotNull(), F.col("at"))).alias("landing"),
        F.transform(F.array_sort(F.collect_list(F.when(sought.isNotNull(), F.struct("at", sought.alias("t"))))), lambda x: x["t"]).alias("terms"),
    )
    stem = F.regexp_replace(F.regexp_extract("landing", "([^/]*)$", 1), r"\.[^.]*$", "")
    words = F.when((stem == "") | F.array_contains("terms", stem), F.array().cast("array<string>")).otherwise(F.array(F.regexp_replace(stem, "[_-]", " ")))
    query = F.substring(F.array_join(F.concat(F.array_distinct("terms"), words), " "), 1, 200)
    return found.where((F.col("calls") >= least) & F.col("landing").isNotNull()).select("session", "first", "calls", "cost_bytes", "landing", query.alias("query"))


def credit(sweeps: DataFrame, hits: DataFrame) -> DataFrame:
    """What the index would have saved: sweeps (sweep, landing, cost_bytes) against hits (sweep, path, outline_bytes, body_bytes).

    A sweep counts if its landing ends in the path of a hit; its indexed cost is the
    outline, the body and two calls.
    """
    best = hits.groupBy("sweep").agg(F.collect_set("path").alias("paths"), F.max("outline_bytes").alias("outline_bytes"), F.max("body_bytes").alias("body_bytes"))
    rows = sweeps.join(best, "sweep", "left")
    met = F.coalesce(F.exists("paths", lambda p: (p != "") & F.col("landing").endswith(p)), F.lit(False))
    indexed = F.coalesce("outline_bytes", F.lit(0)) + F.coalesce("body_bytes", F.lit(0)) + 2 * CALL_BYTES
    tokens = lambda b: F.floor(b / TOKEN_BYTES)
    return rows.select("sweep", met.alias("creditable"), tokens(F.col("cost_bytes")).alias("actual_tokens"), tokens(indexed).alias("indexed_tokens"), F.when(met, tokens(F.col("cost_bytes") - indexed)).otherwise(0).alias("saved_tokens"))


def replay_totals(credits: DataFrame) -> DataFrame:
    """One row: sweeps, creditable ones, tokens spent, tokens that the index would have saved."""
    return credits.agg(F.count("*").alias("sweeps"), F.sum(F.col("creditable").cast("long")).alias("creditable"), F.sum("actual_tokens").alias("actual_tokens"), F.sum("saved_tokens").alias("saved_tokens"))


def average_ranks(rows: DataFrame, by: str, value: str) -> DataFrame:
    """rows with `rank` of the value within `by`, ties at the mean of their ranks."""
    place, ties = F.rank().over(W.partitionBy(by).orderBy(value)), F.count("*").over(W.partitionBy(by, value))
    return rows.withColumn("rank", place + (ties - 1) / 2.0)


def evaluate_stm(facts: DataFrame, queries: DataFrame, now: float, c: Config = DEFAULT, weights: tuple[float, ...] = (1.0, 0.5, 0.0)) -> DataFrame:
    """weight, and queries, recall_1, recall_3, mrr_10 at it, of queries (qid, q, gold: ids) over facts with vectors, ranked by priority without a gate.

    Facts and queries meet once, in the tasks that read the facts; ten of each query and weight leave a task.
    """
    found = retrieve.batch_priority(facts, queries, now, weights, 10, c)
    gold = queries.select("qid", F.explode("gold").alias("id"))
    best = found.join(gold, ["qid", "id"]).groupBy("weight", "qid").agg(F.min("rank").alias("best"))
    asked = queries.select("qid", F.explode(F.array(*map(F.lit, weights))).alias("weight"))
    return asked.join(best, ["weight", "qid"], "left").groupBy("weight").agg(F.count("*").alias("queries"), *_quality())


def evaluate(facts: DataFrame, queries: DataFrame, now: float, c: Config = DEFAULT) -> DataFrame:
    """evaluate_stm() at the settings' own weight: queries, recall_1, recall_3, mrr_10."""
    return evaluate_stm(facts, queries, now, c, (c.stm_recall_weight,)).drop("weight")


def mine(facts: DataFrame, least: int = 40, most: int = 500, pool: int = 20_000, same: float = 0.9, topic: float = 0.6, own: str = "") -> DataFrame:
    """Facts for a test corpus: project_key, id, place, cluster, flags, and the reason of those left out (`dropped`).

    Active facts of a project, newest first, are taken unless they are short, speak of
    measurements or are nearly one taken before, until there are `most`; each joins
    the first cluster whose leader is near, or leads one.  The newest `pool` facts of
    a project that aren't short or contaminated take part, the operator's own bound.
    """
    body = F.trim("text")
    reason = F.when(F.length(body) < least, "short").when(rules.contamination(body).isNotNull(), "contaminated")
    rows = facts.where("status = 'active' and kind = 'fact'").withColumns({"dropped": reason, "seen": F.coalesce("last_seen", "created_at"), "flags": rules.privacy_flags(body, own)})
    order = W.partitionBy("project_key").orderBy(F.desc("seen"), F.asc("id"))
    good = rows.where("dropped is null").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= pool)
    kind = facts.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        v = np.stack(pdf["vec"].to_list()).astype(float)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(size > 0, size, 1)
        kept, leaders, out = [], [], []
        for i, id_ in enumerate(pdf["id"].tolist()):
            if len(kept) >= most:
                break
            if kept and (np.round(v[kept] @ v[i], 6) >= same).any():
                out.append((id_, None, None, "duplicate"))
                continue
            near = np.flatnonzero(np.round(v[leaders] @ v[i], 6) >= topic) if leaders else []
            cluster = int(near[0]) if len(near) else len(leaders)
            leaders += [i] * (not len(near))
            out.append((id_, len(kept), cluster, None))
            kept.append(i)
        return pd.DataFrame(out, columns=["id", "place", "cluster", "dropped"]).astype({"place": "Int64", "cluster": "Int64"}).assign(project_key=pdf["project_key"].iloc[0])

    taken = good.select("project_key", "id", "vec", "_n").groupBy("project_key").applyInPandas(run, f"id {kind}, place long, cluster long, dropped string, project_key string")
    lost = rows.where("dropped is not null").select("id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("cluster"), "dropped", "project_key")
    return taken.unionByName(lost).join(rows.select("id", "flags"), "id")
