"""Ranking of facts for a query: priority search, rank fusion, spreading, confidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import scoring, text, vec
from ..store import checkpointed
from . import graph
from .best import PLACES, Best, unit

GLOBAL = "__global__"


def in_scope(project: str | None) -> Column:
    """Active facts of the project and global anti-patterns; all active ones without a project."""
    active = F.col("status") == "active"
    if project is None:
        return active
    return active & ((F.col("project_key") == project) | ((F.col("project_key") == GLOBAL) & (F.col("kind") == "antipattern")))


def _arrow_cosine(vectors: Column, query: Column) -> Column:
    """vec.cosine over Arrow batches, for very wide vectors."""
    @F.pandas_udf("double")
    def run(v: pd.Series, q: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        m, one = np.stack(v.to_list()).astype(float), np.asarray(q.iloc[0], float)
        size = np.linalg.norm(m, axis=1) * np.linalg.norm(one)
        return pd.Series(np.where(size > 0, m @ one / np.where(size > 0, size, 1), 0.0))

    return run(vectors, query)


#: Ways to score vectors: built-in functions, or numpy over Arrow batches.
SCORERS = {"sql": vec.cosine, "arrow": _arrow_cosine}


def with_similarity(facts: DataFrame, query: Column | DataFrame, scorer: str = "sql") -> DataFrame:
    """facts with sim to the query vector: a literal, or a one-row DataFrame with column q; vectors of another size are left out."""
    if isinstance(query, DataFrame):
        facts, query = facts.crossJoin(F.broadcast(query.limit(1))), F.col("q")
    same = F.size("vec") == F.size(query)
    return facts.where(same).withColumn("sim", F.round(SCORERS[scorer](F.col("vec"), query), 6))


def with_score(hits: DataFrame, now: float, c: Config = DEFAULT, penalty: float = 1.0, stm_weight: Column | None = None) -> DataFrame:
    """hits with the priority score; short-term facts count by the settings' weight, or by a column of hits."""
    age = F.lit(now) - F.coalesce("last_seen", "created_at")
    score = scoring.priority(F.col("sim"), scoring.recency_decay(age, c.half_life_days), scoring.frequency_boost(F.col("frequency")), c)
    tier = F.when(F.col("tier") == "stm", c.stm_recall_weight if stm_weight is None else stm_weight).otherwise(1.0)
    return hits.withColumn("score", F.round(score * penalty * tier, 6))


def top(df: DataFrame, score: str, k: int, *by: str) -> DataFrame:
    """The k best, of each `by` if there are any, ties by id, with rank from 1."""
    order = [F.desc(score), F.asc("id")]
    if by:
        return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def search(facts: DataFrame, query: Column | DataFrame, now: float, project: str | None = None, c: Config = DEFAULT, k: int | None = None, min_sim: float | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Facts over the similarity gate by priority; with cross_project, others fill up at nine tenths where there are fewer than k.

    With a spread weight, edges (src, dst, kind, weight) raise candidates that they join
    to other candidates; the heaviest 512 at any candidate are looked at.
    """
    if edges is not None and c.spread_weight > 0:
        return _search_spread(facts, query, now, project, c, k or c.top_k, c.min_sim if min_sim is None else min_sim, edges)
    k, gate = k or c.top_k, c.min_sim if min_sim is None else min_sim
    sims = with_similarity(facts.where(F.col("status") == "active"), query, c.scorer).where(F.col("sim") >= gate)
    own = with_score(sims.where(in_scope(project)), now, c)
    if not (c.cross_project and project is not None):
        return top(own, "score", k)
    other = with_score(sims.where(~in_scope(project)), now, c, 0.9)
    best = top(own, "score", k).drop("rank")
    few = best.agg(F.count("*").alias("n"))
    fill = top(other, "score", k).drop("rank").crossJoin(F.broadcast(few)).where(F.col("n") < k).drop("n")
    return top(best.unionByName(fill), "score", k)


def _search_spread(facts: DataFrame, query: Column | DataFrame, now: float, project: str | None, c: Config, k: int, gate: float, edges: DataFrame) -> DataFrame:
    sims = with_similarity(facts.where(F.col("status") == "active"), query, c.scorer).where(F.col("sim") >= gate)
    found = with_score(sims.where(in_scope(project)), now, c)
    if c.cross_project and project is not None:
        few = F.broadcast(found.agg(F.count("*").alias("_n")))
        found = found.unionByName(with_score(sims.where(~in_scope(project)), now, c, 0.9).crossJoin(few).where(F.col("_n") < k).drop("_n"))
    found = checkpointed(found)
    raised = spread(found.select("id", "score"), graph.neighbours(edges, found), c.spread_weight)
    return top(found.drop("score").join(raised.select("id", F.col("boosted").alias("score")), "id"), "score", k)


def fuse(ranked: DataFrame, weights: dict[str, float], smoothing: int = 60) -> DataFrame:
    """Weighted reciprocal ranks of ranked (channel, id, rank from 1); channels without a weight count once."""
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("channel")), F.lit(1.0))
    return ranked.groupBy("id").agg(F.round(F.sum(weight / (F.lit(smoothing) + F.col("rank"))), 6).alias("score"), F.count("*").alias("channels"))


#: Up to so many candidates a rank is one sort; beyond, it is a range partitioning and the counts of its parts.
ONE_SORT = 1_000_000


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place of each row in a total order, from 1, over any number of tasks and for keys of any type.

    Rows are dealt by ranges of the order and sorted in their task; the counts of the
    parts, one number a task, give where each begins.  The sorted rows are written
    first, so a task that runs again gives the same places.
    """
    place = F.monotonically_increasing_id()
    done = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["count"]) for r in done.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for at, n in sizes:
        starts.append((at, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return done.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + within + 1).drop("_at", "_part", "_start")


def with_ranks(candidates: DataFrame, one_sort: int = ONE_SORT) -> DataFrame:
    """candidates (id, sim, lexical, bm25, last_seen, frequency) with a rank for each channel that holds them, null elsewhere."""
    out = checkpointed(candidates)
    large = out.count() > one_sort
    orders = {"similarity": ("sim", F.col("sim") > 0, False), "lexical": ("lexical", F.col("lexical") > 0, False), "fts": ("bm25", F.col("bm25").isNotNull(), True), "recency": ("last_seen", F.lit(True), False), "frequency": ("frequency", F.lit(True), False)}
    for name, (by, held, up) in orders.items():
        order = [F.asc_nulls_last(by) if up else F.desc_nulls_last(by), F.asc("id")]
        out = numbered(out, order, "_rank") if large else out.withColumn("_rank", F.row_number().over(W.orderBy(*order)))
        out = out.withColumn(name, F.when(held, F.col("_rank"))).drop("_rank")
    return out


def search_fused(facts: DataFrame, vector: Column | DataFrame, query: str, hits: DataFrame, c: Config = DEFAULT, k: int | None = None, min_sim: float | None = None, pool: int | None = None) -> DataFrame:
    """Facts admitted by similarity, shared words or keyword hits, by fused ranks of five channels.

    hits (id, bm25) are those of the facts in scope; the best `pool` of them, by
    default max(4k, 50), take part.  A fact without a time of last sight counts by its creation, one
    without a frequency as seen once.
    """
    gate, k = c.min_sim if min_sim is None else min_sim, k or c.top_k
    best = hits.orderBy("bm25", "id").limit(pool or max(4 * k, 50)).select("id", "bm25")
    sims = with_similarity(facts.where(F.col("status") == "active"), vector, c.scorer)
    scored = sims.withColumn("lexical", text.overlap(text.tokens(F.col("text")), text.tokens(F.lit(query)))).join(F.broadcast(best), "id", "left")
    seen = F.coalesce("last_seen", "created_at") if "created_at" in facts.columns else F.col("last_seen")
    admitted = scored.where((F.col("sim") >= gate) | (F.col("lexical") > 0) | F.col("bm25").isNotNull())
    ranked = with_ranks(admitted.select("id", "sim", "lexical", "bm25", seen.alias("last_seen"), F.coalesce("frequency", F.lit(1)).alias("frequency")))
    names = ("similarity", "lexical", "fts", "recency", "frequency")
    part = lambda n: F.coalesce(F.lit(c.channel_weights.get(n, 1.0)) / (F.lit(c.smoothing) + F.col(n)), F.lit(0.0))
    score, held = part(names[0]), F.lit(0).cast("long")
    for n in names[1:]:
        score = score + part(n)
    for n in names:
        held = held + F.when(F.col(n).isNotNull(), 1).otherwise(0)
    return top(ranked.select("id", "sim", F.round(score, 6).alias("score"), held.alias("channels")), "score", k)


def spread(scored: DataFrame, edges: DataFrame, weight: float) -> DataFrame:
    """scored (id, score) with a boost to both ends of edges (src, dst, weight) that join two of them."""
    ids = scored.select("id")
    inner = edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src").join(ids.withColumnRenamed("id", "dst"), "dst")
    ends = inner.select(F.col("src").alias("id"), "weight").unionByName(inner.select(F.col("dst").alias("id"), "weight"))
    boost = ends.groupBy("id").agg((F.sum("weight") * weight).alias("boost"))
    return scored.join(boost, "id", "left").withColumn("boosted", F.round(F.col("score") + F.coalesce("boost", F.lit(0.0)), 6)).drop("boost")


def verdicts(hits: DataFrame, identity: float | None = 1.0, least: float = DEFAULT.recall_min_confidence) -> DataFrame:
    """qid, hits, top_sim, confidence and verdict of hits (qid, rank, sim) in the order of rank; with no identity, that of the first hit (a column)."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("sim")))
    two = hits.groupBy("qid").agg(F.count("id").alias("hits"), at(1).alias("first"), at(2).alias("second"), *([F.max(F.when(F.col("rank") == 1, F.col("identity"))).alias("identity")] if identity is None else []))
    trust = F.coalesce("identity", F.lit(0.6)) if identity is None else F.lit(identity)
    sure = two.withColumn("confidence", scoring.confidence(F.col("first"), F.col("second"), trust))
    verdict = F.when(F.col("hits") == 0, "no_memory").when(F.col("confidence") < least, "low_confidence").otherwise("ok")
    return sure.select("qid", "hits", F.col("first").alias("top_sim"), "confidence", verdict.alias("verdict"))


#: Rows of a block of facts that meets the queries.
ROWS = 2048


def _best_by_vector(queries: DataFrame, facts: DataFrame, k: int, weights: tuple[float, ...] | None, most: int, block: int) -> DataFrame | None:
    """qid, id, sim or score, and which weight: the k best facts of each query and weight in each task; None without queries."""
    kinds = {c: d.schema[c].dataType.simpleString() for c, d in (("qid", queries), ("id", facts))}
    schema, out = f"qid {kinds['qid']}, id {kinds['id']}, score double, weight double", None
    groups = max(1, -(-queries.count() // most))

    for g in range(groups):
        some = queries.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == g).select("qid", "q").toPandas()
        if not len(some):
            continue
        asked, names = unit(np.stack(some["q"].to_list()).astype(float)), some["qid"].to_numpy()

        def run(batches, asked=asked, names=names):
            found = [(w, Best(len(names), k)) for w in weights or (None,)]
            for whole in batches:
                for at in range(0, len(whole), ROWS):
                    b = whole.iloc[at : at + ROWS]
                    v, ids = unit(np.stack(b["vec"].to_list()).astype(float)).T, b["id"].to_numpy()
                    if weights:
                        base, slope, short = b["base"].to_numpy(float), b["slope"].to_numpy(float), b["short"].to_numpy(bool)
                    for start in range(0, len(names), block):
                        s = asked[start : start + block] @ v
                        if weights:
                            s = (np.round(s, PLACES) + 0.0) * slope + base
                        for w, best in found:
                            best.add(s if w is None or w == 1.0 else s * np.where(short, w, 1.0), ids, start)
            for w, best in found:
                q, i, s = best.rows()
                if len(q):
                    yield pd.DataFrame({"qid": names[q], "id": i, "score": s, "weight": w if w is not None else 1.0})

        part = facts.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def batch_topk(queries: DataFrame, facts: DataFrame, k: int, most: int = 1 << 16, block: int = 512) -> DataFrame:
    """qid, id, sim, rank: the k most similar facts (id, vec) of each query (qid, q).

    Queries are sent to all facts, at most about `most` at a time, dealt by a hash of
    qid; a task works on blocks of both and keeps its k best facts of each query over
    all its rows, and only those are merged.  All vectors have one size.
    """
    out = _best_by_vector(queries, facts.select("id", "vec"), k, None, most, block)
    if out is None:
        return top(queries.select("qid").crossJoin(facts.select("id")).limit(0).withColumn("sim", F.lit(0.0)), "sim", k, "qid")
    return top(out.select("qid", "id", F.col("score").alias("sim")), "sim", k, "qid")


#: Queries of a block and facts of a part that meet in one task when all rows ask all rows, about.
ASKED, MET = 1 << 15, 1 << 17


def all_topk(facts: DataFrame, k: int, asked: int = ASKED, met: int = MET, block: int = 512) -> DataFrame:
    """qid, id, sim, rank: the k most similar facts (id, vec) of each of them, which is one of its own hits.

    Rows are dealt by a hash of id, into blocks that ask and into parts that are asked; each block meets each part
    in a group of its own, so no row passes the driver, no group grows with the table, and k rows a query leave it.
    All vectors have one size.
    """
    n, kind = facts.count(), facts.schema["id"].dataType.simpleString()
    blocks, parts = max(4, -(-n // asked)), max(4, -(-n // met))
    of = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = facts.select(of(blocks, 1).alias("_b"), every(parts).alias("_p"), "id", "vec")
    right = facts.select(every(blocks).alias("_b"), of(parts, 2).alias("_p"), "id", "vec")

    def run(some: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        best, names = Best(len(some), k), some["id"].to_numpy()
        if len(some) and len(rows):
            q = unit(np.stack(some["vec"].to_list()).astype(float))
            for at in range(0, len(rows), ROWS):
                b = rows.iloc[at : at + ROWS]
                v, ids = unit(np.stack(b["vec"].to_list()).astype(float)), b["id"].to_numpy()
                for start in range(0, len(q), block):
                    best.add_products(q[start : start + block], v, ids, start)
        at, ids, s = best.rows()
        return pd.DataFrame({"qid": names[at], "id": ids, "sim": s})

    found = left.groupBy("_b", "_p").cogroup(right.groupBy("_b", "_p")).applyInPandas(run, f"qid {kind}, id {kind}, sim double")
    return top(found, "sim", k, "qid")


def batch_priority(facts: DataFrame, queries: DataFrame, now: float, weights: tuple[float, ...], k: int, c: Config = DEFAULT, most: int = 1 << 16, block: int = 512) -> DataFrame:
    """weight, qid, id, score, rank: the k active facts with vectors that come first by priority for each query (qid, q) and weight of short-term facts.

    As batch_topk; the parts of the score that no query changes are worked out before.
    """
    size = queries.select(F.max(F.size("q"))).first()[0] or 0
    age = F.lit(now) - F.coalesce("last_seen", "created_at")
    part = lambda sim: scoring.priority(F.lit(sim), scoring.recency_decay(age, c.half_life_days), scoring.frequency_boost(F.col("frequency")), c)
    rows = facts.where((F.col("status") == "active") & (F.size("vec") == size))
    rows = rows.select("id", "vec", F.coalesce(part(0.0), F.lit(-1e18)).alias("base"), F.lit(float(c.w_sim)).alias("slope"), F.coalesce(F.col("tier") == "stm", F.lit(False)).alias("short"))
    out = _best_by_vector(queries, rows, k, weights, most, block)
    if out is None:
        out = queries.select("qid").crossJoin(rows.select("id")).limit(0).withColumns({"score": F.lit(0.0), "weight": F.lit(1.0)})
    return top(out, "score", k, "weight", "qid")
