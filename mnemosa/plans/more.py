"""Queries on the index, the whole store and the embedder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import admin, fts, graph, index
from ..sources.views import EDGES, FACTS, HAS_VECTOR, facts, table, vectors, view, with_vectors
from .recall import _ASKED, COS, TOKENS, _bm25_sql, _query_vector
from .registry import query


@query("SELECT avg(len(embedding) + ceil(len(embedding) / 8.0)) AS bytes FROM embeddings")
def bytes_per_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.bytes_per_fact(vectors(spark, sf_dir))


@query(f"""WITH c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i % 8 = 0 THEN 0.0 ELSE x END) AS w FROM embeddings WHERE vec_id < 16),
s AS (SELECT round(avg({COS.format('v', 'w')}), 6) AS similarity FROM c) SELECT CASE WHEN similarity < 0.95 THEN 'drift' ELSE 'ok' END AS status, similarity FROM s""")
def embedder_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).where("vec_id < 16").select(F.col("vec_id").alias("id"), F.lit("hash").alias("model"), "vec")
    return admin.drift(v, v.withColumn("vec", F.transform("vec", lambda x, i: F.when((i + 1) % 8 == 0, 0.0).otherwise(x))))


@query(f"""WITH f AS ({FACTS}), g AS ({EDGES}), u AS (SELECT src, dst, kind FROM g GROUP BY ALL), k AS (SELECT id FROM f WHERE project_key <> 'src1')
SELECT 'facts' AS name, count(*) AS removed FROM f WHERE project_key = 'src1' UNION ALL SELECT 'edges', count(*) FROM u WHERE src NOT IN (SELECT id FROM k) OR dst NOT IN (SELECT id FROM k)
UNION ALL SELECT 'cursors', count(*) FROM (SELECT DISTINCT concat(source, ':', lang) AS c FROM documents) WHERE c LIKE 'src1:%'""")
def delete_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", "lang").alias("cursor_key")).distinct()
    return admin.delete_project({"facts": facts(spark, sf_dir), "edges": graph.upsert(view(spark, sf_dir, EDGES, "conversations")), "cursors": cursors}, "src1")[1]


@query("""WITH s AS (SELECT conv_id, sum(length(text)) AS size, CASE WHEN conv_id % 3 > 0 THEN conv_id * 40 END AS off FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS cursor_key, CAST(CASE WHEN coalesce(off, 0) > size THEN 0 ELSE coalesce(off, 0) END AS BIGINT) AS start, CAST(size AS BIGINT) AS "end" FROM s WHERE size - CASE WHEN coalesce(off, 0) > size THEN 0 ELSE coalesce(off, 0) END >= 1000""")
def capture_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("size"))
    cursors = sizes.where("conv_id % 3 > 0").select(F.col("conv_id").cast("string").alias("cursor_key"), (F.col("conv_id") * 40).alias("offset"))
    return admin.due_for_summary(cursors, sizes.select(F.col("conv_id").cast("string").alias("cursor_key"), "size"), 1000)


_CHUNKS = "SELECT doc_id AS id, concat('file', doc_id % 25) AS source_path, text, split_part(text, chr(10), 1) AS title FROM documents"
_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "concat('file', doc_id % 25) as source_path", "text", "split_part(text, chr(10), 1) as title")
    hits = fts.bm25(d, spark.range(1).select(F.col("id").alias("qid"), F.lit(_ASKED).alias("query")), {"text": 1.0}).select("id", "bm25")
    return with_vectors(d, spark, sf_dir).drop("label"), hits


@query(_bm25_sql(_CHUNKS, f"SELECT 0 AS qid, '{_ASKED}' AS query", {"text": 1.0}, f""", {_Q},
s AS (SELECT d.*, round({COS.format('CAST(embedding AS DOUBLE[])', 'q')}, 6) AS sim FROM d {HAS_VECTOR}, q),
c AS (SELECT 1.0 AS w, id, row_number() OVER (ORDER BY sim DESC, id DESC) AS rank FROM s UNION ALL SELECT 0.8, id, row_number() OVER (ORDER BY bm25, id) FROM b),
f AS (SELECT id, source_path, round(sum(w / (60 + rank)), 6) AS score FROM c JOIN s USING (id) WHERE rank <= 40 GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY score DESC, id) - 1 AS n FROM f)
SELECT id, source_path, score, round(score * power(0.5, n), 6) AS diverse FROM n WHERE n < 3 ORDER BY diverse DESC, id LIMIT 10"""))
def index_search_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, hits = _chunks(spark, sf_dir)
    return index.search(chunks, _query_vector(spark, sf_dir), hits).select("id", "source_path", "score", "diverse")


@query(_bm25_sql(_CHUNKS, f"SELECT 0 AS qid, '{_ASKED}' AS query", {"text": 1.0}, f""", {_Q},
p AS (SELECT id FROM b ORDER BY bm25, id LIMIT 12),
s AS (SELECT d.id, substr(title, 1, 200) AS line, round({COS.format('CAST(embedding AS DOUBLE[])', 'q')}, 6) AS sim FROM p JOIN d USING (id) {HAS_VECTOR}, q),
k AS (SELECT *, row_number() OVER (ORDER BY sim DESC, id) AS n FROM s WHERE sim >= 0.0), u AS (SELECT *, sum(length(line) + 3) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS used FROM k WHERE n <= 2)
SELECT id, sim, line, CAST(used AS BIGINT) AS used FROM u WHERE used <= 400 OR n = 1"""))
def prompt_index_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    from ..config import DEFAULT

    chunks, hits = _chunks(spark, sf_dir)
    return index.prompt_block(chunks, _query_vector(spark, sf_dir), hits, replace(DEFAULT, index_min_sim=0.0))


@query("""WITH c AS (SELECT doc_id AS id, concat('f', doc_id % 300) AS source_path, CAST(doc_id AS VARCHAR) AS anchor, md5(text) AS h, CASE WHEN doc_id % 10 = 0 THEN 'snapshot' ELSE 'doc_section' END AS kind, doc_id * 100.0 AS indexed_at FROM documents),
l AS (SELECT source_path, anchor, CASE WHEN id % 4 = 0 THEN 'x' ELSE h END AS h FROM c WHERE id % 300 < 200 AND id % 7 <> 0)
SELECT id, CASE WHEN kind = 'snapshot' THEN CASE WHEN indexed_at >= 100000 - 86400 THEN 'fresh' ELSE 'stale' END WHEN source_path NOT IN (SELECT source_path FROM l) THEN 'stale' WHEN l.h IS NULL THEN 'gone' WHEN l.h = c.h THEN 'fresh' ELSE 'edited' END AS state
FROM c LEFT JOIN l USING (source_path, anchor)""")
def chunk_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "concat('f', doc_id % 300) as source_path", "cast(doc_id as string) as anchor", "md5(text) as content_hash", "case when doc_id % 10 = 0 then 'snapshot' else 'doc_section' end as kind", "doc_id * 100.0D as indexed_at")
    live = c.where("id % 300 < 200 and id % 7 <> 0").selectExpr("source_path", "anchor", "case when id % 4 = 0 then 'x' else content_hash end as content_hash")
    return index.freshness(c, live, 100_000.0).select("id", "state")


@query(f"""WITH a AS (SELECT item_id AS action_id, list_distinct({TOKENS.format('text')}) AS t FROM benchmark), f AS ({FACTS}),
r AS (SELECT id, length(text) + 3 AS cost, list_distinct({TOKENS.format('text')}) AS t FROM f WHERE kind = 'antipattern' AND status = 'active'),
s AS (SELECT action_id, id, cost, len(list_intersect(a.t, r.t)) AS shared FROM a, r),
u AS (SELECT *, sum(cost) OVER w AS used, row_number() OVER w AS n FROM s WHERE shared >= 2 WINDOW w AS (PARTITION BY action_id ORDER BY shared DESC, id ROWS UNBOUNDED PRECEDING))
SELECT action_id, id, shared FROM u WHERE used <= 600 OR n = 1""")
def antipattern_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("action_id"), text.tokens(F.col("text")).alias("tokens"))
    rules = facts(spark, sf_dir).where("kind = 'antipattern' and status = 'active'").select("id", "text", text.tokens(F.col("text")).alias("tokens"))
    return index.warnings(actions, rules)
