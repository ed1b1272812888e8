"""Queries on vectors, scores, keyword search and recall."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import scoring, text, vec
from ..operators import fts, graph, lifecycle, pack, retrieve
from ..sources.views import EDGES, FACTS, HAS_VECTOR, NOW, embedded_facts, facts, table, vectors, view
from .registry import query

COS = "coalesce(list_cosine_similarity({0}, {1}), 0.0)"
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains(" + STOP + ", t))"
DECAY = f"exp(greatest(0.0, {NOW} - last_seen) * (-ln(2) / 2592000.0))"
BOOST = "CASE WHEN frequency <= 1 THEN 0.0 ELSE least(1.0, ln(frequency) / ln(8)) END"
HITS = f"""WITH f AS ({FACTS}), q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
e AS MATERIALIZED (SELECT f.*, label, CAST(embedding AS DOUBLE[]) AS vec FROM f {HAS_VECTOR}),
s AS MATERIALIZED (SELECT e.*, round({COS.format('vec', 'q')}, 6) AS sim FROM e, q WHERE status = 'active'),
p AS (SELECT *, round(sim + 0.3 * {DECAY} + 0.2 * {BOOST}, 6) AS score FROM s)"""
GATE = 0.05


def _query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("vec_id = 0").select(F.col("vec").alias("q"))


@query(HITS + f" SELECT id, project_key, sim, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM p WHERE sim >= {GATE} ORDER BY score DESC, id LIMIT 20")
def recall_priority_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.search(embedded_facts(spark, sf_dir), _query_vector(spark, sf_dir), NOW, k=20, min_sim=GATE)
    return found.select("id", "project_key", "sim", "score", F.col("rank").cast("long").alias("rank"))


@query(HITS + f""", own AS (SELECT id, score FROM p WHERE sim >= {GATE} AND project_key = 'src3' ORDER BY score DESC, id LIMIT 20),
other AS (SELECT id, round((sim + 0.3 * {DECAY} + 0.2 * {BOOST}) * 0.9, 6) AS score FROM p WHERE sim >= {GATE} AND project_key <> 'src3' ORDER BY 2 DESC, 1 LIMIT 20)
SELECT * FROM (SELECT * FROM own UNION ALL SELECT * FROM other WHERE (SELECT count(*) FROM own) < 20) ORDER BY score DESC, id LIMIT 20""")
def recall_cross_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = replace(DEFAULT, cross_project=True)
    return retrieve.search(embedded_facts(spark, sf_dir), _query_vector(spark, sf_dir), NOW, "src3", c, 20, GATE).select("id", "score")


@query(HITS + f" SELECT id, round((sim + 0.3 * {DECAY} + 0.2 * {BOOST}) * CASE WHEN tier = 'stm' THEN 0.5 ELSE 1.0 END, 6) AS score FROM p WHERE sim >= {GATE} ORDER BY 2 DESC, 1 LIMIT 20")
def recall_stm_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = replace(DEFAULT, stm_recall_weight=0.5)
    return retrieve.search(embedded_facts(spark, sf_dir), _query_vector(spark, sf_dir), NOW, None, c, 20, GATE).select("id", "score")


@query(HITS + f""", g AS ({EDGES}), u AS (SELECT src, dst, kind, sum(weight) AS weight FROM g GROUP BY ALL),
c AS (SELECT id, score FROM p WHERE sim >= 0.0), i AS (SELECT u.* FROM u JOIN c a ON a.id = src JOIN c b ON b.id = dst),
b AS (SELECT id, sum(weight) * 0.1 AS boost FROM (SELECT src AS id, weight FROM i UNION ALL SELECT dst, weight FROM i) GROUP BY id)
SELECT id, score, round(score + coalesce(boost, 0.0), 6) AS boosted FROM c LEFT JOIN b USING (id)""")
def recall_spreading(spark: SparkSession, sf_dir: str) -> DataFrame:
    sims = retrieve.with_similarity(embedded_facts(spark, sf_dir).where("status = 'active'"), _query_vector(spark, sf_dir)).where("sim >= 0.0")
    scored = retrieve.with_score(sims, NOW).select("id", "score")
    return retrieve.spread(scored, graph.upsert(view(spark, sf_dir, EDGES, "conversations")), 0.1)


def _bm25_sql(docs: str, queries: str, columns: dict[str, float], final: str, keep: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT id, unnest(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')) AS term, {float(w)} AS w FROM d" for c, w in columns.items())
    return f"""WITH d AS ({docs}), qs AS ({queries}), t AS ({parts}),
post AS (SELECT id, term, sum(w) AS tf, count(*) AS n FROM t GROUP BY ALL), len AS (SELECT id, sum(n) AS length FROM post GROUP BY id),
st AS (SELECT (SELECT count(*) FROM d) AS docs, (SELECT sum(length) FROM len) AS tokens),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM qs) GROUP BY ALL),
df AS (SELECT term, count(*) AS holders FROM post GROUP BY term),
b AS (SELECT qid, id, round(-sum(CASE WHEN ln((docs - holders + 0.5) / (holders + 0.5)) > 0 THEN ln((docs - holders + 0.5) / (holders + 0.5)) ELSE 1e-6 END
  * times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (tokens / docs)))), 6) AS bm25
  FROM qt JOIN post USING (term) JOIN df USING (term) JOIN len USING (id), st {keep} GROUP BY qid, id) {final}"""


_TOP = "SELECT * FROM (SELECT qid, id, bm25, row_number() OVER (PARTITION BY qid ORDER BY bm25, id) AS rank FROM b) WHERE rank <= 10"


def _ranked_hits(hits: DataFrame) -> DataFrame:
    return retrieve.top(hits.withColumn("s", -F.col("bm25")), "s", 10, "qid").select("qid", "id", "bm25", F.col("rank").cast("long").alias("rank"))


@query(_bm25_sql("SELECT doc_id AS id, text FROM documents", "SELECT item_id AS qid, text AS query FROM benchmark", {"text": 1.0}, _TOP, "WHERE id IN (SELECT id FROM (" + FACTS + ") WHERE status = 'active')"))
def bm25_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "text")
    asked = table(spark, sf_dir, "benchmark").selectExpr("item_id as qid", "text as query")
    return _ranked_hits(fts.bm25(docs, asked, {"text": 1.0}, keep=facts(spark, sf_dir).where("status = 'active'"), k=10))


_CHUNK = "SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, source AS heading_path, substr(text, 1, 80) AS summary, text AS body FROM documents"
_WEIGHTS = {"title": 3.0, "heading_path": 2.0, "summary": 1.5, "body": 1.0}


@query(_bm25_sql(_CHUNK, "SELECT item_id AS qid, text AS query FROM benchmark", _WEIGHTS, _TOP))
def bm25_weighted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "split_part(text, chr(10), 1) as title", "source as heading_path", "substr(text, 1, 80) as summary", "text as body")
    return _ranked_hits(fts.bm25(chunks, table(spark, sf_dir, "benchmark").selectExpr("item_id as qid", "text as query"), _WEIGHTS, k=10))


@query()
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "text")
    return _ranked_hits(fts.bm25(docs, table(spark, sf_dir, "benchmark").selectExpr("item_id as qid", "text as query"), {"text": 1.0}, stem=True, k=10))


_ASKED = "the these than then rest thing attion"
_CHANNELS = """chan AS (
SELECT 1.0 AS w, id, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM c WHERE sim > 0 UNION ALL
SELECT 0.8, id, row_number() OVER (ORDER BY lexical DESC, id) FROM c WHERE lexical > 0 UNION ALL
SELECT 0.6, id, row_number() OVER (ORDER BY bm25, id) FROM c WHERE bm25 IS NOT NULL UNION ALL
SELECT 0.4, id, row_number() OVER (ORDER BY last_seen DESC, id) FROM c UNION ALL
SELECT 0.3, id, row_number() OVER (ORDER BY frequency DESC, id) FROM c)"""


@query(_bm25_sql("SELECT doc_id AS id, text FROM documents", f"SELECT 0 AS qid, '{_ASKED}' AS query", {"text": 1.0}, f""", f AS ({FACTS}),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT f.*, round({COS.format('CAST(embedding AS DOUBLE[])', 'q')}, 6) AS sim, len(list_intersect({TOKENS.format('text')}, {TOKENS.format("'" + _ASKED + "'")})) AS lexical
  FROM f {HAS_VECTOR}, q WHERE status = 'active'),
p AS (SELECT id, bm25 FROM b ORDER BY bm25, id LIMIT 100),
c AS (SELECT s.id, sim, lexical, bm25, last_seen, frequency FROM s LEFT JOIN p ON p.id = s.id WHERE sim >= 0.12 OR lexical > 0 OR bm25 IS NOT NULL), {_CHANNELS},
fu AS (SELECT id, round(sum(w / (60 + rank)), 6) AS score, count(*) AS channels FROM chan GROUP BY id)
SELECT id, score, channels, sim, row_number() OVER (ORDER BY score DESC, id) AS rank FROM fu JOIN c USING (id) ORDER BY score DESC, id LIMIT 25""", "WHERE id IN (SELECT id FROM (" + FACTS + ") WHERE status = 'active')"))
def recall_fused_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "text")
    asked = spark.range(1).select(F.col("id").alias("qid"), F.lit(_ASKED).alias("query"))
    hits = fts.bm25(docs, asked, {"text": 1.0}, keep=facts(spark, sf_dir).where("status = 'active'")).select("id", "bm25")
    found = retrieve.search_fused(embedded_facts(spark, sf_dir), _query_vector(spark, sf_dir), _ASKED, hits, k=25)
    return found.select("id", "score", "channels", "sim", F.col("rank").cast("long").alias("rank"))


@query("""WITH r AS (SELECT 'price' AS channel, o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders UNION ALL
SELECT 'lines', l_orderkey, row_number() OVER (ORDER BY count(*) DESC, l_orderkey) FROM lineitem GROUP BY l_orderkey)
SELECT id, round(sum(CASE channel WHEN 'price' THEN 2.0 ELSE 1.0 END / (60 + rank)), 6) AS score, count(*) AS channels FROM r WHERE rank <= 500 GROUP BY id""")
def rrf_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = retrieve.top(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("s")), "s", 500)
    lines = retrieve.top(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("s")), "s", 500)
    ranked = price.select(F.lit("price").alias("channel"), "id", "rank").unionByName(lines.select(F.lit("lines").alias("channel"), "id", "rank"))
    return retrieve.fuse(ranked, {"price": 2.0})


_TOPK = f"""WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, vec_id AS id, round({COS.format('q', 'CAST(embedding AS DOUBLE[])')}, 6) + 0.0 AS sim FROM q, embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s)"""


def _topk(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = vectors(spark, sf_dir)
    return retrieve.batch_topk(v.where("vec_id % 50 = 0").selectExpr("vec_id as qid", "vec as q"), v.selectExpr("vec_id as id", "vec"), k)


@query(_TOPK + " SELECT qid, id, sim, rank FROM k WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, 10).select("qid", "id", "sim", F.col("rank").cast("long").alias("rank"))


@query(_TOPK + """, t AS (SELECT qid, count(*) AS hits, max(sim) FILTER (rank = 2) AS a, max(sim) FILTER (rank = 3) AS b FROM k WHERE rank BETWEEN 2 AND 4 AND sim >= 0.3 GROUP BY qid),
c AS (SELECT qid, coalesce(hits, 0) AS hits, a AS top_sim, CASE WHEN a IS NULL THEN 0.0 ELSE round_even(exp(0.35 * ln(greatest(CASE WHEN a <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (a - coalesce(b, 0.0)) / a)) END, 1e-6))
  + 0.40 * ln(greatest(greatest(0.0, least(1.0, 1 - exp(-a / 0.5))), 1e-6)) + 0.25 * ln(0.7)), 3) END AS confidence FROM q LEFT JOIN t USING (qid))
SELECT qid, hits, top_sim, confidence, CASE WHEN hits = 0 THEN 'no_memory' WHEN confidence < 0.35 THEN 'low_confidence' ELSE 'ok' END AS verdict FROM c""")
def recall_structured_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _topk(spark, sf_dir, 4).where("rank >= 2 and sim >= 0.3").withColumn("rank", F.col("rank") - 1)
    asked = vectors(spark, sf_dir).where("vec_id % 50 = 0").selectExpr("vec_id as qid")
    return retrieve.verdicts(asked.join(hits, "qid", "left"), identity=0.7)


@query(f"""SELECT a.vec_id AS a, b.vec_id AS b, round({COS.format('CAST(a.embedding AS DOUBLE[])', 'CAST(b.embedding AS DOUBLE[])')}, 6) AS sim
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round({COS.format('CAST(a.embedding AS DOUBLE[])', 'CAST(b.embedding AS DOUBLE[])')}, 6) >= 0.3""")
def cosine_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.similar_pairs(vectors(spark, sf_dir).selectExpr("vec_id as id", "label", "vec"), 0.3, "label")


_MOST = "CASE WHEN list_max(list_transform(v, lambda x: abs(x))) > 0 THEN list_max(list_transform(v, lambda x: abs(x))) ELSE 1.0 END"


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT *, {_MOST} AS scale FROM v),
q AS (SELECT *, list_transform(v, lambda x: CAST(greatest(-127, least(127, round_even(x / scale * 127, 0))) AS INT)) AS q FROM s)
SELECT vec_id, round(scale, 6) AS scale, array_to_string(q, ',') AS quantised, round({COS.format('v', 'list_transform(q, lambda x: x / 127.0 * scale)')}, 6) AS kept FROM q""")
def quantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("scale", vec.scale_of(F.col("vec")))
    v = v.withColumn("q", vec.quantize_int8(F.col("vec"), F.col("scale")))
    kept = vec.cosine(F.col("vec"), vec.dequantize_int8(F.col("q"), F.col("scale")))
    return v.select("vec_id", F.round("scale", 6).alias("scale"), F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("quantised"), F.round(kept, 6).alias("kept"))


@query("""WITH b AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings),
q AS (SELECT bits AS q FROM b WHERE vec_id = 0)
SELECT vec_id, bits, CAST(hamming(bits, q) AS INT) AS distance FROM b, q""")
def sign_bits_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = vectors(spark, sf_dir).select("vec_id", vec.sign_bits(F.col("vec")).alias("bits"))
    one = b.where("vec_id = 0").select(F.col("bits").alias("q"))
    return b.crossJoin(F.broadcast(one)).select("vec_id", "bits", vec.hamming(F.col("bits"), F.col("q")).alias("distance"))


@query("""WITH h AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:16] AS h FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS n FROM h)
SELECT vec_id, round(list_sum(list_transform(h, lambda x: x / n * x / n)), 6) AS length, round(h[1] / n, 6) + 0.0 AS first FROM n""")
def truncate_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("vec_id", vec.truncate_renorm(F.col("vec"), 16).alias("h"))
    return v.select("vec_id", F.round(vec.total(F.transform("h", lambda x: x * x)), 6).alias("length"), (F.round(F.col("h")[0], 6) + F.lit(0.0)).alias("first"))


@query("""WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN embedding[1:32] ELSE embedding END AS v FROM embeddings)
SELECT id, round(coalesce(list_cosine_similarity(CAST(v AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)), 0.0), 6) AS sim FROM v WHERE len(v) = 64""")
def dim_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    mixed = v.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 5 == 0, F.slice("vec", 1, 32)).otherwise(F.col("vec")).alias("vec"))
    return retrieve.with_similarity(mixed, v.where("vec_id = 1").select(F.col("vec").alias("q"))).select("id", "sim")


@query("""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
p AS (SELECT item_id, CAST(('0x' || substr(md5(t), 1, 6)) AS BIGINT) % 64 AS i, CASE WHEN CAST(('0x' || substr(md5(t), 7, 1)) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END AS s FROM t),
v AS (SELECT item_id, k, coalesce(sum(s), 0) AS x FROM (SELECT item_id, unnest(range(64)) AS k FROM benchmark) LEFT JOIN p ON p.item_id = item_id_ AND i = k GROUP BY ALL)
SELECT item_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY k) AS vec FROM v GROUP BY item_id""".replace("(SELECT item_id, unnest(range(64)) AS k FROM benchmark)", "(SELECT item_id AS item_id_, unnest(range(64)) AS k FROM benchmark)").replace("v AS (SELECT item_id, k", "v AS (SELECT item_id_ AS item_id, k"))
def hash_embed_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(vec.hash_embed_md5(F.col("text")), lambda x: x.cast("string")), ",").alias("vec"))


@query()
def hash_embed_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors' places that aren't 0, as they would be stored."""
    v = table(spark, sf_dir, "documents").select("doc_id", vec.hash_embed(F.col("text")).alias("vec"))
    stored = F.transform(vec.quantize_int8(F.col("vec"), vec.scale_of(F.col("vec"))), lambda x, i: F.concat_ws(":", i.cast("string"), x.cast("string")))
    return v.select("doc_id", F.size("vec").alias("dim"), F.round(vec.norm(F.col("vec")), 6).alias("length"), F.array_join(F.filter(stored, lambda x: ~x.endswith(":0")), ",").alias("places"))


@query(f"""WITH f AS ({FACTS}) SELECT id, round({DECAY}, 6) AS decay, round({BOOST}, 6) AS boost, round(least(1.0, length(text) / 240.0), 6) AS importance,
round(CASE WHEN injected_count <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (injected_count - used_count) / injected_count)) END, 6) AS inhibition FROM f""")
def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.lit(NOW) - F.col("last_seen")
    return facts(spark, sf_dir).select("id", F.round(scoring.recency_decay(age, 30), 6).alias("decay"), F.round(scoring.frequency_boost(F.col("frequency")), 6).alias("boost"), F.round(scoring.importance(F.col("text")), 6).alias("importance"), F.round(scoring.inhibition(F.col("injected_count"), F.col("used_count")), 6).alias("inhibition"))


_HALF = "CASE WHEN {0} + 1 <= 1 THEN 0.0 ELSE least(1.0, ln({0} + 1) / ln(8)) END"


@query(f"""WITH f AS ({FACTS}), n AS (SELECT superseded_by AS id, count(*) AS n FROM f WHERE superseded_by IS NOT NULL GROUP BY 1)
SELECT id, round(0.3 * {_HALF.format('recall_count')} + 0.3 * {DECAY} + 0.1 * ((CASE WHEN title <> '' THEN 1.0 ELSE 0.0 END + CASE WHEN type IS NOT NULL THEN 1.0 ELSE 0.0 END) / 3)
+ 0.1 * {_HALF.format('coalesce(n, 0)')} + 0.2 * {BOOST}, 6) AS retention FROM f LEFT JOIN n USING (id)""")
def retention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.with_retention(facts(spark, sf_dir), NOW).select("id", "retention")


@query(f"""WITH f AS ({FACTS}) SELECT id, project_key, kind FROM f WHERE status = 'active' AND (project_key = 'src1' OR (project_key = '__global__' AND kind = 'antipattern'))""")
def global_union_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).where(retrieve.in_scope("src1")).select("id", "project_key", "kind")


_ROWS = f"WITH f AS ({FACTS}), r AS (SELECT id, project_key, last_seen, frequency, title, least(length(text), 240) + 3 AS cost FROM f WHERE status = 'active')"
_RUN = "sum(cost) OVER (PARTITION BY project_key ORDER BY frequency DESC, last_seen DESC, id ROWS UNBOUNDED PRECEDING)"


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).where("status = 'active'")
    return f.select("id", "project_key", "last_seen", "frequency", "title", (F.least(F.length("text"), F.lit(240)) + 3).alias("cost"))


_BEST = [F.desc, F.desc, F.asc]


def _order() -> list:
    return [F.desc("frequency"), F.desc("last_seen"), F.asc("id")]


@query(_ROWS + f", u AS (SELECT id, project_key, {_RUN} + 20 AS used FROM r) SELECT * FROM u WHERE used <= 800")
def pack_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.prefix(_costs(spark, sf_dir), ["project_key"], _order(), "cost", 800, 20).select("id", "project_key", "used")


@query(_ROWS + f", u AS (SELECT id, project_key, {_RUN} AS used, row_number() OVER (PARTITION BY project_key ORDER BY frequency DESC, last_seen DESC, id) AS n FROM r) SELECT id, project_key, used FROM u WHERE used <= 200 OR n = 1")
def pack_first_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.prefix(_costs(spark, sf_dir), ["project_key"], _order(), "cost", 200, first_free=True).select("id", "project_key", "used")


@query("WITH RECURSIVE " + _ROWS[5:] + """, o AS (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY id) AS n FROM r),
w AS (SELECT project_key, id, n, cost AS used, TRUE AS took FROM o WHERE n = 1 UNION ALL
SELECT o.project_key, o.id, o.n, CASE WHEN w.used + o.cost <= 1200 THEN w.used + o.cost ELSE w.used END, w.used + o.cost <= 1200 FROM w JOIN o ON o.project_key = w.project_key AND o.n = w.n + 1)
SELECT project_key, id, used FROM w WHERE took""")
def pack_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All active facts of each project."""
    return pack.skip(_costs(spark, sf_dir).withColumn("at", F.col("id")), ["project_key"], "at", "cost", 1200)


@query(_ROWS + """, h AS (SELECT *, coalesce(title, 'Notes') AS heading, row_number() OVER (PARTITION BY project_key ORDER BY frequency DESC, last_seen DESC, id) AS a FROM r),
g AS (SELECT *, min(a) OVER (PARTITION BY project_key, heading) AS f FROM h),
u AS (SELECT *, sum(cost) OVER (PARTITION BY project_key ORDER BY f, a ROWS UNBOUNDED PRECEDING) AS used FROM g),
v AS (SELECT *, max(CASE WHEN used > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY project_key, heading ORDER BY a ROWS UNBOUNDED PRECEDING) AS o FROM u)
SELECT project_key, heading, id, used FROM v WHERE o = 0""")
def pack_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.scaffold(_costs(spark, sf_dir), ["project_key"], _order(), "cost", 2000).select("project_key", "heading", "id", "used")


@query(_bm25_sql(_CHUNK.replace("AS body", "AS body, concat('file', doc_id % 40) AS path"), "SELECT item_id AS qid, text AS query FROM benchmark", _WEIGHTS, """,
k AS (SELECT qid, id, bm25, row_number() OVER (PARTITION BY qid ORDER BY bm25, id) AS rank FROM b), s AS (SELECT k.*, path, round(0.8 / (60 + rank), 6) AS score FROM k JOIN d USING (id) WHERE rank <= 40),
n AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY score DESC, id) - 1 AS n FROM s), v AS (SELECT qid, id, path, round(score * power(0.5, n), 6) AS diverse FROM n WHERE n < 3)
SELECT qid, id, path, diverse FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY diverse DESC, id) AS rank FROM v) WHERE rank <= 10"""))
def index_search_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "split_part(text, chr(10), 1) as title", "source as heading_path", "substr(text, 1, 80) as summary", "text as body", "concat('file', doc_id % 40) as path")
    hits = fts.bm25(chunks, table(spark, sf_dir, "benchmark").selectExpr("item_id as qid", "text as query"), _WEIGHTS, k=40)
    pool = retrieve.top(hits.withColumn("s", -F.col("bm25")), "s", 40, "qid").join(chunks.select("id", "path"), "id").withColumn("score", F.round(F.lit(0.8) / (F.lit(60) + F.col("rank")), 6)).drop("rank")
    return retrieve.top(pack.diverse(pool, ["qid"], "score", "path", 3), "diverse", 10, "qid").select("qid", "id", "path", "diverse")


@query(f"""WITH f AS ({FACTS}), k AS (SELECT project_key, id, frequency, last_seen, row_number() OVER (PARTITION BY project_key ORDER BY frequency DESC, last_seen DESC, id) AS rank FROM f WHERE status = 'active') SELECT * FROM k WHERE rank <= 5""")
def recall_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).where("status = 'active'").select("project_key", "id", "frequency", "last_seen")
    from pyspark.sql import Window as W

    return f.withColumn("rank", F.row_number().over(W.partitionBy("project_key").orderBy(*_order()))).where("rank <= 5")


@query(f"WITH f AS ({FACTS}) SELECT project_key, arg_max(id, created_at * 1000000 + id) AS id, max(created_at) AS created_at FROM f WHERE kind = 'session_summary' AND status = 'active' GROUP BY project_key")
def latest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).where("kind = 'session_summary' and status = 'active'")
    return f.groupBy("project_key").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("created_at"))


_EVAL = HITS.split("q AS (SELECT", 1)[0] + f"""e AS (SELECT f.*, label, CAST(embedding AS DOUBLE[]) AS vec FROM f {HAS_VECTOR}), q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 7),
p AS (SELECT qid, id, tier, round({COS.format('vec', 'q')}, 6) + 0.3 * {DECAY} + 0.2 * {BOOST} AS score FROM e, q WHERE status = 'active'), w AS (SELECT unnest([1.0, 0.5, 0.0]) AS weight),
r AS (SELECT weight, qid, id, row_number() OVER (PARTITION BY weight, qid ORDER BY round(score * CASE WHEN tier = 'stm' THEN weight ELSE 1.0 END, 6) DESC, id) AS rank FROM p, w),
g AS (SELECT weight, qid, min(rank) AS best FROM r WHERE rank <= 10 AND id IN (qid, qid + 1, qid + 2) GROUP BY ALL)"""


@query(_EVAL + """ SELECT CAST(weight AS DOUBLE) AS weight, count(*) AS queries, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(coalesce(1.0 / best, 0.0)), 6) AS mrr_10
FROM (SELECT weight, qid FROM w, q) LEFT JOIN g USING (weight, qid) GROUP BY weight""")
def evaluate_stm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of three facts by each query, with less and less weight on the short term."""
    from .. import evalkit

    v = vectors(spark, sf_dir)
    asked = v.where("vec_id % 50 = 7").select(F.col("vec_id").alias("qid"), F.col("vec").alias("q"), F.array(F.col("vec_id"), F.col("vec_id") + 1, F.col("vec_id") + 2).alias("gold"))
    return evalkit.evaluate_stm(embedded_facts(spark, sf_dir), asked, NOW)


@query(_TOPK.replace(" WHERE vec_id % 50 = 0", "") + """, g AS (SELECT k.qid, min(k.rank) AS best FROM k JOIN embeddings a ON a.vec_id = k.qid JOIN embeddings b ON b.vec_id = k.id WHERE k.id <> k.qid AND a.label = b.label AND k.rank <= 11 GROUP BY k.qid)
SELECT count(*) AS queries, round(avg(CASE WHEN best <= 2 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN best <= 4 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(coalesce(1.0 / (best - 1), 0.0)), 6) AS mrr_10
FROM q LEFT JOIN g USING (qid)""")
def recall_at_k_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a query, so all pairs are scored."""
    from .. import evalkit

    labels = vectors(spark, sf_dir).select("vec_id", "label")
    hits = retrieve.all_topk(table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding as vec"), 11).where("id <> qid").withColumn("rank", F.col("rank") - 1)
    gold = hits.join(labels.selectExpr("vec_id as qid", "label"), "qid").join(labels.selectExpr("vec_id as id", "label as other"), "id").where("label = other").select("qid", "id", "rank")
    return evalkit.retrieval_quality(labels.selectExpr("vec_id as qid"), gold)
