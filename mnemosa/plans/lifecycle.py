"""Queries on the lifecycle of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lifecycle as lc
from ..sources.views import FACTS, HAS_VECTOR, NOW, embedded_facts, facts, table, vectors
from .recall import BOOST, COS, DECAY, _HALF
from .registry import query

_F = f"WITH f AS ({FACTS})"
_DAY = 86_400


@query("""SELECT doc_id, substr(sha256(concat(source, chr(0), trim(regexp_replace(lower(text), '[\\t\\n\\v\\f\\r ]+', ' ', 'g')))), 1, 24) AS fact_id,
substr(sha256(concat(source, chr(0), 'verbal', chr(0), lang, chr(0), trim(regexp_replace(lower(text), '[\\t\\n\\v\\f\\r ]+', ' ', 'g')))), 1, 24) AS sensory_id,
substr(sha256(concat(source, chr(0), lang, chr(0), CAST(doc_id AS VARCHAR))), 1, 24) AS chunk_id, sha256(text) AS content_hash FROM documents""")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    project, body = F.col("source"), F.col("text")
    return d.select("doc_id", text.content_id(project, body).alias("fact_id"), text.sensory_id(project, F.lit("verbal"), F.col("lang"), body).alias("sensory_id"), text.chunk_id(project, F.col("lang"), F.col("doc_id").cast("string")).alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))


_LINES = """WITH l AS (SELECT doc_id, source AS project_key, unnest(string_split(text, chr(10))) AS line FROM documents),
g AS (SELECT doc_id, project_key, substr(sha256(concat(project_key, chr(0), trim(regexp_replace(lower(line), '[\\t\\n\\v\\f\\r ]+', ' ', 'g')))), 1, 24) AS id FROM l WHERE length(line) BETWEEN 14 AND 240)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project_key"), F.explode(F.split("text", "\n")).alias("line")).where("length(line) between 14 and 240")
    return lines.select("doc_id", "project_key", text.content_id(F.col("project_key"), F.col("line")).alias("id"))


@query(_LINES + """, o AS (SELECT DISTINCT id, project_key FROM g WHERE doc_id % 2 = 0), n AS (SELECT id, any_value(project_key) AS project_key, count(*) AS times FROM g WHERE doc_id % 2 = 1 GROUP BY id)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.project_key, n.project_key) AS project_key, CAST(CASE WHEN o.id IS NULL THEN times ELSE 1 + coalesce(times, 0) END AS INT) AS frequency,
CASE WHEN (CASE WHEN o.id IS NULL THEN times ELSE 1 + coalesce(times, 0) END) >= 2 THEN 'ltm' ELSE 'stm' END AS tier FROM o FULL JOIN n ON o.id = n.id""")
def dedup_reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    fresh = lambda df: df.select("id", "project_key").distinct().select("id", "project_key", F.lit(1).alias("frequency"), F.lit("stm").alias("tier"), F.lit("active").alias("status"), F.lit(NOW).alias("last_seen"))
    old, new = fresh(lines.where("doc_id % 2 = 0")), lines.where("doc_id % 2 = 1")
    stored = lc.add(old, fresh(new).withColumn("seq", F.lit(0))).drop("seq")
    again = new.join(old.select("id"), "id", "left_semi").select("id")
    more = new.join(old.select("id"), "id", "left_anti").groupBy("id").agg((F.count("*") - 1).alias("n")).where("n > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("n")))).select("id")
    return lc.reinforce(stored, again.unionByName(more), NOW, 2).select("id", "project_key", "frequency", "tier")


@query(_LINES + """, o AS (SELECT DISTINCT id FROM g WHERE doc_id % 2 = 0), n AS (SELECT g.id, count(*) AS n, any_value(o.id) AS old FROM g LEFT JOIN o ON o.id = g.id WHERE doc_id % 2 = 1 GROUP BY g.id)
SELECT CAST(sum(CASE WHEN old IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS inserted, CAST(sum(CASE WHEN old IS NULL THEN n - 1 ELSE n END) AS BIGINT) AS reinforced FROM n""")
def bulk_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return lc.bulk_import(lines.where("doc_id % 2 = 0").select("id").distinct(), lines.where("doc_id % 2 = 1"))


@query(f"""WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS scale FROM v), d AS (SELECT id, label, list_transform(v, lambda x: round_even(x / scale * 127, 0)) AS d FROM q)
SELECT d.id, min(v.id) AS "by" FROM d JOIN v ON v.label = d.label AND v.id > d.id WHERE round({COS.format('v', 'd')}, 6) >= 0.3 GROUP BY d.id""")
def supersede_first_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.superseding(vectors(spark, sf_dir).selectExpr("vec_id as id", "vec_id as seq", "label", "vec"), 0.3, "label")


@query(_F + f""", n AS (SELECT id % 200 AS id, count(*) AS times FROM f GROUP BY 1)
SELECT id, CAST(frequency + coalesce(times, 0) AS INT) AS frequency, CASE WHEN times IS NOT NULL THEN 'active' ELSE status END AS status,
CASE WHEN times IS NOT NULL AND frequency + times >= 4 THEN 'ltm' ELSE tier END AS tier, CASE WHEN times IS NOT NULL THEN {NOW} ELSE last_seen END AS last_seen FROM f LEFT JOIN n USING (id)""")
def promote_rehearsal(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return lc.reinforce(f, f.selectExpr("id % 200 as id"), NOW, 4).select("id", "frequency", "status", "tier", "last_seen")


@query(_F + f" SELECT id, CASE WHEN status = 'active' AND recall_count >= 1 AND tier = 'stm' THEN 'ltm' ELSE tier END AS tier, CASE WHEN status = 'active' AND recall_count >= 1 AND tier = 'stm' THEN {NOW} ELSE last_seen END AS last_seen FROM f")
def replay_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.replay(facts(spark, sf_dir), NOW).select("id", "tier", "last_seen")


@query(_F + """, r AS (SELECT id, row_number() OVER (PARTITION BY project_key ORDER BY frequency DESC, last_seen DESC, id) AS n FROM f WHERE status = 'active' AND tier = 'stm')
SELECT f.id, CASE WHEN n > 5 THEN 'displaced' ELSE status END AS status FROM f LEFT JOIN r USING (id)""")
def displace_stm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.displace_stm(facts(spark, sf_dir), 5).select("id", "status")


_OLD = f"status = 'active' AND kind <> 'antipattern' AND last_seen < {NOW} - {30 * _DAY} AND frequency < 3"


@query(_F + f" SELECT id, CASE WHEN {_OLD} THEN 'expired' ELSE status END AS status FROM f")
def ttl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.sweep(facts(spark, sf_dir), NOW, 30 * _DAY, 3).select("id", "status")


@query(_F + f" SELECT id, status FROM f WHERE NOT (status <> 'active' AND coalesce(last_seen, created_at) < {NOW} - {60 * _DAY})")
def purge_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.purge(facts(spark, sf_dir), NOW, 60 * _DAY).select("id", "status")


_SCORED = _F + f""", n AS (SELECT superseded_by AS id, count(*) AS n FROM f WHERE superseded_by IS NOT NULL GROUP BY 1),
s AS (SELECT f.*, status = 'active' AND tier = 'ltm' AND kind <> 'antipattern' AS held, round(0.3 * {_HALF.format('recall_count')} + 0.3 * {DECAY} + 0.1 * ((CASE WHEN title <> '' THEN 1.0 ELSE 0.0 END
+ CASE WHEN type IS NOT NULL THEN 1.0 ELSE 0.0 END) / 3) + 0.1 * {_HALF.format('coalesce(n, 0)')} + 0.2 * {BOOST}, 6) AS retention FROM f LEFT JOIN n ON n.id = f.id),
r AS (SELECT *, row_number() OVER (PARTITION BY project_key, held ORDER BY retention DESC, id) AS rk, count(*) OVER (PARTITION BY project_key, held) AS cnt FROM s)"""


@query(_SCORED + " SELECT id, CASE WHEN held AND rk > 12 THEN 'pruned' ELSE status END AS status FROM r")
def refine_keep_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.refine(lc.with_retention(facts(spark, sf_dir), NOW), 12).select("id", "status")


@query(_SCORED + " SELECT id, CASE WHEN held AND rk > cnt - ceil(cnt * 0.25) THEN 'pruned' ELSE status END AS status FROM r")
def refine_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.refine(lc.with_retention(facts(spark, sf_dir), NOW), 0, 0.25).select("id", "status")


@query(_SCORED + " SELECT id, retention >= 1 AS strong, CASE WHEN held AND retention < 1.0 THEN 'pruned' ELSE status END AS status FROM r")
def refine_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lc.with_retention(facts(spark, sf_dir), NOW)
    return lc.refine(scored, 0, 1.0).select("id", (F.col("retention") >= 1).alias("strong"), "status")


def _merging(facts: str) -> str:
    """Common table expressions from `facts` (id, project_key, text, v, counters, last ones): `gone` has the ids that a stronger fact absorbs."""
    return f"""pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY created_at DESC, id DESC) AS newest FROM {facts} WHERE status = 'active' AND tier = 'stm') WHERE newest <= 512),
ord AS (SELECT id, project_key, v, row_number() OVER (PARTITION BY project_key ORDER BY frequency DESC, recall_count DESC, last_seen DESC, length(text) DESC, id) AS n FROM pool),
near AS MATERIALIZED (SELECT b.project_key, b.n, list(a.n) AS stronger FROM ord a JOIN ord b ON a.project_key = b.project_key AND a.n < b.n AND round({COS.format('a.v', 'b.v')}, 6) >= 0.3 GROUP BY ALL),
walk AS (SELECT project_key, 1::BIGINT AS n, [1::BIGINT] AS kept FROM ord WHERE n = 1 UNION ALL
SELECT w.project_key, o.n, CASE WHEN len(list_intersect(w.kept, coalesce(near.stronger, []))) > 0 THEN w.kept ELSE list_append(w.kept, o.n) END FROM walk w JOIN ord o ON o.project_key = w.project_key AND o.n = w.n + 1 LEFT JOIN near ON near.project_key = o.project_key AND near.n = o.n),
gone AS (SELECT o.id FROM ord o JOIN walk w ON w.project_key = o.project_key AND w.n = o.n WHERE NOT list_contains(w.kept, o.n))"""


_EMBEDDED = f"WITH RECURSIVE f AS ({FACTS}), e AS MATERIALIZED (SELECT f.*, CAST(embedding AS DOUBLE[]) AS v FROM f {HAS_VECTOR})"


@query(_EMBEDDED + ", " + _merging("e") + " SELECT id, project_key, CASE WHEN id IN (SELECT id FROM gone) THEN 'merged' ELSE status END AS status FROM e")
def integrate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.integrate(embedded_facts(spark, sf_dir), 0.3).select("id", "project_key", "status")


#: All steps in turn, each a table: r replayed, d displaced, m merged, p pruned, x expired.
_ALL_STEPS = _EMBEDDED + f""", r AS (SELECT * REPLACE (CASE WHEN hit THEN 'ltm' ELSE tier END AS tier, CASE WHEN hit THEN {NOW} ELSE last_seen END AS last_seen) FROM (SELECT *, status = 'active' AND recall_count >= 1 AND tier = 'stm' AS hit FROM e)),
dr AS (SELECT id, row_number() OVER (PARTITION BY project_key ORDER BY frequency DESC, last_seen DESC, id) AS n FROM r WHERE status = 'active' AND tier = 'stm'),
d AS (SELECT r.* REPLACE (CASE WHEN n > 5 THEN 'displaced' ELSE status END AS status) FROM r LEFT JOIN dr USING (id)), """ + _merging("d") + f""",
m AS (SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM gone) THEN 'merged' ELSE status END AS status) FROM d), sn AS (SELECT superseded_by AS id, count(*) AS k FROM m WHERE superseded_by IS NOT NULL GROUP BY 1),
sc AS (SELECT m.*, status = 'active' AND tier = 'ltm' AND kind <> 'antipattern' AS held, round(0.3 * {_HALF.format('recall_count')} + 0.3 * {DECAY} + 0.1 * ((CASE WHEN title <> '' THEN 1.0 ELSE 0.0 END
+ CASE WHEN type IS NOT NULL THEN 1.0 ELSE 0.0 END) / 3) + 0.1 * {_HALF.format('coalesce(k, 0)')} + 0.2 * {BOOST}, 6) AS retention FROM m LEFT JOIN sn ON sn.id = m.id),
p AS (SELECT * REPLACE (CASE WHEN held AND rk > 12 THEN 'pruned' ELSE status END AS status) FROM (SELECT *, row_number() OVER (PARTITION BY project_key, held ORDER BY retention DESC, id) AS rk FROM sc)),
u AS (SELECT id, unnest([concat('file', id % 7), concat('file', id % 5 + 4)]) AS path FROM p WHERE status = 'active' AND kind = 'antipattern'), st AS (SELECT id FROM u GROUP BY id HAVING max(CASE WHEN path IN ('file1', 'file5', 'file6') THEN 1 ELSE 0 END) = 0),
x AS (SELECT *, status <> 'active' AND coalesce(last_seen, created_at) < {NOW} - {60 * _DAY} AS cold FROM (SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM st) THEN 'expired' ELSE status END AS status) FROM p))"""


def _consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded_facts(spark, sf_dir).withColumn("files", F.expr("array(concat('file', id % 7), concat('file', id % 5 + 4))"))
    files = spark.range(1).select(F.explode(F.array(*map(F.lit, ("file1", "file5", "file6")))).alias("path"))
    return lc.consolidation(f, NOW, 5, 0.3, 12, horizon=60 * _DAY, files=files)


@query(_ALL_STEPS + " SELECT id, status, tier FROM x WHERE NOT cold")
def consolidate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consolidated(spark, sf_dir).where("purged = 0").select("id", "status", "tier")


@query(_ALL_STEPS + """ SELECT (SELECT count(*) FROM r WHERE hit) AS replayed, (SELECT count(*) FROM dr WHERE n > 5) AS displaced, (SELECT count(*) FROM gone) AS merged,
(SELECT count(*) FROM p WHERE status = 'pruned') AS pruned, (SELECT count(*) FROM st) AS expired, (SELECT count(*) FROM x WHERE cold) AS purged""")
def consolidation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.consolidation_counts(_consolidated(spark, sf_dir))


@query(_F + """, x AS (SELECT id, unnest([concat('file', id % 7), concat('file', id % 5 + 4)]) AS path FROM f WHERE status = 'active' AND kind = 'antipattern'),
g AS (SELECT id FROM x GROUP BY id HAVING max(CASE WHEN path IN ('file1', 'file5', 'file6') THEN 1 ELSE 0 END) = 0)
SELECT id, CASE WHEN id IN (SELECT id FROM g) THEN 'expired' ELSE status END AS status FROM f""")
def invalidate_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).withColumn("files", F.expr("array(concat('file', id % 7), concat('file', id % 5 + 4))"))
    files = spark.range(1).select(F.explode(F.array(*map(F.lit, ("file1", "file5", "file6")))).alias("path"))
    return lc.invalidate(f, files).select("id", "status")


@query(_F + " SELECT id, CAST(recall_count + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS recall_count FROM f")
def mark_recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    hit = f.where("id % 3 = 0").select("id")
    return lc.mark(f, hit.unionByName(hit), "recall_count").select("id", "recall_count")
