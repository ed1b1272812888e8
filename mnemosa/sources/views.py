"""Engine tables derived from the driver's tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_711_843_200.0

#: One fact for each document; age, tier, status and counters follow from doc_id.
FACTS = """
SELECT doc_id AS id, doc_id AS seq, source AS project_key, lang AS session_id, text,
  CASE WHEN doc_id % 11 = 0 THEN 'antipattern' WHEN doc_id % 7 = 0 THEN 'prompt' WHEN doc_id % 13 = 0 THEN 'session_summary' ELSE 'fact' END AS kind,
  CASE WHEN doc_id % 3 = 0 THEN 'stm' ELSE 'ltm' END AS tier,
  CASE WHEN doc_id % 17 = 0 THEN 'superseded' WHEN doc_id % 19 = 0 THEN 'displaced' WHEN doc_id % 23 = 0 THEN 'merged' WHEN doc_id % 29 = 0 THEN 'expired' ELSE 'active' END AS status,
  CASE WHEN doc_id % 17 = 0 THEN doc_id + 1 END AS superseded_by,
  CASE WHEN doc_id % 4 = 0 THEN CONCAT('obs', CAST(doc_id - doc_id % 12 AS VARCHAR(20))) END AS observation_id,
  CAST(1704067200 + (doc_id * 7919) % 7776000 AS DOUBLE) AS created_at,
  CAST(1704067200 + (doc_id * 104729) % 7776000 AS DOUBLE) AS last_seen,
  CAST(1 + doc_id % 9 AS INT) AS frequency, CAST(doc_id % 4 AS INT) AS recall_count, CAST(doc_id % 6 AS INT) AS injected_count, CAST(doc_id % 3 AS INT) AS used_count,
  CASE WHEN doc_id % 2 = 0 THEN 'decision' END AS type, CASE WHEN doc_id % 5 = 0 THEN SUBSTRING(text, 1, 20) END AS title, n_chars
FROM documents
"""

#: Perceptions of pages, one for every event of a page: modality by event, time from the event.
PERCEPTIONS = """
SELECT e.event_id AS id, CONCAT('user', CAST(e.user_id % 10 AS VARCHAR(20))) AS project_key, CASE WHEN e.event_type = 'view' THEN 'visual' ELSE 'verbal' END AS modality,
  p.url AS url, CAST(1704067200 + e.event_id * 37 AS DOUBLE) AS created_at, CAST(CASE WHEN e.event_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS attended,
  CASE WHEN e.event_id % 9 = 0 THEN CAST(1704067200 + e.event_id * 37 + 500 AS DOUBLE) END AS decayed_at
FROM events e CROSS JOIN (SELECT count(*) AS n FROM pages) c JOIN pages p ON p.page_id = e.event_id % c.n
"""

#: Work items, one for each event.
QUEUE = """
SELECT event_id AS msg_id, event_type AS stage, CASE WHEN event_id % 7 = 0 THEN 'in_progress' WHEN event_id % 31 = 0 THEN 'dead' ELSE 'pending' END AS status,
  CAST(event_id % 6 AS INT) AS attempts, CAST(1704067200 + (event_id * 53) % 900000 AS DOUBLE) AS next_retry_at,
  CASE WHEN event_id % 7 = 0 THEN CAST(1704067200 + (event_id * 71) % 900000 AS DOUBLE) END AS lease_expires, CAST(1704067200 + (event_id * 13) % 800000 AS DOUBLE) AS enqueued_at
FROM events
"""

#: Ledger of recalls and injections, one row for each event.
LEDGER = """
SELECT event_id AS seq, CONCAT('user', CAST(user_id % 10 AS VARCHAR(20))) AS project_key,
  CASE event_id % 5 WHEN 0 THEN 'inject_prompt' WHEN 1 THEN 'inject_core' WHEN 2 THEN 'pull_symbol' WHEN 3 THEN 'pull_doc' ELSE 'read_bounded' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'low_confidence' WHEN 2 THEN 'no_memory' ELSE 'embedding_mismatch' END AS verdict,
  CAST(FLOOR(value * 10) AS BIGINT) AS bytes_in, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(FLOOR(value * 25) AS BIGINT) END AS bytes_saved
FROM events
"""

#: Edges between conversation partners' documents, with repeats.
EDGES = """
SELECT conv_id % 97 AS src, (conv_id + turn) % 101 AS dst, CASE WHEN turn % 2 = 0 THEN 'cooc' ELSE 'entity' END AS kind, CAST(1.0 AS DOUBLE) AS weight
FROM conversations WHERE conv_id % 97 < (conv_id + turn) % 101
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The result of one of the statements above, its tables by name."""
    return spark.sql(_quoted(sql, names), **{n: table(spark, sf_dir, n) for n in names})


def _quoted(sql: str, names: tuple[str, ...]) -> str:
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return sql


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FACTS, "documents")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(embedding, x -> cast(x as double)) vec", "label")


def embedded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact with a vector: that of its document's number, counted round the table of vectors."""
    return with_vectors(facts(spark, sf_dir), spark, sf_dir)


#: The join of rows (id) with their vectors, as SQL.
HAS_VECTOR = "JOIN embeddings ON vec_id = id % (SELECT count(*) FROM embeddings)"


def with_vectors(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows (id LONG) with vec and label."""
    v = vectors(spark, sf_dir)
    n = v.count()
    return rows.withColumn("vec_id", F.col("id") % n).join(v, "vec_id").drop("vec_id")
