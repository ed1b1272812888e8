"""Queries on what is kept between runs: tables by partition, postings, and the state of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators import lifecycle
from ..operators.term_index import TermIndex
from ..sources.views import PERCEPTIONS, table, view
from ..store import Files, Table, checkpointed, shared_folder
from ..streaming import stateful
from .recall import _TOP, _bm25_sql, _ranked_hits
from .registry import query
from .tables import _URL

_SEEN = schemas._schema("id string, project_key string, created_at double, last_seen double, frequency int, status string, tier string")
_CAPTURES = ("true", "doc_id % 3 = 0", "doc_id % 50 < 2")
_FACT_ID = "substr(sha256(concat(source, chr(0), trim(regexp_replace(lower(text), '[\\t\\n\\v\\f\\r ]+', ' ', 'g')))), 1, 24)"


def _root(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/mnemosa-{what}-{uuid.uuid4().hex}"


def _captured(t: Table, seen: DataFrame, now: float) -> None:
    """Rows (id, project_key) into a table of facts: known ones are reinforced, new ones added; the partitions of their ids are written."""
    seen = checkpointed(seen)
    parts = t.parts_of(seen)
    old = t.read(parts)
    new = seen.join(old.select("id"), "id", "left_anti").groupBy("id", "project_key").agg(F.count("*").cast("int").alias("n"))
    fresh = new.select("id", "project_key", F.lit(now).alias("created_at"), F.lit(now).alias("last_seen"), F.col("n").alias("frequency"), F.lit("active").alias("status"), F.when(F.col("n") > 1, "ltm").otherwise("stm").alias("tier"))
    again = seen.join(new.select("id"), "id", "left_anti")
    t.replace(lifecycle.reinforce(old, again, now, 2).unionByName(fresh), parts)


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT {_FACT_ID} AS id, source AS project_key, {float(k)} AS now FROM documents WHERE {w} AND source IS NOT NULL AND text IS NOT NULL" for k, w in enumerate(_CAPTURES, 1)) + """)
SELECT id, project_key, min(now) AS created_at, max(now) AS last_seen, CAST(count(*) AS INT) AS frequency, CASE WHEN count(*) > 1 THEN 'ltm' ELSE 'stm' END AS tier FROM s GROUP BY id, project_key""")
def table_after_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, then a third, then a twenty-fifth of them again, into a table by partition."""
    t = Table(spark, _root(spark, "facts"), _SEEN, "id", "project_key", 4, 8)
    docs = table(spark, sf_dir, "documents").where("source is not null and text is not null")
    for k, where in enumerate(_CAPTURES, 1):
        _captured(t, docs.where(where).select(text.content_id(F.col("source"), F.col("text")).alias("id"), F.col("source").alias("project_key")), float(k))
    return t.read().select("id", "project_key", "created_at", "last_seen", "frequency", "tier")


_NOW = "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 7 THEN concat(source, ' ', text) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3"


@query(_bm25_sql(_NOW, "SELECT item_id AS qid, text AS query FROM benchmark", {"text": 1.0}, _TOP))
def kept_postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two halves, then a tenth changed and a tenth deleted, in kept postings; the ten best for each item of the benchmark.

    Ids are filled up with zeros, so that ties come in the order of the numbers.
    """
    index = TermIndex(spark, _root(spark, "terms"), ["text"], stem=False)
    docs = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("id"), F.lit("1").alias("version"), "text", "source")
    none, number = docs.limit(0).select("id"), F.col("id").cast("long")
    for half in (0, 1):
        index.update(docs.where(number % 2 == half), none)
    changed = docs.where(number % 10 == 7).withColumns({"version": F.lit("2"), "text": F.concat_ws(" ", "source", "text")})
    index.update(changed, docs.where(number % 10 == 3).select("id"))
    asked = table(spark, sf_dir, "benchmark").selectExpr("item_id as qid", "text as query")
    return _ranked_hits(index.search(asked, [1.0], k=10).withColumn("id", F.col("id").cast("long")))


def _perceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptions as a stream of the files of events."""
    name, stream = "events.parquet", spark.readStream.schema(table(spark, sf_dir, "events").schema)
    one = Files(spark, sf_dir).names(name) == [name]  # a stream reads folders
    events = stream.option("pathGlobFilter", name).parquet(sf_dir) if one else stream.parquet(f"{sf_dir}/{name}")
    pages = table(spark, sf_dir, "pages")
    return spark.sql(PERCEPTIONS.replace("FROM events", "FROM {events}").replace("FROM pages", "FROM {pages}").replace("JOIN pages", "JOIN {pages}"), events=events, pages=pages)



@query(f"""WITH p AS ({PERCEPTIONS}), l AS (SELECT id, created_at - lag(created_at) OVER w AS a, lead(created_at) OVER w - created_at AS b FROM p
  WHERE decayed_at IS NULL AND modality = 'visual' AND {_URL} <> '' WINDOW w AS (PARTITION BY project_key, {_URL} ORDER BY created_at, id))
SELECT id FROM l WHERE a <= 20000 OR b <= 20000""")
def stream_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.finished(stateful.attention(_perceptions(spark, sf_dir), 20_000), "seen")


@query(f"""WITH p AS ({PERCEPTIONS}), u AS (SELECT max(created_at) - 600 AS until FROM p),
n AS (SELECT *, lead(created_at, 64) OVER (PARTITION BY project_key ORDER BY created_at, CAST(id AS VARCHAR)) AS nth FROM p WHERE decayed_at IS NULL),
d AS (SELECT project_key, id, CASE WHEN nth IS NOT NULL THEN least(created_at + 50000, nth) ELSE created_at + 50000 END AS t FROM n WHERE attended = 0),
g AS (SELECT d.* FROM d, u WHERE t <= until UNION ALL SELECT project_key, id, decayed_at FROM p WHERE decayed_at IS NOT NULL)
SELECT project_key, id, 'decayed' AS event, t AS "at" FROM d, u WHERE t <= until UNION ALL SELECT project_key, id, 'purged', t + 50000 FROM g, u WHERE t + 50000 <= until""")
def stream_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.finished(stateful.register(_perceptions(spark, sf_dir), 50_000, 64), "gone")
