"""Queries on scans, deletes, upserts, the index of files and the write path of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dml, lifecycle, rollups, scans
from ..sources import imports
from ..sources.views import EDGES, FACTS, HAS_VECTOR, NOW, PERCEPTIONS, QUEUE, embedded_facts, facts, table, view
from .recall import COS
from .registry import query

_F = f"WITH f AS ({FACTS})"
_T0 = 1704067200
_P = f"WITH p AS ({PERCEPTIONS})"


def _senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PERCEPTIONS, "events", "pages")


@query(_F + " SELECT id, status, created_at FROM f WHERE project_key = 'src2' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 5")
def scan_facts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.facts_page(facts(spark, sf_dir), "src2", 20, 5).select("id", "status", "created_at")


@query(_F + " SELECT id, text FROM f WHERE status = 'active' AND kind = 'antipattern' AND project_key = 'src3'")
def scan_antipatterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.active(facts(spark, sf_dir), "src3", "antipattern").select("id", "text")


@query(_F + " SELECT id, frequency, last_seen FROM f WHERE status = 'active' AND tier = 'stm' AND project_key = 'src1' ORDER BY frequency, last_seen, id LIMIT 10")
def scan_stm_weakest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.weakest_stm(facts(spark, sf_dir), "src1", 10).select("id", "frequency", "last_seen")


@query(_F + " SELECT id, created_at FROM f WHERE status = 'active' AND tier = 'stm' AND project_key = 'src1' ORDER BY created_at DESC, id DESC LIMIT 8")
def scan_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.merge_candidates(facts(spark, sf_dir), "src1", 8).select("id", "created_at")


@query(_F + " SELECT item_id * 37 AS id, item_id * 37 IN (SELECT id FROM f) AS known FROM benchmark")
def scan_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.known(table(spark, sf_dir, "benchmark").selectExpr("item_id * 37 as id"), facts(spark, sf_dir))


@query(_F + " SELECT id, kind, text FROM f WHERE id IN (SELECT item_id * 7 FROM benchmark)")
def scan_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.by_id(facts(spark, sf_dir), table(spark, sf_dir, "benchmark").selectExpr("item_id * 7 as id")).select("id", "kind", "text")


_CHUNKS = """SELECT doc_id AS id, source AS project_key, concat('f', doc_id % 40) AS source_path, CASE WHEN doc_id % 10 = 0 THEN 'snapshot' WHEN doc_id % 3 = 0 THEN 'code_symbol' ELSE 'doc_section' END AS kind,
concat('a', doc_id % 60) AS anchor, substring(text, 1, 20) AS title, lang AS heading_path, CAST(1 AS INT) AS level, substring(text, 1, 40) AS summary, text AS body, CAST(doc_id * 13 % 1000 AS BIGINT) AS byte_start, CAST(doc_id * 13 % 1000 + 50 AS BIGINT) AS byte_end FROM documents"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _CHUNKS, "documents")


@query(f"SELECT id, body FROM ({_CHUNKS}) WHERE project_key = 'src2' AND kind = 'code_symbol'")
def scan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.chunk_rows(_chunks(spark, sf_dir), "src2", "code_symbol").select("id", "body")


@query(f"SELECT id, source_path, anchor, byte_start, row_number() OVER (ORDER BY source_path, byte_start, anchor, id) AS place FROM ({_CHUNKS}) WHERE project_key = 'src2'")
def scan_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    o = scans.outline(_chunks(spark, sf_dir), "src2")
    return o.select("id", "source_path", "anchor", "byte_start", F.row_number().over(W.orderBy("source_path", "byte_start", "anchor", "id")).cast("long").alias("place"))


@query(f"SELECT id, source_path, body FROM ({_CHUNKS}) WHERE project_key = 'src2' AND anchor = 'a12' ORDER BY source_path, byte_start LIMIT 1")
def scan_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.section(_chunks(spark, sf_dir).withColumn("id", F.concat(F.lit("c"), F.col("id").cast("string"))), "src2", "a12").select(F.substring("id", 2, 20).cast("long").alias("id"), "source_path", "body")


@query(_P + " SELECT id, modality, created_at FROM p WHERE project_key = 'user3' AND decayed_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 64")
def scan_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.senses(_senses(spark, sf_dir), "user3", 64).select("id", "modality", "created_at")


@query(f"WITH q AS ({QUEUE}) SELECT msg_id, stage, enqueued_at FROM q ORDER BY enqueued_at DESC, msg_id DESC LIMIT 50")
def scan_recent_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.work(view(spark, sf_dir, QUEUE, "events"), None, 50).select("msg_id", "stage", "enqueued_at")


@query("SELECT concat('s', conv_id) AS cursor_key, CAST(CASE WHEN conv_id % 3 > 0 THEN conv_id * 40 ELSE 0 END AS BIGINT) AS \"offset\" FROM (SELECT DISTINCT conv_id FROM conversations)")
def scan_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("cursor_key")).distinct()
    return scans.cursor(keys.where("conv_id % 3 > 0").select("cursor_key", (F.col("conv_id") * 40).alias("offset")), keys.select("cursor_key"))


_LABELLED = _F + ", l AS (SELECT id, project_key, created_at, CASE WHEN id % 3 = 1 THEN concat('Label ', id) END AS project_label, CASE WHEN id % 5 = 1 THEN concat('/p/', id) END AS project_path FROM f)"


@query(_LABELLED + """ SELECT project_key, coalesce(arg_max(project_label, created_at * 1000000 + id) FILTER (project_label IS NOT NULL), project_key) AS label,
coalesce(arg_max(project_path, created_at * 1000000 + id) FILTER (project_path IS NOT NULL), '') AS path FROM l GROUP BY project_key""")
def scan_project_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = facts(spark, sf_dir).withColumns({"project_label": F.expr("case when id % 3 = 1 then concat('Label ', id) end"), "project_path": F.expr("case when id % 5 = 1 then concat('/p/', id) end")})
    return scans.project_meta(labelled)


_STATES = "SELECT 'p' AS project_key, concat('d', doc_id % 7, '/f', doc_id) AS source_path, md5(text) AS file_hash, CAST(doc_id * 1000 AS BIGINT) AS mtime_ns, doc_id FROM documents"
_LIVE = f"SELECT source_path, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE file_hash END AS file_hash, CAST(CASE WHEN doc_id % 5 = 0 THEN 7 ELSE mtime_ns END AS BIGINT) AS mtime_ns FROM ({_STATES}) WHERE doc_id % 4 <> 1"


@query(f"""WITH s AS (SELECT * FROM ({_STATES}) WHERE doc_id % 3 <> 2), n AS ({_LIVE})
SELECT n.source_path, CASE WHEN s.file_hash IS NULL THEN 'new' WHEN s.file_hash = n.file_hash THEN 'touched' ELSE 'changed' END AS why FROM n LEFT JOIN s USING (source_path) WHERE s.file_hash IS NULL OR s.mtime_ns <> n.mtime_ns""")
def index_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = view(spark, sf_dir, _STATES, "documents")
    return scans.needs_index(view(spark, sf_dir, _LIVE, "documents"), states.where("doc_id % 3 <> 2"), "p").select("source_path", "why")


@query(f"SELECT source_path FROM ({_STATES}) WHERE doc_id % 7 = 3 AND doc_id % 4 = 1")
def index_vanished_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.vanished(view(spark, sf_dir, _STATES, "documents"), view(spark, sf_dir, _LIVE, "documents"), "p", "d3")


@query(f"""WITH l AS (SELECT string_agg(concat(source_path, '|', mtime_ns, '|', doc_id), chr(10) ORDER BY source_path) AS t FROM ({_STATES}))
SELECT CAST(('0x' || substr(sha256(t), 1, 16))::UBIGINT & 9223372036854775807 AS BIGINT) AS signature FROM l""")
def index_tree_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.tree_signature(view(spark, sf_dir, _STATES, "documents").selectExpr("source_path as path", "mtime_ns", "doc_id as size"))


@query(_F + " SELECT id, CASE WHEN id % 5 = 2 THEN 'expired' ELSE status END AS status FROM f")
def dml_set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return dml.set_status(f, f.where("id % 5 = 2").select("id"), "expired").select("id", "status")


@query(_F + " SELECT id, CASE WHEN id % 6 = 1 AND status = 'active' THEN 'superseded' ELSE status END AS status, CASE WHEN id % 6 = 1 AND status = 'active' THEN id + 2 ELSE superseded_by END AS superseded_by FROM f")
def dml_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return lifecycle.supersede(f, f.where("id % 6 = 1").select("id", (F.col("id") + 2).alias("by"))).select("id", "status", "superseded_by")


@query(_F + " SELECT id FROM f WHERE NOT (project_key = 'src1' AND session_id = 'en' AND kind = 'session_summary')")
def dml_clear_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.clear_session_kind(facts(spark, sf_dir), "src1", "en", "session_summary").select("id")


@query(_F + " SELECT project_key, id FROM f WHERE project_key <> 'src4' AND id % 9 <> 4")
def dml_delete_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return dml.prune_project(dml.delete_facts(f, f.where("id % 9 = 4").select("id")), "src4").select("project_key", "id")


_GONE = "SELECT id FROM f WHERE project_key = (SELECT project_key FROM f WHERE id = 24) AND observation_id = 'obs24'"


@query(_F + f", g AS ({EDGES}), u AS (SELECT src, dst, kind, sum(weight) AS weight FROM g GROUP BY ALL), x AS ({_GONE}) SELECT 'fact' AS what, id AS a, CAST(NULL AS BIGINT) AS b FROM f WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT kind, src, dst FROM u WHERE src NOT IN (SELECT id FROM x) AND dst NOT IN (SELECT id FROM x)")
def dml_delete_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import graph

    f = facts(spark, sf_dir)
    project = f.where("id = 24").first()["project_key"]
    left, edges = dml.delete_memory(f, graph.upsert(view(spark, sf_dir, EDGES, "conversations")), project, "obs24")
    return left.select(F.lit("fact").alias("what"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(edges.select(F.col("kind").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query(_P + f""", n AS (SELECT id - id % 2 AS id, max(id) AS t FROM p WHERE id % 6 < 3 GROUP BY 1)
SELECT p.id, attended, CASE WHEN n.id IS NOT NULL THEN {_T0} + t ELSE created_at END AS created_at, CASE WHEN n.id IS NULL THEN decayed_at END AS decayed_at FROM p LEFT JOIN n ON n.id = p.id
UNION ALL SELECT id, 0, {_T0} + t, NULL FROM n WHERE id NOT IN (SELECT id FROM p)""")
def dml_perceive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known perceptions are seen again, some twice in a batch: the later one counts, and they are live again."""
    p = _senses(spark, sf_dir)
    new = p.where("id % 6 < 3").select((F.col("id") - F.col("id") % 2).alias("id"), "project_key", "modality", "url", F.lit(0).alias("attended"), (F.col("id") + _T0).cast("double").alias("created_at"), F.col("id").alias("seq"))
    return dml.perceive(p, new).select("id", "attended", "created_at", "decayed_at")


@query(_P + f" SELECT id, CASE WHEN id % 4 = 1 THEN 1 ELSE attended END AS attended, CASE WHEN id % 7 = 2 AND decayed_at IS NULL THEN CAST({_T0} AS DOUBLE) ELSE decayed_at END AS decayed_at FROM p WHERE id % 11 <> 5")
def dml_sensory_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _senses(spark, sf_dir)
    out = dml.mark_decayed(dml.mark_attended(p, p.where("id % 4 = 1")), p.where("id % 7 = 2"), float(_T0))
    return dml.delete_facts(out, p.where("id % 11 = 5")).select("id", "attended", "decayed_at")


_NEW = "SELECT doc_id + 5000000 AS id, source AS project_key, concat('f', doc_id % 40) AS source_path, 'doc_section' AS kind, concat('n', doc_id) AS anchor, CAST(doc_id AS BIGINT) AS byte_start FROM documents WHERE doc_id % 40 IN (3, 4, 17)"


@query(f"WITH c AS ({_CHUNKS}), n AS ({_NEW}) SELECT id, source_path, anchor FROM n UNION ALL SELECT id, source_path, anchor FROM c WHERE (project_key, source_path) NOT IN (SELECT (project_key, source_path) FROM n) AND (project_key, source_path) NOT IN (SELECT (project_key, source_path) FROM c WHERE id % 40 = 9)")
def dml_replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    left = dml.delete_sources(c, c.where("id % 40 = 9"))
    return dml.replace_chunks(left, view(spark, sf_dir, _NEW, "documents")).select("id", "source_path", "anchor")


@query(f"""WITH c AS ({_CHUNKS}), n AS (SELECT source AS project_key, concat('f', doc_id % 40) AS source_path, trim(text) AS body, row_number() OVER (PARTITION BY source, doc_id % 40 ORDER BY doc_id DESC) AS n FROM documents WHERE doc_id % 3 = 0 AND trim(text) <> '')
SELECT source_path, kind, md5(body) AS h FROM c WHERE NOT (kind = 'snapshot' AND (project_key, source_path) IN (SELECT (project_key, source_path) FROM n)) UNION ALL
SELECT source_path, 'snapshot', md5(body) FROM n WHERE n = 1""")
def index_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest text of each page becomes its one snapshot chunk; other chunks stay."""
    pages = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").selectExpr("source as project_key", "concat('f', doc_id % 40) as url", "trim(text) as text", "doc_id as seq")
    return dml.replace_chunks(_chunks(spark, sf_dir).withColumn("id", F.col("id").cast("string")), dml.snapshot_chunks(pages, NOW), snapshots=True).select("source_path", "kind", F.md5("body").alias("h"))


_SEEN = f"SELECT *, CASE WHEN id % 10 = 3 THEN concat('text ', id) ELSE concat('other ', id) END AS text FROM ({PERCEPTIONS}) AS p"


@query(f"""WITH p AS ({_SEEN}), r AS (SELECT * FROM p WHERE modality = 'visual' AND attended = 1 AND decayed_at IS NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY project_key, url ORDER BY created_at DESC, id DESC) AS n FROM r)
SELECT 'chunk' AS what, concat(project_key, url) AS name, text AS value FROM n WHERE n = 1 UNION ALL SELECT 'left', project_key, CAST(count(*) AS VARCHAR) FROM p WHERE decayed_at IS NULL AND id NOT IN (SELECT id FROM r) GROUP BY project_key""")
def sensory_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attended pages go into the index and leave the register."""
    p = _senses(spark, sf_dir).withColumn("text", F.expr("case when id % 10 = 3 then concat('text ', id) else concat('other ', id) end"))
    empty = spark.createDataFrame([], "id string, project_key string, source_path string, kind string, body string")
    senses, chunks = dml.promote_perceptions(p, empty, NOW)
    kept = senses.where("decayed_at is null").groupBy("project_key").agg(F.count("*").cast("string").alias("value"))
    return chunks.select(F.lit("chunk").alias("what"), F.concat("project_key", "source_path").alias("name"), F.col("body").alias("value")).unionByName(kept.select(F.lit("left").alias("what"), F.col("project_key").alias("name"), "value"))


@query("""WITH m AS (SELECT source AS project_key, min(lang) AS label, 1.0::DOUBLE AS updated_at FROM documents GROUP BY source), n AS (SELECT source AS project_key, max(doc_id) AS seq FROM documents WHERE doc_id % 4 = 1 AND source <> 'src3' GROUP BY source)
SELECT project_key, CASE WHEN n.seq IS NULL THEN label ELSE concat('l', n.seq) END AS label, CASE WHEN n.seq IS NULL THEN updated_at ELSE 2.0 END AS updated_at FROM m FULL JOIN n USING (project_key)""")
def dml_upsert_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    meta = d.groupBy(F.col("source").alias("project_key")).agg(F.min("lang").alias("label"), F.lit(1.0).alias("updated_at"))
    new = d.where("doc_id % 4 = 1 and source <> 'src3'").select(F.col("source").alias("project_key"), F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("label"), F.lit(2.0).alias("updated_at"), F.col("doc_id").alias("seq"))
    return dml.upsert(meta, new, ["project_key"])


_V = _F + f", e AS MATERIALIZED (SELECT f.*, CAST(embedding AS DOUBLE[]) AS v FROM f {HAS_VECTOR})"


@query(_V + f""", n AS (SELECT * FROM e WHERE id % 8 = 5 AND kind = 'fact'), o AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS scale FROM e WHERE id % 8 <> 5 AND status = 'active'),
q AS (SELECT *, list_transform(v, lambda x: round_even(x / scale * 127, 0)) AS d FROM o),
s AS (SELECT q.id, min(n.id) AS "by" FROM q JOIN n ON n.project_key = q.project_key WHERE round({COS.format('n.v', 'd')}, 6) >= 0.35 GROUP BY q.id),
x AS (SELECT q.id, min(n.id) AS "by" FROM q JOIN n ON n.project_key = q.project_key AND n.id + 2 = q.id GROUP BY q.id),
u AS (SELECT id, min("by") AS "by" FROM (SELECT * FROM s UNION ALL SELECT * FROM x) GROUP BY id)
SELECT id, CASE WHEN "by" IS NULL THEN 'active' ELSE 'superseded' END AS status, "by" AS superseded_by FROM q LEFT JOIN u USING (id)""")
def add_records_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New facts against those stored: the first that is as similar, or names one, supersedes it."""
    e = embedded_facts(spark, sf_dir)
    new, old = e.where("id % 8 = 5 and kind = 'fact'"), e.where("id % 8 <> 5 and status = 'active'")
    keyed = lambda df, key: df.select("project_key", F.col("id").cast("string").alias(key), F.lit(0).cast("long").alias("seq"), "vec")
    later = new.select("project_key", F.col("id").cast("string").alias("id"), F.col("id").alias("seq"), "vec")
    similar = lifecycle.superseding_new(keyed(old, "key").withColumn("seq", F.lit(-1).cast("long")), later, 0.35, group="project_key").select(F.col("key").cast("long").alias("id"), F.col("by").cast("long").alias("by"))
    named = lifecycle.named_victims(new.select("id", "project_key", F.array(F.col("id") + 2).alias("supersedes")), old)
    return lifecycle.supersede(old, similar.unionByName(named)).select("id", "status", F.when(F.col("status") == "superseded", F.col("superseded_by")).alias("superseded_by"))


def _source(spark: SparkSession, sf_dir: str) -> imports.Source:
    d = table(spark, sf_dir, "documents")
    line = F.regexp_replace(F.substring_index("text", "\n", 1), r'["\\]', "")
    some = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 13 != 0, F.col("source")).alias("project"), F.col("lang").alias("type"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), F.lit("s").alias("subtitle"), line.alias("line"))
    facts_ = F.when(F.col("id") % 4 == 0, F.lit("oops")).otherwise(F.to_json(F.array("line", F.lit("  "), F.concat(F.lit("more "), (F.col("id") % 50).cast("string")))))
    o = some.select("id", "project", "type", "title", "subtitle", facts_.alias("facts"), F.lit("n").alias("narrative"), F.lit('["a","b"]').alias("files_read"), F.lit('["b"," c "]').alias("files_modified"), (F.lit(1.7e12) + F.col("id")).alias("created_at_epoch"))
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(*(F.max(F.when(F.col("turn") == i, F.col("text"))).alias(f) for i, f in enumerate(imports.SUMMARY_FIELDS)))
    return imports.Source(o, c.withColumns({"project": F.concat(F.lit("src"), (F.col("id") % 30).cast("string")), "created_at_epoch": F.lit(1.7e9)}))


_KEY = "substr(sha256(concat({0}, chr(0), trim(regexp_replace(lower({1}), '[\\t\\n\\v\\f\\r ]+', ' ', 'g')))), 1, 24)"
_IMPORT = f"""d AS (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN source END AS label, concat('t', doc_id) AS title, trim(regexp_replace(split_part(text, chr(10), 1), '["\\\\]', '', 'g')) AS line FROM documents),
r AS (SELECT label, 0 AS t, doc_id AS i, 0 AS p, CASE WHEN doc_id % 4 = 0 THEN title || ' — s' ELSE line END AS text FROM d UNION ALL SELECT label, 0, doc_id, 1, concat('more ', doc_id % 50) FROM d WHERE doc_id % 4 <> 0
  UNION ALL SELECT concat('src', conv_id % 30), 1, conv_id, turn, trim(text) FROM conversations WHERE turn < 6),
w AS (SELECT * FROM r WHERE label <> '' AND text <> ''), l AS (SELECT DISTINCT label FROM w), k AS (SELECT label, concat('key', label) AS project_key FROM l WHERE label <> 'src7')"""


@query(f"WITH {_IMPORT} SELECT label FROM l UNION SELECT concat('src', conv_id % 30) FROM conversations")
def import_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir).labels()


@query(f"""WITH {_IMPORT}, m AS (SELECT w.*, project_key, {_KEY.format('project_key', 'text')} AS id FROM w JOIN k USING (label)), o AS (SELECT DISTINCT id FROM m WHERE i % 6 = 1 AND t = 0 AND p = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, i, p) AS n FROM m), c AS (SELECT label, sum(CASE WHEN n = 1 AND id NOT IN (SELECT id FROM o) THEN 1 ELSE 0 END) AS inserted, count(*) AS total FROM n GROUP BY label)
SELECT l.label, project_key, CAST(inserted AS BIGINT) AS inserted, CAST(total - inserted AS BIGINT) AS reinforced, CAST(ceil(inserted / 256.0) AS BIGINT) AS batches FROM l LEFT JOIN k USING (label) LEFT JOIN c USING (label)""")
def import_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of observations and summaries, one of its labels without a project, into a table that knows some of its facts."""
    records = _source(spark, sf_dir).records()
    keys = records.select("label").distinct().where("label <> 'src7'").withColumn("project_key", F.concat(F.lit("key"), "label"))
    mapped = records.join(keys, "label", "left")
    rows = mapped.where("project_key is not null").withColumn("id", text.content_id(F.col("project_key"), F.col("text")))
    known = rows.where("seq.i % 6 = 1 and seq.t = 0 and seq.p = 1").select("id").distinct()
    return lifecycle.import_counts(known, rows, mapped)


@query(_F + """, c AS (SELECT project_key, coalesce(observation_id, CAST(id AS VARCHAR)) AS card, max(created_at) AS newest, count(*) AS n, string_agg(id || ':' || coalesce(title, ''), '|' ORDER BY created_at, id) AS facts FROM f WHERE status = 'active' GROUP BY 1, 2)
SELECT * FROM c ORDER BY newest DESC, card, project_key LIMIT 40 OFFSET 3""")
def cards_with_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rollups.cards(scans.active(facts(spark, sf_dir)), 40, 3)
    return c.withColumn("facts", F.array_join(F.transform("facts", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.coalesce(x["title"], F.lit("")))), "|"))
