"""Queries on parsing, importing and indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources import chunking, imports, projects, transcript
from ..sources.views import table
from .recall import STOP, TOKENS
from .registry import query




@query(r"""WITH l AS (SELECT conv_id, turn, i, trim(s, '-*#• ' || chr(9)) AS s FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)),
p AS (SELECT conv_id, turn, i, unnest(ps) AS s, generate_subscripts(ps, 1) AS j FROM (SELECT *, CASE WHEN length(s) > 240 THEN string_split(regexp_replace(s, '([.!?])[\t\n\v\f\r ]+', '\1' || chr(1), 'g'), chr(1)) ELSE [s] END AS ps FROM l)),
g AS (SELECT conv_id, turn, i, j, trim(s) AS s, trim(regexp_replace(lower(trim(s)), '[\t\n\v\f\r ]+', ' ', 'g')) AS k FROM p WHERE length(trim(s)) BETWEEN 14 AND 240),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY i, j) AS n FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, j) AS place FROM d WHERE n = 1)
SELECT conv_id, turn, place - 1 AS place, s AS fact FROM r WHERE place <= 12""")
def heuristic_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, long lines by sentence."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.heuristic_facts(F.col("text"))).alias("place", "fact")).withColumn("place", F.col("place").cast("long"))


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS tokens, len(list_intersect({TOKENS.format('text')}, {TOKENS.format(chr(39) + 'then rest thing attion reth' + chr(39))})) AS shared FROM documents")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("tokens"), text.overlap(t, text.tokens(F.lit("then rest thing attion reth"))).alias("shared"))


_RE2 = r"""/(?:Users|home)/[\w.-]+/[^\s'\x22]*""".replace("'", "''")


@query(f"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '{rules.EMAIL}') THEN 'email' END, CASE WHEN regexp_matches(text, '{rules.SECRET}') THEN 'credential-shaped' END, CASE WHEN regexp_matches(text, '{_RE2}') THEN 'non-repo path: ' || substr(regexp_extract(text, '{_RE2}'), 1, 60) END], lambda f: f IS NOT NULL), '|') AS flags FROM documents")
def privacy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rules.privacy_flags(F.col("text"), "/nowhere/"), "|").alias("flags"))


@query(f"SELECT conv_id, turn, trim(text) AS line FROM conversations WHERE role = 'user' AND length(trim(text)) BETWEEN 12 AND 600")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.prompts(table(spark, sf_dir, "conversations"))


_QUOTED = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
#: Turns, every fifth with a phrase that the rules know, as their texts have none.
SAID = f"SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 5 = 0 THEN {_QUOTED(rules.ADMISSIONS)}[1 + CAST(conv_id % {len(rules.ADMISSIONS)} AS INT)] || ' ' || text ELSE text END AS text FROM conversations"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.element_at(F.array(*map(F.lit, rules.ADMISSIONS)), (F.col("conv_id") % len(rules.ADMISSIONS) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.concat(F.initcap(words), F.lit(" "), "text")).otherwise(F.col("text")))


@query(f"SELECT conv_id, count(*) AS turns, CAST(sum(CASE WHEN len(list_filter({_QUOTED(rules.ADMISSIONS)}, lambda m: contains(lower(text), m))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS admitted FROM ({SAID}) GROUP BY 1")
def admission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.admissions(_said(spark, sf_dir))


@query()
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five patterns over every document; their letters and digits of any script are beyond the SQL, so plain Python checks it."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(text.entities(F.col("text"))), "|").alias("names"))


_ID = "substr(sha256(concat({0}, chr(0), trim(regexp_replace(lower({1}), '[\\t\\n\\v\\f\\r ]+', ' ', 'g')))), 1, 24)"
_FIELDS = ["request", "investigated", "learned", "completed", "next_steps", "notes"]


def _summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six turns at a time of a conversation as the fields of a summary."""
    c = table(spark, sf_dir, "conversations").withColumn("part", F.floor(F.col("turn") / 6))
    return c.groupBy("conv_id", "part").agg(*(F.max(F.when(F.col("turn") % 6 == i, F.col("text"))).alias(f) for i, f in enumerate(_FIELDS)))


@query(f"""SELECT conv_id, CAST(turn // 6 AS BIGINT) AS part, [{", ".join(f"'{f}'" for f in _FIELDS)}][1 + turn % 6] AS field, {_ID.format("'conv'", "text")} AS id FROM conversations WHERE trim(text) <> ''""")
def import_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imports.summary_facts(_summary_rows(spark, sf_dir), _FIELDS, "conv_id", "part")
    return rows.select("conv_id", "part", "field", text.content_id(F.lit("conv"), F.col("value")).alias("id"))


@query("""WITH o AS (SELECT DISTINCT source AS project_key, concat('f', doc_id) AS path, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT source AS project_key, concat('f', doc_id) AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'gone' WHEN o.path IS NULL THEN 'new' WHEN o.h = n.h THEN 'fresh' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.path = n.path""")
def drift_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("project_key"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    old = d.where("doc_id % 3 <> 0").select("project_key", "path", F.sha2("text", 256).alias("hash"))
    new = d.where("doc_id % 5 <> 0").select("project_key", "path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return chunking.source_states(old, new).select("path", "state")


@query("""WITH a AS (SELECT doc_id, source, lower(split_part(text, ' ', 1)) AS anchor FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY source, anchor ORDER BY doc_id) AS n FROM a)
SELECT doc_id, CASE WHEN n = 1 THEN anchor ELSE anchor || '~' || n END AS anchor FROM n""")
def anchor_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "lower(split_part(text, ' ', 1)) as anchor")
    return chunking.unique_anchors(d, ["source"], "doc_id").select("doc_id", "anchor")


@query()
def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.regexp_replace("text", "\n", "\n\n## part\n"))
    return chunking.markdown_sections(d.select(F.col("doc_id").cast("string").alias("source_path"), body.alias("body"))).drop("body")


@query()
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class, a method and a function of each text: its words are their names, docstring and defaults."""
    d = table(spark, sf_dir, "benchmark").withColumn("words", F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})"), 1)).where("size(words) >= 4")
    name = lambda i: F.concat(F.lit("n_"), F.col("words")[i])
    code = F.concat(F.lit("class "), name(0), F.lit(":\n    \'\'\'"), F.array_join("words", " "), F.lit("\'\'\'\n    def "), name(1), F.lit("(self, x='"), F.col("words")[2], F.lit("'):\n        return x\n\nasync def "), name(3), F.lit("(*a):\n    pass\n"))
    return chunking.python_symbols(d.select(F.col("item_id").cast("string").alias("source_path"), code.alias("body")))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)
SELECT concat(conv_id, ':', turn) AS id, CASE WHEN turn % 2 = 0 THEN 'Read' ELSE 'Bash' END AS name, CAST(sum(CASE turn % 4 WHEN 0 THEN strlen(t) WHEN 1 THEN strlen(t) + 2 WHEN 2 THEN 0 ELSE 2 * strlen(t) END) AS BIGINT) AS bytes FROM c GROUP BY ALL""")
def tool_call_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call and its result for each turn: a text, a list of blocks, a list without texts, or two results."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "turn", F.coalesce("text", F.lit("")).alias("t"))
    message = lambda role, block: F.to_json(F.struct(F.lit(role).alias("type"), F.struct(F.lit(role).alias("role"), F.array(block).alias("content")).alias("message")))
    use = message("assistant", F.struct(F.lit("tool_use").alias("type"), "id", F.when(F.col("turn") % 2 == 0, "Read").otherwise("Bash").alias("name")))
    answer = lambda content: message("user", F.struct(F.lit("tool_result").alias("type"), F.col("id").alias("tool_use_id"), content.alias("content")))
    block = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    n = F.col("turn") % 4
    lines = [c.select(use.alias("value")), c.where((n == 0) | (n == 3)).select(answer(F.col("t")).alias("value")), c.where(n == 3).select(answer(F.array(block(F.col("t")))).alias("value")), c.where(n == 1).select(answer(F.array(block(F.col("t")), block(F.lit("é")))).alias("value")), c.where(n == 2).select(answer(F.array(F.struct(F.lit("image").alias("type")))).alias("value"))]
    whole = lines[0]
    for more in lines[1:]:
        whole = whole.unionByName(more)
    return transcript.tool_calls(whole).select("id", "name", "bytes")


_DIRS = "SELECT page_id, '/' || regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', '', 's') AS d FROM pages WHERE url IS NOT NULL"


@query(f"""WITH s AS (SELECT page_id, '/' || array_to_string(list_filter(string_split(d, '/'), lambda x: x NOT IN ('', '.')), '/') AS d FROM ({_DIRS})),
h AS (SELECT DISTINCT regexp_replace(d, '/[^/]*$', '') AS path, page_id % 9 = 0 AS pinned FROM s WHERE page_id % 3 = 0), m AS (SELECT path, bool_or(pinned) AS pinned FROM h GROUP BY path),
f AS (SELECT page_id, arg_max(path, (CASE WHEN pinned THEN 1000000 ELSE 0 END) + length(path)) AS root FROM s JOIN m ON s.d = path OR starts_with(s.d, path || '/') GROUP BY page_id),
r AS (SELECT page_id, coalesce(root, d) AS path FROM s LEFT JOIN f USING (page_id))
SELECT page_id, path AS project_path, substr(sha256(path), 1, 16) AS project_key, string_split(path, '/')[-1] AS project_label FROM r""")
def projects_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as folders of sessions, by marker; every third one's folder holds a marker, every ninth one's the root's name."""
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "(?s)[?#].*$", ""))
    s = table(spark, sf_dir, "pages").where("url is not null").select("page_id", path.alias("cwd"), F.lit(None).cast("string").alias("project_dir"))
    held = s.where("page_id % 3 = 0").select(F.regexp_replace(projects.folder(F.col("cwd")), "/[^/]*$", "").alias("path"), F.when(F.col("page_id") % 9 == 0, projects.ROOT).otherwise(".git").alias("name"))
    return projects.resolve(s, held, "marker").select("page_id", "project_path", "project_key", "project_label")
