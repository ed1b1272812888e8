"""Queries on rules and parsers of text: noise, commands, tool answers, distiller answers, sweeps, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import evalkit
from ..functions import rules
from ..operators import fts, retrieve
from ..sources import imports, transcript
from ..sources.views import facts, table
from .ingest import _QUOTED
from .recall import _bm25_sql
from .registry import query

#: Turns with a head that marks them, by conversation and turn.
_HEADS = ("", "  <command-name>x ", "Caveat: ", "You review a coding-assistant session. ", "Let me ", "Can you ", "The assistant ", "Note, ")
_TURNS = f"SELECT conv_id, turn, role, {_QUOTED(_HEADS)}[1 + CAST((conv_id + turn) % 8 AS INT)] || trim(split_part(text, chr(10), 1)) || CASE conv_id % 7 WHEN 1 THEN '?' WHEN 2 THEN ':' ELSE '' END AS text FROM conversations"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, _HEADS)), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    tail = F.when(F.col("conv_id") % 7 == 1, "?").when(F.col("conv_id") % 7 == 2, ":").otherwise("")
    return table(spark, sf_dir, "conversations").withColumn("text", F.concat(head, F.trim(F.split_part("text", F.lit("\n"), F.lit(1))), tail))


def _starts(text: str, words: tuple[str, ...]) -> str:
    return f"len(list_filter({_QUOTED(words)}, lambda w: starts_with({text}, w))) > 0"


@query(f"""WITH t AS ({_TURNS}) SELECT conv_id, turn, {_starts('substr(ltrim(text), 1, 120)', rules.DISTILLER_PROMPTS)} AS prompt, {_starts('substr(lower(ltrim(text)), 1, 40)', rules.HARNESS)} AS harness,
ends_with(text, '?') OR {_starts('lower(text)', rules.ASKS)} AS ask, ends_with(text, ':') OR {_starts('lower(text)', rules.NARRATION)} AS narration FROM t""")
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _turns(spark, sf_dir).select("conv_id", "turn", rules.is_distiller_prompt(t).alias("prompt"), rules.is_harness(t).alias("harness"), rules.is_ask(t).alias("ask"), rules.is_narration(t).alias("narration"))


@query(f"SELECT doc_id, {_QUOTED(rules.CONTAMINATION)}[list_position(list_transform({_QUOTED(rules.CONTAMINATION)}, lambda w: contains(lower(text), w)), TRUE)] AS hit FROM (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN text || ' MRR and paired' WHEN 2 THEN 'the Corpus ' || text ELSE text END AS text FROM documents)")
def contamination_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    marked = F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit(" MRR and paired"))).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("the Corpus "), "text")).otherwise(F.col("text"))
    return d.select("doc_id", rules.contamination(marked).alias("hit"))


_COMMANDS = ("ls -l | grep foo", "rg foo src", "a; ack x", "grep -rn foo .", "egrep --include=*.py foo", "find . -name x", "find . -delete", "echo rg", "tool plugin uninstall memo", "tool plugins remove MEMO --keep-data", "tool plugin remove other")


@query(f"""WITH c AS (SELECT event_id, {_QUOTED(_COMMANDS)}[1 + CAST(event_id % {len(_COMMANDS)} AS INT)] AS c FROM events)
SELECT event_id, regexp_matches(c, '(?:^|[|&;]\\s*|\\s)(?:rg|ag|ack)\\b') OR (regexp_matches(c, '\\be?grep\\b') AND regexp_matches(c, '(?:-[A-Za-z]*[rR]\\b|--include|--exclude)')) OR (regexp_matches(c, '\\bfind\\b') AND regexp_matches(c, '-(?:i?name|i?path|regex)\\b')) AS search,
regexp_matches(c, '(?i)\\btool\\s+plugins?\\s+(?:uninstall|remove)\\b') AND NOT regexp_matches(c, '--keep-data\\b') AND contains(lower(c), 'memo') AS removal FROM c""")
def command_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.col("event_id") % len(_COMMANDS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", rules.is_file_search(c).alias("search"), rules.removes_data(c, "tool", "memo").alias("removal"))


@query("""WITH a AS (SELECT doc_id, 'Mod.' || lower(split_part(text, ' ', 1)) AS anchor, CASE doc_id % 3 WHEN 0 THEN split_part(text, ' ', 1) WHEN 1 THEN 'x.' || split_part(text, ' ', 1) ELSE lang END AS gold FROM documents WHERE text IS NOT NULL)
SELECT doc_id, lower(anchor) = lower(gold) OR ends_with(lower(anchor), '.' || list_last(string_split(lower(gold), '.'))) AS met FROM a""")
def anchor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.split_part("text", F.lit(" "), F.lit(1))
    gold = F.when(F.col("doc_id") % 3 == 0, word).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x."), word)).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", rules.anchor_matches(F.concat(F.lit("Mod."), F.lower(word)), gold).alias("met"))


_CUT = "regexp_replace(regexp_replace(regexp_replace(substr(t, 1, {0}), '\\s+\\z', ''), '\\s+\\S+\\z', ''), '[ ,;:—-]+\\z', '')"


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g'), '\\.+\\z', ''), '\\A\\s+|\\s+\\z', '', 'g') AS t, text FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 100 THEN t WHEN {_CUT.format(100)} <> '' THEN {_CUT.format(100)} || '…' ELSE regexp_replace(substr(t, 1, 100), '\\s+$', '') END AS rule,
CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 200) || chr(10) || '...' || chr(10) || right(text, 300) END AS clipped FROM t""")
def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text

    return table(spark, sf_dir, "documents").select("doc_id", rules.rule_text(F.col("text"), 100).alias("rule"), text.clip(F.col("text"), 500).alias("clipped"))


_LINE = "regexp_replace(split_part(text, chr(10), 1), '[\"\\\\]', '', 'g')"
_ANSWERS = f"""SELECT conv_id, turn, {_LINE} AS line, CASE turn % 5 WHEN 0 THEN {_LINE} WHEN 1 THEN '[{{"type":"text","text":"' || {_LINE} || '"}},{{"type":"image"}},{{"type":"text","text":"b"}}]'
WHEN 2 THEN '{{"content":[{{"type":"text","text":"' || {_LINE} || '"}}]}}' WHEN 3 THEN '{{"stdout":"' || {_LINE} || '","n":{{"long name of a field":["' || {_LINE} || 'zz"]}}}}' END AS response FROM conversations"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r'["\\]', "")
    block = lambda t: F.concat(F.lit('{"type":"text","text":"'), t, F.lit('"}'))
    n = F.col("turn") % 5
    response = (
        F.when(n == 0, line).when(n == 1, F.concat(F.lit("["), block(line), F.lit(',{"type":"image"},'), block(F.lit("b")), F.lit("]"))).when(n == 2, F.concat(F.lit('{"content":['), block(line), F.lit("]}")))
        .when(n == 3, F.concat(F.lit('{"stdout":"'), line, F.lit('","n":{"long name of a field":["'), line, F.lit('zz"]}}')))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"), response.alias("response"))


@query(f"""WITH a AS ({_ANSWERS}) SELECT conv_id, turn, coalesce(CASE turn % 5 WHEN 1 THEN line || chr(10) || 'b' WHEN 4 THEN '' ELSE line END, '') AS text,
coalesce(CAST(CASE turn % 5 WHEN 0 THEN strlen(line) WHEN 3 THEN strlen(line) + 2 WHEN 4 THEN 0 ELSE greatest(strlen(line), 4 + CASE WHEN turn % 5 = 1 AND line IS NOT NULL THEN 1 ELSE 0 END) END AS INT), 0) AS longest FROM a""")
def tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of tool answers of four shapes, and their longest string, plain ones that begin like JSON too."""
    a = _answers(spark, sf_dir)
    return a.select("conv_id", "turn", rules.result_text(F.col("response")).alias("text"), rules.longest_string(F.col("response")).alias("longest"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '- Page URL: ' || coalesce(url, '') || chr(10) || substr(html, 1, 200) WHEN 1 THEN 'see ' || coalesce(url, '') || '). ' WHEN 2 THEN 'URL = ' || coalesce(url, '') ELSE 'nothing here' END AS t FROM pages),
u AS (SELECT page_id, regexp_extract(t, '(?im)^\\s*-?\\s*(?:page\\s+url|url)\\s*[:=]\\s*(\\S+)', 1) AS a, regexp_extract(substr(t, 1, 2000), '(https?://\\S+)', 1) AS b FROM p)
SELECT page_id, CASE WHEN a <> '' THEN regexp_replace(a, '[.,);]+$', '') WHEN b <> '' THEN regexp_replace(b, '[.,);]+$', '') END AS url FROM u""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, n = F.coalesce("url", F.lit("")), F.col("page_id") % 4
    t = F.when(n == 0, F.concat(F.lit("- Page URL: "), url, F.lit("\n"), F.substring("html", 1, 200))).when(n == 1, F.concat(F.lit("see "), url, F.lit("). "))).when(n == 2, F.concat(F.lit("URL = "), url)).otherwise("nothing here")
    return table(spark, sf_dir, "pages").select("page_id", rules.page_url(t).alias("url"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, trim(ltrim(trim(s, ' ' || chr(9) || chr(13)), '#'), ' ' || chr(9) || chr(13)) AS s FROM l), f AS (SELECT doc_id, arg_min(s, i) AS s FROM c WHERE s <> '' AND NOT regexp_matches(s, '^(```|\\||>|-|\\*)') GROUP BY doc_id),
n AS (SELECT doc_id, arg_min(t, i) AS t FROM (SELECT doc_id, i, trim(s, ' ' || chr(9) || chr(13)) AS t FROM l) WHERE t <> '' GROUP BY doc_id)
SELECT d.doc_id, substr(coalesce(f.s, source), 1, 200) AS summary, substr(coalesce(n.t, ''), 1, 200) AS snapshot, CASE WHEN doc_id % 2 = 0 THEN substr(source, 1, 200) ELSE 'page snapshot' END AS title FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN n USING (doc_id)""")
def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", rules.first_prose_line(F.col("source"), F.col("text")).alias("summary"), rules.snapshot_summary(F.coalesce("text", F.lit(""))).alias("snapshot"), rules.snapshot_title(F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("title"))


_KEYS = ("merged", "title", "completed", "next_steps")


@query(f"""WITH c AS (SELECT conv_id, turn, {_LINE} AS line FROM conversations WHERE text IS NOT NULL), t AS (SELECT *, trim(line) AS x FROM c)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND lower(x) NOT IN ('none', 'null', 'n/a', 'na', '-', '') THEN x END AS merged,
CASE WHEN turn % 3 = 1 AND x <> '' THEN CASE WHEN conv_id % 2 = 0 THEN x ELSE substr(x, 1, 200) END END AS summary, CASE WHEN turn % 3 = 1 AND x <> '' THEN CASE WHEN conv_id % 2 = 0 THEN 'Next steps: go' ELSE 'Completed: ' || x || chr(10) || 'Next steps: go' END END AS narrative FROM t""")
def distiller_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge and summary answers, bare, fenced, in prose, or refusals."""
    line = F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r'["\\]', "")
    field = F.when(F.col("conv_id") % 2 == 0, "title").otherwise("completed")
    raw = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit('Sure. {"merged": "'), line, F.lit('"} Done.')))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit('```json\n{"'), field, F.lit('": "'), line, F.lit('", "next_steps": "go"}\n```'))).otherwise('{"merged": "distinct"}')
    )
    a = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", raw.alias("raw"))
    s = imports.summaries(a.where("turn % 3 = 1")).select("conv_id", "turn", F.col("text").alias("summary"), "narrative")
    return a.select("conv_id", "turn", imports.merged_text(F.col("raw")).alias("merged")).join(s, ["conv_id", "turn"], "left")


@query(f"""WITH c AS (SELECT conv_id, turn, {_LINE} AS line FROM conversations WHERE text IS NOT NULL AND turn % 2 = 0), t AS (SELECT *, regexp_replace(trim(line), '\\.+\\z', '') AS x FROM c)
SELECT conv_id, turn, CASE WHEN length(x) <= 400 THEN x WHEN {_CUT.replace('(t,', '(x,').format(400)} <> '' THEN {_CUT.replace('(t,', '(x,').format(400)} || '…' ELSE substr(x, 1, 400) END AS text, 'Root cause: c' || chr(10) || 'DO: d' || conv_id AS narrative, CASE WHEN conv_id % 3 = 0 THEN 'global' ELSE 'project' END AS scope,
CASE WHEN conv_id % 4 = 0 THEN 'a' ELSE '' END AS supersedes FROM t WHERE x <> ''""")
def distilled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r'["\\]', "")
    n = F.col("conv_id")
    one = F.concat(
        F.lit('{"antipatterns": [{"title": "t", "scope": "'), F.when(n % 3 == 0, " Global ").otherwise("here"), F.lit('", "root_cause": "c", "strict_rule": "'), line, F.lit('", "dont": " ", "do": "d'), n.cast("string"), F.lit('", "supersedes": ['),
        F.when(n % 4 == 0, '"a", "none"').otherwise('"n/a"'), F.lit("]}]}"),
    )
    a = table(spark, sf_dir, "conversations").where("text is not null and turn % 2 = 0").select("conv_id", "turn", one.alias("raw"))
    return imports.antipatterns(a).select("conv_id", "turn", "text", "narrative", "scope", F.array_join("supersedes", ",").alias("supersedes"))


_TOOLS = ("Grep", "Read", "Glob", "Edit", "Read")
_CALLS = f"""SELECT user_id AS session, event_id AS tick, {_QUOTED(_TOOLS)}[1 + CAST(event_id * 7 % 5 AS INT)] AS name, CASE WHEN event_id % 4 = 0 THEN '10' END AS "limit", 'src/file_' || (event_id % 9) || '.py' AS file_path,
CASE WHEN event_id % 2 = 0 THEN 'pat' || (event_id % 3) END AS pattern, 'dir' || (event_id % 5) AS path, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    say = lambda head, k, tail="": F.concat(F.lit(head), (n % k).cast("string"), F.lit(tail))
    return e.select(
        F.col("user_id").alias("session"), n.alias("at"), F.element_at(F.array(*map(F.lit, _TOOLS)), (n * 7 % 5 + 1).cast("int")).alias("name"), F.when(n % 4 == 0, "10").alias("limit"), say("src/file_", 9, ".py").alias("file_path"),
        F.when(n % 2 == 0, say("pat", 3)).alias("pattern"), say("dir", 5).alias("path"), F.floor(F.col("value") * 100).cast("long").alias("bytes"),
    )


_SWEEPS = f"""c AS ({_CALLS}), k AS (SELECT *, name IN ('Grep', 'Glob', 'Read') AND (name <> 'Read' OR "limit" IS NULL) AS s FROM c), g AS (SELECT *, sum(CASE WHEN s THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY tick ROWS UNBOUNDED PRECEDING) AS run FROM k),
t AS (SELECT session, run, min(tick) AS first, count(*) AS calls, CAST(sum(bytes) AS BIGINT) AS cost_bytes, arg_max(file_path, tick) FILTER (name = 'Read') AS landing FROM g WHERE s GROUP BY session, run HAVING count(*) >= 2),
o AS (SELECT session, run, coalesce(pattern, path) AS term, min(tick) AS tick FROM g WHERE s GROUP BY ALL), q AS (SELECT session, run, string_agg(term, ' ' ORDER BY tick) AS terms FROM o GROUP BY ALL),
w AS (SELECT session, first, calls, cost_bytes, landing, substr(terms || ' ' || replace(regexp_extract(landing, 'file_[0-9]'), '_', ' '), 1, 200) AS query FROM t JOIN q USING (session, run) WHERE landing IS NOT NULL)"""


@query(f"WITH {_SWEEPS} SELECT * FROM w")
def landed_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.landed_sweeps(_calls(spark, sf_dir))


@query(f"""WITH {_SWEEPS}, i AS (SELECT *, 300 + 100 * (first % 3) + 150 * (first % 2) + 400 AS indexed, landing IN ('src/file_1.py', 'src/file_4.py') OR (first % 2 = 0 AND landing = 'src/file_7.py') AS met FROM w)
SELECT count(*) AS sweeps, CAST(sum(CAST(met AS INT)) AS BIGINT) AS creditable, CAST(sum(cost_bytes // 4) AS BIGINT) AS actual_tokens, CAST(sum(CASE WHEN met THEN floor((cost_bytes - indexed) / 4.0) ELSE 0 END) AS BIGINT) AS saved_tokens FROM i""")
def replay_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index would have saved, had it found some of the landings."""
    s = evalkit.landed_sweeps(_calls(spark, sf_dir)).withColumn("sweep", F.struct("session", "first"))
    paths = F.array(F.lit("file_1.py"), F.lit("src/file_4.py"), F.when(F.col("first") % 2 == 0, "file_7.py").otherwise(""))
    hits = s.select("sweep", F.explode(paths).alias("path"), (300 + 100 * (F.col("first") % 3)).alias("outline_bytes"), (150 * (F.col("first") % 2)).alias("body_bytes"))
    return evalkit.replay_totals(evalkit.credit(s, hits))


@query("SELECT user_id, event_id, rank() OVER w + (count(*) OVER (PARTITION BY user_id, floor(value)) - 1) / 2.0 AS rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY floor(value))")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("v"))
    return evalkit.average_ranks(e, "user_id", "v").select("user_id", "event_id", "rank")


@query(_bm25_sql("SELECT doc_id AS id, text, source FROM documents", "SELECT 0 AS qid, 'the these rest thing' AS query", {"text": 1.0}, """,
m AS (SELECT id, row_number() OVER (ORDER BY bm25, id) AS rank FROM b JOIN d USING (id) WHERE source = 'src1'), o AS (SELECT id, row_number() OVER (ORDER BY bm25, id) AS rank FROM b JOIN d USING (id) WHERE source IN ('src1', 'src2')),
u AS (SELECT id, 0 AS l, rank FROM m WHERE rank <= 30 UNION ALL SELECT id, 1, rank FROM o WHERE id NOT IN (SELECT id FROM m WHERE rank <= 30) AND rank <= 50)
SELECT id, row_number() OVER (ORDER BY l, rank, id) AS place FROM u ORDER BY l, rank, id LIMIT 40"""))
def keyword_lists_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project's keyword hits, then those of a wider scope that it lacks."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "text", "source")
    hits = fts.bm25(d, spark.range(1).select(F.col("id").alias("qid"), F.lit("the these rest thing").alias("query")), {"text": 1.0}).join(d.select("id", "source"), "id")
    first, then = fts.pool(hits.where("source = 'src1'"), 30), fts.pool(hits.where("source in ('src1', 'src2')"), 50)
    return fts.in_turn(first, then, 40).select("id", F.col("place").cast("long").alias("place"))


@query("""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents WHERE text IS NOT NULL), g AS (SELECT id, ws[1] || '_' || ws[2] AS p FROM d WHERE len(ws) > 1 AND id % 40 = 3),
a AS (SELECT id, len(ws) AS length, unnest(range(1, len(ws))) AS i, ws FROM d), h AS (SELECT id, length, ws[i] || '_' || ws[i + 1] AS p, count(*) AS tf FROM a GROUP BY ALL), m AS (SELECT g.id AS qid, h.* FROM g JOIN h USING (p)),
n AS (SELECT p, count(DISTINCT id) AS holders FROM m GROUP BY p), s AS (SELECT count(*) AS docs, (SELECT sum(len(ws)) FROM d) AS tokens FROM documents)
SELECT qid, id, round(-(CASE WHEN ln((docs - holders + 0.5) / (holders + 0.5)) > 0 THEN ln((docs - holders + 0.5) / (holders + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (tokens / docs)))), 6) AS bm25 FROM m JOIN n USING (p), s""".replace("h.* FROM g JOIN h USING (p)", "h.id, h.length, h.tf, h.p FROM g JOIN h ON g.p = h.p"))
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words of a document, joined by an underscore, as a phrase."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "text")
    from ..functions import text

    w = text.words(F.col("text"))
    asked = d.where((F.col("id") % 40 == 3) & (F.size(w) > 1)).select(F.col("id").alias("qid"), F.concat_ws("_", w[0], w[1]).alias("query"))
    return fts.bm25(d, asked, {"text": 1.0})
