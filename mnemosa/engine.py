"""The engine as one object: tables by project and key, reads as DataFrames, writes of the partitions that change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import schemas
from .config import DEFAULT, Config
from .functions import rules, scoring, text, vec
from .operators import admin, dml, fts, graph, index, lifecycle, pack, retrieve, rollups, scans, sensory, work_queue
from .operators.term_index import TermIndex
from .sources import chunking, imports, transcript
from .store import Ledger, Part, Table, checkpointed

FACT_COLUMNS = ["text", "title", "subtitle", "narrative", "file_names"]
CHUNK_WEIGHTS = {"title": 3.0, "heading_path": 2.0, "summary": 1.5, "body": 1.0}
#: Texts whose embeddings show that an embedder has changed are the operator's own; sixteen of them.
CANARIES = (
    "a fact about storage", "the build failed on the server", "use tabs and not spaces", "the user prefers short answers", "login returns an error", "cache the result of the query", "rename the column",
    "the release is on friday", "tests run in parallel", "the key is rotated each month", "an index speeds up the join", "logs go to the shared disk", "retry after a timeout", "the page has two forms",
    "numbers are rounded half to even", "write the file before the marker",
)
GUIDANCE = {
    "ok": "The facts fit the question.", "low_confidence": "The facts may not fit the question: look further.", "no_memory": "Nothing is known about this.",
    "embedding_mismatch": "Facts are stored, but by another embedder: embed them anew.",
}


def heuristic(texts: DataFrame) -> DataFrame:
    """Records (seq, text, degraded) of texts (seq, text): their lines, without a model."""
    lines = texts.select("seq", F.posexplode(text.heuristic_facts(F.col("text"))).alias("_at", "text"))
    return lines.select((F.shiftleft("seq", 4) + F.col("_at")).alias("seq"), "text", F.lit(True).alias("degraded"))


class Engine:
    """Facts, chunks, ledgers, queue, register and edges under one root folder.

    embed gives the vector of a Column of texts, embed_query that of a question where it
    isn't the same; distil the records (seq, text and
    any of title, subtitle, narrative, files, type, observation_id, supersedes,
    scope, degraded) of texts (seq, text).  Both have defaults that need no model.
    extractors give the symbols of a source by the suffix of its file.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config = DEFAULT, embed: Callable[[Column], Column] | None = None, distil: Callable[[DataFrame], DataFrame] = heuristic, model: str = "hash", extractors: dict | None = None, embed_query: Callable[[Column], Column] | None = None):
        self.spark, self.c, self.distil, self.model, self.extractors = spark, config, distil, model, extractors or chunking.EXTRACTORS
        self.embed = embed or (lambda t: vec.hash_embed(t, self.c.dim))
        self.embed_query = embed_query or self.embed
        c = self.c
        table = lambda name, schema, key, project=None: Table(spark, f"{root}/{name}", schema, key, project, c.project_buckets, c.key_buckets)
        self.facts, self.senses = table("facts", schemas.FACTS, "id", "project_key"), table("sensory", schemas.SENSORY, "id", "project_key")
        self.chunks, self.sources = table("chunks", schemas.CHUNKS, "source_path", "project_key"), table("chunk_sources", schemas.CHUNK_SOURCES, "source_path", "project_key")
        self.queue, self.edges, self.meta, self.cursors = table("work_queue", schemas.WORK_QUEUE, "msg_id"), table("fact_edges", schemas.EDGES, "src_id"), table("index_meta", schemas.INDEX_META, "project_key"), table("capture_cursors", schemas.CURSORS, "cursor_key")
        self.usage, self.recalls = Ledger(spark, f"{root}/usage_events", schemas.USAGE_EVENTS), Ledger(spark, f"{root}/recall_events", schemas.RECALL_EVENTS)
        self.canary = table("embedder_canary", schemas.CANARY, "id")
        self.fact_terms, self.chunk_terms = (TermIndex(spark, f"{root}/{n}", cols, c.term_buckets, c.term_segments) for n, cols in (("fact_terms", FACT_COLUMNS), ("chunk_terms", list(CHUNK_WEIGHTS))))

    # Vectors and keyword postings

    def _embedded(self, rows: DataFrame, of: Column | None = None) -> DataFrame:
        """rows with vec, and what of it is stored."""
        v = rows.withColumn("vec", vec.truncate_renorm(self.embed(F.col("text") if of is None else of), self.c.truncate_dim)).withColumn("scale", vec.scale_of(F.col("vec")))
        stored = F.transform(vec.quantize_int8(F.col("vec"), F.col("scale")), lambda x: x.cast("tinyint"))
        return v.withColumns({"dim": F.size("vec"), "vec_int8": stored, "vec_bits": vec.pack_bits(F.col("vec"))})

    def _with_vectors(self, rows: DataFrame) -> DataFrame:
        """rows with vec as it is stored; nothing is embedded again."""
        return rows.withColumn("vec", vec.dequantize_int8(F.col("vec_int8"), F.col("scale")))

    def _query(self, query: str) -> DataFrame:
        return self.spark.range(1).select(vec.truncate_renorm(self.embed_query(F.lit(query)), self.c.truncate_dim).alias("q"))

    def _asked(self, query: str) -> DataFrame:
        return self.spark.range(1).select(F.col("id").alias("qid"), F.lit(query).alias("query"))

    @staticmethod
    def _texts_of_facts(facts: DataFrame) -> DataFrame:
        texts = facts.select("id", *FACT_COLUMNS[:4], F.array_join("files", " ").alias("file_names"))
        return texts.withColumn("version", F.sha2(F.to_json(F.struct(*FACT_COLUMNS)), 256))

    @staticmethod
    def _texts_of_chunks(chunks: DataFrame) -> DataFrame:
        return chunks.select("id", *CHUNK_WEIGHTS).withColumn("version", F.sha2(F.to_json(F.struct(*CHUNK_WEIGHTS)), 256))

    def _put(self, table: Table, rows: DataFrame, parts: list[Part], new: DataFrame | None = None) -> int:
        """rows in place of the facts or chunks of the partitions, and the postings in step; new, if given, are all whose texts are new."""
        terms, texts = (self.fact_terms, self._texts_of_facts) if table is self.facts else (self.chunk_terms, self._texts_of_chunks)
        before = checkpointed(table.read(parts).select("id")) if new is None else None
        v = table.replace(rows, parts)
        now = texts(table.read(parts) if new is None else new)
        terms.update(now, None if before is None else before.join(now.select("id"), "id", "left_anti"))
        return v

    def _remove(self, table: Table, gone: DataFrame) -> int:
        """The facts or chunks without gone (id, and what places them)."""
        gone = checkpointed(gone.select("id", *({table.key, table.project} - {"id"})))
        parts = table.parts_of(gone)
        return self._put(table, table.read(parts).join(gone.select("id"), "id", "left_anti"), parts)

    def repair(self) -> int:
        """Finish writes whose writer died, and bring the postings in step with the tables; how many documents were not."""
        for t in (self.facts, self.chunks, self.sources, self.queue, self.edges, self.meta, self.cursors, self.senses, self.canary):
            t.recover()
        return self.fact_terms.replace(self._texts_of_facts(self.facts.read())) + self.chunk_terms.replace(self._texts_of_chunks(self.chunks.read()))

    def _placed_facts(self, ids: DataFrame) -> DataFrame:
        """id, project_key of facts by id, of which only these two columns are read."""
        return checkpointed(self.facts.read().select("id", "project_key").join(ids.select("id").distinct(), "id", "left_semi"))

    def _marked(self, ids: DataFrame, how: Callable[[DataFrame], DataFrame]) -> int:
        """how() over the partitions of facts by id; texts stay as they are."""
        return self.facts.change(self._placed_facts(ids), how)

    def _scope(self, project: str | None) -> DataFrame:
        """The facts that a recall for a project sees, read from its partitions and those of the global rules."""
        near = None if project is None else [project, retrieve.GLOBAL]
        return self.facts.read(projects=near).where(retrieve.in_scope(project))

    def _keyword_hits(self, terms: TermIndex, query: str, weights: list[float], keep: DataFrame, k: int) -> DataFrame:
        """id, bm25 of the best k, and perhaps of others."""
        return terms.search(self._asked(query), weights, keep, k).select("id", "bm25")

    def _fact_hits(self, query: str, project: str | None, facts: DataFrame, limit: int) -> DataFrame:
        """id, bm25 (a place, in order) of the keyword hits of a recall: the project's own, then the global ones, `limit` of each."""
        weights, active = [1.0] * len(FACT_COLUMNS), scans.active(facts)
        own = active if project is None else active.where(F.col("project_key") == project)
        ranked = lambda keep: retrieve.top(self._keyword_hits(self.fact_terms, query, weights, keep, limit).withColumn("_s", -F.col("bm25")), "_s", limit).select("id", "rank")
        first, everywhere = ranked(own), active.where(F.col("project_key") == retrieve.GLOBAL)
        if project is None or project == retrieve.GLOBAL or everywhere.isEmpty():
            return first.select("id", F.col("rank").alias("bm25"))
        return fts.in_turn(first, ranked(everywhere), 2 * limit).select("id", F.col("place").alias("bm25"))

    # Writing facts

    def capture(self, texts: DataFrame, project: str, now: float, kind: str = "fact", tier: str = "stm", session: str | None = None) -> int:
        """Facts that the distiller finds in texts (text): known ones are reinforced, new ones added, similar older ones superseded."""
        seen = texts.select(F.monotonically_increasing_id().alias("seq"), "text").where(~rules.is_distiller_prompt(F.coalesce("text", F.lit(""))))
        return self.add_records(self.distil(seen), project, now, kind, tier, session)

    def add_records(self, records: DataFrame, project: str, now: float, kind: str = "fact", tier: str = "stm", session: str | None = None) -> int:
        """Records in the order of seq, each reinforcing the fact of its text or adding it.

        A new fact supersedes the facts that it names (supersedes: ids of the project) and
        those as similar as the threshold that are active at its time.  With a spread
        weight, facts captured together or sharing a name are joined by edges.
        """
        empty = {"title": "string", "subtitle": "string", "narrative": "string", "files": "array<string>", "type": "string", "observation_id": "string", "supersedes": "array<string>"}
        named = records.where("trim(text) <> ''").select("seq", "text", *(F.col(c).cast(t) if c in records.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()))
        rows = named.withColumns({"id": text.content_id(F.lit(project), F.col("text")), "project_key": F.lit(project), "kind": F.lit(kind), "session_id": F.lit(session).cast("string")})
        rows = checkpointed(rows)  # a distiller may not give the same twice
        parts = self.facts.parts_of(rows)
        old = self.facts.read(parts)
        once = rows.groupBy("id").agg(F.min(F.struct("seq", *(c for c in rows.columns if c not in ("seq", "id")))).alias("_f")).select("id", "_f.*")
        first = checkpointed(self._embedded(once.join(old.select("id"), "id", "left_anti")))
        blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
        new = first.select(
            "id", "project_key", "kind", "session_id", "text", *map(blank, ("title", "subtitle", "narrative", "type", "observation_id")), "files", "dim", "scale", "vec_int8", "vec_bits", F.lit(now).alias("created_at"),
            F.lit(now).alias("last_seen"), F.lit(1).alias("frequency"), F.lit("active").alias("status"), F.lit(tier).alias("tier"), scoring.importance(F.col("text")).alias("importance"),
        )
        seen = rows.select("id", "seq").join(first.select("id", "seq"), ["id", "seq"], "left_anti").select("id")
        new = schemas.upgrade(new, schemas.FACTS)
        victims = self._victims(new, rows, first, project)
        parts = sorted({*parts, *self.facts.parts_of(victims.select("id", F.lit(project).alias("project_key")))})
        stored = lifecycle.reinforce(self.facts.read(parts).unionByName(new), seen, now, self.c.promote_after_freq)
        v = self._put(self.facts, self._superseded(stored, victims), parts, new)
        if self.c.spread_weight > 0 and kind == "fact":
            self._record_edges(rows, project)
        return v

    def _victims(self, new: DataFrame, rows: DataFrame, first: DataFrame, project: str) -> DataFrame:
        """id, by, ends: whom a new fact of first superseded while it was active, the last time; ends says that it wasn't seen again afterwards.

        Reads the project's partitions only.
        """
        mine = self.facts.read(projects=[project]).where(F.col("project_key") == project)
        alive = mine.where("status = 'active'").select("id", F.lit(-1).cast("long").alias("seq"))
        spans = alive.unionByName(rows.select("id", "seq")).withColumn("until", F.lead("seq").over(W.partitionBy("id").orderBy("seq"))).withColumn("key", F.concat_ws(":", "id", "seq"))
        named = first.select(F.col("id").alias("by"), F.col("seq").alias("by_seq"), F.explode("supersedes").alias("id")).where("id <> by").join(spans, "id").where("by_seq > seq")
        hits = named.select("key", "id", "until", "by", "by_seq")
        if self.c.supersede_threshold < 1:
            vectors = self._with_vectors(mine.unionByName(new).where(F.col("dim") == self.c.size()).select("id", "vec_int8", "scale")).select("id", "vec")
            similar = lifecycle.superseding_new(spans.join(vectors, "id"), first, self.c.supersede_threshold)
            hits = hits.unionByName(spans.select("key", "id", "until").join(similar, "key"))
        hits = hits.where("until is null or by_seq < until")
        last = hits.groupBy("id", "until").agg(F.min(F.struct("by_seq", "by")).alias("_f")).groupBy("id").agg(F.max(F.struct("_f.by_seq", "_f.by", F.col("until").isNull().alias("ends"))).alias("_h"))
        return checkpointed(last.select("id", "_h.by", "_h.ends"))

    @staticmethod
    def _superseded(stored: DataFrame, victims: DataFrame) -> DataFrame:
        again = victims.where("not ends").select("id", F.col("by").alias("_by"))
        marked = stored.join(again, "id", "left").withColumn("superseded_by", F.coalesce("_by", "superseded_by")).drop("_by")
        return lifecycle.supersede(marked, victims.where("ends").select("id", "by"))

    def _record_edges(self, rows: DataFrame, project: str, batch: int = 50, most: int = 8) -> None:
        """Edges between the first facts of a capture, and from each to the best keyword hits of the names in it."""
        held = rows.orderBy("seq").limit(batch).select("id", "text")
        together = graph.co_occurrence(held.select("id", F.lit(0).alias("g")).distinct(), "g", batch)
        entities = held.select("id", F.explode(text.entities(F.col("text"))).alias("entity"))
        asked = entities.select(F.xxhash64("entity").alias("qid"), F.col("entity").alias("query")).distinct()
        mine = scans.active(self.facts.read(projects=[project]), project)
        found = fts.pool(self.fact_terms.search(asked, [1.0] * len(FACT_COLUMNS), mine, most), most)
        mentions = entities.withColumn("qid", F.xxhash64("entity")).join(found.select("qid", F.col("id").alias("other")), "qid")
        shared = mentions.select(F.col("id").alias("src"), F.col("other").alias("dst"), F.lit("entity").alias("kind"), F.lit(1.0).alias("weight"))
        self.link(together.unionByName(shared))

    def cursor(self, key: str) -> int:
        return scans.cursor(self.cursors.read(), self.spark.createDataFrame([(key,)], "cursor_key string")).first()["offset"]

    def capture_transcript(self, path: str, project: str, session: str, now: float) -> int:
        """What a transcript (JSON lines) gained since the last call: its prompts word for word, its facts, and all of it in the register.

        The new end is kept even if nothing came of it; a file that was replaced is read anew.  How many lines were new.
        """
        key = f"{project}:{session or path}"
        lines, end = transcript.read_delta(self.spark, path, start := self.cursor(key))
        if end == start:
            return 0
        parts = checkpointed(transcript.texts(self.spark.createDataFrame([(x,) for x in lines], "value string").withColumn("at", F.monotonically_increasing_id()), order="at"))
        whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text")).where("text <> ''")
        self.perceive(whole.select(F.lit(project).alias("project_key"), F.lit("verbal").alias("modality"), F.lit(None).cast("string").alias("url"), "text", F.lit(session).alias("observation_id"), F.lit(float(now)).alias("created_at")), now)
        self.capture_prompts(parts.where("role = 'user'"), project, now, session)
        self.capture(whole, project, now, session=session)
        self.set_cursor(key, end, now)
        return len(lines)

    def maybe_capture(self, kind: str, path: str, project: str, session: str, now: float, make: Callable[[DataFrame], DataFrame], force: bool = False, least: int = 8000) -> bool:
        """A session's summary, or its rules (kind `summary` or `antipat`), once its transcript has grown by `least` bytes; whether it was looked at.

        make gives the records of texts (role, text).  Rules are looked for only if the
        texts admit a mistake; the new size is kept either way.
        """
        key, size = f"{kind}:{project}:{session or path}", transcript.size_of(self.spark, path)
        if not force and size - self.cursor(key) < least:
            return False
        texts = transcript.texts(self.spark.read.text(path))
        if kind == "summary":
            self.capture_summary(make(texts), project, session, now)
        elif not texts.where(rules.has_admission(F.col("text"))).isEmpty():
            self.capture_antipatterns(make(texts), project, now, session)
        self.set_cursor(key, size, now)
        return True

    def capture_prompts(self, prompts: DataFrame, project: str, now: float, session: str | None = None) -> int:
        """What users asked (text), word for word: known ones are reinforced, without promotion; new ones supersede nothing."""
        rows = checkpointed(prompts.where("trim(text) <> ''").select(text.content_id(F.lit(project), F.col("text")).alias("id"), "text", F.lit(project).alias("project_key")))
        parts = self.facts.parts_of(rows)
        old = self.facts.read(parts)
        counts = rows.groupBy("id").agg(F.min("text").alias("text"), F.count("*").alias("n"))
        first = self._embedded(counts.join(old.select("id"), "id", "left_anti"))
        fixed = {"project_key": project, "session_id": session, "kind": "prompt", "type": "prompt", "status": "active", "tier": "stm", "importance": 0.5, "created_at": now, "last_seen": now}
        new = first.withColumn("frequency", F.col("n").cast("int")).withColumns({k: F.lit(v) for k, v in fixed.items()})
        again = rows.join(first.select("id"), "id", "left_anti").select("id")
        new = checkpointed(schemas.upgrade(new, schemas.FACTS))
        return self._put(self.facts, lifecycle.reinforce(old, again, now).unionByName(new), parts, new)

    def capture_summary(self, summary: DataFrame, project: str, session: str, now: float) -> int:
        """The summary of a session (a record, see add_records) in place of its older one; none leaves the older one."""
        if summary.isEmpty():
            return self.facts.version()
        mine = self.facts.read(projects=[project]).where(F.col("project_key") == project)
        self._remove(self.facts, mine.join(dml.clear_session_kind(mine, project, session, "session_summary").select("id"), "id", "left_anti"))
        return self.add_records(summary, project, now, "session_summary", session=session)

    def capture_antipatterns(self, records: DataFrame, project: str, now: float, session: str | None = None) -> int:
        """Rules (records with scope), those of scope global for all projects; they are long-term from the start."""
        everywhere = F.coalesce("scope", F.lit("project")) == "global" if "scope" in records.columns else F.lit(False)
        typed = records.withColumn("type", F.lit("antipattern"))
        self.add_records(typed.where(~everywhere), project, now, "antipattern", "ltm", session)
        return self.add_records(typed.where(everywhere), retrieve.GLOBAL, now, "antipattern", "ltm", session)

    def import_source(self, source: imports.Source, keys: DataFrame, now: float, label: str | None = None, dry_run: bool = False) -> DataFrame:
        """label, project_key, inserted, reinforced, batches for each label of a source; keys (label, project_key) says which are taken, others are skipped.

        Facts keep their own times, and nothing is superseded or linked.  A dry run only counts.
        """
        records = source.records(label)
        mapped = records.join(keys.select("label", "project_key"), "label", "left")
        rows = mapped.where("project_key is not null").withColumn("id", text.content_id(F.col("project_key"), F.col("text")))
        parts = self.facts.parts_of(rows)
        old = self.facts.read(parts)
        counts = lifecycle.import_counts(old, rows, mapped)
        if dry_run:
            return counts.select("label", "project_key", F.lit(0).cast("long").alias("inserted"), F.lit(0).cast("long").alias("reinforced"), F.lit(0).cast("long").alias("batches"), (F.col("inserted") + F.col("reinforced")).alias("would_import"))
        counts = checkpointed(counts)  # before the table changes
        first = rows.groupBy("id").agg(F.min(F.struct("seq", *(c for c in rows.columns if c not in ("seq", "id")))).alias("_f")).select("id", "_f.*").join(old.select("id"), "id", "left_anti")
        new = self._embedded(first).withColumns({"created_at": F.coalesce("created_at", F.lit(now)), "status": F.lit("active"), "tier": F.lit("stm"), "frequency": F.lit(1), "kind": F.lit("fact"), "session_id": F.lit("import"), "importance": scoring.importance(F.col("text"))})
        seen = rows.select("id", "seq").join(first.select("id", "seq"), ["id", "seq"], "left_anti").select("id")
        new = checkpointed(schemas.upgrade(new, schemas.FACTS))
        self._put(self.facts, lifecycle.reinforce(old.unionByName(new), seen, now, self.c.promote_after_freq), parts, new)
        return counts.withColumn("would_import", F.lit(None).cast("long"))

    def rescue(self, now: float, limit: int = 3, owner: str = "rescue") -> int:
        """Texts that only the heuristic had distilled go through the distiller again; how many came out better."""
        items = work_queue.claim(self.queue.read(), now, self.c.lease_ttl, limit, owner, "rescue")
        taken = checkpointed(items)
        self.queue.apply(lambda q: work_queue.apply(q, taken))
        done = 0
        for item in work_queue.payloads(taken).orderBy("msg_id").collect():  # at most `limit`
            one = self.spark.createDataFrame([(item["msg_id"],)], "msg_id string")
            if item["text"] is None:
                self.queue.apply(lambda q, one=one: work_queue.term(q, one))
                continue
            records = self.distil(self.spark.createDataFrame([(0, item["text"])], "seq long, text string"))
            better = records.isEmpty() or ("degraded" in records.columns and records.where("not degraded").isEmpty())
            if better:
                self.queue.apply(lambda q, one=one: work_queue.nak(q, one, now, self.c.queue_backoff, self.c.queue_max_deliver))
                continue
            gone = self.spark.createDataFrame([(x,) for x in item["fact_ids"] or []], "id string")
            self._remove(self.facts, self._placed_facts(gone))
            self.add_records(records, item["project_key"], now, session=item["session_id"])
            self.queue.apply(lambda q, one=one: work_queue.ack(q, one))
            done += 1
        return done

    def park(self, records: DataFrame, delta: str, project: str, session: str, now: float) -> int:
        """Publish a text for rescue if all its records (text, degraded) are degraded."""
        ids = records.withColumn("id", text.content_id(F.lit(project), F.col("text")))
        item = work_queue.degraded(ids, project, delta, session, now)
        return self.queue.apply(lambda q: work_queue.publish(q, schemas.upgrade(item, schemas.WORK_QUEUE)))

    # Recall

    def recall(self, query: str, project: str | None, now: float, k: int | None = None) -> DataFrame:
        """Facts by fused ranks of five channels."""
        f, limit = self._scope(project), max(4 * (k or self.c.top_k), 50)
        hits = self._fact_hits(query, project, f, limit)
        found = retrieve.search_fused(self._with_vectors(f), self._query(query).select("q"), query, hits, self.c, k, pool=2 * limit)
        return found.join(f.select("id", "text", "title", "kind", "frequency"), "id").orderBy("rank")

    def recall_structured(self, query: str, project: str, now: float, k: int | None = None, max_chars: int | None = None) -> DataFrame:
        """One row: query, project, verdict, confidence, guidance, facts (text, similarity, kind, frequency), returned, matched, dropped; logged, and its facts marked."""
        hits = checkpointed(self.recall(query, project, now, k or max(self.c.activated_k, self.c.top_k)))
        packed = pack.skip(hits.withColumns({"all": F.lit(0), "cost": F.length("text")}), ["all"], "rank", "cost", max_chars or self.c.recall_max_chars)
        chosen = hits.join(packed.select("id"), "id", "left_semi")
        identity = F.when(F.size(F.array_intersect(text.tokens(F.col("text")), text.tokens(F.lit(query)))) > 0, 1.0).otherwise(0.7)
        sure = retrieve.verdicts(self.spark.range(1).select(F.col("id").alias("qid")).join(hits.select(F.lit(0).cast("long").alias("qid"), "id", "rank", "sim", identity.alias("identity")), "qid", "left"), None, self.c.recall_min_confidence)
        dims = scans.stored_dims(self.facts.read(), project).agg(F.collect_set("dim").alias("dims"))
        size = self._query(query).select(F.size("q").alias("qdim"))
        verdict = F.when((F.col("hits") == 0) & (F.size("dims") > 0) & ~F.array_contains("dims", F.col("qdim")), "embedding_mismatch").otherwise(F.col("verdict"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", F.bround("sim", 4).alias("similarity"), "kind", "frequency"))), lambda x: x.dropFields("rank"))
        out = sure.crossJoin(dims).crossJoin(size).withColumn("verdict", verdict).crossJoin(chosen.agg(listed.alias("facts"), F.count("*").alias("returned")))
        guide = F.element_at(F.create_map(*(F.lit(x) for kv in GUIDANCE.items() for x in kv)), F.col("verdict"))
        out = checkpointed(out.select(F.lit(query).alias("query"), F.lit(project).alias("project"), "verdict", "confidence", guide.alias("guidance"), "facts", "returned", F.col("hits").alias("matched"), (F.col("hits") - F.col("returned")).alias("dropped"), F.coalesce("top_sim", F.lit(0.0)).alias("top_sim")))
        self.recalls.append(out.select(F.lit(now).alias("ts"), F.lit(project).alias("project_key"), "query", "returned", "top_sim", "confidence", "verdict"))
        self._marked(chosen, lambda f: lifecycle.mark(f, chosen, "recall_count", now))
        return out.drop("top_sim")

    def recall_block(self, query: str, project: str | None, now: float) -> DataFrame:
        """The block of text that a prompt gets: the best facts within max_chars, then the best chunks; logged, and its facts marked."""
        f = self._with_vectors(self.facts.read() if self.c.cross_project else self._scope(project))
        hits = checkpointed(retrieve.search(f, self._query(query), now, project, self.c, edges=self._edges()).withColumn("cost", F.length("text") + 3).withColumn("all", F.lit(0)).select("id", "rank", "text", "cost", "all"))
        head = "Relevant memory:"
        chosen = pack.prefix(hits, ["all"], ["rank"], "cost", self.c.max_chars, len(head))
        facts = pack.block(chosen, ["all"], "rank", "text", head).select("all", F.col("block").alias("facts"))
        chunks = self.index_block(query, project).select(F.lit(0).alias("all"), "block") if project and self.chunks.version() > 0 else self.spark.createDataFrame([], "all int, block string")
        both = self.spark.range(1).select(F.lit(0).alias("all")).join(facts, "all", "left").join(chunks, "all", "left")
        out = checkpointed(both.select(F.concat_ws("\n", "facts", "block").alias("block")).where("block <> ''"))
        if project:
            self.record_usage(out.select(F.lit(project).alias("project_key"), F.lit("inject_prompt").alias("kind"), F.length("block").cast("long").alias("bytes_in")), now)
            chosen = checkpointed(chosen.select("id"))
            self._marked(chosen, lambda t: lifecycle.mark(lifecycle.mark(t, chosen, "recall_count", now), chosen, "injected_count"))
        return out

    def core(self, project: str) -> DataFrame:
        return scans.strongest(self.facts.read(projects=[project]), project, self.c.core_size)

    def core_block(self, project: str, now: float) -> DataFrame:
        """The facts that a session begins with, as a block, logged; they count as injected, not as recalled."""
        best = self.core(project).withColumns({"all": F.lit(0), "cost": F.length("text") + 3})
        order = [F.desc("frequency"), F.desc("last_seen"), F.asc("id")]
        head = "Core memory:"
        chosen = pack.prefix(best, ["all"], order, "cost", self.c.max_chars, len(head)).withColumn("rank", F.row_number().over(W.partitionBy("all").orderBy(*order)))
        out = pack.block(chosen, ["all"], "rank", "text", head).select("block")
        self.record_usage(out.select(F.lit(project).alias("project_key"), F.lit("inject_core").alias("kind"), F.length("block").cast("long").alias("bytes_in")), now)
        return out

    def orientation_block(self, project: str, most: int = 900) -> DataFrame:
        """The latest summary of the project, cut at `most` characters."""
        body = F.concat_ws("\n", F.when(F.col("title") != F.col("text"), F.col("title")), "text", "narrative")
        return scans.latest_summary(self.facts.read(projects=[project]), project).select(F.substring(F.concat(F.lit("Last session:\n"), body), 1, most).alias("block"))

    def antipattern_warning(self, action: str, project: str, session: str | None = None, now: float = 0.0) -> DataFrame:
        """The rules that share two words or more with an action, within 600 characters; with a session, each rule once in it."""
        facts = self._scope(project).where(F.col("kind") == "antipattern")
        told = F.concat(F.lit(f"warned:{session}:"), F.col("id"))
        if session is not None:
            facts = facts.join(self.cursors.read().select(F.col("cursor_key").alias("_told")), told == F.col("_told"), "left_anti")
        all_text = F.concat_ws(" ", "text", "narrative")
        found = index.warnings(self._asked(action).select(F.col("qid").alias("action_id"), text.tokens(F.col("query")).alias("tokens")), facts.select("id", "text", text.tokens(all_text).alias("tokens")))
        rows = found.join(facts.select("id", "text"), "id").select("id", "text", "shared").orderBy(F.desc("shared"), "id")
        if session is None:
            return rows
        rows = checkpointed(rows)
        self.cursors.upsert(rows.select(told.alias("cursor_key"), F.lit(0).cast("long").alias("offset"), F.lit(float(now)).alias("updated_at")))
        return rows

    # Ledgers, counters, edges

    def record_usage(self, rows: DataFrame, now: float) -> int:
        """Append rows (project_key, kind, bytes_in, bytes_saved) to the usage ledger."""
        return self.usage.append(rows.withColumn("ts", F.lit(float(now))))

    def mark_used(self, ids: DataFrame) -> int:
        return self._marked(ids, lambda f: lifecycle.mark(f, ids, "used_count"))

    def link(self, edges: DataFrame) -> int:
        new = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "kind", "weight")
        new = checkpointed(graph.upsert(new).withColumnsRenamed({"src": "src_id", "dst": "dst_id"}))
        return self.edges.change(new, lambda old: graph.upsert(old.unionByName(new).withColumnsRenamed({"src_id": "src", "dst_id": "dst"})).withColumnsRenamed({"src": "src_id", "dst": "dst_id"}))

    def _edges(self) -> DataFrame:
        return self.edges.read().withColumnsRenamed({"src_id": "src", "dst_id": "dst"})

    def stats(self) -> DataFrame:
        return rollups.usage_stats(self.usage.read())

    def ledger(self) -> DataFrame:
        """Tokens spent and saved, from both ledgers."""
        usage = self.usage.read().select("project_key", "kind", "bytes_in", "bytes_saved", F.lit(None).cast("string").alias("verdict"))
        recalls = self.recalls.read().select("project_key", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("bytes_in"), F.lit(None).cast("long").alias("bytes_saved"), "verdict")
        return rollups.usage_summary(usage.unionByName(recalls))

    # Lifecycle

    def sweep(self, now: float) -> int:
        return self.facts.apply(lambda f: lifecycle.sweep(f, now, self.c.ttl_days * 86_400, self.c.ttl_keep_frequency)) if self.c.ttl_days > 0 else self.facts.version()

    def consolidate(self, now: float, files: DataFrame | None = None, horizon: float = 0) -> DataFrame:
        """Replay, displacement, near-duplicates, refinement, stale rules, purge, over all projects: one row of counts by step."""
        facts = self._with_vectors(self.facts.read())
        done = checkpointed(lifecycle.consolidation(facts, now, self.c.stm_capacity, self.c.integrate_threshold, self.c.refine_keep_max, self.c.refine_prune_percentile, horizon, files=files))
        gone = done.where("purged = 1").select("id")
        self.facts.write(schemas.upgrade(done.where("purged = 0"), schemas.FACTS))
        self.fact_terms.update(self._texts_of_facts(self.facts.read().limit(0)), gone)
        return lifecycle.consolidation_counts(done)

    def prune(self, project: str) -> int:
        mine = self.facts.read(projects=[project])
        return self._remove(self.facts, mine.join(dml.prune_project(mine, project).select("id"), "id", "left_anti"))

    def delete_memory(self, project: str, card: str) -> int:
        """The facts of an observation, or the one of an id, and edges that ended there."""
        mine = self.facts.read(projects=[project])
        facts, edges = dml.delete_memory(mine, self._edges(), project, card)
        gone = checkpointed(mine.select("id", "project_key").join(facts.select("id"), "id", "left_anti"))
        self.edges.write(edges.withColumnsRenamed({"src": "src_id", "dst": "dst_id"}))
        return self._remove(self.facts, gone)

    def delete_project(self, project: str) -> DataFrame:
        """All rows of a project in nine tables: name, removed.  One table after the other; done again, it finishes what was left."""
        names = {"facts": self.facts, "recall_events": self.recalls, "usage_events": self.usage, "chunks": self.chunks, "chunk_sources": self.sources, "work_queue": self.queue, "index_meta": self.meta, "cursors": self.cursors}
        left, counts = admin.delete_project({n: t.read() for n, t in names.items()} | {"edges": self._edges()}, project)
        counts = checkpointed(counts)
        self.edges.write(left["edges"].withColumnsRenamed({"src": "src_id", "dst": "dst_id"}))
        for n, t in names.items():
            if t in (self.facts, self.chunks):
                mine = t.read(projects=[project])
                self._remove(t, mine.where(F.col("project_key") == project))
            else:
                t.write(left[n])
        return counts

    # Index of files and pages

    def index(self, files: DataFrame, project: str, now: float, scope: str | None = None, most: int = 2_000_000) -> DataFrame:
        """Index Markdown and Python files (source_path, body, and mtime_ns if known): one row of files, skipped, chunks, deleted.

        Files of the same content as before are skipped, those over `most` bytes too.
        With scope ("" for the whole project), indexed files under it that are not among
        files are deleted.
        """
        mtime = F.col("mtime_ns") if "mtime_ns" in files.columns else F.lit(None).cast("long")
        live = checkpointed(files.where(F.octet_length("body") <= most).select("source_path", "body", mtime.alias("mtime_ns"), F.sha2("body", 256).alias("file_hash")))
        due = scans.needs_index(live, self.sources.read(), project)
        changed = due.where("why <> 'touched'")
        new = checkpointed(self._chunks_of(changed, project, now))
        gone = scans.vanished(self.sources.read(), live, project, scope).withColumn("project_key", F.lit(project)) if scope is not None else self.spark.createDataFrame([], "source_path string, project_key string")
        gone = checkpointed(gone)
        replaced = changed.select(F.lit(project).alias("project_key"), "source_path")
        files_now = due.select(F.lit(project).alias("project_key"), "source_path", "file_hash", "mtime_ns", F.lit(float(now)).alias("indexed_at"))
        counts = changed.agg(F.count("*").alias("files")).crossJoin(live.agg(F.count("*").alias("n"))).crossJoin(new.agg(F.count("*").alias("chunks"))).crossJoin(gone.agg(F.count("*").alias("deleted")))
        counts = checkpointed(counts.select("files", (F.col("n") - F.col("files")).alias("skipped"), "chunks", "deleted"))
        files_now, replaced = checkpointed(files_now), checkpointed(replaced)
        parts = self.chunks.parts_of(replaced, gone)
        chunks = dml.delete_sources(dml.delete_sources(self.chunks.read(parts), replaced), gone)
        self._put(self.chunks, dml.replace_chunks(chunks, new), parts)
        parts = self.sources.parts_of(files_now, gone)
        self.sources.replace(dml.upsert(dml.delete_sources(self.sources.read(parts), gone), files_now, ["project_key", "source_path"]), parts)
        return counts

    def _chunks_of(self, files: DataFrame, project: str, now: float) -> DataFrame:
        docs = chunking.markdown_sections(files.where("source_path rlike '[.](md|mdx)$'")).withColumns({"kind": F.lit("doc_section"), "summary": rules.first_prose_line(F.col("title"), F.col("body"))})
        code = chunking.code_symbols(files, self.extractors).withColumnsRenamed({"signature": "title", "doc": "summary"}).withColumns({"kind": F.lit("code_symbol"), "heading_path": F.regexp_replace("anchor", r"\.?[^.]*$", ""), "level": F.lit(0)})
        columns = ["source_path", "kind", "anchor", "title", "heading_path", "level", "summary", "body", "byte_start", "byte_end"]
        both = chunking.unique_anchors(docs.select(columns).unionByName(code.select(columns)), ["source_path"], "byte_start")
        keyed = both.withColumns({"project_key": F.lit(project), "id": text.chunk_id(F.lit(project), F.col("source_path"), F.col("anchor")), "content_hash": F.sha2("body", 256), "indexed_at": F.lit(float(now))})
        return schemas.upgrade(self._embedded(keyed, rules.embed_text(F.col("title"), F.col("heading_path"), F.col("summary"), F.col("body"))), schemas.CHUNKS)

    def set_index_meta(self, project: str, label: str, path: str, now: float) -> int:
        new = self.spark.createDataFrame([(project, label, path, float(now))], schemas.INDEX_META)
        return self.meta.upsert(new)

    def set_cursor(self, key: str, offset: int, now: float) -> int:
        new = self.spark.createDataFrame([(key, offset, float(now))], schemas.CURSORS)
        return self.cursors.upsert(new)

    def index_snapshot(self, pages: DataFrame, now: float) -> int:
        """Texts of pages (project_key, url, text, seq) as chunks: one for each URL, the last by seq; empty ones change nothing."""
        new = self._embedded(dml.snapshot_chunks(pages, now), rules.embed_text(F.col("title"), F.col("heading_path"), F.col("summary"), F.col("body")))
        new = checkpointed(schemas.upgrade(new, schemas.CHUNKS))
        parts = self.chunks.parts_of(new)
        return self._put(self.chunks, dml.replace_chunks(self.chunks.read(parts), new, snapshots=True), parts)

    def search_index(self, query: str, project: str, kind: str | None = None, k: int = 10, now: float | None = None, live: DataFrame | None = None, max_chars: int | None = None) -> DataFrame:
        """Chunks by fused ranks of vectors and keywords, spread over files, with `matched` (chunks in the pools).

        live (source_path, anchor, content_hash) gives the state of each, as files are now.
        """
        chunks = scans.chunk_rows(self.chunks.read(projects=[project]), project, kind)
        hits = self._keyword_hits(self.chunk_terms, query, list(CHUNK_WEIGHTS.values()), chunks, max(4 * k, 40))
        found = index.search(self._with_vectors(chunks), self._query(query), hits, k, self.c, counted=True)
        rows = found.join(chunks.drop("vec_int8", "vec_bits", "source_path"), "id").withColumn("cost", F.length(F.coalesce("summary", "title"))).withColumn("all", F.lit(0))
        if max_chars is not None:
            rows = pack.prefix(rows, ["all"], ["rank"], "cost", max_chars, first_free=True)
        if live is not None:
            rows = index.freshness(rows, live, now or 0.0)
        return rows.drop("cost", "all", "used").orderBy("rank")

    def index_block(self, query: str, project: str) -> DataFrame:
        """The few lines of the index that a prompt gets."""
        chunks = scans.chunk_rows(self.chunks.read(projects=[project]), project)
        hits = self._keyword_hits(self.chunk_terms, query, list(CHUNK_WEIGHTS.values()), chunks, max(6 * self.c.index_top_k, 12))
        line = F.concat_ws(" ", "source_path", F.concat(F.lit("#"), "anchor"), F.coalesce("summary", "title"))
        best = index.prompt_block(self._with_vectors(chunks).withColumn("title", line), self._query(query), hits, self.c).withColumn("all", F.lit(0))
        return pack.block(best.withColumn("order", -F.col("sim")), ["all"], "order", "line", "From the index:").select("block")

    def outline(self, project: str, source: str | None = None, kind: str | None = None) -> DataFrame:
        return scans.outline(self.chunks.read(), project, source, kind)

    def section(self, project: str, ref: str, live: DataFrame | None = None, now: float | None = None) -> DataFrame:
        """The chunk of an id or anchor; of several, the first by path.

        live (source_path, anchor, content_hash, file_bytes), as files are now, gives its
        state; with a time, what it saved against its whole file goes to the ledger.
        """
        found = scans.section(self.chunks.read(projects=[project]), project, ref)
        if live is None:
            return found
        sizes = live.groupBy("source_path").agg(F.max("file_bytes").alias("file_bytes"))
        found = checkpointed(index.freshness(found, live, now or 0.0).join(sizes, "source_path", "left"))
        if now is not None:
            pulled = F.when(F.col("kind") == "code_symbol", "pull_symbol").otherwise("pull_doc").alias("kind")
            saved = F.greatest(F.lit(0), F.col("file_bytes") - F.length(F.coalesce("body", F.lit("")))).cast("long").alias("bytes_saved")
            self.record_usage(found.where("file_bytes is not null").select(F.lit(project).alias("project_key"), pulled, F.lit(0).cast("long").alias("bytes_in"), saved), now)
        return found.drop("file_bytes")

    # The register

    def perceive(self, rows: DataFrame, now: float) -> int:
        """Perceptions (project_key, modality, url, text, created_at) into the register: attention, then decay and capacity.

        What is in the register already, live or not, is live again and attended.
        """
        url = F.coalesce("url", F.lit("")) if "url" in rows.columns else F.lit("")
        new = schemas.upgrade(rows.withColumn("id", text.sensory_id(F.col("project_key"), F.col("modality"), url, F.col("text"))), schemas.SENSORY).withColumn("created_at", F.coalesce("created_at", F.lit(float(now))))
        new = checkpointed(new)
        old = self.senses.read()
        again = new.join(old.select("id"), "id", "left_semi").where("modality = 'visual'").select("id").unionByName(new.where("modality = 'visual'").groupBy("id").count().where("count > 1").select("id"))
        kept = dml.mark_attended(dml.perceive(old, new.withColumn("seq", F.col("created_at"))), again)
        done = sensory.sweep(sensory.attend(kept, self.c.attention_window_seconds).drop("page"), now, self.c.sensory_ttl_seconds, self.c.sensory_capacity)
        return self.senses.write(schemas.upgrade(done, schemas.SENSORY))

    def promote_perceptions(self, now: float) -> int:
        """Attended visual perceptions become chunks and leave the register; how many."""
        senses = self.senses.read()
        ready = senses.where("modality = 'visual' and attended = 1 and decayed_at is null")
        count = ready.count()
        if count:
            self.index_snapshot(ready.select("project_key", "url", "text", F.struct("created_at", "id").alias("seq")), now)
            self.senses.write(dml.mark_decayed(senses, ready, now))
        return count

    # What there is

    def status(self) -> DataFrame:
        """name, n: rows of each table, and active facts and rules among them."""
        tables = {"facts": self.facts, "chunks": self.chunks, "work_queue": self.queue, "fact_edges": self.edges, "sensory": self.senses, "recall_events": self.recalls, "usage_events": self.usage}
        counts = [t.read().agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in tables.items()]
        facts = scans.active(self.facts.read())
        counts += [facts.agg(F.lit("active_facts").alias("name"), F.count("*").alias("n")), facts.where("kind = 'antipattern'").agg(F.lit("active_rules").alias("name"), F.count("*").alias("n"))]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out

    def projects(self) -> DataFrame:
        """Counts by project, with label and path, archived and queued rows, and live perceptions."""
        facts = self.facts.read()
        counted = rollups.projects(facts).join(scans.project_meta(facts), "project_key", "left")
        archived = rollups.consolidation_counts(facts, self.queue.read()).withColumnRenamed("n", "consolidation")
        live = sensory.stats(self.senses.read()).select("project_key", F.col("live").alias("sensory"))
        out = counted.join(archived, "project_key", "left").join(live, "project_key", "left").fillna(0, ["consolidation", "sensory"])
        return rollups.disambiguated(out.withColumn("parent", F.regexp_extract("path", r"([^/]+)/[^/]*/?$", 1)).withColumn("key", F.col("project_key"))).drop("parent", "key")

    def facts_page(self, project: str, limit: int = 50, offset: int = 0) -> DataFrame:
        return scans.facts_page(self.facts.read(), project, limit, offset)

    def cards(self, project: str, limit: int = 50, offset: int = 0, query: str | None = None, tier: str | None = None, now: float = 0.0) -> DataFrame:
        """Observations with their facts, newest first; with a query, facts by rank, of a tier afterwards."""
        if query:
            k = scans.active(self.facts.read(), project).count()
            found = self.recall(query, project, now, max(1, k)).join(self.facts.read().select("id", "tier"), "id").withColumn("sim", F.bround("sim", 3))
            return (found if tier is None else found.where(F.col("tier") == tier)).orderBy("rank").offset(offset).limit(limit)
        return rollups.cards(scans.active(self.facts.read(), project, tier=tier), limit, offset)

    def sensory(self, project: str, modality: str | None = None, limit: int = 100) -> DataFrame:
        """Live perceptions, newest first, with the first 500 characters of each."""
        rows = self.senses.read()
        rows = rows if modality is None else rows.where(F.col("modality") == modality)
        return scans.senses(rows, project, limit).withColumn("excerpt", F.substring("text", 1, 500)).drop("text")

    def consolidation(self, project: str, limit: int = 200) -> tuple[DataFrame, DataFrame]:
        """Archived facts as cards, and the project's work items with the head of their payloads."""
        facts = scans.of_project(self.facts.read(), project).where("status <> 'active'")
        return rollups.cards(facts, limit, 0), scans.work(self.queue.read(), project, limit).withColumn("payload", F.substring("payload", 1, 240))

    def index_projects(self) -> DataFrame:
        labels = self.meta.read().select("project_key", "label").unionByName(scans.project_meta(self.facts.read()).select("project_key", "label")).groupBy("project_key").agg(F.first("label").alias("label"))
        return rollups.chunk_projects(self.chunks.read(), labels)

    def work(self) -> DataFrame:
        return work_queue.by_stage(self.queue.read())

    def purge_work(self, status: str | None = None, stage: str | None = None, project: str | None = None) -> int:
        return self.queue.apply(lambda q: work_queue.purge(q, status, stage, project))

    def pin_embedder(self) -> int:
        """Keep the vectors of the canary texts, to tell later whether the embedder is the same."""
        return self.canary.write(schemas.upgrade(self._canaries(), schemas.CANARY))

    def _canaries(self) -> DataFrame:
        texts = self.spark.createDataFrame(list(enumerate(CANARIES)), "id long, text string")
        return self._embedded(texts).withColumn("model", F.lit(self.model))

    def drift(self) -> DataFrame:
        """status and similarity of the embedder against what was pinned."""
        return admin.drift(self._with_vectors(self.canary.read()).select("id", "model", "vec"), self._canaries().select("id", "model", "vec"))

    def replay(self, sweeps: DataFrame, project: str, k: int = 5) -> DataFrame:
        """What the index would have saved of past searches: totals of sweeps (sweep, landing, query, cost_bytes), one search each."""
        from . import evalkit

        hits = None
        for s in sweeps.select("sweep", "landing", "query").collect():  # a stated set of searches
            kind = "doc_section" if s["landing"].endswith((".md", ".mdx")) else "code_symbol"
            found = self.search_index(s["query"], project, kind, k)
            outline = F.sum(F.length(F.concat_ws("", "anchor", "summary", "source_path"))).over(W.partitionBy(F.lit(0)))
            body = F.max(F.when(F.lit(s["landing"]).endswith(F.col("source_path")), F.length("body"))).over(W.partitionBy(F.lit(0)))
            rows = found.select(F.lit(s["sweep"]).alias("sweep"), F.col("source_path").alias("path"), outline.alias("outline_bytes"), body.alias("body_bytes"))
            hits = rows if hits is None else hits.unionByName(rows)
        if hits is None:
            hits = self.spark.createDataFrame([], f"sweep {sweeps.schema['sweep'].dataType.simpleString()}, path string, outline_bytes long, body_bytes long")
        return evalkit.replay_totals(evalkit.credit(sweeps, hits))
