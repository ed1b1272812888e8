"""Whole paths through the engine: writing, recall, rescue, index, import, consolidation, deletes, the register."""

from dataclasses import replace

from pyspark.sql import functions as F

from mnemosa import schemas
from mnemosa.config import DEFAULT
from mnemosa.engine import Engine, heuristic
from mnemosa.functions import vec
from mnemosa.operators import work_queue
from mnemosa.sources import imports


def lines(spark, *texts):
    return spark.createDataFrame([("\n".join(texts),)], "text string")


def test_register(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m")
    see = lambda now, *rows: e.perceive(spark.createDataFrame([("p", "visual", u, t, now) for u, t in rows], "project_key string, modality string, url string, text string, created_at double"), now)
    see(100.0, ("http://x", "first look at the page"), (None, "no page here"))
    assert e.senses.read().where("attended = 1").isEmpty()
    see(200.0, ("http://x?q", "second look at the page"))
    assert {r.text for r in e.senses.read().where("attended = 1").collect()} == {"first look at the page", "second look at the page"}
    see(250.0, (None, "no page here"))  # the very same again
    assert e.senses.read().where("attended = 1").count() == 3 and e.senses.read().count() == 3
    assert e.promote_perceptions(300.0) == 3 and e.promote_perceptions(300.0) == 0
    assert {(r.source_path, r.kind, r.body) for r in e.chunks.read().collect()} == {("http://x", "snapshot", "first look at the page"), ("http://x?q", "snapshot", "second look at the page"), ("", "snapshot", "no page here")}
    assert e.sensory("p").isEmpty() and e.search_index("second look", "p").first().body == "second look at the page"


def test_recall_structured(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m", replace(DEFAULT, min_sim=0.3))
    assert e.recall_structured("anything", "p", 1.0).first().verdict == "no_memory"
    e.capture(lines(spark, "The storage layer keeps Parquet files on disk.", "Tokens are counted by a ledger of events."), "p", 10.0)
    r = e.recall_structured("where does the storage layer keep parquet files", "p", 20.0).first()
    assert r.verdict in ("ok", "low_confidence") and r.facts[0].text.startswith("The storage") and r.returned == len(r.facts) and r.matched == r.returned + r.dropped
    marked = {x.text[:3]: (x.recall_count, x.last_recalled) for x in e.facts.read().collect()}
    assert marked["The"] == (1, 20.0)
    assert [x.verdict for x in e.recalls.read().orderBy("ts").collect()] == ["no_memory", r.verdict]
    other = Engine(spark, f"file://{tmp_path}/m", replace(DEFAULT, dim=128))
    assert other.recall_structured("zzz", "p", 30.0).first().verdict == "embedding_mismatch"
    e.pin_embedder()
    assert e.drift().first().status == "ok" and other.drift().first().status == "dim_changed"
    small = e.recall_structured("storage layer parquet files tokens ledger events", "p", 40.0, k=2, max_chars=10).first()
    assert small.returned == 1 and small.dropped == small.matched - 1


def test_vectors_are_stored_once(spark, tmp_path):
    """Recall and consolidation embed no stored fact again."""
    calls = []

    def embed(t):
        calls.append(1)
        return vec.hash_embed(t, 256)

    e = Engine(spark, f"file://{tmp_path}/m", embed=embed)
    e.capture(lines(spark, "A fact that is long enough to keep.", "One more fact that is long enough."), "p", 1.0)
    n = len(calls)
    row = e.facts.read().first()
    assert len(row.vec_int8) == 256 and row.dim == 256 and len(row.vec_bits) == 32
    e.consolidate(2.0)
    assert len(calls) == n
    e.recall("long fact", "p", 2.0).collect()
    assert len(calls) == n + 1  # the query


def test_named_victims_edges_prompts_and_rules(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m", replace(DEFAULT, spread_weight=0.5))
    e.capture(lines(spark, "I live in Paris, in core/store.py of the town."), "p", 1.0)
    paris = e.facts.read().first().id
    new = spark.createDataFrame([(0, "Moved to London; see core/store.py too.", [paris, "unknown"]), (1, "Nothing else has changed at all since.", None)], "seq long, text string, supersedes array<string>")
    e.add_records(new, "p", 2.0)
    of = {r.text[:4]: r for r in e.facts.read().collect()}
    assert of["I li"].status == "superseded" and of["I li"].superseded_by == of["Move"].id and of["Noth"].status == "active"
    edges = {(r.src_id, r.dst_id, r.kind) for r in e.edges.read().collect()}
    a, b = sorted((of["Move"].id, of["Noth"].id))
    assert (a, b, "cooc") in edges
    ask = lambda now, *t: e.capture_prompts(spark.createDataFrame([(x,) for x in t], "text string"), "p", now, "s")
    ask(3.0, "What is the key of the cache?", "What is the key of the cache?", " ")
    ask(4.0, "What is the key of the cache?")
    p = e.facts.read().where("kind = 'prompt'").collect()
    assert len(p) == 1 and (p[0].frequency, p[0].tier, p[0].importance, p[0].last_seen) == (3, "stm", 0.5, 4.0)
    rules = spark.createDataFrame([(0, "Never edit generated files by hand in the build.", "project", "n"), (1, "Never pass the force flag to the push command.", "global", "n")], "seq long, text string, scope string, narrative string")
    e.capture_antipatterns(rules, "p", 5.0)
    got = {(r.project_key, r.tier, r.type) for r in e.facts.read().where("kind = 'antipattern'").collect()}
    assert got == {("p", "ltm", "antipattern"), ("__global__", "ltm", "antipattern")}
    assert [r.text for r in e.antipattern_warning("git push with the force flag", "q").collect()] == ["Never pass the force flag to the push command."]
    for n, t in ((6.0, "First session did this."), (7.0, "Second look at the session.")):
        e.capture_summary(spark.createDataFrame([(0, t, "T")], "seq long, text string, title string"), "p", "s", n)
    assert e.orientation_block("p").first().block.endswith("Second look at the session.") and e.facts.read().where("kind = 'session_summary'").count() == 1
    assert "Core memory" in e.core_block("p", 8.0).first().block and e.usage.read().first().kind == "inject_core"
    assert e.status().where("name = 'active_rules'").first().n == 2


def test_distiller_prompts_are_not_captured(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m")
    e.capture(lines(spark, "  You review a coding-assistant session for mistakes.", "This line is long enough."), "p", 1.0)
    assert e.facts.read().isEmpty()


def test_rescue(spark, tmp_path):
    """A degraded capture is parked; a healthy distiller replaces its facts, a sick one gives it back, nonsense is dead."""
    text = "The heuristic took this line as a fact."
    e = Engine(spark, f"file://{tmp_path}/m")
    e.capture(lines(spark, text), "p", 1.0)
    for now in (1.0, 2.0):
        e.park(heuristic(lines(spark, text).withColumn("seq", F.lit(0).cast("long"))), text, "p", "s", now)
    assert e.queue.read().count() == 1 and e.rescue(10.0) == 0
    assert e.queue.read().first().status == "pending" and e.queue.read().first().next_retry_at == 15.0
    well = Engine(spark, f"file://{tmp_path}/m", distil=lambda t: t.select("seq", F.lit("A model made this fact of it.").alias("text"), F.lit(False).alias("degraded")))
    assert well.rescue(11.0) == 0 and well.rescue(20.0) == 1 and e.queue.read().isEmpty()
    assert [r.text for r in e.facts.read().collect()] == ["A model made this fact of it."]
    bad = spark.createDataFrame([("x", "rescue", "pending", 0, 0.0, 1.0, "no json")], "msg_id string, stage string, status string, attempts int, next_retry_at double, enqueued_at double, payload string")
    e.queue.apply(lambda q: work_queue.publish(q, schemas.upgrade(bad, schemas.WORK_QUEUE)))
    assert well.rescue(30.0) == 0 and e.queue.read().first().status == "dead"


def test_index_knows_what_changed(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m")
    put = lambda now, *rows, **kw: tuple(e.index(spark.createDataFrame(rows, "source_path string, body string, mtime_ns long"), "p", now, **kw).first())
    a, b, c = ("d/a.md", "# One\nalpha\n# One\nbeta", 1), ("d/b.py", 'class K:\n  """doc"""\n  def f(self): pass\n', 1), ("e/c.md", "plain", 1)
    assert put(1.0, a, b, c) == (3, 0, 5, 0)
    assert put(2.0, a, b, c) == (0, 3, 0, 0)
    assert put(3.0, (a[0], a[1], 9), (b[0], b[1] + "\ndef g(): pass\n", 9)) == (1, 1, 3, 0)
    assert {r.anchor for r in e.outline("p", "d/b.py").collect()} == {"K", "K.f", "g"} and e.outline("p", "e/c.md").count() == 1
    assert put(4.0, (a[0], a[1], 9), scope="d") == (0, 1, 0, 1) and e.outline("p", "e/c.md").count() == 1
    assert put(5.0, (a[0], a[1], 9), scope="") == (0, 1, 0, 1) and {r.source_path for r in e.outline("p").collect()} == {"d/a.md"}
    assert put(6.0, ("big.md", "x" * 100, 1), most=10) == (0, 0, 0, 0)
    kept = e.chunk_terms.docs().select("id")
    assert {r.id for r in kept.collect()} == {r.id for r in e.chunks.read().collect()}


OBSERVED = "id long, project string, type string, title string, subtitle string, facts string, narrative string, files_read string, files_modified string, created_at_epoch double"
SUMMED = "id long, project string, request string, investigated string, learned string, completed string, next_steps string, notes string, created_at_epoch double"


def test_import_of_another_store(spark, tmp_path):
    o = spark.createDataFrame([(1, "a", "decision", "t", "s", '["one fact here", " ", "two facts here"]', "n", '["x","y"]', '["y"]', 1.7e12), (2, "b", None, "only title", "sub", None, None, None, None, None), (3, "c", "x", None, None, "[]", "story", None, None, 5.0), (4, None, "x", "lost", None, None, None, None, None, 5.0)], OBSERVED)
    s = spark.createDataFrame([(1, "a", "asked", None, "learned it", " ", None, "one fact here", 1.7e12)], SUMMED)
    source = imports.Source(o, s)
    assert {r.label for r in source.labels().collect()} == {"a", "b", "c"} and not imports.Source().available()
    e = Engine(spark, f"file://{tmp_path}/m")
    keys = spark.createDataFrame([("a", "A"), ("b", "B")], "label string, project_key string")
    dry = {r.label: r.would_import for r in e.import_source(source, keys, 1.0, dry_run=True).collect()}
    assert dry == {"a": 5, "b": 1, "c": None} and e.facts.read().isEmpty()
    got = {r.label: (r.inserted, r.reinforced, r.batches) for r in e.import_source(source, keys, 1.0).collect()}
    assert got == {"a": (4, 1, 1), "b": (1, 0, 1), "c": (None, None, None)}
    facts = {r.text: r for r in e.facts.read().collect()}
    assert facts["one fact here"].frequency == 2 and facts["one fact here"].created_at == 1.7e9 and facts["one fact here"].files == ["x", "y"] and facts["one fact here"].tier == "ltm"
    assert facts["only title — sub"].created_at == 1.0 and facts["learned it"].type == "summary"
    again = {r.label: (r.inserted, r.reinforced) for r in e.import_source(source, keys, 2.0).collect()}
    assert again["a"] == (0, 5)


def test_consolidate_counts_its_steps(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m", replace(DEFAULT, supersede_threshold=1.0, stm_capacity=3, integrate_threshold=0.8, refine_keep_max=1))
    texts = ["Alpha beta gamma delta epsilon zeta one.", "Alpha beta gamma delta epsilon zeta two.", "Quite another matter is written here.", "The fourth line speaks of the sea.", "A fifth line about mountains and snow."]
    for i, t in enumerate(texts):
        e.capture(lines(spark, t), "p", 10.0 + i)
    ids = {r.text: r.id for r in e.facts.read().collect()}
    e.facts.apply(lambda f: f.withColumn("recall_count", F.when(F.col("id").isin(ids[texts[2]], ids[texts[3]]), 1).otherwise(0)))
    rule = spark.createDataFrame([(0, "Never touch the lock file of the build.", ["gone.py"])], "seq long, text string, files array<string>")
    e.capture_antipatterns(rule, "p", 20.0)
    files = spark.createDataFrame([("here.py",)], "path string")
    counts = e.consolidate(1e9, files, horizon=1e6).first().asDict()
    assert counts["replayed"] == 2 and counts["displaced"] == 0 and counts["merged"] == 1 and counts["pruned"] == 1 and counts["expired"] == 1
    assert counts["purged"] == 1 + 6 - 1 - e.facts.read().count()
    terms = {r.id for r in e.fact_terms.docs().select("id").collect()}
    assert terms == {r.id for r in e.facts.read().collect()}


def test_deletes(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m", replace(DEFAULT, spread_weight=1.0))
    for p in "pq":
        e.capture(lines(spark, "A fact that is long enough to keep.", "One more fact, about other things."), p, 1.0)
    e.set_cursor("p:s", 5, 1.0)
    e.set_cursor("summary:p:s", 6, 1.0)
    e.set_cursor("p:s", 7, 2.0)
    e.set_index_meta("p", "Label", "/x", 1.0)
    first = e.facts.read().where("project_key = 'q'").orderBy("id").first().id
    e.delete_memory("q", first)
    assert e.facts.read().count() == 3 and e.edges.read().count() == 1
    gone = {r.name: r.removed for r in e.delete_project("p").collect()}
    assert gone["facts"] == 2 and gone["cursors"] == 1 and gone["index_meta"] == 1 and gone["edges"] == 1
    assert [tuple(r)[:2] for r in e.cursors.read().collect()] == [("summary:p:s", 6)] and e.facts.read().count() == 1
    e.prune("q")
    assert e.facts.read().isEmpty() and e.fact_terms.docs().isEmpty()


def test_read_api(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m")
    e.add_records(spark.createDataFrame([(0, "First fact of the card.", "o"), (1, "Second fact of the card.", "o"), (2, "A fact of its own here.", None)], "seq long, text string, observation_id string"), "p", 5.0)
    cards = e.cards("p").collect()
    assert sorted(len(c.facts) for c in cards) == [1, 2] and e.facts_page("p", 2).count() == 2
    assert e.cards("p", query="second card", tier="stm").first().text == "Second fact of the card."
    p = e.projects().first()
    assert (p.facts, p.stm, p.consolidation, p.sensory, p.label) == (3, 3, 0, 0, "p")
    for now, kind, into, saved in ((1.0, "inject_prompt", 400, 0), (2.0, "pull_doc", 0, 4000)):
        e.record_usage(spark.createDataFrame([("p", kind, into, saved)], "project_key string, kind string, bytes_in long, bytes_saved long"), now)
    assert e.ledger().first().net_measured == 900 and e.stats().count() == 2 and e.usage.version() == 2
    e.usage.fold()
    assert e.usage.read().count() == 2 and e.usage.files.names("rows").count("_w=3") == 1
    archived, work = e.consolidation("p")
    assert archived.isEmpty() and work.isEmpty() and e.index_projects().isEmpty()
    e.index(spark.createDataFrame([("a.md", "# Cache keys\nThe cache key is made of the query and the day.")], "source_path string, body string"), "p", 1.0)
    assert "cache" in e.index_block("cache key of the query", "p").first().block.lower()
    assert e.index_projects().first().label == "p"
    sweeps = spark.createDataFrame([(1, "/x/a.md", "cache key query", 40_000), (2, "/x/b.py", "nothing", 40_000)], "sweep long, landing string, query string, cost_bytes long")
    t = e.replay(sweeps, "p").first()
    assert (t.sweeps, t.creditable) == (2, 1) and 9000 < t.saved_tokens < 10_000


def test_transcript_grows(spark, tmp_path):
    """Only what came since the last call is read; prompts, facts and the register get it; a replaced file is read anew."""
    import json

    say = lambda role, text: json.dumps({"type": role, "message": {"role": role, "content": text}}) + "\n"
    p, e = tmp_path / "t.jsonl", Engine(spark, f"file://{tmp_path}/m")
    p.write_text(say("user", "Why does the login page fail?") + say("assistant", "The login page fails on an expired token.") + '{"half')
    assert e.capture_transcript(f"file://{p}", "p", "s", 1.0) == 2 and e.capture_transcript(f"file://{p}", "p", "s", 2.0) == 0
    facts = {(r.kind, r.text) for r in e.facts.read().collect()}
    assert ("prompt", "Why does the login page fail?") in facts and ("fact", "The login page fails on an expired token.") in facts
    assert [r.text for r in e.senses.read().collect()] == ["Why does the login page fail?\nThe login page fails on an expired token."]
    p.write_text(p.read_text()[:-6] + say("assistant", "My mistake: the token had not expired at all."))
    assert e.capture_transcript(f"file://{p}", "p", "s", 3.0) == 1 and e.senses.read().count() == 2
    p.write_text(say("user", "Start again from the beginning."))
    assert e.capture_transcript(f"file://{p}", "p", "s", 4.0) == 1 and e.cursor("p:s") == p.stat().st_size
    calls = []

    def make(texts):
        calls.append(texts.count())
        return spark.createDataFrame([(0, "Check the clock before blaming a token.", "project")], "seq long, text string, scope string")

    p.write_text(say("assistant", "The page works now. " * 20))
    at = lambda **kw: e.maybe_capture("antipat", f"file://{p}", "p", "s", 5.0, make, least=100, **kw)
    assert at() and not at() and at(force=True) and not calls  # nothing admitted
    p.write_text(p.read_text() + say("assistant", "My mistake, I misread the log. " * 10))
    assert at() and calls == [2] and e.facts.read().where("kind = 'antipattern'").count() == 1
    assert e.maybe_capture("summary", f"file://{p}", "p", "s", 6.0, make, force=True) and e.facts.read().where("kind = 'session_summary'").count() == 0
    assert e.facts.read().where("text like 'Check the clock%'").first().frequency == 2


def test_versions_tell_of_changes(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m")
    assert e.facts.version() == 0
    e.capture(lines(spark, "A fact that is long enough to keep."), "p", 1.0)
    assert e.facts.version() == 1
    e.recall("fact", "p", 2.0).collect()
    assert e.facts.version() == 1


def test_files_under_a_root(spark, tmp_path):
    from mnemosa.sources import chunking

    for name in ("a.md", "src/b.py", "src/c.txt", ".git/x.md", "node_modules/y.py", "big.md"):
        at = tmp_path / "root" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("# T\n" + "x" * (500 if name == "big.md" else 1))
    found = {r.source_path: r for r in chunking.discover(spark, f"file://{tmp_path}/root", most=100).collect()}
    assert set(found) == {"a.md", "src/b.py"} and found["a.md"].body == "# T\nx"
    other = chunking.code_symbols(spark.createDataFrame([("x.zz", "f g"), ("y.py", "def f(): pass"), ("z.qq", "q")], "source_path string, body string"), chunking.EXTRACTORS | {".zz": lambda p, t: [(p, w, "function", w, None, 0, 1, w) for w in t.split()], ".qq": lambda p, t: None})
    assert {(r.source_path, r.anchor) for r in other.collect()} == {("x.zz", "f"), ("x.zz", "g"), ("y.py", "f")}


def test_edits_are_told_once(spark, tmp_path):
    from mnemosa.streaming import stateful

    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:06"), ("a", "2024-01-01 00:01:00")]
    df = spark.createDataFrame(rows, "path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    q = stateful.coalesced_edits(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")).writeStream.format("memory").queryName("edits").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.path for r in spark.table("edits").collect()) == ["a", "b"]


def test_mined_corpus(spark):
    from mnemosa import evalkit

    rows = [(1, "A plain fact about the storage of the tables.", [1.0, 0.0], 9.0), (2, "A plain fact about the storage of the tables!", [0.99, 0.05], 8.0), (3, "short", [0.0, 1.0], 7.0), (4, "The benchmark of the day was about the tables here.", [0.0, 1.0], 6.0), (5, "Mail jo@example.org about the key of the storage.", [0.8, 0.6], 5.0), (6, "Another matter that has nothing to do with it at all.", [0.0, 1.0], 4.0), (7, "One more that comes too late to be taken by now, sorry.", [-1.0, 0.0], 3.0)]
    f = spark.createDataFrame([(i, "p", "active", "fact", t, v, s, 0.0) for i, t, v, s in rows], "id long, project_key string, status string, kind string, text string, vec array<double>, last_seen double, created_at double")
    got = {r.id: (r.place, r.cluster, r.dropped, list(r.flags)) for r in evalkit.mine(f, most=3).collect()}
    assert got == {1: (0, 0, None, []), 2: (None, None, "duplicate", []), 3: (None, None, "short", []), 4: (None, None, "contaminated", []), 5: (1, 0, None, ["email"]), 6: (2, 1, None, [])}
