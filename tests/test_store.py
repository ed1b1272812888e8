"""Tables by partition, ledgers, and the kept postings: what is written, what readers see, what a dead writer leaves."""

import random
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mnemosa import schemas
from mnemosa.config import DEFAULT
from mnemosa.engine import Engine
from mnemosa.operators import fts
from mnemosa.operators.term_index import TermIndex
from mnemosa.store import Ledger, Table

SCHEMA = schemas._schema("id string, project_key string, n int, status string, created_at double, last_seen double")


def rows(spark, *data):
    return schemas.upgrade(spark.createDataFrame([(i, p, n) for i, p, n in data], "id string, project_key string, n int"), SCHEMA)


def table(spark, tmp_path, **kw):
    return Table(spark, f"file://{tmp_path}/t", SCHEMA, "id", "project_key", **kw)


def held(t, **kw):
    return {r.id: r.n for r in t.read(**kw).collect()}


def files(tmp_path):
    return {str(p): p.stat().st_mtime_ns for p in Path(tmp_path, "t", "rows").rglob("*.parquet")}


def test_only_changed_partitions_are_written(spark, tmp_path):
    t = table(spark, tmp_path)
    assert held(t) == {} and t.version() == 0
    many = {f"k{i}": i for i in range(400)}
    t.upsert(rows(spark, *((k, "p" if n % 2 else "q", n) for k, n in many.items())))
    before = files(tmp_path)
    assert held(t) == many and t.version() == 1 and len(before) == 16  # two projects of eight partitions
    t.upsert(rows(spark, ("k1", "p", -1), ("new", "p", 7)))
    after = files(tmp_path)
    assert held(t) == many | {"k1": -1, "new": 7}
    assert 1 <= len(set(after.items()) - set(before.items())) <= 2  # a file for each partition of two keys
    t.remove(rows(spark, ("k1", "p", 0), ("k2", "q", 0), ("unknown", "q", 0)))
    assert held(t).keys() == (many.keys() | {"new"}) - {"k1", "k2"}
    before = files(tmp_path)
    t.apply(lambda df: df.withColumn("n", F.when(F.col("id") == "k9", 99).otherwise(F.col("n"))))
    assert held(t)["k9"] == 99 and len(set(files(tmp_path).items()) - set(before.items())) == 1
    assert set(held(t, projects=["p"])) >= {k for k, n in many.items() if n % 2 and k != "k1"}
    plan = t.read(projects=["p"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_p" in plan
    t.apply(lambda df: df.limit(0))
    assert held(t) == {} and not files(tmp_path)


def test_rows_stay_in_their_partitions(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, ("a", "p", 1)))
    with pytest.raises(ValueError):
        t.replace(rows(spark, *((f"x{i}", "p", i) for i in range(50))), t.parts_of(rows(spark, ("a", "p", 1))))
    assert held(t) == {"a": 1} and t.version() == 1


class Died(Exception):
    pass


@pytest.mark.parametrize("at", ["before", "after", "between"])
def test_a_write_counts_whole_or_not_at_all(at, spark, tmp_path, monkeypatch):
    """The writer dies before its rows are marked whole, right after, or with one of two partitions replaced."""
    t = table(spark, tmp_path)
    t.upsert(rows(spark, *((f"k{i}", "p", i) for i in range(50))))
    old, change = held(t), rows(spark, ("k1", "p", -1), ("k2", "p", -2), ("k3", "p", -3), ("k4", "p", -4))
    settle = Table._settle

    def dies(self, version):
        if at == "between":
            one = self._parquet(f"pending-{version}/rows").select("_p", "_b").distinct().orderBy("_p", "_b").first()
            self.files.drop(f"rows/_p={one['_p']}/_b={one['_b']}")
        raise Died

    if at == "before":
        monkeypatch.setattr("mnemosa.store.Files.put", lambda *a: (_ for _ in ()).throw(Died()))
    else:
        monkeypatch.setattr(Table, "_settle", dies)
    with pytest.raises(Died):
        t.upsert(change)
    monkeypatch.undo()
    assert Table._settle is settle
    want = old if at == "before" else old | {f"k{i}": -i for i in (1, 2, 3, 4)}
    reader = table(spark, tmp_path)
    assert held(reader) == want
    reader.upsert(rows(spark, ("z", "p", 0)))  # the next writer finishes what counts
    assert held(table(spark, tmp_path)) == want | {"z": 0} and reader.version() == (2 if at == "before" else 3)


def test_ledgers(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l", SCHEMA)
    assert ledger.read().isEmpty()
    for n in range(4):
        ledger.append(rows(spark, (f"a{n}", "p", n)))
    Path(tmp_path, "l", "rows", "_w=5").mkdir()  # a writer that died
    assert {r.n for r in ledger.read().collect()} == {0, 1, 2, 3} and ledger.version() == 4
    ledger.append(rows(spark, ("b", "p", 9)))
    ledger.fold()
    assert sorted(r.n for r in ledger.read().collect()) == [0, 1, 2, 3, 9] and sum(n.startswith("_w=") for n in ledger.files.names("rows")) == 1
    ledger.write(ledger.read().where("n = 9"))
    ledger.append(rows(spark, ("c", "p", 1)))
    assert sorted(r.n for r in ledger.read().collect()) == [1, 9]


def test_older_files_get_defaults(spark, tmp_path):
    """Files without columns that came later: defaults, and last_seen from created_at."""
    t = table(spark, tmp_path)
    t._placed(spark.createDataFrame([("a", "p", 5.0)], "id string, project_key string, created_at double")).write.partitionBy("_p", "_b").parquet(f"file://{tmp_path}/t/rows")
    r = t.read().first()
    assert (r.id, r.n, r.status, r.last_seen) == ("a", None, "active", 5.0)


# Kept postings

WORDS = [f"w{i}" for i in range(60)]


def texts(spark, ids, seed=0, columns=("title", "body")):
    rng = random.Random(seed)
    word = lambda: WORDS[min(int(rng.expovariate(0.12)), 59)]
    data = [(f"d{i}", f"v{seed}", " ".join(word() for _ in range(rng.randint(0, 4))), " ".join(word() for _ in range(rng.randint(0, 30))) or None) for i in ids]
    return spark.createDataFrame(data, "id string, version string, title string, body string")


def scores(df):
    return {(r.qid, r.id): r.bm25 for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 2e-6 for k in a)


def test_postings_like_the_texts(spark, tmp_path, monkeypatch):
    """After every kind of change, and merges, the scores are those of the texts as they are now."""
    index = TermIndex(spark, f"file://{tmp_path}/i", ["title", "body"], buckets=4, most=3)
    weights = {"title": 3.0, "body": 1.0}
    asked = spark.createDataFrame([(1, "w0 w7 w30"), (2, "w55 w55 missing"), (3, "w1_w2 w9"), (4, "")], "qid long, query string")
    now = {}
    assert scores(index.search(asked, [3.0, 1.0])) == {}
    steps = [(range(0, 80), 0, ()), (range(20, 60), 2, ("d1", "d70")), ((), 0, ("d2", "d3")), (range(100, 110), 4, ("d30",)), (range(20, 60), 2, ())]
    for ids, seed, gone in steps:
        new = texts(spark, ids, seed)
        now = {k: v for k, v in now.items() if k not in gone} | {r.id: r for r in new.collect()}
        index.update(new, spark.createDataFrame([(g,) for g in gone], "id string"))
        assert len(index.segments()) <= 3
        whole = spark.createDataFrame(list(now.values()), new.schema)
        close(scores(index.search(asked, [3.0, 1.0])), scores(fts.bm25(whole, asked, weights, stem=True)))
    assert {r.id for r in index.docs().collect()} == set(now) and index.update(new, new.limit(0).select("id")) == 0
    keep = whole.where("id < 'd4'").select("id")
    close(scores(index.search(asked, [3.0, 1.0], keep)), scores(fts.bm25(whole, asked, weights, stem=True, keep=keep)))
    index.merge()
    index.merge()
    assert len(index.segments()) == 1
    close(scores(index.search(asked, [3.0, 1.0])), scores(fts.bm25(whole, asked, weights, stem=True)))
    assert index.replace(whole.limit(0)) == len(now) and index.docs().isEmpty()


def test_slots_that_cannot_matter_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("mnemosa.operators.term_index.SLOT", 16)
    index = TermIndex(spark, f"file://{tmp_path}/i", ["title", "body"], buckets=4)
    docs = texts(spark, range(2000), 5)
    index.update(docs, docs.limit(0).select("id"))
    asked = spark.createDataFrame([(1, "w40 w0 w1"), (2, "w38 w3")], "qid long, query string")
    every = fts.pool(index.search(asked, [3.0, 1.0]), 5)
    best = fts.pool(index.search(asked, [3.0, 1.0], k=5), 5)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, every.collect())) and best.count() == 10
    kept, whole = index.slots(index.asked(asked), [3.0, 1.0], 5)
    assert kept.count() < whole.count() / 2, (kept.count(), whole.count())
    one = spark.createDataFrame([(1, "w40")], "qid long, query string")
    plan = index._rows(index.asked(one))
    bucket = spark.sql("select pmod(xxhash64('w40'), 4)").first()[0]
    read = {f.split("_t=")[1].split("/")[0] for f in plan.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert read == {str(bucket)} and "PartitionFilters" in plan._jdf.queryExecution().toString()


def test_a_segment_that_was_not_finished_does_not_count(spark, tmp_path, monkeypatch):
    index = TermIndex(spark, f"file://{tmp_path}/i", ["title", "body"], buckets=2)
    none = spark.createDataFrame([], "id string")
    index.update(texts(spark, range(20)), none)
    write = __import__("mnemosa.operators.term_index", fromlist=["overwrite"]).overwrite

    def dies(df, path, parts):
        if path.endswith("segments"):
            raise Died
        write(df, path, parts)

    monkeypatch.setattr("mnemosa.operators.term_index.overwrite", dies)
    with pytest.raises(Died):
        index.update(texts(spark, range(10, 30), 7), none)
    monkeypatch.undo()
    asked = spark.createDataFrame([(1, "w0 w1 w2")], "qid long, query string")
    weights = {"title": 1.0, "body": 1.0}
    close(scores(index.search(asked, [1.0, 1.0])), scores(fts.bm25(texts(spark, range(20)), asked, weights, stem=True)))
    index.update(texts(spark, range(10, 30), 7), none)
    assert {(r.id, r.version) for r in index.docs().collect()} == {(f"d{i}", "v0" if i < 10 else "v7") for i in range(30)}


# The engine on them


def test_capture_writes_its_partitions_and_replaces_postings(spark, tmp_path):
    """Ten facts into a store of several hundred; a summary that changes is found by its new words only."""
    e = Engine(spark, f"file://{tmp_path}/m", replace(DEFAULT, supersede_threshold=1.0))
    base = spark.createDataFrame([(i, f"Fact number {i} of the base is about item {i * 7}.") for i in range(300)], "seq long, text string")
    e.add_records(base, "p", 1.0)
    at = lambda: {str(p): p.stat().st_mtime_ns for p in Path(tmp_path, "m", "facts", "rows").rglob("*.parquet")}
    before = at()
    e.add_records(spark.createDataFrame([(0, "One fact of another project entirely.")], "seq long, text string"), "q", 2.0)
    assert len(set(at().items()) - set(before.items())) == 1 and len(before) == 8
    say = lambda t, n, now: e.capture_summary(spark.createDataFrame([(0, t, n)], "seq long, text string, narrative string"), "p", "s", now)
    say("The session was about animals.", "zebra crossing", 3.0)

    def find(q):
        scope = e._scope("p")
        return [r.text for r in e._fact_hits(q, "p", scope, 50).join(scope, "id").collect()]

    held = lambda: {t for r in e.fact_terms.docs().collect() for t in r.terms}
    assert find("zebra") == ["The session was about animals."] and "zebra" in held()
    say("The session was about animals.", "walrus tusk", 5.0)
    assert "zebra" not in held() and find("zebra") == [] and find("walrus") == ["The session was about animals."]
    e.facts.apply(lambda f: f.withColumn("narrative", F.when(F.col("kind") == "session_summary", "otter").otherwise(F.col("narrative"))))
    assert e.repair() == 1 and find("otter") and find("walrus") == [] and e.repair() == 0


def test_recall_spreads_and_takes_global_rules_last(spark, tmp_path):
    lines = lambda *t: spark.createDataFrame([("\n".join(t),)], "text string")
    a, b, c = "The build of the parser needs the lexer tables.", "The lexer tables come from the grammar file.", "The parser prints the tables of the build."
    e = Engine(spark, f"file://{tmp_path}/m", replace(DEFAULT, min_sim=0.01, supersede_threshold=1.0, max_chars=80))
    e.capture(lines(a, b, c), "p", 1.0)
    ids = {r.text: r.id for r in e.facts.read().collect()}
    plain = e.recall_block("parser build tables", "p", 2.0).first().block
    last = next(t for t in (a, b, c) if t not in plain)
    first = next(t for t in (a, b, c) if t in plain)
    e.link(spark.createDataFrame([(ids[last], ids[x], "entity", 9.0) for x in ids if x not in (last, first)], "src string, dst string, kind string, weight double"))
    assert last not in e.recall_block("parser build tables", "p", 3.0).first().block
    spreading = Engine(spark, f"file://{tmp_path}/m", replace(e.c, spread_weight=0.5))
    assert first not in spreading.recall_block("parser build tables", "p", 4.0).first().block
    rule = spark.createDataFrame([(0, "Never edit the lexer tables by hand, never the tables.", "global")], "seq long, text string, scope string")
    e.capture_antipatterns(rule, "p", 5.0)
    hits = [r.id for r in e._fact_hits("lexer tables", "p", e._scope("p"), 50).orderBy("bm25").collect()]
    globals_ = {r.id for r in e.facts.read().where("project_key = '__global__'").collect()}
    assert hits[-1] in globals_ and len(hits) == 4


def test_queries_can_be_embedded_in_their_own_way(spark, tmp_path):
    from mnemosa.functions import vec

    e = Engine(spark, f"file://{tmp_path}/m", embed_query=lambda t: vec.hash_embed(F.regexp_replace(t, "^query: ", ""), 256))
    e.capture(spark.createDataFrame([("Tokens are counted by the ledger of events.",)], "text string"), "p", 1.0)
    assert e.recall("query: tokens ledger events", "p", 2.0).first().sim == Engine(spark, f"file://{tmp_path}/m").recall("tokens ledger events", "p", 2.0).first().sim


def test_sections_tell_their_state_and_rules_are_told_once(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m")
    e.index(spark.createDataFrame([("a.md", "# One\nalpha\n## Two\ngamma")], "source_path string, body string"), "p", 1.0)
    chunk = e.section("p", "one/two").first()
    live = spark.createDataFrame([("a.md", "one/two", chunk.content_hash, 4000)], "source_path string, anchor string, content_hash string, file_bytes long")
    assert e.section("p", "one/two", live, 2.0).first().state == "fresh"
    assert e.section("p", "one/two", live.withColumn("content_hash", F.lit("x")), 3.0).first().state == "edited"
    assert e.section("p", "one/two", live.withColumn("source_path", F.lit("b.md")), 4.0).first().state == "stale"
    assert [(r.kind, r.bytes_saved) for r in e.usage.read().collect()] == [("pull_doc", 4000 - len(chunk.body))] * 2
    e.capture_antipatterns(spark.createDataFrame([(0, "Never pass the force flag to the push command.")], "seq long, text string"), "p", 5.0)
    warn = lambda s: e.antipattern_warning("git push with the force flag", "p", s, 6.0).count()
    assert [warn("s"), warn("s"), warn("t"), warn(None)] == [1, 0, 1, 1]
