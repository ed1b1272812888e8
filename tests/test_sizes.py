"""What shows only on larger tables: keys that meet, many queries, long texts."""

from mnemosa.plans import registry


def test_queue_publish_where_new_ids_meet(spark, tmp_path, same_rows):
    """From 30,000 events on, a new id can be a known one that is done: both producers' rows stay."""
    import duckdb

    e = spark.range(0, 40_000, 10).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "id % 7 as user_id", "case when id % 20 = 0 then 'view' else 'click' end as event_type", "double(id) as value")
    e.coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = registry.queries()["queue_publish_ack"](spark, f"file://{tmp_path}")
    same_rows(got, c.sql(registry.oracle_sql()["queue_publish_ack"]))
    assert got.groupBy("msg_id").count().where("count > 1").count() > 100


def test_best_over_blocks():
    """Ties by id, NaN above all, ids of both kinds, as one sort gives."""
    import numpy as np

    from mnemosa.operators.best import Best

    r = np.random.default_rng(1)
    s = np.round(r.normal(size=(5, 900)), 1)
    s[2, 17] = np.nan
    for ids in (r.permutation(900), np.array([f"k{i:04d}" for i in r.permutation(900)], object)):
        best = Best(5, 7)
        for at in range(0, 900, 64):
            best.add(s[:3, at : at + 64], ids[at : at + 64])
            best.add(s[3:, at : at + 64], ids[at : at + 64], 3)
        q, i, x = best.rows()
        for n in range(5):
            order = sorted(range(900), key=lambda j: (-np.inf if np.isnan(s[n, j]) else -s[n, j], ids[j]))[:7]  # noqa: B023
            assert i[q == n].tolist() == [ids[j] for j in order] and np.isnan(x[q == n][0]) == (n == 2)


def test_ten_of_a_query_and_weight_leave_a_task(spark, sf):
    """However many facts a task reads, it gives out k rows a query and weight, and the ranks are those of all pairs."""
    from mnemosa.operators import retrieve
    from mnemosa.sources.views import NOW, embedded_facts, vectors

    f = embedded_facts(spark, sf).coalesce(2)
    q = vectors(spark, sf).where("vec_id % 50 = 7").selectExpr("vec_id as qid", "vec as q")
    rows = f.selectExpr("id", "vec", "0.0D base", "1.0D slope", "tier = 'stm' short")
    assert retrieve._best_by_vector(q, rows, 10, (1.0, 0.5, 0.0), 1 << 16, 3).count() <= 2 * 3 * 10 * q.count() < 3 * f.count() * q.count() / 4
    found = retrieve.batch_priority(f, q, NOW, (1.0, 0.5), 10, block=2)
    assert found.count() == 2 * 10 * q.count()


def test_a_batch_of_texts_is_embedded_in_pieces():
    """Python holds the words of one piece of a batch, however many texts it has."""
    from mnemosa.functions import vec

    assert [len(x) for x in vec.pieces(["a" * 5, "b" * 4, "c" * 30, "", "d"], 10)] == [2, 1, 2] and list(vec.pieces([])) == []


def test_hits_of_the_tasks_equal_those_of_the_shuffle(spark, sf, monkeypatch):
    """Both ways give the same scores, in several groups of queries too; with k, k rows a query leave a task."""
    from pyspark.sql import functions as F

    from mnemosa.operators import fts

    d = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as id", "text", "source").repartition(3)
    asked = spark.createDataFrame([(n, q) for n, q in enumerate(["the these", "the_the of_the", "thing THE the", "", "src1 the_of", "zzz"])], "qid long, query string")
    for stem in (False, True):
        shown = {(r.qid, r.id): r.bm25 for r in fts._bm25_met(d, fts.asked_terms(asked, stem), {"text": 1.0, "source": 0.0}, stem, None).collect()}
        monkeypatch.setattr(fts, "MOST_ASKED", 3)
        got = {(r.qid, r.id): r.bm25 for r in fts.bm25(d, asked, {"text": 1.0, "source": 0.0}, stem).collect()}
        assert got.keys() == shown.keys() and all(abs(got[k] - shown[k]) < 2e-6 for k in got) and len(got) > 100
        monkeypatch.undo()
        few = fts.bm25(d, asked, {"text": 1.0, "source": 0.0}, stem, k=4)
        assert few.count() <= 3 * 4 * 6 and few.groupBy("qid").agg(F.min("bm25").alias("m")).collect()
        for q in {q for q, _ in got}:
            want = sorted((round(s, 5), i) for (p, i), s in got.items() if p == q)[:4]
            mine = sorted((round(r.bm25, 5), r.id) for r in few.where(F.col("qid") == q).collect())[:4]
            assert mine == want


def test_states_are_slices_of_time(spark, tmp_path):
    """A project's state doesn't grow with its history: many slices, with rows on both sides of their bounds, give what the batch gives."""
    import random

    from test_streaming import SCHEMA, arrivals, fed

    from mnemosa.operators import sensory
    from mnemosa.streaming import stateful

    rng = random.Random(6)
    times = [1e9 + round(rng.uniform(0, 2500), 1) for _ in range(150)]
    rows = [(n, f"id{n}", "p", f"http://x/{n % 3}", "visual", t, int(n % 5 == 1), t + 3 if n % 13 == 2 else None) for n, t in enumerate(times)]
    df = spark.createDataFrame(rows, "n int, " + SCHEMA.format("string"))
    sliced = stateful._sliced(df, 160.0, 0.0, 20.0)
    assert sliced.where("own").count() == 150 and 10 < sliced.select("slice").distinct().count() < 20 and sliced.count() < 200
    got = sorted(map(tuple, stateful.finished(stateful.register(fed(spark, tmp_path / "a", df, arrivals(times, 600, 6)), 20, 3), "gone").collect()))
    assert got == sorted(map(tuple, sensory.register_events(df, max(times) - 600, 20, 3).collect())) and len(got) > 100
    near = [r.id for r in stateful.finished(stateful.attention(fed(spark, tmp_path / "b", df, arrivals(times, 600, 7)), 15), "seen").collect()]
    want = {r.id for r in sensory.attend(df.withColumn("attended", df.attended * 0), 15).where("attended = 1").collect()}
    assert set(near) == want and len(near) == len(want) > 10


def test_kept_postings_are_made_and_scored_where_they_lie(spark, tmp_path):
    """The tasks' rows of a slot are those that tokens and places give when grouped by Spark; with k, k rows a query leave a task."""
    from pyspark.sql import functions as F

    from mnemosa.operators import fts, term_index

    docs = spark.createDataFrame([(f"d{i:03d}", "v", "the Thing" if i % 3 else None, " ".join(f"w{n}" for n in range(i % 9, 9)) + " the THE") for i in range(400)], "id string, version string, title string, body string")
    asked = spark.createDataFrame([(q, "the thing w8 w5") for q in range(3)], "qid long, query string")
    for stem in (False, True):
        index = term_index.TermIndex(spark, f"file://{tmp_path}/{stem}", ["title", "body"], stem=stem)
        index.update(docs)
        made = index._table("postings", term_index.POSTINGS).drop("_s", "_t")
        of = fts.tokens(docs, ["title", "body"], stem).withColumn("term", fts.porter(F.col("word")) if stem else F.col("word"))
        want = index._merged(of.groupBy("id", "length", "term").agg(F.array_sort(F.collect_list(F.struct("col", "at"))).alias("places")), 400)
        key = lambda df: sorted(map(repr, df.select("term", "slot", "entries", "most", "shortest", "holders").collect()))
        assert key(made) == key(want)
        every, best = index.search(asked, [2.0, 1.0]), index.search(asked, [2.0, 1.0], k=3)
        assert every.count() == 3 * 400 and best.count() <= 3 * 3
        assert fts.pool(best, 3).collect() == fts.pool(every, 3).collect()


def test_ends_of_words_are_sorted_once_and_stems_remembered():
    """A word's stem costs no sort of the tables; a task asks for it once while it has room."""
    from unittest import mock

    from mnemosa.functions import porter
    from mnemosa.operators import fts

    with mock.patch("builtins.sorted", side_effect=AssertionError("sorted for a word")):
        porter.stem.cache_clear()
        assert [porter.stem(w) for w in ("relational", "hopefulness", "adoption", "ties", "x81")] == ["relat", "hope", "adopt", "ti", "x81"]
    asked = []
    known = fts._Known(lambda w: asked.append(w) or len(w))
    assert [known[w] for w in (b"ab", b"c", b"ab", b"ab")] == [2, 1, 2, 2] and asked == [b"ab", b"c"]
    with mock.patch.object(fts, "MOST_STEMS", 2):
        assert known[b"def"] == 3 and len(known) == 1


def test_texts_of_any_script_are_counted_as_tokens(spark):
    """ASCII texts take a shorter way than others; lengths and counts are those of the tokens."""
    from mnemosa.operators import fts

    odd = ["Running RUNS, run_run", "Éclairs éclair éclair x—y", "Straße STRASSE İstanbul ıstanbul", "Привет, привет мир", "日本 語   日本", "\x1c\x1d a\x85b c", "", None, "½ ² x2 ٣"]
    docs = spark.createDataFrame(list(enumerate(odd)), "id long, text string")
    asked = spark.createDataFrame([(0, "run eclair istanbul x y a b c run_run eclair_eclair x2 stra e")], "qid long, query string")
    for stem in (False, True):
        terms = sorted({tuple(r.parts) for r in fts.asked_terms(asked, stem).collect()})
        got = {r.id: r for r in fts.counted(docs, {"text": 1.0}, stem, terms).collect()}
        sizes = {r.id: r.n for r in docs.select("id", fts.F.size(fts.tokens_of(fts.F.col("text"), stem)).alias("n")).collect()}
        assert {i: r.length for i, r in got.items()} == sizes
        shown = {(r.qid, r.id): r.bm25 for r in fts._bm25_met(docs, fts.asked_terms(asked, stem), {"text": 1.0}, stem, None).collect()}
        mine = {(r.qid, r.id): r.bm25 for r in fts.bm25(docs, asked, {"text": 1.0}, stem).collect()}
        assert mine.keys() == shown.keys() and all(abs(mine[k] - shown[k]) < 2e-6 for k in mine) and len(mine) >= 3


def test_a_block_of_scores_is_bounded():
    """However long an Arrow batch is and however many the queries, a task holds 512 by 2048 scores at once."""
    import numpy as np
    import pandas as pd

    from mnemosa.operators import retrieve
    from mnemosa.operators.best import Best

    class Rows:
        """Stands for a table: keeps the function of its tasks."""

        def __init__(self, rows, **kinds):
            self.rows, self.schema = rows, {k: self._kind(v) for k, v in kinds.items()}

        @staticmethod
        def _kind(name):
            kind = type("Kind", (), {"simpleString": lambda self: name})()
            return type("Field", (), {"dataType": kind})()

        count = lambda self: len(self.rows)
        where = select = lambda self, *a: self
        toPandas = lambda self: self.rows  # noqa: E731, N815

        def mapInPandas(self, run, schema):  # noqa: N802
            return run

    r, seen, add = np.random.default_rng(3), [], Best.add
    facts = pd.DataFrame({"id": range(5000), "vec": list(r.normal(size=(5000, 4)))})
    queries = pd.DataFrame({"qid": range(1100), "q": list(r.normal(size=(1100, 4)))})
    from unittest import mock

    import pyspark.sql.functions as F

    with mock.patch.object(Best, "add", lambda self, scores, *a: seen.append(scores.shape) or add(self, scores, *a)), mock.patch.multiple(F, pmod=mock.DEFAULT, xxhash64=mock.DEFAULT, lit=mock.DEFAULT):
        run = retrieve._best_by_vector(Rows(queries, qid="long"), Rows(facts, id="long"), 3, None, 1 << 16, 512)
        got = pd.concat(run(iter([facts])))
    assert sum(a * b for a, b in seen) == 5000 * 1100 and max(a for a, _ in seen) <= 512 and max(b for _, b in seen) <= 2048
    assert len(got) == 3 * 1100


def test_searches_where_vectors_have_copies(spark, sf, tmp_path, same_rows):
    """A copy with a smaller id comes before the query itself; all three queries give what their SQL gives."""
    import duckdb

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = e.selectExpr("max(vec_id)").first()[0] // 50 * 50 + 50
    e.unionByName(e.withColumn("vec_id", e.vec_id + n)).coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("recall_at_k_mrr", "cosine_topk", "recall_structured_verdict"):
        same_rows(registry.queries()[name](spark, f"file://{tmp_path}"), c.sql(registry.oracle_sql()[name]))
