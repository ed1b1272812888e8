import pytest
from pyspark.sql import functions as F

from mnemosa.engine import Engine
from mnemosa.operators import lifecycle, sensory, work_queue


def test_loop(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m")
    t = spark.createDataFrame([("We decided to use Parquet for the storage layer.\nTokens are counted by the ledger.",)], "text string")
    e.capture(t, "p", 1000.0)
    e.capture(t, "p", 2000.0)
    assert {(r.frequency, r.tier) for r in e.facts.read().collect()} == {(2, "ltm")}
    assert "Parquet" in e.recall_block("parquet storage layer", "p", 3000.0).first().block
    assert e.recall("ledger tokens", "p", 3000.0).first().text.startswith("Tokens")
    e.consolidate(4000.0)
    assert e.projects().first().ltm == 2 and e.core("p").count() == 2


def test_one_capture_reinforces_and_supersedes(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m")
    a, b, c = "The storage layer of the project uses Parquet files on the shared disk now.", "The storage layer of the project uses Parquet files on the shared disk today.", "Tokens are counted by a ledger."
    put = lambda now, *lines: e.capture(spark.createDataFrame([("\n".join(lines),)], "text string"), "p", now)
    of = lambda: {r.text: (r.frequency, r.tier, r.status, r.superseded_by) for r in e.facts.read().collect()}
    e.capture(spark.createDataFrame([(t,) for t in (c, a, c, b)], "text string").coalesce(1), "p", 1.0)
    ids = {r.text: r.id for r in e.facts.read().collect()}
    assert of() == {a: (1, "stm", "superseded", ids[b]), b: (1, "stm", "active", None), c: (2, "ltm", "active", None)}
    put(2.0, a)  # seen again: active again, by what superseded it
    assert of()[a] == (2, "ltm", "active", ids[b])
    d = b.replace("today", "again")
    put(3.0, d)
    new = {r.text: r.id for r in e.facts.read().collect()}[d]
    assert of() == {a: (2, "ltm", "superseded", new), b: (1, "stm", "superseded", new), c: (2, "ltm", "active", None), d: (1, "stm", "active", None)}
    f = b.replace("today", "finally")
    e.capture(spark.createDataFrame([(t,) for t in (f, d)], "text string").coalesce(1), "p", 4.0)
    last = {r.text: r.id for r in e.facts.read().collect()}[f]
    assert of()[d] == (2, "ltm", "active", last) and of()[f] == (1, "stm", "active", None)


def test_index(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m")
    rows = [("a.md", "# One\nalpha\n## Two\ngamma"), ("b.py", "def f(x):\n  return x\n")]
    e.index(spark.createDataFrame(rows, "source_path string, body string"), "p", 1.0)
    assert e.search_index("gamma", "p").first().anchor == "one/two"
    e.index(spark.createDataFrame([("a.md", "# New\nx")], "source_path string, body string"), "p", 2.0)
    assert {r.anchor for r in e.outline("p").collect()} == {"new", "f"}


def test_sweep_keeps_what_has_no_time(spark):
    f = spark.createDataFrame([(1, "fact", 0.0, 1, "active"), (2, None, 0.0, 1, "active"), (3, "fact", None, 1, "active"), (4, "fact", 0.0, 5, "active"), (5, "antipattern", 0.0, 1, "active")], "id int, kind string, last_seen double, frequency int, status string")
    assert [r.id for r in lifecycle.sweep(f, 1e7, 100.0, 3).where("status = 'expired'").collect()] == [1]


def test_register(spark):
    rows = spark.createDataFrame([("a", "p", 100.0, 0, None), ("b", "p", 950.0, 0, None), ("c", "p", 100.0, 1, None), ("d", "p", 50.0, 0, 20.0)], "id string, project_key string, created_at double, attended int, decayed_at double")
    assert {(r.id, r.decayed_at) for r in sensory.sweep(rows, 1000.0, 60.0, 64).collect()} == {("a", 1000.0), ("b", None), ("c", None)}


def test_queue(spark):
    q = spark.createDataFrame([("m", "s", "pending", 0, 0.0, None, 1.0)], "msg_id string, stage string, status string, attempts int, next_retry_at double, lease_expires double, enqueued_at double")
    taken = work_queue.apply(q, work_queue.claim(q, 100.0, 10.0, 5))
    assert taken.first().lease_expires == 110.0 and work_queue.claim(taken, 105.0, 10.0, 5).isEmpty()
    assert work_queue.claim(taken, 120.0, 10.0, 5).first().attempts == 2
    other = taken.withColumn("msg_id", F.lit("n"))
    given = {r.msg_id: r for r in work_queue.nak(taken.unionByName(other), taken, 100.0, (50,), 5).collect()}
    assert given["m"].next_retry_at == 150.0 and given["m"].status == "pending" and given["n"].status == "in_progress" and given["n"].lease_expires == 110.0
    assert work_queue.nak(taken, taken, 100.0, (50,), 1).first().status == "dead" and work_queue.term(taken, taken).first().status == "dead"
    assert work_queue.purge(q, status="pending").isEmpty() and work_queue.purge(q, stage="t").count() == 1
    with pytest.raises(ValueError):
        work_queue.purge(q)


def test_attention_needs_a_page(spark):
    rows = [("a", None, 1.0), ("b", None, 2.0), ("c", "http://x", 1.0), ("d", "http://x#y", 9.0), ("e", "http://x", 9000.0)]
    df = spark.createDataFrame([(i, "p", u, "visual", t, 0, None) for i, u, t in rows], "id string, project_key string, url string, modality string, created_at double, attended int, decayed_at double")
    assert {r.id for r in sensory.attend(df).where("attended = 1").collect()} == {"c", "d"}
