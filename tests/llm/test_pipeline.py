import collections

import corpus_pipeline
from mnemosa.llm.shared import Tables


def test_stages(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    tables, columns = Tables(spark), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = tables.write(name, stage(spark, docs, sf))
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    for name in ("toxicity_filter", "minhash_near_dedup"):
        before, after = seen[name]
        assert after.exceptAll(before).isEmpty() and 0.8 * before.count() < after.count() <= before.count()
    before, after = seen["substring_dedup"]
    assert before.count() == after.count()
    count = collections.Counter()
    for r in after.select("text").collect():
        w = (r.text or "").split()
        count.update({tuple(w[k : k + 35]) for k in range(len(w) - 34)})
    assert max(count.values(), default=0) <= 1
    _, packed = seen["best_two_fit"]
    used = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    total = sum(r["sum(length)"] for r in used)
    assert max(r["sum(length)"] for r in used) <= 4096 and len(used) <= -(-total // 4096) + 2


def test_run_has_the_last_stages_rows(spark, sf):
    assert set(corpus_pipeline.run(spark, sf).columns) >= {"doc_id", "sequence_id", "offset", "length"}


def test_repeated_and_null_ids_leave_one_row_of_a_group(spark, sf):
    text = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    copied, near = text(1), text(2)
    rows = [(1, copied), (1, copied), (2, near), (3, near + " more"), (3, text(3)), (4, text(4)), (4, text(5)), (None, copied), (None, text(6)), (None, text(6)), (None, text(7)), (None, text(7) + " more"), (7, text(7)), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = corpus_pipeline.minhash_near_dedup(spark, docs, sf)
    want = [(1, copied), (2, near), (3, text(3)), (4, text(4)), (4, text(5)), (None, text(6)), (7, text(7)), (8, None), (8, "")]
    left = corpus_pipeline.substring_dedup(spark, Tables(spark).write("once", once), sf)
    for df in (once, left):
        assert df.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_odd_tables_go_through_all_stages(spark, sf):
    """Nulls in every column, repeated rows, empty and very long texts, extra columns with the operators' names; and no rows at all."""
    long = " ".join(f"long{i}" for i in range(9000))
    rows = [(1, "some words of a text that stands alone", "en", "a", 5), (1, "some words of a text that stands alone", "en", "a", 5), (None, None, None, None, None), (None, "", "en", None, 0), (2, long, None, "b", None), (3, "one", "fr", "c", 3), (4, "\n \t", "fr", "c", 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as score", "1 as label", "'r' as row", "2 as tokens", "'k' as row_key_")
    for docs in (odd, odd.limit(0)):
        tables, some = Tables(spark), not docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            done = tables.write(name, stage(spark, docs, sf))
            assert done.columns == docs.columns and (done.count() > 0) == some
            if name in ("toxicity_filter", "substring_dedup"):
                assert done.count() == docs.count()
            docs = done
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        got = packed.groupBy("doc_id").agg({"piece": "max"}).collect()
        assert ({r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}) and bool(got) == some
