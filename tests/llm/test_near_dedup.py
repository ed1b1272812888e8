import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemosa.llm import near_dedup as nd

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1, copies=40):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(400)
    base = [word() for _ in range(120)]
    texts = [" ".join(word() for _ in range(r.randrange(60))) for _ in range(40)]
    for k in range(copies):  # a chain of edits: neighbours are alike, the ends are not
        base = [word() if r.random() < 0.012 else w for w in base]
        texts.append("  ".join(base) if k % 3 else " ".join(base).upper())
    texts += ["", " \n\t", None, "one two", "ONE TWO", "one two three", "é É", texts[50], texts[50]]
    return list(enumerate(texts, 100))


def test_components_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("node", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df).collect()}
    assert got == brute(docs)


def test_hot_group_is_whole(spark, monkeypatch):
    """Blocks of four nodes: the way of large buckets."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    docs = corpus(seed=3, copies=60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_empty_and_nulls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "z"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(odd).collect()), key=repr)
    assert got == sorted([(None, 5, False), (5, 5, True), (5, 5, True), (None, None, True), (None, None, True)], key=repr)


def test_near_copies_without_ids_link_and_bridge(spark):
    base = ["w%d" % i for i in range(100)]
    edited = lambda k: " ".join(["x%d" % i for i in range(k)] + base[k:])
    ends, bridge, lone = [(7, edited(0)), (8, edited(17))], (None, edited(9)), [(None, "y " + " ".join("z%d" % i for i in range(60))), (None, " ".join("z%d" % i for i in range(60)))]
    of = lambda rows: sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert of(ends) == [(7, 7, True), (8, 8, True)]
    assert of([*ends, bridge, bridge, *lone]) == sorted([(7, 7, True), (8, 7, False), (None, 7, False), (None, 7, False), (None, None, True), (None, None, True)], key=repr)


@pytest.mark.parametrize("share", [0.6, 0.8])
def test_signature_is_unbiased(share):
    rng = np.random.default_rng(0)
    agree = []
    for _ in range(60):
        both, a, b = int(400 * share), *((400 - int(400 * share)) // 2,) * 2
        x = rng.integers(0, 2**63, 400).astype(np.uint64)
        agree.append((nd.signature(x[: both + a]) == nd.signature(np.concatenate([x[:both], x[both + a : both + a + b]]))).mean())
    assert abs(np.mean(agree) - share) < 0.02


def test_long_text_in_one_row():
    text = " ".join("x%d" % i for i in range(300_000))
    assert [len(s) for s in nd.shingle_sets(pa.array([text, "", None, "a"]))] == [299_996, 0, 0, 1]
