import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemosa.llm import substring_dedup as sd
from mnemosa.llm.textkit import Words, constants


def brute(docs, width=35):
    words = [(t or "").encode().split() for _, t in docs]
    count = collections.Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        covered = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                covered[k : k + width] = [True] * width
        kept = b" ".join(x for x, c in zip(w, covered, strict=True) if not c)
        out.append((i, len(w), sum(covered), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=0):
    r = random.Random(seed)
    word = lambda n=300: "w%d" % r.randrange(n)
    passage = [word() for _ in range(52)]
    texts = []
    for _ in range(25):
        w = [word() for _ in range(r.randrange(120))]
        at = r.randrange(len(w) + 1)
        texts.append(" ".join(w[:at] + passage[r.randrange(10) :] + w[at:]))
    texts += [texts[3], texts[3] + " end", " ".join(passage[:34]), " ".join(passage[:35]), "a " * 90, "a b " * 60, " ".join("ab"[r.random() < 0.5] for _ in range(400)), "a b c " * 30, "", None, "\t\n"]
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tag", F.lit("x"))
    got = sorted((tuple(r) for r in sd.digest(sd.remove_repeats(df)).collect()), key=repr)
    assert got == brute(docs)


def test_repeated_rows_and_ids(spark):
    words = " ".join("q%d" % i for i in range(50))
    docs = [(1, words), (1, words), (None, words + " x"), (None, None), (2, "other " * 10)]
    got = sorted((tuple(r) for r in sd.digest(sd.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))).collect()), key=repr)
    assert got == brute(docs)


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_strip_keeps_columns_and_other_texts(spark):
    passage = " ".join("p%d" % i for i in range(40))
    rows = [(1, "head\n" + passage + "\n\ttail", "k", 0), (2, passage, "l", 0), (3, "as  it\nstands", "m", 0), (4, None, "n", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars long")
    got = {r.doc_id: (r.text, r.row, r.n_chars) for r in sd.strip_repeats(df).collect()}
    assert got == {1: ("head\ntail", "k", 9), 2: ("", "l", 0), 3: ("as  it\nstands", "m", 13), 4: (None, "n", None)}
    assert sd.strip_repeats(df).columns == df.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=35, max_size=80), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_equal_windows_have_equal_anchors(middle, before, after):
    """A window's key, and its place in the anchor's range, don't depend on what stands around it."""
    text = lambda xs: " ".join("w%d" % x for x in xs)
    words = Words(pa.array([text(middle), text(before + middle + after)]))
    found = sd.anchors(words.hashes(), words.bounds, 35, [0, 0, 0])
    key = {}
    for row, lo, hi, k in zip(found["row"], found["lo"], found["hi"], found["key"], strict=True):
        key |= {(int(row), w): int(k) for w in range(int(lo), int(hi) + 1)}
    assert len(key) == (len(middle) - 34) + (len(before) + len(middle) + len(after) - 34)
    assert all(key[0, w] == key[1, w + len(before)] for w in range(len(middle) - 34))


def test_symbols_cover_all_words():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 50, 1000).astype(np.uint64)
    sizes = []
    for levels in range(4):
        name, start = sd.symbols(words, np.repeat([0, 1], 500), [0] * levels)
        assert start[0] == 0 and 500 in start and (np.diff(start) > 0).all()
        sizes.append(1000 / len(name))
    assert sizes == sorted(sizes) and sizes[0] == 1 and sizes[3] > 2.2


def test_windows_without_runs_hold_a_whole_symbol():
    """The interior of a window of 35 words is wide enough for a symbol, so no window has to be its own anchor."""
    words = constants(20_000, 5)
    found = sd.anchors(words, np.array([0, 20_000]), 35, [0, 0, 0])
    assert (found["hi"] - found["lo"] + 1).sum() == 20_000 - 34 and len(found["lo"]) < 20_000 / 4


def test_names_of_a_level_are_settled(spark):
    """A name that stands for two things in different documents is found, and the level gets other seeds."""
    docs = spark.createDataFrame([("a b c d " * 4,), ("e f g h " * 4,), (None,)], "text string").repartition(3)
    sent = sd.names(docs, [0]).collect()
    assert sent and not any(r.clash for r in sent)
    words = Words(pa.array(["a b c d " * 4, "e f g h " * 4]))
    _, start = sd.symbols(words.hashes(), words.row_of(), [0])
    assert len(start) < len(words)
    table = spark.createDataFrame([(7, 2, 2, 3), (7, 4, 4, 1), (8, 2, 2, 1), (8, 2, 2, 1), (9, 1, 2, 2)], "name long, low int, high int, times int")
    assert {r.name: (r.times, r.clash) for r in sd.gathered(table).collect()} == {7: (4, True), 8: (2, False), 9: (2, True)}


def test_a_clash_draws_other_seeds(spark, monkeypatch):
    from mnemosa.llm.shared import Tables

    tried = []

    def fake(docs, seeds):
        tried.append(list(seeds))
        return spark.createDataFrame([(1, 2, len(seeds) == 2 and seeds[-1] < 1)], "name long, times long, clash boolean")

    monkeypatch.setattr(sd, "names", fake)
    assert sd.settled(Tables(spark), spark.createDataFrame([("x",)], "text string")) == [0, 1, 0]
    assert tried == [[0], [0, 0], [0, 1], [0, 1, 0]]


def test_digests_are_of_the_words():
    words = Words(pa.array(["a  b\tc", "b c a", "ab c"]))
    got = sd.digests(words, np.array([0, 1, 3, 6]), np.array([3, 3, 5, 8]))
    assert bytes(got[0].tobytes()) == hashlib.blake2b(b"a b c", digest_size=16).digest()
    assert (got[1] == got[2]).all() and not (got[0] == got[3]).all()


def test_copies_without_id_are_collected_once(spark):
    text = " ".join("q%d" % i for i in range(60))
    docs = spark.createDataFrame([(None, text)] * 40, "doc_id long, text string")
    keyed = docs.select("text", *(c.alias(k) for k, c in sd._keys(F.col("text"), F.col("doc_id")).items()))
    assert [len(r.covered) for r in sd.repeated_windows(keyed).collect()] == [len({(x.lo, x.hi) for r in sd.repeated_windows(keyed).collect() for x in r.covered})]
