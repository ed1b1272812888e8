"""Operators 11 to 13 against plain Python, and their defined cases."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemosa.llm import filter_audit, hard_negatives, url_filter


# URL filters

GLOBS = st.text(alphabet="ab/.*?\\é", max_size=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(GLOBS, max_size=12), st.lists(st.text(alphabet="ab/.é*", max_size=12), max_size=12))
def test_automaton_fits_like_regular_expressions(globs, texts):
    import pyarrow as pa

    automaton = url_filter.Automaton([url_filter.glob_rule("block", g) for g in globs])
    got = automaton.first_fit(pa.array(texts, pa.string()))
    for text, k in zip(texts, got, strict=True):
        fits = [i for i, r in enumerate(automaton.rules) if re.fullmatch(url_filter.as_regex(r.name), text)]
        assert k == (fits[0] if fits else -1)


def test_automaton_over_many_words_and_blocks(monkeypatch):
    """Globs that cross 64-bit words, blocks of rules, and one text much longer than the others."""
    import pyarrow as pa

    rng = random.Random(5)
    make = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    globs = [make(rng.randint(1, 90), "abc*/") for _ in range(60)] + ["**needle**", "x" * 200]
    texts = [make(rng.randint(0, 60), "abc/") for _ in range(300)] + ["x" * 200, "y" * 20_000 + "needle" + "z" * 9_000, *(g.replace("*", "a") for g in globs)]
    answers = []
    for words in (64, 3, 1):
        monkeypatch.setattr(url_filter, "BLOCK_WORDS", words)
        automaton = url_filter.Automaton([url_filter.glob_rule("block", g) for g in globs])
        answers.append(automaton.first_fit(pa.array(texts)).tolist())
    rules = [re.compile(url_filter.as_regex(r.name)) for r in automaton.rules]
    assert answers[0] == answers[1] == answers[2] == [next((i for i, r in enumerate(rules) if r.fullmatch(t)), -1) for t in texts]
    monkeypatch.setattr(url_filter, "MOST_PLACES", 100)
    with pytest.raises(ValueError):
        url_filter.Automaton([url_filter.glob_rule("block", g) for g in globs])


def test_host_rules(spark):
    urls = [
        ("http://A.Example.ORG/es/x?q#f", ("a.example.org", "/es/x", "example.org/es/", "block", None)),
        ("http://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block", None)),
        ("http://example.org/en/2", ("example.org", "/en/2", "org/", "allow", None)),
        ("http://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow", None)),
        ("http://x.org", ("x.org", "", None, "allow", None)),
        ("http://evil.net/www.example.org/es/", ("evil.net", "/www.example.org/es/", None, "allow", None)),
        ("http://a.com/de/", ("a.com", "/de/", "com/de/", "block", None)),
        ("http://a.com/DE/", ("a.com", "/DE/", None, "allow", None)),
        ("http://b.net/a.zip?x", ("b.net", "/a.zip", None, "block", "**.zip")),
        ("no scheme", ("", "", None, "block", "")),
        (None, ("", "", None, "block", "")),
        ("", ("", "", None, "block", "")),
        ("file:///etc", ("", "/etc", None, "block", "/**")),
        ("http://a?http://b.com/de/", ("a", "", None, "allow", None)),
        ("http://" + "q" * 100_000 + ".com/fr/", ("q" * 100_000 + ".com", "/fr/", "com/fr/", "allow", None)),
    ]
    pages = spark.createDataFrame([(i, u, "clash", None) for i, (u, _) in enumerate(urls)] + [(None, urls[0][0], None, None)] * 2, "page_id int, url string, host string, verdict string")
    got = url_filter.judge(pages).collect()
    assert {r.page_id: tuple(r)[1:] for r in got if r.page_id is not None} == dict(enumerate(x for _, x in urls))
    assert [tuple(r)[1:] for r in got if r.page_id is None] == [urls[0][1]] * 2
    assert url_filter.judge(pages.limit(0)).collect() == [] and {r.verdict for r in url_filter.judge(pages, (), "block").collect()} == {"block"}


# Filter interaction audit


def replayed(flags, letters):
    """Counts of (part, order, step) by hand; flags has (part, good, toxic, letters that fail)."""
    out = {}
    for part in {x[0] for x in flags}:
        mine = [x for x in flags if x[0] == part]
        for order in itertools.permutations(letters):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[3]]
                failing = [x for x in mine if letter in x[3]]
                left = [x for x in left if letter not in x[3]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(x[3] == {letter} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    for part, order, step in list(out):
        letter = order[step - 1]
        out[part, order, step].append(sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == letter))
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("letters", ["ABCDE", "AB", "X"])
def test_replay_like_by_hand(letters, spark):
    rng = random.Random(len(letters))
    flags = [(rng.choice(["", "en"]), rng.random() < 0.5, rng.random() < 0.3, {x for x in letters if rng.random() < 0.3}) for _ in range(60)]
    rows = [(p, g, t, *(x in f for x in letters)) for p, g, t, f in flags]
    df = spark.createDataFrame(rows, ", ".join(["part string, good boolean, toxic boolean", *(f"{x} boolean" for x in letters)]))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.replay(df, letters).collect()}
    assert got == replayed(flags, letters)


def test_audit_of_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(200))
    docs = [(5, long, "en"), (3, long, None), (3, long, None), (None, long, "en"), (None, None, None), (7, "", "de"), (8, "\x0b \n", "de"), (9, "A a a # é", "de"), (10, "A" * 50_000, "de"), (11, "é" * 9 + "A", "de")]
    df = spark.createDataFrame([(*r, True, "x") for r in docs], "doc_id int, text string, lang string, A boolean, part string")
    labels = spark.createDataFrame([(5, 1, None), (5, 0, 1), (None, 1, 1), (99, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    flags = []
    for i, text, lang in docs:
        text, w = text or "", words(text or "")
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in docs)}
        flags.append((lang or "", i == 5, i in (5, 9), {k for k, v in fails.items() if v}))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(df, labels).collect()}
    assert got == replayed(flags, "ABCDE") and len(got) == 3 * 600
    assert filter_audit.audit(df.limit(0), labels.limit(0)).collect() == []
    with pytest.raises(ValueError):
        filter_audit.orders(spark, "ABCDEFG")


# Hard negatives


def mined(rows, k=5):
    """rows: (vec_id, label, vector of integers or None)."""
    out = []
    last = lambda i: math.inf if i is None else i
    for i, label, x in rows:
        if i is None or i % 100:
            continue
        scored = sorted(((-int(np.dot(x, y)), last(j), lab) for j, lab, y in rows if len(y) == len(x) and (j != i or lab != label)), key=lambda t: t[:2])
        for s, j, _ in [t for t in scored if t[2] == label][:k]:
            fits = [t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s]
            out += [(i, j, n, m, -s, -t) for n, (t, m, _) in enumerate(fits[:k], 1)]
    return sorted(tuple(None if v == math.inf else v for v in r) for r in out)


def rows_of(seed, n, d, spread, anchors=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, d))
    x[n // 3 : 2 * n // 3] = np.round(x[n // 3 : 2 * n // 3], 1)  # ties
    x[: n // 4] = x[0]  # one very common vector
    return [(int(100 * i if i < anchors else 100 * i + 1), int(rng.integers(0, 4)), [float(v) for v in np.float32(v)]) for i, v in enumerate(x)]


@pytest.mark.parametrize(("n", "d", "spread", "rows_a_tree"), [(900, 8, 0.1, 8192), (900, 8, 1.0, 100), (400, 2, 0.05, 8192)])
def test_mined_like_by_hand(n, d, spread, rows_a_tree, spark, monkeypatch):
    rows = rows_of(3, n, d, spread)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)
    monkeypatch.setattr(hard_negatives, "MOST_ROWS", rows_a_tree)
    df = spark.createDataFrame([(i, x, lab) for i, lab, x in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    whole = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(256 * np.array(x)).astype(int)) for i, lab, x in rows]
    assert sorted(map(tuple, hard_negatives.hard_negatives(df).collect())) == mined(whole)


def test_nodes_are_pruned():
    """Of clustered vectors a small part of the scores is worked out, and the best are still right."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 8000)] + 0.05 * rng.normal(size=(8000, 16))))
    ids, labels = np.arange(8000), rng.integers(0, 10, 8000)
    asked = hard_negatives.Queries(x[:50], labels[:50], ids[:50], np.full(50, 3 << 16), np.full(50, 1 << 20), False)
    best = hard_negatives.Best(50, 5)
    done, every = hard_negatives.BallTree(x, ids, labels).search(asked, np.arange(50), best)
    assert done < every / 5
    for q in range(50):
        score = (x @ x[q]).astype(int)
        fits = [i for i in np.lexsort((ids, -score)) if labels[i] != labels[q] and 3 << 16 <= score[i] <= 1 << 20][:5]
        assert best.id[q][best.held[q]].tolist() == fits


def test_mining_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.9, 0.5], 2), (2, [0.9, 0.5], 2), (None, [0.9, 0.5], 2), (None, [1.0, 0.5], 1), (3, [1.0], 1), (4, [], 2), (200, [], 2), (5, [], 3)]
    rows += [(6, None, 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 2), (10, [None, 1.0], 2), (11, [1.0, 1.0], None), (12, [1e30, 1.0], 2), (300, [-1.0, -0.5], 5), (13, [-1.0, -0.25], 5)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id int, embedding array<float>, label int, score string, rank int")
    whole = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, np.floor(256 * np.array(x, np.float64)).astype(int)) for i, x, lab in rows if x is not None and lab is not None and all(v is not None and abs(v) <= 1 << 17 for v in x)]
    got = sorted(map(tuple, hard_negatives.hard_negatives(df).collect()), key=repr)
    assert got == sorted(odd(whole), key=repr) and got
    assert hard_negatives.hard_negatives(df.limit(0)).collect() == []
    assert hard_negatives.hard_negatives(df.where("vec_id = 1")).collect() == []


def odd(rows):
    """mined(), where several rows may have one vec_id."""
    last = lambda i: math.inf if i is None else i
    for i, label, x in rows:
        if i is None or i % 100:
            continue
        scored = sorted(((-int(np.dot(x, y)), last(j), lab) for j, lab, y in rows if len(y) == len(x)), key=lambda t: t[:2])
        for s, j, _ in [t for t in scored if t[2] == label and t[1] != i][:5]:
            fits = [t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s]
            for n, (t, m, _) in enumerate(fits[:5], 1):
                yield (i, None if j == math.inf else j, n, None if m == math.inf else m, -s, -t)


def test_large_components_are_exact():
    a = np.array([[float(1 << 24), 3.0]] * 2)
    b = np.array([[float(1 << 24), 5.0], [float((1 << 24) + 1), 7.0]])
    assert hard_negatives._products(a, b).tolist() == [[int(x) * int(u) + int(y) * int(v) for u, v in b] for x, y in a]
    a *= 1 << 2
    b *= 1 << 2
    assert hard_negatives._products(a, b).tolist() == [[int(x) * int(u) + int(y) * int(v) for u, v in b] for x, y in a]


def test_new_plans(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plan = filter_audit.audit(docs, labels)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" in plan and "partial_count" in plan and "Python" not in plan
    assert "Exchange" not in url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().toString()
