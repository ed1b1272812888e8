import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemosa.llm import mixing, quality_model, quality_rules, toxicity
from mnemosa.llm.queries import queries


def texts(seed=0, n=600):
    """Every sixth is toxic: some words of a family of endings on a rude stem."""
    r = random.Random(seed)
    words = ["".join(r.choices("aeioutnrshl", k=r.randrange(2, 8))) for _ in range(500)]
    out = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randrange(20, 150))]
        if i % 6 == 0:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["zorgum", "zorgon", "zorgit", "blakny", "blaknot"])
        out.append((" ".join(w), int(i % 6 == 0)))
    return out


@pytest.fixture(scope="module")
def detector():
    rows = texts()
    return toxicity.train([t for t, _ in rows], np.array([y for _, y in rows]))


def test_held_out_texts(detector):
    rows = texts(seed=1, n=240)
    score = detector(pa.array([t for t, _ in rows]))
    # seed 1 has other clean words; the rude family is the same
    y = np.array([y for _, y in rows])
    assert (score[y == 1] >= 0.3).mean() > 0.9 and (score[y == 0] < 0.3).mean() > 0.9


def test_scores_are_defined_everywhere(detector):
    score = detector(pa.array(["", None, "...", "zorgum " * 5, "x" * 50_000, "word " * 20_000]))
    assert ((score >= 0) & (score <= 1)).all() and score[3] > score[0]


def test_all_windows_are_read(detector):
    clean = " ".join(t for t, y in texts(n=60) if not y)
    w = clean.split()
    for at in (0, len(w) // 2, len(w)):
        assert detector(pa.array([" ".join(w[:at] + ["zorgum", "blakny", "zorgon"] + w[at:])]))[0] > detector(pa.array([clean]))[0]


def test_gradients_through_windows_words_and_bytes():
    """Of the loss of three windows, by every kind of weight, against differences."""
    rng = np.random.default_rng(0)
    v = toxicity.Vocabulary(pa.array(["ab cde !!! f", "f*** ab"]))
    encoder, net = toxicity.Encoder(v.words[:4], 1), toxicity.Network(1)
    for k in ("vectors", "filters", "bias"):
        setattr(encoder, k, getattr(encoder, k).astype(np.float64))
    encoder.bias += 0.1
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    letters, number = toxicity.Letters(v.data, v.size), encoder.number(v.words)
    assert sorted(number.tolist()) == [0, 1, 2, 3, 4]
    at, mask = rng.integers(0, len(v.words), (3, 5)), np.ones((3, 5))
    mask[0, 3:] = 0
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        x = encoder(number, letters)[at] * mask[:, :, None]
        s = np.concatenate([net.layer(d, (lambda d: lambda t: (x @ net.p[f"W{d}"] + net.p[f"B{d}"])[:, t])(d), mask).astype(float) for d in "fb"], 2)
        z = net.pooled(s, mask)[3]
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() / weight.sum())

    x = encoder(number, letters)
    g, into = net.gradients(x[at] * mask[:, :, None], mask, y, weight)
    dx = np.zeros_like(x)
    np.add.at(dx, at.ravel(), (into * mask[:, :, None]).reshape(-1, toxicity.INPUTS))
    rows, vectors, more = encoder.gradients(number, letters, dx)
    table = np.zeros_like(encoder.vectors)
    table[rows] = vectors
    g |= more | {"vectors": table}
    params = net.p | {"vectors": encoder.vectors, "filters": encoder.filters, "bias": encoder.bias}
    for k in ("Wf", "Ub", "A", "v", "w", "Bb", "vectors", "filters", "bias"):
        for i in [np.unravel_index(n, params[k].shape) for n in np.argsort(-np.abs(g[k]).ravel())[:4]]:
            old = params[k][i]
            params[k][i] = old + 1e-3
            up = loss()
            params[k][i] = old - 1e-3
            down = loss()
            params[k][i] = old
            assert g[k][i] == pytest.approx((up - down) / 2e-3, abs=1e-3)


def test_every_byte_is_a_token():
    v = toxicity.Vocabulary(pa.array(["F*** you2 é!\t$$", None, " \n"]))
    words, at = [], 0
    for n in v.size:
        words.append(bytes(v.data[at : at + n]).decode())
        at += n
    assert [words[i] for i in v.ids] == ["f", "***", "you", "2", "é", "!", "$$"] and v.bounds.tolist() == [0, 7, 7, 7]
    letters = toxicity.Letters(v.data, v.size)
    assert bytes(letters.bytes).decode().split() == words and len(letters.at) == sum(v.size + 1)


def test_all_windows_are_cut():
    row, ids, mask = toxicity.cut(np.array([0, 100, 100, 133]), np.arange(133))
    for r, (a, b) in enumerate(((0, 100), (100, 100), (100, 133))):
        seen = [set(i[m > 0].tolist()) for i, m in zip(ids[row == r], mask[row == r], strict=True)]
        assert set().union(*seen) == set(range(a, b))
        assert all(sum({k, k + 1} <= s for s in seen) >= 1 for k in range(a, b - 1))


def test_calibration_of_parted_scores():
    raw, y = np.r_[np.linspace(-9, -3, 90), np.linspace(3, 9, 10)], np.r_[np.zeros(90), np.ones(10)]
    slope, offset = toxicity._platt(raw, y)
    q = 1 / (1 + np.exp(-(slope * raw + offset)))
    assert q[:90].max() < 0.1 and q[90:].min() > 0.5


def test_scores_of_odd_tables(spark):
    """Null and repeated ids, repeated rows, null texts and labels, clashing columns, an empty table."""
    rows = texts(n=240)
    docs = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(rows)), (None, "x"), (None, None), (3, rows[3][0]), (3, rows[3][0])], "doc_id long, text string")
    docs = docs.withColumns({"score": F.lit("clash"), "y": F.lit(1), "held_out": F.lit(None).cast("string")})
    labels = spark.createDataFrame([*((i, y) for i, (_, y) in enumerate(rows)), (1, None), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 244 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and not any(r.held_out for r in got if r.doc_id is None)
    assert toxicity.score(docs.limit(0), model).collect() == [] and toxicity.fit(docs.limit(0), labels).share == 0.0


def test_a_score_does_not_depend_on_its_neighbours(detector):
    """Equal texts have equal scores alone, among few and among many, to the last bit before rounding."""
    some = [t for t, _ in texts(n=120)] + ["one", "a b c " * 300]
    alone = np.array([detector.raw(pa.array([t]))[0] for t in some])
    assert (detector.raw(pa.array(some)) == alone).all() and (detector.raw(pa.array(some * 7))[-len(some) :] == alone).all()
    assert detector(pa.array([some[0]] * 3)).tolist() == [round(detector(pa.array([some[0]]))[0], 6)] * 3


def test_labels_are_learnt_once_whatever_the_rows(spark):
    """A doc_id with very many rows gives the training one text."""
    rows = texts(n=120)
    docs = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(rows)), *((3, f"{rows[3][0]} {k}") for k in range(500))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    picked = toxicity.examples(docs, labels, "toxic", (4, 2), 4000).collect()
    assert 60 < len(picked) == len({r.doc_id for r in picked}) <= 120 and min(r.text for r in picked if r.doc_id == 3) == rows[3][0]


def test_few_labels():
    assert toxicity.train([], np.array([]))(pa.array(["a"]))[0] == 0.0
    assert toxicity.train(["a", "b"], np.array([1, 1]))(pa.array(["a", ""])).tolist() == [1.0, 1.0]
    assert toxicity.train([""] * 50 + [f"x{i}" for i in range(40)] + [f"y{i}" for i in range(40)], np.array([0] * 50 + [0] * 40 + [1] * 40))(pa.array(["q", None])).shape == (2,)


def test_keep_clean_filters_rows(spark, detector):
    df = spark.createDataFrame([(1, "zorgum blakny zorgon " * 3, 0.5), (2, "aeo tin rshl", 0.1), (3, None, 0.2)], "doc_id long, text string, score double")
    assert {r.doc_id for r in toxicity.keep_clean(df, detector).collect()} == {2, 3} and toxicity.keep_clean(df, detector).columns == df.columns


def _documents(spark, rows, label):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").withColumn("held_out", F.lit("clash"))
    return docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], f"doc_id long, {label} int")


def test_quality_held_out(spark):
    r = random.Random(2)
    words = ["".join(r.choices("aeioutnrshl", k=r.randrange(2, 7))) for _ in range(300)]
    rows = []
    for i in range(500):
        w = [r.choice(words) for _ in range(r.randrange(20, 90))]
        low = i % 4 == 0
        rows.append((" ".join(x + "###" if i % 8 else x + " " + x for x in w) if low else " ".join(w) + ".", int(not low)))
    docs, labels = _documents(spark, rows, "quality")
    got = quality_model.score(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert len(got) > 50 and np.mean([g.predicted == g.quality for g in got]) > 0.95


def test_quality_edges(spark):
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, None), (9, 1)], "doc_id long, quality int")
    got = quality_model.score(odd, labels).collect()
    assert len(got) == 4 and all(0 <= g.score <= 1 for g in got)
    assert quality_model.score(odd.limit(0), labels).collect() == []


def test_context_vectors_equal_a_plain_count():
    index, total = quality_model.index_vectors(), np.zeros((quality_model.BUCKETS, quality_model.SIZE), np.int64)
    words, bounds = np.array([5, 7, 5, 9, 7], np.uint16), np.array([0, 3, 3, 5])
    quality_model.contexts(words, bounds, index, total)
    want = np.zeros_like(total)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for i in range(a, b):
            for j in range(max(a, i - 2), min(b, i + 3)):
                if i != j:
                    want[words[i]] += index[words[j]]
    assert (total == want).all()


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    base = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(rng.integers(10, 500, 400), p, strict=True)], "tokens long, p array<double>")
    n = np.array([r.tokens for r in base.collect()])
    goal = np.array([0.7, 0.2, 0.1]) * n.sum()
    r = mixing.rates(p, mixing.fit_rates(base, lambda totals: goal, 3))
    assert (r >= 0).all() and np.allclose((n * r) @ p, goal, rtol=1e-3)
    # targets out of reach: the rates settle at the least squares, none negative
    p = 0.7 * p + 0.1
    base = spark.createDataFrame([(int(k), [float(x) for x in q]) for k, q in zip(n, p, strict=True)], "tokens long, p array<double>")
    steps = mixing.fit_rates(base, lambda totals: np.array([n.sum(), 0.0, 0.0]), 3)
    r = mixing.rates(p, steps)
    metric = np.linalg.inv((p.T * n) @ p)
    miss = lambda r: (d := (n * r) @ p - np.array([n.sum(), 0.0, 0.0])) @ metric @ d
    assert (r >= 0).all() and len(steps) <= mixing.STEPS
    best = np.ones(len(n))
    for _ in range(5_000):  # plain projected gradient on all rates, to the end
        best = np.maximum(0, best - p @ (metric @ ((n * best) @ p - np.array([n.sum(), 0.0, 0.0]))))
    assert miss(r) <= miss(best) * 1.2
    on = mixing.rates(p, mixing.fit_rates(base, lambda totals: np.array([n.sum(), 0.0, 0.0]), 3, steps=100, still=-1.0))
    assert (on >= 0).all() and miss(on) <= miss(best) * 1.1


@pytest.mark.parametrize("tasks", [1, 50])
def test_copies_meet_expected_tokens(tasks):
    """Whole copies have the tokens that the rates promise, by domain, however few rows a task has."""
    rng = np.random.default_rng(3)
    n, p = rng.lognormal(5, 1.2, 20_000).astype(int), rng.dirichlet([0.2, 0.5], 20_000)
    rate = p @ np.array([0.1, 1.3])
    parts = [(mixing.Copies(2, t), np.arange(len(n))[t::tasks]) for t in range(tasks)]
    copies = np.zeros(len(n), int)
    for c, rows in parts:
        for some in np.array_split(rows, 7):
            copies[some] = c(n[some], p[some], rate[some])
    assert ((copies == np.floor(rate)) | (copies == np.floor(rate) + 1)).all()
    for k in (0, 1):
        assert (copies * n) @ p[:, k] == pytest.approx((rate * n) @ p[:, k], rel=0.005)


def test_mixing_of_odd_tables(spark):
    """Null texts, null and repeated ids, repeated rows, one domain, no domain, clashing columns, an empty table."""
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (None, "x y"), (2, ""), (3, "z " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tokens": F.lit("clash"), "rate": F.lit(0), "domain": F.lit("q")})
    label = lambda *xs: spark.createDataFrame([*xs, (9, "high"), (2, None)], "doc_id long, domain string")
    for labelled in (label((1, "high")), label(), label((1, "high"), (2, "low"), (None, "low"))):
        got = mixing.mix(docs, labelled).collect()
        assert sorted(r.tokens for r in got) == [0, 0, 2, 3, 3, 3000] and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
        assert mixing.mixed_rows(docs, labelled).columns == docs.columns and mixing.mixed_rows(docs, labelled).count() >= 0
    assert mixing.mix(docs.limit(0), label()).collect() == [] and mixing.mixed_rows(docs.limit(0), label()).collect() == []


def test_mixed_rows(spark):
    rows = [("clean words of prose stand here number %d." % i, 1) if i % 3 else ("### %d $$$ | | ###" % i, 0) for i in range(300)]
    docs, labels = _documents(spark, rows, "quality")
    labelled = labels.select("doc_id", mixing.domain_of_label().alias("domain"))
    got = mixing.mix(docs, labelled).collect()
    assert len(got) == 300 and all(g.rate >= 0 for g in got)
    kept = mixing.mixed_rows(docs, labelled)
    assert kept.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert abs(sum(counts.values()) - sum(g.copies for g in got)) <= 4 and set(counts) <= set(range(300))
    assert all(counts.get(i, 0) >= 1 for i in range(300) if i % 3)
    assert mixing.mix(docs.limit(0), labelled).collect() == []


def test_rules_equal_plain_python(spark):
    t = ["", None, "short", "a b c a b c\na b c\n\na b c", "Home | About | Contact\n" + "This is a full line of prose, as it goes on and on with words that differ.\n" * 1, "x " * 60, "\n".join(" ".join(f"word{i}{c}" for c in "abcdefghijk") + "." for i in range(9)) + "\nAll rights reserved.", "é # * é."]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in quality_rules.rule_figures(df, with_text=True).collect()}
    for i, x in enumerate(t):
        x = x or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        repeated = {k + j for k, y in enumerate(tri) if tri.count(y) > 1 for j in range(3)}
        lines = [y for y in x.split("\n") if y.strip()]
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(repeated))
        assert g.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and (not g.kept or not g.base_failed)
    assert quality_rules.rule_figures(df.limit(0)).collect() == [] and sorted(r.doc_id for r in quality_rules.rule_figures(df.union(df)).collect()) == sorted([*got] * 2)
    assert got[6].kept and "rights" not in got[6].clean_text and "Home" not in got[4].clean_text


@pytest.mark.parametrize("name", ["op1_toxicity_bigru", "op7_random_indexing_quality", "op8_soft_domain_mixing"])
def test_queries_give_a_row_for_each_document(spark, sf, name):
    assert queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
