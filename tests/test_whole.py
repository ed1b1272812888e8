"""Queries on texts of any script and shape, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from mnemosa.operators import pack
from mnemosa.plans import registry
from mnemosa.sources.views import facts


def facts_of(body):
    found = {}
    for line in (s.strip("-*#• \t") for s in (body or "").split("\n")):
        for s in [line] if len(line) <= 240 else re.split(r"(?<=[.!?])\s+", line, flags=re.A):
            s = s.strip(" ")
            if 14 <= len(s) <= 240:
                found.setdefault(re.sub(r"\s+", " ", s.lower(), flags=re.A).strip(" "), s)
    return list(found.values())[:12]


def test_facts_of_turns_with_long_lines(spark, tmp_path):
    long = " ".join(f"Sentence number {i} of a long line stands here!" for i in range(9))
    rows = [(1, 0, "- A short line of facts.\n" + long), (1, 1, "word " * 80), (1, 2, None), (2, 0, f"* {long} é. Sentence number 3 of a LONG line stands here!\nThe last line here.")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn, r.place): r.fact for r in registry.queries()["heuristic_facts"](spark, f"file://{tmp_path}").collect()}
    assert got == {(c, t, n): f for c, t, body in rows for n, f in enumerate(facts_of(body))}
    assert len([k for k in got if k[:2] == (1, 0)]) == 10 and len(got) == 20


def test_facts_of_all_turns(spark, sf):
    got = {(r.conv_id, r.turn, r.place): r.fact for r in registry.queries()["heuristic_facts"](spark, sf).collect()}
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert got == {(r.conv_id, r.turn, n): f for r in turns for n, f in enumerate(facts_of(r.text))}


NAMES = [r"\b[\w-]+(?:/[\w.-]+)+\b", r"\b\w+\.\w{1,5}\b", r"\b[a-z]+(?:_[a-z0-9]+)+\b", r"(?i)\b[a-z0-9]+\.[a-z0-9]+(?:\.[a-z0-9]+)+\b", r"\b[A-Z][a-z]+(?:[A-Z][a-z0-9]+)+\b"]


def names_of(body):
    found = {m.lower().strip(".") for p in NAMES for m in re.findall(p, body or "")}
    return "|".join(sorted(n for n in found if len(n) >= 4))


def test_names_by_all_patterns_in_any_script(spark, sf, tmp_path):
    rows = list(enumerate(["see core/store.py and a-b/c.d-e/", "add_records of core.recall.search.top in RetentionWeights", "éadd_it naïve_path/größe.txt ÀB.été x.y", "日本.語文 ein_wort, FooBarÉ FooBar", None, "", "-x/y K.kk.ſs ²½.ab a\u0301b.cde"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    run = registry.queries()["entity_extract"]
    assert {r.doc_id: r.names for r in run(spark, f"file://{tmp_path}").collect()} == {i: names_of(t) for i, t in rows}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {r.doc_id: r.names for r in run(spark, sf).collect()} == {r.doc_id: names_of(r.text) for r in docs}


def skipped(rows, most):
    kept, used = {}, {}
    for by, at, cost in sorted(rows):
        if by not in used or used[by] + cost <= most:
            used[by] = used.get(by, 0) + cost
            kept[by, at] = used[by]
    return kept


def test_skip_packs_all_active_facts(spark, sf):
    rows = [(r.project_key, r.id, min(len(r.text), 240) + 3) for r in facts(spark, sf).where("status = 'active'").collect()]
    got = {(r.project_key, r.id): r.used for r in registry.queries()["pack_skip"](spark, sf).collect()}
    assert got == skipped(rows, 1200)


def test_skip_holds_a_bounded_part_of_a_group(spark):
    r = random.Random(5)
    rows = [("free", 0, 500), ("free", 1, 0), ("big", 0, 60), *(("big", i, 243) for i in range(1, 3000)), *(("any", i, r.choice([0, 3, 40, 90, 101, 400])) for i in range(400))]
    rows += [(f"g{k}", i, r.randrange(1, 130)) for k in range(20) for i in range(150)]
    df = spark.createDataFrame(rows, "p string, id long, cost int").repartition(5).withColumn("at", F.col("id"))
    assert {(x.p, x.id): x.used for x in pack.skip(df, ["p"], "at", "cost", 100).collect()} == skipped(rows, 100)
    assert pack._can_fit(df, ["p"], "at", "cost", 100, "id").where("p = 'big'").count() == 2


def test_symbols_of_texts(spark, sf):
    got = {(r.source_path, r.anchor): (r.kind, r.signature, r.doc) for r in registry.queries()["code_symbols"](spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = re.findall("[A-Za-z]{3,}", r.text)
        if len(w) >= 4:
            p = str(r.item_id)
            want |= {(p, f"n_{w[0]}"): ("class", f"class n_{w[0]}", " ".join(w)), (p, f"n_{w[0]}.n_{w[1]}"): ("method", f"def n_{w[1]}(self, x='{w[2]}')", None), (p, f"n_{w[3]}"): ("function", f"async def n_{w[3]}(*a)", None)}
    assert got == want and len(want) > 50


def test_embeddings_of_all_documents(spark, sf):
    import hashlib
    import math

    got = {r.doc_id: (r.dim, r.length, r.places) for r in registry.queries()["hash_embed_blake2b"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        v = [0] * 256
        for w in re.findall("[a-z0-9]+", (r.text or "").lower()):
            for h in (0, 1):
                d = hashlib.blake2b(f"{h}:{w}".encode(), digest_size=8).digest()
                v[int.from_bytes(d[:4], "big") % 256] += 1 if d[4] & 1 else -1
        size, most = math.sqrt(sum(x * x for x in v)), max(map(abs, v)) or 1
        places = {i: x for i, q in enumerate(v) if (x := round(q / most * 127))}
        dim, length, text = got[r.doc_id]
        mine = {int(i): int(x) for i, x in (p.split(":") for p in text.split(",") if p)}
        assert (dim, length) == (256, 1.0 if size else 0.0) and all(abs(mine.get(i, 0) - places.get(i, 0)) <= 1 for i in {*mine, *places})
        assert sum(mine.get(i, 0) != places.get(i, 0) for i in {*mine, *places}) <= 2  # a half may round either way


def test_recall_is_measured_with_every_vector(spark, sf):
    """Against plain scores of all pairs: each vector is a query, not one in fifty."""
    import numpy as np

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    v, label = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    best = []
    for i in range(len(v)):
        order = np.lexsort((np.arange(len(v)), -np.round(v @ v[i], 6)))[:11]
        best.append(next((at for at, j in enumerate(order) if j != i and label[j] == label[i]), np.inf))
    got, best = registry.queries()["recall_at_k_mrr"](spark, sf).first(), np.array(best)
    assert got.queries == len(rows) == 500
    assert np.allclose([got.recall_1, got.recall_3, got.mrr_10], [(best <= 1).mean(), (best <= 3).mean(), (1 / best).mean()], atol=2e-6)
