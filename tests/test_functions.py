import math
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from mnemosa import evalkit
from mnemosa.functions import porter, scoring, text, vec
from mnemosa.operators import fts, lifecycle, retrieve
from mnemosa.operators.term_index import TermIndex
from mnemosa.sources import chunking, imports, transcript


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_quantise_and_bits(spark):
    v = F.array(*map(F.lit, (0.5, -1.0, 0.0, 0.25)))
    r = one(spark, vec.quantize_int8(v, vec.scale_of(v)), vec.sign_bits(v), vec.pack_bits(v), vec.scale_of(F.array(F.lit(0.0))))
    assert list(r[0]) == [64, -127, 0, 32] and r[1] == "1011" and bytes(r[2]) == b"\xb0" and r[3] == 1.0


def test_cosine_of_nothing_is_zero(spark):
    z, a = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, vec.cosine(z, a))[0] == 0.0


def test_scores(spark):
    r = one(spark, scoring.recency_decay(F.lit(30 * 86_400.0), 30), scoring.recency_decay(F.lit(-5.0), 30), scoring.frequency_boost(F.lit(8)), scoring.frequency_boost(F.lit(1)), scoring.confidence(F.lit(0.5), F.lit(0.25), F.lit(1.0)))
    assert r[0] == pytest.approx(0.5) and r[1] == 1.0 and r[2] == pytest.approx(1.0) and r[3] == 0.0
    assert r[4] == round(math.exp(0.35 * math.log(0.5) + 0.4 * math.log(1 - math.exp(-1))), 3)


def test_statistics():
    assert evalkit.mcnemar_exact(1, 9) == 22 / 1024 and evalkit.mcnemar_exact(0, 0) == 1 and evalkit.mcnemar_exact(5, 5) == 1
    assert evalkit.wilcoxon_exact([1, 2, 3, 4, 5]) == (0, 0.0625) and evalkit.wilcoxon_exact([-1, -2, 3, 0]) == (3.0, 1.0) and evalkit.wilcoxon_exact([0]) == (0, 1)
    low, high = evalkit.bootstrap_ci([0.0, 1.0] * 50, 2000)
    assert 0.35 < low < 0.5 < high < 0.65 and evalkit.bootstrap_ci([]) == (0, 0) and evalkit.bootstrap_ci([2.0]) == (2, 2)


def test_signed_ranks_equal_all_signs():
    """The p of every outcome against an enumeration of all signs, with ties."""
    import itertools

    for d in ([1, -2, 3, -4, 5, 6], [1, 1, -1, 2, -2, 2], [-3, 3, -3, 1], [0, 0.5, -0.5, 2.5, -7]):
        x = sorted((v for v in d if v), key=abs)
        ranks = [sum(abs(w) < abs(v) for w in x) + (sum(abs(w) == abs(v) for w in x) + 1) / 2 for v in x]
        minus = sum(r for r, v in zip(ranks, x, strict=True) if v < 0)
        least = min(minus, sum(ranks) - minus)
        sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(x))]
        assert evalkit.wilcoxon_exact(d) == (minus, min(1.0, 2 * sum(s <= least for s in sums) / len(sums)))


def test_stems():
    words = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic", "adjustment": "adjust", "adoption": "adopt", "controll": "control", "rate": "rate"}
    assert {w: porter.stem(w) for w in words} == words


def fts5(texts, queries, columns=("text",), weights=()):
    """What SQLite's own index gives: (qid, id) -> bm25."""
    c = sqlite3.connect(":memory:")
    c.execute(f"create virtual table t using fts5({', '.join(columns)}, tokenize='porter unicode61')")
    c.executemany(f"insert into t(rowid, {', '.join(columns)}) values (?{', ?' * len(columns)})", texts)
    found = {}
    for q, text_ in queries:
        terms = [w for w in re.findall("[a-z0-9_]+", text_.lower()) if w.strip("_")]
        if terms:
            rank = f"bm25(t{''.join(f', {w}' for w in weights)})"
            match = " OR ".join('"' + w + '"' for w in terms)
            found |= {(q, i): round(s, 6) for i, s in c.execute(f"select rowid, {rank} from t where t match ?", (match,))}
    return found


def same_scores(got, want):
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-5) for k in want)


def test_stemmed_search_equals_fts5(spark, tmp_path):
    """Stems, accents, phrases with underscores, repeated terms, column weights, digits, other scripts."""
    texts = [(0, "the running dogs ran quickly", "Dogs"), (1, "a dog runs core store", "étion façade"), (2, "cats sleeping on connected mats", "core_store x"), (3, "connection of cats and dogs 42 core.store", None), (4, "", ""), (5, "日本 語 naïve ΑΒΓ", "42nd")]
    asked = [(0, "dogs connecting"), (1, "core_store"), (2, "dog dog runs_core Core_Store_x"), (3, "facade etion naive 42"), (4, "étion _ 語"), (5, "")]
    docs = spark.createDataFrame(texts, "id long, text string, title string")
    queries = spark.createDataFrame(asked, "qid long, query string")
    weights = {"text": 1.0, "title": 3.0}
    want = fts5(texts, asked, ("text", "title"), (1.0, 3.0))
    same_scores({(r.qid, r.id): r.bm25 for r in fts.bm25(docs, queries, weights, stem=True).collect()}, want)
    kept = TermIndex(spark, f"file://{tmp_path}/i", list(weights), buckets=2)
    kept.update(docs.select(F.col("id").cast("string").alias("id"), F.lit("1").alias("version"), *weights))
    same_scores({(r.qid, int(r.id)): r.bm25 for r in kept.search(queries, [1.0, 3.0]).collect()}, want)


def test_stemmed_search_of_all_documents_equals_fts5(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as id", "text")
    asked = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).collect()]
    want = fts5([(r.id, r.text) for r in docs.collect()], asked)
    got = fts.bm25(docs, spark.createDataFrame(asked, "qid long, query string"), {"text": 1.0}, stem=True)
    same_scores({(r.qid, r.id): r.bm25 for r in got.collect()}, want)


def test_markdown():
    body = "---\ntitle: x\n---\nlead é\n# A\none\n```\n# not\n```\n## B\ntwo\nC\n===\nthree\n# A\n"
    got = chunking.sections("p", body)
    assert [(r[1], r[4]) for r in got] == [("_root", 0), ("a", 1), ("a/b", 2), ("c", 1), ("a-2", 1)]
    data = body.encode()
    assert all(data[r[5] : r[6]].decode() == r[7] for r in got)
    assert chunking.sections("p", "no heading")[0][1] == "_root" and chunking.sections("p", " \n") == []


def test_symbols():
    src = "@d\ndef f(a, *, b=1):\n    'doc'\n\nclass K:\n    async def m(self): ...\n"
    got = chunking.symbols("p", src)
    assert [(r[1], r[2], r[3]) for r in got] == [("f", "function", "def f(a, *, b=1)"), ("K", "class", "class K"), ("K.m", "method", "async def m(self)")]
    assert chunking.symbols("p", "def (") == []


def test_transcript(spark, tmp_path):
    lines = ['{"type":"user","message":{"role":"user","content":"hello <system-reminder>x</system-reminder>"}}', '{"type":"assistant","message":{"content":[{"type":"thinking","text":"no"},{"type":"text","text":"yes"},{"type":"tool_use","id":"t1","name":"Edit","input":{"file_path":"a.py"}}]}}', '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t1","content":"12345"}]}}', "broken"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(r.text for r in transcript.texts(df).collect()) == ["Edited a.py", "hello", "yes"]
    assert [(r.id, r.bytes) for r in transcript.tool_calls(df).collect()] == [("t1", 5)]
    p = tmp_path / "t.jsonl"
    p.write_text("a\nb\npart")
    got, at = transcript.read_delta(spark, f"file://{p}", 0)
    assert got == ["a", "b"] and at == 4
    assert transcript.read_delta(spark, f"file://{p}", 99)[0] == ["a", "b"]


def test_distilled(spark):
    raw = 'Sure:\n```json\n{"observations":[{"title":"T","facts":["one fact","n/a"],"supersedes":["x"]}]}\n```'
    other = '{"facts":[{"text":"lone"},{"text":"none"}]}'
    df = imports.distilled(spark.createDataFrame([(1, raw), (2, other), (3, "nothing")], "k int, raw string"))
    assert sorted((r.k, r.text, tuple(r.supersedes)) for r in df.collect()) == [(1, "one fact", ("x",)), (2, "lone", ())]


def test_heuristic_facts_and_urls(spark):
    t = F.lit("- First fact stands here.\n- first fact  stands here.\nshort\n" + "Long sentence number one is here. " * 10)
    r = one(spark, text.heuristic_facts(t), text.normalize_url(F.lit(" HTTP://X.org/A/?q#f ")))
    assert r[0] == ["First fact stands here.", "Long sentence number one is here."] and r[1] == "http://x.org/a"


def test_supersede_and_clusters(spark):
    rows = [(1, 1, "p", [1.0, 0.0], "a", 1), (2, 2, "p", [0.98, 0.02], "b", 5), (3, 3, "p", [0.0, 1.0], "c", 1), (4, 4, "q", [1.0, 0.0], "d", 1)]
    f = spark.createDataFrame(rows, "id long, seq long, project_key string, vec array<double>, text string, frequency int")
    assert {(r.id, r.by) for r in lifecycle.superseding(f, 0.9, block=1).collect()} == {(1, 2)}
    g = f.selectExpr("*", "'active' status", "'stm' tier", "0 recall_count", "0.0D last_seen", "0.0D created_at")
    assert {(r.id, r.survivor) for r in lifecycle.cluster_duplicates(g, 0.9).collect()} == {(1, 2)}
    assert {(r.a, r.b) for r in lifecycle.similar_pairs(f, 0.9, "project_key", block=1).collect()} == {(1, 2)}


def test_topk_in_blocks_of_queries(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(60)], "id long, vec array<double>")
    q = v.where("id % 10 = 0").selectExpr("id as qid", "vec as q")
    whole = {(r.qid, r.id, r.rank) for r in retrieve.batch_topk(q, v, 5).collect()}
    assert whole == {(r.qid, r.id, r.rank) for r in retrieve.batch_topk(q, v, 5, block=2).collect()} and len(whole) == 30


def test_scan_gate(spark):
    """100,000 vectors of 64 dimensions against one query, warm, in under five seconds."""
    import time

    v = spark.range(100_000).select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(F.col("id") * (i + 1)).cast("double")).alias("vec")).cache()
    v.count()
    q = v.where("id = 7").selectExpr("id as qid", "vec as q")
    for _ in range(2):
        began = time.time()
        rows = retrieve.batch_topk(q, v, 3).collect()
    assert rows[0].sim is not None and min(r.rank for r in rows) == 1 and time.time() - began < 5


def test_numbers_equal_one_sort(spark):
    """For keys of any type, ties, nulls and a value that is in a third of all rows."""
    rows = [(f"k{i:04d}", None if i % 13 == 0 else float(i * 7 % 50) if i % 3 else 9.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, x double").repartition(7)
    for up in (True, False):
        order = sorted(rows, key=lambda r: (r[1] is None, (r[1] or 0) * (1 if up else -1), r[0]))
        want = {i: n for n, (i, _) in enumerate(order, 1)}
        got = retrieve.numbered(df, [F.asc_nulls_last("x") if up else F.desc_nulls_last("x"), F.asc("id")], "n")
        assert {r.id: r.n for r in got.collect()} == want
    assert retrieve.numbered(df.limit(0), [F.asc("id")], "n").collect() == []


def test_ranks_by_parts_equal_ranks_by_sort(spark):
    rows = [(f"id{i}", (i % 7) / 10 - 0.2, i % 3, -float(i % 5) if i % 2 else None, float(i * 31 % 17), i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, sim double, lexical long, bm25 double, last_seen double, frequency long")
    assert sorted(map(tuple, retrieve.with_ranks(df, 0).collect()), key=repr) == sorted(map(tuple, retrieve.with_ranks(df).collect()), key=repr)


def test_topk_over_batches_and_groups_of_queries(spark):
    """A task keeps its best over all its batches; ids of any type; ties by id."""
    import numpy as np

    v = np.random.default_rng(0).integers(-2, 3, (700, 4)).astype(float)
    facts = spark.createDataFrame([(f"f{i:03d}", x.tolist()) for i, x in enumerate(v)], "id string, vec array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 700, 50)], "qid long, q array<double>")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(n > 0, n, 1)
    want = {}
    for i in range(0, 700, 50):
        s = np.round(u[i] @ u.T, 6) + 0.0
        want |= {(i, rank): f"f{j:03d}" for rank, j in enumerate(np.lexsort((np.arange(700), -s))[:6], 1)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for most, block in ((1 << 16, 1024), (4, 3)):
            assert {(r.qid, r.rank): r.id for r in retrieve.batch_topk(asked, facts, 6, most, block).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_every_row_asks_all_rows(spark):
    """Over blocks and parts of any size; ids of any type; ties by id; a vector without length, and more hits asked than there are."""
    import numpy as np

    v = np.random.default_rng(4).integers(-2, 3, (300, 4)).astype(float)
    v[7] = 0
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(n > 0, n, 1)
    facts = spark.createDataFrame([(f"f{i:03d}", x.tolist()) for i, x in enumerate(v)], "id string, vec array<double>").repartition(3)
    for k, asked, met, block in ((6, 1 << 15, 1 << 17, 512), (6, 50, 70, 3), (40, 20, 20, 512)):
        want = {(f"f{i:03d}", rank): f"f{j:03d}" for i in range(300) for rank, j in enumerate(np.lexsort((np.arange(300), -(np.round(u[i] @ u.T, 6) + 0.0)))[:k], 1)}
        assert {(r.qid, r.rank): r.id for r in retrieve.all_topk(facts, k, asked, met, block).collect()} == want
    assert {(r.qid, r.id, r.rank) for r in retrieve.all_topk(facts.limit(2), 6).collect()} == {(r.qid, r.id, r.rank) for r in retrieve.batch_topk(facts.limit(2).selectExpr("id as qid", "vec as q"), facts.limit(2), 6).collect()}
    assert retrieve.all_topk(facts.limit(0), 6).collect() == []


def test_products_of_single_precision_lose_no_hit():
    """Many scores around the k-th are closer than single precision tells apart; NaN comes first."""
    import numpy as np

    from mnemosa.operators.best import Best, unit

    r = np.random.default_rng(5)
    v = unit(r.normal(size=(1, 300)) + 1e-3 * r.normal(size=(6000, 300)))
    v[5] = np.nan
    for k, step in ((5, 2048), (11, 700), (50, 40)):
        one, two = Best(40, k), Best(40, k)
        for at in range(0, 6000, step):
            ids = np.arange(at, min(at + step, 6000))
            one.add(v[:40] @ v[ids].T, ids)
            two.add_products(v[:40], v[ids], ids)
        a, b = ({(q, i): s for q, i, s in zip(*(x.tolist() for x in best.rows()), strict=True)} for best in (one, two))
        assert repr(sorted(a.items())) == repr(sorted(b.items())) and len(a) == 40 * k


def test_hash_embedding_equals_its_definition(spark):
    import hashlib

    texts = ["Alpha beta, beta 42!", "", None, "été naïve", "x" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", vec.hash_embed(F.col("t"), 32).alias("v")).collect()
    for r in rows:
        want = [0.0] * 32
        for w in re.findall("[a-z0-9]+", (texts[r.i] or "").lower()):
            for h in (0, 1):
                d = hashlib.blake2b(f"{h}:{w}".encode(), digest_size=8).digest()
                want[int.from_bytes(d[:4], "big") % 32] += 1 if d[4] & 1 else -1
        size = math.sqrt(sum(x * x for x in want))
        assert list(r.v) == pytest.approx([x / size if size else x for x in want])


def test_scorers_agree(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [-2.0, 1.0])], "id int, vec array<double>")
    q = spark.createDataFrame([([1.0, 1.0],)], "q array<double>")
    by = lambda m: {r.id: r.sim for r in retrieve.with_similarity(df, q, m).collect()}
    assert by("sql") == by("arrow") and set(by("sql")) == {1, 2, 4}


def test_settings_from_the_environment():
    from mnemosa.config import DEFAULT, Config

    c = Config.from_env({"top_k": "7"}, {"MNEMOSA_TOP_K": "5", "MNEMOSA_MIN_SIM": "0.5", "MNEMOSA_CROSS_PROJECT": "yes", "MNEMOSA_QUEUE_BACKOFF": "1,2", "MNEMOSA_DIM": "many"})
    assert (c.top_k, c.activated_k, c.min_sim, c.cross_project, c.queue_backoff, c.dim) == (7, 7, 0.5, True, (1, 2), DEFAULT.dim)
    assert Config.from_env({}, {}).activated_k == DEFAULT.top_k


def test_where_another_store_lies(tmp_path):
    (tmp_path / "x").mkdir()
    at = lambda *a, **k: str(imports.db_path(*a, home=tmp_path, env=k.get("env", {}), settings=k.get("settings")).relative_to(tmp_path))
    assert at(f"{tmp_path}/f.db", "V", "n.db") == "f.db" and at(None, "V", "n.db", env={"V": f"{tmp_path}/x"}) == "x/n.db"
    assert at(None, "V", "n.db", settings={"data_dir": f"{tmp_path}/x"}) == "x/n.db" and at(None, "V", "n.db") == "n.db"


def test_tool_calls_as_lines(spark):
    import json

    use = lambda name, role="assistant", **args: json.dumps({"type": role, "message": {"content": [{"type": "tool_use", "id": "1", "name": name, "input": args}]}})
    rows = [use("Write", file_path="/a/b.py"), use("Read", file_path="c/"), use("Bash", command="ls\n -l " + "x" * 100), use("Grep", pattern="p"), use("Task", subagent_type="s"), use("WebFetch", url="u"), use("TodoWrite", todos="t"), use("mcp__x__y", a="b"), use("Other", a="b"), use("Read", "user", file_path="z"), json.dumps({"type": "user", "message": {"content": "<command-name>x"}}), json.dumps({"type": "user", "message": {"content": [{"type": "text", "text": "Why?"}]}})]
    df = spark.createDataFrame([(x,) for x in rows], "value string")
    got = [r.text for r in transcript.texts(df).collect()]
    assert sorted(got) == sorted(["Wrote b.py", "Read c", "Ran: ls -l " + "x" * 73 + "…", "Searched for p", "Delegated task: s", "Fetched u", "Called mcp__x__y", 'Used Other: {"a":"b"}', "Why?"])
    assert [r.text for r in transcript.asked(df).collect()] == ["Why?"]


def test_bytes_of_results_of_any_shape(spark):
    """Strings, lists, nothing, numbers; texts that only begin like JSON; bytes and not characters."""
    import json

    from mnemosa.functions import rules
    from mnemosa.sources import transcript

    say = lambda c, i: json.dumps({"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": i, "content": c}]}}, ensure_ascii=False)
    use = lambda i: json.dumps({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": i, "name": "Read", "input": {"file_path": "a"}}]}})
    contents = [[{"type": "text", "text": "é" * 10}], "[x é", "é", '{"a": "text"}', [{"type": "text", "text": "a"}, 5, {"text": 77}], None, [{"type": "image"}], 12]
    lines = [use(str(i)) for i in range(len(contents) + 1)] + [say(c, str(i)) for i, c in enumerate(contents)] + [say("again", "2"), "no json", "null"]
    got = {r.id: r.bytes for r in transcript.tool_calls(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"0": 20, "1": 5, "2": 7, "3": 13, "4": 3, "5": 0, "6": 0, "7": 0, "8": 0}
    shapes = {"[note] all fine": "[note] all fine", "{curly": "{curly", '[{"text":"a"},{"type":"image"},5,{"text":7},{"text":"b"}]': "a\nb", '{"content":[{"text":"c"}],"text":"no"}': "c", '{"text":5,"result":"r"}': "r", '"quoted"': "quoted", "": "", "12": "12", "null": "", "{}": "", "[]": ""}
    df = spark.createDataFrame([(x,) for x in [*shapes, None]], "r string")
    assert {r.r: r.t for r in df.select("r", rules.result_text(F.col("r")).alias("t")).collect()} == shapes | {None: ""}


def test_projects_of_folders(spark):
    from mnemosa.sources import projects

    sessions = [("/w/a/b/c", None), ("/w/a/b/../x/", "/w/q"), ("/w/p/s", ""), (None, None), ("/", None), ("/w/a//b/./c", None)]
    df = spark.createDataFrame(sessions, "cwd string, project_dir string")
    held = spark.createDataFrame([("/w/a", ".git"), ("/w/a/b/", "package.json"), ("/w/p", projects.ROOT), ("/w/p/s", ".git"), ("/w", "other"), ("/w/a", ".git")], "path string, name string")
    of = lambda by: {(r.cwd, r.project_dir): (r.project_path, r.project_label) for r in projects.resolve(df, held, by).collect()}
    assert of("workspace") == {("/w/a/b/c", None): ("/w/a/b/c", "c"), ("/w/a/b/../x/", "/w/q"): ("/w/q", "q"), ("/w/p/s", ""): ("/w/p", "p"), (None, None): (None, None), ("/", None): ("/", "root"), ("/w/a//b/./c", None): ("/w/a/b/c", "c")}
    assert of("marker") == {("/w/a/b/c", None): ("/w/a/b", "b"), ("/w/a/b/../x/", "/w/q"): ("/w/a", "a"), ("/w/p/s", ""): ("/w/p", "p"), (None, None): (None, None), ("/", None): ("/", "root"), ("/w/a//b/./c", None): ("/w/a/b", "b")}
    import hashlib

    assert {r.project_key for r in projects.resolve(df, held, "marker").where("cwd = '/'").collect()} == {hashlib.sha256(b"/").hexdigest()[:16]}
    with pytest.raises(ValueError):
        projects.resolve(df, held, "name")


def test_front_matter_of_both_kinds():
    from mnemosa.sources.chunking import headings

    assert [t for _, _, t in headings('+++\n# a comment\ntitle = "x"\n+++\n# One\n')] == ["One"]
    assert [t for _, _, t in headings("---\n# a comment\n---\n# One\n")] == ["One"]
    assert [t for _, _, t in headings("+++\n# never closed\n---\n# One\n")][:1] == ["never closed"]
