import hashlib
import tarfile
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemosa.llm import chat_format, media, warc
from mnemosa.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(name, spark, sf, duck, same_rows):
    same_rows(queries()[name](spark, sf), duck.sql(oracle_sql()[name]))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_chat_is_native(spark, sf):
    assert not any(x in plan(queries()["op6_reply_tree_chat"](spark, sf)) for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


TREE = "conv_id long, node long, parent long, role string, text string, score double"


def test_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good <|im_end|> <\\|x", 2.0), (1, 4, 3, "user", None, 1.0), (1, 5, 2, "user", "x", 9.0), (1, 6, 4, "assistant", "end", 1.0), (None, 1, None, "u\n\\x", "solo", None), (7, 1, 2, "a", "c", 0.0), (7, 2, 1, "a", "c", 0.0), (8, 3, 99, "user", "lost parent", 0.0)]
    df = chat_format.format_trees(spark.createDataFrame(rows, TREE).withColumn("rank", F.lit(1)).withColumn("leaf", F.lit(1)), 2)
    turns = df.select("conv_id", "rank", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.under_mask(F.col("formatted"), F.col("loss")).alias("m")).collect()
    got = {(r.conv_id, r["rank"]): ([(x.role, x.text) for x in r.t], r.m) for r in turns}
    assert got == {
        (1, 1): ([("user", "q"), ("assistant", "bad"), ("user", "x")], "bad"),
        (1, 2): ([("user", "q"), ("assistant", "good <|im_end|> <\\|x"), ("user", ""), ("assistant", "end")], "good <|im_end|> <\\|xend"),
        (None, 1): ([("u\n\\x", "solo")], ""),
        (8, 1): ([("user", "lost parent")], ""),
    }


def test_messages_on_a_cycle_belong_to_no_path(spark):
    """A cycle, a branch hanging on it, a message that is its own parent, and a tree beside them."""
    rows = [(1, 1, 2, "user", "a", 1.0), (1, 2, 3, "user", "b", 1.0), (1, 3, 1, "user", "c", 1.0), (1, 4, 2, "user", "d", 1.0), (1, 5, 5, "user", "e", 1.0), (1, 6, None, "user", "f", 0.0), (1, 7, 6, "assistant", "g", None), (1, 8, 99, "user", "lost", 0.5)]
    got = chat_format.format_trees(spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double"), 5).collect()
    assert [(r.leaf, r.formatted.count("<|im_start|>")) for r in sorted(got, key=lambda r: r["rank"])] == [(8, 1), (7, 2)]
    assert chat_format.format_trees(spark.createDataFrame([], "conv_id long, node long, parent long, role string, text string, score double")).collect() == []


def test_long_thread_and_ties(spark):
    rows = spark.range(150).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    tied = spark.createDataFrame([(2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "assistant", None)], "conv_id int, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_trees(chat_format.threads(rows.unionByName(tied)))).collect()}
    said = "".join(f"{'user' if i % 2 == 0 else 'assistant'}\nt{i}\n" for i in range(150))
    assert got[1].n_turns == 150 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"assistant\n\nuser\na\nuser\na\n").hexdigest()
    assert chat_format.format_trees(chat_format.threads(rows.limit(0))).collect() == []


@given(st.binary(max_size=2000))
def test_png_round_trip(data):
    payload = media.payload_of(data)
    image = media.encode_png(payload, len(data))
    assert len(payload) % 576 == 0 and payload and media.decode_png(image) == payload
    assert media.read_head(image[: media.HEAD]) == (576, len(payload) // 576, 8, len(data))


def test_media_columns(spark, tmp_path):
    texts = [(1, "hello"), (2, "hello"), (3, None), (4, "é" * 3000), (None, ""), (4, "é" * 3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("offset", F.lit("clash")).repartition(3)
    rows = media.media_columns(df, f"file://{tmp_path}/m").collect()
    assert len(rows) == 6 and len({r.digest for r in rows}) == 3
    for r in rows:
        text = dict(texts).get(r.doc_id) or ""
        payload = media.payload_of(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        with open(f"{tmp_path}/m/{r.shard}", "rb") as f:
            f.seek(r.offset)
            assert hashlib.sha256(f.read(r.length)).hexdigest() == r.digest == r.media_sha256
    names = [m.name for p in (tmp_path / "m").glob("*.tar") for m in tarfile.open(p)]
    assert set(names) == {f"{r.digest}.png" for r in rows}
    assert media.media_columns(df.limit(0), f"file://{tmp_path}/e").collect() == []


def test_shards_roll_over(tmp_path):
    s = media.Shards(f"file://{tmp_path}", 0, most=3000)
    places = [s.add(f"{i:064d}", bytes([i]) * 1000) for i in range(5)]
    assert s.add(f"{4:064d}", b"") == places[4]
    s.close()
    assert len({p for p, _ in places}) > 1 and not list(tmp_path.glob(".*"))


def test_damage_is_seen():
    image = bytearray(media.encode_png(media.payload_of(b"abc"), 3))
    image[-20] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(image))


def _lines(headers):
    return None if headers is None else list(headers.items())


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.X.org/a/", 100, {"etag": '"1"', "content-type": "t", "age": "1"}, b"one"),
        (2, "response", "https://x.org/a?utm_source=f#top", 200, {"etag": 'W/"2"', "content-type": "t"}, b"two"),
        (3, "revisit", "http://m.x.org/a", 150, {"etag": '"1"', "content-type": "other", "age": "9"}, None),
        (4, "revisit", "http://x.org/a", 10_000_000, {"etag": '"2"'}, None),
        (5, "revisit", "http://x.org/a", 250, {"etag": '"1"'}, None),
        (6, "revisit", "http://x.org/a", 50, {"etag": '"1"'}, None),
        (7, "revisit", "http://x.org/a", 260, {}, None),
        (8, "revisit", None, 260, None, None),
        (9, "revisit", "http://y.org", 260, {"etag": '"1"'}, None),
        (10, "response", None, 1, None, b""),
    ]
    df = spark.createDataFrame([(*r[:4], _lines(r[4]), r[5]) for r in rows], warc.CAPTURE)
    back = warc.read_records(warc.write_records(df))
    got = {r.capture_id: (r.response_id, r.status, r.headers and {h.name: h.value for h in r.headers}, r.payload_bytes) for r in warc.resolve(back.withColumn("status", F.lit("clash")), span=1000).collect()}
    assert got[3] == (1, "resolved", {"etag": '"1"', "content-type": "t", "age": "9"}, 3)
    assert got[4][:2] == (2, "resolved") and got[5] == (2, "mismatch", None, None)
    assert got[6][:2] == (None, "no_response") and got[7][:2] == (2, "no_validator") and got[8][1] == got[9][1] == "no_response"
    small = {r.capture_id: (r.response_id, r.status) for r in warc.resolve(back, span=7).collect()}
    assert small == {k: v[:2] for k, v in got.items()}
    assert warc.resolve(df.limit(0)).collect() == []


def test_revisits_against_plain_search(spark):
    """Repeated rows, ties in time, null times and URLs, repeated header names, a hot URL in one second."""
    import random

    r, rows = random.Random(4), []
    for i in range(400):
        url = r.choice(["http://a.org/x", "https://www.a.org/x/", "http://b.org", "http://c.org/?q=1", None])
        at = r.choice([None, 5, 5, *range(0, 40)])
        tags = r.sample([("etag", r.choice(['"1"', 'W/"2"'])), ("last-modified", r.choice(["d", "e"])), ("Via", "p"), ("via", "q"), ("age", str(i))], r.randrange(6))
        rows.append((i, r.choice(["response", "revisit"]), url, at, tags, b"%d" % i))
    rows += rows[:40]
    df = spark.createDataFrame([(*x[:5], x[5] if x[1] == "response" else None) for x in rows], warc.CAPTURE)
    for span in (3, 1000):
        got = sorted((x.capture_id, -1 if x.response_id is None else x.response_id, x.status, [tuple(h) for h in x.headers or ()]) for x in warc.resolve(warc.read_records(warc.write_records(df)), span).collect())
        want = []
        site = lambda u: u and u.replace("www.", "").replace("https:", "http:").rstrip("/")
        first = lambda tags, name: next((v.removeprefix("W/") for k, v in tags if k.lower() == name), None)
        for i, kind, url, at, tags, _ in rows:
            if kind != "revisit":
                continue
            older = [x for x in rows if x[1] == "response" and url and site(x[2]) == site(url) and None not in (at, x[3]) and x[3] <= at]
            if not older:
                want.append((i, -1, "no_response", []))
                continue
            best = max(older, key=lambda x: (x[3], x[0]))
            e, f, m, n = (first(t, k) for k in ("etag", "last-modified") for t in (tags, best[4]))
            agrees = e == f if e and f else m == n if not e and m and n else None
            lower = [(k.lower(), v) for k, v in tags]
            merged = [(k.lower(), v) for k, v in best[4] if k.lower() not in {k for k, _ in lower}] + lower
            want.append((i, best[0], "no_validator" if agrees is None else "resolved" if agrees else "mismatch", merged if agrees else []))
        assert got == sorted(want)


def test_records_of_others_and_line_ends(spark):
    raw = b"WARC/1.0\nWARC-Type: revisit\nWARC-Record-ID: <urn:uuid:12345678-9abc-def0-1234-56789abcdef0>\nWARC-Date: 2020-01-02T03:04:05.5Z\nWARC-Target-URI: <http://a.org/>\nContent-Length: 61\n\nHTTP/1.1 304 Not Modified\r\nSet-Cookie: a\r\nSET-COOKIE: b\r\n c\r\n\r\n\r\n"
    x = warc.parse_record(raw)
    assert x["at"] == 1577934245 and x["url"] == "http://a.org/" and x["headers"] == [{"name": "set-cookie", "value": "a"}, {"name": "set-cookie", "value": "b c"}] and x["capture_id"] >= 0
    assert warc.parse_record(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n") is None
    rows = [(1, "response", "http://a.org/\r\nWARC-Type: x", None, [("A", "1\r\nB: 2"), ("A", None), (None, "z")], b"\r\n\r\nbody"), (2, "revisit", "", 10**15, None, None), (3, "response", "u", 0, [("A", "é")], None)]
    back = {r.capture_id: r for r in warc.read_records(warc.write_records(spark.createDataFrame(rows, warc.CAPTURE))).collect()}
    assert back[1].url == "http://a.org/%0D%0AWARC-Type: x" and [tuple(h) for h in back[1].headers] == [("a", "1 B: 2"), ("a", "")] and bytes(back[1].payload) == b"\r\n\r\nbody"
    assert back[1].at is None and back[2].at is None and back[3].at == 0 and back[3].headers[0].value == "é" and bytes(back[3].payload) == b""


def test_canonical_urls(spark):
    same = ["http://www.X.org:80/a/?b=2&a=1#f", "https://x.org/a?a=1&b=2&utm_medium=z", " HTTPS://m.x.org/a/index.html?b=2&a=1&ref=q "]
    got = {r[0] for r in spark.createDataFrame([(u,) for u in same], "u string").select(warc.canonical_url(F.col("u"))).collect()}
    assert len(got) == 1
