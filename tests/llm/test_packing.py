import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemosa.llm import packing
from mnemosa.llm.shared import Tables
from mnemosa.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't I'll we'VE x's <|endoftext|>a<|startoftext|>", "b́ ﬁ İx ΣΑΣ. 中文 \x1c q\x85r ½ ² 3.14 ªº µ ſs", "", "ABC,def. <b>", "a b   c"]


def test_ids_equal_the_tokenizer():
    t = Tokenizer.from_file(PATH)
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(ODD, add_special_tokens=False)]
    assert WordIds(PATH).packed(pa.array(ODD)) == want


def test_ids_of_documents_equal_the_tokenizer(sf):
    import pyarrow.parquet as pq

    column = pq.read_table(f"{sf}/documents.parquet").column("text").combine_chunks()
    texts = [*(t or "" for t in column.to_pylist()), "A.", ".", ",", "a,", "Word.. word.", "İ.", "x<|endoftext|>.", "é,", "don't.", "b1."]
    t = Tokenizer.from_file(PATH)
    w = WordIds(PATH)
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert w.packed(pa.array(texts)) == want and w.packed(pa.array(texts[::-1])) == want[::-1]


def test_cache_starts_anew(monkeypatch):
    from mnemosa.llm import tokens

    monkeypatch.setattr(tokens, "MOST_CHUNKS", 3)
    w, t = WordIds(PATH), Tokenizer.from_file(PATH)
    for i in range(20):
        text = f"word{i} common word{i}, {ODD[0]}"
        assert w.packed(pa.array([text, None, "", text[::-1]])) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in (text, "", "", text[::-1])]
    assert len(w.chunks) < 40 and len(w.letters) < 40


def naive_best_two_fit(lengths, capacity):
    """The rule word for word, on a plain list."""
    stock, bins = sorted(lengths, reverse=True), []
    while stock:
        held = []
        while fits := [n for n in stock if n <= capacity - sum(held)]:
            held.append(fits[0])
            stock.remove(fits[0])
        while True:
            small = min(held)
            room = capacity - sum(held) + small
            pairs = [(x + y, x, y) for i, x in enumerate(stock) for y in stock[i + 1 :] if small < x + y <= room]
            if not pairs:
                break
            _, x, y = max(pairs)
            held.remove(small)
            stock.remove(x)
            stock.remove(y)
            held += [x, y]
            stock = sorted([*stock, small], reverse=True)
        bins.append(sorted(held, reverse=True))
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_equals_the_naive_rule(lengths):
    assert packing.best_two_fit(np.array(lengths, int), 30) == naive_best_two_fit(lengths, 30)


def test_pieces_and_places(spark):
    texts = [(1, "hello world"), (2, None), (3, "a b c d e f g h i j " * 700), (3, "a b c d e f g h i j " * 700), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    rows = packing.packed(df, PATH).collect()
    t = Tokenizer.from_file(PATH)
    for doc, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: (r.piece, r.sequence_id))
        many = 2 if doc == 3 else 1
        assert len(mine) == many * -(-len(ids) // 4096)
        for r in mine:
            cut = ids[r.start : r.start + 4096]
            assert (r.length, r.ids_crc32, r.start) == (len(cut), zlib.crc32(cut.tobytes()), 4096 * r.piece)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, "some words " * i) for i in range(30)], "doc_id long, text string")
    pieces = Tables(spark).write("ids", packing.tokenised(df, PATH, 64, keep_ids=True))
    placed = packing.pack(pieces, 64)
    got = {r.sequence_id: bytes(r.ids) for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert got[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_bins(lengths):
    bins = packing.best_two_fit(np.array(lengths, int), 50)
    assert sorted(sum(bins, [])) == sorted(lengths) and all(0 < sum(b) <= 50 for b in bins)


def test_few_bins():
    r = random.Random(0)
    lengths = [min(4096, int(r.lognormvariate(6.5, 1)) + 1) for _ in range(20_000)]
    assert len(packing.best_two_fit(np.array(lengths), 4096)) <= -(-sum(lengths) // 4096) + 2


def test_pair_replaces_the_smallest():
    assert sorted(packing.best_two_fit(np.array([6, 3, 2, 2]), 10)[0]) == [2, 2, 6]


def test_what_is_known_of_words_is_small():
    """A worker remembers 100,000 chunks in a few MB of arrays; numbers are found again, others are not."""
    from mnemosa.llm.tokens import Known

    rng, known, of = np.random.default_rng(4), Known(), {}
    assert known.find(np.array([0, 7], np.uint64)).tolist() == [-1, -1]
    for _ in range(5):
        keys = np.unique(rng.integers(0, 1 << 64, 300, np.uint64))
        keys = keys[known.find(keys) < 0]
        known.add(keys, np.arange(len(of), len(of) + len(keys)))
        of.update(zip(keys.tolist(), range(len(of), len(of) + len(keys)), strict=True))
    asked = np.concatenate([rng.permutation(list(of)).astype(np.uint64), rng.integers(0, 1 << 64, 100, np.uint64)])
    assert known.find(asked).tolist() == [of.get(k, -1) for k in asked.tolist()] and len(known) == len(of)
    w = WordIds(PATH)
    w.packed(pa.array([" ".join(f"x{i:x}y" for i in range(n, n + 10_000)) for n in range(0, 100_000, 10_000)]))
    assert len(w.chunks) == 100_000 and w.chunks.keys.nbytes + w.chunks.numbers.nbytes == 1_600_000
