"""Vectors as Columns: quantised forms and similarities."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two."""
    return total(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: F.coalesce(z["x"] * z["y"], F.lit(0.0))))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0.0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / size).otherwise(0.0)


def scale_of(v: Column) -> Column:
    most = F.array_max(F.transform(v, F.abs))
    return F.when(most > 0, most).otherwise(1.0)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once a row, where use has it in a function of each component."""
    return F.element_at(F.transform(F.array(value), use), 1)


def quantize_int8(v: Column, scale: Column) -> Column:
    """Half-even rounding of x / scale * 127 within +-127."""
    return _once(scale, lambda s: F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x / s * 127).cast("int")))))


def dequantize_int8(q: Column, scale: Column) -> Column:
    return _once(scale, lambda s: F.transform(q, lambda x: x / F.lit(127.0) * s))


def sign_bits(v: Column) -> Column:
    """1 where x >= 0, first component first, as a string of 0 and 1."""
    return F.array_join(F.transform(v, lambda x: F.when(x >= 0, "1").otherwise("0")), "")


def pack_bits(v: Column) -> Column:
    """Sign bits as bytes, most significant first, zero-padded."""
    bits = sign_bits(v)
    padded = F.rpad(bits, ((F.ceil(F.length(bits) / 8)) * 8).cast("int"), F.lit("0"))
    nibbles = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(padded) / 4).cast("int") - 1)), lambda i: F.conv(F.substring(padded, i * 4 + 1, F.lit(4)), 2, 16))
    return F.unhex(F.array_join(nibbles, ""))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of 0 and 1."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def truncate_renorm(v: Column, dim: int) -> Column:
    """The first dim components at unit length; unchanged if dim is none or not less than the size."""
    if dim <= 0:
        return v
    head = F.slice(v, 1, dim)
    size = norm(head)
    cut = _once(size, lambda s: F.when(s > 0, F.transform(head, lambda x: x / s)).otherwise(head))
    return F.when(F.size(v) <= dim, v).otherwise(cut)


_token = re.compile("[a-z0-9]+")
#: Words whose places a task remembers, about.
MOST_KNOWN = 1 << 17
#: Texts are taken apart so many characters at a time, or one by one.
PIECE = 1 << 20


def pieces(texts: list[str], most: int = PIECE) -> Iterator[list[str]]:
    """Runs of texts of at most so many characters; a longer one is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def hash_embed(text: Column, dim: int = 256) -> Column:
    """Signed feature hashing of the words of a text, two places each, at unit length."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        places, signs = np.zeros((0, 2), np.int64), np.zeros((0, 2))
        for whole in batches:
            done = []
            for texts in pieces([t or "" for t in whole]):
                words = [_token.findall(t.lower()) for t in texts]
                if len(known) > MOST_KNOWN:
                    known, places, signs = {}, places[:0], signs[:0]
                new = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in known]
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                digests = np.frombuffer(b"".join(hashlib.blake2b(f"{h}:{w}".encode(), digest_size=8).digest() for w in new for h in (0, 1)), np.uint8).reshape(-1, 2, 8)
                if new:
                    places = np.concatenate([places, digests[:, :, :4].copy().view(">u4")[:, :, 0].astype(np.int64) % dim])
                    signs = np.concatenate([signs, np.where(digests[:, :, 4] & 1, 1.0, -1.0)])
                ids = np.fromiter((known[w] for ws in words for w in ws), np.int64)
                row = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
                v = np.bincount((row[:, None] * dim + places[ids]).ravel(), signs[ids].ravel(), len(words) * dim).reshape(len(words), dim)
                size = np.sqrt((v * v).sum(1, keepdims=True))
                done += list(v / np.where(size > 0, size, 1))
            yield pd.Series(done, dtype=object)

    return embed(text)


def hash_embed_md5(text: Column, dim: int = 64) -> Column:
    """The same shape of embedding from MD5, in built-in functions only; one place a word, not scaled."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    place = lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % dim
    sign = lambda t: F.when(F.conv(F.substring(F.md5(t), 7, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    pairs = F.transform(tokens, lambda t: F.struct(place(t).alias("i"), sign(t).alias("s")))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.aggregate(F.filter(pairs, lambda p: p["i"] == k), F.lit(0), lambda a, p: a + p["s"]))
