"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Each of BUCKETS word buckets has a fixed sparse index vector of +1 and -1.  One
pass over all documents adds to every bucket the index vectors of the words
around its occurrences (SPAN either side); the sums of all tasks are added by
bucket, which takes BUCKETS rows a task whatever its input.  A document is the
mean and the deviation of its words' vectors, scaled to unit length, and the size
of the steps from each word's vector to the next (none where words repeat).  A network
of one hidden layer, trained in numpy on at most `most` labelled documents, gives
the logit; a temperature and an offset fitted on a fifth of them, kept out of
training, calibrate it.

Words are runs of letters, digits or other signs, as they stand.

Defined cases: null text counts as empty; a document without a word is the zero
vector; labels that are null, held out, or without a document are not learnt
from; with one kind of label or none every score is the share of label 1 (0
without labels).  Repeated rows get a result each; an empty table gives no rows.
Other columns of documents are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables
from .textkit import U64, Tokens, constants, held_out, pieces

BUCKETS, SIZE, NONZERO, SPAN, HIDDEN = 1 << 14, 32, 4, 2, 24
MOST_ROWS, THRESHOLD = 8000, 0.3


def index_vectors() -> np.ndarray:
    """Of every bucket: NONZERO places with +1 or -1."""
    draw = constants(BUCKETS * NONZERO, 31).reshape(BUCKETS, NONZERO)
    out = np.zeros((BUCKETS, SIZE), np.int8)
    for k in range(NONZERO):
        place = (draw[:, k] % U64(SIZE // NONZERO)).astype(np.int64) * NONZERO + k
        out[np.arange(BUCKETS), place] = np.where(draw[:, k] >> U64(63), 1, -1)
    return out


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and the rows' bounds."""
    tokens = Tokens(column)
    return (tokens.hashes() >> U64(64 - BUCKETS.bit_length() + 1)).astype(np.uint16), tokens.bounds


def contexts(words: np.ndarray, bounds: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Add to total the index vectors of the neighbours of each word in its row."""
    count = np.diff(bounds)
    place = np.arange(len(words)) + SPAN * (1 + np.repeat(np.arange(len(count)), count))
    padded = np.zeros((len(words) + SPAN * (len(count) + 1), SIZE), np.int8)
    padded[place] = index[words]
    around = sum(padded[place + k] for k in range(-SPAN, SPAN + 1) if k)
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    first = np.flatnonzero(np.append(True, sorted_words[1:] != sorted_words[:-1])) if len(words) else np.zeros(0, np.int64)
    if len(first):
        total[sorted_words[first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)


def context_table(docs: DataFrame) -> np.ndarray:
    """The context vectors of all buckets over all documents, scaled to unit length."""
    size = SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((BUCKETS, SIZE), np.int64)
        for whole in batches:
            for batch in pieces(whole):
                contexts(*buckets(batch.column("text")), index, total)
        used = np.flatnonzero(total.any(1))
        yield pa.record_batch([pa.array(used, pa.int32()), *(pa.array(total[used, k]) for k in range(SIZE))], ["bucket", *(f"v{k}" for k in range(SIZE))])

    parts = docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"v{k} long" for k in range(size)))
    rows = parts.groupBy("bucket").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(size))).toPandas()
    out = np.zeros((BUCKETS, SIZE), np.float32)
    out[rows["bucket"].to_numpy(np.int64)] = rows[[f"v{k}" for k in range(size)]].to_numpy(np.float64)
    return out / np.maximum(1e-6, np.linalg.norm(out, axis=1, keepdims=True))


def pooled(words: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean, deviation and step from word to word of the vectors of each row's words."""
    count = np.diff(bounds)
    out = np.zeros((len(count), 3 * SIZE), np.float32)
    full = np.flatnonzero(count)
    if len(full):
        x = table[words]
        n = count[full, None]
        mean = np.add.reduceat(x, bounds[:-1][full], axis=0) / n
        square = np.add.reduceat(x * x, bounds[:-1][full], axis=0) / n
        steps = np.diff(x, axis=0, prepend=x[:1])
        steps[bounds[:-1][full]] = 0
        step = np.add.reduceat(steps * steps, bounds[:-1][full], axis=0) / n
        out[full] = np.concatenate([mean, np.sqrt(np.maximum(0, square - mean * mean)), np.sqrt(step)], 1)
    return out


class Network:
    """A hidden layer of HIDDEN units over scaled inputs; temperature and offset come after the logit."""

    def __init__(self, share: float):
        self.share, self.p, self.temperature, self.offset = share, None, 1.0, 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.p
        return np.tanh(((x - p["mean"]) / p["scale"]) @ p["W"] + p["b"]) @ p["v"] + p["c"]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.p is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.offset, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5, passes: int = 120) -> Network:
    y = np.asarray(y, float)
    net = Network(float(y.mean()) if len(y) else 0.0)
    if len(set(y.tolist())) < 2 or min(y.sum(), (1 - y).sum()) < 8:
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    kept, used = order[: len(y) // 5], order[len(y) // 5 :]
    p = {"mean": x[used].mean(0), "scale": x[used].std(0) + 1e-4, "W": rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), "b": np.zeros(HIDDEN), "v": rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), "c": np.zeros(1)}
    z = (x - p["mean"]) / p["scale"]
    learnt = ("W", "b", "v", "c")
    moment, step = {k: [0.0, 0.0] for k in learnt}, 0
    for _ in range(passes):
        rng.shuffle(used)
        for i in range(0, len(used), 256):
            at = used[i : i + 256]
            h = np.tanh(z[at] @ p["W"] + p["b"])
            d = (1 / (1 + np.exp(-np.clip(h @ p["v"] + p["c"], -30, 30))) - y[at]) / len(at)
            back = d[:, None] * p["v"] * (1 - h * h)
            g = {"W": z[at].T @ back + 1e-4 * p["W"], "b": back.sum(0), "v": h.T @ d + 1e-4 * p["v"], "c": d.sum(keepdims=True)}
            step += 1
            for k in learnt:
                m = moment[k]
                m[0] = 0.9 * m[0] + 0.1 * g[k]
                m[1] = 0.999 * m[1] + 0.001 * g[k] * g[k]
                p[k] = p[k] - 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    net.p = p
    t = np.array([1.0, 0.0])
    raw = np.stack([net.logits(x[kept]), np.ones(len(kept))], 1)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(raw @ t, -30, 30)))
        s = q * (1 - q) + 1e-6
        t = t + np.linalg.solve((raw * s[:, None]).T @ raw + np.eye(2), raw.T @ (y[kept] - q) - (t - [1.0, 0.0]))
    net.temperature, net.offset = 1 / max(0.05, float(t[0])), float(t[1])
    return net


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", held: tuple[int, int] = (5, 0), threshold: float = THRESHOLD, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; learns from at most `most` labels picked by a hash of doc_id."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(context_table(docs))  # BUCKETS x SIZE numbers

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                x = pooled(*buckets(batch.column("text")), table.value)
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "held_out", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(*held).alias("held_out"), "text")
    vectors = Tables(spark).write("vectors", rows.mapInArrow(pool, "doc_id long, held_out boolean, x binary"))
    picked = labels.where(F.col(label).isNotNull() & ~held_out(*held)).select("doc_id", F.col(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    known: pd.DataFrame = vectors.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas().sort_values(["doc_id", "x"])
    array = lambda xs: np.frombuffer(b"".join(xs), np.float32).reshape(-1, 3 * SIZE)
    net = train(array(known["x"]), known["y"].to_numpy())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = net(array(batch.column("x").to_pylist()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(value.astype(float)), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return vectors.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")
