"""Hard-negative mining: ball trees bound every score from above and below.

Scores are inner products of vectors with integer components, so that ties are
ties everywhere.  Each anchor has its first `positives` rows of the same label;
each of those opens a window of scores, from `low` to 100 per cent of its own, in
which the first `negatives` rows of other labels are wanted.

Each task makes a ball tree of the rows it has read (a batch at a time, MOST_ROWS
at most, whatever their labels) and sends all queries of a block down together: a
node with centre c and radius r holds no score outside a.c - |a|r and a.c + |a|r.
A query leaves a node whose bounds lie outside its window, whose upper bound is
strictly beneath its current kth score, or whose labels it can't use.  The k best
are carried from batch to batch, so a task sends k rows a query at most, and they
are merged by a ranking that Spark cuts to k in the tasks as well.  Rows never move,
and a label that holds a third of them is no group of its own.

Anchors are dealt into blocks of about ANCHORS; a block's vectors (ANCHORS vectors)
are what is broadcast, for its positives and then for its windows, and its result
is added to the written table before the next begins.

Defined cases: rows with a null label, vector or component, or a component that is
not finite, take no part; nor do rows with a component beyond +-MOST_COMPONENT, whose
scores would leave 64 bits.  Rows of another dimension than the anchor's are no
partners of it.  Rows with a null vec_id can be negatives or positives and come
last among equal scores; rows with the anchor's own vec_id are not its positives;
an anchor that is there twice is mined twice.  An anchor without positives, or a
positive whose window is empty, has no rows.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Tables, fresh

SCALE, MOST_COMPONENT = 256, 1 << 17
POSITIVES, NEGATIVES, LOW, WHOLE = 5, 5, 80, 100
ANCHORS, MOST_ROWS, LEAF, TOGETHER, UNEVEN = 1 << 14, 1 << 13, 64, 1 << 12, 16
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "query long, id long, score long"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, x (doubles): the rows that take part."""
    sound = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <= {})".format(MOST_COMPONENT)
    at = rows.where(f"label IS NOT NULL AND embedding IS NOT NULL AND {sound}")
    return at.selectExpr("cast(vec_id as bigint) vec_id", "cast(label as int) label", "cast(embedding as array<double>) x")


def relabelled(rows: DataFrame) -> DataFrame:
    """The contract's labels: one further where vec_id is divisible by 7."""
    return rows.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").cast("int"))


class Best:
    """The k best (score, id) of each query, by score downwards, then id upwards; MOST as an id stands for null."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id = np.full((queries, k), LEAST), np.full((queries, k), MOST)
        self.held = np.zeros((queries, k), bool)

    def kth(self) -> np.ndarray:
        """The score that a row has to reach at least."""
        return np.where(self.held[:, -1], self.score[:, -1], LEAST)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """Rows with these ids have these scores (queries x rows) for the queries q, where ok."""
        wanted = (ok & (score >= self.kth()[q][:, None])).any(1)
        if not wanted.any():
            return
        q, score, ok = q[wanted], score[wanted], ok[wanted]
        score = np.concatenate([self.score[q], np.where(ok, score, LEAST)], 1)
        id_ = np.concatenate([self.id[q], np.broadcast_to(ids, ok.shape)], 1)
        held = np.concatenate([self.held[q], ok], 1)
        order = np.lexsort((id_, ~score, ~held), axis=-1)[:, : self.k]
        for mine, new in ((self.score, score), (self.id, id_), (self.held, held)):
            mine[q] = np.take_along_axis(new, order, 1)


@dataclass
class Queries:
    """Anchors of one dimension, each with its label, id and window of scores; `same`: rows of the label are wanted, or the others."""

    x: np.ndarray  # queries x dimension, integers held as doubles
    label: np.ndarray
    id: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool

    def __post_init__(self):
        self.norm = np.sqrt((self.x**2).sum(1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class BallTree:
    """Rows cut in two again and again, by the nearer of two far rows or, where a side would have under 1/UNEVEN, in halves; down to LEAF rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, int]] = []  # first, end, left, right
        centres, radii, todo = [], [], [(0, len(x), -1, 0)]
        while todo:
            first, end, parent, side = todo.pop()
            here, k = x[order[first:end]], len(self.nodes)
            self.nodes.append((first, end, -1, -1))
            if parent >= 0:
                f, e, left, right = self.nodes[parent]
                self.nodes[parent] = (f, e, k, right) if side == 0 else (f, e, left, k)
            centre = here.mean(0)
            off = np.sqrt(((here - centre) ** 2).sum(1))
            centres.append(centre)
            radii.append(off.max())
            if end - first > LEAF and radii[-1] > 0:
                one = here[off.argmax()]
                other = here[((here - one) ** 2).sum(1).argmax()]
                along = here @ (other - one)
                nearer_one = int((along < (one + other) @ (other - one) / 2).sum())
                cut = nearer_one if min(nearer_one, end - first - nearer_one) * UNEVEN >= end - first else (end - first) // 2
                order[first:end] = order[first:end][np.argpartition(along, cut)]
                todo += [(first + cut, end, k, 1), (first, first + cut, k, 0)]
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.is_leaf = np.array([left < 0 for _, _, left, _ in self.nodes])
        self.low_label = np.array([self.labels[f:e].min() for f, e, *_ in self.nodes])
        self.high_label = np.array([self.labels[f:e].max() for f, e, *_ in self.nodes])

    def search(self, asked: Queries, at: np.ndarray, best: Best) -> tuple[int, int]:
        """Add this tree's rows to best, where asked's queries are the rows `at`; the scores worked out, and all there are."""
        done = sum(self._search(asked, at, best, np.arange(f, min(f + TOGETHER, len(at)))) for f in range(0, len(at), TOGETHER))
        return done, len(at) * len(self.x)

    def _search(self, asked: Queries, at: np.ndarray, best: Best, every: np.ndarray) -> int:
        leaves = np.flatnonzero(self.is_leaf)
        # each query's most promising leaf comes first, so that its kth score soon cuts the others
        nearest = leaves[np.minimum(asked.x[every] @ self.centre[leaves].T, asked.high[every][:, None]).argmax(1)]
        done = sum(self._leaf(n, asked, every[nearest == n], at, best) for n in np.unique(nearest))
        todo = [(0, every)]
        while todo:
            node, q = todo.pop()
            if self.is_leaf[node]:
                q = q[nearest[q - every[0]] != node]
            q = q[self._open(node, asked, q, best.kth()[at[q]])]
            if not len(q):
                continue
            _, _, left, right = self.nodes[node]
            if self.is_leaf[node]:
                done += self._leaf(node, asked, q, at, best)
            else:
                nearer = (asked.x[q] @ (self.centre[left] - self.centre[right])).sum() > 0
                todo += [(right, q), (left, q)] if nearer else [(left, q), (right, q)]
        return done

    def _leaf(self, node: int, asked: Queries, q: np.ndarray, at: np.ndarray, best: Best) -> int:
        first, end, done = *self.nodes[node][:2], 0
        for f in range(first, end, LEAF):  # more than LEAF rows only where all are equal
            e = min(f + LEAF, end)
            score = _products(asked.x[q], self.x[f:e])
            done += score.size
            same = self.labels[f:e] == asked.label[q][:, None]
            ok = same & (self.ids[f:e] != asked.id[q][:, None]) if asked.same else ~same
            ok &= (score >= asked.low[q][:, None]) & (score <= asked.high[q][:, None])
            best.add(at[q], score, self.ids[f:e], ok)
        return done

    def _open(self, node: int, asked: Queries, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        middle, reach = asked.x[q] @ self.centre[node], asked.norm[q] * self.radius[node]
        slack = 0.5 + 1e-9 * (np.abs(middle) + reach)  # of floating point; scores are integers
        upper, lower = middle + reach + slack, middle - reach - slack
        low, high = self.low_label[node], self.high_label[node]
        label = asked.label[q]
        usable = (label >= low) & (label <= high) if asked.same else ~((label == low) & (label == high))
        return usable & (upper >= asked.low[q]) & (lower <= asked.high[q]) & (upper >= kth)


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors of the batch's rows, once for each dimension."""
    vectors = batch.column("x")
    size, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    ids = batch.column("vec_id").fill_null(MOST).to_numpy(zero_copy_only=False)
    labels = batch.column("label").to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        x = flat[start[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0))
        yield ids[rows], labels[rows], np.floor(SCALE * x.astype(np.float64))


def _search(rows: DataFrame, groups: list[tuple[np.ndarray, Queries]], n: int, k: int) -> DataFrame:
    """query, id, score, place: the k best rows of each of n queries; groups holds their places and themselves by dimension."""
    shared = rows.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n, k)
        for whole in batches:
            for f in range(0, whole.num_rows, MOST_ROWS):
                for ids, labels, x in _matrix(whole.slice(f, MOST_ROWS)):
                    for at, asked in shared.value:
                        if asked.x.shape[1] == x.shape[1]:
                            BallTree(x, ids, labels).search(asked, at, best)
        query = np.repeat(np.arange(n), best.held.sum(1))
        ids = best.id[best.held]
        yield pa.record_batch([pa.array(query), pa.array(ids, mask=ids == MOST), pa.array(best.score[best.held])], ["query", "id", "score"])

    found = rows.mapInArrow(run, FOUND)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _grouped(x: list[np.ndarray], label: np.ndarray, id_: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> list[tuple[np.ndarray, Queries]]:
    size = np.array([len(v) for v in x], np.int64)
    at = {d: np.flatnonzero(size == d) for d in np.unique(size)}
    return [(w, Queries(np.array([x[i] for i in w]).reshape(len(w), d), label[w], id_[w], low[w], high[w], same)) for d, w in at.items()]


def mine(rows: DataFrame, is_anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows has vec_id, label, x; is_anchor is a condition on vec_id."""
    spark = rows.sparkSession
    tables = Tables(spark)
    anchors = rows.where(is_anchor)
    blocks = -(-anchors.count() // ANCHORS)
    out = fresh(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    if blocks:
        anchors = tables.write("anchors", anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "x", F.monotonically_increasing_id()), F.lit(blocks))))
    for b in range(blocks):
        block = anchors.where(F.col("block") == b).toArrow()
        id_, label = (block.column(c).to_numpy() for c in ("vec_id", "label"))
        x = [np.floor(SCALE * np.array(v, np.float64)) for v in block.column("x").to_pylist()]
        every = np.full(len(x), LEAST), np.full(len(x), MOST)
        found = _search(rows, _grouped(x, label, id_, *every, True), len(x), positives).toArrow()
        q, score = found.column("query").to_numpy(), found.column("score").to_numpy()
        # low * positive <= 100 * negative <= 100 * positive, as whole numbers
        least = np.array([-(-low * int(s) // WHOLE) for s in score], np.int64)
        if not len(q):
            continue
        asked = _grouped([x[i] for i in q], label[q], id_[q], least, score, False)
        pairs = pa.table({"query": np.arange(len(q)), "anchor_id": id_[q], "positive_id": found.column("id"), "positive_score": score})
        near = _search(rows, asked, len(q), negatives).join(spark.createDataFrame(pairs), "query")
        near = near.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        near.write.mode("append").parquet(out)
    tables.drop("anchors")
    return spark.read.schema(schema).parquet(out)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The contract's anchors, labels and windows."""
    return mine(relabelled(usable(embeddings)), "vec_id % 100 = 0")


SQL = rf"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) > {MOST_COMPONENT})) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND len(a.x) = len(b.x)),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST) AS place FROM s WHERE same AND id IS DISTINCT FROM anchor_id),
n AS (SELECT p.r, p.place, p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.id NULLS LAST) AS rank
  FROM p JOIN s ON p.r = s.r AND p.place <= {POSITIVES} AND NOT s.same AND {LOW} * p.score <= {WHOLE} * s.score AND {WHOLE} * s.score <= {WHOLE} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
