"""Near-duplicate documents by min-max hashing.

One pass over the texts gives each document its set of distinct word shingles,
a 128-bit digest of that set, and a signature: under each of 64 permutations
both the smallest and the largest image, so 128 values for 64 hash evaluations.
Minimum and maximum agree, each with the Jaccard similarity as probability and
all but independently, so a band of four values (two permutations) is met with
probability J^4.  With 32 bands a pair at J = 0.75 is missed with probability
(1 - 0.75^4)^32 = 5e-6, and at J = 0.8 with 5e-8.

Equal sets are one node from the digest on.  Links between nodes come in two
steps, both confirmed on whole sets:

* in every bucket (band value) that has two nodes or more, each member against
  one representative, picked by a hash that differs from band to band;
* where a bucket still holds nodes of different components, all pairs of its
  nodes in different components, in blocks of 256 x 256 that any number of tasks
  share.  A block compares signatures first; the sets of a pair are compared if
  55% of the 128 values agree (4.6 standard deviations below 0.75).  Only links
  that join components within the block leave it.

So a group of copies costs rows in proportion to its size, no pair is listed
before it is confirmed, and none within a component.  Aggregates are written
before they are joined with the rows they were made of, as a join can be split
within a hot key only where both of its sides come straight from a shuffle.

Defined cases: null or wordless text is an empty set, linked with nothing;
fewer than five words are one shingle, the whole sequence; repeated rows are
linked like any equal texts, and each gets its result row; a null doc_id takes
part, gets its component's smallest id (null if there is none) and is kept only
if there is none.  An empty table gives no rows.  Other columns are not read.
Nodes are known by 64 bits of the digest: at 10^9 distinct sets the chance that
any two clash is 3%.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Tables
from .textkit import U64, Words, constants, mix, pieces, signed, windows

WIDTH, PERMUTATIONS, BANDS, PERCENT, BLOCK, LEAST_AGREEING = 5, 64, 32, 75, 256, 70
ROWS = 2 * PERMUTATIONS // BANDS
_FACTORS = (constants(PERMUTATIONS, 11) >> U64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (constants(PERMUTATIONS, 12) >> U64(32)).astype(np.uint32)
_BAND = constants(BANDS * ROWS, 13).reshape(BANDS, ROWS)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles; letters A-Z count as a-z."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    runs = windows(hashes, width)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield mix(windows(hashes[a:b], b - a) + U64(b - a))
        else:
            yield np.zeros(0, U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side."""
    images = (shingles >> U64(32)).astype(np.uint32)[:, None] * _FACTORS
    images += _SHIFTS
    return np.stack([images.min(0), images.max(0)], 1).ravel()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            n, node, check, sig = [], [], [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                m = mix(s)
                node.append(int(mix(m.sum(keepdims=True) + U64(len(s)))[0]) if len(s) else 0)
                check.append(int(mix(m ^ U64(0xA5A5A5A5A5A5A5A5)).sum()))
                sig.append(signature(s).tobytes() if len(s) else None)
            as_long = lambda x: pa.array(np.array(x, U64).view(np.int64))
            kept = [c for c in ("doc_id", "row_key") if c in batch.schema.names]
            yield pa.record_batch([*map(batch.column, kept), pa.array(n, pa.int64()), as_long(node), as_long(check), pa.array(sig, pa.binary())], [*kept, "n_shingles", "node", "digest", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
        keys = mix((mix(sig.astype(U64) + _BAND) * (_BAND | U64(1))).sum(2) + _BAND[:, 0])
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)
        band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
        for i in range(0, len(node), 1 << 16):
            cut = slice(i, i + (1 << 16))
            yield pa.record_batch([pa.array(signed(keys.ravel()[cut])), pa.array(band[cut]), pa.array(node[cut])], ["key", "band", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            node, sets = [], []
            for want, s in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                if len(s) and int(mix(mix(s).sum(keepdims=True) + U64(len(s))).view(np.int64)[0]) == want:
                    node.append(want)
                    sets.append(s.tobytes())
            yield pa.record_batch([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])


def _own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            sets = [s for s in shingle_sets(batch.column("text")) if len(s)]
            node = [int(mix(mix(s).sum(keepdims=True) + U64(len(s))).view(np.int64)[0]) for s in sets]
            yield pa.record_batch([pa.array(node, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether `percent` per cent of the union of two sorted sets is common to both."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), percent) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys; the rows come sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        same = held and all(held[-1].column(k)[held[-1].num_rows - 1].as_py() == c[0] for k, c in zip(keys, cols, strict=True))
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _links(percent: int):
    """Confirmed links between components, from blocks of nodes of one bucket: at most one less than the components in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "i", "j"]):
            node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
            _, part = np.unique(group.column("label").to_numpy(), return_inverse=True)
            block, rep, band = group.column("block").to_numpy(), group.column("rep")[0].as_py(), group.column("band")[0].as_py()
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(len(node), -1)
            sets = [np.frombuffer(x.as_buffer(), U64) for x in group.column("set")]
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            a, b = [], []
            for x in left.tolist():
                y = right[(right > x) if i == j else slice(None)]
                y = y[(part[y] != part[x]) & (node[y] != rep) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
                if node[x] == rep or not len(y):
                    continue
                agree = sig[y] == sig[x]
                y = y[(agree.sum(1) >= LEAST_AGREEING) & (agree.reshape(len(y), BANDS, ROWS).all(2).argmax(1) == band)]
                for k in y.tolist():
                    if part[k] != part[x] and alike(sets[x], sets[k], percent):
                        a.append(int(node[x]))
                        b.append(int(node[k]))
                        part[part == part[k]] = part[x]
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with exactly one row of each component, of the smallest doc_id, null last; wordless rows all stay."""
    t = Tables(docs.sparkSession)
    keyed = t.write("keyed", docs.withColumn("row_key", F.monotonically_increasing_id()))
    judged = near_duplicates(keyed, keyed=True)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))["row_key"].alias("row_key")
    kept = judged.where("label is not null").groupBy("label").agg(least).select("row_key").unionByName(judged.where("label is null").select("row_key"))
    return keyed.join(kept, "row_key", "left_semi").select(*docs.columns)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id LONG, text STRING).

    If keyed, row_key (LONG) of docs and label too: equal within a component and
    in no other, null for rows without words.

    Two documents are linked if `percent` per cent of the union of their shingle
    sets is common to both; percent of 75 or more has the recall stated above.
    """
    spark = docs.sparkSession
    t = Tables(spark)
    key = ["row_key"] if keyed else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, "text")
    docs = rows.select("doc_id", "text")
    found = t.write("features", rows.mapInArrow(_features, f"doc_id long, {'row_key long, ' * keyed}n_shingles long, node long, digest long, sig binary"))
    nodes = t.write("nodes", found.where("n_shingles > 0").groupBy("node", "digest").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    bands = nodes.select("node", "sig").mapInArrow(_bands, "key long, band int, node long")
    spread = F.struct(F.xxhash64("node", "band").alias("h"), F.col("node").alias("rep"))
    buckets = t.write("representatives", bands.groupBy("key").agg(F.count("*").alias("k"), F.min(spread)["rep"].alias("rep")).where("k > 1"))
    shared = t.write("buckets", bands.join(buckets, "key"))
    wanted = shared.select("node").distinct().join(nodes.select("node", "first_id"), "node")
    named = docs.join(wanted.where("first_id is not null").withColumnRenamed("first_id", "doc_id"), "doc_id").mapInArrow(_sets, "node long, set binary")
    unnamed = docs.where("doc_id is null").mapInArrow(_own_sets, "node long, set binary").join(wanted.where("first_id is null").select("node"), "node", "left_semi")
    sets = t.write("sets", named.unionByName(unnamed.groupBy("node").agg(F.first("set").alias("set"))))

    def confirmed(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        sides = ordered.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
        return sides.mapInArrow(_similar(percent), "a long, b long")

    star = t.write("star", confirmed(shared.where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))))
    label = components(t, star, "first")
    at = shared.where("k > 2").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = at.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    blocks = F.ceil(F.col("k") / F.lit(BLOCK)).cast("int")
    rows = at.join(apart, "key").join(nodes.select("node", "n", "sig"), "node").join(sets, "node").withColumn("blocks", blocks).withColumn("block", F.expr("cast(pmod(xxhash64(node, 7), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.select("key", "i", "j", "band", "rep", "block", "node", "label", "n", "sig", "set").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rest = t.write("rest", rows.mapInArrow(_links(percent), "a long, b long"))
    joined = star.unionByName(rest)
    label = components(t, joined, "all") if not rest.isEmpty() else label
    low = label.join(nodes.select("node", "first_id"), "node").groupBy("label").agg(F.min("first_id").alias("low"))
    names = t.write("names", label.join(low, "label").select("node", "low", *["label"] * keyed))
    part = [F.coalesce("label", "node").alias("label")] * keyed
    of = nodes.select("node", "first_id").join(names, "node", "left").select("node", F.coalesce("low", "first_id").alias("component_id"), *part)
    out = found.select("doc_id", *key, "n_shingles", "node").join(of, "node", "left")
    whole = F.coalesce("component_id", "doc_id")
    t.drop("buckets", "representatives", "sets", "star", "rest", *[p for p in t.paths if p.startswith(("first-", "all-"))])
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.col("doc_id").eqNullSafe(whole).alias("kept"), *key, *["label"] * keyed)


#: All pairs with a common shingle are counted: for small tables.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + {WIDTH - 1}], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {WIDTH - 2}))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN low USING (doc_id)
"""
