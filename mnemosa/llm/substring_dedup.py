"""Repeated passages by recompression of the corpus's word sequences.

The words are the first symbols.  Each round names runs of one symbol, or pairs of
adjacent symbols of which the first is on the left side and the second on the
right side, as hashes of the symbols, drawn anew each round, say.  A name is a 64-bit
hash of what it stands for, so that all tasks of a Spark stage give the same run or
pair the same name without looking it up.  After the rounds of a level a Spark
aggregation gathers the level's names into a table of all documents, with what
each stands for and how often: if a name stood for two things, the level gets
other hashes and is named again, so the levels above build on names that mean one
thing in the whole corpus.  A round's sequences are not stored; the next one
derives them from the texts by the names that are settled, which costs less disk
than eight bytes a symbol.

Symbols over a round's limit of words stand still, so whether a boundary between
two symbols lasts through a round of limit m depends on m words either side.
After all rounds (limits REACH in sum) equal substrings are cut into equal
symbols but for REACH words at each end.  Symbols have at most eight words (runs
any number), so each window of 35 words holds a whole one at least REACH words
from its ends.

A window of `width` words is represented by its anchor: of those symbols the one
whose hash is smallest (the first of equals).  Equal windows have the same anchor
at the same place.  The stages after the rounds are

1. one row for each anchor and the windows it represents, with a key that names
   the symbol and the REACH words around it, which all these windows contain;
   anchors whose key occurs once represent no repeated window;
2. of the rest, those that agree in the words of all their windows (a 128-bit
   BLAKE2b digest of the words themselves, not of their hashes) repeat whole;
3. where a key stands for different surroundings, one anchor of each kind is
   taken apart into its windows, which are counted by such a digest;
4. repeated windows go back to their documents by document, where the words they
   cover are removed.

Clashes of names or keys can cost work but not results: names only bring
candidates together, and digests of words decide.  A window with no such symbol
(it lies in a run of one word or so) is its own anchor.  Counts have map-side
partial sums, and going back to the rows is a join by key whose heavy side
adaptive execution splits: a passage in a third of all documents costs rows in
proportion to its occurrences and nothing is listed in pairs.  Repeated keys are
written before the join, since a join can only be split where both of its sides
come straight from a shuffle.

Defined cases: null text has no words; texts under `width` words have no window
and keep all words; a repeated row is another document, so all its windows repeat;
rows with a null or repeated doc_id are told apart by their texts (23 bits of a
hash among the rows of one doc_id).  An empty table gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables
from .textkit import U64, Words, constants, mix, pieces, range_hashes, signed

WIDTH = 35
#: Kind and limit of words of each round, by level; a level's names are settled before the next.
LEVELS = ((("run", 1), ("pair", 1)), (("pair", 2),), (("pair", 4),))
REACH = sum(limit for level in LEVELS for _, limit in level)
#: Texts are named in runs of so many bytes, so that a run's names are distinct already.
NAMING_BYTES = 1 << 21
Seeds = list[int]


def _seeds(level: int, seed: int) -> np.ndarray:
    return constants(3 * len(LEVELS[level]), 21 + 100 * level + 10_000 * seed).reshape(-1, 3)


def symbols(words: np.ndarray, row: np.ndarray, seeds: Seeds, new: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after as many levels as there are seeds; symbols don't cross rows.

    new gets (name, first, second) of all runs and pairs of the last level: what a
    name stands for, for a run the symbol and how many.
    """
    name, start, n = words, np.arange(len(words)), len(words)
    for level, drawn in enumerate(seeds):
        for (kind, limit), seed in zip(LEVELS[level], _seeds(level, drawn), strict=True):
            if len(name) < 2:
                break
            short = np.diff(start, append=n) <= limit
            free = short[1:] & short[:-1] & (row[start[1:]] == row[start[:-1]])
            if kind == "run":
                first = np.ones(len(name), bool)
                first[1:] = ~(free & (name[1:] == name[:-1]))
                at = np.flatnonzero(first)
                times = np.diff(at, append=len(name)).astype(U64)
                old, name, start = name[at], name[at], start[at]
                put = np.flatnonzero(times > 1)
                one, two = old[put], times[put]
                made = mix(one * seed[1] + two)
                name[put] = made
            else:
                left = (mix(name ^ seed[0]) >> U64(63)).astype(bool)
                put = np.flatnonzero(free & left[:-1] & ~left[1:])
                one, two = name[put], name[put + 1]
                made = mix(one * seed[1] + mix(two ^ seed[2]))
                name = name.copy()
                name[put] = made
                keep = np.ones(len(name), bool)
                keep[put + 1] = False
                name, start = name[keep], start[keep]
            if new is not None and level == len(seeds) - 1:
                new.append((made, one, two))
    return name, start


def _names(seeds: Seeds):
    """name, low and high of a hash of what it stands for, times: of what the last level names in a run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most=NAMING_BYTES):
                words, new = Words(batch.column("text")), []
                symbols(words.hashes(), words.row_of(), seeds, new)
                if not new:
                    continue
                name, one, two = (np.concatenate(x) for x in zip(*new, strict=True))
                order = np.argsort(name, kind="stable")
                name = name[order]
                meaning = (mix(mix(one[order] + U64(0x2545F491)) + two[order]) >> U64(32)).astype(np.uint32).view(np.int32)
                at = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
                low, high = (f.reduceat(meaning, at) if len(at) else meaning for f in (np.minimum, np.maximum))
                yield pa.record_batch([pa.array(signed(x)) for x in (name[at], low, high, np.diff(at, append=len(name)).astype(np.int32))], ["name", "low", "high", "times"])

    return run


def names(docs: DataFrame, seeds: Seeds) -> DataFrame:
    """name, times, clash of what the last level of seeds names in all of docs (text); a clash is a name of two things."""
    return gathered(docs.select("text").mapInArrow(_names(seeds), "name long, low int, high int, times int"))


def gathered(rows: DataFrame) -> DataFrame:
    """name, times, clash of (name, low and high of a hash of what it stands for, times) from all tasks."""
    return rows.groupBy("name").agg(F.sum("times").alias("times"), (F.min("low") != F.max("high")).alias("clash"))


def settled(t: Tables, docs: DataFrame, seeds_to_try: int = 2) -> Seeds:
    """The seeds of all levels: the first of which no name of the level stands for two things in docs, else the last."""
    seeds: Seeds = []
    for level in range(len(LEVELS)):
        for seed in range(seeds_to_try):
            table = t.write(f"names-{level}", names(docs, [*seeds, seed]).where("times > 1"))
            clear = table.where("clash").isEmpty()
            t.drop(f"names-{level}")
            if clear:
                break
        seeds.append(seed)
    return seeds


def digests(words: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of the words starts to ends, joined by one space, as two columns."""
    size = words.ends - words.starts
    stop = np.cumsum(size + 1)
    text = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    letters = np.ones(len(text), bool)
    letters[stop - 1] = False
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    text[letters] = words.data[np.cumsum(inside[:-1]).astype(bool)]
    data = memoryview(text.tobytes())
    first, last = (stop - size - 1)[starts].tolist(), (stop - 1)[ends - 1].tolist()
    return np.frombuffer(b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(first, last, strict=True)]), np.int64).reshape(-1, 2)


def anchors(hashes: np.ndarray, bounds: np.ndarray, width: int, seeds: Seeds) -> dict[str, np.ndarray]:
    """The anchors of all windows: row, lo and hi (first and last window, counted in the row), key, at (the word where lo begins)."""
    n, counts = len(hashes), np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    name, start = symbols(hashes, row, seeds)
    end = np.append(start[1:], n)
    begin = np.arange(n)
    begin = begin[begin + width <= bounds[1:][row]]
    if not len(begin):
        return {k: np.zeros(0, np.int64) for k in ("row", "lo", "hi", "key", "at")}
    bits = U64(max(24, len(name).bit_length()))
    order = (mix(name ^ U64(0x5851F42D4C957F2D)) >> bits << bits) | np.arange(len(name), dtype=U64)
    tables = [order]
    while 2 << len(tables) - 1 <= width:
        half = 1 << len(tables) - 1
        last = tables[-1]
        tables.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
    at = np.zeros(n + 1, np.int64)
    at[start] = 1
    number = np.cumsum(at)  # symbols that start at or before a word
    first = number[begin + REACH - 1]
    last = number[np.minimum(begin + width - REACH, n)] - 1  # the symbol that starts there or the one that covers that place
    last = np.where((begin + width - REACH == n), len(name), last) - 1
    size = last - first + 1
    least = np.full(len(begin), np.iinfo(np.uint64).max, U64)
    for k, table in enumerate(tables):
        i = np.flatnonzero((size >> k) == 1)
        if len(i):
            least[i] = np.minimum(table[first[i]], table[last[i] - (1 << k) + 1])
    own = size <= 0
    chosen = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    chosen[own] = -1 - begin[own]
    cut = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (row[begin[1:]] != row[begin[:-1]])))
    lo, hi = begin[cut], begin[np.append(cut[1:], len(begin)) - 1]
    symbol = chosen[cut]
    whole = symbol < 0
    symbol[whole] = 0
    left = np.where(whole, lo, start[symbol] - REACH)
    right = np.where(whole, lo + width, end[symbol] + REACH)
    base = bounds[row[lo]]
    return {"row": row[lo], "lo": lo - base, "hi": hi - base, "key": range_hashes(hashes, left, right), "at": lo}


def _keys_of(width: int, seeds: Seeds):
    """The keys of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                words = Words(batch.column("text"))
                yield pa.record_batch([pa.array(signed(anchors(words.hashes(), words.bounds, width, seeds)["key"]), pa.int64())], ["key"])

    return run


def _rows(width: int, seeds: Seeds):
    """The anchors, with digests of the words of all their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                words = Words(batch.column("text"))
                found = anchors(words.hashes(), words.bounds, width, seeds)
                doc, tag = (batch.column(c).to_numpy()[found["row"]] for c in ("doc", "tag"))
                place = (tag.astype(np.int64) << 40) | (found["lo"] << 8) | (found["hi"] - found["lo"])
                words_of = digests(words, found["at"], found["at"] + found["hi"] - found["lo"] + width)
                yield pa.record_batch([pa.array(signed(np.ascontiguousarray(x))) for x in (found["key"], *words_of.T, doc, place)], ["key", "one", "two", "doc", "place"])

    return run


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                words, out = Words(batch.column("text")), []
                for r, taken in enumerate(batch.column("taken").to_pylist()):
                    for x in taken:
                        lo = np.arange(x["lo"], x["hi"] + 1)
                        out.append((np.full(len(lo), r), lo, np.full(len(lo), x["times"])))
                if not out:
                    continue
                r, lo, times = (np.concatenate(x) for x in zip(*out, strict=True))
                at = words.bounds[r] + lo
                one, two = digests(words, at, at + width).T
                doc, tag = (batch.column(c).to_numpy()[r] for c in ("doc", "tag"))
                yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in (one, two, doc, tag.astype(np.int32), lo.astype(np.int64), times.astype(np.int64))], ["one", "two", "doc", "tag", "lo", "times"])

    return run


def keep_words(text: str | None, covered: list, width: int) -> tuple[int, list[bytes]]:
    """The number of words, and the words outside the windows that start at lo to hi for each (lo, hi)."""
    words = (text or "").encode().split()
    kept, at = [], 0
    for lo, hi in sorted((x["lo"], x["hi"]) for x in covered or ()):
        kept += words[at:lo]
        at = max(at, hi + width)
    return len(words), kept + words[at:] if at else words


def _place(df: DataFrame) -> DataFrame:
    """doc and tag tell rows apart, lo and hi are what place holds."""
    lo = F.shiftright("place", 8).bitwiseAND(F.lit((1 << 32) - 1))
    return df.withColumns({"tag": F.shiftright("place", 40).cast("int"), "lo": lo, "hi": lo + F.col("place").bitwiseAND(F.lit(255))})


def _keys(text: Column, doc_id: Column) -> dict[str, Column]:
    h = F.xxhash64(text)
    return {"doc": F.coalesce(doc_id.cast("long"), h), "tag": h.bitwiseAND(F.lit((1 << 23) - 1)).cast("int")}


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc, tag, covered (array of lo, hi: windows that start at lo to hi occur elsewhere too) of documents with any.

    docs has doc, tag and text.  width is 35 to 200 words: a window must hold a
    whole symbol with REACH words either side.
    """
    if not WIDTH <= width <= 200:
        raise ValueError(f"width {width} is outside {WIDTH} to 200")
    t = Tables(docs.sparkSession)
    seeds = settled(t, docs)
    keys = t.write("keys", docs.select("text").mapInArrow(_keys_of(width, seeds), "key long").groupBy("key").count().where("count > 1").select("key"))
    rows = docs.mapInArrow(_rows(width, seeds), "key long, one long, two long, doc long, place long")
    shared = t.write("anchors", rows.join(keys, "key"))
    kinds = t.write("kinds", shared.groupBy("key", "one", "two").agg(F.count("*").alias("times"), F.min(F.struct("doc", "place")).alias("at")))
    several = t.write("several", kinds.groupBy("key").count().where("count > 1").select("key"))
    apart = _place(kinds.join(several, "key").select("times", "at.doc", "at.place"))
    apart = apart.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi", "times")).alias("taken"))
    single = t.write("windows", docs.join(apart, ["doc", "tag"]).mapInArrow(_windows(width), "one long, two long, doc long, tag int, lo long, times long"))
    again = t.write("again", single.groupBy("one", "two").agg(F.sum("times").alias("n")).where("n > 1").select("one", "two"))
    t.drop("keys", "several")
    some = single.where("times = 1").join(again, ["one", "two"]).select("doc", "tag", "lo", F.col("lo").alias("hi"))
    every = _place(shared.join(kinds.where("times > 1").select("key", "one", "two"), ["key", "one", "two"])).select("doc", "tag", "lo", "hi")
    return every.unionByName(some).groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("covered"))


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """row (a struct of the columns of docs but text), text, covered."""
    other = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    keyed = docs.select(other, "text", *(c.alias(k) for k, c in _keys(F.col("text"), F.col("doc_id")).items()))
    return keyed.join(repeated_windows(keyed.select("doc", "tag", "text"), width), ["doc", "tag"], "left").select("row", "text", "covered")


def strip_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the covered words taken out of text; what is left either side of them comes on lines of its own.

    Texts without a repeated window stay as they are; n_chars, if there is such a
    column, follows the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                words, covered, out = Words(batch.column("text")), batch.column("covered").to_pylist(), batch.column("text").to_pylist()
                data = words.data.tobytes()
                for r in [r for r, c in enumerate(covered) if c]:
                    at, end, parts = 0, int(words.bounds[r + 1] - words.bounds[r]), []
                    for lo, hi in [*sorted((x["lo"], x["hi"] + width) for x in covered[r]), (end, end)]:
                        if lo > at:
                            first, last = words.bounds[r] + at, words.bounds[r] + lo - 1
                            parts.append(data[words.starts[first] : words.ends[last]])
                        at = max(at, hi)
                    out[r] = b"\n".join(parts).decode()
                yield pa.record_batch([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])

    marked = _marked(docs, width)
    done = marked.mapInArrow(run, f"row {marked.schema['row'].dataType.simpleString()}, text string")
    value = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*(value.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by one space) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                done = [keep_words(t, c, width) for t, c in zip(batch.column("text").to_pylist(), batch.column("covered").to_pylist(), strict=True)]
                counts = [pa.array(x, pa.int64()) for x in ([n for n, _ in done], [n - len(k) for n, k in done])]
                yield pa.record_batch([batch.column("doc_id"), *counts, pa.array([b" ".join(k).decode() for _, k in done], pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    marked = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    return marked.select("row.doc_id", "text", "covered").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(kept: DataFrame) -> DataFrame:
    """kept_text as its SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, i, md5(array_to_string(ws[i:i + {WIDTH - 1}], ' ')) AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM d WHERE len(ws) >= {WIDTH})),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
covered AS (SELECT DISTINCT r, i + j AS p FROM again, (SELECT unnest(range({WIDTH})) AS j)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d) x ANTI JOIN covered USING (r, p) GROUP BY r),
gone AS (SELECT r, count(*) AS n FROM covered GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
