"""Packing of tokenised documents into sequences of bounded length by best-two-fit.

A sequence begins with the longest unpacked piece and is filled with the longest
that fits, until none does.  Then its smallest piece is given back if two
unpacked pieces together fit the gap, with the place that it leaves, more
tightly; the pair that leaves least is taken, and this is repeated while it helps.

Lengths are at most the capacity, so the unpacked pieces are counts by length.
The lengths in stock are bits of one integer and, mirrored, of another: the
longest that fits and all pairs of a given sum are a few operations on 512-byte
integers, however many pieces there are.

Pieces are dealt at random into groups of about GROUP, packed independently: a
group holds thousands of sequences and leaves about one of them partly filled.
Only lengths move between tasks, not tokens.

Defined cases: null or empty text has no tokens but the final one; repeated rows
are packed each; null doc_id is kept; texts over the capacity are cut into whole
pieces of the capacity and a shorter last one.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables
from .tokens import WordIds
from .textkit import pieces as runs

CAPACITY, END, GROUP = 4096, 1, 16384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document's ids with `end` after them; `ids` holds them as little-endian unsigned 32-bit numbers on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, most = WordIds.of(tokenizer), np.array([end], "<u4").tobytes(), 4 * capacity
        for whole in batches:
            for batch in runs(whole, most=1 << 20):
                out: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(batch.column("doc_id").to_pylist(), words.packed(batch.column("text")), strict=True):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), most)):
                        cut = ids[at : at + most]
                        for column, value in zip(out, (doc, k, at // 4, len(cut) // 4, zlib.crc32(cut), cut if keep_ids else None), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 5 + keep_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids binary" * keep_ids)


class Stock:
    """Counts of unpacked pieces by length."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        self.count = np.bincount(lengths, minlength=capacity + 1).tolist()
        self.bits = sum(1 << n for n, c in enumerate(self.count) if c)
        self.mirror = sum(1 << capacity - n for n, c in enumerate(self.count) if c)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.bits ^= 1 << n
            self.mirror ^= 1 << self.capacity - n

    def give(self, n: int) -> None:
        if not self.count[n]:
            self.bits ^= 1 << n
            self.mirror ^= 1 << self.capacity - n
        self.count[n] += 1

    def longest(self, room: int) -> int:
        """0 if none fits."""
        return max(0, (self.bits & ((2 << room) - 1)).bit_length() - 1)

    def pair(self, room: int, over: int) -> tuple[int, int] | None:
        """Two lengths of the largest sum up to room that is larger than over."""
        for total in range(room, over, -1):
            both = self.bits & (self.mirror >> self.capacity - total)
            if total % 2 == 0 and self.count[total // 2] == 1:
                both &= ~(1 << total // 2)
            if both:
                long = both.bit_length() - 1
                return long, total - long
        return None


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Lengths of each sequence, in the order in which they stand in it."""
    stock, bins = Stock(lengths, capacity), []
    while stock.bits:
        held, room = [], capacity
        while room and (n := stock.longest(room)):
            stock.take(n)
            held.append(n)
            room -= n
        while room and (two := stock.pair(room + held[-1], held[-1])):
            small = held.pop()
            stock.give(small)
            for n in two:
                stock.take(n)
            held = sorted(held + list(two), reverse=True)
            room = capacity - sum(held)
        bins.append(held)
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset; `pieces` must be read from a written table, of lengths 1 to capacity."""
    groups = max(1, -(-pieces.count() // group))
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", sequence_id long, offset long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        order = np.argsort(lengths, kind="stable")
        places = defaultdict(list)
        for row in order.tolist():
            places[int(lengths[row])].append(row)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, held in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for n in held:
                row = places[n].pop()
                sequence[row], offset[row] = (int(key[0]) << 32) + k, at
                at += n
        return rows.drop(columns="g").assign(sequence_id=sequence, offset=offset)

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("g").applyInPandas(run, schema)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack(Tables(docs.sparkSession).write("pieces", tokenised(docs, tokenizer, capacity, end)), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from pack() of pieces with ids; a group is one sequence, at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"))
