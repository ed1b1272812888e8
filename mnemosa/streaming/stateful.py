"""Structured Streaming forms of the time-driven operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import text
from ..store import shared_folder


#: A slice of time is so many windows (or times to live) wide; its state is written as one value.
SLICE = 8


class _Attention(StatefulProcessor):
    """Perceptions of some pages in a slice of time and within the window around it, with whether its own were given out."""

    def __init__(self, window: float):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "rows array<struct<project_key:string,page:string,at:double,id:string,own:boolean,copies:int,told:boolean>>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.get()
        held = {tuple(r)[:5]: tuple(r)[5:] for r in known[0]} if known else {}
        more: dict[tuple, int] = {}
        for f in rows:
            for k in zip(f["project_key"], f["page"], f["created_at"].tolist(), f["id"], f["own"].tolist(), strict=True):
                more[k] = more.get(k, 0) + 1
        out = []
        for k, n in more.items():
            copies, told = held.get(k, (0, False))
            held[k] = copies + n, told
            out += [k[3]] * n * (told and k[4])  # more of what was given out
        order = sorted(held, key=lambda k: (k[0] is not None, k[0] or "", *k[1:]))
        for n, k in enumerate(order):
            copies, told = held[k]
            beside = (order[m] for m in (n - 1, n + 1) if 0 <= m < len(order))
            if k[4] and not told and (copies > 1 or any(o[:2] == k[:2] and abs(o[2] - k[2]) <= self.window for o in beside)):
                out += [k[3]] * copies
                held[k] = copies, True
        self.seen.update(([(*k, *v) for k, v in held.items()],))
        width = SLICE * max(self.window, 1.0)
        self.handle.registerTimer(math.ceil(((key[0] + 1) * width + 2 * self.window) * 1000) + 1)
        yield pd.DataFrame({"id": out}, dtype=object)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame({"id": []}, dtype=object)

    def close(self) -> None:
        pass


class _Register(StatefulProcessor):
    """The live perceptions of one project in a slice of time, the times of those within the ttl after it, and tombstones."""

    def __init__(self, ttl: float, capacity: int):
        self.ttl, self.capacity = ttl, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "live array<struct<at:double,id:string,own:boolean,attended:boolean>>, gone array<struct<at:double,id:string>>")

    def _read(self) -> tuple[dict, set]:
        known = self.held.get()
        return ({tuple(r)[:3]: bool(r[3]) for r in known[0]}, {tuple(r) for r in known[1]}) if known else ({}, set())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        live, gone = self._read()
        for f in rows:
            for t, i, own, attended, decayed in zip(f["created_at"].tolist(), f["id"], f["own"].tolist(), f["attended"].tolist(), f["decayed_at"].tolist(), strict=True):
                if decayed is None or decayed != decayed:
                    live[t, i, own] = bool(attended)
                elif own:
                    gone.add((decayed + self.ttl, i))
        yield self._settled(key, live, gone, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settled(key, *self._read(), timerValues.getCurrentWatermarkInMs())

    def _settled(self, key: Any, live: dict, gone: set, now: float) -> pd.DataFrame:
        """What the watermark has made certain: rows that left, and tombstones whose time is over; one timer for what is next."""
        out, coming = [], []
        rows, left = sorted(live), dict(live)
        for n, (t, i, own) in enumerate(rows):
            if not own:
                continue
            full, attended = n + self.capacity, live[t, i, own]
            over = min(t + self.ttl, rows[full][0]) if self.capacity > 0 and full < len(rows) else t + self.ttl
            if not attended and over * 1000 <= now:
                out.append((i, "decayed", over))
                gone.add((over + self.ttl, i))
            leaves = t + self.ttl if attended else over
            if leaves * 1000 <= now:
                del left[t, i, own]
            else:
                coming.append(leaves)
        for t, i in sorted(gone):
            if t * 1000 <= now:
                out.append((i, "purged", t))
                gone.remove((t, i))
            else:
                coming.append(t)
        width = SLICE * max(self.ttl, 1.0)
        end = (key[1] + 1) * width + self.ttl  # until then rows can come that count
        if end * 1000 > now:
            coming.append(end)
        elif not any(own for _, _, own in left):
            left = {}
        if left or gone:
            self.held.update(([(*k, v) for k, v in left.items()], list(gone)))
        else:
            self.held.clear()
        if coming and (left or gone):
            self.handle.registerTimer(math.ceil(min(coming) * 1000))
        texts = {"project_key": [key[0]] * len(out), "id": [x[0] for x in out], "event": [x[1] for x in out]}
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in texts.items()} | {"at": pd.Series([x[2] for x in out], dtype=float)})

    def close(self) -> None:
        pass


def _sliced(rows: DataFrame, width: float, before: float, after: float) -> DataFrame:
    """rows with slice and own: each in its slice of time, and again in those whose end it is within `after` of, or whose start within `before`."""
    at = F.floor(F.col("created_at") / width)
    first, last = F.floor((F.col("created_at") - after) / width), F.floor((F.col("created_at") + before) / width)
    return rows.withColumn("slice", F.explode(F.sequence(first, last))).withColumn("own", F.col("slice") == at)


def _ready(rows: DataFrame, delay: str) -> DataFrame:
    """rows with string ids and a watermark on their time; maps in state need the RocksDB provider, which is set for the session."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = rows.where("created_at is not null and id is not null").withColumns({"id": F.col("id").cast("string"), "created_at": F.col("created_at").cast("double")})
    return timed.withColumn("ts", F.timestamp_seconds("created_at")).withWatermark("ts", delay)


def attention(perceptions: DataFrame, window: float = 300, delay: str = "10 minutes", parts: int = 4) -> DataFrame:
    """id of each perception that is attended: another of its project and page came within the window, before or after it.

    The rows that sensory.attend marks (live, visual, with a URL), whatever the order in
    which they come, if none is later than `delay`.  A state holds the perceptions
    in a slice of time of eight windows (and one more on either side) of one of `parts` shares of the pages;
    a timer clears it when the watermark has left it behind.  Ids of any type.
    """
    from ..operators import sensory

    keyed = _ready(perceptions.where(sensory.is_seen(perceptions)).withColumn("page", text.normalize_url(F.col("url"))), delay)
    rows = keyed.select("project_key", "page", "id", "created_at", "ts", F.pmod(F.xxhash64("project_key", "page"), F.lit(parts)).alias("part"))
    sliced = _sliced(rows, SLICE * max(float(window), 1.0), window, window)
    found = sliced.groupBy("slice", "part").transformWithStateInPandas(_Attention(window), "id string", "append", "eventtime")
    return found.select(F.col("id").cast(perceptions.schema["id"].dataType).alias("id"))


def register(perceptions: DataFrame, ttl: float = 900, capacity: int = 64, delay: str = "10 minutes") -> DataFrame:
    """project_key, id, event, at: perceptions that leave the register (decayed), and tombstones that are deleted (purged).

    The events of sensory.register_events, whatever the order in which perceptions
    (id, project_key, created_at, attended, decayed_at) come, if none is later than
    `delay`; each is given out once, when the watermark has passed it.  A state is a project's
    slice of time of eight ttl: what is live in it, its tombstones, and the times of
    the live perceptions within one ttl after it, which decide who is beyond the capacity.
    """
    keyed = _ready(perceptions, delay).select("project_key", "id", "created_at", F.coalesce(F.col("attended"), F.lit(0)).cast("boolean").alias("attended"), F.col("decayed_at").cast("double").alias("decayed_at"), "ts")
    sliced = _sliced(keyed, SLICE * max(float(ttl), 1.0), 0.0, ttl if capacity > 0 else 0.0)
    found = sliced.groupBy("project_key", "slice").transformWithStateInPandas(_Register(ttl, capacity), "project_key string, id string, event string, at double", "append", "eventtime")
    return found.withColumn("id", F.col("id").cast(perceptions.schema["id"].dataType))


def finished(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a stream over what is there now, from a written table."""
    root = f"{shared_folder(rows.sparkSession)}/mnemosa-{name}-{uuid.uuid4().hex}"
    rows.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/rows")


def ledger_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and value by window of ts and event_type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select("w.start", "event_type", "n", "value")


def capture(lines: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run merge on the parsed texts of each micro-batch of transcript lines; offsets are the stream's own checkpoint.

    merge(df, batch) must be idempotent by batch, as facts keyed by content are.
    """
    from ..sources import transcript

    return lines.writeStream.foreachBatch(lambda df, n: merge(transcript.texts(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coalesced_edits(edits: DataFrame) -> DataFrame:
    """Each path once in ten minutes of edits (path, ts)."""
    return edits.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["path"])
