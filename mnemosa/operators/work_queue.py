"""Work items with leases, as transforms of the queue table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_id
from .lifecycle import _set


def unknown(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new whose msg_id isn't in the queue, all of them."""
    return new.join(queue.select("msg_id"), "msg_id", "left_anti")


def publish(queue: DataFrame, new: DataFrame) -> DataFrame:
    """A msg_id that is known already is left out, and comes in once."""
    return queue.unionByName(unknown(queue, new.dropDuplicates(["msg_id"])), allowMissingColumns=True)


def claim(queue: DataFrame, now: float, lease: float, most: int, owner: str | None = None, stage: str | None = None) -> DataFrame:
    """The first `most` due items of each stage, with attempts one more and a lease."""
    due = (F.col("next_retry_at") <= now) & ((F.col("status") == "pending") | ((F.col("status") == "in_progress") & (F.col("lease_expires") < now)))
    due = due if stage is None else due & (F.col("stage") == stage)
    n = F.row_number().over(W.partitionBy("stage").orderBy("enqueued_at", "msg_id"))
    taken = queue.where(due).withColumn("_n", n).where(F.col("_n") <= most).drop("_n")
    values = {"status": F.lit("in_progress"), "attempts": F.col("attempts") + 1, "lease_expires": F.lit(now + lease)}
    return taken.withColumns(values | ({"lease_owner": F.lit(owner)} if "lease_owner" in queue.columns else {}))


def apply(queue: DataFrame, changed: DataFrame) -> DataFrame:
    """queue with changed rows in place of their old ones."""
    return queue.join(changed.select("msg_id"), "msg_id", "left_anti").unionByName(changed)


def ack(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return queue.join(ids.select("msg_id"), "msg_id", "left_anti")


def _held(queue: DataFrame, ids: DataFrame) -> tuple[DataFrame, Column]:
    out = queue.join(ids.select("msg_id").distinct().withColumn("_hit", F.lit(1)), "msg_id", "left")
    return out, (F.col("_hit") == 1) & (F.col("status") == "in_progress")


def _free(queue: DataFrame) -> dict:
    return {"lease_expires": F.lit(None).cast("double")} | ({"lease_owner": F.lit(None).cast("string")} if "lease_owner" in queue.columns else {})


def nak(queue: DataFrame, ids: DataFrame, now: float, backoff: tuple[int, ...], most: int) -> DataFrame:
    """Items of ids (msg_id) in progress wait for their next turn, or are dead after `most` attempts."""
    delay = F.element_at(F.array(*map(F.lit, backoff)), F.greatest(F.lit(1), F.least(F.col("attempts"), F.lit(len(backoff)))))
    out, held = _held(queue, ids)
    out = _set(out, held & (F.col("attempts") < most), next_retry_at=now + delay)
    return _set(out, held, **_free(queue), status=F.when(F.col("attempts") >= most, "dead").otherwise("pending")).drop("_hit")


def term(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """Items of ids (msg_id) are dead, whatever they were."""
    out, _ = _held(queue, ids)
    return _set(out, F.col("_hit") == 1, **_free(queue), status="dead").drop("_hit")


def purge(queue: DataFrame, status: str | None = None, stage: str | None = None, project: str | None = None) -> DataFrame:
    """queue without the items of this status, stage and project, of which at least one must be named."""
    named = {"status": status, "stage": stage, "project_key": project}
    if not any(named.values()):
        raise ValueError("purge of the whole queue")
    gone = F.lit(True)
    for column, value in named.items():
        gone = gone if value is None else gone & F.col(column).eqNullSafe(F.lit(value))
    return queue.where(~gone)


def degraded(records: DataFrame, project: str, delta: str, session: str, now: float) -> DataFrame:
    """The item that asks for a text to be distilled again, one row; records (id, degraded) are the facts to replace.  No rows unless all are degraded."""
    ids = records.agg(F.collect_set("id").alias("fact_ids"), F.min(F.col("degraded").cast("int")).alias("all"))
    payload = F.to_json(F.struct(F.lit(delta).alias("text"), F.array_sort("fact_ids").alias("fact_ids"), F.lit(session).alias("session_id"), F.lit(project).alias("project_key")))
    item = ids.where("all = 1").select(F.concat(F.lit("rescue:"), content_id(F.lit(project), F.lit(delta))).alias("msg_id"), F.lit("rescue").alias("stage"), F.lit(project).alias("project_key"), F.lit(session).alias("session_id"), payload.alias("payload"))
    return item.withColumns({"status": F.lit("pending"), "attempts": F.lit(0), "next_retry_at": F.lit(float(now)), "enqueued_at": F.lit(float(now))})


def payloads(items: DataFrame) -> DataFrame:
    """msg_id, text, fact_ids, session_id, project_key of claimed rescue items; text is null where the payload is no JSON object."""
    p = F.from_json("payload", "text string, fact_ids array<string>, session_id string, project_key string")
    return items.select("msg_id", p.alias("p")).select("msg_id", "p.*")


def reclaim(queue: DataFrame, now: float) -> DataFrame:
    return _set(queue, (F.col("status") == "in_progress") & (F.col("lease_expires") < now), status="pending", lease_expires=F.lit(None).cast("double"))


def dead_stale(queue: DataFrame, now: float, after: float) -> DataFrame:
    return _set(queue, (F.col("status") != "dead") & (F.col("enqueued_at") < now - after), status="dead")


def by_stage(queue: DataFrame) -> DataFrame:
    return queue.groupBy("stage", "status").agg(F.count("*").alias("n"))
