"""The sensory register: attention, decay and promotion of perceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text


def is_seen(rows: DataFrame) -> Column:
    """Live visual rows of a page: those without a URL are of none."""
    return F.col("decayed_at").isNull() & (F.col("modality") == "visual") & (F.coalesce(text.normalize_url(F.col("url")), F.lit("")) != "")


def attend(rows: DataFrame, window: float = 300) -> DataFrame:
    """Live visual rows are attended if another of the same project and page lies within the window, both of them."""
    w = W.partitionBy("project_key", "page", "_live").orderBy("created_at", "id")
    out = rows.withColumns({"page": text.normalize_url(F.col("url")), "_live": is_seen(rows)})
    near = (F.col("created_at") - F.lag("created_at").over(w) <= window) | (F.lead("created_at").over(w) - F.col("created_at") <= window)
    return out.withColumn("attended", F.when(F.col("_live") & F.coalesce(near, F.lit(False)), 1).otherwise(F.col("attended"))).drop("_live")


def sweep(rows: DataFrame, now: float, ttl: float = 900, capacity: int = 64) -> DataFrame:
    """Unattended rows decay by age, then beyond the newest `capacity` of the live; tombstones older than ttl go."""
    loose = F.coalesce(F.col("attended"), F.lit(0)) == 0
    aged = rows.withColumn("decayed_at", F.when(F.col("decayed_at").isNull() & loose & (F.col("created_at") < now - ttl), now).otherwise(F.col("decayed_at")))
    live = F.col("decayed_at").isNull()
    rank = F.row_number().over(W.partitionBy("project_key", live).orderBy(F.desc("created_at"), F.desc("id")))
    ranked = aged.withColumn("_rank", F.when(live, rank))
    full = ranked.withColumn("decayed_at", F.when(live & loose & (F.col("_rank") > capacity), now).otherwise(F.col("decayed_at"))).drop("_rank")
    return full.where(F.col("decayed_at").isNull() | (F.col("decayed_at") >= now - ttl))


def register_events(rows: DataFrame, until: float, ttl: float = 900, capacity: int = 64) -> DataFrame:
    """project_key, id, event, at: what a register that is swept all the time loses up to a time.

    An unattended perception is decayed at the end of its ttl, or when the `capacity`-th
    perception after it comes, if that is earlier; a tombstone is purged one ttl later.
    """
    live = rows.where("decayed_at is null and created_at is not null")
    nth = F.lead("created_at", capacity).over(W.partitionBy("project_key").orderBy("created_at", F.col("id").cast("string"))) if capacity > 0 else F.lit(None).cast("double")
    loose = live.withColumn("_nth", nth).where(F.coalesce(F.col("attended"), F.lit(0)) == 0)
    decayed = loose.select("project_key", "id", F.least(F.col("created_at") + ttl, F.col("_nth")).alias("at")).where(F.col("at") <= until)
    dead = decayed.unionByName(rows.where("decayed_at is not null").select("project_key", "id", F.col("decayed_at").alias("at")))
    purged = dead.select("project_key", "id", F.lit("purged").alias("event"), (F.col("at") + ttl).alias("at")).where(F.col("at") <= until)
    return decayed.select("project_key", "id", F.lit("decayed").alias("event"), "at").unionByName(purged)


def promote(rows: DataFrame) -> DataFrame:
    """The newest attended live visual row of each project and URL."""
    held = rows.where("modality = 'visual' and attended = 1 and decayed_at is null")
    return held.groupBy("project_key", "url").agg(F.max(F.struct("created_at", "id")).alias("m")).select("project_key", "url", "m.created_at", "m.id")


def stats(rows: DataFrame) -> DataFrame:
    live = F.col("decayed_at").isNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy("project_key").agg(count(live).alias("live"), count(live & (F.col("attended") == 1)).alias("attended"), count(~live).alias("decayed"), count(live & (F.col("modality") == "visual")).alias("visual"), count(live & (F.col("modality") == "verbal")).alias("verbal"))
