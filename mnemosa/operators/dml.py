"""Changes of the engine's tables beyond the lifecycle: flags, deletes, replacements and upserts, each a function of the old table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text
from .lifecycle import _set


def _hit(rows: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, Column]:
    marked = ids.select(key).distinct().withColumn("_hit", F.lit(1))
    return rows.join(marked, key, "left"), F.col("_hit") == 1


def set_status(facts: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    out, hit = _hit(facts, ids)
    return _set(out, hit, status=status).drop("_hit")


def clear_session_kind(facts: DataFrame, project: str, session: str, kind: str) -> DataFrame:
    gone = (F.col("project_key") == project) & (F.col("session_id") == session) & (F.col("kind") == kind)
    return facts.where(~F.coalesce(gone, F.lit(False)))


def delete_facts(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids.select("id").distinct(), "id", "left_anti")


def delete_memory(facts: DataFrame, edges: DataFrame, project: str, card: str) -> tuple[DataFrame, DataFrame]:
    """facts without those of an observation, or without the one of that id; edges (src, dst) without ends that went with them."""
    mine = F.col("project_key").eqNullSafe(project) & (F.col("observation_id").eqNullSafe(card) | (F.col("id").cast("string") == card))
    left = facts.where(~F.coalesce(mine, F.lit(False)))
    gone = facts.where(mine).select("id")
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return left, edges


def upsert(rows: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """rows with new in place of those of the same keys, each key of new once (the last by `seq`, if there is one); columns of keep stay as they were."""
    order = F.desc("seq") if "seq" in new.columns else F.lit(0)
    last = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").select(*[c for c in rows.columns if c in new.columns])
    for c in keep:
        last = last.drop(c).join(rows.select(*keys, c), keys, "left").withColumn(c, F.coalesce(c, F.lit(0)))
    return rows.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def perceive(senses: DataFrame, new: DataFrame) -> DataFrame:
    """The register with new perceptions: a known id gets the new time and text and is live again; whether it was attended stays."""
    return upsert(senses, new.withColumn("decayed_at", F.lit(None).cast("double")), ["id"], keep=("attended",))


def mark_attended(senses: DataFrame, ids: DataFrame) -> DataFrame:
    out, hit = _hit(senses, ids)
    return _set(out, hit, attended=1).drop("_hit")


def mark_decayed(senses: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    """A row that has decayed already keeps its time."""
    out, hit = _hit(senses, ids)
    return _set(out, hit & F.col("decayed_at").isNull(), decayed_at=now).drop("_hit")


def replace_chunks(chunks: DataFrame, new: DataFrame, snapshots: bool = False) -> DataFrame:
    """chunks with the sources of new in their new form, of one chunk id the last; with snapshots, only snapshot chunks make room."""
    keys = ["project_key", "source_path"]
    sources = new.select(*keys).distinct()
    old = chunks.where("kind = 'snapshot'").join(sources, keys, "left_anti").unionByName(chunks.where("kind is null or kind <> 'snapshot'")) if snapshots else chunks.join(sources, keys, "left_anti")
    order = F.desc("seq") if "seq" in new.columns else F.desc("byte_start")
    once = new.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(order))).where("_n = 1").drop("_n", "seq")
    return old.join(once.select("id"), "id", "left_anti").unionByName(once, allowMissingColumns=True)


def delete_sources(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks or file states without those of gone (project_key, source_path)."""
    return rows.join(gone.select("project_key", "source_path").distinct(), ["project_key", "source_path"], "left_anti")


def prune_project(rows: DataFrame, project: str) -> DataFrame:
    return rows.where(~F.col("project_key").eqNullSafe(F.lit(project)))


def snapshot_chunks(pages: DataFrame, now: float) -> DataFrame:
    """One chunk for each URL of pages (project_key, url, text, seq): of several texts of a URL the last by seq; empty texts give none."""
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    url = F.coalesce("url", F.lit(""))
    rows = pages.select("project_key", url.alias("source_path"), body.alias("body"), "seq").where("body <> ''")
    last = rows.groupBy("project_key", "source_path").agg(F.max_by("body", "seq").alias("body"))
    return last.select(
        text.chunk_id(F.col("project_key"), F.col("source_path"), F.lit("snapshot")).alias("id"), "project_key", "source_path", F.lit("snapshot").alias("kind"), F.lit("snapshot").alias("anchor"),
        rules.snapshot_title(F.col("source_path")).alias("title"), F.col("source_path").alias("heading_path"), F.lit(0).alias("level"), rules.snapshot_summary(F.col("body")).alias("summary"), "body",
        F.lit(0).cast("long").alias("byte_start"), F.octet_length("body").cast("long").alias("byte_end"), F.sha2("body", 256).alias("content_hash"), F.lit(float(now)).alias("indexed_at"),
    )


def promote_perceptions(senses: DataFrame, chunks: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Attended live visual rows go into the index, the newest text of a URL, and leave the register."""
    ready = senses.where("modality = 'visual' and attended = 1 and decayed_at is null")
    new = snapshot_chunks(ready.select("project_key", "url", "text", F.struct("created_at", "id").alias("seq")), now)
    return mark_decayed(senses, ready, now), replace_chunks(chunks, new, snapshots=True)


def tree_signature(files: DataFrame) -> DataFrame:
    """One 63-bit number for files (path, mtime_ns, size): the same as long as none is added, removed or touched."""
    line = F.concat_ws("|", "path", F.col("mtime_ns").cast("string"), F.col("size").cast("string"))
    whole = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    digest = F.sha2("lines", 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    return whole.select(F.shiftleft(high, 32).bitwiseOR(F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")).alias("signature"))
