"""Reads of the engine's tables: by project, status, kind, newest or weakest first, in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_project(rows: DataFrame, project: str | None) -> DataFrame:
    return rows if project is None else rows.where(F.col("project_key") == project)


def newest(rows: DataFrame, time: str, limit: int | None = None, offset: int = 0, id_: str = "id") -> DataFrame:
    """Newest first, ties by id from the largest; a page of them."""
    out = rows.orderBy(F.desc_nulls_last(time), F.desc(id_))
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def facts_page(facts: DataFrame, project: str, limit: int, offset: int = 0) -> DataFrame:
    """Facts of a project in any status, newest first."""
    return newest(of_project(facts, project), "created_at", limit, offset)


def active(facts: DataFrame, project: str | None = None, kind: str | None = None, tier: str | None = None) -> DataFrame:
    out = of_project(facts, project).where("status = 'active'")
    out = out if kind is None else out.where(F.col("kind") == kind)
    return out if tier is None else out.where(F.col("tier") == tier)


def weakest_stm(facts: DataFrame, project: str, limit: int) -> DataFrame:
    """Active short-term facts, the least rehearsed and longest unseen first."""
    return active(facts, project, tier="stm").orderBy(F.asc_nulls_first("frequency"), F.asc_nulls_first("last_seen"), "id").limit(limit)


def merge_candidates(facts: DataFrame, project: str, limit: int = 512) -> DataFrame:
    return newest(active(facts, project, tier="stm"), "created_at", limit)


def strongest(facts: DataFrame, project: str, limit: int) -> DataFrame:
    """Active facts by how often, then how lately, they were seen."""
    return active(facts, project).orderBy(F.desc("frequency"), F.desc_nulls_last("last_seen"), "id").limit(limit)


def latest_summary(facts: DataFrame, project: str) -> DataFrame:
    return newest(active(facts, project, "session_summary"), "created_at", 1)


def by_id(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def known(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """ids (id) with `known`: whether rows has them."""
    return ids.join(rows.select("id", F.lit(True).alias("known")).distinct(), "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def chunk_rows(chunks: DataFrame, project: str | None = None, kind: str | None = None) -> DataFrame:
    out = of_project(chunks, project)
    return out if kind is None else out.where(F.col("kind") == kind)


def outline(chunks: DataFrame, project: str, source: str | None = None, kind: str | None = None) -> DataFrame:
    """Chunks without bodies, in the order of their files."""
    out = chunk_rows(chunks, project, kind)
    out = out if source is None else out.where(F.col("source_path") == source)
    return out.select("id", "source_path", "kind", "anchor", "title", "heading_path", "level", "summary", "byte_start", "byte_end").orderBy("source_path", "byte_start", "anchor")


def section(chunks: DataFrame, project: str, ref: str) -> DataFrame:
    """The chunk of an id or anchor; of several, the first by path."""
    return of_project(chunks, project).where((F.col("id") == ref) | (F.col("anchor") == ref)).orderBy("source_path", "byte_start").limit(1)


def senses(rows: DataFrame, project: str | None = None, limit: int | None = None, with_decayed: bool = False) -> DataFrame:
    """The register, newest first; live rows only unless asked for."""
    return newest(of_project(rows, project).where(F.lit(with_decayed) | F.col("decayed_at").isNull()), "created_at", limit)


def work(queue: DataFrame, project: str | None = None, limit: int = 200) -> DataFrame:
    return newest(of_project(queue, project), "enqueued_at", limit, id_="msg_id")


def source_states(sources: DataFrame, project: str) -> DataFrame:
    """source_path, file_hash, mtime_ns of the indexed files."""
    return of_project(sources, project).select("source_path", "file_hash", "mtime_ns").distinct()


def needs_index(files: DataFrame, sources: DataFrame, project: str) -> DataFrame:
    """files (source_path, mtime_ns, file_hash) with `why`: new, touched (same content) or changed; those of the same time are left out, a null time is never the same."""
    old = source_states(sources, project).select("source_path", F.col("file_hash").alias("_hash"), F.col("mtime_ns").alias("_mtime"))
    same_time = F.coalesce(F.col("_mtime") == F.col("mtime_ns"), F.lit(False))
    why = F.when(F.col("_hash").isNull(), "new").when(F.col("_hash") == F.col("file_hash"), "touched").otherwise("changed")
    return files.join(old, "source_path", "left").where(F.col("_hash").isNull() | ~same_time).withColumn("why", why).drop("_hash", "_mtime")


def vanished(sources: DataFrame, seen: DataFrame, project: str, scope: str = "") -> DataFrame:
    """source_path of indexed files under `scope` that seen (source_path) lacks; nothing outside the scope is swept."""
    old = of_project(sources, project).select("source_path").distinct()
    if scope:
        inside: Column = F.col("source_path").startswith(scope.rstrip("/") + "/") | (F.col("source_path") == scope)
        old = old.where(inside)
    return old.join(seen.select("source_path"), "source_path", "left_anti")


def cursor(cursors: DataFrame, keys: DataFrame) -> DataFrame:
    """cursor_key, offset of keys (cursor_key): 0 where there is none yet."""
    return keys.join(cursors.select("cursor_key", "offset"), "cursor_key", "left").withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))


def project_meta(facts: DataFrame) -> DataFrame:
    """project_key, label, path: of the newest fact that has any, else the key and an empty path."""
    at = F.struct("created_at", "id")
    has = F.coalesce(F.col("project_label"), F.lit("")) != ""
    best = facts.groupBy("project_key").agg(F.max_by(F.when(has, F.col("project_label")), F.when(has, at)).alias("label"), F.max_by("project_path", F.when(F.col("project_path").isNotNull(), at)).alias("path"))
    return best.select("project_key", F.coalesce("label", "project_key").alias("label"), F.coalesce("path", F.lit("")).alias("path"))


def stored_dims(facts: DataFrame, project: str | None = None) -> DataFrame:
    """The distinct sizes of active facts' vectors, by project."""
    return active(facts, project).where("dim is not null").select("project_key", "dim").distinct()
