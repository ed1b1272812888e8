"""Table schemas, and additive upgrades to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, ByteType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "double": DoubleType(), "int": IntegerType(), "long": LongType(), "binary": BinaryType(), "array<string>": ArrayType(StringType()), "array<int>": ArrayType(IntegerType()), "array<tinyint>": ArrayType(ByteType())}


def _schema(columns: str) -> StructType:
    """From "name type, name type"; needs no session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


FACTS = _schema(
    "id string, project_key string, project_label string, project_path string, session_id string, kind string, text string, title string, subtitle string, narrative string, "
    "files array<string>, type string, observation_id string, created_at double, last_seen double, dim int, scale double, vec_int8 array<tinyint>, vec_bits binary, importance double, "
    "frequency int, status string, superseded_by string, tier string, recall_count int, last_recalled double, injected_count int, used_count int"
)
CHUNKS = _schema(
    "id string, project_key string, source_path string, kind string, anchor string, title string, heading_path string, level int, summary string, body string, byte_start long, byte_end long, "
    "content_hash string, dim int, scale double, vec_int8 array<tinyint>, indexed_at double"
)
CHUNK_SOURCES = _schema("project_key string, source_path string, file_hash string, mtime_ns long, indexed_at double")
SENSORY = _schema("id string, project_key string, modality string, observation_id string, url string, text string, attended int, created_at double, decayed_at double")
WORK_QUEUE = _schema(
    "msg_id string, stage string, project_key string, session_id string, ref string, payload string, status string, attempts int, next_retry_at double, lease_owner string, lease_expires double, enqueued_at double"
)
RECALL_EVENTS = _schema("ts double, project_key string, query string, returned int, top_sim double, confidence double, verdict string")
USAGE_EVENTS = _schema("ts double, project_key string, kind string, bytes_in long, bytes_saved long")
EDGES = _schema("src_id string, dst_id string, kind string, weight double")
INDEX_META = _schema("project_key string, label string, path string, updated_at double")
TERMS = _schema("id string, version string, length int, col int, term string, places array<int>")
CANARY = _schema("id long, model string, dim int, vec_int8 array<tinyint>, scale double")
CURSORS = _schema("cursor_key string, offset long, updated_at double")

#: What a column of an older table holds where it was missing.
DEFAULTS = {"status": "active", "frequency": 1, "tier": "ltm", "recall_count": 0, "injected_count": 0, "used_count": 0, "attended": 0, "attempts": 0, "weight": 1.0}


def upgrade(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the columns of schema, missing ones by default; last_seen is created_at where it is missing."""
    out = []
    for f in schema:
        if f.name in df.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "last_seen" and "created_at" in df.columns:
            out.append(F.col("created_at").cast("double").alias("last_seen"))
        else:
            out.append(F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*out)


def filled(df: DataFrame, schema: StructType) -> DataFrame:
    """upgrade(), where older files lack a column and so read as null: defaults there too, and last_seen is created_at."""
    rows = upgrade(df, schema)
    fill = {n: F.coalesce(n, F.lit(d)).cast(schema[n].dataType) for n, d in DEFAULTS.items() if n in schema.names}
    if {"last_seen", "created_at"} <= set(schema.names):
        fill["last_seen"] = F.coalesce("last_seen", "created_at")
    return rows.withColumns(fill) if fill else rows
