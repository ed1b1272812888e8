"""Which project a session belongs to, from its folder and what lies in the folders above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names in a folder that make it the root of a project, if sessions are resolved by marker.
MARKERS = (".git", "pyproject.toml", "package.json", "Cargo.toml", "go.mod")
ROOT = ".mnemosa-root"


def folder(path: Column) -> Column:
    """An absolute path without empty parts, `.` and `..`."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def above(path: Column) -> Column:
    """(path, depth) of a folder and of all above it, as an array."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")).alias("path"), n.alias("depth")))


def resolve(sessions: DataFrame, held: DataFrame, by: str = "workspace", markers: tuple[str, ...] = MARKERS, root: str = ROOT) -> DataFrame:
    """sessions (cwd, project_dir) with project_key, project_path, project_label; held (path, name) says what lies in folders.

    The anchor is project_dir where there is one and sessions are resolved by workspace,
    else cwd; without either a session has no project.  The nearest folder at or
    above the anchor that holds `root` is the project; else, by marker, the nearest
    that holds a marker; else the anchor.  Folders meet what they hold in a join by path.
    """
    if by not in ("workspace", "marker"):
        raise ValueError("projects are resolved by workspace or by marker")
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    anchor = F.coalesce(empty("project_dir"), empty("cwd")) if by == "workspace" else empty("cwd")
    asked = sessions.withColumn("_at", F.when(anchor.isNotNull(), folder(anchor)))
    folders = asked.where("_at is not null").select("_at").distinct()
    wanted = held.where(F.col("name").isin(root, *(markers if by == "marker" else ()))).select(folder(F.col("path")).alias("path"), (F.col("name") == root).alias("pinned"))
    marks = wanted.groupBy("path").agg(F.max("pinned").alias("pinned"))
    met = folders.select("_at", F.explode(above(F.col("_at"))).alias("f")).select("_at", "f.*").join(marks, "path")
    nearest = met.groupBy("_at").agg(F.max(F.struct("pinned", "depth", "path")).alias("m")).select("_at", F.col("m.path").alias("_root"))
    found = asked.join(nearest, "_at", "left").withColumn("project_path", F.coalesce("_root", "_at"))
    label = F.element_at(F.split("project_path", "/"), -1)
    named = found.withColumns({"project_key": F.substring(F.sha2("project_path", 256), 1, 16), "project_label": F.when(label != "", label).when(F.col("project_path").isNotNull(), "root")})
    return named.drop("_at", "_root")
