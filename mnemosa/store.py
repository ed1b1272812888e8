"""Tables as Parquet under partitions; a write costs what it changes.

Table deals rows to partitions by hashes of their project and key, and replaces
the partitions that a change touches by dynamic partition overwrite.  The new rows
are written beside the table first and marked as whole; from then on they count:
readers take the touched partitions from there and the others from the table, so
that nobody sees a part of a change, and a writer that died is finished by the
next.  Ledger adds rows, each time as one more partition, which appears at once.

One writer at a time for each table; readers as many as there are.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .schemas import filled, upgrade

Part = tuple[int, ...]


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode a folder under /tmp where it is unset, elsewhere an error."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def _drop_made() -> None:
    for spark, path in _made:
        try:
            Files(spark, path).drop("")
        except Exception:  # the session may have ended; the files are then the cluster's to clean
            continue


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: computed once, and safe from lost executors; deleted when the driver ends."""
    if not _made:
        atexit.register(_drop_made)
    path = f"{shared_folder(df.sparkSession)}/mnemosa-step-{uuid.uuid4().hex}"
    _made.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Small files and folders under a root, in whatever file system it lies."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        at = self._path(self.at(folder))
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The file, at once: it is written under another name first."""
        self._fs.mkdirs(self._path(self.at(name)).getParent())
        stream = self._fs.create(self._path(self.at(name + "._")), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.rename(self._path(self.at(name + "._")), self._path(self.at(name)))

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name) if name else self.root), True)


def overwrite(df: DataFrame, path: str, parts: Sequence[str]) -> None:
    """Replace the partitions of which df has rows, and no others; each is written by one task."""
    df.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


class Table:
    """Rows by key under partitions _p (of the project) and _b (of the key).

    project and key name the columns whose hashes say where a row lies: a project's
    rows lie in `buckets` partitions, one of the project's share of the table.
    """

    PARTS = ("_p", "_b")

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, project: str | None = None, projects: int = 8, buckets: int = 8):
        self.spark, self.root, self.schema, self.key, self.project = spark, root.rstrip("/"), schema, key, project
        self.projects, self.buckets = projects if project else 1, buckets
        self.files = Files(spark, root)
        self._whole = StructType([*schema.fields, *(StructField(p, IntegerType()) for p in self.PARTS)])

    # Where rows lie

    def _placed(self, df: DataFrame) -> DataFrame:
        p = F.pmod(F.xxhash64(F.col(self.project)), F.lit(self.projects)) if self.project else F.lit(0)
        return df.withColumns({"_p": p.cast("int"), "_b": F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")})

    def parts_of(self, *rows: DataFrame) -> list[Part]:
        """The partitions of the keys (and projects) in rows, of which there are projects * buckets at most."""
        found: set[Part] = set()
        for df in rows:
            found |= {tuple(r) for r in self._placed(df).select(*self.PARTS).distinct().collect()}
        return sorted(found)

    def _within(self, parts: Sequence[Part]) -> Column:
        """Whether a row lies in one of the partitions: a condition on partition columns alone."""
        return (F.col("_p") * self.buckets + F.col("_b")).isin([p * self.buckets + b for p, b in parts]) if parts else F.lit(False)

    # Reading

    def version(self) -> int:
        """How many writes there have been."""
        return max((int(n) for n in self.files.names("writes") if n.isdigit()), default=0)

    def _state(self) -> tuple[int, list[Part] | None]:
        """The number of writes that are done, and the partitions of one that counts but isn't done yet."""
        version, pending = self.version(), f"pending-{self.version() + 1}"
        if not self.files.has(f"{pending}/whole"):
            return version, None
        return version, [tuple(map(int, line.split()[:2])) for line in self.files.text(f"{pending}/whole").splitlines()]

    def _parquet(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._whole).parquet(self.files.at(name)) if self.files.has(name) else self.spark.createDataFrame([], self._whole)

    def _read(self, parts: Sequence[Part] | None, projects: Sequence[str | None] | None) -> DataFrame:
        for _ in range(10):
            version, pending = self._state()
            df = self._parquet("rows")
            if pending is not None:
                df = df.where(~self._within(pending)).unionByName(self._parquet(f"pending-{version + 1}/rows"))
            if self._state() == (version, pending):
                break
        else:
            raise RuntimeError(f"{self.root} kept changing while it was read")
        if parts is not None:
            df = df.where(self._within(parts))
        if projects is not None and self.project:
            one = lambda p: F.col("_p") == F.pmod(F.xxhash64(F.lit(p).cast("string")), F.lit(self.projects)).cast("int")
            where = F.lit(False)
            for p in projects:
                where = where | one(p)
            df = df.where(where)
        return df

    def read(self, parts: Sequence[Part] | None = None, projects: Sequence[str | None] | None = None) -> DataFrame:
        """The table; with parts or projects only the partitions that hold them (other projects can share those)."""
        return filled(self._read(parts, projects), self.schema)

    # Writing

    def replace(self, df: DataFrame, parts: Sequence[Part]) -> int:
        """df in place of all rows of the partitions; its rows must lie there.  Returns the new version.

        df may read the table itself: it is written out before the table changes.
        """
        self.recover()
        version = self.version()
        if not parts:
            return version
        pending = f"pending-{version + 1}"
        self.files.drop(pending)
        overwrite(self._placed(upgrade(df, self.schema)), self.files.at(f"{pending}/rows"), self.PARTS)
        held = {(int(p[3:]), int(b[3:])) for p in self.files.names(f"{pending}/rows") if p.startswith("_p=") for b in self.files.names(f"{pending}/rows/{p}") if b.startswith("_b=")}
        if not held <= set(parts):
            raise ValueError("rows lie outside of the partitions that the write names")
        self.files.put(f"{pending}/whole", "\n".join(f"{p} {b} {int((p, b) in held)}" for p, b in parts))
        self._settle(version + 1)
        self.files.drop(f"pending-{version}")  # of the write before, kept for its readers until now
        return version + 1

    def recover(self) -> None:
        """Finish a write that counts already, if its writer died."""
        version, pending = self._state()
        if pending is not None:
            self._settle(version + 1)

    def _settle(self, version: int) -> None:
        """Bring a write that counts into the table; may be done again."""
        said = [tuple(map(int, line.split())) for line in self.files.text(f"pending-{version}/whole").splitlines()]
        if any(held for *_, held in said):
            overwrite(self._parquet(f"pending-{version}/rows"), self.files.at("rows"), self.PARTS)
        for p, b, held in said:
            if not held:
                self.files.drop(f"rows/_p={p}/_b={b}")
        self.files.put(f"writes/{version}", "")
        self.files.drop(f"writes/{version - 2}")

    def upsert(self, rows: DataFrame) -> int:
        """rows in place of those of the same keys (each key once in rows); only their partitions are written."""
        rows = checkpointed(upgrade(rows, self.schema))
        parts = self.parts_of(rows)
        return self.replace(self.read(parts).join(rows.select(self.key), self.key, "left_anti").unionByName(rows), parts)

    def remove(self, gone: DataFrame) -> int:
        """The table without the keys (and projects) of gone."""
        keys = checkpointed(gone.select(self.key, *([self.project] if self.project else [])).distinct())
        parts = self.parts_of(keys)
        return self.replace(self.read(parts).join(keys.select(self.key), self.key, "left_anti"), parts)

    def change(self, rows: DataFrame, how: Callable[[DataFrame], DataFrame]) -> int:
        """how(the partitions of rows' keys) in their place; how must leave each row in its partition."""
        parts = self.parts_of(rows)
        return self.replace(how(self.read(parts)), parts)

    def apply(self, how: Callable[[DataFrame], DataFrame]) -> int:
        """how(the table) in its place, for changes that can be anywhere: sums of hashes tell which partitions they touch, and those are written."""
        return self.write(how(self.read()))

    def write(self, df: DataFrame) -> int:
        """df as the whole table; partitions that stay as they are aren't written."""
        marks = lambda t: self._placed(upgrade(t, self.schema)).groupBy(*self.PARTS).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*self.schema.names).cast("decimal(38,0)")).alias("mark"))
        old, new = marks(self.read()), marks(df).withColumnsRenamed({"n": "n_", "mark": "mark_"})
        touched = old.join(new, list(self.PARTS), "full").where("not (n <=> n_ and mark <=> mark_)").select(*self.PARTS)
        parts = sorted(tuple(r) for r in touched.collect())
        return self.replace(self._placed(upgrade(df, self.schema)).where(self._within(parts)).drop(*self.PARTS), parts)


class Ledger:
    """Rows that are only added: each write is one more partition, which a small file makes count."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root, self.schema, self.files = spark, root.rstrip("/"), schema, Files(spark, root)
        self._whole = StructType([*schema.fields, StructField("_w", IntegerType())])

    def version(self) -> int:
        """The newest write that counts."""
        return max((int(n) for n in self.files.names("writes") if n.isdigit()), default=0)

    def append(self, rows: DataFrame) -> int:
        last = self.version()
        return self._add(rows, last + 1, int(self.files.text(f"writes/{last}")) if last else 1)

    def _add(self, rows: DataFrame, n: int, oldest: int) -> int:
        """rows as write n; writes before `oldest` count no more."""
        self.files.drop(f"rows/_w={n}")
        overwrite(upgrade(rows, self.schema).withColumn("_w", F.lit(n)), self.files.at("rows"), ["_w"])
        self.files.put(f"writes/{n}", str(oldest))
        self.files.drop(f"writes/{n - 2}")
        return n

    def read(self) -> DataFrame:
        last = self.version()
        if not last or not self.files.has("rows"):
            return self.spark.createDataFrame([], self.schema)
        within = F.col("_w").between(int(self.files.text(f"writes/{last}")), last)
        return filled(self.spark.read.schema(self._whole).parquet(self.files.at("rows")).where(within), self.schema)

    def write(self, rows: DataFrame) -> int:
        """rows as the whole ledger, in one partition."""
        n = self.version() + 1
        self._add(checkpointed(upgrade(rows, self.schema)), n, n)
        for name in self.files.names("rows"):
            if name.startswith("_w=") and int(name[3:]) < n:
                self.files.drop(f"rows/{name}")
        return n

    def fold(self) -> int:
        """All rows in one partition, for a ledger of very many small writes."""
        return self.write(self.read())
