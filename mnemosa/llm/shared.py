"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder under /tmp/checkpoints in local mode, as in tests, and an error elsewhere."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{folder(spark)}/mnemosa-{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(lambda: [drop(s, p) for s, p in list(_made)])
    _made.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended; the files are then the cluster's to clean
        return


class Tables:
    """Intermediate tables of one operator run; drop() deletes those that its result doesn't read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it back: cuts the lineage and outlives lost executors."""
        self.paths[name] = path = fresh(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                drop(self.spark, path)
