import os
from pathlib import Path

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="session")
def same_rows():
    """Checks a DataFrame against a DuckDB relation, columns by name, rows in any order."""

    def check(df, relation):
        cols = sorted(df.columns)
        assert cols == sorted(relation.columns)
        got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        rows = [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()]
        assert got == sorted((tuple(_plain(r[c]) for c in cols) for r in rows), key=repr)

    return check
