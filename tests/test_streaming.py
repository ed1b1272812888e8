"""Streams against their batch forms, in several orders of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from mnemosa.operators import sensory
from mnemosa.streaming import stateful

SCHEMA = "id {}, project_key string, url string, modality string, created_at double, attended int, decayed_at double"


def fed(spark, path, df, batches):
    """A stream of df's rows in the given batches of ids."""
    for ids in batches:
        df.where(F.col("n").isin(ids)).drop("n").coalesce(1).write.mode("append").parquet(f"file://{path}")
    return spark.readStream.schema(df.drop("n").schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}")


def arrivals(times, delay, seed, parts=4):
    """Rows dealt to batches so that none is later than the delay behind the largest time of the batches before."""
    rng = random.Random(seed)
    order = sorted(range(len(times)), key=lambda n: times[n] + rng.uniform(0, 0.9 * delay))
    size = -(-len(order) // parts)
    return [order[k : k + size] for k in range(0, len(order), size)]


@pytest.mark.parametrize(("kind", "seed"), [("string", 1), ("long", 2)])
def test_attention_like_the_batch(kind, seed, spark, tmp_path):
    rng, name = random.Random(seed), (lambda i: f"id{i}" if kind == "string" else i)
    times = [1e9 + round(rng.uniform(0, 4000), 1) for _ in range(70)]
    rows = [(n, name(n), "pq"[n % 7 == 0], None if n % 11 == 5 else "" if n % 11 == 6 else f"http://x/{n % 9}#f{n}", "verbal" if n % 13 == 4 else "visual", t, 0, 1.0 if n % 17 == 3 else None) for n, t in enumerate(times)]
    df = spark.createDataFrame(rows, "n int, " + SCHEMA.format(kind))
    stream = fed(spark, tmp_path / "in", df, arrivals(times, 600, seed))
    got = [r.id for r in stateful.finished(stateful.attention(stream, 150), "seen").collect()]
    want = {r.id for r in sensory.attend(df, 150).where("attended = 1").collect()}
    assert set(got) == want and len(got) == len(want) and 10 < len(want) < 60


def test_attention_in_one_batch_and_late_in_the_next(spark, tmp_path):
    """0 and 500 first, then 100: both of the near pair are attended."""
    rows = [(n, i, "p", "http://x", "visual", t, 0, None) for n, (i, t) in enumerate((("a", 1e9), ("b", 1e9 + 500), ("c", 1e9 + 100)))]
    stream = fed(spark, tmp_path / "in", spark.createDataFrame(rows, "n int, " + SCHEMA.format("string")), [[0, 1], [2]])
    assert sorted(r.id for r in stateful.finished(stateful.attention(stream), "seen").collect()) == ["a", "c"]


@pytest.mark.parametrize(("capacity", "seed"), [(5, 3), (0, 4)])
def test_register_like_the_batch(capacity, seed, spark, tmp_path):
    rng = random.Random(seed)
    times = [1e9 + round(rng.uniform(0, 3000), 1) for _ in range(60)]
    rows = [(n, f"id{n}", "pq"[n % 3 == 0], None, "verbal", t, int(n % 5 == 1), t + 3 if n % 13 == 2 else None) for n, t in enumerate(times)]
    df = spark.createDataFrame(rows, "n int, " + SCHEMA.format("string"))
    stream = fed(spark, tmp_path / "in", df, arrivals(times, 600, seed))
    got = sorted(map(tuple, stateful.finished(stateful.register(stream, 400, capacity), "gone").collect()))
    until = max(times) - 600
    want = sorted(map(tuple, sensory.register_events(df, until, 400, capacity).collect()))
    assert got == want and {e for _, _, e, _ in got} == {"decayed", "purged"}
    # what has decayed is what one sweep at that time takes
    swept = sensory.sweep(df.where(F.col("created_at") <= until).where("decayed_at is null"), until, 400, capacity or 10**6)
    left = {r.id for r in swept.where("decayed_at is null").collect()}
    there = {r.id for r in df.where(F.col("created_at") <= until).where("decayed_at is null").collect()}
    assert {i for _, i, e, _ in got if e == "decayed"} == there - left
