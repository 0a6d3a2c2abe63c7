"""Chunked arrays: round trips of all types, boxes that open few chunks, commits in one step."""

import datetime
import math
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from meshframe.sources import chunks
from meshframe.sources.grid import Source

KINDS = "x double, y long, d date, t timestamp, n timestamp_ntz, a long, b int, c double, e float, f boolean, g timestamp, h date"


def table(spark, n=200, seed=1):
    rng = random.Random(seed)
    rows, seen = [], set()
    while len(rows) < n:
        at = (rng.randrange(7), rng.randrange(5), rng.randrange(3), rng.randrange(4), rng.randrange(2))
        if at in seen:
            continue
        seen.add(at)
        x, y, d, t, m = at
        when = datetime.datetime(2020, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=t, microseconds=t)
        maybe = lambda v: None if rng.random() < 0.2 else v
        rows.append((x * x - 1.5, y - 2, datetime.date(1969, 12, 30) + datetime.timedelta(d), when, datetime.datetime(1960, 1, 1, m), maybe(-n), maybe(7), maybe(rng.choice([math.nan, math.inf, 0.1])), maybe(0.5), maybe(rng.random() < 0.5), maybe(when), maybe(datetime.date(2000, 1, 1))))
    return spark.createDataFrame(rows, KINDS)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_round_trip(spark, tmp_path):
    df = table(spark)
    s = Source("s", df, ["x", "y", "d", "t", "n"])
    path = str(tmp_path / "array")
    chunks.save(s, path, {"x": 3, "y": 2, "t": 3})
    back = chunks.load(spark, path)
    assert rows(back.select(*sorted(df.columns))) == rows(df.select(*sorted(df.columns)))
    again = chunks.open_chunks(spark, path, "again", features=["c", "a"])
    assert again.frame.columns == ["d", "n", "t", "x", "y", "c", "a"]
    assert rows(again.cells().select("x", "y", "t", "a")) == rows(df.select("x", "y", "t", "a"))


def test_a_box_opens_only_its_chunks(spark, tmp_path):
    df = spark.range(40 * 30).select((F.col("id") / 30).cast("int").alias("x"), (F.col("id") % 30).alias("y"), F.col("id").alias("v"), (F.col("id") * 0.5).alias("w"))
    path = str(tmp_path / "array")
    chunks.save(Source("s", df, ["x", "y"]), path, {"x": 10, "y": 10})
    layout = chunks.Layout.read(path)
    assert len(layout.index) == 12

    def opened(*filters):
        r = chunks.ChunkReader(path, ["v"], layout)
        assert list(r.pushFilters(list(filters))) == list(filters)
        return len(r.chunks())

    assert opened() == 12
    assert opened(EqualTo(("x",), 12)) == 3
    assert opened(GreaterThan(("x",), 9), LessThanOrEqual(("x",), 19), EqualTo(("y",), 0)) == 1
    assert opened(In(("y",), (0, 9))) == 4 and opened(GreaterThan(("x",), 99)) == 0 and opened(EqualTo(("v",), 3)) == 12
    back = chunks.load(spark, path)
    box = back.where("x between 10 and 19 and y >= 20")
    assert rows(box) == rows(df.where("x between 10 and 19 and y >= 20").select("x", "y", "v", "w"))
    assert "x" in box._jdf.queryExecution().executedPlan().toString()
    assert back.where("x = 100").count() == 0 and back.where("v = 31").collect()[0].x == 1


def test_tasks_hold_few_bytes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "array")
    df = spark.range(1000).select(F.col("id").alias("x"), F.rand(3).alias("v"))
    chunks.save(Source("s", df, ["x"]), path, {"x": 50})
    monkeypatch.setattr(chunks, "TASK_BYTES", 500)
    r = chunks.ChunkReader(path, ["v"], chunks.Layout.read(path))
    assert len(r.partitions()) == 20 and sum(len(p.value) for p in r.partitions()) == 20


def test_replaced_in_one_step(spark, tmp_path):
    """A write that fails leaves the array that was there; shards nobody refers to are not read."""
    path = str(tmp_path / "array")
    df = spark.range(20).select(F.col("id").alias("x"), F.col("id").alias("v"))
    chunks.save(Source("s", df, ["x"]), path, {"x": 5})
    twice = df.unionByName(df.limit(1))
    with pytest.raises(Exception, match="two rows for one cell"):
        chunks.save(Source("s", twice, ["x"]), path, {"x": 5})
    assert chunks.load(spark, path).count() == 20
    chunks.save(Source("s", df.where("x < 3"), ["x"]), path, {})
    assert rows(chunks.load(spark, path)) == rows(df.where("x < 3")) and len(os.listdir(path + "/shards")) > 1
    chunks.save(Source("s", df.limit(0), ["x"]), path, {})
    assert chunks.load(spark, path).count() == 0
    with pytest.raises(ValueError, match="no array holds"):
        chunks.save(Source("s", df.withColumn("v", F.lit("text")), ["x"]), path, {})
