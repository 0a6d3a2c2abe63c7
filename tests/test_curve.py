"""Cells along a curve: boxes open few files, and find all their cells."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from meshframe.sources import curve
from meshframe.sources.grid import Source


def test_keys_and_ranges(spark):
    """Keys are the bits in turn; ranges of a box hold just its cells while there may be as many as needed."""
    bits = 3
    df = spark.range(64).select((F.col("id") / 8).cast("long").alias("x"), (F.col("id") % 8).alias("y"))
    keys = {(r.x, r.y): r.k for r in df.withColumn("k", curve.interleaved([F.col("x"), F.col("y")], bits)).collect()}
    assert sorted(keys.values()) == list(range(64)) and keys[(1, 0)] == 2 and keys[(0, 1)] == 1 and keys[(7, 7)] == 63
    rng = random.Random(1)
    for _ in range(40):
        a, b, c, d = (rng.randrange(8) for _ in range(4))
        low, high = (min(a, b), min(c, d)), (max(a, b), max(c, d))
        inside = {k for (x, y), k in keys.items() if low[0] <= x <= high[0] and low[1] <= y <= high[1]}
        exact = curve.key_ranges(low, high, bits, 1000)
        assert {k for p, q in exact for k in range(p, q + 1)} == inside
        few = curve.key_ranges(low, high, bits, 3)
        assert len(few) <= 3 and inside <= {k for p, q in few for k in range(p, q + 1)}
        assert all(q < p for (_, q), (p, _) in itertools.pairwise(few))


def test_a_small_box_opens_few_files(spark, tmp_path):
    """A box of 1 % of an even square opens at most 5 % of the files, whichever way it lies."""
    df = spark.range(120_000).select((F.rand(1) * 100).alias("x"), (F.rand(2) * 1000).alias("y"), F.col("id").alias("v"))
    c = curve.save(Source("s", df, ["x", "y"]), str(tmp_path / "c"), 400)
    cells = c.read().cache()
    files = c.manifest().count()
    assert files > 200 and c.manifest().agg(F.sum("rows")).first()[0] == 120_000 == cells.count()
    for x, y in ((13.0, 377.0), (45.0, 451.0), (88.0, 20.0)):
        box = {"x": (x, x + 10), "y": (y, y + 100)}
        got = c.read(box)
        assert len(got.inputFiles()) <= files * 0.05
        assert sorted(r.v for r in got.collect()) == sorted(r.v for r in cells.where(f"x between {x} and {x + 10} and y between {y} and {y + 100}").collect())
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    p = c.read({"x": (13.0, 14.0), "y": (3.0, 9.0)})._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(curve_key" in p and "GreaterThanOrEqual(x,13.0)" in p


@pytest.mark.parametrize("dims", [["x"], ["x", "t", "n"]])
def test_boxes_of_all_kinds(spark, tmp_path, dims):
    """Open ends, times, single cells, boxes outside, repeated cells; cells that lie nowhere are left out."""
    df = spark.range(600).selectExpr("cast(id % 23 as double) x", "timestamp_micros(cast(id % 7 as bigint) * 3600000000) t", "cast(id % 5 as int) n", "id v")
    odd = spark.sql("select cast(null as double) x, timestamp_micros(0) t, 1 n, -1L v union all select double('nan'), timestamp_micros(0), 1, -2L")
    path = str(tmp_path / "c")
    curve.save(Source("s", df.unionByName(odd), dims, features=[c for c in df.columns if c not in dims]), path, 50)
    c = curve.Curve.open(spark, path)
    for box, where in (({"x": (3.0, None)}, "x >= 3"), ({"x": (None, 2.0)}, "x <= 2"), ({"x": (5.0, 5.0)}, "x = 5"), ({"x": (99.0, 100.0)}, "false"), ({}, "true")):
        assert sorted(r.v for r in c.read(box).collect()) == sorted(r.v for r in df.where(where).collect())
    if "t" in dims:
        lo, hi = spark.sql("select timestamp_micros(3600000000), timestamp_micros(4 * 3600000000)").first()
        got = c.read({"t": (lo, hi), "n": (1, 2)})
        assert sorted(r.v for r in got.collect()) == sorted(r.v for r in df.where("v % 7 between 1 and 4 and n between 1 and 2").collect())


def test_empty_and_flat(spark, tmp_path):
    none = spark.createDataFrame([], "x double, y double, v long")
    assert curve.save(Source("s", none, ["x", "y"]), str(tmp_path / "a")).read({"x": (0.0, 1.0)}).count() == 0
    flat = spark.range(50).selectExpr("1.0d x", "2.0d y", "id v")
    c = curve.save(Source("s", flat, ["x", "y"]), str(tmp_path / "b"), 10)
    assert c.read({"x": (1.0, 1.0)}).count() == 50 and c.read({"x": (1.1, 2.0)}).count() == 0
