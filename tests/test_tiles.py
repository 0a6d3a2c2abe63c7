"""Windows cut from tiles against windows of exploded centres."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from meshframe.operators import validity, windows
from meshframe.sources.grid import Source


def cells(spark, shape, missing=0.2, seed=1):
    rng = random.Random(seed)
    rows = []
    for n in range(shape[0] * shape[1] * shape[2]):
        x, y, t = n // (shape[1] * shape[2]), n // shape[2] % shape[1], n % shape[2]
        if rng.random() > missing or 0 in (x, y, t):
            rows.append((float(x * x), float(y), datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=t), None if n % 11 == 0 else n, f"s{n}", n / 3))
    return spark.createDataFrame(rows, "x double, y double, t timestamp, a long, b string, c double")


@pytest.mark.parametrize("window", [{"x": 1}, {"x": (2, 1), "y": 1}, {"x": 1, "y": (0, 2), "t": (1, 0)}, {"y": None, "x": 1}])
def test_tiles_equal_exploded_windows(spark, monkeypatch, window):
    monkeypatch.setattr(windows, "LEAST_STEPS", 2)
    monkeypatch.setattr(windows, "TILE_STEPS", 1)
    monkeypatch.setattr(windows, "BATCH_CELLS", 40)
    s = Source("s", cells(spark, (7, 6, 4)), ["x", "y", "t"], features=["a", "c"], window=window, valid_percent={tuple(window): 0.0})
    c = validity.centers(s)
    found = {}
    for name, most in (("tiles", 0), ("exploded", 10**9)):
        monkeypatch.setattr(windows, "EXPLODED", most)
        found[name] = sorted(map(tuple, windows.gather(s, c).collect()))
    assert found["tiles"] == found["exploded"] and found["tiles"]


def test_edges_and_repeats(spark):
    """Windows beyond the array are null there; a centre without a cell and one that comes twice are answered."""
    axis = spark.range(5).select(F.col("id").alias("i"), (F.col("id") * 10).cast("string").alias("v"))
    asked = spark.createDataFrame([(0,), (4,), (4,), (9,), (-3,)], "i long")
    got = sorted(map(tuple, windows.from_tiles(axis, asked, {"i": (2, 1)}, ["v"]).collect()))
    none = [None] * 4
    assert got == [(-3, none), (0, [None, None, "0", "10"]), (4, ["20", "30", "40", None]), (4, ["20", "30", "40", None]), (9, none)]
    assert windows.from_tiles(axis.limit(0), asked.limit(0), {"i": (2, 1)}, ["v"]).collect() == []


def test_what_is_exchanged_does_not_follow_the_window(spark):
    """Rows that meet in tiles for windows of 3 x 3 and of 21 x 21: within a factor of 2 (exploded, it is 49)."""
    df = spark.range(300 * 300).select((F.col("id") / 300).cast("long").alias("i"), (F.col("id") % 300).alias("j"), F.col("id").alias("v"))
    rows = {}
    for w in (1, 10):
        rows[w] = windows.tiled(df, df, {"i": (w, w), "j": (w, w)}, ["v"])[0].count()
    assert rows[10] < 2 * rows[1] and rows[10] < 3 * df.count()
    p = windows.from_tiles(df, df, {"i": (10, 10), "j": (10, 10)}, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange ") == 1 and "Join" not in p
