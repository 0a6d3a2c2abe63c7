"""Draws by deficit and states over streams."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshframe.operators import batching, policies
from meshframe.streaming import incremental


def drawn(df, **kw):
    return sorted(batching.deficit_batches(df, "b", "i", 50, **kw).collect(), key=lambda r: r.row)


def table(spark, counts):
    rows = [(b, n) for b, c in counts.items() for n in range(c)]
    rows = [(b, i) for i, (b, _) in enumerate(rows)]
    return spark.createDataFrame(rows, "b string, i long").repartition(5)


def test_bins_keep_to_their_shares(spark):
    """No prefix is off by more than a row a bin until a bin is exhausted; then the rest go on in their own shares."""
    counts = {"x": 3000, "y": 900, "z": 40, None: 500}
    weights = {"x": 3, "y": 2, "z": 1, None: 1}
    rows = drawn(table(spark, counts), weights=weights)
    assert [r.row for r in rows] == list(range(4440)) and [r.batch for r in rows] == [n // 50 for n in range(4440)]
    seen, left = Counter(), 40 * 7
    for n, r in enumerate(rows[:left], 1):
        seen[r.b] += 1
        assert all(abs(seen[b] - n * w / 7) <= 1.5 for b, w in weights.items())
    later = Counter(r.b for r in rows[400:2000])  # z is exhausted
    assert later["z"] == 0 and all(abs(later[b] / 1600 - weights[b] / 6) < 0.01 for b in ("x", "y", None))
    assert len({(r.b, r.i) for r in rows}) == 4440


def test_former_epochs_and_left_out_bins(spark):
    df = table(spark, {"x": 200, "y": 200, "z": 5})
    rows = drawn(df, drawn={"x": 100}, weights={"z": 0})
    assert Counter(r.b for r in rows[:100]) == {"y": 100} and Counter(r.b for r in rows) == {"x": 200, "y": 200}
    assert drawn(df, seed=1) == drawn(df.repartition(2), seed=1) != drawn(df, seed=2)
    assert drawn(df.limit(0)) == [] and drawn(df, weights={"x": 0, "y": 0, "z": 0}) == []


def test_weights_of_bins_and_rows(spark):
    """bin_weights say what comes sooner; heavy rows of a bin come before light ones, in proportion."""
    df = table(spark, {"x": 4000, "y": 1000}).withColumn("w", F.when(F.col("i") % 4 == 0, 9.0).when(F.col("i") % 4 == 1, 0.0).otherwise(1.0))
    rows = drawn(df, row_weight="w")
    assert all(r.i % 4 != 1 for r in rows) and len(rows) == 3750
    first = [r for r in rows if r.b == "x"][:300]
    assert 0.72 < sum(r.i % 4 == 0 for r in first) / 300 < 0.9
    bins = spark.createDataFrame([("x", 90, 1.0), ("y", 10, 0.5), ("none", 0, 0.0)], "bin string, drawn long, share double")
    weights = {r.bin: round(1000 * r.weight) for r in policies.bin_weights(bins, 100).collect()}
    some = Counter(r.b for r in drawn(df, weights=weights)[:600])
    assert some["y"] / 600 == pytest.approx(weights["y"] / (weights["x"] + weights["y"]), abs=0.01)


def test_numbers_within_groups(spark):
    df = spark.createDataFrame([(g, i, random.Random(i).random()) for i in range(300) for g in (None, "a")], "g string, i long, x double")
    got = batching.numbered_within(df, ["g"], F.col("x"), ["i"]).collect()
    for g in (None, "a"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.x, r.i))
        assert [r["rank"] for r in mine] == list(range(300))


def _events(n=240, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=10 * i), float(rng.randrange(100))) for i in range(n)]


def _run(spark, tmp_path, groups, ttl=None):
    out = str(tmp_path / "out")
    for g in groups:
        spark.createDataFrame([(k, t.to_pydatetime(), v) for k, t, v in g], "k string, t timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.file_stream(spark, str(tmp_path / "in"), "k string, t timestamp, v double")
        found = incremental.keyed_recurrence(stream, "k", "t", "v", lambda x, s: 0.5 * s + x, 1.0, "3 hours", ttl)
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return sorted(((r.k, r.t, r.v, r.state) for r in spark.read.parquet(out).collect()), key=repr)


def _plain(events, until, ttl=None):
    state, last, out = {}, {}, []
    for k, t, v in sorted(events, key=lambda e: (e[1], e[2])):
        if t >= until:
            continue
        if ttl and k in last and t - last[k] > ttl:
            state[k] = 1.0
        state[k], last[k] = 0.5 * state.get(k, 1.0) + v, t
        out.append((k, t.to_pydatetime(), v, state[k]))
    return sorted(out, key=repr)


def test_recurrence_over_shuffled_files_and_restarts(spark, tmp_path):
    events = _events()
    rng = random.Random(1)
    groups = []
    for i in range(0, 240, 12):  # two hours a file, rows in any order
        some = events[i : i + 12]
        rng.shuffle(some)
        groups.append(some)
    got = _run(spark, tmp_path, [[e for g in groups[:7] for e in g], [e for g in groups[7:] for e in g]])
    want = _plain(events, events[-1][1] - pd.Timedelta(hours=3))
    assert got == want and len(want) > 200


def test_keys_that_rest_begin_anew(spark, tmp_path):
    t0 = pd.Timestamp("2024-01-01")
    at = lambda h: t0 + pd.Timedelta(hours=h)
    events = [("a", at(0), 4.0), ("a", at(1), 8.0), ("b", at(1), 2.0), ("a", at(30), 6.0), ("b", at(30), 1.0), ("b", at(33), 5.0), ("z", at(60), 0.0)]
    got = _run(spark, tmp_path, [events[:3], events[3:6], events[6:]], "10 hours")
    assert got == _plain(events, at(57), pd.Timedelta(hours=10))
