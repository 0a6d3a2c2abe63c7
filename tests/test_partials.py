"""Partial summaries: any cutting into blocks gives the whole's summary; ranks are off by no more than stated."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.operators import partials, stats
from meshframe.sources.grid import Source
from meshframe.streaming import incremental


def source(df):
    return Source("s", df, ["i"], features=["v", "w"])


def table(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, float("nan"), math.inf]) if i % 10 == 0 else rng.lognormvariate(0, 2), rng.gauss(-5, 3)) for i in range(n)]
    return spark.createDataFrame(rows, "i long, v double, w double").repartition(5)


def test_blocks_merge_to_the_whole(spark):
    df = table(spark)
    whole = {r.feature: r for r in stats.summary(source(df), exact=True, coordinates=False).collect()}
    blocks = partials.partial(source(df.withColumn("i", F.col("i"))), 65000)
    cut = [partials.partial(source(df.where(F.pmod("i", F.lit(7)) == b)), 65000) for b in range(7)]
    several = cut[0]
    for c in cut[1:]:
        several = several.unionByName(c)
    for found in (partials.merged(blocks), partials.merged(several), partials.merged(partials.merged(several).unionByName(partials.partial(source(df.limit(0)), 65000)))):
        for r in partials.summary_of(found).collect():
            want = whole[r.feature]
            for c in ("mean", "std", "min", "max", "logstd"):
                assert getattr(r, c) == pytest.approx(getattr(want, c), rel=1e-9, nan_ok=True) if getattr(want, c) is not None else getattr(r, c) is None
            assert r.null == want.null
            values = np.sort([x[0] for x in df.select(r.feature).collect() if x[0] is not None and math.isfinite(x[0])])
            for p in stats.PERCENTS:
                assert getattr(r, "median" if p == 50 else f"p{p}") == values[math.ceil(len(values) * p / 100) - 1]


@pytest.mark.parametrize("k", [200, 1000])
def test_ranks_after_many_merges(spark, k):
    df = spark.range(60_000).select(F.col("id").alias("i"), (F.rand(4) ** 3).alias("v"), F.rand(9).alias("w"))
    by_block = df.withColumn("v", F.col("v"))
    parts = partials.partial(Source("s", by_block.withColumn("b", F.pmod("i", F.lit(40))), ["i", "b"], features=["v", "w"]), k, by=["b"])
    assert parts.count() == 80
    out = partials.summary_of(partials.merged(parts.drop("b"))).collect()
    for r in out:
        values = np.sort([x[0] for x in df.select(r.feature).collect()])
        off = [abs(np.searchsorted(values, getattr(r, "median" if p == 50 else f"p{p}"), "right") / len(values) - p / 100) for p in stats.PERCENTS]
        assert max(off) <= 1.5 * partials.rank_error(k)


def test_store_counts_each_increment_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(partials, "FAN", 3)
    df = table(spark, 400)
    store = partials.SummaryStore(spark, str(tmp_path / "store"), 2000)
    for n in (0, 1, 1, 2, 0, 3, 4, 2, 5):
        store.add(source(df.where(F.pmod("i", F.lit(6)) == n)), f"b{n}")
    assert len(store._tables()) <= 3 and store._counted() >= {f"b{n}" for n in range(6)}
    got, want = ({r.feature: r.asDict() for r in x.collect()} for x in (store.summary(), partials.summary_of(partials.partial(source(df), 2000))))
    for f in want:
        numbers = {k: v for k, v in want[f].items() if isinstance(v, float)}
        assert {k: got[f][k] for k in numbers} == pytest.approx(numbers, rel=1e-9) and got[f]["null"] == want[f]["null"]
    again = partials.SummaryStore(spark, str(tmp_path / "store"), 2000)
    assert again.merged().agg(F.sum("n"), F.sum("missing")).first()[0:2] == (760, 40)
    with pytest.raises(ValueError):
        store.add(source(df), "merged~x")


def test_stream_into_summaries(spark, tmp_path):
    df = table(spark, 300)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    store = partials.SummaryStore(spark, str(tmp_path / "store"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), df.schema)
    for _ in range(2):
        partials.into_summaries(stream, store, ["i"], ["v", "w"], str(tmp_path / "cp"))
    assert store.merged().agg(F.sum("n"), F.sum("missing")).first()[0:2] == (570, 30)
    df.limit(10).write.mode("append").parquet(str(tmp_path / "in"))
    partials.into_summaries(stream, store, ["i"], ["v", "w"], str(tmp_path / "cp"))
    assert store.merged().agg(F.sum(F.col("n") + F.col("missing"))).first()[0] == 620


def ranked(df, feature):
    values = np.sort([x[0] for x in df.select(feature).collect() if x[0] is not None and math.isfinite(x[0])])
    return [values[-(-len(values) * p // 100) - 1] for p in stats.PERCENTS]


def percentiles(row):
    return [row["median" if p == 50 else f"p{p}"] for p in stats.PERCENTS]


def test_store_with_values_is_exact_above_its_sketches(spark, tmp_path, monkeypatch):
    """Far more values than a sketch keeps, increments that come again and merges: each percentile has just its rank."""
    monkeypatch.setattr(partials, "FAN", 3)
    df = table(spark, 6000).withColumn("w", F.round("w")).cache()
    store = partials.SummaryStore(spark, str(tmp_path / "store"), 50, values=True)
    for n in (0, 1, 1, 2, 0, 3, 4, 2, 5):
        store.add(source(df.where(F.pmod("i", F.lit(6)) == n)), f"b{n}")
    got = {r.feature: r for r in store.summary().collect()}
    assert {f: percentiles(r) for f, r in got.items()} == {f: ranked(df, f) for f in ("v", "w")}
    rough = {r.feature: r for r in partials.summary_of(store.merged()).collect()}
    assert percentiles(rough["v"]) != percentiles(got["v"])
    assert [(r["mean"], r["null"], r["max"]) for _, r in sorted(got.items())] == [(r["mean"], r["null"], r["max"]) for _, r in sorted(rough.items())]


def test_store_with_values_of_nothing(spark, tmp_path):
    store = partials.SummaryStore(spark, str(tmp_path / "store"), values=True)
    store.add(source(table(spark, 50).where("i < 0")), "none")
    store.add(source(table(spark, 50).withColumn("w", F.lit(None).cast("double"))), "some")
    got = {r.feature: r for r in store.summary().collect()}
    assert percentiles(got["w"]) == [None] * 99 and got["w"]["null"] == 50 and percentiles(got["v"]) == ranked(table(spark, 50), "v")


def test_spread_far_from_zero(spark):
    """Values whose squares no double holds to the last place keep their deviation, in one partial and over blocks."""
    df = spark.range(3000).select(F.col("id").alias("i"), (F.pmod("id", F.lit(10)) + F.col("id") / 1000 + 1e9 / 7).alias("v"), (F.pmod("id", F.lit(7)) + 1e8).alias("w"))
    parts = partials.partial(Source("s", df.withColumn("b", F.expr("int(sqrt(i) / 7)")), ["i", "b"], features=["v", "w"]), by=["b"]).drop("b")
    for found in (partials.partial(source(df)), partials.merged(parts)):
        got = {r.feature: r["std"] for r in partials.summary_of(found).collect()}
        assert got == pytest.approx({f: np.std([x[0] for x in df.select(f).collect()]) for f in ("v", "w")}, rel=1e-6)
