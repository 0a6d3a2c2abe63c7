"""Statistics, transforms, metrics, batches, archives, graphs, regions, halos and streams."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.functions import metrics as M
from meshframe.functions import scalar as X
from meshframe.functions.transforms import NAMED, Transform, parse, propagate, quantile_table
from meshframe.operators import archive, batching, halo, regions, stats
from meshframe.plans.graph import Graph, Node, lstm, recurrence, score, select_flat
from meshframe.plans.specs import IOSpec, StructuredDataset, TensorSpec, sources_from, span_of
from meshframe.sources.grid import Source, synthetic
from meshframe.streaming import incremental

# metrics


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(float(x + d), (0.05 if d else 0.1) * x) for x in range(10) for d in (1, 0)], "t double, p double")


@pytest.mark.parametrize("name,want", [("mse", 29.178125), ("unbiased_rmse", 5.401677), ("nse", -2.432720), ("relative_error", -0.8873224), ("alpha_nse", 0.0869203), ("beta_nse", -1.599224)])
def test_metric_values(spark, name, want):
    t = np.array([(x + 1, x) for x in range(10)], float).ravel()
    p = np.array([(0.05 * x, 0.1 * x) for x in range(10)], float).ravel()
    df = spark.createDataFrame(list(zip(t.tolist(), p.tolist())), "t double, p double")
    got = M.Metrics().evaluate(df, "t", "p", [name]).first()[0]
    plain = {
        "mse": ((t - p) ** 2).mean(), "unbiased_rmse": math.sqrt(((t - p) ** 2).mean()), "nse": 1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum(),
        "relative_error": np.mean([0.0 if a == b == 0 else (b - a) / a for a, b in zip(t, p)]), "alpha_nse": p.std() / t.std(), "beta_nse": (p.mean() - t.mean()) / t.std(),
    }[name]
    assert got == pytest.approx(plain, abs=1e-9) and got == pytest.approx(want, abs=1e-5)


def test_metric_identities(spark):
    df = spark.range(365).select(F.col("id").cast("double").alias("t"), F.col("id").cast("double").alias("p"))
    r = M.Metrics().evaluate(df, "t", "p", ["mse", "nse", "kge", "pearsonr", "r2", "lkg", "fluctuation_complexity"]).first()
    assert r.mse == 0 and r.nse == 1 and r.kge == pytest.approx(1) and r.pearsonr == pytest.approx(1) and r.r2 == pytest.approx(1) and r.lkg == pytest.approx(0) and r.fluctuation_complexity is None
    assert df.agg(M.metric_entropy(F.col("t"), compat=True)).first()[0] == pytest.approx(0.0219178, abs=1e-6)
    assert df.limit(1).agg(M.kge(F.col("t"), F.col("p"))).first()[0] is None
    own = M.Metrics()
    own.register("bias", lambda t, p: F.avg(p - t))
    assert own.evaluate(df, "t", "p", ["bias"]).first()[0] == 0 and "bias" in own.names()
    with pytest.raises(KeyError):
        own.get("nothing")
    assert M.Metrics.from_json(own.to_json(own.evaluate(df, "t", "p", ["mse"]))) == {"mse": 0.0}


def test_loss_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert df.agg(M.masked_loss(F.col("x"))).first()[0] == 0.0
    assert spark.createDataFrame([(0.0, 1.0)], "t double, p double").agg(M.relative_error(F.col("t"), F.col("p"))).first()[0] == math.inf


# transforms


STATS = {
    "feat_1": {"mean": 5.5, "std": 2.0, "min": -3.0, "max": 20.0, "median": 6.0, "p25": 2.0, "p75": 8.0},
    "feat_2": {"mean": -30.0, "std": 10.123, "min": -42.0, "max": 1000.0, "median": 65.0, "p25": 0.0, "p75": 321.0},
}
DATA = [(2.0, -20.0), (6.0, 3.0), (-1.0, 999.0), (0.5, 0.0123)]
BOTH_WAYS = sorted(set(NAMED) - {"clip"})


@pytest.mark.parametrize("spec", [*BOTH_WAYS, *[f"{a},{b}" for a, b in itertools.product(["standardize", "robust", "normalize", "asinh", "logexpp1"], ["normalize", "iqrnorm", "asinh", "identity"])]])
def test_inverse_undoes_forward(spark, spec):
    data = [(abs(a) + 0.1, abs(b) + 0.1) for a, b in DATA] if "logexp" in spec.split(",") else DATA
    df = spark.createDataFrame(data, "feat_1 double, feat_2 double")
    t = Transform(STATS, spec)
    for got, want in zip(t.apply(t.apply(df), inverse=True).collect(), data):
        assert got.feat_1 == pytest.approx(want[0], abs=1e-4) and got.feat_2 == pytest.approx(want[1], abs=1e-4)


def test_forward_values_match_numpy(spark):
    x = np.array([-2.5, 0.1, 3.0, 19.0])
    df = spark.createDataFrame([(float(v),) for v in x], "feat_1 double")
    for name, make in NAMED.items():
        data = np.abs(x) if name == "logexp" else x
        own = df.select(F.abs("feat_1").alias("feat_1")) if name == "logexp" else df
        got = [r[0] for r in own.select(make(STATS["feat_1"]).forward(F.col("feat_1"))).collect()]
        assert got == pytest.approx(make(STATS["feat_1"]).numeric(data).tolist(), abs=1e-9), name


def test_chain_statistics():
    s = dict(STATS["feat_1"])
    after = propagate(NAMED["standardize"](s), s)
    assert after["mean"] == pytest.approx(0, abs=1e-5) and after["std"] == pytest.approx(1, abs=1e-5)
    bent = propagate(NAMED["asinh"](s), s)
    assert bent["mean"] == pytest.approx((bent["p25"] + 2 * bent["median"] + bent["p75"]) / 4)
    from meshframe.functions.transforms import Pair

    with pytest.raises(ValueError):
        propagate(Pair(lambda x: -x, lambda y: -y, lambda a: -a), s)


def test_specs_of_features(spark):
    df = spark.createDataFrame(DATA, "feat_1 double, feat_2 double").withColumn("other", F.lit(1.0))
    t = Transform(STATS, {"feat_1": "standardize&identity", "*": "normalize|minim=0|maxim=1"})
    out = t.apply(df)
    assert out.columns == ["feat_1_0", "feat_1_1", "feat_2", "other"] and out.first().feat_1_1 == 2.0
    assert parse("clip|minim=1,identity") == [("clip", {"minim": 1.0}), ("identity", {})]
    with pytest.raises(KeyError):
        Transform(STATS, {"feat_1": "identity"}).forward(F.col("feat_2"), "feat_2")
    with pytest.raises(NotImplementedError):
        Transform(STATS, "clip").inverse(F.col("feat_1"), "feat_1")
    with pytest.raises(ValueError):
        parse("nothing")
    pair = Transform(STATS, (lambda x, f: x + 1, lambda y, f: y - 1))
    assert [r[0] for r in pair.apply(pair.apply(df), inverse=True).select("feat_1").collect()] == [a for a, _ in DATA]
    assert Transform(STATS, "standardize", drop=["feat_1"]).apply(df).first().feat_1 == 2.0


def test_degenerate_quantiles():
    flat = {"min": 0.0, "max": 9.0} | {("median" if p == 50 else f"p{p}"): (0.0 if p < 80 else float(p)) for p in (1, 5, 10, 20, 30, 40, 50, 60, 70, 80)}
    xs, ys = quantile_table(flat, "uniform")
    assert xs == sorted(set(xs)) and ys == sorted(ys) and len(xs) == len(ys)


# statistics


def test_summary_by_rank(spark):
    """A coarse sketch only cuts the values into slices; percentiles have just their rank, with many ties and in several features."""
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(round(y)) if i % 11 else None) for i, (x, y) in enumerate(zip(rng.lognormal(2, 3, 5000), rng.normal(0, 4, 5000), strict=True))]
    df = spark.createDataFrame(rows, "x int, v double, w double").withColumn("none", F.lit(None).cast("double"))
    got = {r.feature: r for r in stats.summary(Source("s", df, ["x"]), accuracy=20, ranked=True).collect()}
    assert set(got) == {"v", "w", "none", "x"}
    for f, values in (("v", [r[1] for r in rows]), ("w", [r[2] for r in rows if r[2] is not None]), ("x", [r[0] for r in rows])):
        values = np.sort(values)
        assert [got[f]["median" if p == 50 else f"p{p}"] for p in stats.PERCENTS] == [values[-(-len(values) * p // 100) - 1] for p in stats.PERCENTS]
    assert got["none"].median is None and got["none"]["null"] == 5000
    one = stats.summary(Source("s", df.limit(1), ["x"], features=["v"]), coordinates=False, ranked=True).first()
    assert one.p1 == one.p99 == rows[0][1]


def test_summary(spark):
    rng = np.random.default_rng(1)
    v = rng.lognormal(size=200)
    df = spark.createDataFrame([(i, float(x) if i % 9 else (None if i % 2 else float("nan"))) for i, x in enumerate(v)], "x int, v double")
    s = stats.summary(Source("s", df, ["x"])).where("feature = 'v'").first()
    kept = np.array([x for i, x in enumerate(v) if i % 9])
    assert s.mean == pytest.approx(kept.mean()) and s.std == pytest.approx(kept.std()) and s["null"] == 200 - len(kept) and s.logstd == pytest.approx(np.log(kept).std())
    assert s.p25 == pytest.approx(np.percentile(kept, 25)) and s.median == pytest.approx(np.median(kept))
    sparse = Source("s", df.where("x % 2 = 0"), ["x"], sparse=True, match_radius={"x": 1})
    assert stats.sparsity(sparse).first()[0] == pytest.approx(1 - len([i for i in range(0, 200, 2) if i % 9]) / 100)
    assert stats.max_resolution(Source("s", df, ["x"])) == {"x": 1.0}


def test_induced_bins():
    q, p = [0, 1, 2, 4, 8, 16], [0, 0.2, 0.4, 0.6, 0.8, 1]
    assert stats.induced_bins(q, p, 4, 0.0) == pytest.approx([0, 4, 8, 12, 16])
    assert stats.induced_bins(q, p, 5, 1.0) == pytest.approx(q)
    middle = stats.induced_bins(q, p, 4, 0.25)
    assert middle == sorted(middle) and 0 < middle[1] < 4 and middle[-1] == 16
    assert middle == pytest.approx([0, 2.8568, 6.6029, 11.1515, 16], abs=0.02)


def test_histogram_and_edges(spark):
    df = spark.createDataFrame([(float(x), "ab"[i % 2]) for i, x in enumerate([0, 1, 1.5, 2, 5, 9, 10, 11])], "v double, g string")
    assert [r.n for r in stats.histogram(df, "v", [0, 1, 5, 8, 10]).orderBy("bin").collect()] == [1, 3, 1, 2]
    assert sum(r.n for r in stats.histogram(df, "v", [0, 5, 10], ["g"]).collect()) == 7
    assert stats.nonempty_bins(df, {"v": [0, 1, 2, 3, 4, 5, 6]}).count() == 4
    s = [Source("a", spark.range(11).toDF("x"), ["x"]), Source("b", spark.range(0, 21, 2).toDF("x"), ["x"])]
    assert stats.barycenter_edges(s, "x", 2) == [0, 7.5, 15]


# batches


def test_batches_are_complete(spark):
    df = spark.range(1000)
    for size in (1, 10, 64):
        got = list(batching.Batches(df, "id", size, "id", seed=4))
        assert len(got) == -(-1000 // size) and sorted(x for b in got for x in b["id"]) == list(range(1000))
    ordered = list(batching.Batches(df, "id", 100, "id", seed=None))
    assert [x for b in ordered for x in b["id"]] == list(range(1000))
    twice = itertools.islice(iter(batching.Batches(df.limit(20), "id", 10, "id", repeat=True)), 4)
    assert len(list(twice)) == 4


def test_nested_structure(spark, tmp_path):
    df = spark.range(20).select("id", *[(F.col("id") * i).alias(f"f{i}") for i in range(4)])
    structure = [["f0"], [["f1", "f2"], ["f3"]]]
    b = batching.Batches(df, "id", 2, structure, seed=None)
    first = next(iter(b))
    assert first == [{"f0": [0, 0]}, [{"f1": [0, 1], "f2": [0, 2]}, {"f3": [0, 3]}]]
    b.save(str(tmp_path / "b"))
    assert next(batching.Batches.load(spark, str(tmp_path / "b"), structure)) == first


def test_strata_and_configs(spark):
    df = spark.range(300).select("id", (F.col("id") % 100).cast("double").alias("v"))
    out = batching.stratified(df, "id", [{"v": (0, 10)}, {"v": (10, 90)}, {"v": (500, 600)}], 8).collect()
    by = {}
    for r in out:
        by.setdefault((r.batch, r.config), []).append(r.id)
    assert {len(v) for v in by.values()} == {8} and len(by) == 2 * (30 // 8)
    bins = batching.sampling_bins({("a", "b"): [[0, 1, 2], [0, 5]], "c": 2}, lambda f, n: [0, 1, 2])
    assert bins == [{"a": (0, 1), "b": (0, 5)}, {"a": (1, 2), "b": (0, 5)}, {"c": (0, 1)}, {"c": (1, 2)}]
    a, b = spark.range(10).select(F.col("id"), F.lit(5).alias("x")), spark.range(7).select(F.col("id"), F.lit(6).alias("y"))
    m = batching.multi_config([a, b], "id", 4)
    assert m.where("config = 0").count() == 8 and m.where("config = 1").count() == 7 and m.where("config = 1 and x is not null").count() == 0
    assert batching.block_size(10, 16, 3) == 53 and batching.block_size(0, 16, 3) == 1


# archive


def axis(spark, values, name):
    return spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], f"{name} double, idx long")


def test_archive_generations(spark, tmp_path):
    axes = {"x": axis(spark, [0, 10, 20], "x"), "y": axis(spark, [0, 1], "y")}
    path = str(tmp_path / "archive")
    a = archive.Archive(spark, path, axes, ["v"])
    rng = random.Random(1)
    rows = [(rng.uniform(-3, 24), rng.uniform(0, 1), rng.choice([rng.gauss(0, 1), float("nan"), None, math.inf])) for _ in range(90)]
    for i in range(3):
        a.stage(spark.createDataFrame(rows[i * 30 : i * 30 + 30], "x double, y double, v double"))
        a.flush()
    sums = {}
    for x, y, v in rows:
        if v is not None and math.isfinite(v):
            k = (min([0, 10, 20], key=lambda c: (abs(c - x), c)), min([0, 1], key=lambda c: (abs(c - y), c)))
            sums.setdefault(k, []).append(v)
    got = {(r.x, r.y): r.v for r in a.read().collect()}
    assert got == pytest.approx({k: np.mean(v) for k, v in sums.items()}) and a.generation() == 2
    with pytest.raises(FileExistsError):
        archive.Archive(spark, path, axes, ["v"])
    archive.Archive(spark, path, axes, ["v"], overwrite=True)


# graph


def test_graph(spark):
    g = Graph()
    g.add_node("double", Node(lambda c: c["a"] * 2, ["a"], ["b"]))
    g.add_node("sum", Node(lambda c: {"total": c["b"] + c["a"]}, grouped=False))
    for e in (("input", "double", ["a"]), ("double", "sum"), ("input", "sum", ["a"]), ("sum", "output")):
        g.add_edge(*e)
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    assert [r.total for r in g.run(df).collect()] == [3, 6]
    for bad in (("output", "sum"), ("sum", "input"), ("sum", "double")):
        with pytest.raises(ValueError):
            g.add_edge(*bad)
    with pytest.raises(ValueError):
        g.add_node("sum", Node(dict))
    outer = Graph("outer")
    outer.add_node("inner", g)
    outer.add_edge("input", "inner", ["x"], rename={"x": "a"})
    outer.add_edge("inner", "output", rename={"total": "y"})
    named = df.withColumnRenamed("a", "x")
    want = [r.y for r in outer.run(named).collect()]
    assert want == [3, 6] and "inner/double" in outer and "nothing" not in outer and outer.find("double") is g.nodes["double"]
    registry = {"double": g.nodes["double"], "sum": g.nodes["sum"]}
    again = Graph.from_json(outer.to_json(registry), registry)
    assert [r.y for r in again.run(named).collect()] == want
    outer.expand("inner")
    assert [r.y for r in outer.run(named).collect()] == want and "inner.double" in outer.summary()
    lone = Graph()
    lone.add_node("n", Node(dict))
    with pytest.raises(ValueError):
        lone({"a": F.lit(1)})


def test_edges_choose_and_group(spark):
    g = Graph()
    g.add_node("n", Node(lambda c: {"out": c["A"]["x"] + c["y"]}, grouped=True))
    g.add_edge("input", "n", ["y"], labels=["A"])
    g.add_edge("n", "output")
    df = spark.createDataFrame([(1, 10, 100)], "A__x int, y int, B__x int")
    assert g.run(df).first()[0] == 11
    h = Graph()
    h.add_edge("input", "output", ["a", "gone"])
    with pytest.warns(UserWarning):
        h({"a": F.lit(1)})
    assert str(select_flat({"a": {"b": F.lit(1)}, "c": F.lit(2)}, "b")) == str(F.lit(1))
    with pytest.raises(KeyError):
        select_flat({"a": {"b": 1}, "c": {"b": 2}}, "b")


def test_recurrence_and_lstm(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "x array<double>")
    assert df.select(recurrence(F.col("x"), F.lit(0.0), lambda v, s: s * 0.5 + v)).first()[0] == 5.25
    assert df.select(recurrence(F.col("x"), F.lit(0.0), lambda v, s: s * 0.5 + v, sequence=True)).first()[0] == [0, 1, 2.5, 5.25]
    rng = np.random.default_rng(1)
    w, u, b, x = rng.normal(size=(2, 8)), rng.normal(size=(2, 8)), rng.normal(size=8), rng.normal(size=(4, 2))
    h = c = np.zeros(2)
    for v in x:
        z = v @ w + h @ u + b
        i, f, g, o = z[:2], z[2:4], z[4:6], z[6:]
        sig = lambda a: 1 / (1 + np.exp(-a))
        c = sig(f) * c + sig(i) * np.tanh(g)
        h = sig(o) * np.tanh(c)
    df = spark.createDataFrame([(x.tolist(),)], "x array<array<double>>")
    got = df.select(lstm(F.col("x"), {"W": w.tolist(), "U": u.tolist(), "b": b.tolist()})).first()[0]
    assert got == pytest.approx(h.tolist())
    scored = score(spark.range(10), lambda: lambda pdf: pdf.assign(y=pdf["id"] * 2.0), "id long, y double")
    assert sorted(r.y for r in scored.collect()) == [2.0 * i for i in range(10)]


# specs


def test_specs(spark):
    io = IOSpec("grid/zero", ["a", "b"], {"time": 4, "lat": None})
    assert [s.name for s in io.specs()] == ["grid$zero__a", "grid$zero__b"] and io.schema()["grid$zero__a"].dataType.simpleString() == "array<array<double>>"
    t = TensorSpec("A__x", (None, 4), dims=("time",))
    assert TensorSpec.from_json(t.to_json()) == t and t.label == "A" and t.key == "x" and t.accepts(TensorSpec("y", (None, None))) and not t.accepts(TensorSpec("y", (None, 5)))
    assert span_of(4) == (2, 1) and span_of(3) == (1, 1)
    frame = synthetic(spark, {"lat": [0, 1, 2], "time": [0, 1, 2, 3]}, 2)
    got = sources_from([io_like("g", ["var_0"]), io_like("g", ["var_1", "lat"])], lambda n: (frame, ["time", "lat"]), {"lat": 3}, {"*": {"valid_percent": {"time": 1.0}}})
    assert len(got) == 1 and got[0].feature_names == ["var_0", "var_1"] and got[0].span("time") == (2, 1) and got[0].span("lat") == (1, 1)
    with pytest.raises(ValueError):
        sources_from([io_like("g", ["gone"])], lambda n: (frame, ["time", "lat"]), {"lat": 3})


def io_like(name, features):
    return IOSpec(name, features, {"time": 4, "lat": None})


def test_structured_dataset(spark):
    d = StructuredDataset(spark, np.arange(6).reshape(3, 2), [1.5, 2.5, 3.5], labels=["a", "b"])
    again = StructuredDataset.from_json(spark, d.to_json())
    assert sorted(map(str, again.frame.collect())) == sorted(map(str, d.frame.collect()))
    with pytest.raises(ValueError):
        StructuredDataset(spark, [1], [1, 2])


# halo, regions, scalars


@pytest.mark.parametrize(
    "boundary,left,right",
    [("none", [], []), ("periodic", [6, 7], [0, 1]), ("nearest", [0, 0], [7, 7]), ("reflect", [1, 0], [7, 6]), ("constant", [-1, -1], [-1, -1])],
)
def test_halo(spark, boundary, left, right):
    df = spark.range(8).select(F.col("id").alias("i"), F.col("id").alias("v"))
    out = halo.overlap(df, "i", "v", 8, 4, 2, 2, boundary, constant=-1).orderBy("block", "position").collect()
    assert [r.v for r in out if r.block == 0] == [*left, 0, 1, 2, 3, 4, 5] and [r.v for r in out if r.block == 1] == [2, 3, 4, 5, 6, 7, *right]


def test_regions(spark):
    square, small = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(8.0, 8.0), (9.0, 8.0), (9.0, 9.0)]
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (8.6, 8.2), (None, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(regions.inside(F.col("x"), F.col("y"), [square, small])).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(regions.inside(F.col("x"), F.col("y"), [square, small], largest_only=False)).collect()] == [True, False, True, False]
    assert regions.area(square) == 16 and regions.raster(spark, [square], 4, 3).where("inside").count() == 12
    names = spark.createDataFrame([(" Asia ",), ("africa",)], "n string")
    assert regions.select_regions(names, "n", ["ASIA"]).count() == 1


def test_scalars(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], -1.7)], "a array<int>, v double")
    r = df.select(X.chunks(F.col("a"), 2).alias("c"), X.tile(F.col("a"), 2).alias("t"), X.squeeze(X.expand(F.col("a"))).alias("s"), *[c.alias(n) for n, c in X.one_hot("v", [-1, 0]).items()]).first()
    assert r.c == [[1, 2], [3, 4], [5]] and r.t[0] == [1, 1] and r.s == [1, 2, 3, 4, 5] and r["v_-1"] == 1 and r.v_0 == 0
    assert X.json_safe({"a": {3, 1}, 2: float("nan"), "o": object}, as_string=False)["a"] == [1, 3]
    assert df.select(X.kelvin_to(F.lit(300.0), "C")).first()[0] == pytest.approx(26.85)
    with pytest.raises(ValueError):
        X.kelvin_to(F.lit(1), "F")
    assert X.total_bytes(spark.range(100)) > 0


# streams


def test_extents(spark):
    ax = axis(spark, range(7), "t")
    got = list(incremental.Extents("t", "steps", steps=3).all(ax))
    assert got == [{"t": (0, 3)}, {"t": (3, 6)}]
    e = incremental.Extents("t", "diff", position=2)
    assert e.next(ax) == {"t": (2, 6)} and e.next(ax) == {} and e.next(axis(spark, range(9), "t")) == {"t": (6, 8)}
    assert list(incremental.Extents("t", "fixed", extent=(1, 2)).all(ax)) == [{"t": (1, 2)}]
    assert incremental.Extents("t", lambda s, a: {"t": (9, 9)}).next(ax) == {"t": (9, 9)}
    with pytest.raises(ValueError):
        incremental.Extents("t", "steps", steps=0)


def test_stream_into_archive(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.uniform(0, 20), rng.gauss(0, 1)) for _ in range(60)]
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], "x double, v double").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    axes = {"x": axis(spark, [0, 10, 20], "x")}
    a = archive.Archive(spark, str(tmp_path / "archive"), axes, ["v"])
    stream = incremental.file_stream(spark, str(tmp_path / "in" / "*"), "x double, v double")
    incremental.into_archive(stream, a, str(tmp_path / "cp"))
    whole = incremental.micro_batches([spark.createDataFrame(rows, "x double, v double")], axes, ["v"])
    want = {r.i_x * 10.0: r.v for r in whole.collect()}
    assert {r.x: r.v for r in a.read().collect()} == pytest.approx(want) and a.generation() == 2


def test_archives_open_again(spark, tmp_path):
    axes, path = {"x": axis(spark, [0, 10, 20], "x")}, str(tmp_path / "archive")
    df = spark.createDataFrame([(1.0, 2.0), (11.0, 3.0), (2.0, 4.0)], "x double, v double")
    a = archive.Archive(spark, path, axes, ["v"])
    a.stage(df)
    a.flush(7)
    a.stage(df, "late")
    b = archive.Archive(spark, path, axes, ["v"], existing="append")
    assert b.mark() == 7 and len(b.fragments()) == 1
    b.stage(df.limit(0), "late")  # a fragment that comes again replaces its first try
    b.stage(df, "late")
    b.flush(8)
    assert {r.x: r.v for r in b.read().collect()} == {0.0: 3.0, 10.0: 3.0} and b.mark() == 8 and not b.fragments()
    assert {r.v__count for r in b.sums().collect()} == {4, 2}
    with pytest.raises(ValueError):
        archive.Archive(spark, path, axes, ["w"], existing="append")


def test_a_killed_stream_counts_nothing_twice(spark, tmp_path, monkeypatch):
    """The first run dies between staging and merging, the second inside its checkpoint's batch."""
    rows = [(float(i % 25), float(i)) for i in range(80)]
    for i in range(4):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], "x double, v double").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    axes, path = {"x": axis(spark, [0, 10, 20], "x")}, str(tmp_path / "archive")

    def run(fail):
        a = archive.Archive(spark, path, axes, ["v"], existing="append")
        if fail:
            def broken(mark=None, stream=""):
                if mark == fail:
                    raise RuntimeError("killed")
                archive.Archive.flush(a, mark, stream)
            a.flush = broken
        incremental.into_archive(incremental.file_stream(spark, str(tmp_path / "in" / "*"), "x double, v double"), a, str(tmp_path / "cp"), every=2)
        return a

    with pytest.raises(Exception, match="killed"):
        run(1)
    with pytest.raises(Exception, match="killed"):
        run(3)
    a = run(0)
    assert a.mark() == 3 and sum(r.v__count for r in a.sums().collect()) == 80
    assert sum(r.v__sum for r in a.sums().collect()) == sum(v for _, v in rows)


def test_caches_tell_data_apart(spark, tmp_path):
    from meshframe.sources.grid import cache

    def source(frame, least=0, **kw):
        return Source("s", frame, ["x"], features=["v"], preprocessors=[lambda own, df: df.where(F.col("v") >= least)], **kw)

    folder, a, b = str(tmp_path / "cache"), spark.range(5).select(F.col("id").alias("x"), F.col("id").alias("v")), spark.range(9).select(F.col("id").alias("x"), (F.col("id") * 2).alias("v"))
    assert cache(source(a), folder).frame.count() == 5 and cache(source(b), folder).frame.count() == 9
    assert cache(source(a, 3), folder).frame.count() == 2 and source(a).config_hash() == source(a).config_hash()
    assert source(a).config_hash() != source(a, invalid_value=3.0).config_hash()
    path = str(tmp_path / "files")
    a.write.parquet(path)
    before = source(spark.read.parquet(path)).config_hash()
    assert before == source(spark.read.parquet(path)).config_hash()
    b.write.mode("overwrite").parquet(path)
    assert before != source(spark.read.parquet(path)).config_hash() and cache(source(spark.read.parquet(path)), folder).frame.count() == 9


def test_frames_of_one_dim_across_stretches(spark, monkeypatch):
    from meshframe.operators import validity

    monkeypatch.setattr(validity, "STRETCH", 10)
    df = spark.range(95).select(F.col("id").alias("i_t"), (F.col("id") % 7).alias("v"))
    got = {r.i_t: r.s for r in validity.frame_sum(df, F.col("v"), "t", [], 3, 1, "s").collect()}
    assert got == {i: sum(k % 7 for k in range(max(0, i - 3), min(95, i + 2))) for i in range(95)}


def test_scratch_tables_go(spark, tmp_path):
    from meshframe.sources.store import SharedPath
    from meshframe.sources.tables import fresh_path, scratch, stash

    with scratch(spark):
        kept = stash(spark.range(5), "test")
        other = fresh_path(spark, "test")
        assert kept.count() == 5
        path = SharedPath(spark, kept.inputFiles()[0]).parent
        assert path.exists() and path.join("..", "x").name == "x" and path.parent.children()
    assert not path.exists() and not SharedPath(spark, other).exists()
    assert stash(spark.range(3), "test").count() == 3


def test_policies(spark):
    from meshframe.operators import policies

    assert [p.drop for p in policies.rotation([{"t": 1.0}], [["a"], []])] == [("a",), ()]
    with pytest.raises(ValueError):
        policies.rotation([{"t": 1.0}, {"t": 0.5}], [["a"], [], ["b"]])
    assert policies.merged_chunks([[1, 5, 1, 4, 1], [2, 2, 2, 2, 2]], [2, 2]) == [[6, 6], [4, 6]]
    items, at = policies.arranged(["bb", "a", "cc", "d"], len)
    assert items == ["a", "d", "bb", "cc"] and policies.restored(items, at) == ["bb", "a", "cc", "d"]
    entered = []

    @policies.factory
    def scaled():
        import contextlib

        @contextlib.contextmanager
        def manage():
            entered.append(1)
            yield lambda x: x * 2
        return manage()

    assert list(policies.prepared([1, 2, 3], scaled)) == [2, 4, 6] and entered == [1]


def test_gridded_runs(spark, tmp_path):
    """Predictions of matched windows reach their cells; extents one after another give what all at once gives."""
    import itertools as it

    from meshframe.plans.gridded import GriddedRun, cast

    a = Source("a", synthetic(spark, {"t": range(12), "y": range(5)}), ["t", "y"], window={"t": (2, 0), "y": 1}, valid_percent={("t", "y"): 1.0})
    b = Source("b", synthetic(spark, {"y": [0, 1, 2, 3, 4]}), ["y"])
    run = GriddedRun([a, b], ["var_0@0", "var_0@1"], {"t": ("t", True), "y": ("y", False)}, graph=lambda c: {"v": F.element_at(c["var_0@0"], -1) + F.get(c["var_0@1"], F.lit(0))}, after={"v": lambda c: c / 2})
    want = {(float(t), float(y)): ((t * 5 + y + 1) + y) / 2 for t, y in it.product(range(2, 12), range(1, 4))}
    assert {(r.t, r.y): r.v for r in run.predictions().collect()} == want
    axes = {"t": axis(spark, range(12), "t"), "y": axis(spark, range(5), "y")}
    whole, parts = (archive.Archive(spark, str(tmp_path / n), axes, ["v"]) for n in ("whole", "parts"))
    assert cast(run, whole) and cast(run, parts, [{"t": (0, 6)}, {"t": (5, 11)}])
    assert {(r.t, r.y): r.v for r in whole.read().collect()} == want == {(r.t, r.y): r.v for r in parts.read().collect()}
    assert not cast(run, whole, [{"t": (0,)}]) and cast(run, whole, [{"t": (0,)}]).error is not None


def test_config(tmp_path):
    from meshframe.sources.config import Config

    c = Config(tmp_path / "c.yml")
    c.a = 1
    c.update(b=[1, 2]).save()
    again = Config(tmp_path / "c.yml")
    assert again.a == 1 and again.b == [1, 2] and again.other is None


def test_late_events_close_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    for i, minutes in enumerate([[1, 2, 61], [3, 130], [4]]):  # the last comes after its window closed
        spark.createDataFrame([(start + timedelta(minutes=m), 1) for m in minutes], "ts timestamp, v int").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        s = incremental.file_stream(spark, str(tmp_path / "in" / "*"), "ts timestamp, v int")
        out = incremental.windowed(s, "ts", "1 hour", "30 minutes", [], "v").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        out.outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r.start.hour: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 3}
