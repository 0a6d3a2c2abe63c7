"""Proximity joins against worked examples and against enumeration."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.operators import matching, validity, windows
from meshframe.sources import grid
from meshframe.sources.grid import EPS, Source, cache, equal_extents, reader, resolutions, synthetic


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def found(spark, grids, resolution=None, radius=0.5, method="multi"):
    res = resolution if isinstance(resolution, list) else [resolution] * len(grids)
    return rows(matching.match([matching.plain_points(spark, g, r, radius) for g, r in zip(grids, res)], method))


def line(spark, name, values, **kw):
    df = spark.createDataFrame([(float(x), float(i)) for i, x in enumerate(values)], "x double, v double")
    return Source(name, df, ["x"], **kw)


# Worked examples of which points match, as the semantics state them.
def test_one_dim(spark):
    assert found(spark, [[1, 2, 3], [2, 3, 4], [3, 4, 5]]) == [(2, 1, 0)]
    assert found(spark, [[1, 2, 3], [4, 5, 6], [3, 1, 0]], 2) == [(2, 0, 0)]
    assert found(spark, [[1, 2, 3], [4, 5, 6], [2, 1, 0]], radius=2) == [(1, 0, 0), (2, 0, 0)]
    assert found(spark, [[1, 2], [5, 6], [9, 10], [20, 21]]) == []


def test_two_dims_euclidean(spark):
    grids = [[[1, 1], [1, 2], [2, 3]], [[2, 1], [2, 2], [3, 3]], [[1, 2], [3, 1], [3, 2]]]
    assert found(spark, grids, radius=1, method="l2") == [(1, 1, 0)]


def enumerate_matches(grids, res, radius, locus=False):
    def near(x, rx, y, ry):
        for a, (al, ar), b, (bl, br) in zip(x, rx, y, ry):
            lo_a, hi_a, lo_b, hi_b = a - al * radius - EPS, a + ar * radius + EPS, b - bl * radius - EPS, b + br * radius + EPS
            if not ((lo_a <= hi_b and lo_b <= hi_a) if locus else (lo_b <= a <= hi_b or lo_a <= b <= hi_a)):
                return False
        return True

    out = []
    for at in itertools.product(*[range(len(g)) for g in grids]):
        if all(near(grids[i][at[i]], res[i][at[i]], grids[j][at[j]], res[j][at[j]]) for i, j in itertools.combinations(range(len(grids)), 2)):
            out.append(at)
    return sorted(out)


@pytest.mark.parametrize("dims,n", [(1, 3), (2, 3), (3, 2)])
@pytest.mark.parametrize("locus", [False, True])
def test_random_points(spark, dims, n, locus):
    rng = np.random.default_rng(dims * 10 + n)
    grids = [rng.uniform(0, 6, (18, dims)) for _ in range(n)]
    res = [rng.uniform(0, 1.5, (18, dims, 2)) for _ in range(n)]
    want = enumerate_matches(grids, res, 0.5, locus)
    ps = [matching.plain_points(spark, g, r) for g, r in zip(grids, res)]
    assert rows(matching.match(ps, "locus" if locus else "multi")) == want
    assert rows(matching.match_pairwise(ps, locus)) == want
    anchored = {r.k0: (sorted(r.m1), *(sorted(r[f"m{j}"]) for j in range(2, n))) for r in matching.match_anchor(ps, allow_empty=True).collect()}
    if not locus:
        for i in range(18):
            for j in range(1, n):
                pair = enumerate_matches([grids[0][i : i + 1], grids[j]], [res[0][i : i + 1], res[j]], 0.5)
                assert anchored[i][j - 1] == [b for _, b in pair]


def test_optional_source_leaves_nulls(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 9, (25, 2)), rng.uniform(0, 9, (12, 2))
    p, q = matching.plain_points(spark, a), matching.plain_points(spark, b)
    got = {}
    for r in matching.match([p, matching.Points(q.frame, q.dims, q.most, required=False)]).collect():
        got.setdefault(r.k0, []).append(r.k1)
    want = {}
    for i, j in enumerate_matches([a, b], [np.ones((25, 2, 2)), np.ones((12, 2, 2))], 0.5):
        want.setdefault(i, []).append(j)
    assert {k: sorted(v) for k, v in got.items() if v != [None]} == want and set(got) == set(range(25))


def test_plan_has_no_nested_loop(spark):
    p = matching.plain_points(spark, [[float(i)] for i in range(50)])
    plan = matching.match([p, p])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sources_of_different_steps(spark):
    a, b, c = line(spark, "a", range(0, 17, 2), window={"x": 1}), line(spark, "b", range(17), window={"x": 2}), line(spark, "c", range(0, 16, 3))
    ps = [matching.points(s, validity.centers(s), key=F.col("i_x")) for s in (a, b, c)]
    want = "1,2,1 1,3,1 2,3,1 2,4,1 3,5,2 3,6,2 3,7,2 4,8,3 4,9,3 5,9,3 5,10,3 6,11,4 6,12,4 6,13,4 7,14,5"
    assert rows(matching.match(ps)) == sorted(tuple(map(int, x.split(","))) for x in want.split())


NON_UNIFORM = ([1, 9, 13, 15, 16], [1, 3, 5, 7, 9, 11, 13, 15])


@pytest.mark.parametrize(
    "radius,want",
    [
        (None, "1,1 1,3 1,5 9,5 9,7 9,9 9,11 13,11 13,13 15,15 16,15"),
        (2, "1,1 1,3 9,7 9,9 9,11 13,11 13,13 13,15 15,13 15,15 16,15"),
        ("25%", "1,1 1,3 9,7 9,9 13,13 15,15"),
    ],
)
def test_non_uniform_axes(spark, radius, want):
    kw = {"match_radius": {"x": radius}} if radius else {}
    ps = [matching.points(s, s.cells(), key=F.col("x").cast("int")) for s in (line(spark, "a", NON_UNIFORM[0], **kw), line(spark, "b", NON_UNIFORM[1], **kw))]
    assert rows(matching.match(ps)) == sorted(tuple(map(int, x.split(","))) for x in want.split())


def cube(spark, name, n, features=1, time=True, bad=(), **kw):
    dims = {"time": [0.0, 1.0, 2.0]} if time else {}
    dims |= {"lat": [4.0 / (n - 1) * i for i in range(n)], "lon": [4.0 / (n - 1) * i for i in range(n)]}
    df = synthetic(spark, dims, features)
    for f, at in bad:
        same = F.lit(True)
        for d, i in zip(dims, at):
            same = same & (F.col(d) == dims[d][i])
        df = df.withColumn(f, F.when(~same, F.col(f)))
    return Source(name, df, list(dims), **kw)


def test_cubes_with_missing_values(spark):
    w = {"time": (1, 0), "lat": 1, "lon": 1}
    rule = {("time", "lat", "lon"): 1.0}
    a = cube(spark, "a", 3, 2, bad=[("var_0", (0, 1, 2)), ("var_1", (0, 2, 0))], window=w, valid_percent=rule)
    b = cube(spark, "b", 5, bad=[("var_0", (1, 3, 1))], window=w, valid_percent=rule)
    got = rows(matching.match([matching.points(s, validity.centers(s)) for s in (a, b)]))
    flat = [tuple(dict(zip(s.dim_names, k))[d] for s, k in zip((a, b), r) for d in ("time", "lat", "lon")) for r in got]
    assert sorted(flat) == sorted((2, 1, 1, 2, y, x) for y, x in [(1, 1), (1, 2), (1, 3), (2, 3), (3, 3)])


def test_source_without_time(spark):
    a = cube(spark, "a", 3, window={"time": (1, 0), "lat": 1, "lon": 1})
    b = cube(spark, "b", 5, time=False, window={"lat": (2, 1), "lon": 1})
    assert matching.match([matching.points(s, validity.centers(s)) for s in (a, b)]).count() == 12


def test_implode(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 2), (2, 2, 2)], "a int, b int, c int")
    assert sorted(map(str, matching.implode(df).collect())) == sorted(map(str, spark.createDataFrame([([1], [1], [0]), ([2], [1], [0, 2]), ([2], [2], [2])], "a array<int>, b array<int>, c array<int>").collect()))


@pytest.mark.parametrize("mode", ["nearest", "left", "strict"])
def test_index_of(spark, mode):
    rng = random.Random(1)
    axis = sorted(rng.sample(range(-50, 200), 40))
    values = [rng.uniform(-80, 230) for _ in range(300)] + [float(a) for a in axis] + [(a + b) / 2 for a, b in itertools.pairwise(axis)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n long, v double")
    ax = spark.createDataFrame([(float(a), i) for i, a in enumerate(axis)], "c double, idx long")
    got = {r.n: r.idx for r in matching.index_of(df, "v", ax, "c", mode).collect()}
    for i, v in enumerate(values):
        if v is None:
            want = None
        elif mode == "nearest":
            want = min(range(40), key=lambda k: (abs(axis[k] - v), k))
        elif mode == "left":
            want = sum(a <= v for a in axis) - 1
        else:
            want = axis.index(v) if v in axis else None
        assert got[i] == want, (v, mode)


def test_products_are_asked_for(spark):
    p, q = matching.plain_points(spark, [1.0, 2.0]), matching.plain_points(spark, [5.0, 6.0, 7.0])
    q = matching.Points(q.frame.withColumnsRenamed({"c_0": "c_y", "l_0": "l_y", "r_0": "r_y"}), ["y"], {"y": 1.0})
    with pytest.raises(ValueError):
        matching.match([p, q])
    assert matching.match([p, q], allow_product=True).count() == 6


def test_cartesian(spark):
    a = spark.range(3).select(F.col("id").alias("n"), F.col("id").alias("v"))
    b = spark.range(4).select(F.col("id").alias("n"), (F.col("id") * 10).alias("v"))
    want = list(itertools.product(range(3), range(0, 40, 10)))
    got = matching.cartesian([a, b], 1, 11, 2).orderBy("row").collect()
    assert [(r.v_0, r.v_1) for r in got] == want[1:11:2]


def test_diagnose(spark):
    p, q = matching.plain_points(spark, [1.0, 2.0]), matching.plain_points(spark, [9.0])
    assert matching.diagnose([("p", p), ("q", q)]) == "p and q do not match"
    assert matching.diagnose([("p", matching.Points(p.frame.limit(0), p.dims, p.most)), ("q", q)]) == "p has no valid windows"
    assert matching.diagnose([("p", p), ("r", p)]) is None


def test_samples_and_selectors(spark):
    df = spark.createDataFrame([(([1.0, 2.0], [10.0, 20.0], [0.0, 1.0]), ([3.0, 4.0], [30.0, 40.0], [5.0, 6.0]))], "s0 struct<a:array<double>,shared:array<double>,x:array<double>>, s1 struct<b:array<double>,shared:array<double>,x:array<double>>")
    sel = windows.Selector([("grid/zero", ["a", "shared"], ["x"]), ("grid/one", ["b", "shared"], ["x"])])
    r = sel.select(df, ["shared", "shared@1", "grid$one__shared", "x", "b", "distance:0:1"]).first()
    assert r[0] == [10, 20] and r[1] == [30, 40] and r[2] == [30, 40] and r[3] == [0, 1] and r[4] == [3, 4]
    assert r[5].x == [[-5.0, -6.0], [-4.0, -5.0]]
    assert sel.mean_coordinates(df).first().x == 3.0
    with pytest.raises(KeyError):
        sel.find("nothing")
    with pytest.raises(ValueError):
        sel.distances(0, 0)


def test_validation(spark):
    df = spark.range(3).toDF("x")
    for bad in ({"extent": {"x": [1]}}, {"window": {"x": (1, 2, 3)}}, {"valid_percent": {"x": 2.0}}, {"valid_feature": "some"}, {"sparse": True}):
        with pytest.raises(ValueError):
            Source("s", df, ["x"], **bad)
    with pytest.raises(ValueError):
        reader(spark, "/nowhere/a.zarr3")


def test_resolutions(spark):
    assert resolutions(line(spark, "a", [0, 2, 4]))["x"][1:] == (1.0, 1.0)
    assert resolutions(line(spark, "a", [7]))["x"][1:] == (0.0, 0.0)
    assert resolutions(line(spark, "a", [0, 2, 4], match_radius={"x": "25%"}))["x"][1] == 0.5


def test_cache_and_extents(spark, tmp_path):
    a, b = line(spark, "a", range(10), extent={"x": [2, 8]}), line(spark, "b", [4, 5, 6, 20])
    c = cache(a, str(tmp_path))
    assert rows(c.cells()) == rows(a.cells()) and rows(cache(a, str(tmp_path)).cells()) == rows(a.cells())
    x, y = equal_extents([a, b])
    assert [r.x for r in x.frame.orderBy("x").collect()] == [3, 4, 5, 6, 7, 8] and [r.x for r in y.frame.orderBy("x").collect()] == [4, 5, 6, 20]


def brute_centers(valid, span, rule):
    shape = valid.shape
    ok = valid.copy()
    for group, pct in rule:
        total = int(np.prod([1 + sum(span[d]) for d in group]))
        need = validity.least_valid(pct, total)
        new = np.zeros(shape, bool)
        for at in np.ndindex(*shape):
            count = 0
            for off in itertools.product(*[range(-span[d][0], span[d][1] + 1) if d in group else (0,) for d in range(len(shape))]):
                p = tuple(a + o for a, o in zip(at, off))
                count += all(0 <= q < n for q, n in zip(p, shape)) and ok[p]
            new[at] = count >= need
        ok = new
    for group, _ in rule:
        for d in group:
            for at in np.ndindex(*shape):
                if not span[d][0] <= at[d] <= shape[d] - 1 - span[d][1]:
                    ok[at] = False
    return sorted(zip(*map(lambda x: x.tolist(), np.nonzero(ok))))


@pytest.mark.parametrize("rule", [[((0, 1), 1.0)], [((0, 1), 0.4)], [((0,), 0.5), ((1,), 1.0)], [((1,), 0.5), ((0,), 0.5)], [((0,), 0.0), ((1,), 1.0)]])
def test_centers_by_enumeration(spark, rule):
    rng = np.random.default_rng(3)
    values = rng.standard_normal((7, 6, 2))
    values[rng.random(values.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(i, j, *[float(v) for v in values[i, j]]) for i in range(7) for j in range(6)], "x int, y int, f0 double, f1 double")
    names, span = "xy", {0: (1, 2), 1: (1, 0)}
    for how, reduce in (("all", np.all), ("any", np.any)):
        s = Source("s", df, ["x", "y"], window={"x": (1, 2), "y": (1, 0)}, valid_feature=how, valid_percent={tuple(names[d] for d in g): p for g, p in rule})
        got = rows(validity.centers(s).select("i_x", "i_y"))
        assert got == brute_centers(reduce(~np.isnan(values), axis=2), span, rule)


def test_threshold_is_exact(spark):
    assert validity.least_valid(0.8, 5) == 4 and validity.least_valid(1.0, 7) == 7 and validity.least_valid(0.0, 7) == 0
    df = spark.createDataFrame([(i, None if i == 4 else 1.0) for i in range(7)], "x int, v double")
    s = Source("s", df, ["x"], window={"x": 2}, valid_percent={"x": 0.8})
    assert [r.i_x for r in validity.centers(s).orderBy("i_x").collect()] == [2, 3, 4]


def test_spans(spark):
    assert line(spark, "a", range(4), window={"x": None}).span("x") == (2, 1)
    assert [r.i_x for r in validity.centers(line(spark, "a", range(8), window={"x": 1})).orderBy("i_x").collect()] == [1, 2, 3, 4, 5, 6]
    for w, want in (((3, 0), [3, 4]), ((0, 3), [0, 1]), ((1, 2), [1, 2]), ((2, 1), [2, 3])):
        assert [r.i_x for r in validity.centers(line(spark, "a", range(5), window={"x": w})).orderBy("i_x").collect()] == want


def test_sparse_centers(spark):
    rng = random.Random(2)
    cells = [(i, j) for i in range(8) for j in range(7) if rng.random() < 0.8]
    s = Source("s", spark.createDataFrame([(i, j, 1.0) for i, j in cells], "x int, y int, v double"), ["x", "y"], window={"x": 1, "y": (0, 1)}, sparse=True, match_radius={"x": 1, "y": 1})
    there = set(cells)
    want = [(i, j) for i, j in cells if 1 <= i <= 6 and j <= 5 and sum((a, b) in there for a in (i - 1, i, i + 1) for b in (j, j + 1)) >= 4]
    assert rows(validity.sparse_centers(s, 0.6).select("i_x", "i_y")) == sorted(want)


# reaches and gaps of all sizes


def uneven(rng, n, start=0.0):
    """Coordinates with gaps from 0.1 to a million times that."""
    gaps = rng.choice([0.1, 0.3, 1.0, 20.0, 1e3, 1e5], n, p=[0.4, 0.3, 0.15, 0.1, 0.03, 0.02])
    return (start + np.cumsum(gaps)).round(3)


@pytest.mark.parametrize("locus", [False, True])
@pytest.mark.parametrize("dims", [1, 2])
def test_levels_find_what_enumeration_finds(spark, locus, dims):
    rng = np.random.default_rng(dims + 7 * locus)
    grids, res = [], []
    for n in (25, 20, 15):
        g = np.stack([uneven(rng, n) if d == 0 else rng.uniform(0, 4, n) for d in range(dims)], axis=1)
        r = np.stack([rng.choice([0.2, 1.5, 40.0, 1e4, 1e5], (n, dims)) * rng.uniform(0.5, 1, (n, dims)) for _ in range(2)], axis=2)
        grids.append(g)
        res.append(r)
    want = enumerate_matches(grids, res, 0.5, locus)
    assert found(spark, grids, res, method="locus" if locus else "multi") == want and want
    p = [matching.plain_points(spark, g, r) for g, r in zip(grids, res)]
    assert all(len(x.levels["0"]) > 2 for x in p)
    optional = matching.match([p[0], matching.replace(p[1], required=False)], "locus" if locus else "multi").collect()
    pairs = enumerate_matches(grids[:2], res[:2], 0.5, locus)
    alone = [(i, None) for i in range(25) if i not in {a for a, _ in pairs}]
    assert sorted(map(tuple, optional), key=repr) == sorted([*pairs, *alone], key=repr)


def test_a_gap_does_not_widen_other_buckets(spark):
    """Beside a gap of a million times the median the candidates stay within 8 times the matches; they were a product before."""
    x = np.r_[np.arange(2000.0), 1e6 + np.arange(2000.0)]
    sources = [line(spark, n, x + s) for n, s in (("a", 0.0), ("b", 0.25))]
    points = [matching.points(s, validity.centers(s)) for s in sources]
    assert all(len(p.levels["x"]) > 1 for p in points)
    left, right, equal, again = matching._bucketed(points[1], matching._prefixed(points[0], 0), matching._prefixed(points[1], 1), 1, [(0, points[0])], False)
    candidates = left.join(right, matching.reduce(lambda a, b: a & b, equal)).count()
    matches = matching.match(points).count()
    assert again and matches >= 4000 and candidates <= 8 * matches


@pytest.mark.parametrize("stretch", [3, 50])
def test_neighbours_across_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(grid, "STRETCH", stretch)
    axis = spark.createDataFrame([(i * i * 1.0, i) for i in range(13)], "c double, idx long").repartition(4)
    got = {r.idx: (r.before, r.after) for r in grid.neighbours(axis, "c").collect()}
    assert got == {i: (None if i == 0 else (i - 1.0) ** 2, None if i == 12 else (i + 1.0) ** 2) for i in range(13)}


@pytest.mark.parametrize("mode", ["nearest", "left", "right"])
def test_index_on_uneven_axes(spark, mode):
    rng = np.random.default_rng(3)
    x = np.r_[uneven(rng, 60), 1e12]
    axis = spark.createDataFrame([(float(c), i) for i, c in enumerate(x)], "c double, idx long")
    values = [*rng.uniform(-5, x[-2] + 10, 80), *x[::7], *((x[:-1] + x[1:]) / 2)[::5], -1e9, 2e12, None]
    df = spark.createDataFrame([(None if v is None else float(v), i) for i, v in enumerate(values)], "v double, n int")
    got = {r.n: r.idx for r in matching.index_of(df, "v", axis, "c", mode).collect()}
    for n, v in enumerate(values):
        want = None
        if v is not None:
            want = int(np.searchsorted((x[:-1] + x[1:]) / 2, v)) if mode == "nearest" else int(np.searchsorted(x, v, "right")) - 1
        assert got[n] == want
    assert len(got) == len(values)
    near = {r.n: r.idx for r in matching.index_of(df, "v", axis, "c", "nearest", 0.2).collect()}
    at = [None if v is None else int(np.searchsorted((x[:-1] + x[1:]) / 2, v)) for v in values]
    assert all(near[n] == (at[n] if abs(x[at[n]] - v) <= 0.2 else None) for n, v in enumerate(values) if v is not None)


def test_a_far_coordinate_does_not_gather_values(spark):
    """60,000 values on 20,000 coordinates and one far away: no bucket holds more than a few intervals."""
    axis = spark.range(20_000).selectExpr("cast(id as double) c", "id idx").unionByName(spark.createDataFrame([(1e15, 20_000)], "c double, idx long"))
    df = spark.range(60_000).selectExpr("id % 20000 + 0.25 as v", "id as n")
    out = matching.index_of(df, "v", axis, "c")
    assert out.where("idx <> cast(v as long)").count() == 0 and out.count() == 60_000
