"""More queries over the shared tables: operators that need samples, archives, graphs or several steps."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions import scalar as X
from .functions.transforms import Transform
from .operators import archive, batching, halo, matching, regions, stats, validity, windows
from .plans.graph import Graph, Node, group_labels, lstm, select_flat
from .plans.specs import IOSpec, StructuredDataset, sources_from
from .queries import AB, ARCHIVE, E, EV, GRID, HOURLY, IDX, ORACLE_SQL, PAIRS, SAMPLES, STATS, TRIANGLE, _axis, _pipeline_graph, _samples, _values, every, grid, grid_source, hour_source, hourly, keys, kind_source, pts, query, table, three
from .sources.grid import Source, cache, minutes, synthetic
from .sources.tables import fresh_path
from .streaming import incremental

# sources


@query("cached_source", f"WITH {GRID} SELECT x, y, n, n > 50 AS large FROM grid")
def cached_source(spark, sf_dir):
    """Two sources of one name over different data, and functions that differ in what they hold, share no entry."""
    folder, g = fresh_path(spark, "cache"), grid(spark, sf_dir)

    def above(least):
        return lambda source, df: df.withColumn("large", F.col("n") > least)

    cache(Source("grid", g.where("x < 3"), ["x", "y"], features=["n", "large"], preprocessors=(above(50),)), folder)
    cache(Source("grid", g, ["x", "y"], features=["n", "large"], preprocessors=(above(9),)), folder)
    kept = cache(Source("grid", g, ["x", "y"], features=["n", "large"], preprocessors=(above(50),)), folder)
    again = cache(Source("grid", g, ["x", "y"], features=["n", "large"], preprocessors=(above(50),)), folder)
    return again.frame.join(kept.cells(), ["x", "y", "n", "large"], "left_semi").select("x", "y", "n", "large")


@query("synthetic_grid", "SELECT CAST(n_nationkey AS DOUBLE) AS n, CAST(r_regionkey AS DOUBLE) / 2 AS r, CAST(row_number() OVER (ORDER BY n_nationkey, r_regionkey) - 1 AS DOUBLE) AS var_0 FROM nation, region")
def synthetic_grid(spark, sf_dir):
    """A dense grid over the keys of two small tables."""
    nations = sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())
    regions = sorted(r[0] / 2 for r in table(spark, sf_dir, "region").select("r_regionkey").collect())
    return synthetic(spark, {"n": nations, "r": regions})


@query("sources_from_specs", f"WITH {IDX} SELECT CAST(i AS BIGINT) AS i, (SELECT CAST(sum(n) AS BIGINT) FROM ix o WHERE o.i BETWEEN ix.i - 2 AND ix.i + 1) AS n FROM ix WHERE i BETWEEN 2 AND size - 2")
def sources_from_specs(spark, sf_dir):
    specs = [IOSpec("hours", ["n"], {"t": None}), IOSpec("hours", ["n", "t"], {"t": 4})]
    s = sources_from(specs, lambda name: (hourly(spark, sf_dir).drop("h"), ["t"]), {"t": 4}, {"*": {"valid_percent": {"t": 1.0}}})
    w = windows.gather(s[0], validity.centers(s[0]))
    return w.select(F.col("i_t").alias("i"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


@query("structured_dataset", "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS row_id, r_name, CAST(r_regionkey AS BIGINT) AS key FROM region")
def structured_dataset(spark, sf_dir):
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # arrays in memory are what the class is for
    made = StructuredDataset(spark, [r.r_name for r in rows], [int(r.r_regionkey) for r in rows], labels=["r_name", "key"])
    return StructuredDataset.from_json(spark, made.to_json()).frame.select("row_id", "r_name", F.col("key").cast("long"))


@query("time_minutes", "SELECT event_id, round(epoch_us(ts) / 6e7, 6) AS m FROM events")
def time_minutes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(minutes(F.col("ts")), 6).alias("m"))


# samples


@query("drop_source", f"WITH {SAMPLES} SELECT a, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS BIGINT) AS m FROM pairs")
def drop_source(spark, sf_dir):
    df, sel = _samples(spark, sf_dir)
    out = sel.select(windows.dropped(df, three(spark, sf_dir)[:2], ["error"]), ["t", "t@1", "error__m"])
    return out.select(F.element_at("t", -1).alias("a"), F.get("`t@1`", F.lit(0)).alias("b"), F.get("error__m", F.lit(0)).alias("m"))


@query("drop_features", f"WITH {SAMPLES} SELECT a, b, CAST(NULL AS BIGINT) AS m FROM pairs")
def drop_features(spark, sf_dir):
    df, sel = _samples(spark, sf_dir)
    out = sel.select(windows.dropped(df, three(spark, sf_dir)[:2], [1], keep_coordinates=True), ["t", "t@1", "error__m"])
    return out.select(F.element_at("t", -1).alias("a"), F.get("`t@1`", F.lit(0)).alias("b"), F.get("error__m", F.lit(0)).alias("m"))


@query("sample_array", f"WITH {SAMPLES} SELECT a, b, CAST(2 AS INTEGER) AS n FROM pairs")
def sample_array(spark, sf_dir):
    df, sel = _samples(spark, sf_dir)
    out = sel.to_array(df, ["t", "t@1"]).select(F.element_at(F.get("values", F.lit(0)), -1).alias("a"), F.get(F.get("values", F.lit(1)), F.lit(0)).alias("b"), F.size("values").alias("n"))
    return out


@query("sample_struct", f"WITH {SAMPLES} SELECT a, CAST(m AS BIGINT) AS m FROM pairs")
def sample_struct(spark, sf_dir):
    df, sel = _samples(spark, sf_dir)
    return sel.to_struct(df, ["t", "error__m"]).select(F.element_at("values.t", -1).alias("a"), F.get("values.error__m", F.lit(0)).alias("m"))


@query("sample_coordinate", f"WITH {SAMPLES} SELECT DISTINCT b FROM pairs")
def sample_coordinate(spark, sf_dir):
    df, sel = _samples(spark, sf_dir)
    return sel.select(df, ["t@error"]).select(F.get("`t@error`", F.lit(0)).alias("b")).distinct()


@query("gather_sparse", f"WITH {GRID}, v AS (SELECT x, y, n FROM grid WHERE q <> -2147483648) SELECT a.x, a.y, count(b.n) AS there, CAST(sum(b.n) AS BIGINT) AS n FROM v a JOIN v b ON abs((SELECT count(DISTINCT x) FROM v c WHERE c.x < a.x) - (SELECT count(DISTINCT x) FROM v c WHERE c.x < b.x)) <= 1 AND a.y = b.y GROUP BY 1, 2")
def gather_sparse(spark, sf_dir):
    s = Source("sparse", grid(spark, sf_dir).where("q <> -2147483648"), ["x", "y"], features=["n"], window={"x": 1}, sparse=True, match_radius={"x": 1, "y": 1})
    df, _ = validity.indexed(s)
    w = windows.gather(s, df)
    there = F.filter("n", lambda v: v.isNotNull())
    return w.select(F.get("x", F.lit(1)).alias("x"), F.get("y", F.lit(0)).alias("y"), F.size(there).cast("long").alias("there"), F.aggregate(there, F.lit(0).cast("long"), lambda a, v: a + v).alias("n"))


@query("match_single", f"WITH {HOURLY} SELECT t AS a FROM hourly")
def match_single(spark, sf_dir):
    return keys(matching.match([pts(hour_source(spark, sf_dir))]), "a")


@query("diagnose_empty", f"WITH {AB} SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM hourly JOIN b ON abs(hourly.t - (b.t + 100000)) <= 1.5) THEN 'hours and far do not match' END AS why")
def diagnose_empty(spark, sf_dir):
    far = kind_source(spark, sf_dir, 3, "error", 1.5)
    far = far.with_frame(far.frame.withColumn("t", F.col("t") + 100_000))
    return spark.createDataFrame([(matching.diagnose([("hours", pts(hour_source(spark, sf_dir))), ("far", pts(far))]),)], "why string")


# statistics, transforms, metrics


@query("summary_sparse", f"WITH {GRID}, v AS (SELECT * FROM grid WHERE q <> -2147483648) SELECT 'n' AS feature, round(avg(n), 6) AS mean, CAST((SELECT count(DISTINCT x) * count(DISTINCT y) FROM v) - count(n) AS BIGINT) AS null_count FROM v")
def summary_sparse(spark, sf_dir):
    s = Source("sparse", grid(spark, sf_dir).where("q <> -2147483648"), ["x", "y"], features=["n"], sparse=True, match_radius={"x": 1, "y": 1})
    return stats.summary(s, coordinates=False).select("feature", F.round("mean", 6).alias("mean"), F.col("null").alias("null_count"))


@query(
    "summary_percentiles_sketch",
    f"WITH {EV}, d AS (SELECT cents, cume_dist() OVER (ORDER BY cents) AS c FROM ev) SELECT 'cents' AS feature, "
    + ", ".join(f"CAST(min(cents) FILTER (c >= {p / 100}) AS BIGINT) AS p{p}" for p in (5, 20, 40, 80, 95))
    + " FROM d",
)
def summary_percentiles_sketch(spark, sf_dir):
    """Percentiles by rank: a sketch cuts the values into slices, in which they are counted, so any number of rows is exact."""
    df = table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    got = stats.summary(Source("events", df, ["event_id"], features=["cents"]), coordinates=False, accuracy=1_000_000, ranked=True)
    return got.select("feature", *[F.col(f"p{p}").cast("long").alias(f"p{p}") for p in (5, 20, 40, 80, 95)])


@query("max_resolution", f"WITH {HOURLY}{every(3, 'b', 'error')} SELECT (SELECT max(g) FROM (SELECT lead(t) OVER (ORDER BY t) - t AS g FROM b)) AS b, (SELECT max(g) FROM (SELECT lead(t) OVER (ORDER BY t) - t AS g FROM hourly)) AS hours")
def max_resolution(spark, sf_dir):
    return spark.createDataFrame([(stats.max_resolution(kind_source(spark, sf_dir, 3, "error", 1.5))["t"], stats.max_resolution(hour_source(spark, sf_dir))["t"])], "b double, hours double")


@query("barycenter_edges", f"WITH {HOURLY}{every(3, 'b', 'error')}, f AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS p) SELECT round(((SELECT quantile_cont(t, p) FROM hourly) + (SELECT quantile_cont(t, p) FROM b)) / 2, 4) AS edge FROM (SELECT 0.0 AS p) UNION ALL SELECT round(((SELECT quantile_cont(t, 0.25) FROM hourly) + (SELECT quantile_cont(t, 0.25) FROM b)) / 2, 4) UNION ALL SELECT round(((SELECT quantile_cont(t, 0.5) FROM hourly) + (SELECT quantile_cont(t, 0.5) FROM b)) / 2, 4) UNION ALL SELECT round(((SELECT quantile_cont(t, 0.75) FROM hourly) + (SELECT quantile_cont(t, 0.75) FROM b)) / 2, 4) UNION ALL SELECT round(((SELECT max(t) FROM hourly) + (SELECT max(t) FROM b)) / 2, 4)".replace("(SELECT quantile_cont(t, p) FROM hourly)", "(SELECT min(t) FROM hourly)").replace("(SELECT quantile_cont(t, p) FROM b)", "(SELECT min(t) FROM b)"))
def barycenter_edges(spark, sf_dir):
    edges = stats.barycenter_edges([hour_source(spark, sf_dir), kind_source(spark, sf_dir, 3, "error", 1.5)], "t", 4)
    return spark.createDataFrame([(round(e, 4),) for e in edges], "edge double")


#: Targets of quartiles and ends under a normal curve that reaches 1 at 99.5 %.
Q = NormalDist().inv_cdf(0.75) / NormalDist().inv_cdf(0.995)


def _piecewise(points) -> str:
    """SQL of a broken line, constant beyond its ends."""
    (x0, y0), (xn, yn) = points[0], points[-1]
    whens = " ".join(f"WHEN value < {b} THEN {c!r} + (value - {a}) / {b - a} * {d - c!r}" for (a, c), (b, d) in zip(points, points[1:], strict=False))
    return f"CASE WHEN value <= {x0} THEN {y0!r} {whens} ELSE {yn!r} END"


@query("t_quantile_gaussian", f"SELECT event_id, round({_piecewise([(-20, -1.0), (60, -Q), (100, 0.0), (180, Q), (490, 1.0)])} + 1e-8, 6) AS y, round(least(490, greatest(-20, value)), 4) AS x FROM events")
def t_quantile_gaussian(spark, sf_dir):
    t = Transform(STATS, "quantile")
    y = t.forward(F.col("value"), "value")
    return table(spark, sf_dir, "events").select("event_id", F.round(y + 1e-8, 6).alias("y"), F.round(t.inverse(y, "value"), 4).alias("x"))


@query("t_quantile_uniform11", f"SELECT event_id, round({_piecewise([(-20, -1.0), (60, 49 / 99 - 1), (100, 0.0), (180, 149 / 99 - 1), (490, 1.0)])} + 1e-8, 6) AS y, round(least(490, greatest(-20, value)), 4) AS x FROM events")
def t_quantile_uniform11(spark, sf_dir):
    t = Transform(STATS, "quantile|target=uniform11")
    y = t.forward(F.col("value"), "value")
    return table(spark, sf_dir, "events").select("event_id", F.round(y + 1e-8, 6).alias("y"), F.round(t.inverse(y, "value"), 4).alias("x"))


@query("t_several_outputs", f"SELECT event_id, round((value - 120) / (80 + {E}), 6) AS value_0, round((value + 20) / (510 + {E}), 6) AS value_1 FROM events")
def t_several_outputs(spark, sf_dir):
    out = Transform(STATS, "standardize&normalize|minim=0|maxim=1").apply(table(spark, sf_dir, "events").select("event_id", "value"))
    return out.select("event_id", F.round("value_0", 6).alias("value_0"), F.round("value_1", 6).alias("value_1"))


@query("t_custom", "SELECT event_id, round(value * 3 + 1, 6) AS y, round(value, 6) AS x FROM events")
def t_custom(spark, sf_dir):
    t = Transform(STATS, (lambda x, name: x * 3 + 1, lambda y, name: (y - 1) / 3))
    y = t.forward(F.col("value"), "value")
    return table(spark, sf_dir, "events").select("event_id", F.round(y, 6).alias("y"), F.round(t.inverse(y, "value"), 6).alias("x"))


@query("drop_stats", f"SELECT l_orderkey, l_linenumber, l_quantity, round(ln(l_tax + {E}), 6) AS l_tax FROM lineitem")
def drop_stats(spark, sf_dir):
    t = Transform({"l_quantity": {"mean": 25.0}, "l_tax": {"mean": 0.0}}, "logexp", drop=["l_quantity"])
    return t.apply(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")).withColumn("l_tax", F.round("l_tax", 6))


@query("metric_lkge", "WITH p AS (SELECT l_returnflag, l_quantity AS t, l_quantity * 1.1 + l_linenumber AS p FROM lineitem), a AS (SELECT l_returnflag, corr(t, p) AS r, stddev_pop(p) / stddev_pop(t) AS s, avg(p) / avg(t) AS b FROM p GROUP BY 1) SELECT l_returnflag, round(ln(1 - sqrt(pow(r - 1, 2) + pow(s - 1, 2) + pow(b - 1, 2))), 6) AS lkg FROM a")
def metric_lkge(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("t"), (F.col("l_quantity") * 1.1 + F.col("l_linenumber")).alias("p"))
    return M.Metrics().evaluate(df, "t", "p", ["lkg"], ["l_returnflag"]).select("l_returnflag", F.round("lkg", 6).alias("lkg"))


@query("metric_registered", f"WITH {PAIRS} SELECT l_returnflag, round(max(abs(t - p)), 6) AS worst FROM p GROUP BY 1")
def metric_registered(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("t"), (F.round(F.col("l_discount") * 100) + F.col("l_linenumber")).alias("p"))
    m = M.Metrics()
    m.register("worst", lambda t, p: F.max(F.abs(t - p)))
    return m.evaluate(df, "t", "p", ["worst"], ["l_returnflag"]).select("l_returnflag", F.round("worst", 6).alias("worst"))


# arrays and scalars


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_linenumber").cast("long"))).alias("n"))


LINES = "n AS (SELECT l_orderkey, list_sort(list(DISTINCT CAST(l_linenumber AS BIGINT))) AS n FROM lineitem GROUP BY 1)"


@query("array_chunks", f"WITH {LINES} SELECT l_orderkey, CAST(ceil(len(n) / 3.0) AS INTEGER) AS pieces, array_to_string(n[1:3], ',') AS first FROM n")
def array_chunks(spark, sf_dir):
    c = _lines(spark, sf_dir).withColumn("c", X.chunks(F.col("n"), 3))
    return c.select("l_orderkey", F.size("c").alias("pieces"), F.array_join(F.transform(F.get("c", F.lit(0)), lambda v: v.cast("string")), ",").alias("first"))


@query("array_tile", f"WITH {LINES} SELECT l_orderkey, array_to_string(flatten(list_transform(n, lambda v: [v, v, v])), ',') AS tiled FROM n")
def array_tile(spark, sf_dir):
    t = _lines(spark, sf_dir).select("l_orderkey", X.squeeze(X.tile(F.col("n"), 3)).alias("t"))
    return t.select("l_orderkey", F.array_join(F.transform("t", lambda v: v.cast("string")), ",").alias("tiled"))


@query("array_expand", f"WITH {LINES} SELECT l_orderkey, CAST(1 AS INTEGER) AS outer_size, CAST(len(n) AS INTEGER) AS inner_size FROM n")
def array_expand(spark, sf_dir):
    e = _lines(spark, sf_dir).withColumn("e", X.expand(F.col("n"), 2))
    return e.select("l_orderkey", F.size("e").alias("outer_size"), F.size(X.squeeze(F.col("e"), 2)).alias("inner_size"))


@query("converted_units", f"WITH {GRID} SELECT x, y, CASE WHEN q <> -2147483648 THEN CAST(round(q - 273.15, 4) AS DOUBLE) END AS celsius FROM grid")
def converted_units(spark, sf_dir):
    kept = regions.masked(grid(spark, sf_dir), F.col("q") != -2147483648, ["q"])
    return kept.select("x", "y", F.round(X.kelvin_to(F.col("q"), "C").cast("double"), 4).alias("celsius"))


@query("region_union", "SELECT x, y, inside OR (x < 3 AND y < 3 AND x >= 0 AND y >= 0) AS inside FROM (" + ORACLE_SQL["region_mask"] + ")")
def region_union(spark, sf_dir):
    square = [(-0.5, -0.5), (2.5, -0.5), (2.5, 2.5), (-0.5, 2.5)]
    mask = regions.inside(F.col("x").cast("double"), F.col("y").cast("double"), [TRIANGLE, square], largest_only=False)
    return grid(spark, sf_dir).select("x", "y", mask.alias("inside"))


# graphs


@query("graph_expanded", ORACLE_SQL["graph_pipeline"])
def graph_expanded(spark, sf_dir):
    g = _pipeline_graph()
    g.expand("inner")
    out = g.run(table(spark, sf_dir, "lineitem"), {"price": "l_extendedprice", "discount": "l_discount", "items__q": "l_quantity"}, keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.round("net_price", 4).alias("net_price"), F.round("total", 4).alias("total"))


@query("graph_decoded", "SELECT l_orderkey, l_linenumber, round(l_quantity * 2 + 1, 4) AS y FROM lineitem")
def graph_decoded(spark, sf_dir):
    registry = {"double": Node(lambda c: {"x": c["x"] * 2.0}, ["x"], ["x"]), "next": Node(lambda c: {"y": c["x"] + 1.0}, ["x"], ["y"])}
    g = Graph("small")
    for name in registry:
        g.add_node(name, registry[name])
    g.add_edges([("input", "double"), ("double", "next"), ("next", "output", ["y"])])
    out = Graph.from_json(g.to_json(registry), registry).run(table(spark, sf_dir, "lineitem"), {"x": "l_quantity"}, keep=["l_orderkey", "l_linenumber"])
    return out.withColumn("y", F.round("y", 4))


@query("graph_labels", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 4) AS total FROM lineitem")
def graph_labels(spark, sf_dir):
    node = Node(lambda c: {"total": c["items"]["q"] + c["items"]["t"]}, grouped=True)
    out = node({"items__q": F.col("l_quantity"), "items__t": F.col("l_tax")})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(out["total"], 4).alias("total"))


@query("graph_select", "SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem")
def graph_select(spark, sf_dir):
    nest = {"items": {"a": {"q": F.col("l_quantity")}, "b": {"t": F.col("l_tax")}}}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", select_flat(nest, "a/q").alias("q"))


LSTM_WEIGHTS = {"W": [[0.5, -0.25, 0.75, 0.1]], "U": [[0.2, 0.3, -0.4, 0.6]], "b": [0.1, 1.0, -0.2, 0.05]}


def _gate(j: int) -> str:
    w = LSTM_WEIGHTS
    return f"(x.x * {w['W'][0][j]} + s.h * ({w['U'][0][j]}) + ({w['b'][j]}))"


def _sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-{x})))"


LSTM_C = f"({_sigmoid(_gate(1))} * s.c + {_sigmoid(_gate(0))} * ((exp(2 * {_gate(2)}) - 1) / (exp(2 * {_gate(2)}) + 1)))"


@query(
    "lstm_state",
    f"""WITH r AS (SELECT l_orderkey, list({{'x': l_quantity / 50, 'h': 0.0::DOUBLE, 'c': 0.0::DOUBLE}} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(list_reduce(list_prepend({{'x': 0.0::DOUBLE, 'h': 0.0::DOUBLE, 'c': 0.0::DOUBLE}}, r), lambda s, x: {{'x': 0.0::DOUBLE, 'h': {_sigmoid(_gate(3))} * ((exp(2 * {LSTM_C}) - 1) / (exp(2 * {LSTM_C}) + 1)), 'c': {LSTM_C}}}).h, 6) AS h FROM r""",
)
def lstm_state(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("r"))
    x = F.transform("r", lambda v: F.array((v["l_quantity"] / 50).cast("double")))
    return a.select("l_orderkey", F.round(F.get(lstm(x, LSTM_WEIGHTS), F.lit(0)), 6).alias("h"))


# batches, archives, halos, increments


@query("batch_nested", "WITH s AS (SELECT event_id, user_id, value, row_number() OVER (ORDER BY md5(concat(CAST(event_id AS VARCHAR), '_0')), event_id) - 1 AS row FROM events) SELECT CAST(row // 500 AS BIGINT) AS batch, CAST(sum(user_id) AS BIGINT) AS users, CAST(count(value) AS INTEGER) AS n FROM s GROUP BY 1")
def batch_nested(spark, sf_dir):
    plan = batching.Batches(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id", 500, [["user_id"], ["value"]]).plan()
    return plan.select("batch", F.aggregate("user_id", F.lit(0).cast("long"), lambda a, x: a + x).alias("users"), F.size("value").alias("n"))


@query("sampling_bins", f"WITH {GRID} SELECT CAST(x // 4 * 2 + y // 5 AS INTEGER) AS bin, count(*) AS n FROM grid WHERE x < 12 AND y < 10 GROUP BY 1")
def sampling_bins(spark, sf_dir):
    filters = batching.sampling_bins({("x", "y"): [[0, 4, 8, 12], [0, 5, 10]]})
    tags = F.explode(F.array_compact(F.array(*[F.when(validity.in_bins(f), F.lit(i)) for i, f in enumerate(filters)])))
    return grid(spark, sf_dir).select(tags.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("archive_generations", ARCHIVE.replace("GROUP BY i_c", "GROUP BY i_c"))
def archive_generations(spark, sf_dir):
    """Staged in fragments, merged, opened again with a fragment waiting, and merged again."""
    path, axes, v = fresh_path(spark, "archive"), {"c": _axis(spark)}, _values(spark, sf_dir)
    part = F.pmod(F.xxhash64("user_id"), F.lit(3))
    a = archive.Archive(spark, path, axes, ["cents"])
    a.stage(v.where(part == 0))
    a.flush()
    a.stage(v.where(part == 1), "second")
    b = archive.Archive(spark, path, axes, ["cents"], existing="append")
    b.stage(v.where(part == 1), "second")
    b.stage(v.where(part == 2))
    b.flush()
    return archive.means(b.sums(), ["i_c"], ["cents"])


def _halo_2d() -> str:
    out = []
    for d, (c, size, block, before, after) in enumerate((("x", "sx", 4, 1, 2), ("y", "sy", 3, 2, 1))):
        out.append(f"b{d} AS (SELECT b AS block_{d}, p AS position_{d}, b * {block} + p AS j{d} FROM size, LATERAL (SELECT unnest(range(0, CAST(ceil({size} / {block}.0) AS BIGINT))) AS b), LATERAL (SELECT unnest(range(-{before}, least({block}, {size} - b * {block}) + {after})) AS p))")
    return ", ".join(out)


@query(
    "halo_2d",
    f"""WITH {GRID}, size AS (SELECT max(x) + 1 AS sx, max(y) + 1 AS sy FROM grid), {_halo_2d()}
SELECT CAST(block_0 AS INTEGER) AS block_0, CAST(block_1 AS INTEGER) AS block_1, CAST(position_0 AS INTEGER) AS position_0, CAST(position_1 AS INTEGER) AS position_1,
  CASE WHEN j1 < 0 OR j1 >= sy THEN -5 ELSE n END AS n
FROM b0 CROSS JOIN b1 CROSS JOIN size LEFT JOIN grid ON x = CASE WHEN j0 < 0 THEN -j0 - 1 WHEN j0 >= sx THEN 2 * sx - 1 - j0 ELSE j0 END AND y = j1""",
)
def halo_2d(spark, sf_dir):
    g = grid(spark, sf_dir)
    size = g.agg(F.max("x"), F.max("y")).first()
    out = halo.overlap_nd(g, ["x", "y"], "n", [size[0] + 1, size[1] + 1], [4, 3], [(1, 2), (2, 1)], ["reflect", "constant"], -5)
    return out.withColumn("n", F.col("n").cast("long"))


@query("halo_hours", f"WITH {IDX}, b AS (SELECT i // 50 AS block, i, size FROM ix), p AS (SELECT DISTINCT block, size FROM b), q AS (SELECT block, size, unnest(range(-3, least(50, size - block * 50) + 1)) AS position FROM p) SELECT CAST(block AS INTEGER) AS block, CAST(position AS INTEGER) AS position, CAST(n AS BIGINT) AS n FROM q JOIN ix ON ix.i = block * 50 + position")
def halo_hours(spark, sf_dir):
    df, sizes = validity.indexed(hour_source(spark, sf_dir))
    return halo.overlap(df, "i_t", "n", sizes["t"], 50, 3, 1)


@query("extent_diff", f"WITH {HOURLY}, i AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM hourly) SELECT (SELECT t FROM i WHERE i = 40) AS low, (SELECT max(t) FROM i) AS high")
def extent_diff(spark, sf_dir):
    e = incremental.Extents("t", "diff", position=40)
    axis = hour_source(spark, sf_dir).axis("t")
    found = [e.next(axis)["t"]]
    return spark.createDataFrame(found if e.next(axis) == {} else [], "low double, high double")


@query("extent_custom", f"WITH {HOURLY} SELECT max(t) - 24 AS low, max(t) AS high FROM hourly")
def extent_custom(spark, sf_dir):
    def last_day(own, axis):
        high = axis.agg(F.max("t")).first()[0]
        return {own.dim: (high - 24, high)}

    return spark.createDataFrame([incremental.Extents("t", last_day).next(hour_source(spark, sf_dir).axis("t"))["t"]], "low double, high double")


@query("stream_into_archive", ARCHIVE)
def stream_into_archive(spark, sf_dir):
    """The events' files through a stream into an archive, two batches for each merge."""
    path = fresh_path(spark, "stream-archive")
    raw = table(spark, sf_dir, "events")
    raw.repartition(5, "event_id").write.parquet(f"{path}/in")
    stream = incremental.file_stream(spark, f"{path}/in", raw.schema, 2)
    cents = F.round(F.col("value") * 100).cast("long")
    a = archive.Archive(spark, f"{path}/archive", {"c": _axis(spark)}, ["cents"])
    incremental.into_archive(stream.select((cents / 100.0).alias("c"), cents.alias("cents")), a, f"{path}/checkpoint", every=2)
    return archive.means(a.sums(), ["i_c"], ["cents"])


@query("two_streams_one_archive", ARCHIVE)
def two_streams_one_archive(spark, sf_dir):
    """The events in two folders, each a stream with a checkpoint of its own; the first runs again after the second."""
    path = fresh_path(spark, "stream-archive")
    raw = table(spark, sf_dir, "events")
    part = F.pmod(F.xxhash64("user_id"), F.lit(3))
    cents = F.round(F.col("value") * 100).cast("long")
    a = archive.Archive(spark, f"{path}/archive", {"c": _axis(spark)}, ["cents"])

    def run(name, which):
        raw.where(which).repartition(3, "event_id").write.mode("append").parquet(f"{path}/{name}")
        stream = incremental.file_stream(spark, f"{path}/{name}", raw.schema, 2)
        incremental.into_archive(stream.select((cents / 100.0).alias("c"), cents.alias("cents")), a, f"{path}/checkpoint-{name}", every=2)

    run("one", part == 0)
    run("two", part == 1)
    run("one", part == 2)
    return archive.means(a.sums(), ["i_c"], ["cents"])
