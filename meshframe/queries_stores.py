"""Queries over stored sources, policies of batches, orders, and graphs that are checked."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from .functions import metrics as M
from .operators import batching, halo, policies, regions, stats, validity, windows
from .plans.graph import Graph, Node, cross_stitch, rename_found
from .plans.specs import IOSpec, TensorSpec
from .queries import GRID, HOURLY, IDX, ORACLE_SQL, PAIRS, SAMPLES, TRIANGLE, _samples, every, grid, grid_source, hour_source, hourly, kind_source, query, table, three
from .sources import store
from .sources.grid import Source
from .sources.tables import fresh_path, stash


@query("sparse_round_trip", f"WITH {GRID} SELECT x, y, CASE WHEN q <> -2147483648 THEN q END AS q, r FROM grid WHERE q <> -2147483648 OR r IS NOT NULL")
def sparse_round_trip(spark, sf_dir):
    path = fresh_path(spark, "sparse")
    store.save_sparse(grid_source(spark, sf_dir, features=["q", "r"]), path)
    return store.open_sparse(spark, path, "grid", ["x", "y"], {"x": 1, "y": 1}).cells().select("x", "y", "q", "r")


@query("block_read", f"WITH {GRID} SELECT x - 2 AS x, y - 3 AS y, n FROM grid WHERE x >= 2 AND x < 7 AND y >= 3 AND y < 6")
def block_read(spark, sf_dir):
    df, _ = validity.indexed(grid_source(spark, sf_dir, features=["n"]))
    return store.read_block(df, {"x": (2, 7), "y": (3, 6)}).select(F.col("i_x").alias("x"), F.col("i_y").alias("y"), "n")


@query("blocks_cached", f"WITH {IDX}, b AS (SELECT DISTINCT i // 100 AS block FROM ix) SELECT CAST(block AS INTEGER) AS block, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n FROM b JOIN ix ON i BETWEEN block * 100 - 5 AND block * 100 + 99 + 2 GROUP BY 1")
def blocks_cached(spark, sf_dir):
    df, _ = validity.indexed(hour_source(spark, sf_dir))
    kept = store.cache_blocks(df, fresh_path(spark, "blocks"), {"t": 100}, {"t": (5, 2)})
    inside = kept.groupBy(F.col("b_t").alias("block")).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.max(F.floor(F.col("i_t") / 100) == F.col("b_t")).alias("own"))
    return inside.where("own").select("block", "cells", "n")


@query("set_cached", f"WITH {HOURLY}{every(3, 'b', 'error')} SELECT 'hours' AS source, count(*) AS n FROM hourly UNION ALL SELECT 'error', count(*) FROM b")
def set_cached(spark, sf_dir):
    found = store.cache_all(three(spark, sf_dir)[:2], fresh_path(spark, "set"))
    parts = [s.cells().agg(F.count(F.lit(1)).alias("n")).select(F.lit(s.name).alias("source"), "n") for s in found]
    return parts[0].unionByName(parts[1])


@query("samples_stored", f"WITH {SAMPLES} SELECT a, b, CAST(m AS BIGINT) AS m FROM pairs")
def samples_stored(spark, sf_dir):
    df, sel = _samples(spark, sf_dir)
    path = fresh_path(spark, "samples")
    store.save_samples(df, path)
    out = sel.select(store.load_samples(spark, path), ["t", "t@1", "error__m"])
    return out.select(F.element_at("t", -1).alias("a"), F.get("`t@1`", F.lit(0)).alias("b"), F.get("error__m", F.lit(0)).alias("m"))


@query("outlines_stored", ORACLE_SQL["region_table"])
def outlines_stored(spark, sf_dir):
    path = fresh_path(spark, "outlines")
    store.save_outlines(spark, {"tri": [TRIANGLE]}, path)
    g = grid(spark, sf_dir).select(F.col("x").cast("double"), F.col("y").cast("double"))
    out = regions.inside_table(g, "x", "y", store.load_outlines(spark, path).select("name", "x0", "y0", "x1", "y1"))
    return out.select(F.col("x").cast("long"), F.col("y").cast("long"), F.array_join("region", ",").alias("region"))


@query("models_sources", f"WITH {IDX} SELECT CAST(i AS BIGINT) AS i, (SELECT CAST(sum(n) AS BIGINT) FROM ix o WHERE o.i BETWEEN ix.i - 1 AND ix.i) AS n, (SELECT CAST(sum(s) AS BIGINT) FROM ix o WHERE o.i BETWEEN ix.i - 1 AND ix.i) AS s FROM ix WHERE i >= 1")
def models_sources(spark, sf_dir):
    models = [SimpleNamespace(inputs=[IOSpec("hours", ["n"], {"t": 2})]), SimpleNamespace(inputs=[IOSpec("hours", ["s", "n"], {"t": 2})])]
    (s,) = store.sources_of_models(models, lambda name: (hourly(spark, sf_dir).drop("h"), ["t"]), options={"*": {"valid_percent": {"t": 1.0}}})
    w = windows.gather(s, validity.centers(s))
    return w.select(F.col("i_t").alias("i"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))


# policies


@query(
    "policy_rotation",
    f"""WITH {IDX}, v AS (SELECT *, sum(CASE WHEN n % 3 <> 0 THEN 1 ELSE 0 END) OVER (ORDER BY i RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM ix)
SELECT CAST(i // 50 % 3 AS INTEGER) AS config, CAST(i AS BIGINT) AS i FROM v WHERE i >= 2 AND (i // 50 % 3 = 0 AND c >= 3 OR i // 50 % 3 = 1 AND c >= {validity.least_valid(0.5, 3)})""",
)
def policy_rotation(spark, sf_dir):
    df = hourly(spark, sf_dir).select("t", F.when(F.col("n") % 3 != 0, F.col("n")).alias("n"))
    s = Source("hours", df, ["t"], window={"t": (2, 0)})
    turns = policies.rotation([{"t": 1.0}, {"t": 0.5}, {"t": 0.0}], [[], [], ["hours"]])
    return policies.centers_in_turn(s, "t", 50, turns).select("config", F.col("i_t").alias("i"))


@query("policy_required", f"WITH {HOURLY}{every(3, 'b', 'error')}{every(24, 'd', 'purchase')} SELECT 'hours' AS name, true AS required, count(*) AS cells FROM hourly UNION ALL SELECT 'error', false, count(*) FROM b UNION ALL SELECT 'purchase', false, count(*) FROM d")
def policy_required(spark, sf_dir):
    """Which sources policies in turn always need, with their cells."""
    turns = policies.rotation([{"t": 1.0}], [["error"], ["purchase"], []])
    parts = [s.cells().agg(F.count(F.lit(1)).alias("cells")).select(F.lit(s.name).alias("name"), F.lit(s.required).alias("required"), "cells") for s in policies.required_under(three(spark, sf_dir), turns)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("percents_override", f"WITH {GRID}, a AS (SELECT x, y, CASE WHEN sum(CASE WHEN q <> -2147483648 THEN 1 ELSE 0 END) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= {validity.least_valid(0.3, 3)} THEN 1 ELSE 0 END AS ok FROM grid), b AS (SELECT x, y, sum(ok) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM a) SELECT x, y FROM b WHERE c >= 3 AND x BETWEEN 1 AND (SELECT max(x) FROM grid) - 1 AND y BETWEEN 1 AND (SELECT max(y) FROM grid) - 1")
def percents_override(spark, sf_dir):
    s = grid_source(spark, sf_dir, window={"x": 1, "y": 1}, valid_percent={"x": 0.9, "y": 0.9})
    return validity.centers(s, percents=policies.with_percents(s, {"x": 0.3})).select("x", "y")


@query("bin_weights", "WITH b AS (SELECT event_type, count(*) AS drawn, count(DISTINCT user_id % 50) / 50.0 AS share FROM events GROUP BY 1), m AS (SELECT sum(drawn / 1000.0) / count(*) AS m FROM b), w AS (SELECT event_type, exp(m - drawn / 1000.0) / (share + 1e-6) AS w FROM b, m) SELECT event_type, round(w / (SELECT sum(w) FROM w), 6) AS weight FROM w")
def bin_weights(spark, sf_dir):
    b = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("drawn"), (F.count_distinct(F.col("user_id") % 50) / 50.0).alias("share"))
    return policies.bin_weights(b, 1000).select("event_type", F.round("weight", 6).alias("weight"))


@query("match_tasks", "WITH s AS (SELECT event_id, row_number() OVER (ORDER BY md5(concat(CAST(event_id AS VARCHAR), '_4')), event_id) - 1 AS row FROM events) SELECT event_id, CAST(row // 300 AS BIGINT) AS task FROM s")
def match_tasks(spark, sf_dir):
    return policies.tasks(table(spark, sf_dir, "events").select("event_id"), "event_id", 300, seed=4)


@query("sparsity_order", f"WITH {GRID} SELECT CASE WHEN (SELECT count(*) FILTER (WHERE q = -2147483648) FROM grid) >= (SELECT count(*) - count(r) FROM grid) THEN 'q' ELSE 'r' END AS first")
def sparsity_order(spark, sf_dir):
    g = grid(spark, sf_dir)
    a = Source("q", g.withColumn("q", F.when(F.col("q") != -2147483648, F.col("q"))), ["x", "y"], features=["q"])
    b = Source("r", g, ["x", "y"], features=["r"])
    return spark.createDataFrame([(policies.sparsest_first([a, b])[0].name,)], "first string")


_NO_DESCENT = "NOT EXISTS (SELECT 1 FROM (SELECT {c} AS c, lead({c}) OVER (ORDER BY {by}) AS n FROM {t}) WHERE n {less} c)"


@query(
    "order_checks",
    "SELECT "
    + ", ".join(
        f"{_NO_DESCENT.format(c=c, by=by, t=t, less=less)} AS {name}"
        for name, c, by, t, less in (("by_time", "ts", "event_id", "events", "<"), ("by_user", "user_id", "event_id", "events", "<"), ("by_name", "n_name", "n_nationkey", "nation", "<="), ("by_date", "o_orderdate", "o_orderkey", "orders", "<"))
    ),
)
def order_checks(spark, sf_dir):
    """Whether tables in the order of their keys ascend in other columns too."""
    found = []
    for t, key, column, strict in (("events", "event_id", "ts", False), ("events", "event_id", "user_id", False), ("nation", "n_nationkey", "n_name", True), ("orders", "o_orderkey", "o_orderdate", False)):
        df = batching.in_order(table(spark, sf_dir, t).select(key, column), [key], "position")
        found.append(policies.is_sorted(df, "position", [column], strict=strict))
    return spark.createDataFrame([tuple(found)], "by_time boolean, by_user boolean, by_name boolean, by_date boolean")


@query("match_order", f"WITH {HOURLY}{every(3, 'b', 'error')}, m AS (SELECT hourly.t AS a, b.t AS b FROM hourly JOIN b ON abs(hourly.t - b.t) <= 1.5 + 1e-5) SELECT a, b, row_number() OVER (ORDER BY a, b) AS place FROM m")
def match_order(spark, sf_dir):
    from .queries import match_two_sources

    placed = batching.in_order(match_two_sources(spark, sf_dir), ["a", "b"], "place")
    return placed.select("a", "b", (F.col("place") + 1).alias("place"))


@query(
    "uniform_chunks",
    f"""WITH {HOURLY}{every(3, 'b', 'error')}, e AS (SELECT least((SELECT min(t) FROM hourly), (SELECT min(t) FROM b)) AS e0, ((SELECT quantile_cont(t, 0.5) FROM hourly) + (SELECT quantile_cont(t, 0.5) FROM b)) / 2 AS e1)
SELECT CAST(0 AS BIGINT) AS bin, (SELECT count(*) FROM hourly, e WHERE t < e1) AS hours, (SELECT count(*) FROM b, e WHERE t < e1) AS error UNION ALL SELECT 1, (SELECT count(*) FROM hourly, e WHERE t >= e1), (SELECT count(*) FROM b, e WHERE t >= e1)""",
)
def uniform_chunks(spark, sf_dir):
    counts = stats.uniform_chunks([hour_source(spark, sf_dir), kind_source(spark, sf_dir, 3, "error", 1.5)], "t", 2, [1, 1])
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(*counts, strict=True))], "bin long, hours long, error long")


@query("set_summaries", f"WITH {HOURLY}{every(3, 'b', 'error')} SELECT 'm' AS feature, CAST(max(m) AS DOUBLE) AS max FROM b UNION ALL SELECT 'n', CAST(max(n) AS DOUBLE) FROM hourly UNION ALL SELECT 's', CAST(max(s) AS DOUBLE) FROM hourly")
def set_summaries(spark, sf_dir):
    return stats.summary_if_valid(three(spark, sf_dir)[:2], coordinates=False).select("feature", "max")


@query("batch_replay", "WITH s AS (SELECT value, row_number() OVER (ORDER BY md5(concat(CAST(event_id AS VARCHAR), '_0')), event_id) - 1 AS row FROM events), n AS (SELECT count(*) AS n FROM s) SELECT CAST(sum(CASE WHEN row < 400 THEN 2 ELSE 1 END) AS BIGINT) AS rows, round(sum(CASE WHEN row < 400 THEN 2 ELSE 1 END * value), 2) AS total FROM s")
def batch_replay(spark, sf_dir):
    """A repeating run replays what it stored: all batches, and the first again when more samples are asked for."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    b, path, n = batching.Batches(e, "event_id", 400, ["value"], repeat=True), fresh_path(spark, "replay"), e.count()
    rows, total = 0, 0.0
    for batch in policies.prepared(b.replay(path, n + 400), lambda x: x):
        rows, total = rows + len(batch["value"]), total + sum(batch["value"])
    return spark.createDataFrame([(rows, total)], "rows long, total double").select("rows", F.round("total", 2).alias("total"))


# selectors, graphs, metrics


@query("sample_available", f"WITH {SAMPLES}, v AS (SELECT (SELECT sum(n) FROM ix o WHERE o.i BETWEEN p.i - 2 AND p.i) AS n, m FROM pairs p) SELECT 'n' AS feature, CAST(sum(n) AS BIGINT) AS total FROM v UNION ALL SELECT 'error__m', CAST(sum(m) AS BIGINT) FROM v")
def sample_available(spark, sf_dir):
    """Of some names those that the samples have, with the sum of all their values."""
    df, sel = _samples(spark, sf_dir)
    there = [f for f in sel.available(["n", ["none"], "error__m", "absent"]) if isinstance(f, str)]
    found = sel.select(df, there)
    sums = [F.sum(F.aggregate(f"`{f}`", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total") for f in there]
    parts = [found.agg(t).select(F.lit(f).alias("feature"), "total") for f, t in zip(there, sums, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("sample_only", f"WITH {SAMPLES} SELECT a, CAST(m AS BIGINT) AS m FROM pairs")
def sample_only(spark, sf_dir):
    df, sel = _samples(spark, sf_dir)
    return df.select(F.element_at("s0.t", -1).alias("a"), F.get(sel.only("m"), F.lit(0)).alias("m"))


@query("graph_checked", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS y, true AS refused FROM lineitem")
def graph_checked(spark, sf_dir):
    g, wide = Graph(), TensorSpec("x", (None, 3))
    g.add_node("double", Node(lambda c: {"x": c["q"] * 2}, gives=[TensorSpec("x")]))
    g.add_node("wide", Node(lambda c: {"y": c["x"]}, takes=[wide]))
    g.add_node("narrow", Node(lambda c: {"y": c["x"]}, takes=[TensorSpec("x")]))
    try:
        g.add_edge("double", "wide")
        refused = False
    except ValueError:
        refused = True
    g.remove_node("wide")
    g.add_edges([("input", "double"), ("double", "narrow"), ("narrow", "output")])
    refused = refused and g.degree("double") == 2 and g.adjacent("double") == ["input", "narrow"] and g.is_isomorphic(g.copy())
    return g.run(table(spark, sf_dir, "lineitem"), {"q": "l_quantity"}, keep=["l_orderkey", "l_linenumber"]).withColumn("refused", F.lit(refused))


@query("graph_renamed", "SELECT l_orderkey, l_linenumber, l_quantity AS amount, l_tax AS t FROM lineitem")
def graph_renamed(spark, sf_dir):
    nest = {"items": {"a": {"q": F.col("l_quantity")}, "b": {"t": F.col("l_tax")}}}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in rename_found(nest, {"a/q": "amount"}).items()])


STITCH = [
    {"W": [[0.5, -0.25, 0.75, 0.1], [0.3, 0.2, -0.1, 0.4]], "U": [[0.2, 0.3, -0.4, 0.6]], "b": [0.1, 1.0, -0.2, 0.05]},
    {"W": [[-0.4, 0.35, 0.6, 0.2], [0.15, -0.3, 0.5, -0.2]], "U": [[0.1, 0.25, 0.3, -0.5]], "b": [0.0, 0.8, 0.1, -0.1]},
]


def _stitched(k: int) -> tuple[str, str]:
    """SQL of cell k's new cell state, and of its output gate."""
    w, o = STITCH[k], 1 - k

    def gate(j: int) -> str:
        return f"(x.x * ({w['W'][0][j]}) + s.h{o} * ({w['W'][1][j]}) + s.h{k} * ({w['U'][0][j]}) + ({w['b'][j]}))"

    def sigmoid(x: str) -> str:
        return f"(1 / (1 + exp(-{x})))"

    return f"({sigmoid(gate(1))} * s.c{k} + {sigmoid(gate(0))} * ((exp(2 * {gate(2)}) - 1) / (exp(2 * {gate(2)}) + 1)))", sigmoid(gate(3))


_ZERO = "'h0': 0.0::DOUBLE, 'c0': 0.0::DOUBLE, 'h1': 0.0::DOUBLE, 'c1': 0.0::DOUBLE"
_NEXT = ", ".join(f"'h{k}': {_stitched(k)[1]} * ((exp(2 * {_stitched(k)[0]}) - 1) / (exp(2 * {_stitched(k)[0]}) + 1)), 'c{k}': {_stitched(k)[0]}" for k in (0, 1))


@query(
    "cross_stitch",
    f"""WITH r AS (SELECT l_orderkey, list({{'x': l_quantity / 50, {_ZERO}}} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey, list_reduce(list_prepend({{'x': 0.0::DOUBLE, {_ZERO}}}, r), lambda s, x: {{'x': 0.0::DOUBLE, {_NEXT}}}) AS s FROM r)
SELECT l_orderkey, round(s.h0, 6) AS h0, round(s.h1, 6) AS h1 FROM f""",
)
def cross_stitch_lstm(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("r"))
    x = F.transform("r", lambda v: F.array((v["l_quantity"] / 50).cast("double")))
    h = a.select("l_orderkey", cross_stitch(x, STITCH).alias("h"))
    return h.select("l_orderkey", *[F.round(F.get(F.get("h", F.lit(k)), F.lit(0)), 6).alias(f"h{k}") for k in (0, 1)])


@query("metric_last_batch", f"WITH {PAIRS} SELECT round(avg((t - p) * (t - p)), 6) AS mse FROM p WHERE l_returnflag = 'R'")
def metric_last_batch(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("t"), (F.round(F.col("l_discount") * 100) + F.col("l_linenumber")).alias("p"))
    last = M.LastBatch(["mse"], "t", "p")
    for flag in ("A", "N", "R"):  # batches one after another
        last.update(df.where(F.col("l_returnflag") == flag))
    return spark.createDataFrame([(last.values["mse"],)], "mse double").select(F.round("mse", 6).alias("mse"))


@query("transformed_loss", f"WITH {GRID} SELECT round(avg(abs(ln(n) - ln(q))), 6) AS loss FROM grid WHERE q <> -2147483648")
def transformed_loss(spark, sf_dir):
    g = grid(spark, sf_dir).where("q <> -2147483648")
    return g.agg(F.round(M.loss_of(F.col("n").cast("double"), F.col("q").cast("double"), lambda t, p: F.abs(t - p), F.ln), 6).alias("loss"))


@query(
    "halo_sparse",
    f"""WITH {GRID}, v AS (SELECT x, CAST(sum(n) AS BIGINT) AS n FROM grid WHERE q <> -2147483648 GROUP BY x), p AS (SELECT block, unnest(range(-1, least(4, 11 - block * 4) + 1)) AS position FROM range(3) b(block))
SELECT CAST(block AS INTEGER) AS block, CAST(position AS INTEGER) AS position, n FROM p JOIN v ON x = block * 4 + position""",
)
def halo_sparse(spark, sf_dir):
    v = grid(spark, sf_dir).where("q <> -2147483648").groupBy("x").agg(F.sum("n").alias("n"))
    out = halo.overlap_nd(v, ["x"], "n", [11], [4], [(1, 1)], ["none"], sparse=True)
    return out.select(F.col("block_0").alias("block"), F.col("position_0").alias("position"), "n")
