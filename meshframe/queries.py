"""Queries over the shared tables, one or more for each operator, each with the SQL that gives the same rows.

Values are taken in cents, so that sums are exact in any order; what is irrational is rounded in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions import scalar as X
from .functions.transforms import Transform
from .operators import archive, batching, halo, matching, regions, stats, validity, windows
from .plans.graph import Graph, Node, recurrence
from .plans.gridded import GriddedRun
from .sources.grid import Source, cell_valid, is_valid
from .sources.tables import fresh_path
from .streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EV = "ev AS (SELECT event_id, user_id, event_type, ts, epoch_us(ts) // 3600000000 AS h, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "ts", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("h"), F.round(F.col("value") * 100).cast("long").alias("cents"))


HOURLY = EV + ", hourly AS (SELECT h, CAST(h AS DOUBLE) AS t, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS s FROM ev GROUP BY h)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("s")).select("h", F.col("h").cast("double").alias("t"), "n", "s")


def every(hours: int, name: str, kind: str) -> str:
    return f", {name} AS (SELECT (h // {hours}) * {hours} AS h, CAST((h // {hours}) * {hours} AS DOUBLE) AS t, CAST(count(*) AS BIGINT) AS m FROM ev WHERE event_type = '{kind}' GROUP BY 1)"


def grouped(spark: SparkSession, sf_dir: str, hours: int, kind: str) -> DataFrame:
    h = F.expr(f"(h div {hours}) * {hours}")
    out = events(spark, sf_dir).where(F.col("event_type") == kind).groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("m"))
    return out.select("h", F.col("h").cast("double").alias("t"), "m")


GRID = """grid AS (SELECT x, y, n, CASE WHEN q % 4 = 0 THEN -2147483648 ELSE q END AS q, CASE WHEN n % 7 = 0 THEN NULL ELSE n END AS r FROM (
  SELECT CAST(round(l_discount * 100) AS BIGINT) AS x, CAST(round(l_tax * 100) AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2))"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.round(F.col("l_discount") * 100).cast("long").alias("x"), F.round(F.col("l_tax") * 100).cast("long").alias("y")
    g = table(spark, sf_dir, "lineitem").groupBy(x, y).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return g.select("x", "y", "n", F.when(F.col("q") % 4 == 0, F.lit(-2147483648)).otherwise(F.col("q")).alias("q"), F.when(F.col("n") % 7 != 0, F.col("n")).alias("r"))


def grid_source(spark: SparkSession, sf_dir: str, **kw) -> Source:
    return Source("grid", grid(spark, sf_dir), ["x", "y"], **({"features": ["q"]} | kw))


def hour_source(spark: SparkSession, sf_dir: str, reach: float = 1.0, **kw) -> Source:
    return Source("hours", hourly(spark, sf_dir).drop("h"), ["t"], **({"match_radius": {"t": reach}} | kw))


def kind_source(spark: SparkSession, sf_dir: str, hours: int, kind: str, reach: float, **kw) -> Source:
    return Source(kind, grouped(spark, sf_dir, hours, kind).drop("h"), ["t"], **({"match_radius": {"t": reach}} | kw))


def pts(source: Source) -> matching.Points:
    return matching.points(source, source.cells(), key=F.col("t"))


# 2.2 projections, filters, predicates


@query("extent_filter", "SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'")
def extent_filter(spark, sf_dir):
    s = Source("events", table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["ts"], extent={"ts": (F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-09 12:00:00'"))})
    return s.cells().drop("ts")


@query("feature_projection", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def feature_projection(spark, sf_dir):
    return Source("items", table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], features=["l_tax", "l_quantity"]).cells()


def _mask(how: str, join: str) -> None:
    @query(f"valid_mask_{how}", f"WITH {GRID} SELECT x, y, (q IS NOT NULL AND q <> -2147483648 AND q <> 101) {join} (r IS NOT NULL AND r <> 101) AS valid FROM grid")
    def valid_mask(spark, sf_dir):
        s = grid_source(spark, sf_dir, features=["q", "r"], valid_feature=how, invalid_value=101.0)
        return s.cells().select("x", "y", cell_valid(s).alias("valid"))


_mask("all", "AND")
_mask("any", "OR")


@query("bin_mask", f"WITH {GRID} SELECT x, y, n FROM grid WHERE n >= 20 AND n < 700 AND x >= 2 AND x < 9")
def bin_mask(spark, sf_dir):
    return grid(spark, sf_dir).where(validity.in_bins({"n": (20, 700), "x": (2, 9)})).select("x", "y", "n")


TRIANGLE = [(0.5, 0.5), (9.5, 1.5), (4.5, 7.5)]


@query(
    "region_mask",
    f"""WITH {GRID}, e(x0, y0, x1, y1) AS (VALUES (0.5, 0.5, 9.5, 1.5), (9.5, 1.5, 4.5, 7.5), (4.5, 7.5, 0.5, 0.5))
SELECT x, y, (SELECT count(*) FROM e WHERE (y0 > y) <> (y1 > y) AND x < x0 + (y - y0) * (x1 - x0) / (y1 - y0)) % 2 = 1 AS inside FROM grid""",
)
def region_mask(spark, sf_dir):
    mask = regions.inside(F.col("x").cast("double"), F.col("y").cast("double"), [TRIANGLE, [(0.0, 0.0), (0.1, 0.0), (0.0, 0.1)]])
    return grid(spark, sf_dir).select("x", "y", mask.alias("inside"))


@query("region_extent", "SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM (" + ORACLE_SQL["region_mask"] + ") WHERE inside")
def region_extent(spark, sf_dir):
    mask = regions.inside(F.col("x").cast("double"), F.col("y").cast("double"), [TRIANGLE])
    return regions.mask_extent(grid(spark, sf_dir), mask, ["x", "y"])


@query("region_table", "SELECT x, y, CASE WHEN inside THEN 'tri' END AS region FROM (" + ORACLE_SQL["region_mask"] + ")")
def region_table(spark, sf_dir):
    ring = [*TRIANGLE, TRIANGLE[0]]
    edges = spark.createDataFrame([("tri", *a, *b) for a, b in zip(ring, ring[1:], strict=False)], "name string, x0 double, y0 double, x1 double, y1 double")
    g = grid(spark, sf_dir).select(F.col("x").cast("double"), F.col("y").cast("double"))
    return regions.inside_table(g, "x", "y", edges).select(F.col("x").cast("long"), F.col("y").cast("long"), F.array_join("region", ",").alias("region"))


@query("region_filter", "SELECT x, y, CASE WHEN inside THEN n END AS n FROM (" + ORACLE_SQL["region_mask"] + ") JOIN (WITH " + GRID + " SELECT * FROM grid) USING (x, y)")
def region_filter(spark, sf_dir):
    mask = regions.inside(F.col("x").cast("double"), F.col("y").cast("double"), [TRIANGLE])
    return regions.masked(grid(spark, sf_dir), mask, ["n"]).select("x", "y", "n")


@query("region_names", "SELECT r_regionkey, r_name FROM region WHERE lower(trim(r_name)) IN ('asia', 'europe')")
def region_names(spark, sf_dir):
    return regions.select_regions(table(spark, sf_dir, "region"), "r_name", [" Asia", "EUROPE "])


@query("preprocessed", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity FROM lineitem WHERE l_quantity > 30")
def preprocessed(spark, sf_dir):
    def large(source, df):
        return df.where("l_quantity > 30")

    def double(source, df):
        return df.withColumn("l_quantity", F.col("l_quantity") * 2)

    return Source("items", table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], features=["l_quantity"], preprocessors=(large, double)).cells()


@query("extent_equalization", f"WITH {HOURLY}{every(3, 'b', 'error')}, e AS (SELECT greatest((SELECT min(t) FROM hourly), (SELECT min(t) + 30 FROM b)) AS lo, least((SELECT max(t) FROM hourly), (SELECT max(t) FROM b)) AS hi) SELECT t, n FROM hourly, e WHERE t BETWEEN coalesce((SELECT max(t) FROM hourly WHERE t < lo), lo) AND coalesce((SELECT min(t) FROM hourly WHERE t > hi), hi)")
def extent_equalization(spark, sf_dir):
    b = kind_source(spark, sf_dir, 3, "error", 1.5)
    low = b.frame.agg(F.min("t")).first()[0] + 30
    return sources_equal(hour_source(spark, sf_dir), b.with_frame(b.frame.where(F.col("t") >= low)))


def sources_equal(a: Source, b: Source) -> DataFrame:
    from .sources.grid import equal_extents

    return equal_extents([a, b])[0].frame.select("t", "n")


# 2.6 windows


@query("axis_index", f"WITH {HOURLY} SELECT t, CAST(dense_rank() OVER (ORDER BY t) - 1 AS BIGINT) AS idx FROM hourly")
def axis_index(spark, sf_dir):
    return hour_source(spark, sf_dir).axis("t")


IDX = HOURLY + ", ix AS (SELECT *, dense_rank() OVER (ORDER BY t) - 1 AS i, (SELECT count(*) FROM hourly) AS size FROM hourly)"


def _window(name: str, percent: float, before: int, after: int) -> None:
    need = validity.least_valid(percent, before + after + 1)

    @query(
        name,
        f"""WITH {IDX}, v AS (SELECT *, sum(CASE WHEN n % 3 <> 0 THEN 1 ELSE 0 END) OVER (ORDER BY i RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING) AS c FROM ix)
SELECT CAST(i AS BIGINT) AS i, t FROM v WHERE c >= {need} AND i BETWEEN {before} AND size - 1 - {after}""",
    )
    def window_valid(spark, sf_dir):
        df = hourly(spark, sf_dir).select("t", F.when(F.col("n") % 3 != 0, F.col("n")).alias("n"))
        s = Source("hours", df, ["t"], window={"t": (before, after)}, valid_percent={"t": percent})
        return validity.centers(s).select(F.col("i_t").alias("i"), "t")


_window("window_valid_all", 1.0, 2, 0)
_window("window_valid_fraction", 0.6, 3, 2)
_window("window_valid_none", 0.0, 1, 1)


@query(
    "window_valid_2d",
    f"""WITH {GRID}, a AS (SELECT x, y, sum(CASE WHEN q <> -2147483648 THEN 1 ELSE 0 END) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS c FROM grid),
b AS (SELECT x, y, sum(c) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM a)
SELECT x, y FROM b WHERE c >= {validity.least_valid(0.75, 12)} AND x BETWEEN 1 AND (SELECT max(x) FROM grid) - 2 AND y BETWEEN 1 AND (SELECT max(y) FROM grid) - 1""",
)
def window_valid_2d(spark, sf_dir):
    s = grid_source(spark, sf_dir, window={"x": (1, 2), "y": 1}, valid_percent={("x", "y"): 0.75})
    return validity.centers(s).select("x", "y")


@query(
    "window_valid_groups",
    f"""WITH {GRID}, a AS (SELECT x, y, CASE WHEN sum(CASE WHEN q <> -2147483648 THEN 1 ELSE 0 END) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 2 THEN 1 ELSE 0 END AS ok FROM grid),
b AS (SELECT x, y, sum(ok) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM a)
SELECT x, y FROM b WHERE c >= 3 AND x BETWEEN 1 AND (SELECT max(x) FROM grid) - 1 AND y BETWEEN 1 AND (SELECT max(y) FROM grid) - 1""",
)
def window_valid_groups(spark, sf_dir):
    s = grid_source(spark, sf_dir, window={"x": 1, "y": 1}, valid_percent={"x": 0.5, "y": 1.0})
    return validity.centers(s).select("x", "y")


@query(
    "window_sparse",
    f"""WITH {GRID}, v AS (SELECT x, y FROM grid WHERE q <> -2147483648)
SELECT x, y FROM v WHERE (SELECT count(*) FROM v o WHERE o.x BETWEEN v.x - 1 AND v.x + 1 AND o.y BETWEEN v.y - 1 AND v.y + 1) >= 7
 AND x BETWEEN 1 AND (SELECT max(x) FROM grid) - 1 AND y BETWEEN 1 AND (SELECT max(y) FROM grid) - 1""",
)
def window_sparse(spark, sf_dir):
    s = grid_source(spark, sf_dir, window={"x": 1, "y": 1}, sparse=True, match_radius={"x": 1, "y": 1})
    return validity.sparse_centers(s, 0.75).select("x", "y")


@query(
    "window_bins",
    f"""WITH {GRID}, m AS (SELECT *, CASE WHEN q <> -2147483648 AND n >= 10 AND n < 640 THEN 1 ELSE 0 END AS ok FROM grid),
a AS (SELECT *, sum(ok) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM m)
SELECT x, y FROM a WHERE c >= 2 AND n >= 10 AND n < 640 AND x BETWEEN 1 AND (SELECT max(x) FROM grid) - 1""",
)
def window_bins(spark, sf_dir):
    s = grid_source(spark, sf_dir, features=["n", "q"], window={"x": 1}, valid_percent={"x": 0.5})
    return validity.centers(s, bins={"n": (10, 640)}).select("x", "y")


@query("window_gather_1d", f"WITH {IDX} SELECT CAST(i AS BIGINT) AS i, string_agg(CAST(n AS VARCHAR), ',' ORDER BY o) AS w FROM (SELECT a.i, b.i AS o, b.n FROM ix a JOIN ix b ON b.i BETWEEN a.i - 3 AND a.i + 1) GROUP BY i")
def window_gather_1d(spark, sf_dir):
    df, _ = validity.indexed(hour_source(spark, sf_dir))
    return windows.gather_1d(df, "i_t", "n", 3, 1).select(F.col("i_t").alias("i"), F.array_join(F.transform("window", lambda v: v.cast("string")), ",").alias("w"))


@query(
    "window_gather_2d",
    f"""WITH {GRID} SELECT a.x, a.y, string_agg(CAST(b.n AS VARCHAR), ',' ORDER BY b.x, b.y) AS n, string_agg(CAST(b.x AS VARCHAR), ',' ORDER BY b.x, b.y) FILTER (WHERE b.y = a.y) AS xs
FROM grid a JOIN grid b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y AND a.y + 1
WHERE a.x BETWEEN 1 AND (SELECT max(x) FROM grid) - 1 AND a.y <= (SELECT max(y) FROM grid) - 1 GROUP BY a.x, a.y""",
)
def window_gather_2d(spark, sf_dir):
    s = grid_source(spark, sf_dir, features=["n"], window={"x": 1, "y": (0, 1)}, valid_percent={("x", "y"): 0.0})
    w = windows.gather(s, validity.centers(s))

    def text(c):
        return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")

    return w.select(F.get("x", F.lit(1)).alias("x"), F.get("y", F.lit(0)).alias("y"), text("n").alias("n"), text("x").alias("xs"))


@query("window_full_dim", f"WITH {GRID} SELECT x, string_agg(CAST(n AS VARCHAR), ',' ORDER BY y) AS n FROM grid GROUP BY x")
def window_full_dim(spark, sf_dir):
    s = grid_source(spark, sf_dir, features=["n"], window={"y": None}, valid_percent={"y": 0.0})
    w = windows.gather(s, validity.centers(s))
    return w.select(F.get("x", F.lit(0)).alias("x"), F.array_join(F.transform("n", lambda v: v.cast("string")), ",").alias("n"))


# 2.3 joins


AB = HOURLY + every(3, "b", "error")
ABC = AB + every(24, "c", "purchase")


def three(spark, sf_dir, **kw) -> list[Source]:
    return [hour_source(spark, sf_dir, 0.5), kind_source(spark, sf_dir, 3, "error", 1.5), kind_source(spark, sf_dir, 24, "purchase", 2.0, **kw)]


def keys(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(names)])


@query("match_two_sources", f"WITH {AB} SELECT hourly.t AS a, b.t AS b FROM hourly JOIN b ON abs(hourly.t - b.t) <= 1.5 + 1e-5")
def match_two_sources(spark, sf_dir):
    return keys(matching.match([pts(s) for s in three(spark, sf_dir)[:2]]), "a", "b")


@query("match_three_sources", f"WITH {ABC} SELECT hourly.t AS a, b.t AS b, c.t AS c FROM hourly JOIN b ON abs(hourly.t - b.t) <= 1.5 + 1e-5 JOIN c ON abs(hourly.t - c.t) <= 2 + 1e-5 AND abs(b.t - c.t) <= 2 + 1e-5")
def match_three_sources(spark, sf_dir):
    return keys(matching.match([pts(s) for s in three(spark, sf_dir)]), "a", "b", "c")


@query("match_pairwise", ORACLE_SQL["match_three_sources"])
def match_pairwise(spark, sf_dir):
    return keys(matching.match_pairwise([pts(s) for s in three(spark, sf_dir)]), "a", "b", "c")


@query("match_locus", f"WITH {AB} SELECT hourly.t AS a, b.t AS b FROM hourly JOIN b ON abs(hourly.t - b.t) <= 2 + 2e-5")
def match_locus(spark, sf_dir):
    return keys(matching.match([pts(s) for s in three(spark, sf_dir)[:2]], "locus"), "a", "b")


@query(
    "match_anchor",
    f"""WITH {ABC}, m AS (SELECT hourly.t AS a, b.t AS b FROM hourly JOIN b ON abs(hourly.t - b.t) <= 1.5 + 1e-5), o AS (SELECT hourly.t AS a, c.t AS c FROM hourly JOIN c ON abs(hourly.t - c.t) <= 2 + 1e-5)
SELECT a, CAST(count(DISTINCT b) AS INTEGER) AS nb, CAST(count(DISTINCT c) AS INTEGER) AS nc, min(b) AS b FROM m JOIN o USING (a) GROUP BY a""",
)
def match_anchor(spark, sf_dir):
    m = matching.match_anchor([pts(s) for s in three(spark, sf_dir)])
    return m.select(F.col("k0").alias("a"), F.size("m1").alias("nb"), F.size("m2").alias("nc"), F.get("m1", F.lit(0)).alias("b"))


@query(
    "match_anchor_allow_empty",
    f"""WITH {ABC} SELECT t AS a, CAST((SELECT count(*) FROM b WHERE abs(hourly.t - b.t) <= 1.5 + 1e-5) AS INTEGER) AS nb, CAST((SELECT count(*) FROM c WHERE abs(hourly.t - c.t) <= 2 + 1e-5) AS INTEGER) AS nc FROM hourly""",
)
def match_anchor_allow_empty(spark, sf_dir):
    m = matching.match_anchor([pts(s) for s in three(spark, sf_dir)], allow_empty=True)
    return m.select(F.col("k0").alias("a"), F.size("m1").alias("nb"), F.size("m2").alias("nc"))


@query("match_optional_source", f"WITH {ABC} SELECT hourly.t AS a, b.t AS b, c.t AS c FROM hourly JOIN b ON abs(hourly.t - b.t) <= 1.5 + 1e-5 LEFT JOIN c ON abs(hourly.t - c.t) <= 2 + 1e-5 AND abs(b.t - c.t) <= 2 + 1e-5")
def match_optional_source(spark, sf_dir):
    return keys(matching.match([pts(s) for s in three(spark, sf_dir, required=False)]), "a", "b", "c")


@query("match_radius_percent", f"WITH {GRID} SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM grid a JOIN grid b ON abs(a.x - b.x) <= 1.25 + 1e-5 AND abs(a.y - b.y) <= 0.5 + 1e-5")
def match_radius_percent(spark, sf_dir):
    s = [grid_source(spark, sf_dir, match_radius={"x": "125%"}), grid_source(spark, sf_dir)]
    m = matching.match([matching.points(o, o.cells(), key=F.struct("x", "y")) for o in s])
    return m.select(F.col("k0.x").alias("ax"), F.col("k0.y").alias("ay"), F.col("k1.x").alias("bx"), F.col("k1.y").alias("by"))


@query("match_radius_raw", f"WITH {GRID} SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM grid a JOIN grid b ON abs(a.x - b.x) <= 2 + 1e-5 AND abs(a.y - b.y) <= 1 + 1e-5")
def match_radius_raw(spark, sf_dir):
    s = [grid_source(spark, sf_dir, match_radius={"x": 2, "y": 1}), grid_source(spark, sf_dir)]
    m = matching.match([matching.points(o, o.cells(), key=F.struct("x", "y")) for o in s])
    return m.select(F.col("k0.x").alias("ax"), F.col("k0.y").alias("ay"), F.col("k1.x").alias("bx"), F.col("k1.y").alias("by"))


@query("match_l2", f"WITH {GRID} SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM grid a JOIN grid b ON pow((a.x - b.x) / 2.0, 2) + pow((a.y - b.y) / 1.5, 2) <= 1 + 1e-5")
def match_l2(spark, sf_dir):
    s = grid_source(spark, sf_dir, match_radius={"x": 2, "y": 1.5})
    m = matching.match([matching.points(s, s.cells(), key=F.struct("x", "y"))] * 2, "l2")
    return m.select(F.col("k0.x").alias("ax"), F.col("k0.y").alias("ay"), F.col("k1.x").alias("bx"), F.col("k1.y").alias("by"))


@query("match_virtual_dim", f"WITH {GRID} SELECT a.x, a.y, b.y AS other FROM grid a JOIN (SELECT y, count(*) FROM grid GROUP BY y) b ON abs(a.y - b.y) <= 1 + 1e-5")
def match_virtual_dim(spark, sf_dir):
    a = grid_source(spark, sf_dir)
    b = Source("rows", grid(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n")), ["y"], match_radius={"y": 1})
    m = matching.match([matching.points(a, a.cells(), key=F.struct("x", "y")), matching.points(b, b.cells(), key=F.col("y"))])
    return m.select(F.col("k0.x").alias("x"), F.col("k0.y").alias("y"), F.col("k1").alias("other"))


def moments(spark: SparkSession, sf_dir: str, kind: str) -> Source:
    """The minutes in which events of a kind came: an axis with gaps of all sizes."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    m = e.groupBy(F.expr("unix_micros(cast(ts as timestamp)) div 60000000").cast("double").alias("t")).agg(F.count(F.lit(1)).alias("m"))
    return Source(kind, m, ["t"])


def _reach(name: str, kind: str) -> str:
    gap, back = "lead(t) OVER (ORDER BY t) - t", "t - lag(t) OVER (ORDER BY t)"
    return f"{name} AS (SELECT t, 0.5 * coalesce({back}, {gap}) AS l, 0.5 * coalesce({gap}, {back}) AS r FROM (SELECT DISTINCT CAST(epoch_us(ts) // 60000000 AS DOUBLE) AS t FROM events WHERE event_type = '{kind}'))"


@query(
    "match_non_uniform",
    f"""WITH {_reach("ee", "error")}, {_reach("uu", "purchase")}
SELECT ee.t AS a, uu.t AS b FROM ee JOIN uu ON uu.t BETWEEN ee.t - ee.l - 1e-5 AND ee.t + ee.r + 1e-5 OR ee.t BETWEEN uu.t - uu.l - 1e-5 AND uu.t + uu.r + 1e-5""",
)
def match_non_uniform(spark, sf_dir):
    return keys(matching.match([pts(moments(spark, sf_dir, k)) for k in ("error", "purchase")]), "a", "b")


@query(
    "implode_matches",
    f"""WITH {AB}, m AS (SELECT hourly.t AS a, b.t AS b FROM hourly JOIN b ON abs(hourly.t - b.t) <= 1.5 + 1e-5), x AS (SELECT a, list(b ORDER BY b) AS b FROM m GROUP BY a)
SELECT array_to_string(list(CAST(a AS BIGINT) ORDER BY a), ',') AS a, array_to_string(list_transform(b, lambda v: CAST(v AS BIGINT)), ',') AS b FROM x GROUP BY b""",
)
def implode_matches(spark, sf_dir):
    m = matching.implode(matching.match([pts(s) for s in three(spark, sf_dir)[:2]]))

    def text(c):
        return F.array_join(F.transform(c, lambda v: v.cast("long").cast("string")), ",")

    return m.select(text("k0").alias("a"), text("k1").alias("b"))


@query("match_sampled", f"WITH {AB}, m AS (SELECT hourly.t AS a, b.t AS b FROM hourly JOIN b ON abs(hourly.t - b.t) <= 1.5 + 1e-5) SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY b ORDER BY md5(concat('{{\"a\":', CAST(CAST(a AS BIGINT) AS VARCHAR), '}}_5'))) AS r FROM m) WHERE r <= 2")
def match_sampled(spark, sf_dir):
    m = keys(matching.match([pts(s) for s in three(spark, sf_dir)[:2]]), "a", "b")
    out = matching.sampled(m.select(F.col("a").cast("long").alias("a"), "b"), 2, seed=5, by=["b"])
    return out.select(F.col("a").cast("double").alias("a"), "b")


def _axis(spark) -> DataFrame:
    return spark.range(12).select((F.col("id") * 40.0 + 5).alias("c"), F.col("id").alias("idx"))


@query("nearest_index", "WITH a AS (SELECT CAST(i AS BIGINT) AS idx, i * 40.0 + 5 AS c FROM range(12) r(i)) SELECT event_id, (SELECT idx FROM a ORDER BY abs(c - value), idx LIMIT 1) AS idx FROM events")
def nearest_index(spark, sf_dir):
    return matching.index_of(table(spark, sf_dir, "events").select("event_id", "value"), "value", _axis(spark), "c").select("event_id", "idx")


@query("nearest_index_tol", "WITH a AS (SELECT CAST(i AS BIGINT) AS idx, i * 40.0 + 5 AS c FROM range(12) r(i)) SELECT event_id, (SELECT CASE WHEN abs(c - value) <= 10 THEN idx END FROM a ORDER BY abs(c - value), idx LIMIT 1) AS idx FROM events")
def nearest_index_tol(spark, sf_dir):
    return matching.index_of(table(spark, sf_dir, "events").select("event_id", "value"), "value", _axis(spark), "c", tol=10.0).select("event_id", "idx")


@query("strict_index", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IN (5, 45) THEN CAST((l_quantity - 5) / 40 AS BIGINT) END AS idx FROM lineitem")
def strict_index(spark, sf_dir):
    return matching.index_of(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", _axis(spark), "c", "strict").select("l_orderkey", "l_linenumber", "idx")


@query("edge_index", "WITH a AS (SELECT i * 40.0 + 5 AS c FROM range(12) r(i)) SELECT event_id, CAST((SELECT count(*) FROM a WHERE c <= value) - 1 AS BIGINT) AS idx FROM events")
def edge_index(spark, sf_dir):
    return matching.index_of(table(spark, sf_dir, "events").select("event_id", "value"), "value", _axis(spark), "c", "left").select("event_id", "idx")


@query("cartesian_slice", "WITH p AS (SELECT n.n_nationkey AS a, r.r_regionkey AS b, row_number() OVER (ORDER BY n.n_nationkey, r.r_regionkey) - 1 AS row FROM nation n, region r) SELECT a, b, CAST(row AS BIGINT) AS row FROM p WHERE row BETWEEN 7 AND 60 AND (row - 7) % 3 = 0")
def cartesian_slice(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_nationkey").alias("v"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("n"), F.col("r_regionkey").alias("v"))
    return matching.cartesian([n, r], 7, 61, 3).select(F.col("v_0").alias("a"), F.col("v_1").alias("b"), "row")


def _samples(spark, sf_dir):
    ss = [s for s in three(spark, sf_dir)[:2]]
    ss[0] = Source("grid/hours", ss[0].frame, ["t"], match_radius={"t": 0.5}, window={"t": (2, 0)}, valid_percent={"t": 1.0})
    cs = [validity.centers(s) for s in ss]
    m = matching.match([matching.points(s, c) for s, c in zip(ss, cs, strict=True)])
    return windows.samples(ss, m, cs), windows.Selector.of(ss)


SAMPLES = IDX + every(3, "b", "error") + ", pairs AS (SELECT ix.i, ix.t AS a, b.t AS b, b.m FROM ix JOIN b ON abs(ix.t - b.t) <= 1.5 + 1e-5 WHERE i >= 2)"


@query("sample_select", f"WITH {SAMPLES} SELECT a, b, CAST(m AS BIGINT) AS m, CAST((SELECT sum(n) FROM ix o WHERE o.i BETWEEN p.i - 2 AND p.i) AS BIGINT) AS n FROM pairs p")
def sample_select(spark, sf_dir):
    df, sel = _samples(spark, sf_dir)
    out = sel.select(df, ["t", "t@1", "error__m", "grid$hours__n"])
    total = F.aggregate("`grid$hours__n`", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(F.element_at("t", -1).alias("a"), F.get("`t@1`", F.lit(0)).alias("b"), F.get("error__m", F.lit(0)).alias("m"), total.alias("n"))


@query("sample_distance", f"WITH {SAMPLES} SELECT a, b, (SELECT sum(o.t - p.b) FROM ix o WHERE o.i BETWEEN p.i - 2 AND p.i) AS d FROM pairs p")
def sample_distance(spark, sf_dir):
    df, sel = _samples(spark, sf_dir)
    d = F.aggregate(F.flatten(sel.column("distance:0:1")["t"]), F.lit(0.0), lambda a, x: a + x)
    return df.select(F.element_at("s0.t", -1).alias("a"), F.get("s1.t", F.lit(0)).alias("b"), d.alias("d"))


@query("sample_mean_coordinate", f"WITH {SAMPLES} SELECT ((SELECT avg(o.t) FROM ix o WHERE o.i BETWEEN p.i - 2 AND p.i) + b) / 2 AS t FROM pairs p")
def sample_mean_coordinate(spark, sf_dir):
    df, sel = _samples(spark, sf_dir)
    return sel.mean_coordinates(df)


def _last_total(spark, sf_dir, **kw) -> GriddedRun:
    a = Source("hours", hourly(spark, sf_dir).drop("h"), ["t"], match_radius={"t": 0.5}, window={"t": (2, 0)}, valid_percent={"t": 1.0})
    return GriddedRun([a, kind_source(spark, sf_dir, 3, "error", 1.5)], ["n", "error__m"], {"t": ("t@0", True)}, **kw)


GRIDDED = f"WITH {SAMPLES} SELECT a AS t, CAST((SELECT sum(n) FROM ix o WHERE o.i BETWEEN p.i - 2 AND p.i) * 2 + m AS DOUBLE) AS y FROM pairs p"


@query("gridded_graph", GRIDDED)
def gridded_graph(spark, sf_dir):
    def net(c):
        return {"y": (F.aggregate(c["n"], F.lit(0).cast("long"), lambda a, x: a + x) * 2 + F.get(c["error__m"], F.lit(0))).cast("double")}

    return _last_total(spark, sf_dir, graph=net).predictions()


@query("gridded_model", GRIDDED)
def gridded_model(spark, sf_dir):
    def model():
        return lambda pdf: pdf.assign(y=[float(sum(n) * 2 + m[0]) for n, m in zip(pdf["n"], pdf["error__m"], strict=True)])[["t", "y"]]

    return _last_total(spark, sf_dir, model=model, outputs="y double").predictions()


# 2.4 aggregations


@query(
    "summary_stats",
    f"""WITH {HOURLY} {" UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS std, CAST(min({f}) AS DOUBLE) AS min, CAST(max({f}) AS DOUBLE) AS max, count(*) - count({f}) AS null_count, round(stddev_pop(ln({f})), 6) AS logstd FROM hourly" for f in ("n", "s", "t"))}""",
)
def summary_stats(spark, sf_dir):
    s = stats.summary(hour_source(spark, sf_dir))
    return s.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", F.col("null").alias("null_count"), F.round("logstd", 6).alias("logstd"))


@query("summary_percentiles", f"WITH {HOURLY} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, quantile_cont(CAST({f} AS DOUBLE), 0.05) AS p5, quantile_cont(CAST({f} AS DOUBLE), 0.25) AS p25, quantile_cont(CAST({f} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({f} AS DOUBLE), 0.75) AS p75 FROM hourly" for f in ("n", "s")))
def summary_percentiles(spark, sf_dir):
    return stats.summary(hour_source(spark, sf_dir), exact=True, coordinates=False).select("feature", "p5", "p25", "median", "p75")


@query("summaries_keep_last", f"WITH {ABC} SELECT 'm' AS feature, CAST(max(m) AS DOUBLE) AS max FROM c UNION ALL SELECT 'n', CAST(max(n) AS DOUBLE) FROM hourly UNION ALL SELECT 's', CAST(max(s) AS DOUBLE) FROM hourly UNION ALL SELECT 't', max(t) FROM c")
def summaries_keep_last(spark, sf_dir):
    return stats.summaries(three(spark, sf_dir)).select("feature", "max")


@query("sparsity", f"WITH {GRID} SELECT 1 - (count(n) + count(r)) / (2.0 * count(*)) AS sparsity FROM grid")
def sparsity(spark, sf_dir):
    return stats.sparsity(grid_source(spark, sf_dir, features=["n", "r"]))


@query("histogram_bins", f"WITH {HOURLY}, b(bin, lo, hi) AS (VALUES (0, 0, 10), (1, 10, 14), (2, 14, 20), (3, 20, 1000000)) SELECT CAST(bin AS INTEGER) AS bin, (SELECT count(*) FROM hourly WHERE n >= lo AND n < hi) AS n FROM b")
def histogram_bins(spark, sf_dir):
    return stats.histogram(hourly(spark, sf_dir), "n", [0, 10, 14, 20, 1_000_000])


@query("nonempty_bins", f"WITH {GRID} SELECT x // 4 AS x, y // 5 AS y, count(*) AS n FROM grid WHERE x < 12 AND y < 10 GROUP BY 1, 2")
def nonempty_bins(spark, sf_dir):
    out = stats.nonempty_bins(grid(spark, sf_dir), {"x": [0, 4, 8, 12], "y": [0, 5, 10]}, joint=True)
    return out.select(F.col("x").cast("long"), F.col("y").cast("long"), "n")


@query("entropy_bits", "WITH p AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS s FROM p) SELECT 'event_type' AS \"column\", round(-sum(n / s * log2(n / s)), 6) AS entropy FROM p, t")
def entropy_bits(spark, sf_dir):
    return stats.entropy(table(spark, sf_dir, "events"), ["event_type"]).select("column", F.round("entropy", 6).alias("entropy"))


PAIRS = "p AS (SELECT l_returnflag, l_quantity AS t, CAST(round(l_discount * 100) AS DOUBLE) + l_linenumber AS p FROM lineitem)"


@query(
    "metrics_by_group",
    f"""WITH {PAIRS}, a AS (SELECT l_returnflag, avg((t - p) * (t - p)) AS mse, sum((p - t) * (p - t)) AS e, count(*) AS n, var_pop(t) AS v, corr(t, p) AS r, stddev_pop(t) AS st, stddev_pop(p) AS sp, avg(t) AS mt, avg(p) AS mp, avg((p - t) / t) AS re FROM p GROUP BY 1)
SELECT l_returnflag, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(1 - e / (n * v), 6) AS nse, round(1 - sqrt(pow(r - 1, 2) + pow(sp / st - 1, 2) + pow(mp / mt - 1, 2)), 6) AS kge,
 round(r, 6) AS pearsonr, round(sp / st, 6) AS alpha_nse, round((mp - mt) / st, 6) AS beta_nse, round(re, 6) AS relative_error, round(r * r, 6) AS r2 FROM a""",
)
def metrics_by_group(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("t"), (F.round(F.col("l_discount") * 100) + F.col("l_linenumber")).alias("p"))
    names = ["mse", "rmse", "nse", "kge", "pearsonr", "alpha_nse", "beta_nse", "relative_error", "r2"]
    out = M.Metrics().evaluate(df, "t", "p", names, ["l_returnflag"])
    return out.select("l_returnflag", *[F.round(n, 6).alias(n) for n in names])


@query("metric_logs", f"WITH {PAIRS}, a AS (SELECT ln(t) AS t, ln(p) AS p FROM p WHERE p > 0) SELECT round(1 - sum((p - t) * (p - t)) / (count(*) * var_pop(t)), 6) AS nse_log, (SELECT round((log2(sum(t)) - sum(t * log2(t)) / sum(t)) / count(*), 9) FROM p) AS entropy FROM a")
def metric_logs(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("t"), (F.round(F.col("l_discount") * 100) + F.col("l_linenumber")).alias("p"))
    return df.agg(F.round(M.nse_log(F.col("t"), F.col("p")), 6).alias("nse_log"), F.round(M.metric_entropy(F.col("t")), 9).alias("entropy"))


@query("masked_loss", f"WITH {GRID} SELECT coalesce(avg(CASE WHEN r IS NOT NULL THEN (n - x) * (n - x) END), 0.0) AS loss FROM grid WHERE q <> -2147483648")
def masked_loss(spark, sf_dir):
    d = F.when(F.col("r").isNotNull(), (F.col("n") - F.col("x")) * (F.col("n") - F.col("x")))
    return grid(spark, sf_dir).where(is_valid(F.col("q"))).agg(M.masked_loss(d).alias("loss"))


# 2.9 transforms and scalars


STATS = {"value": {"mean": 120.0, "std": 80.0, "min": -20.0, "max": 490.0, "median": 100.0, "p25": 60.0, "p75": 180.0}}


def _transform(name: str, spec: str, forward: str, inverse: bool = True) -> None:
    back = "round(value, 4)" if inverse else "CAST(NULL AS DOUBLE)"

    @query(f"t_{name}", f"SELECT event_id, round({forward}, 6) AS y, {back} AS x FROM events")
    def transformed(spark, sf_dir):
        t = Transform(STATS, spec)
        y = t.forward(F.col("value"), "value")
        x = F.round(t.inverse(y, "value"), 4) if inverse else F.lit(None).cast("double")
        return table(spark, sf_dir, "events").select("event_id", F.round(y, 6).alias("y"), x.alias("x"))


E = 1e-6
_transform("identity", "identity", "value")
_transform("logexp", "logexp", f"ln(value + {E})")
_transform("logexpp1", "logexpp1", f"sign(value) * ln(1 + abs(value) + {E})")
_transform("standardize", "standardize", f"(value - 120) / (80 + {E})")
_transform("robust", "robust", f"(value - 100) / (120 + {E})")
_transform("normalize", "normalize", f"(value + 20) / (510 + {E}) * 2 - 1")
_transform("normalize_unit", "normalize|minim=0|maxim=1", f"(value + 20) / (510 + {E})")
_transform("iqrnorm", "iqrnorm", f"(value - 60) / (120 + {E}) * 2 - 1")
_transform("adaptnorm", "adaptnorm", f"(value + 20) / (510 + {E}) * 25.5 - 1")
_transform("asinh", "asinh", f"asinh(value / (120 / 1.349 + {E}))")
_transform("clip", "clip|minim=50|maxim=200", "least(200, greatest(50, value))", False)
_transform("combination", "standardize,normalize", f"((value - 120) / (80 + {E}) - (-140 / (80 + {E}))) / (510 / (80 + {E}) + {E}) * 2 - 1")


@query("t_quantile_uniform", "SELECT event_id, round(CASE WHEN value <= -20 THEN 0 WHEN value < 60 THEN (value + 20) / 80 * 24.5 WHEN value < 100 THEN 24.5 + (value - 60) / 40 * 25 WHEN value < 180 THEN 49.5 + (value - 100) / 80 * 25 WHEN value < 490 THEN 74.5 + (value - 180) / 310 * 24.5 ELSE 99 END / 99 + 1e-8, 6) AS y FROM events")
def t_quantile_uniform(spark, sf_dir):
    t = Transform(STATS, "quantile|target=uniform")
    return table(spark, sf_dir, "events").select("event_id", F.round(t.forward(F.col("value"), "value") + 1e-8, 6).alias("y"))  # no value then lies between two roundings


@query("t_by_feature", f"SELECT l_orderkey, l_linenumber, round((l_quantity - 25) / (10 + {E}), 6) AS l_quantity, round(ln(l_tax + {E}), 6) AS l_tax, l_discount FROM lineitem")
def t_by_feature(spark, sf_dir):
    t = Transform({"l_quantity": {"mean": 25.0, "std": 10.0}, "l_tax": {"mean": 0.0}}, {"l_quantity": "standardize", "*": "logexp"})
    out = t.apply(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"))
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"), "l_discount")


@query("cyclic_time", "WITH m AS (SELECT event_id, epoch_us(ts) / 6e7 AS m FROM events) SELECT event_id, round(sin(fmod(m, 1440) / 1440 * 2 * pi()), 5) AS sin_1, round(cos(fmod(m, 1440) / 1440 * 2 * pi()), 5) AS cos_1, round(sin(fmod(m, 1440 * 365.2425) / (1440 * 365.2425) * 2 * pi()), 5) AS sin_365, round(cos(fmod(m, 1440 * 365.2425) / (1440 * 365.2425) * 2 * pi()), 5) AS cos_365 FROM m")
def cyclic_time(spark, sf_dir):
    cols = X.cyclic(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", *[F.round(c, 5).alias(n) for n, c in cols.items()])


@query("one_hot", "SELECT l_orderkey, l_linenumber, CASE WHEN trunc(l_quantity / 10) = 0 THEN 1 ELSE 0 END AS q_0, CASE WHEN trunc(l_quantity / 10) = 2 THEN 1 ELSE 0 END AS q_2 FROM lineitem")
def one_hot(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("q"))
    return df.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in X.one_hot("q", [0, 2]).items()])


@query("lookback_range", "SELECT event_id, ts - INTERVAL 6 HOURS AS first, ts AS last FROM events")
def lookback_range(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("r", X.lookback(F.col("ts"), 6))
    return e.select("event_id", F.get("r", F.lit(0)).alias("first"), F.get("r", F.lit(1)).alias("last"))


@query("ravel_index", f"WITH {GRID} SELECT x, y, x * 9 + y AS flat FROM grid WHERE y < 9")
def ravel_index(spark, sf_dir):
    flat = X.ravel([F.col("x"), F.col("y")], [11, 9])
    df = grid(spark, sf_dir).where("y < 9").select(flat.alias("flat"))
    x, y = X.unravel(F.col("flat"), [11, 9])
    return df.select(x.alias("x"), y.alias("y"), "flat")


INDUCED = stats.induced_bins([0, 60, 100, 180, 500], [0, 0.25, 0.5, 0.75, 1.0], n=6, alpha=0.25)


@query("induced_bins", "WITH b(bin, lo, hi) AS (VALUES " + ", ".join(f"({i}, {a!r}, {b!r})" for i, (a, b) in enumerate(zip(INDUCED, INDUCED[1:], strict=False))) + ") SELECT CAST(bin AS INTEGER) AS bin, (SELECT count(*) FROM events WHERE value >= lo AND value < hi) AS n FROM b")
def induced(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events"), "value", INDUCED)


# 2.12 batching


SHUFFLED = "s AS (SELECT event_id, value, event_type, row_number() OVER (ORDER BY md5(concat(CAST(event_id AS VARCHAR), '_7')), event_id) - 1 AS row FROM events)"


@query("batches", f"WITH {SHUFFLED} SELECT event_id, CAST(row AS BIGINT) AS row, CAST(row // 64 AS BIGINT) AS batch FROM s")
def batches(spark, sf_dir):
    return batching.batches(table(spark, sf_dir, "events").select("event_id"), "event_id", 64, seed=7)


@query("batch_shapes", f"WITH {SHUFFLED} SELECT CAST(row // 64 AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1")
def batch_shapes(spark, sf_dir):
    b = batching.stacked(batching.batches(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 64, seed=7), ["value"])
    return b.select("batch", F.size("value").alias("n"), F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


STRATA = [{"value": (0, 50)}, {"value": (50, 100)}, {"value": (100, 500)}, {"value": (600, 700)}]


@query(
    "stratified_batches",
    """WITH f(config, lo, hi) AS (VALUES (0, 0, 50), (1, 50, 100), (2, 100, 500), (3, 600, 700)),
r AS (SELECT CAST(config AS INTEGER) AS config, event_id, row_number() OVER (PARTITION BY config ORDER BY md5(concat(CAST(event_id AS VARCHAR), '_3')), event_id) - 1 AS row FROM events JOIN f ON value >= lo AND value < hi),
m AS (SELECT min(n // 16) AS least FROM (SELECT count(*) AS n FROM r GROUP BY config))
SELECT config, CAST(row // 16 AS BIGINT) AS batch, CAST(row AS BIGINT) AS row, event_id FROM r, m WHERE row // 16 < least""",
)
def stratified_batches(spark, sf_dir):
    out = batching.stratified(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", STRATA, 16, seed=3)
    return out.select("config", "batch", F.col("row").cast("long"), "event_id")


@query(
    "multi_config_batches",
    """WITH p AS (SELECT 0 AS config, event_id AS id, value, NULL AS m FROM events WHERE event_type = 'error' UNION ALL SELECT 1, event_id, NULL, user_id FROM events WHERE event_type = 'purchase'),
r AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY md5(concat(CAST(id AS VARCHAR), '_1')), id) - 1 AS row FROM p),
s AS (SELECT min((n + 31) // 32) AS least FROM (SELECT count(*) AS n FROM p GROUP BY config))
SELECT config, CAST(row // 32 AS BIGINT) AS batch, id, value, m FROM r, s WHERE row // 32 < least""",
)
def multi_config_batches(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("id"), "value")
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("m"))
    return batching.multi_config([a, b], "id", 32, seed=1).select("config", "batch", "id", "value", "m")


@query("limit_groups", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat(CAST(event_id AS VARCHAR), '_0')), event_id) AS r FROM events) WHERE r <= 5")
def limit_groups(spark, sf_dir):
    return batching.limit_groups(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], "event_id", 5)


# archive, graph, recurrence, halo, increments


ARCHIVE = f"""WITH {EV}, p AS (SELECT CAST(least(11, greatest(0, ceil((cents / 100.0 - 5) / 40 - 0.5))) AS BIGINT) AS i_c, user_id, cents FROM ev)
SELECT i_c, CAST(sum(cents) AS DOUBLE) / count(*) AS cents FROM p GROUP BY i_c"""


def _values(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select((F.col("cents") / 100.0).alias("c"), "cents", "user_id")


@query("archive_mean", ARCHIVE)
def archive_mean(spark, sf_dir):
    df = archive.placed(_values(spark, sf_dir), {"c": _axis(spark)})
    return archive.means(archive.cell_sums(df, ["i_c"], ["cents"]), ["i_c"], ["cents"])


@query("archive_incremental", ARCHIVE)
def archive_incremental(spark, sf_dir):
    v = _values(spark, sf_dir)
    return incremental.micro_batches([v.where(F.col("user_id") % 3 == i) for i in range(3)], {"c": _axis(spark)}, ["cents"])


def _pipeline_graph() -> Graph:
    inner = Graph("inner")
    inner.add_node("scale", Node(lambda c: {"y": c["x"] * 2.0}, ["x"], ["y"]))
    inner.add_edge("input", "scale", rename={"items__q": "x"})
    inner.add_edge("scale", "output")
    g = Graph("demo")
    g.add_node("net", Node(lambda c: {"net": c["price"] * (1 - c["discount"])}, ["price", "discount"], ["net"]))
    g.add_node("inner", inner)
    g.add_node("mix", Node(lambda c: [c["net"] + c["y"]], ["net", "y"], ["total"]))
    g.add_edge("input", "net", ["price", "discount"])
    g.add_edge("input", "inner", labels=["items"])
    g.add_edge("net", "mix")
    g.add_edge("inner", "mix")
    g.add_edge("mix", "output", ["total"])
    g.add_edge("net", "output", ["net"], rename={"net": "net_price"})
    return g


@query("graph_pipeline", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net_price, round(l_extendedprice * (1 - l_discount) + 2 * l_quantity, 4) AS total FROM lineitem")
def graph_pipeline(spark, sf_dir):
    out = _pipeline_graph().run(table(spark, sf_dir, "lineitem"), {"price": "l_extendedprice", "discount": "l_discount", "items__q": "l_quantity"}, keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.round("net_price", 4).alias("net_price"), F.round("total", 4).alias("total"))


@query("recurrence_ema", "SELECT l_orderkey, round(list_reduce(list_prepend(CAST(0 AS DOUBLE), list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)), lambda s, x: s * 0.5 + x * 0.5), 6) AS ema FROM lineitem GROUP BY l_orderkey")
def recurrence_ema(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("r"))
    x = F.transform("r", lambda v: v["l_quantity"])
    return a.select("l_orderkey", F.round(recurrence(x, F.lit(0.0), lambda v, s: s * 0.5 + v * 0.5), 6).alias("ema"))


def _halo(boundary: str, at: str, where: str = "true", value: str = "n") -> None:
    @query(
        f"halo_{boundary}",
        f"""WITH {GRID}, g AS (SELECT x AS i, CAST(sum(n) AS BIGINT) AS n FROM grid GROUP BY x), size AS (SELECT count(*) AS n FROM g), b AS (SELECT unnest(range(0, CAST(ceil(n / 4.0) AS BIGINT))) AS block, n AS size FROM size),
p AS (SELECT block, size, unnest(range(-2, least(4, size - block * 4) + 2)) AS pos FROM b), q AS (SELECT block, pos, size, block * 4 + pos AS j FROM p)
SELECT CAST(block AS INTEGER) AS block, pos AS position, {value} AS n FROM (SELECT block, pos, j, size, {at} AS k FROM q) LEFT JOIN (SELECT i, n FROM g) g ON g.i = k WHERE {where}""",
    )
    def halos(spark, sf_dir):
        g = grid(spark, sf_dir).groupBy(F.col("x").alias("i")).agg(F.sum("n").alias("n"))
        out = halo.overlap(g, "i", "n", g.count(), 4, 2, 2, boundary, constant=-5)
        return out.select("block", F.col("position").cast("long"), F.col("n").cast("long"))


_halo("reflect", "CASE WHEN j < 0 THEN -j - 1 WHEN j >= size THEN 2 * size - 1 - j ELSE j END")
_halo("periodic", "((j % size) + size) % size")
_halo("nearest", "greatest(0, least(size - 1, j))")
_halo("none", "j", "j >= 0 AND j < size")
_halo("constant", "j", value="CASE WHEN j < 0 OR j >= size THEN -5 ELSE n END")


@query("extent_steps", f"WITH {HOURLY}, i AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, (SELECT count(*) FROM hourly) - 1 AS last FROM hourly) SELECT a.t AS low, b.t AS high FROM i a JOIN i b ON b.i = least(a.i + 100, a.last) WHERE a.i % 100 = 0 AND a.i < a.last")
def extent_steps(spark, sf_dir):
    found = [e["t"] for e in incremental.Extents("t", "steps", steps=100).all(hour_source(spark, sf_dir).axis("t"))]
    return spark.createDataFrame(found, "low double, high double")


def _streamed(spark, sf_dir, build, mode: str) -> DataFrame:
    """What a stream over the events' file gives once all of it has arrived: the last batch's table in the shared folder."""
    raw = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(raw.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    out = build(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    path = fresh_path(spark, "stream")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{epoch}")

    q = out.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    last = (q.lastProgress or {"batchId": 0})["batchId"]
    return spark.read.schema(out.schema).parquet(f"{path}/{last}" if mode == "complete" else f"{path}/*")


@query("stream_running_mean", "SELECT event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS cents, count(*) AS n FROM events GROUP BY 1")
def stream_running_mean(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: incremental.running_mean(s.withColumn("cents", F.round(F.col("value") * 100).cast("long")), ["event_type"], "cents"), "complete")


@query("stream_windowed", "SELECT date_trunc('hour', ts) AS start, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed(spark, sf_dir):
    out = _streamed(spark, sf_dir, lambda s: incremental.windowed(s.withColumn("cents", F.round(F.col("value") * 100).cast("long")), "ts", "1 hour", "1 hour", ["event_type"], "cents"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with a full window of two before them, matched to daily counts, with the window gathered."""
    a = Source("hours", hourly(spark, sf_dir).drop("h"), ["t"], window={"t": (2, 0)}, valid_percent={"t": 1.0}, match_radius={"t": 1.0})
    b = kind_source(spark, sf_dir, 24, "purchase", 12.0)
    cs = [validity.centers(a), validity.centers(b)]
    m = matching.match([matching.points(s, c) for s, c in zip((a, b), cs, strict=True)])
    return windows.samples([a, b], m, cs).select("k0.*", F.col("s0.n").alias("n"), F.col("s0.t").alias("t"), F.get("s1.m", F.lit(0)).alias("m"))


FLAGSHIP_SQL = f"""WITH {IDX}{every(24, 'd', 'purchase')}
SELECT CAST(i AS BIGINT) AS i, (SELECT CAST(sum(n) AS BIGINT) FROM ix o WHERE o.i BETWEEN ix.i - 2 AND ix.i) AS n, ix.t, d.m FROM ix JOIN d ON abs(ix.t - d.t) <= 12 + 1e-5 WHERE i >= 2"""


@query("flagship", FLAGSHIP_SQL)
def flagship_rows(spark, sf_dir):
    out = flagship(spark, sf_dir)
    return out.select(F.col("i_t").alias("i"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.element_at("t", -1).alias("t"), "m")


from . import queries_more, queries_scale, queries_stores  # noqa: E402,F401  (adds to QUERIES and ORACLE_SQL)
