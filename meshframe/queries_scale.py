"""Queries of the operators that uneven, dense and growing data need."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import batchfiles, batching, matching, partials, validity, windows
from .queries import EV, GRID, IDX, events, grid_source, hour_source, keys, pts, query
from .sources import chunks, curve
from .sources.grid import Source
from .sources.tables import fresh_path
from .streaming import incremental

#: Hours whose second half lies a million hours later: an axis with a gap of a million times the median.
GAPPED = EV + ", mid AS (SELECT (min(h) + max(h)) // 2 AS m FROM ev)"


def gapped(spark, sf_dir, kind, hours):
    e = events(spark, sf_dir)
    e = e.crossJoin(F.broadcast(e.agg(F.expr("(min(h) + max(h)) div 2").alias("m"))))  # one row
    at = F.expr(f"(h div {hours}) * {hours} + if(h > m, 1000000, 0)").cast("double")
    return Source(kind, e.where(F.col("event_type") == kind).groupBy(at.alias("t")).agg(F.count(F.lit(1)).alias("m")), ["t"])


def _gapped(name: str, kind: str, hours: int) -> str:
    gap, back = "lead(t) OVER (ORDER BY t) - t", "t - lag(t) OVER (ORDER BY t)"
    times = f"SELECT DISTINCT CAST((h // {hours}) * {hours} + CASE WHEN h > m THEN 1000000 ELSE 0 END AS DOUBLE) AS t FROM ev, mid WHERE event_type = '{kind}'"
    return f"{name} AS (SELECT t, 0.5 * coalesce({back}, {gap}) AS l, 0.5 * coalesce({gap}, {back}) AS r FROM ({times}))"


@query(
    "match_levels",
    f"""WITH {GAPPED}, {_gapped("ee", "error", 1)}, {_gapped("uu", "purchase", 5)}
SELECT ee.t AS a, uu.t AS b FROM ee JOIN uu ON uu.t BETWEEN ee.t - ee.l - 1e-5 AND ee.t + ee.r + 1e-5 OR ee.t BETWEEN uu.t - uu.l - 1e-5 AND uu.t + uu.r + 1e-5""",
)
def match_levels(spark, sf_dir):
    return keys(matching.match([pts(gapped(spark, sf_dir, "error", 1)), pts(gapped(spark, sf_dir, "purchase", 5))]), "a", "b")


@query(
    "match_levels_optional",
    f"""WITH {GAPPED}, {_gapped("ee", "error", 1)}, {_gapped("uu", "purchase", 24)}
SELECT ee.t AS a, uu.t AS b FROM ee LEFT JOIN uu ON ee.t - ee.l - 1e-5 <= uu.t + uu.r + 1e-5 AND uu.t - uu.l - 1e-5 <= ee.t + ee.r + 1e-5""",
)
def match_levels_optional(spark, sf_dir):
    e, u = pts(gapped(spark, sf_dir, "error", 1)), pts(gapped(spark, sf_dir, "purchase", 24))
    return keys(matching.match([e, matching.replace(u, required=False)], "locus"), "a", "b")


@query(
    "nearest_uneven",
    f"WITH {GAPPED}, a AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS idx FROM (SELECT DISTINCT CAST((h // 7) * 7 + CASE WHEN h > m THEN 1000000 ELSE 0 END AS DOUBLE) AS t FROM ev, mid WHERE event_type = 'error'))"
    " SELECT event_id, CAST((SELECT idx FROM a ORDER BY abs(t - h), idx LIMIT 1) AS BIGINT) AS idx FROM ev",
)
def nearest_uneven(spark, sf_dir):
    axis = gapped(spark, sf_dir, "error", 7).axis("t")
    return matching.index_of(events(spark, sf_dir).select("event_id", F.col("h").cast("double").alias("v")), "v", axis, "t").select("event_id", "idx")


@query(
    "window_gather_tiles",
    f"""WITH {GRID} SELECT a.x, a.y, string_agg(CAST(b.n AS VARCHAR), ',' ORDER BY b.x, b.y) AS n, string_agg(CAST(b.x AS VARCHAR), ',' ORDER BY b.x, b.y) FILTER (WHERE b.y = a.y) AS xs
FROM grid a JOIN grid b ON b.x BETWEEN a.x - 3 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 1
WHERE a.x BETWEEN 3 AND (SELECT max(x) FROM grid) - 2 AND a.y BETWEEN 2 AND (SELECT max(y) FROM grid) - 1 GROUP BY a.x, a.y""",
)
def window_gather_tiles(spark, sf_dir):
    s = grid_source(spark, sf_dir, features=["n"], window={"x": (3, 2), "y": (2, 1)}, valid_percent={("x", "y"): 0.0})
    w = windows.gather(s, validity.centers(s))

    def text(c):
        return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")

    return w.select(F.get("x", F.lit(3)).alias("x"), F.get("y", F.lit(2)).alias("y"), text("n").alias("n"), text("x").alias("xs"))


@query("window_gather_day", f"WITH {IDX} SELECT t, CAST((SELECT sum(n * (1 + o.i - ix.i + 24)) FROM ix o WHERE o.i BETWEEN ix.i - 24 AND ix.i + 24) AS BIGINT) AS weighted FROM ix WHERE i BETWEEN 24 AND size - 25")
def window_gather_day(spark, sf_dir):
    """Two days around each hour, summed with weights by place."""
    s = hour_source(spark, sf_dir, features=["n"], window={"t": 24}, valid_percent={"t": 0.0})
    w = windows.gather(s, validity.centers(s))
    placed = F.transform("n", lambda v, i: v * (i + 1))
    return w.select(F.get("t", F.lit(24)).alias("t"), F.aggregate(placed, F.lit(0).cast("long"), lambda a, x: a + x).alias("weighted"))


@query("chunk_store_round_trip", f"WITH {GRID} SELECT x, y, n, q, CAST(r AS DOUBLE) / 3 AS r FROM grid")
def chunk_store_round_trip(spark, sf_dir):
    path, s = fresh_path(spark, "array"), grid_source(spark, sf_dir)
    chunks.save(Source("grid", s.frame.withColumn("r", F.col("r").cast("double") / 3), ["x", "y"]), path, {"x": 4, "y": 3})
    return chunks.load(spark, path)


@query("chunk_store_box", "SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_id BETWEEN 200 AND 749 AND ts >= TIMESTAMP '2024-01-01 00:00:00'")
def chunk_store_box(spark, sf_dir):
    """Some features of a box of an array of all events, of which the chunks in the box are opened."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    path = fresh_path(spark, "array")
    chunks.save(Source("events", e, ["event_id"]), path, {"event_id": 100})
    return chunks.load(spark, path, ["user_id", "cents", "ts"]).where("event_id between 200 and 749 and ts >= timestamp_ntz '2024-01-01 00:00:00'").drop("ts")


@query("curve_box", "SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE value BETWEEN 20 AND 60 AND user_id <= 400")
def curve_box(spark, sf_dir):
    """A box of the events laid out along a curve by value and user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    c = curve.save(Source("events", e, ["user_id", "value"]), fresh_path(spark, "curve"), 2000)
    return c.read({"value": (20.0, 60.0), "user_id": (None, 400)}).select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))


PERCENTILES = (1, 10, 25, 50, 75, 90, 99)
_CUMULATIVE = ", ".join(f"min(cents) FILTER (c >= {p / 100}) AS {'median' if p == 50 else f'p{p}'}" for p in PERCENTILES)


@query(
    "summary_merged",
    f"""WITH {EV}, d AS (SELECT cents, cume_dist() OVER (ORDER BY cents) AS c FROM ev)
SELECT 'cents' AS feature, round(avg(cents), 6) AS mean, round(stddev_pop(cents), 6) AS std, CAST(min(cents) AS DOUBLE) AS min, CAST(max(cents) AS DOUBLE) AS max, 0::BIGINT AS "null", {_CUMULATIVE} FROM d""",
)
def summary_merged(spark, sf_dir):
    """The summary of the events from three increments of a store, one of which comes twice; the store keeps the different
    values beside the sketches, so percentiles of any number of events are exact."""
    e = events(spark, sf_dir)
    store = partials.SummaryStore(spark, fresh_path(spark, "summaries"), 60_000, values=True)
    part = F.pmod(F.xxhash64("user_id"), F.lit(3))
    for n in (0, 1, 1, 2):
        store.add(Source("events", e.where(part == n), ["event_id"], features=["cents"]), f"part-{n}")
    out = store.summary()
    marks = [F.col("median" if p == 50 else f"p{p}").cast("long").alias("median" if p == 50 else f"p{p}") for p in PERCENTILES]
    return out.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", "null", *marks)


@query(
    "deficit_batches",
    """WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i, 1 << CAST((row_number() OVER (ORDER BY event_type) - 1) % 3 AS INTEGER) AS w FROM (SELECT DISTINCT event_type FROM events)),
u AS (SELECT event_id, event_type, -ln((CAST(('0x' || substr(md5(concat(CAST(event_id AS VARCHAR), '_5')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656) AS o FROM events),
r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY o, event_id) - 1 AS k FROM u),
d AS (SELECT event_id, r.event_type, row_number() OVER (ORDER BY (2 * k + 1) * 4 // w, i) - 1 AS row FROM r JOIN t ON r.event_type = t.event_type)
SELECT event_id, event_type, CAST(row AS BIGINT) AS row, CAST(row // 64 AS BIGINT) AS batch FROM d""",
)
def deficit_batches(spark, sf_dir):
    """All events in batches in which event types keep to weights 1, 2, 4, 1, ... as long as they last."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())  # a bin each
    return batching.deficit_batches(e, "event_type", "event_id", 64, {k: 1 << i % 3 for i, k in enumerate(kinds)}, seed=5)


@query(
    "stream_recurrence",
    """WITH e AS (SELECT user_id % 20 AS k, ts, CAST(round(value * 100) AS BIGINT) AS v FROM events), m AS (SELECT max(ts) - INTERVAL 6 HOURS AS mark FROM e),
l AS (SELECT k, ts, v, list(v) OVER (PARTITION BY k ORDER BY ts, v ROWS UNBOUNDED PRECEDING) AS before FROM e, m WHERE ts < mark)
SELECT k, ts, CAST(v AS DOUBLE) AS v, round(list_reduce(list_prepend(0::DOUBLE, list_transform(list_slice(before, greatest(1, len(before) - 60), len(before)), lambda x: CAST(x AS DOUBLE))), lambda s, x: s * 0.5 + x * 0.5), 4) AS state FROM l""",
)
def stream_recurrence(spark, sf_dir):
    """A running average by key over a stream of the events' files in no order of time, run twice from one checkpoint: the
    state after each event that the watermark, six hours behind the newest, has passed."""
    path = fresh_path(spark, "recurrence")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 20).alias("k"), "ts", F.round(F.col("value") * 100).cast("double").alias("v"))
    days = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    e = e.withColumn("p", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(days["a"]).cast("timestamp"))) / 1e6 / ((days["b"] - days["a"]).total_seconds() + 1) * 4))
    for half in range(2):  # two runs; in each files of hours in any order, none later than the watermark allows
        for p in (2 * half, 2 * half + 1):
            e.where(F.col("p") == p).drop("p").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = incremental.file_stream(spark, f"{path}/in", "k long, ts timestamp_ntz, v double", 2).withColumn("ts", F.col("ts").cast("timestamp"))
        out = incremental.keyed_recurrence(stream, "k", "ts", "v", lambda x, s: s * 0.5 + x * 0.5, 0.0, "6 hours")
        out.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("k long, ts timestamp, v double, state double").parquet(f"{path}/out")
    return found.select("k", F.col("ts").cast("timestamp_ntz").alias("ts"), "v", F.round("state", 4).alias("state"))


@query("batch_files", "WITH s AS (SELECT event_id, row_number() OVER (ORDER BY md5(concat(CAST(event_id AS VARCHAR), '_4')), event_id) - 1 AS row FROM events) SELECT event_id, CAST(row // 100 AS BIGINT) AS batch, CAST(row // 100 // 5 % 4 AS BIGINT) AS rank FROM s")
def batch_files(spark, sf_dir):
    """Batches of 100 events in files of 5 batches, as four ranks read them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    path = fresh_path(spark, "batches")
    batchfiles.write_batches(batching.batches(e, "event_id", 100, seed=4), path, 5)
    return batchfiles.read_ranks(spark, path, 4, "event_id long, row long, batch long").select("event_id", "batch", "rank")
