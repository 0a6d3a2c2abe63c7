"""Summaries that grow: partial statistics of blocks with quantile sketches, stored, merged, and turned into summaries.

A partial has counts, sums, squared deviations from its own mean, extremes and a KLL sketch for each feature; partials merge in any order
and number, over blocks, generations and micro-batches. A quantile of a sketch of size ``k`` is a value whose rank is off
by about 2.3 / k ** 0.9 of all values at most (99 % of the time; k = 4096: 0.13 %), however often it was merged; up to
``k`` values are kept as they are, so quantiles of so many are exact. A store that keeps ``values`` also has the different
values with their numbers, which add up like the rest: then quantiles of any number are exact, at the price of as many rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.grid import Source
from ..sources.store import SharedPath
from .stats import PERCENTS, _finite, counted, ranked_percentiles, slice_shares

#: Size of a sketch; a partial of a feature has some 16 * SIZE bytes at most.
SIZE = 4096
#: Stored partials that are merged into one.
FAN = 8
_SUMS = ("n", "missing", "s1", "l1")


def rank_error(k: int = SIZE) -> float:
    """Bound of the rank error of a sketch's quantiles, as a share of all values (99 % of the time)."""
    return 2.296 / k**0.9021


def partial(source: Source, k: int = SIZE, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, n, missing, low, high, s1, d2, l1, e2, sketch): of each feature of a source, for each group of ``by``.

    One aggregation, combined before the exchange. Missing and infinite values count as missing. s1 and d2 are sums of
    values and of squared deviations from their mean, in double precision; l1 and e2 of logarithms of values above 0.
    """
    df = source.cells() if not by else source.cells().select("*")
    each = []
    for f in source.feature_names:
        x = _finite(F.col(f))
        ln = F.when(x > 0, F.ln(x))
        none = F.coalesce(F.count(F.lit(1)) - F.count(x), F.lit(0)).cast("long")
        of = [("s1", F.sum(x)), ("d2", F.var_pop(x) * F.count(x)), ("l1", F.sum(ln)), ("e2", F.var_pop(ln) * F.count(ln))]
        sums = [F.coalesce(v, F.lit(0.0)).alias(n) for n, v in of]
        each.append(F.struct(F.lit(f).alias("feature"), F.count(x).alias("n"), none.alias("missing"), F.min(x).alias("low"), F.max(x).alias("high"), *sums, F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch")).alias(f"__{f}"))
    rows = df.groupBy(*by).agg(*each) if by else df.agg(*each)
    return rows.select(*by, F.inline(F.array(*[F.col(f"__{f}") for f in source.feature_names])))


def merged(partials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Partials of the same feature (and group) as one."""

    def deviations(s: str, d: str):
        """Those inside the partials and those of their means, a partial at a time, so that no large numbers cancel."""
        each = F.collect_list(F.when(F.col("n") > 0, F.struct(F.col("n").cast("double").alias("n"), F.col(s).alias("s"), F.col(d).alias("d"))))
        none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("d"))

        def add(x, y):
            apart = F.when(x["n"] > 0, y["s"] / y["n"] - F.try_divide(x["s"], x["n"])).otherwise(0.0)
            n = x["n"] + y["n"]
            return F.struct(n.alias("n"), (x["s"] + y["s"]).alias("s"), (x["d"] + y["d"] + apart * apart * (x["n"] * y["n"] / n)).alias("d"))

        return F.aggregate(each, none, add)["d"].alias(d)

    aggs = [*[F.sum(c).alias(c) for c in _SUMS], deviations("s1", "d2"), deviations("l1", "e2"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch")]
    out = partials.groupBy(*by, "feature").agg(*aggs)
    return out.select(*by, "feature", "n", "missing", "low", "high", "s1", "d2", "l1", "e2", "sketch")


def summary_of(partials: DataFrame, by: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """The summary of merged partials, as ``stats.summary`` gives it: a row for each feature (and group).

    With ``counts``, the (feature, value, n) of all that the partials hold, percentiles are exact (without groups).
    """

    def spread(deviations: str):
        return F.sqrt(F.try_divide(F.col(deviations), F.col("n")))

    if counts is None:
        ranks = F.array(*[F.lit(p / 100) for p in PERCENTS])
        out = partials.withColumn("__q", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", ranks)))
    else:
        bounds = F.kll_sketch_get_quantile_double("sketch", slice_shares())
        found = ranked_percentiles(counts, partials.where("n > 0").select("feature", bounds.alias("bounds")))
        out = partials.join(found.withColumnRenamed("pct", "__q"), "feature", "left")
    named = [F.get("__q", F.lit(i)).alias("median" if p == 50 else f"p{p}") for i, p in enumerate(PERCENTS)]
    mean, logs = F.try_divide(F.col("s1"), F.col("n")), F.when(F.col("low") > 0, spread("e2"))
    return out.select(*by, "feature", mean.alias("mean"), F.when(F.col("n") > 0, spread("d2")).alias("std"), F.col("low").alias("min"), F.col("high").alias("max"), F.col("missing").alias("null"), logs.alias("logstd"), *named)


class SummaryStore:
    """Partials in a folder, one table for each increment, merged FAN at a time.

    An increment has a name, and one of the same name that comes again replaces its first try, or is passed over if that is
    merged already: so a batch or a block counts once, however often it is tried. One writer adds at a time.

    With ``values`` the different values of an increment and their numbers lie in a table beside its partials, and the
    summary's percentiles are exact. A store is used with or without them from its first increment on.
    """

    def __init__(self, spark: SparkSession, path: str, k: int = SIZE, values: bool = False):
        self.spark, self.k, self._home = spark, k, SharedPath(spark, path.rstrip("/"))
        self._beside = SharedPath(spark, f"{path.rstrip('/')}~values") if values else None

    def _tables(self) -> list[str]:
        """Tables that count, by their marks: a merged one names what it holds, and these no longer count."""
        if not self._home.exists():
            return []
        names = [n for n in self._home.names() if self._home.join(n, "_SUCCESS").exists()]
        held = {x for n in names if n.startswith("merged~") for x in self._held(n)}
        return sorted(n for n in names if n not in held)

    def _held(self, merged_name: str) -> list[str]:
        mark = self._home.join(merged_name, "_held")
        return mark.read_text().split("\n") if mark.exists() else []

    def _counted(self) -> set[str]:
        """The names of all increments, merged or not."""
        if not self._home.exists():
            return set()
        names = self._home.names()
        return {n for n in names if not n.startswith("merged~")} | {x for n in names if n.startswith("merged~") for x in self._held(n)}

    def add(self, source: Source, name: str) -> None:
        """Adds the partials of a source's cells as the increment ``name``."""
        if name.startswith(("merged~", "_", ".")) or "/" in name:
            raise ValueError(f"{name} is no name of an increment")
        if any(name in self._held(n) for n in (self._home.names() if self._home.exists() else []) if n.startswith("merged~")):
            return
        if self._beside:
            self._home.join(name).delete()  # it counts again when its values are there
            counted(source.cells(), source.feature_names).write.mode("overwrite").parquet(self._beside.join(name).uri)
        partial(source, self.k).write.mode("overwrite").parquet(self._home.join(name).uri)
        tables = self._tables()
        if len(tables) >= FAN:
            self._merge(tables)

    def _merge(self, tables: list[str]) -> None:
        name = f"merged~{uuid.uuid4().hex}"
        target = self._home.join(name)
        if self._beside:
            self._counts(tables).write.parquet(self._beside.join(name).uri)
        merged(self._read(tables)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(target.uri)
        inside = [x for t in tables for x in (self._held(t) if t.startswith("merged~") else [t])]
        target.join("_held").write_new("\n".join([*inside, *[t for t in tables if t.startswith("merged~")]]))
        target.join("_SUCCESS").write_new("")  # from here on it counts, and what it holds does not
        for t in tables:
            self._home.join(t).delete()
            if self._beside:
                self._beside.join(t).delete()

    def _read(self, tables: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[self._home.join(t).uri for t in tables])

    def _counts(self, tables: list[str]) -> DataFrame:
        """(feature, value, n) of what some tables hold."""
        rows = self.spark.read.schema("feature string, value double, n long").parquet(*[self._beside.join(t).uri for t in tables])
        return rows.groupBy("feature", "value").agg(F.sum("n").alias("n"))

    def merged(self) -> DataFrame:
        """One partial for each feature, of all increments."""
        return merged(self._read(self._tables()))

    def summary(self) -> DataFrame:
        return summary_of(self.merged(), counts=self._counts(self._tables()) if self._beside else None)


def into_summaries(stream: DataFrame, store: SummaryStore, dims: Sequence[str], features: Sequence[str], checkpoint: str):
    """Runs what is there now of a stream into a store of summaries; each micro-batch is an increment that counts once."""
    from ..streaming.incremental import stream_id

    name = stream_id(store.spark, checkpoint)

    def add(batch: DataFrame, epoch: int) -> None:
        store.add(Source("batch", batch, dims, features=features), f"{name}-{epoch}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
