"""Summaries of sources, histograms of values, and bins induced from quantiles."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.grid import Source, cell_valid, neighbours

#: Percentiles of a summary; the 50th is named median.
PERCENTS = tuple(range(1, 100))
#: Slices in which values are ranked.
SLICES = 1000


def _finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)


def statistic_names() -> list[str]:
    return ["mean", "std", "min", "max", "null", "logstd", *["median" if p == 50 else f"p{p}" for p in PERCENTS]]


def slice_shares() -> Column:
    """Shares of all values at which a sketch is asked for the bounds of slices, as a constant."""
    return F.split(F.lit(",".join(str(i / SLICES) for i in range(1, SLICES))), ",").cast("array<double>")


def counted(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, n): the different values of each feature and how often they occur."""
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), _finite(F.col(f)).alias("value")) for f in features]))
    return df.select(each).where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def ranked_percentiles(counts: DataFrame, bounds: DataFrame) -> DataFrame:
    """(feature, pct): for each percentile the least value that so many of all values do not exceed, whatever their number.

    ``counts`` has (feature, value, n), each value once; ``bounds`` (feature, bounds) with ascending values, which cut the
    values into slices and may come from a sketch: they decide how even slices are, not the result. Slices are summed up,
    and the values of those that hold a percentile are ranked within their slice.
    """
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(SLICES.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda k, step: F.when(F.get("bounds", k + step - 1) < F.col("value"), k + step).otherwise(k))
    cut = counts.join(F.broadcast(bounds), "feature").select("feature", "value", "n", below.alias("__slice"))  # a row a feature
    sums = cut.groupBy("feature", "__slice").agg(F.sum("n").alias("held"))
    w = Window.partitionBy("feature")  # SLICES rows
    upto = F.sum("held").over(w.orderBy("__slice"))
    spans = sums.select("feature", "__slice", (upto - F.col("held")).alias("__before"), upto.alias("__upto"), F.sum("held").over(w).alias("__all"))

    def percent(rank: str) -> Column:
        """The greatest percentile that so many values reach."""
        return F.least(F.expr(f"{rank} * 100 div __all"), F.lit(max(PERCENTS)))

    wanted = spans.where(percent("__before") < percent("__upto")).drop("__upto")
    at = F.col("__before") + F.sum("n").over(Window.partitionBy("feature", "__slice").orderBy("value"))
    ranked = cut.join(F.broadcast(wanted), ["feature", "__slice"]).withColumn("__upto", at).withColumn("__before", F.col("__upto") - F.col("n"))
    found = ranked.where(percent("__before") < percent("__upto")).select("feature", "value", F.explode(F.sequence(percent("__before") + 1, percent("__upto"))).alias("p"))
    return found.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("p", "value"))).alias("found")).select("feature", F.col("found.value").alias("pct"))


def summary(source: Source, exact: bool = False, coordinates: bool = True, accuracy: int = 10_000, ranked: bool = False) -> DataFrame:
    """One row for each feature (and numeric coordinate): mean, std (population), min, max, null, logstd, p1..p99.

    One aggregation over all features. Missing and infinite values are left out; ``null`` counts them, for a sparse source
    also the cells that are not stored. logstd is null unless all values are above 0. Percentiles are those of a sketch of bounded size, whose
    ranks are off by at most 1 / ``accuracy`` of all values; with ``ranked`` the sketch only cuts the values into slices, and
    percentiles have just their rank, for an exchange of the different values. ``exact`` ones, which lie between two values,
    keep each distinct value in one task, which is for small sources.
    """
    df = source.cells()
    names = list(source.feature_names)
    if coordinates:
        names += [d for d in source.dim_names if df.schema[d].dataType.simpleString() not in ("timestamp", "timestamp_ntz", "date", "string")]
    fractions = [p / 100 for p in PERCENTS]
    size = F.lit(math.prod(source.axis_size(d) for d in source.dim_names)) if source.sparse else F.count(F.lit(1))
    aggs = []
    for f in names:
        x = _finite(F.col(f))
        pct = F.percentile(x, fractions) if exact else F.percentile_approx(x, slice_shares() if ranked else fractions, accuracy)
        logs = F.when(F.min(x) > 0, F.stddev_pop(F.when(x > 0, F.ln(x))))
        aggs.append(F.struct(F.lit(f).alias("feature"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), (size - F.count(x)).cast("long").alias("null"), logs.alias("logstd"), pct.alias("pct")).alias(f))
    row = df.agg(*aggs).select(F.inline(F.array(*[F.col(f) for f in names])))
    if ranked and not exact:
        found = ranked_percentiles(counted(df, names), row.select("feature", F.col("pct").alias("bounds")))
        row = row.drop("pct").join(found, "feature", "left")
    named = [F.get("pct", F.lit(i)).alias("median" if p == 50 else f"p{p}") for i, p in enumerate(PERCENTS)]
    return row.select("feature", "mean", "std", "min", "max", "null", "logstd", *named)


def summaries(sources: Sequence[Source], keep: str = "last", prefixed: bool = False, **kw) -> DataFrame:
    """The summaries of all sources; of features in several the last or first source's, or all, named label__feature."""
    parts = []
    for i, s in enumerate(sources):
        part = summary(s, **kw).withColumn("__n", F.lit(i))
        parts.append(part.withColumn("feature", F.concat(F.lit(s.name.replace("/", "$") + "__"), "feature")) if prefixed else part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy("feature").orderBy(F.col("__n").desc() if keep == "last" else F.col("__n"))
    return out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__n")


def sparsity(source: Source) -> DataFrame:
    """(sparsity): the share of a source's values, over all features and the whole array, that are missing."""
    df = source.cells()
    size = math.prod(source.axis_size(d) for d in source.dim_names) if source.sparse else None
    there = sum((F.count(_finite(F.col(f))) for f in source.feature_names), F.lit(0))
    total = F.lit(size) if size is not None else F.count(F.lit(1))
    return df.agg((1 - F.try_divide(there.cast("double"), total * len(source.feature_names))).alias("sparsity"))


def histogram(df: DataFrame, feature: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, n): values in half-open bins between the edges, the last one closed; empty bins are there with 0."""
    at = bin_of(F.col(feature), edges)
    counts = df.withColumn("bin", at).where("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    if by:  # as many rows as groups and bins, both of which the result has anyway
        bins = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))))
    return bins.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """The number of the half-open bin (the last closed), or null outside."""
    held = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        top = x <= edges[i + 1] if i == len(edges) - 2 else x < edges[i + 1]
        held = F.when((x >= edges[i]) & top, i).otherwise(held)
    return held


def nonempty_bins(df: DataFrame, bins: Mapping[str, Sequence[float]], joint: bool = False) -> DataFrame:
    """The bins that hold data: (feature, bin) of marginals, or the combinations of all features' bins."""
    if joint:
        cols = [bin_of(F.col(f), e).alias(f) for f, e in bins.items()]
        out = df.select(*cols)
        for f in bins:
            out = out.where(F.col(f).isNotNull())
        return out.groupBy(*bins).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(F.col(f), e).alias("bin")) for f, e in bins.items()]))
    return df.select(pairs.alias("p")).select("p.*").where("bin is not null").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def entropy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, entropy): bits of the distribution of values in each column."""
    out = None
    for c in columns:
        p = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        e = p.agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy")).select(F.lit(c).alias("column"), "entropy")
        out = e if out is None else out.unionByName(e)
    return out


def barycenter_edges(sources: Sequence[Source], dim: str, bins: int) -> list[float]:
    """Edges that split a dim evenly over sources: the mean of their quantiles."""
    parts = [s for s in sources if dim in s.dim_names]
    fractions = [i / bins for i in range(bins + 1)]
    rows = [s.axis(dim).agg(F.percentile(s.coordinate(dim), fractions)).first()[0] for s in parts]
    return [float(sum(x) / len(x)) for x in zip(*rows, strict=True)]


def uniform_chunks(sources: Sequence[Source], dim: str, bins: int, least: Sequence[int] | None = None) -> list[list[int]]:
    """Steps of each source in common bins of a dim, about even: edges are mean quantiles, the outer ones the least and
    greatest coordinate of all. Bins in which any source has fewer steps than ``least`` join a neighbour."""
    from .policies import merged_chunks

    edges = barycenter_edges(sources, dim, bins)
    ends = [s.axis(dim).agg(F.min(s.coordinate(dim)), F.max(s.coordinate(dim))).first() for s in sources]
    edges[0], edges[-1] = min(e[0] for e in ends), max(e[1] for e in ends)
    counts = []
    for s in sources:
        h = histogram(s.axis(dim).select(s.coordinate(dim).alias("c")), "c", edges).orderBy("bin").collect()  # one row a bin
        counts.append([r["n"] for r in h])
    return counts if least is None else merged_chunks(counts, least)


def summary_if_valid(sources: Sequence[Source], **kw) -> DataFrame | None:
    """The summaries of a set of sources, or None if one of them has no valid cell at all."""
    return summaries(sources, **kw) if all(has_valid(s) for s in sources) else None


def max_resolution(source: Source) -> dict[str, float]:
    """The largest gap of each dim; 0 for sparse sources and single coordinates."""
    if source.sparse:
        return dict.fromkeys(source.dim_names, 0.0)
    out = {}
    for d in source.dim_names:
        a = source.axis(d).select(source.coordinate(d).alias("c"), "idx")
        out[d] = neighbours(a, "c").agg(F.max(F.col("after") - F.col("c"))).first()[0] or 0.0
    return out


def has_valid(source: Source) -> bool:
    return bool(source.cells().where(cell_valid(source)).limit(1).count())


def induced_bins(values: Sequence[float], probabilities: Sequence[float], n: int = 10, alpha: float = 0.25, drop_zero_width: bool = True) -> list[float]:
    """Edges between equal width (alpha 0) and equal probability (alpha 1) of a distribution given by quantiles.

    The bins' density over a stretch of width dq and probability dp goes as dq**(1 - a) * dp**a. The exponent a is found
    by bisection so that the L1 distance from the uniform density is ``alpha`` of that of the distribution itself. Quantile
    tables are short; this is arithmetic on the driver.
    """
    q, p = np.asarray(values, float), np.asarray(probabilities, float)
    dq, dp = np.diff(q), np.diff(p)
    if drop_zero_width:
        keep = (dq > 0) & (dp > 0)
        q = np.concatenate([q[:1], q[1:][keep]])
        dq, dp = dq[keep], dp[keep]
    if not len(dq):
        return [float(q[0])] * (n + 1)
    wide, likely = dq / dq.sum(), dp / dp.sum()

    def mass(a: float) -> np.ndarray:
        m = wide ** (1 - a) * likely**a
        return m / m.sum()

    goal, low, high = alpha * np.abs(likely - wide).sum(), 0.0, 1.0
    a = alpha
    if 0 < alpha < 1 and goal > 0:
        for _ in range(100):
            a = (low + high) / 2
            if np.abs(mass(a) - wide).sum() < goal:
                low = a
            else:
                high = a
            if high - low < 1e-12:
                break
    cumulative = np.concatenate([[0.0], np.cumsum(mass(a))])
    return [float(x) for x in np.interp(np.linspace(0, 1, n + 1), cumulative / cumulative[-1], q)]
