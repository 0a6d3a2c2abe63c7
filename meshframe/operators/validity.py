"""Which cells may be centres: validity of cells, of windows, and by bins of values."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.grid import Source, cell_valid


def least_valid(percent: float, total: int) -> int:
    """Valid cells that a window of ``total`` needs; products that exceed a whole number by rounding alone do not count."""
    return math.ceil(math.nextafter(percent * total, 0.0)) if percent * total > 0 else 0


def in_bins(bins: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """lo <= value < hi for all features; None leaves an end open."""
    held = F.lit(True)
    for f, (lo, hi) in bins.items():
        if lo is not None:
            held = held & (F.col(f) >= lo)
        if hi is not None:
            held = held & (F.col(f) < hi)
    return F.coalesce(held, F.lit(False))


def indexed(source: Source, dims: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Cells with i_<dim>, their step on each axis, and the axes' sizes. Axes are joined on; AQE broadcasts short ones."""
    df, sizes = source.table(), {}
    for d in dims or source.dim_names:
        sizes[d] = source.axis_size(d)
        df = df.join(source.axis(d).withColumnRenamed("idx", f"i_{d}"), d)
    return df, sizes


#: Steps of a stretch of an array with one dim, at least.
STRETCH = 65_536


def frame_sum(df: DataFrame, value: Column, dim: str, others: Sequence[str], before: int, after: int, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the steps from ``before`` before to ``after`` after along i_<dim>.

    Other dims part the array. An array of one dim is cut in stretches; cells near the end of one come to its
    neighbours too, so no task holds the whole dim.
    """
    w = Window.orderBy(f"i_{dim}").rangeBetween(-before, after)
    if others:
        return df.withColumn(out, F.sum(value).over(w.partitionBy(*[f"i_{o}" for o in others])))
    size = max(STRETCH, 4 * (before + after + 1))
    i = F.col(f"i_{dim}")
    own = F.floor(i / size)
    spread = df.withColumn(out, value).withColumn("__b", F.explode(F.sequence(F.floor((i - after) / size), F.floor((i + before) / size))))
    return spread.withColumn(out, F.sum(out).over(w.partitionBy("__b"))).where(F.col("__b") == own).drop("__b")


def centers(source: Source, bins: Mapping[str, tuple[float | None, float | None]] | None = None, percents: Mapping | None = None, pad_edges: bool = False) -> DataFrame:
    """Cells (with steps i_<dim>) whose windows are valid enough and lie inside the axes.

    Each group of dims in the rule is a separable sum of valid cells over RANGE frames of steps; the survivors of a group
    are the valid cells of the next. Cells outside the array are invalid. A frame must lie inside the array along all
    windowed dims; with ``pad_edges`` it may reach beyond. Bins restrict centres and what counts in windows.
    """
    df, sizes = indexed(source)
    rule = {(k,) if isinstance(k, str) else tuple(k): p for k, p in (percents if percents is not None else source.valid_percent).items()}
    ok = cell_valid(source)
    if bins:
        ok = ok & in_bins(bins)
    df = df.withColumn("__ok", ok.cast("int"))
    span = {d: source.span(d, sizes[d]) for d in source.dim_names}
    if not rule:
        rule = {tuple(d for d in source.dim_names if span[d] != (0, 0)): None}
    for group, percent in rule.items():
        if percent is None:
            df = df.where("__ok = 1")
            continue
        total = math.prod(1 + sum(span[d]) for d in group)
        held = F.col("__ok")
        for n, d in enumerate(group):
            df = frame_sum(df, held, d, [o for o in source.dim_names if o != d], *span[d], f"__sum{n}")
            held = F.col(f"__sum{n}")
        df = df.withColumn("__ok", (held >= least_valid(percent, total)).cast("int")).drop(*[f"__sum{n}" for n in range(len(group))])
    if bins:
        df = df.where(in_bins(bins))
    df = df.where("__ok = 1").drop("__ok")
    if not pad_edges:
        for group in rule:
            for d in group:
                df = df.where(F.col(f"i_{d}").between(span[d][0], sizes[d] - 1 - span[d][1]))
    return df


def sparse_centers(source: Source, percent: float) -> DataFrame:
    """Centres of a sparse source: each valid cell votes for the centres whose windows hold it; enough votes keep a cell."""
    df, sizes = indexed(source)
    span = {d: source.span(d, sizes[d]) for d in source.dim_names}
    ok = df.where(cell_valid(source))
    keys = [f"i_{d}" for d in source.dim_names]
    votes = ok.select(*keys)
    for d in source.dim_names:
        before, after = span[d]
        votes = votes.withColumn(f"i_{d}", F.explode(F.sequence(F.col(f"i_{d}") - after, F.col(f"i_{d}") + before)))
    need = least_valid(percent, math.prod(1 + sum(s) for s in span.values()))
    kept = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__votes")).where(F.col("__votes") >= need).drop("__votes")
    out = ok.join(kept, keys, "left_semi") if need > 0 else ok
    for d in source.dim_names:
        out = out.where(F.col(f"i_{d}").between(span[d][0], sizes[d] - 1 - span[d][1]))
    return out
