"""Proximity joins of sources: every dim of every pair within tolerance, planned as equi-joins on buckets.

Spark plans a band predicate alone as a nested loop. Here points lie in buckets of a level, the power of two of their own
reach. A pair meets at the level of the point that reaches farther: that point lies in one bucket there, the other is
looked up in three neighbouring ones, so that a pair meets in one bucket exactly once and the band is a residual condition
of a hash or sort-merge join. Few points that reach far (beside a gap of an axis) make buckets of their own and leave those
of all others small. Where all points reach equally far there is one level.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.grid import EPS, RADIUS, Source, neighbours, resolutions

#: Dims that buckets are made of; more would multiply the copies of a side by three each.
BUCKET_DIMS = 2


@dataclass(frozen=True)
class Points:
    """(key, c_<dim>, l_<dim>, r_<dim>): coordinates in double with their reach below and above; ``most`` bounds it.

    ``levels``: for dims whose points reach unequally far, the largest reach of each level there is; see ``reach_levels``.
    """

    frame: DataFrame
    dims: Sequence[str]
    most: Mapping[str, float]
    required: bool = True
    levels: Mapping[str, Mapping[int, float]] = field(default_factory=dict)


def _level(left: Column, right: Column) -> Column:
    """The power of two of a reach."""
    return F.ceil(F.log2(F.greatest(left, right, F.lit(0.0)) + EPS)).cast("int")


def reach_levels(frame: DataFrame, left: str, right: str) -> dict[int, float]:
    """{level: largest reach in it}; as many as there are powers of two between the least and the largest reach."""
    rows = frame.groupBy(_level(F.col(left), F.col(right)).alias("level")).agg(F.max(F.greatest(left, right)).alias("most")).collect()
    return {r["level"]: r["most"] for r in rows if r["level"] is not None}


def points(source: Source, centers: DataFrame, key: Column | None = None, radius: float = RADIUS) -> Points:
    """The centres of a source as points; the key is a struct of their steps unless given."""
    df = centers.withColumn("key", key if key is not None else F.struct(*[f"i_{d}" for d in source.dim_names]))
    df = df.select("key", *[source.coordinate(d).alias(f"c_{d}") for d in source.dim_names])
    most, levels = {}, {}
    for d, (table, reach, high) in resolutions(source, radius).items():
        most[d] = high
        if table is not None:
            levels[d] = reach_levels(table, "left", "right")
        if table is None:
            df = df.withColumns({f"l_{d}": F.lit(reach), f"r_{d}": F.lit(reach)})
        else:
            df = df.join(table.select(F.col("c").alias(f"c_{d}"), F.col("left").alias(f"l_{d}"), F.col("right").alias(f"r_{d}")), f"c_{d}")
    return Points(df, source.dim_names, most, not source.optional, levels)


def plain_points(spark: SparkSession, coords: Sequence, resolution=None, radius: float = RADIUS) -> Points:
    """Points from a list of rows of coordinates; dims are named 0, 1, ...; the key is the row's number.

    resolution: None (1 in each dim), a number, one for each dim, or for each point and dim a pair (left, right).
    """
    import numpy as np

    x = np.asarray(coords, float)
    x = x[:, None] if x.ndim == 1 else x
    n, d = x.shape
    res = np.ones((n, d, 2)) if resolution is None else np.asarray(resolution, float)
    if res.ndim < 3:
        res = np.broadcast_to(np.broadcast_to(res, (d,))[None, :, None], (n, d, 2))
    dims = [str(i) for i in range(d)]
    rows = [(i, *[float(v) for j in range(d) for v in (x[i, j], res[i, j, 0] * radius, res[i, j, 1] * radius)]) for i in range(n)]
    schema = "key long, " + ", ".join(f"c_{j} double, l_{j} double, r_{j} double" for j in dims)
    found = Points(spark.createDataFrame(rows, schema), dims, {j: float((res[:, int(j)] * radius).max()) if n else 0.0 for j in dims})
    uneven = [j for j in dims if n and np.ptp(res[:, int(j)].max(axis=1)) > 0]
    return replace(found, levels={j: reach_levels(found.frame, f"l_{j}", f"r_{j}") for j in uneven})


def _near(i: int, j: int, dims: Sequence[str], locus: bool) -> Column:
    """Point j lies in the reach of i or the other way round in every dim; for ``locus`` the reaches overlap."""
    held = F.lit(True)
    for d in dims:
        x, y = F.col(f"p{i}_c_{d}"), F.col(f"p{j}_c_{d}")
        xl, xr = x - F.col(f"p{i}_l_{d}") - EPS, x + F.col(f"p{i}_r_{d}") + EPS
        yl, yr = y - F.col(f"p{j}_l_{d}") - EPS, y + F.col(f"p{j}_r_{d}") + EPS
        held = held & ((xl <= yr) & (yl <= xr) if locus else y.between(xl, xr) | x.between(yl, yr))
    return held


def _distance(olds: Sequence[int], j: int, dims: Mapping[int, Sequence[str]]) -> Column:
    """Squared distance of j from all points joined before, in units of the larger reach of each pair, is 1 at most."""
    total = F.lit(0.0)
    for i in olds:
        for d in dims[i]:
            unit = F.greatest(F.col(f"p{i}_l_{d}"), F.col(f"p{j}_l_{d}"), F.lit(EPS))
            total = total + F.pow((F.col(f"p{i}_c_{d}") - F.col(f"p{j}_c_{d}")) / unit, F.lit(2.0))
    return total <= 1 + EPS


def _prefixed(p: Points, j: int) -> DataFrame:
    return p.frame.select(*[F.col(c).alias(f"p{j}_{c}") for c in p.frame.columns])


def _widths(own: Mapping[int, float], other: Mapping[int, float], locus: bool) -> dict[int, float]:
    """For each level of ``own`` a width that no pair passes of which one point is at it and the other at it or below."""
    out = {}
    for level, most in own.items():
        below = max([m for n, m in other.items() if n <= level], default=0.0)
        out[level] = max(most + below if locus else max(most, below), EPS) + 2 * EPS
    return out


def _by_level(of: Mapping[int, Column], level: Column) -> Column:
    """The array for a level, of few; null at other levels."""
    out = None
    for n, array in of.items():
        out = F.when(level == n, array) if out is None else out.when(level == n, array)
    return out


def _lookups(d: str, i: int, j: int, left: Mapping[int, float] | None, right: Mapping[int, float] | None, locus: bool) -> tuple[Column | None, Column]:
    """Arrays of the buckets (level, number) of a point on the left and on the right; None for the left if it is in one.

    At a level that both sides have, both kinds of pairs (which side reaches farther) have levels of their own: twice the
    level for pairs whose left point is at it, once more for pairs whose right point alone is.
    """
    x, y = F.col(f"p{i}_c_{d}"), F.col(f"p{j}_c_{d}")

    def bucket(c: Column, kind: int, width: float, beside: Sequence[int]) -> list[Column]:
        at = F.floor(c / width)
        return [F.struct(F.lit(kind).alias("level"), (at + k).cast("long").alias("at")) for k in beside]

    upper, lower = _widths(left, right, locus), _widths(right, left, locus)
    x_level, y_level = _level(F.col(f"p{i}_l_{d}"), F.col(f"p{i}_r_{d}")), _level(F.col(f"p{j}_l_{d}"), F.col(f"p{j}_r_{d}"))
    if len(left) == 1:
        x_level = F.lit(next(iter(left)))
    if len(right) == 1:
        y_level = F.lit(next(iter(right)))
    of_left = {n: [*bucket(x, 2 * n, upper[n], (0,)), *[b for m in lower if m > n for b in bucket(x, 2 * m + 1, lower[m], (0,))]] for n in left}
    of_right = {m: [*[b for n in upper if n >= m for b in bucket(y, 2 * n, upper[n], (-1, 0, 1))], *(bucket(y, 2 * m + 1, lower[m], (-1, 0, 1)) if any(n < m for n in left) else [])] for m in right}
    array = lambda buckets: F.array(*buckets) if buckets else F.array().cast("array<struct<level:int,at:bigint>>")
    y_buckets = _by_level({m: array(b) for m, b in of_right.items()}, y_level)
    if all(len(b) == 1 for b in of_left.values()) and len(left) == 1:
        return None, y_buckets
    return _by_level({n: array(b) for n, b in of_left.items()}, x_level), y_buckets


def _bucketed(p: Points, df: DataFrame, right: DataFrame, j: int, olds: Sequence[tuple[int, Points]], locus: bool) -> tuple[DataFrame, DataFrame, list[Column], bool]:
    """Both sides with their buckets for each of the leading shared dims, the equalities, and whether rows of the joined side
    come more than once."""
    i, best = max(olds, key=lambda o: len(set(o[1].dims) & set(p.dims)))
    equal, again = [], False
    shared = [d for d in p.dims if d in best.dims]
    for d in sorted(shared, key=lambda d: best.most[d] + p.most[d])[:BUCKET_DIMS]:
        levels = [q.levels.get(d) or {math.ceil(math.log2(q.most[d] + EPS)): q.most[d]} for q in (best, p)]
        of_left, of_right = _lookups(d, i, j, *levels, locus)
        right = right.withColumn(f"p{j}_b_{d}", F.explode(of_right))
        if of_left is None:
            (n, width), = _widths(*levels, locus).items()
            equal += [F.floor(F.col(f"p{i}_c_{d}") / width) == F.col(f"p{j}_b_{d}.at")]
            right = right.where(F.col(f"p{j}_b_{d}.level") == 2 * n)
        else:
            df, again = df.withColumn(f"p{j}_a_{d}", F.explode(of_left)), True
            equal += [F.col(f"p{j}_a_{d}.{f}") == F.col(f"p{j}_b_{d}.{f}") for f in ("level", "at")]
    return df, right, equal, again


def match(sources: Sequence[Points], method: str = "multi", allow_product: bool = False) -> DataFrame:
    """(k0, k1, ...): keys of one point of each source that all lie near each other.

    method: "multi" (each pair in reach), "locus" (each pair's reaches overlap) or "l2" (Euclidean: the distance from all
    points joined before, so the order of sources matters with three or more). Optional sources come last and give null
    where nothing matches. A source without a dim in common with any other pairs with all of it, which must be asked for
    by ``allow_product``.
    """
    if method not in ("multi", "locus", "l2"):
        raise ValueError("method must be multi, locus or l2")
    order = sorted(range(len(sources)), key=lambda i: not sources[i].required)
    done: list[tuple[int, Points]] = [(order[0], sources[order[0]])]
    df = _prefixed(done[0][1], order[0])
    for j in order[1:]:
        p = sources[j]
        if not allow_product and not any(set(p.dims) & set(o.dims) for _, o in done):
            raise ValueError(f"source {j} shares no dim with those before it: its pairs are a product (allow_product)")
        if method == "l2":
            conditions = [_distance([i for i, _ in done], j, {i: [d for d in o.dims if d in p.dims] for i, o in done})]
        else:
            conditions = []
            for i, o in done:
                near = _near(i, j, [d for d in o.dims if d in p.dims], method == "locus")
                conditions.append(near if o.required else near | F.col(f"p{i}_key").isNull())
        left, right, equal, again = _bucketed(p, df, _prefixed(p, j), j, [d for d in done if d[1].required] or done, method == "locus")
        how = "inner" if p.required or again else "left"
        both = left.join(right, reduce(lambda a, b: a & b, [*equal, *conditions]), how)
        both = both.drop(*[c for c in both.columns if c.startswith((f"p{j}_a_", f"p{j}_b_"))])
        if again and not p.required:  # rows without a match come back once, whatever number of buckets they were in
            keys = [f"p{i}_key" for i, _ in done]
            found = both.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
            alone = df.join(found, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")
            both = both.unionByName(alone, allowMissingColumns=True)
        df = both
        done.append((j, p))
    return df.select(*[F.col(f"p{i}_key").alias(f"k{i}") for i in range(len(sources))])


def match_pairwise(sources: Sequence[Points], locus: bool = False) -> DataFrame:
    """The matches of all pairs of sources with a dim in common, joined naturally on the keys they share; equals ``match``."""
    tables = []
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sources)), 2) if set(sources[i].dims) & set(sources[j].dims)]
    if {i for p in pairs for i in p} != set(range(len(sources))):
        raise ValueError("a source shares no dim with any other")
    for i, j in sorted(pairs):
        m = match([sources[i], sources[j]], "locus" if locus else "multi")
        tables.append(m.select(F.col("k0").alias(f"k{i}"), F.col("k1").alias(f"k{j}")))
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, [c for c in t.columns if c in out.columns])
    return out.select(*[f"k{i}" for i in range(len(sources))])


def match_anchor(sources: Sequence[Points], allow_empty: bool = False) -> DataFrame:
    """(k0, m1, m2, ...): for each point of source 0 the sorted keys of each other source near it; these need not match
    each other. Points without a match in every source go, or have empty lists with ``allow_empty``."""
    out = sources[0].frame.select(F.col("key").alias("k0"))
    for j, p in enumerate(sources[1:], 1):
        m = match([sources[0], replace(p, required=True)]).groupBy("k0").agg(F.sort_array(F.collect_list("k1")).alias(f"m{j}"))
        out = out.join(m, "k0", "left" if allow_empty else "inner")
        if allow_empty:
            out = out.withColumn(f"m{j}", F.coalesce(F.col(f"m{j}"), F.from_json(F.lit("[]"), m.schema[f"m{j}"].dataType)))
    return out


def sampled(matches: DataFrame, n: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """n random matches, or n for each group of ``by`` (blocks of a first source, say); a hash of the keys is the order.

    Without groups it is a top-n, of which each task keeps n rows at most."""
    order = F.md5(F.concat(*[F.coalesce(F.to_json(F.struct(c)), F.lit("-")) for c in matches.columns if c not in by], F.lit(f"_{seed}")))
    if not by:
        return matches.withColumn("__o", order).orderBy("__o").limit(n).drop("__o")
    w = Window.partitionBy(*by).orderBy("__o")
    return matches.withColumn("__o", order).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__o", "__r")


def implode(matches: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The inverse of exploding: from the last column to the first, rows equal in all others become one with a list."""
    columns = list(columns or matches.columns)
    for c in reversed(columns):
        matches = matches.groupBy(*[o for o in columns if o != c]).agg(F.sort_array(F.collect_list(c)).alias(c)).select(*columns)
    return matches


def cartesian(frames: Sequence[DataFrame], start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... of the product of frames (each with a column ``n`` numbered from 0), last varying
    fastest, with their number ``row``. Numbers are computed, so only the wanted rows are made: no product is formed."""
    sizes = [f.agg(F.coalesce(F.max("n") + 1, F.lit(0))).first()[0] for f in frames]
    total = math.prod(sizes)
    stop = total if stop is None else min(stop, total)
    df = frames[0].sparkSession.range(start, max(start, stop), step).withColumnRenamed("id", "row")
    rest = total
    for i, (f, n) in enumerate(zip(frames, sizes, strict=True)):
        rest = rest // max(n, 1)
        at = F.pmod(F.floor(F.col("row") / max(rest, 1)), F.lit(max(n, 1))).alias("n")
        df = df.withColumn(f"n{i}", at).join(f.select(F.col("n").alias(f"n{i}"), *[F.col(c).alias(f"{c}_{i}") for c in f.columns if c != "n"]), f"n{i}").drop(f"n{i}")
    return df


def index_of(df: DataFrame, value: str, axis: DataFrame, coordinate: str, mode: str = "nearest", tol: float | None = None, out: str = "idx") -> DataFrame:
    """``df`` with the index of each value on an axis (coordinate, idx ascending from 0).

    nearest: ties take the lower index, values outside the nearer end; with ``tol`` what is farther is null. strict: exact
    or null. left and right: the last coordinate not above the value (-1 before the first). Intervals of the axis are filed
    by level, the power of two of their width, in the one to three buckets of that level that they meet; a value is looked
    up in one bucket of each level there is. So a value meets a few intervals, however uneven the axis.
    """
    if mode == "strict":
        return df.join(axis.select(F.col(coordinate).alias(value), F.col("idx").alias(out)), value, "left").select(*df.columns, out)
    if mode not in ("nearest", "left", "right"):
        raise ValueError("mode must be nearest, strict, left or right")
    x = neighbours(axis.select(F.col(coordinate).cast("double").alias("__c"), F.col("idx").alias("__i")), "__c", "__i", "__b4", "__next")
    if mode == "nearest":
        x = x.withColumns({"__from": (F.col("__b4") + F.col("__c")) / 2, "__to": (F.col("__next") + F.col("__c")) / 2})
    else:
        x = x.withColumns({"__from": F.col("__c"), "__to": F.col("__next")})
    low, high = axis.agg(F.min(F.col(coordinate).cast("double")), F.max(F.col(coordinate).cast("double"))).first()
    if low is None:
        return df.withColumn(out, F.when(F.col(value).isNotNull() & F.lit(mode != "nearest"), F.lit(-1)).cast("long"))
    x = x.withColumns({"__lo": F.coalesce("__from", F.lit(low)), "__hi": F.coalesce("__to", F.lit(high))})
    x = x.withColumn("__level", F.ceil(F.log2(F.greatest(F.col("__hi") - F.col("__lo"), F.lit(EPS)))).cast("int"))
    levels = sorted(r[0] for r in x.select("__level").distinct().collect())  # powers of two between the least and the largest gap

    def bucket(c: Column, level: Column) -> Column:
        return F.floor(c / F.pow(F.lit(2.0), level)).cast("long")

    x = x.withColumn("__b", F.explode(F.sequence(bucket(F.col("__lo"), F.col("__level")), bucket(F.col("__hi"), F.col("__level")))))
    x = x.select("__c", "__i", "__from", "__to", "__level", "__b")
    v = F.col(value).cast("double")
    at = F.greatest(F.lit(low), F.least(F.lit(high), v))
    if mode == "nearest":
        inside = (F.col("__from").isNull() | (v > F.col("__from"))) & (F.col("__to").isNull() | (v <= F.col("__to")))
    else:
        inside = (v >= F.col("__from")) & (F.col("__to").isNull() | (v < F.col("__to")))
    found = F.col("__i")
    if mode == "nearest" and tol is not None:
        found = F.when(F.abs(v - F.col("__c")) <= tol, found)
    if len(levels) == 1:
        rows = df.withColumn("__at", bucket(at, F.lit(levels[0])))
        joined = rows.join(x, (F.col("__at") == F.col("__b")) & inside, "left")
        found = found if mode == "nearest" else F.coalesce(found, F.when(v.isNotNull(), F.lit(-1)))
        return joined.select(*[F.col(c) for c in df.columns], found.alias(out))
    # each value but null lies in one interval of one level, but for those before the first of mode left and right
    outside = v.isNull() if mode == "nearest" else v.isNull() | (v < low)
    rows = df.where(~outside).withColumn("__at", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), bucket(at, F.lit(n)).alias("b")) for n in levels])))
    joined = rows.join(x, (F.col("__at.n") == F.col("__level")) & (F.col("__at.b") == F.col("__b")) & inside)
    alone = df.where(outside).withColumn(out, F.when(v.isNotNull(), F.lit(-1)).cast("long"))
    return joined.select(*[F.col(c) for c in df.columns], found.alias(out)).unionByName(alone)


def diagnose(sources: Sequence[tuple[str, Points]]) -> str | None:
    """Why a match is empty: the first source without points, or the first pair without a match; None if there is none."""
    for name, p in sources:
        if p.required and not p.frame.limit(1).count():
            return f"{name} has no valid windows"
    for (a, p), (b, q) in itertools.combinations([s for s in sources if s[1].required], 2):
        if not match([p, q], allow_product=True).limit(1).count():
            return f"{a} and {b} do not match"
    return None
