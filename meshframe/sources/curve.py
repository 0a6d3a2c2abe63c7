"""Sparse cells along a space-filling curve: files are ranges of the curve, and a box opens the files it meets.

The key of a cell is its Z-order: the coordinate of each dim is cut in 2**bits even steps between its least and greatest
value, and the bits of the steps are taken in turn. Cells that are near in all dims have near keys, so a file holds a
compact part of space, the smaller the denser it is there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grid import Source, minutes

KEY = "curve_key"
#: Bits of all dims together, rows of a file, and ranges of keys that a box becomes at most.
KEY_BITS, FILE_ROWS, MOST_RANGES = 60, 1_000_000, 64


def _number(df: DataFrame, dim: str) -> Column:
    kind = df.schema[dim].dataType
    return minutes(F.col(dim)) if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) else F.col(dim).cast("double")


def _step(at: Column, low: float, high: float, bits: int) -> Column:
    """The step of a coordinate, from 0 to 2**bits - 1; what is outside is at the nearer end."""
    steps = 1 << bits
    share = (at - low) / ((high - low) or 1.0)
    return F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor(share * steps))).cast("long")


def interleaved(steps: Sequence[Column], bits: int) -> Column:
    """The bits of all steps in turn, from the highest of the first."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for n, s in enumerate(steps):
            bit = F.shiftright(s, b).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.call_function("shiftleft", bit, F.lit(b * len(steps) + len(steps) - 1 - n)))
    return out


def key_ranges(low: Sequence[int], high: Sequence[int], bits: int, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys (both ends belong to them), ``most`` at most, that hold all cells of a box of steps.

    The box is cut along the curve's own cells, the largest first, until they lie inside it or there are ``most``.
    """
    k = len(low)
    done: list[tuple[int, int]] = []
    open_: list[tuple[int, int, tuple[int, ...]]] = [(0, bits, (0,) * k)]  # first key, bits left, first steps
    while open_:
        following = []
        for key, left, first in open_:
            last = [f + (1 << left) - 1 for f in first]
            if any(f > h or e < lo for f, e, lo, h in zip(first, last, low, high, strict=True)):
                continue
            if left == 0 or all(f >= lo and e <= h for f, e, lo, h in zip(first, last, low, high, strict=True)):
                done.append((key, key + (1 << k * left) - 1))
                continue
            following += [(key + (c << k * (left - 1)), left - 1, tuple(f + ((c >> (k - 1 - n) & 1) << (left - 1)) for n, f in enumerate(first))) for c in range(1 << k)]
        if len(done) + len(following) > most * (1 << k):
            done += [(key, key + (1 << k * left) - 1) for key, left, first in following if all(f <= h and f + (1 << left) - 1 >= lo for f, lo, h in zip(first, low, high, strict=True))]
            break
        open_ = following
    done.sort()
    merged: list[list[int]] = []
    for a, b in done:
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    while len(merged) > most:  # the closest two become one
        n = min(range(len(merged) - 1), key=lambda i: merged[i + 1][0] - merged[i][1])
        merged[n : n + 2] = [[merged[n][0], merged[n + 1][1]]]
    return [(a, b) for a, b in merged]


@dataclass(frozen=True)
class Curve:
    """A table along the curve; ``bounds``: least and greatest coordinate of each dim as numbers (times in minutes)."""

    spark: SparkSession
    path: str
    bounds: Mapping[str, tuple[float, float]]

    @property
    def bits(self) -> int:
        return _bits(len(self.bounds))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Curve:
        rows = spark.read.parquet(f"{path}/_dims").orderBy("n").collect()  # one row a dim
        return cls(spark, path, {r["dim"]: (r["low"], r["high"]) for r in rows})

    def manifest(self) -> DataFrame:
        """(file, rows, first_key, last_key, low_<dim>, high_<dim>) of each file."""
        return self.spark.read.parquet(f"{self.path}/_files")

    def read(self, box: Mapping[str, tuple] | None = None) -> DataFrame:
        """The cells, or those of a box of coordinates (both ends belong to it, None is open), without their key.

        Files that the box misses are not listed for the scan; in the others its keys and its coordinates are filters that
        reach the scan, so that row groups are passed over too.
        """
        data = self.spark.read.parquet(f"{self.path}/cells")
        if not box:
            return data.drop(KEY)
        one = self.spark.range(1).select(*[F.lit(e).alias(f"{n}_{d}") for d, ends in box.items() for n, e in zip(("lo", "hi"), ends, strict=True) if e is not None])
        numbers = one.select(*[_number(one, c).alias(c) for c in one.columns]).first() if one.columns else {}
        ends = {d: tuple(numbers[f"{n}_{d}"] if e is not None else None for n, e in zip(("lo", "hi"), box[d], strict=True)) for d in box}
        listed = self.manifest()
        for d, (low, high) in ends.items():
            listed = listed if low is None else listed.where(F.col(f"high_{d}") >= low)
            listed = listed if high is None else listed.where(F.col(f"low_{d}") <= high)
        files = [r[0] for r in listed.select("file").collect()]  # those that the box meets
        if not files:
            return data.limit(0).drop(KEY)
        found = self.spark.read.schema(data.schema).parquet(*[f"{self.path}/cells/{f}" for f in files])
        for d, (low, high) in box.items():
            found = found if low is None else found.where(F.col(d) >= low)
            found = found if high is None else found.where(F.col(d) <= high)
        return found.where(self._keys(ends)).drop(KEY)

    def _keys(self, ends: Mapping[str, tuple[float | None, float | None]]) -> Column:
        import math

        last = (1 << self.bits) - 1
        low, high = [], []
        for d, (least, greatest) in self.bounds.items():
            a, b = ends.get(d, (None, None))
            at = lambda v, least=least, greatest=greatest: max(0, min(last, math.floor((v - least) / ((greatest - least) or 1.0) * (last + 1))))
            low.append(0 if a is None else max(0, at(a) - 1))  # a step more, as the last bits of a division may differ
            high.append(last if b is None else min(last, at(b) + 1))
        out = F.lit(False)
        for a, b in key_ranges(low, high, self.bits):
            out = out | F.col(KEY).between(a, b)
        return out


def _bits(dims: int) -> int:
    return min(24, KEY_BITS // dims)


def save(source: Source, path: str, file_rows: int = FILE_ROWS) -> Curve:
    """Writes the cells of a source along the curve, some ``file_rows`` in a file, with a manifest of the files' bounds.

    Cells with a null or NaN coordinate are left out, as they lie nowhere. A table that is there is replaced.
    """
    spark, dims = source.frame.sparkSession, source.dim_names
    cells = source.table()
    at = {d: _number(cells, d) for d in dims}
    for d in dims:
        cells = cells.where(F.col(d).isNotNull() & ~F.isnan(at[d]))
    row = cells.agg(F.count(F.lit(1)).alias("n"), *[f(at[d]).alias(f"{n}_{d}") for d in dims for n, f in (("low", F.min), ("high", F.max))]).first()
    bounds = {d: (row[f"low_{d}"] or 0.0, row[f"high_{d}"] or 0.0) for d in dims}
    key = interleaved([_step(at[d], *bounds[d], _bits(len(dims))) for d in dims], _bits(len(dims)))
    keyed = cells.withColumn(KEY, key).repartitionByRange(max(1, -(-row["n"] // file_rows)), KEY, *dims).sortWithinPartitions(KEY, *dims)
    keyed.write.mode("overwrite").option("maxRecordsPerFile", 4 * file_rows).parquet(f"{path}/cells")
    spark.createDataFrame([(n, d, *bounds[d]) for n, d in enumerate(dims)], "n int, dim string, low double, high double").coalesce(1).write.mode("overwrite").parquet(f"{path}/_dims")
    written = spark.read.parquet(f"{path}/cells")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")
    facts = [F.count(F.lit(1)).alias("rows"), F.min(KEY).alias("first_key"), F.max(KEY).alias("last_key")]
    facts += [f(at[d]).alias(f"{n}_{d}") for d in dims for n, f in (("low", F.min), ("high", F.max))]
    written.select("*", name).groupBy("file").agg(*facts).write.mode("overwrite").parquet(f"{path}/_files")
    return Curve(spark, path, bounds)
