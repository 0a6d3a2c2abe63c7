"""Scalar and array functions of features and coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.grid import minutes

#: Periods in days of the cyclic time features.
PERIODS = {"1": 1.0, "365": 365.2425}


def cyclic(ts: Column) -> dict[str, Column]:
    """sin_1, cos_1, sin_365, cos_365: the time of day and of year as points on a circle."""
    out = {}
    for name, days in PERIODS.items():
        angle = F.pmod(minutes(ts), F.lit(1440.0 * days)) / F.lit(1440.0 * days) * F.lit(2 * math.pi)
        out[f"sin_{name}"], out[f"cos_{name}"] = F.sin(angle), F.cos(angle)
    return out


def one_hot(feature: str, classes: Sequence[int]) -> dict[str, Column]:
    """<feature>_<class>: 1 where the value, cut to an integer, is the class, else 0; null is no class."""
    value = F.col(feature).cast("double")
    cut = F.when(value.isNotNull() & ~F.isnan(value), F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)))
    return {f"{feature}_{k}": F.coalesce((cut == k).cast("int"), F.lit(0)) for k in classes}


def lookback(target: Column, depth_hours: int) -> Column:
    """The first and the target stamp; one stamp for depth 0."""
    return F.array(target) if depth_hours == 0 else F.array(target - F.expr(f"INTERVAL {int(depth_hours)} HOURS"), target)


def tile(values: Column, steps: int) -> Column:
    """Each value repeated along a new axis of ``steps``."""
    return F.transform(values, lambda x: F.array_repeat(x, steps))


def chunks(array: Column, n: int) -> Column:
    """An array in pieces of n, the last one shorter."""
    count = F.ceil(F.size(array) / n).cast("int")
    return F.when(count == 0, F.slice(F.array(array), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(array, i * n + 1, F.lit(n))))


def ravel(indexes: Sequence[Column], sizes: Sequence[int]) -> Column:
    """The row-major number of a position."""
    held = F.lit(0).cast("long")
    for i, n in zip(indexes, sizes, strict=True):
        held = held * F.lit(n) + i
    return held


def unravel(number: Column, sizes: Sequence[int]) -> list[Column]:
    out, below = [], 1
    for n in reversed(sizes):
        out.insert(0, F.pmod(F.floor(number / below), F.lit(n)).cast("long"))
        below *= n
    return out


def squeeze(array: Column, levels: int = 1) -> Column:
    for _ in range(levels):
        array = F.flatten(array)
    return array


def expand(array: Column, levels: int = 1) -> Column:
    for _ in range(levels):
        array = F.array(array)
    return array


def json_safe(value, as_string: bool = False):
    """A value that JSON can hold: sets are sorted lists, unknown objects their text, keys text."""
    import json

    def safe(v):
        if v is None or isinstance(v, bool | int | str):
            return v
        if isinstance(v, float):
            return v if math.isfinite(v) else str(v)
        if isinstance(v, Mapping):
            return {str(k): safe(x) for k, x in v.items()}
        if isinstance(v, set | frozenset):
            return sorted((safe(x) for x in v), key=str)
        if isinstance(v, Iterable) and not isinstance(v, bytes):
            return [safe(x) for x in v]
        return str(v)

    out = safe(value)
    return json.dumps(out, sort_keys=True) if as_string else out


def total_bytes(df: DataFrame) -> int:
    """Estimate of a frame's size by the optimizer, without reading it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def kelvin_to(c: Column, unit: str) -> Column:
    if unit == "K":
        return c
    if unit == "C":
        return c - F.lit(273.15)
    raise ValueError(f"unknown unit {unit}")
