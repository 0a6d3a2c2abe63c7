"""Skill metrics as aggregate columns over observed and predicted values, and a registry of them."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _pair(t: Column, p: Column) -> tuple[Column, Column]:
    """Both, where both are numbers."""
    t, p = t.cast("double"), p.cast("double")
    ok = t.isNotNull() & p.isNotNull() & ~F.isnan(t) & ~F.isnan(p)
    return F.when(ok, t), F.when(ok, p)


def mse(t: Column, p: Column) -> Column:
    t, p = _pair(t, p)
    return F.avg((t - p) * (t - p))


def rmse(t: Column, p: Column) -> Column:
    return F.sqrt(mse(t, p))


def nse(t: Column, p: Column) -> Column:
    t, p = _pair(t, p)
    return 1 - F.try_divide(F.sum((p - t) * (p - t)), F.count(t) * F.var_pop(t))


def nse_log(t: Column, p: Column) -> Column:
    return nse(F.ln(t.cast("double")), F.ln(p.cast("double")))


def kge(t: Column, p: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """Null for fewer than two pairs."""
    t, p = _pair(t, p)
    r, spread, bias = F.corr(t, p) - 1, F.try_divide(F.stddev_pop(p), F.stddev_pop(t)) - 1, F.try_divide(F.avg(p), F.avg(t)) - 1
    value = 1 - F.sqrt(weights[0] * r * r + weights[1] * spread * spread + weights[2] * bias * bias)
    return F.when(F.count(t) >= 2, value)


def lkge(t: Column, p: Column) -> Column:
    return F.ln(kge(t, p))


def pearsonr(t: Column, p: Column) -> Column:
    t, p = _pair(t, p)
    return F.corr(t, p)


def alpha_nse(t: Column, p: Column) -> Column:
    t, p = _pair(t, p)
    return F.try_divide(F.stddev_pop(p), F.stddev_pop(t))


def beta_nse(t: Column, p: Column) -> Column:
    t, p = _pair(t, p)
    return F.try_divide(F.avg(p) - F.avg(t), F.stddev_pop(t))


def relative_error(t: Column, p: Column) -> Column:
    """0/0 is 0; a difference over 0 is infinite with its sign."""
    t, p = _pair(t, p)
    d = p - t
    at_zero = F.when(d == 0, 0.0).when(d > 0, math.inf).when(d < 0, -math.inf)
    return F.avg(F.when(t == 0, at_zero).otherwise(F.try_divide(d, t)))


def metric_entropy(y: Column, compat: bool = False) -> Column:
    """Entropy in bits of the values as shares of their sum, over their number; ``compat`` cuts the entropy to an integer."""
    y = y.cast("double")
    y = F.when(~F.isnan(y), y)
    total = F.sum(y)
    bits = F.log2(total) - F.try_divide(F.sum(F.when(y > 0, y * F.log2(y)).otherwise(0.0)), total)
    return F.try_divide(F.floor(bits).cast("double") if compat else bits, F.count(y))


def not_defined(t: Column, p: Column) -> Column:
    """Listed but without a formula: null."""
    return F.any_value(F.lit(None).cast("double"))


def r_squared(t: Column, p: Column) -> Column:
    """Of the linear regression."""
    t, p = _pair(t, p)
    return F.pow(F.corr(t, p), F.lit(2.0))


def loss_of(true: Column, predicted: Column, loss, transform=None) -> Column:
    """``masked_loss`` of a loss of both columns, each first through ``transform``."""
    t, p = (transform(true), transform(predicted)) if transform else (true, predicted)
    return masked_loss(loss(t, p))


def masked_loss(loss: Column) -> Column:
    """Mean of the losses that are numbers, 0 if none is."""
    x = loss.cast("double")
    return F.coalesce(F.avg(F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)), F.lit(0.0))


class Metrics:
    """Names and metrics; own ones can be added."""

    built_in: dict[str, Metric] = {
        "mse": mse, "rmse": rmse, "unbiased_rmse": rmse, "nse": nse, "nse_log": nse_log, "kge": kge, "lkg": lkge, "pearsonr": pearsonr,
        "alpha_nse": alpha_nse, "beta_nse": beta_nse, "relative_error": relative_error, "metric_entropy_true": lambda t, p: metric_entropy(t),
        "metric_entropy_pred": lambda t, p: metric_entropy(p), "fluctuation_complexity": not_defined, "triple_collocation_error": not_defined, "r2": r_squared,
    }

    def __init__(self):
        self.own: dict[str, Metric] = {}

    def register(self, name: str, metric: Metric) -> None:
        if name in self.built_in:
            raise ValueError(f"{name} is built in")
        self.own[name] = metric

    def get(self, name: str) -> Metric:
        found = self.own.get(name) or self.built_in.get(name)
        if found is None:
            raise KeyError(f"no metric {name}")
        return found

    def names(self) -> list[str]:
        return sorted({*self.built_in, *self.own})

    def evaluate(self, df: DataFrame, true: str, predicted: str, names: list[str], by: list[str] | None = None) -> DataFrame:
        """All metrics in one aggregation, for each group."""
        cols = [self.get(n)(F.col(true), F.col(predicted)).alias(n) for n in names]
        return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)

    def to_json(self, df: DataFrame) -> str:
        """The metrics of a frame of one row."""
        return json.dumps({k: v for k, v in df.first().asDict().items()})

    @staticmethod
    def from_json(text: str) -> dict[str, float]:
        return json.loads(text)


class LastBatch:
    """Metrics of the last batch seen, not of all: each update replaces the values, as a sink of a stream may call it."""

    def __init__(self, names: list[str], true: str, predicted: str, metrics: Metrics | None = None):
        self.names, self.true, self.predicted, self.metrics = names, true, predicted, metrics or Metrics()
        self.values: dict[str, float] = {}

    def update(self, batch: DataFrame, epoch: int = 0) -> dict[str, float]:
        self.values = self.metrics.evaluate(batch, self.true, self.predicted, self.names).first().asDict()
        return self.values

    def reset(self) -> None:
        self.values = {}
