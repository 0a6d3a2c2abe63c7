"""Reversible transforms of features by their statistics, and the language that names them.

A spec is "name", "name|option=number|...", a chain "a,b" applied in order, or a pair of functions (forward, inverse) of
(column, feature). ``{feature: spec, "*": spec}`` gives features their own; "a&b" gives a feature two outputs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6
Stats = Mapping[str, float]
Step = Callable[[Column], Column]


@dataclass(frozen=True)
class Pair:
    forward: Step
    inverse: Step
    numeric: Callable[[np.ndarray], np.ndarray]


def _no_inverse(_: Column) -> Column:
    raise NotImplementedError("clip cannot be inverted")


def _affine(scale: float, shift: float) -> Pair:
    return Pair(lambda x: x * F.lit(scale) + F.lit(shift), lambda y: (y - F.lit(shift)) / F.lit(scale), lambda a: a * scale + shift)


def _between(low: float, high: float, minim: float, maxim: float, eps: float) -> Pair:
    width, out = high - low + eps, maxim - minim
    return Pair(
        lambda x: (x - F.lit(low)) / F.lit(width) * F.lit(out) + F.lit(minim),
        lambda y: (y - F.lit(minim)) / F.lit(out) * F.lit(width) + F.lit(low),
        lambda a: (a - low) / width * out + minim,
    )


def logexp(s: Stats, eps: float = EPS) -> Pair:
    return Pair(lambda x: F.ln(x + eps), lambda y: F.exp(y) - eps, lambda a: np.log(a + eps))


def logexpp1(s: Stats, eps: float = EPS) -> Pair:
    return Pair(lambda x: F.signum(x) * F.log1p(F.abs(x) + eps), lambda y: F.signum(y) * (F.expm1(F.abs(y)) - eps), lambda a: np.sign(a) * np.log1p(np.abs(a) + eps))


def standardize(s: Stats, eps: float = EPS) -> Pair:
    return Pair(lambda x: (x - F.lit(s["mean"])) / F.lit(s["std"] + eps), lambda y: y * F.lit(s["std"] + eps) + F.lit(s["mean"]), lambda a: (a - s["mean"]) / (s["std"] + eps))


def robust(s: Stats, eps: float = EPS) -> Pair:
    width = s["p75"] - s["p25"] + eps
    return Pair(lambda x: (x - F.lit(s["median"])) / F.lit(width), lambda y: y * F.lit(width) + F.lit(s["median"]), lambda a: (a - s["median"]) / width)


def normalize(s: Stats, minim: float = -1.0, maxim: float = 1.0, eps: float = EPS) -> Pair:
    return _between(s["min"], s["max"], minim, maxim, eps)


def iqrnorm(s: Stats, minim: float = -1.0, maxim: float = 1.0, eps: float = EPS) -> Pair:
    return _between(s["p25"], s["p75"], minim, maxim, eps)


def adaptnorm(s: Stats, minim: float = -1.0, maxim: float = 1.0, eps: float = EPS) -> Pair:
    """Across zero the output range keeps zero's place: the nearer end is at distance 1."""
    if s["min"] < 0 < s["max"]:
        unit = min(abs(s["min"]), s["max"])
        minim, maxim = s["min"] / unit, s["max"] / unit
    return _between(s["min"], s["max"], minim, maxim, eps)


def clip(s: Stats, minim: float = -6.0, maxim: float = 6.0) -> Pair:
    return Pair(lambda x: F.when(x < minim, minim).when(x > maxim, maxim).otherwise(x), _no_inverse, lambda a: np.clip(a, minim, maxim))


def asinh(s: Stats, eps: float = EPS) -> Pair:
    scale = (s["p75"] - s["p25"]) / 1.349 + eps
    return Pair(lambda x: F.asinh(x / F.lit(scale)), lambda y: F.lit(scale) * F.sinh(y), lambda a: np.arcsinh(a / scale))


def identity(s: Stats) -> Pair:
    return Pair(lambda x: x, lambda y: y, lambda a: a)


def quantile_table(s: Stats, target: str) -> tuple[list[float], list[float]]:
    """Increasing values at the known percentiles and their targets; least and largest stand for 0.5 and 99.5."""
    known = {0.5: s["min"], 99.5: s["max"]}
    for k, v in s.items():
        p = 50.0 if k == "median" else float(k[1:]) if k[:1] == "p" and k[1:].isdigit() else None
        if p is not None and v is not None:
            known[p] = v
    percents = sorted(known)
    values = np.maximum.accumulate(np.array([known[p] for p in percents], float))
    if len(np.unique(values)) < len(values) / 2:
        values, percents = _spread(values, percents)
    if target == "gaussian":
        top = NormalDist().inv_cdf(0.995)
        goals = [NormalDist().inv_cdf(p / 100) / top for p in percents]
    elif target in ("uniform", "uniform11"):
        low, high = percents[0], percents[-1]
        unit = [(p - low) / (high - low) for p in percents]
        goals = unit if target == "uniform" else [2 * u - 1 for u in unit]
    else:
        raise ValueError("target must be gaussian, uniform or uniform11")
    keep = [0] + [i for i in range(1, len(values)) if values[i] > values[i - 1]]
    return [float(values[i]) for i in keep], [float(goals[i]) for i in keep]


def _spread(values: np.ndarray, percents: Sequence[float]) -> tuple[np.ndarray, list[float]]:
    """Mostly equal values: distinct ones at even percentiles with the commonest at the middle."""
    distinct, counts = np.unique(values, return_counts=True)
    at = int(counts.argmax())
    below, above = np.linspace(percents[0], 50, at + 1), np.linspace(50, percents[-1], len(distinct) - at)
    return distinct, [float(x) for x in [*below[:-1], 50.0, *above[1:]]]


def _interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear, constant beyond the ends; one step of arithmetic after finding the piece in a literal table."""
    if len(xs) == 1:
        return F.when(x.isNotNull(), F.lit(ys[0]))
    pieces = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(c).alias("c"), F.lit((d - c) / (b - a)).alias("m")) for a, b, c, d in zip(xs, xs[1:], ys, ys[1:], strict=False)])
    held = F.when(x < xs[0], xs[0]).when(x > xs[-1], xs[-1]).otherwise(x)

    def place(v: Column) -> Column:
        piece = F.element_at(F.filter(pieces, lambda p: (p["a"] <= v) | (p["a"] == F.lit(xs[0]))), -1)
        return piece["c"] + (v - piece["a"]) * piece["m"]

    return F.when(F.isnan(x), x).when(x.isNotNull(), F.element_at(F.transform(F.array(held), place), 1))


def quantile(s: Stats, target: str = "gaussian") -> Pair:
    xs, ys = quantile_table(s, target)
    return Pair(lambda x: _interpolate(x, xs, ys), lambda y: _interpolate(y, ys, xs), lambda a: np.interp(a, xs, ys))


NAMED: dict[str, Callable[..., Pair]] = {f.__name__: f for f in (logexp, logexpp1, standardize, robust, normalize, iqrnorm, adaptnorm, clip, asinh, identity, quantile)}


def propagate(pair: Pair, s: Stats) -> dict[str, float]:
    """The statistics of a transformed feature, as far as they follow from those before.

    An affine step maps mean and std exactly. Otherwise order statistics are mapped, and mean and std come from
    quartiles. A step that turns the order around has no such statistics.
    """
    low, high = s["min"], s["max"]
    a, b, mid = (float(pair.numeric(np.array([x], float))[0]) for x in (low, high, (low + high) / 2))
    out = {k: float(pair.numeric(np.array([v], float))[0]) for k, v in s.items() if k in ("min", "max", "median") or (k[:1] == "p" and k[1:].isdigit())}
    if b < a:
        raise ValueError("a transform in a chain turns the order of values around")
    if abs(mid - (a + b) / 2) <= 1e-3 * max(1.0, abs(b - a)) and high > low:
        slope = (b - a) / (high - low)
        out["mean"], out["std"] = a + slope * (s["mean"] - low), abs(slope) * s["std"]
    else:
        out["mean"] = (out["p25"] + 2 * out["median"] + out["p75"]) / 4
        out["std"] = abs(out["p75"] - out["p25"]) / 1.349
    return out


def parse(text: str) -> list[tuple[str, dict[str, float | str]]]:
    steps = []
    for part in text.split(","):
        name, *options = part.strip().split("|")
        if name not in NAMED:
            raise ValueError(f"no transform {name}; one of {sorted(NAMED)}")
        said: dict[str, float | str] = {}
        for o in options:
            k, v = o.split("=")
            try:
                said[k] = float(v)
            except ValueError:
                said[k] = v
        steps.append((name, said))
    return steps


class Transform:
    """Transforms of features whose statistics are known; others pass unchanged."""

    def __init__(self, stats: Mapping[str, Stats] | DataFrame, spec, drop: Sequence[str] = ()):
        if isinstance(stats, DataFrame):  # one row for each feature: as long as the schema is wide
            stats = {r["feature"]: {k: v for k, v in r.asDict().items() if k != "feature"} for r in stats.collect()}
        self.stats = {k: dict(v) for k, v in stats.items() if k not in drop}
        self.spec = spec

    def _spec_of(self, feature: str):
        if not isinstance(self.spec, Mapping):
            return self.spec
        if feature in self.spec:
            return self.spec[feature]
        if "*" in self.spec:
            return self.spec["*"]
        raise KeyError(f"no transform for {feature}")

    def pairs(self, feature: str, spec=None) -> list[Pair]:
        """The steps of a chain, each made with the statistics after those before it."""
        spec = self._spec_of(feature) if spec is None else spec
        if not isinstance(spec, str):
            forward, inverse = spec if isinstance(spec, tuple) else (spec, _no_inverse)
            return [Pair(lambda x: forward(x, feature), lambda y: inverse(y, feature), lambda a: a)]
        steps, s, out = parse(spec), self.stats[feature], []
        for i, (name, options) in enumerate(steps):
            out.append(NAMED[name](s, **options))
            if i + 1 < len(steps):
                s = propagate(out[-1], s)
        return out

    def _outputs(self, feature: str) -> list:
        spec = self._spec_of(feature)
        return spec.split("&") if isinstance(spec, str) and "&" in spec else [spec]

    def forward(self, x: Column, feature: str) -> Column | list[Column]:
        if feature not in self.stats:
            return x
        outs = []
        for spec in self._outputs(feature):
            y = x.cast("double")
            for p in self.pairs(feature, spec):
                y = p.forward(y)
            outs.append(y)
        return outs if len(outs) > 1 else outs[0]

    def inverse(self, y: Column | Sequence[Column], feature: str) -> Column | list[Column]:
        if feature not in self.stats:
            return y
        specs = self._outputs(feature)
        ys = list(y) if len(specs) > 1 else [y]
        outs = []
        for v, spec in zip(ys, specs, strict=True):
            for p in reversed(self.pairs(feature, spec)):
                v = p.inverse(v)
            outs.append(v)
        return outs if len(specs) > 1 else outs[0]

    def apply(self, df: DataFrame, inverse: bool = False, features: Sequence[str] | None = None) -> DataFrame:
        """``df`` with its features transformed in one projection; several outputs are feature_0, feature_1, ..."""
        out = []
        for c in df.columns:
            if (features is not None and c not in features) or c not in self.stats:
                out.append(F.col(c))
                continue
            y = self.inverse(F.col(c), c) if inverse else self.forward(F.col(c), c)
            out += [v.alias(f"{c}_{i}") for i, v in enumerate(y)] if isinstance(y, list) else [y.alias(c)]
        return df.select(*out)
