"""Grid sources: a lazy DataFrame of cells with its extent, features, window, validity rule and tolerances."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import stash

#: What counts as missing besides null and NaN.
INVALID = (-2147483648.0, -9223372036854775808.0, math.inf, -math.inf)
#: Slack of every tolerance, default radius in units of the resolution, decimals that gaps are rounded to.
EPS, RADIUS, DECIMALS = 1e-5, 0.5, 5
#: Coordinates up to which one task numbers an axis; a longer one is numbered in stretches.
SHORT_AXIS, STRETCHES = 100_000, 1000
#: Gaps of a uniform axis differ by less.
UNIFORM = 1e-3


def minutes(c: Column) -> Column:
    """A timestamp (with or without zone) as minutes since the epoch, in double precision."""
    return F.unix_micros(c.cast("timestamp")) / F.lit(6e7)


@dataclass(frozen=True)
class Source:
    """One source of cells.

    ``frame`` has a row for each stored cell; a missing cell is a missing row. ``window``: steps for each dim, an int for
    both sides, (before, after), or None for the whole dim. ``valid_percent``: share of a window that must be valid, by
    dim or tuple of dims, applied in order; an empty rule asks that the centre itself is valid. ``match_radius``: by dim a
    number (in the dim's units; minutes for times) or a percentage of the resolution, e.g. "25%".
    """

    name: str
    frame: DataFrame
    dims: Sequence[str]
    features: Sequence[str] | None = None
    extent: Mapping[str, Sequence] = field(default_factory=dict)
    window: Mapping[str, int | Sequence[int] | None] = field(default_factory=dict)
    valid_percent: Mapping[str | Sequence[str], float] = field(default_factory=dict)
    valid_feature: str = "all"
    invalid_value: float | None = None
    match_radius: Mapping[str, float | str] = field(default_factory=dict)
    preprocessors: Sequence[Callable[[Source, DataFrame], DataFrame]] = ()
    required: bool = True
    sparse: bool = False
    sort_dims: bool = True
    _kept: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self):
        if self.valid_feature not in ("all", "any"):
            raise ValueError("valid_feature must be 'all' or 'any'")
        for d, e in self.extent.items():
            if len(e) != 2:
                raise ValueError(f"extent of {d} must have two ends")
        for d, w in self.window.items():
            if not isinstance(w, int) and w is not None and len(w) != 2:
                raise ValueError(f"window of {d} must be a number, a pair or None")
        for p in self.valid_percent.values():
            if not 0 <= p <= 1:
                raise ValueError("valid_percent must lie in [0, 1]")
        missing = [d for d in self.dims if d not in self.frame.columns]
        if missing:
            raise ValueError(f"dims {missing} are not columns of {self.name}")
        if self.sparse and set(self.dims) - set(self.match_radius):
            raise ValueError("a sparse source must say its match_radius")

    @property
    def feature_names(self) -> list[str]:
        """Requested or all features, sorted; a stored validity column is none."""
        names = self.features if self.features is not None else [c for c in self.frame.columns if c not in self.dims and c != "valid_mask"]
        return sorted(names)

    @property
    def dim_names(self) -> list[str]:
        return sorted(self.dims) if self.sort_dims else list(self.dims)

    def cells(self) -> DataFrame:
        """Preprocessed, projected to dims and features, and cut to the extent (both ends belong to it).

        The extent stays a comparison of a column with literals, so that it reaches the scan.
        """
        df = self.frame
        for d, (lo, hi) in self.extent.items():
            if d in self.dims and not self.preprocessors:
                df = df.where(F.col(d).between(lo, hi))
        for f in self.preprocessors:
            df = f(self, df)
        df = df.select(*self.dim_names, *self.feature_names)
        for d, (lo, hi) in self.extent.items():
            if d in self.dims and self.preprocessors:
                df = df.where(F.col(d).between(lo, hi))
        return df

    def with_frame(self, frame: DataFrame) -> Source:
        return replace(self, frame=frame)

    def coordinate(self, dim: str) -> Column:
        kind = self.frame.schema[dim].dataType
        return minutes(F.col(dim)) if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) else F.col(dim).cast("double")

    def table(self) -> DataFrame:
        """The cells, written to the shared folder when first asked for: a source is read once, however often it is used."""
        if "cells" not in self._kept:
            self._kept["cells"] = stash(self.cells(), "cells")
        return self._kept["cells"]

    def axis(self, dim: str) -> DataFrame:
        """(dim, idx): the distinct coordinates in ascending order, numbered from 0; made once for each dim.

        Up to SHORT_AXIS of them are numbered in one task. More are cut at quantiles into stretches, which are counted and
        numbered apart.
        """
        if dim not in self._kept:
            values = stash(self.table().select(dim).where(F.col(dim).isNotNull()).groupBy(dim).agg(F.count(F.lit(1)).alias("__n")).select(dim), "axis")
            self._kept[dim, "size"] = n = values.count()
            self._kept[dim] = stash(_numbered(values, dim, n), "axis")
        return self._kept[dim]

    def axis_size(self, dim: str) -> int:
        self.axis(dim)
        return self._kept[dim, "size"]

    def span(self, dim: str, size: int | None = None) -> tuple[int, int]:
        """Steps before and after a centre; None is the whole dim of ``size`` steps."""
        w = self.window.get(dim, 0)
        if w is None:
            if size is None:
                size = self.axis_size(dim)
            return size // 2, size - size // 2 - 1
        return (w, w) if isinstance(w, int) else (int(w[0]), int(w[1]))

    @property
    def optional(self) -> bool:
        return not self.required or (bool(self.valid_percent) and math.prod(self.valid_percent.values()) == 0)

    def config_hash(self) -> str:
        """Of all that decides the cells and their validity: the data with its files and their versions, and the rules.

        Functions count by their code and what they hold. Frames without files count by their content, which is read
        for it.
        """
        said = {k: getattr(self, k) for k in ("name", "dims", "features", "extent", "valid_feature", "invalid_value", "sort_dims")}
        said["extent"] = {d: [str(x) for x in e] for d, e in self.extent.items()}
        said["preprocessors"] = [hashlib.sha256(_function_bytes(f)).hexdigest() for f in self.preprocessors]
        said["schema"], said["data"] = self.frame.schema.json(), _data_version(self.frame)
        return hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()


def _function_bytes(f: Callable) -> bytes:
    from pyspark import cloudpickle

    try:
        return cloudpickle.dumps(f)
    except Exception as error:
        raise ValueError(f"{f} cannot be told apart from others, so its results cannot be cached") from error


def _data_version(frame: DataFrame) -> str:
    """What changes when the rows of a frame may have: plan, files, sizes and times; else a digest of its rows."""
    spark = frame.sparkSession
    files = sorted(frame.inputFiles())
    if not files:
        row = frame.select(F.xxhash64(*[F.col(c) for c in frame.columns]).alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.shiftright("h", 20))).first()
        return json.dumps(list(row))
    folders = sorted({f.rsplit("/", 1)[0] for f in files})
    listed = spark.read.format("binaryFile").load(folders).select("path", "length", F.col("modificationTime").cast("string").alias("t"))
    wanted = listed.join(F.broadcast(spark.createDataFrame([(f,) for f in files], "path string")), "path", "left_semi") if len(files) <= 10_000 else listed
    row = wanted.select(F.xxhash64("path", "length", "t").alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.shiftright("h", 20))).first()
    return json.dumps([frame.semanticHash(), *files[:1], len(files), *row])


def _numbered(values: DataFrame, dim: str, n: int) -> DataFrame:
    from pyspark.sql import Window

    if n <= SHORT_AXIS:
        return values.select(dim, (F.row_number().over(Window.orderBy(dim)) - 1).cast("long").alias("idx"))
    kind = values.schema[dim].dataType
    at = F.unix_micros(F.col(dim).cast("timestamp")) if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) else F.col(dim).cast("double")
    edges = sorted(set(values.agg(F.percentile_approx(at, [i / STRETCHES for i in range(1, STRETCHES)], 10 * STRETCHES)).first()[0]))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(edges).bit_length()))])
    bounds = F.array(*[F.lit(e) for e in edges])
    stretch = F.aggregate(steps, F.lit(0), lambda k, step: F.when(F.get(bounds, k + step - 1) <= at, k + step).otherwise(k))
    cut = values.withColumn("__s", stretch)
    counts = cut.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))  # at most STRETCHES rows
    before = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy("__s").orderBy(dim)) - 1
    return cut.withColumn("__l", local).join(F.broadcast(bases), "__s").select(dim, (F.col("__base") + F.col("__l")).cast("long").alias("idx"))


def is_valid(value: Column, invalid_value: float | None = None) -> Column:
    """Not null, not NaN, not the source's own mark, and none of the fixed marks."""
    x = value.cast("double")
    bad = x.isNull() | F.isnan(x) | x.isin([F.lit(v) for v in INVALID])
    if invalid_value is not None:
        bad = bad | (x == F.lit(float(invalid_value)))
    return ~F.coalesce(bad, F.lit(True))


def cell_valid(source: Source) -> Column:
    """Validity of a cell over all or any of the features."""
    parts = [is_valid(F.col(f), source.invalid_value) for f in source.feature_names]
    held = parts[0]
    for p in parts[1:]:
        held = held & p if source.valid_feature == "all" else held | p
    return held


@dataclass(frozen=True)
class Tolerance:
    """Reach of a coordinate below and above itself, as columns, and an upper bound of both."""

    left: Column
    right: Column
    most: float


#: Steps of an axis in a stretch whose neighbours are found together.
STRETCH = 50_000


def neighbours(axis: DataFrame, value: str, index: str = "idx", before: str = "before", after: str = "after") -> DataFrame:
    """``axis`` with the values one step before and after; steps are numbered without gaps.

    The axis is cut in stretches of steps. The last row of one and the first of the next go to both, so each stretch finds
    its neighbours alone and no task sees the whole axis.
    """
    from pyspark.sql import Window

    at = F.pmod(F.col(index), F.lit(STRETCH))
    own = F.floor(F.col(index) / STRETCH)
    both = F.array_compact(F.array(own, F.when(at == 0, own - 1), F.when(at == STRETCH - 1, own + 1)))
    cut = axis.withColumns({"__own": own, "__stretch": F.explode(both)})
    w = Window.partitionBy("__stretch").orderBy(index)
    found = cut.withColumns({before: F.lag(value).over(w), after: F.lead(value).over(w)})
    return found.where("__own = __stretch").drop("__own", "__stretch")


def resolutions(source: Source, radius: float = RADIUS) -> dict[str, tuple[DataFrame | None, float, float]]:
    """For each dim (table of (coordinate, left, right) or None, scalar reach, largest reach), without the slack.

    Gaps between neighbouring coordinates are rounded; an axis of one coordinate has gap 0. If the gaps of all dims are
    uniform the least of each is its resolution; if any is not, every dim has per-coordinate gaps, those at the ends
    repeated. ``match_radius`` comes before: r means a reach of r, "p%" p percent of the gap.
    """
    gaps, uniform = {}, True
    for d in source.dim_names:
        if source.sparse:
            gaps[d] = (None, 0.0, 0.0)
            continue
        a = source.axis(d).select(source.coordinate(d).alias("c"), "idx")
        a = neighbours(a, "c").select("c", F.round(F.col("after") - F.col("c"), DECIMALS).alias("after"), F.round(F.col("c") - F.col("before"), DECIMALS).alias("before"))
        low, high = a.agg(F.min("after"), F.max("after")).first()
        gaps[d] = (a, low or 0.0, high or 0.0)
        uniform = uniform and (high or 0.0) - (low or 0.0) < UNIFORM
    out = {}
    for d, (a, low, high) in gaps.items():
        own = source.match_radius.get(d)
        if own is not None and not str(own).endswith("%"):
            out[d] = (None, float(own), float(own))
            continue
        scale = float(str(own)[:-1]) / 100 if own is not None else radius
        if uniform:
            out[d] = (None, low * scale, low * scale)
        else:
            left = F.coalesce("before", "after", F.lit(0.0)) * scale
            right = F.coalesce("after", "before", F.lit(0.0)) * scale
            out[d] = (a.select("c", left.alias("left"), right.alias("right")), 0.0, high * scale)
    return out


def reader(spark: SparkSession, path: str, **options) -> DataFrame:
    """Opens a path by its suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    kinds = {"parquet": "parquet", "pq": "parquet", "orc": "orc", "json": "json", "jsonl": "json", "csv": "csv", "txt": "text", "avro": "avro"}
    if suffix not in kinds:
        raise ValueError(f"no reader for .{suffix}; one of {sorted(kinds)}")
    return spark.read.format(kinds[suffix]).options(**options).load(path)


def cache(source: Source, folder: str, overwrite: bool = False) -> Source:
    """The source's preprocessed cells with their validity as a table under its configuration's hash.

    A table that is there already is used again, as its name says that it was made by the same configuration from the same
    data: another frame, changed files or rules, or a function with other contents give another name.
    """
    spark = source.frame.sparkSession
    path = f"{folder.rstrip('/')}/{source.name}-{source.config_hash()[:16]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if overwrite or not there:
        source.cells().withColumn("valid_mask", cell_valid(source)).write.mode("overwrite").parquet(path)
    return replace(source, frame=spark.read.parquet(path), preprocessors=(), features=source.feature_names)


def synthetic(spark: SparkSession, dims: Mapping[str, Sequence[float]], features: int = 1, missing: float = 0.0, seed: int = 42) -> DataFrame:
    """A dense grid over the given coordinates; features count cells, a hashed share of them is null."""
    df = spark.range(math.prod(len(v) for v in dims.values()))
    rest, cols = F.col("id"), []
    for d in reversed(list(dims)):
        n = len(dims[d])
        cols.insert(0, F.element_at(F.array(*[F.lit(float(x)) for x in dims[d]]), (F.pmod(rest, F.lit(n)) + 1).cast("int")).alias(d))
        rest = F.floor(rest / n)
    for i in range(features):
        keep = F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(10_000)) >= int(missing * 10_000)
        cols.append(F.when(keep, F.col("id").cast("double")).alias(f"var_{i}"))
    return df.select(*cols)


def shared_extent(sources: Sequence[Source]) -> dict[str, tuple[float, float]]:
    """For each dim the interval that all sources with it have, in coordinates."""
    found: dict[str, tuple[float, float]] = {}
    for s in sources:
        row = s.table().agg(*[f(s.coordinate(d)).alias(f"{n}_{d}") for d in s.dim_names for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for d in s.dim_names:
            lo, hi = row[f"lo_{d}"], row[f"hi_{d}"]
            if lo is not None:
                old = found.get(d, (-math.inf, math.inf))
                found[d] = (max(old[0], lo), min(old[1], hi))
    return found


def equal_extents(sources: Sequence[Source]) -> list[Source]:
    """The sources cut to the extent they share, with one more coordinate on each side where a source has it."""
    shared, out = shared_extent(sources), []
    for s in sources:
        df = s.table()
        for d in s.dim_names:
            lo, hi = shared[d]
            c = s.coordinate(d)
            below, above = s.table().agg(F.max(F.when(c < lo, c)), F.min(F.when(c > hi, c))).first()
            df = df.where(c.between(lo if below is None else below, hi if above is None else above))
        out.append(replace(s, frame=df, extent={}, preprocessors=()))
    return out
