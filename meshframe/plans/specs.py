"""Declared inputs and outputs: shapes and names of tensors, sources planned from them, arrays as frames."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.grid import Source


@dataclass(frozen=True)
class TensorSpec:
    """Name, shape (None: any size, first the batch) and dtype of a value; names may be label__key."""

    name: str
    shape: tuple = (None,)
    dtype: str = "double"
    dims: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.name:
            raise ValueError("a spec needs a name")
        if self.dims and len(self.dims) != len(self.shape) - 1:
            raise ValueError("dims must name all but the batch axis")

    @property
    def label(self) -> str | None:
        return self.name.split("__", 1)[0] if "__" in self.name else None

    @property
    def key(self) -> str:
        return self.name.split("__", 1)[-1]

    def accepts(self, other: TensorSpec) -> bool:
        """Equal rank and dtype, and equal sizes where both are known."""
        return self.dtype == other.dtype and len(self.shape) == len(other.shape) and all(a is None or b is None or a == b for a, b in zip(self.shape, other.shape, strict=True))

    def data_type(self) -> T.DataType:
        kind = T._parse_datatype_string(self.dtype)
        for _ in self.shape[1:]:
            kind = T.ArrayType(kind)
        return kind

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> TensorSpec:
        raw = json.loads(text)
        return cls(raw["name"], tuple(raw["shape"]), raw["dtype"], tuple(raw["dims"]))


@dataclass(frozen=True)
class IOSpec:
    """What a model reads from one source: features, and by dim the size of the window (None: the default depth)."""

    source: str
    features: Sequence[str]
    window: Mapping[str, int | None] = field(default_factory=dict)
    labeled: bool = True

    def specs(self) -> list[TensorSpec]:
        shape = (None, *[n for n in self.window.values()])
        label = self.source.replace("/", "$")
        return [TensorSpec(f"{label}__{f}" if self.labeled else f, shape, dims=tuple(self.window)) for f in self.features]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(s.name, s.data_type()) for s in self.specs()])


def span_of(size: int) -> tuple[int, int]:
    """Steps before and after the centre of a window of ``size``: size // 2 before, the rest but the centre after."""
    return size // 2, size - size // 2 - 1


def sources_from(specs: Sequence[IOSpec], open_source: Callable[[str], tuple[DataFrame, Sequence[str]]], depths: Mapping[str, int] | None = None, options: Mapping[str, Mapping] | None = None, find_location: Callable[[str], str] | None = None, adapt: Callable[[str, DataFrame], DataFrame] | None = None) -> list[Source]:
    """One source for each distinct source and window; sizes None come from ``depths``; options["*"] hold for all.

    A coordinate that is asked for as a feature joins the first source whose window is the same. ``find_location`` says
    where a source lies, for ``open_source``; ``adapt`` changes what was opened, e.g. its names.
    """
    groups: dict[tuple, list[str]] = {}
    for s in specs:
        window = tuple(sorted((d, (depths or {})[d] if n is None else n) for d, n in s.window.items()))
        own = groups.setdefault((s.source, window), [])
        own += [f for f in s.features if f not in own]
    out = []
    for (name, window), features in groups.items():
        frame, dims = open_source(find_location(name) if find_location else name)
        frame = adapt(name, frame) if adapt else frame
        absent = [f for f in features if f not in frame.columns]
        if absent:
            raise ValueError(f"{name} has no {absent}")
        said = {**(options or {}).get("*", {}), **(options or {}).get(name, {})}
        out.append(Source(name, frame, dims, features=[f for f in features if f not in dims], window={d: span_of(n) for d, n in window}, **said))
    return out


class StructuredDataset:
    """Arrays of one length as the columns of a frame; a row is a sample."""

    def __init__(self, spark: SparkSession, *arrays: Sequence, labels: Sequence[str] | None = None):
        self.labels = list(labels or map(str, range(len(arrays))))
        if len({len(a) for a in arrays}) > 1:
            raise ValueError("arrays must have one length")
        rows = [(i, *[_plain(x) for x in row]) for i, row in enumerate(zip(*arrays, strict=True))]
        self.frame = spark.createDataFrame(rows, ["row_id", *self.labels])

    def to_json(self) -> str:
        """For small sets: all rows come to the driver."""
        return json.dumps({"labels": self.labels, "rows": [[_plain(r[x]) for x in self.labels] for r in self.frame.orderBy("row_id").collect()]})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> StructuredDataset:
        raw = json.loads(text)
        return cls(spark, *[list(x) for x in zip(*raw["rows"], strict=True)], labels=raw["labels"])

    def rows_as_json(self) -> DataFrame:
        return self.frame.select("row_id", F.to_json(F.struct(*self.labels)).alias("json"))


def _plain(x):
    return [_plain(y) for y in x] if hasattr(x, "__len__") and not isinstance(x, str | bytes) else (x.item() if hasattr(x, "item") else x)
