"""Windows gathered around centres, the samples made of them, and the language that selects from samples."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.grid import Source
from .validity import indexed


#: Cells of a window up to which centres are exploded to them; larger windows are cut from tiles.
EXPLODED = 9
#: Steps of a tile in a dim: so many for each step of the window beside the centre, and at least so many.
TILE_STEPS, LEAST_STEPS = 4, 8
#: Window cells in a batch that leaves a tile.
BATCH_CELLS = 1 << 20


def gather(source: Source, centers: DataFrame) -> DataFrame:
    """``centers`` (with i_<dim>) with an array column for each feature and dim: the window's values in row-major order.

    Missing cells are null. Windows of up to EXPLODED cells: centres are exploded to their steps and joined to the cells,
    which were written once with the source's axes. Larger ones are cut from tiles (``from_tiles``), and cost one exchange
    whose size does not depend on the window's.
    """
    df, sizes = indexed(source)
    span = {d: source.span(d, sizes[d]) for d in source.dim_names}
    keys = [f"i_{d}" for d in source.dim_names]
    large = math.prod(1 + sum(s) for s in span.values()) > EXPLODED
    if large:
        out = from_tiles(df, centers, {f"i_{d}": span[d] for d in source.dim_names}, source.feature_names)
    else:
        out = _exploded(df, centers, source, span)
    for d in source.dim_names:
        axis = source.axis(d).select(F.col("idx").alias(f"i_{d}"), F.col(d))
        if span[d] == (0, 0):
            near = axis.select(f"i_{d}", F.array(d).alias(d))
        else:
            near = from_tiles(axis, axis.select(f"i_{d}"), {f"i_{d}": span[d]}, [d])
        out = out.join(near, f"i_{d}")
    return out.select(*keys, *source.feature_names, *source.dim_names)


def _exploded(df: DataFrame, centers: DataFrame, source: Source, span: Mapping[str, tuple[int, int]]) -> DataFrame:
    keys = [f"i_{d}" for d in source.dim_names]
    axes = [[*range(-span[d][0], span[d][1] + 1)] for d in source.dim_names]
    offsets = list(itertools.product(*axes))
    rows = F.array(*[F.struct(F.lit(n).alias("__p"), *[F.lit(o).cast("long").alias(f"o_{d}") for d, o in zip(source.dim_names, at, strict=True)]) for n, at in enumerate(offsets)])
    spread = centers.select(*keys).withColumn("__o", F.explode(rows))
    spread = spread.select(*keys, F.col("__o.__p").alias("__p"), *[(F.col(f"i_{d}") + F.col(f"__o.o_{d}")).alias(f"a_{d}") for d in source.dim_names])
    values = df.select(*[F.col(f"i_{d}").alias(f"a_{d}") for d in source.dim_names], *source.feature_names)
    cells = spread.join(values, [f"a_{d}" for d in source.dim_names], "left")
    lists = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__p", *source.feature_names))).alias("__w"))
    out = centers.select(*keys).join(lists, keys)
    return out.select(*keys, *[field_of("__w", f).alias(f) for f in source.feature_names])


def tiled(cells: DataFrame, centers: DataFrame, span: Mapping[str, tuple[int, int]], features: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """Cells and centres (feature columns null, centre true) with the tile t_0, t_1, ... they are for, and the steps of a tile.

    A centre is in one tile. A cell is in its own and in those that have it in their halo: a tile has TILE_STEPS steps for
    each of the halo's, so these copies are a fixed share, whatever the window.
    """
    steps = [max(LEAST_STEPS, TILE_STEPS * sum(s)) for s in span.values()]
    wide, own = cells.select(*span, *features, F.lit(False).alias("centre")), centers.select(*span, *[F.lit(None).cast(cells.schema[f].dataType).alias(f) for f in features], F.lit(True).alias("centre"))
    for n, ((i, (before, after)), size) in enumerate(zip(span.items(), steps, strict=True)):
        first, last = (F.floor((F.col(i) + by) / size).cast("long") for by in (-after, before))
        wide = wide.withColumn(f"t_{n}", F.explode(F.sequence(first, last)) if before + after else first)
        own = own.withColumn(f"t_{n}", F.floor(F.col(i) / size).cast("long"))
    return wide.unionByName(own), steps


def from_tiles(cells: DataFrame, centers: DataFrame, span: Mapping[str, tuple[int, int]], features: Sequence[str]) -> DataFrame:
    """``centers`` (the index columns that are the keys of ``span``) with the features of the window around each, as arrays
    in row-major order; null where there is no cell. Of cells with equal indexes one counts; repeated centres come once each.

    Cells and centres meet in tiles, boxes of cells with a halo as deep as the window. A tile is an array of places of its
    cells; a window is a box of that array, so it is found by adding numbers, and all windows of a tile are taken at once.
    """
    rows, steps = tiled(cells, centers, span, features)
    names = [f"t_{n}" for n in range(len(steps))]
    box = [s + sum(span[i]) for s, i in zip(steps, span, strict=True)]
    fields = ", ".join([*[f"`{i}` long" for i in span], *[f"`{f}` array<{cells.schema[f].dataType.simpleString()}>" for f in features]])
    lows, shape = [before for before, _ in span.values()], [1 + sum(s) for s in span.values()]

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        strides = np.cumprod([1, *box[:0:-1]])[::-1]
        offsets = sum(o * s for o, s in zip(np.indices(shape).reshape(len(shape), -1), strides, strict=True))
        k = len(span)

        def windows(held: list) -> Iterator:
            table = pa.Table.from_batches(held)
            index = [np.asarray(table.column(n)) for n in range(k)]
            corner = [int(np.asarray(table.column(k + len(features) + 1 + n))[0]) * s - low for n, (s, low) in enumerate(zip(steps, lows, strict=True))]
            place = sum((i - c) * s for i, c, s in zip(index, corner, strides, strict=True))
            centre = np.asarray(table.column(k + len(features)))
            row_of = np.full(int(np.prod(box)), -1, np.int64)
            row_of[place[~centre]] = np.flatnonzero(~centre)
            asked = np.flatnonzero(centre)
            each = max(1, BATCH_CELLS // len(offsets))
            values = [table.column(k + n).combine_chunks() for n in range(len(features))]
            for at in range(0, len(asked), each):
                some = asked[at : at + each]
                rows = row_of[(place[some] - sum(low * s for low, s in zip(lows, strides, strict=True)))[:, None] + offsets[None]].ravel()
                take = pa.array(rows, mask=rows < 0)
                ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(offsets))
                yield pa.RecordBatch.from_arrays([pa.array(i[some]) for i in index] + [pa.ListArray.from_arrays(ends, v.take(take)) for v in values], [*span, *features])

        held, now = [], None
        for batch in batches:
            tiles = np.stack([np.asarray(batch.column(k + len(features) + 1 + n)) for n in range(k)])
            cuts = [0, *(np.flatnonzero((tiles[:, 1:] != tiles[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                tile = tuple(tiles[:, a])
                if held and tile != now:
                    yield from windows(held)
                    held = []
                now = tile
                held.append(batch.slice(a, b - a))
        if held:
            yield from windows(held)

    typed = rows.select(*[F.col(i).cast("long").alias(i) for i in span], *features, "centre", *names)
    return typed.repartition(*names).sortWithinPartitions(*names).mapInArrow(cut, fields)


def field_of(array: str, name: str) -> Column:
    """One field of an array of structs, as an array."""
    return F.transform(array, lambda x: x[name])


def gather_1d(df: DataFrame, order: str, value: str, before: int, after: int, partition: Sequence[str] = (), out: str = "window") -> DataFrame:
    """``df`` with the values from ``before`` steps before to ``after`` after, in order; nulls keep their place."""
    w = Window.partitionBy(*partition).orderBy(order).rangeBetween(-before, after)
    listed = F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).over(w)
    return df.withColumn(out, F.transform(F.array_sort(listed), lambda x: x["v"]))


def samples(sources: Sequence[Source], matches: DataFrame, centers: Sequence[DataFrame]) -> DataFrame:
    """Matches with a struct s0, s1, ... of window arrays for each source; unmatched and dropped sources are null.

    Matches carry only steps; windows are gathered for the centres that matched and joined last.
    """
    out = matches
    for i, (source, c) in enumerate(zip(sources, centers, strict=True)):
        keys = [f"i_{d}" for d in source.dim_names]
        used = matches.select(f"k{i}.*").where(" and ".join(f"{k} is not null" for k in keys)).distinct()
        w = gather(source, c.join(used, keys, "left_semi"))
        w = w.select(F.struct(*keys).alias(f"k{i}"), F.struct(*[x for x in w.columns if x not in keys]).alias(f"s{i}"))
        out = out.join(w, f"k{i}", "left")
    return out.select(*matches.columns, *[f"s{i}" for i in range(len(sources))])


def dropped(df: DataFrame, sources: Sequence[Source], which: Sequence[int | str], keep_coordinates: bool = False) -> DataFrame:
    """Samples without the sources named by number or label: their structs are null, or only their features.

    In a label $ may stand for /. Samples keep their shape, so selectors work as before and give null.
    """
    labels = [s.name for s in sources]
    out = {}
    for w in which:
        i = int(w) if str(w).lstrip("-").isdigit() else next((n for n, own in enumerate(labels) if own == str(w).replace("$", "/")), None)
        if i is None or not -len(sources) <= i < len(sources):
            raise KeyError(f"no source {w}")
        i %= len(sources)
        kind, s = df.schema[f"s{i}"].dataType, F.col(f"s{i}")
        if not keep_coordinates:
            out[f"s{i}"] = F.lit(None).cast(kind)
            continue
        parts = [F.lit(None).cast(f.dataType).alias(f.name) if f.name in sources[i].feature_names else s[f.name].alias(f.name) for f in kind]
        out[f"s{i}"] = F.when(s.isNotNull(), F.struct(*parts))
    return df.withColumns(out)


class Selector:
    """Resolves names against the structs of a sample.

    ``name``: the first source that has it, data before coordinates. ``name@2`` or ``name@label``: that source.
    ``label__name``: the source with the label, in which $ stands for /. ``distance:a:b``: for each dim the differences between two sources.
    """

    def __init__(self, schemas: Sequence[tuple[str, Sequence[str], Sequence[str]]]):
        """schemas: (label, data names, coordinate names) of s0, s1, ..."""
        self.schemas = [(label, list(data), list(coords)) for label, data, coords in schemas]

    @classmethod
    def of(cls, sources: Sequence[Source]) -> Selector:
        return cls([(s.name, s.feature_names, s.dim_names) for s in sources])

    def _label(self, label: str) -> int:
        if label.isdigit():
            i = int(label)
            if i < len(self.schemas):
                return i
        for i, (own, _, _) in enumerate(self.schemas):
            if own == label.replace("$", "/"):
                return i
        raise KeyError(f"no source {label}")

    def find(self, name: str) -> tuple[int, str]:
        if "@" in name:
            base, label = name.rsplit("@", 1)
            i = self._label(label)
            if base not in self.schemas[i][1] + self.schemas[i][2]:
                raise KeyError(f"source {label} has no {base}")
            return i, base
        for part in (1, 2):
            for i, schema in enumerate(self.schemas):
                if name in schema[part]:
                    return i, name
        if "__" in name:
            label, base = name.split("__", 1)
            i = self._label(label)
            if base in self.schemas[i][1] + self.schemas[i][2]:
                return i, base
        raise KeyError(f"no source has {name}")

    def column(self, name: str) -> Column:
        if name.startswith("distance:"):
            _, a, b = name.split(":")
            return F.struct(*[c.alias(d) for d, c in self.distances(a, b).items()])
        i, base = self.find(name)
        return F.col(f"s{i}.{base}")

    def distances(self, a: int | str, b: int | str) -> dict[str, Column]:
        """Difference matrices of two sources in every dim; null where one has no such coordinate."""
        i, j = self._label(str(a)), self._label(str(b))
        if i == j:
            raise ValueError("a distance needs two sources")
        own, other = self.schemas[i][2], self.schemas[j][2]
        return {d: distance(F.col(f"s{i}.{d}"), F.col(f"s{j}.{d}")) if d in own and d in other else F.lit(None) for d in sorted({*own, *other})}

    def select(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        return df.select(*[self.column(n).alias(n) for n in names])

    def to_array(self, df: DataFrame, names: Sequence[str], out: str = "values") -> DataFrame:
        return df.select(F.array(*[self.column(n) for n in names]).alias(out))

    def to_struct(self, df: DataFrame, names: Sequence[str], out: str = "values") -> DataFrame:
        return df.select(F.struct(*[self.column(n).alias(n) for n in names]).alias(out))

    def available(self, names) -> list[str]:
        """The names of a nested list that some source has, in order; an explicit source that lacks one is an error."""
        out: list[str] = []
        for n in [names] if isinstance(names, str) else names:
            if not isinstance(n, str):
                out += self.available(n)
                continue
            try:
                self.find(n)
            except KeyError:
                if "@" in n:
                    raise
                continue
            out.append(n)
        return out

    def only(self, name: str) -> Column:
        """A feature that exactly one source has."""
        has = [i for i, (_, data, _) in enumerate(self.schemas) if name in data]
        if len(has) != 1:
            raise KeyError(f"{len(has)} sources have {name}")
        return F.col(f"s{has[0]}.{name}")

    def groups(self) -> dict[str, dict[str, list[str]]]:
        """For each label its data and coordinates."""
        return {label: {"data": data, "coords": coords} for label, data, coords in self.schemas}

    def mean_coordinates(self, df: DataFrame) -> DataFrame:
        """For each dim the mean over the sources of their mean coordinate, missing ones left out."""
        out = {}
        for d in sorted({c for _, _, coords in self.schemas for c in coords}):
            means = [_mean(F.col(f"s{i}.{d}")) for i, (_, _, coords) in enumerate(self.schemas) if d in coords]
            out[d] = _mean(F.array(*means))
        return df.select(*[c.alias(d) for d, c in out.items()])


def _mean(array: Column) -> Column:
    kept = F.filter(F.transform(array, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))


def distance(a: Column, b: Column) -> Column:
    """The matrix a[i] - b[j]."""
    return F.transform(a, lambda x: F.transform(b, lambda y: x - y))


def representative(array: Column, time: bool) -> Column:
    """The last step of a time window, the centre of another."""
    return F.element_at(array, -1) if time else F.get(array, (F.size(array) / 2).cast("int"))

