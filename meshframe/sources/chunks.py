"""A chunked array store: a data source of Spark whose partitions are chunks of an array.

``<path>/array.json`` names dims (with the file of their coordinates), features, chunk sizes and the index of chunks;
``<path>/shards/*`` hold the chunks, each feature of a chunk compressed on its own. A chunk is a box of cells: a bit for each
that is there, and for each feature a bit for each that is not null and the values in row-major order. Nothing refers to a
shard until array.json is written, which is the last step of a commit.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .grid import Source

FORMAT = "meshframe-chunks"
#: Compressed bytes of chunks that one task reads, and most cells of a chunk.
TASK_BYTES, MOST_CELLS = 16 << 20, 1 << 22
#: Types by name: of Spark's column, of the values as they are stored.
KINDS = {"bigint": "<i8", "int": "<i4", "smallint": "<i2", "tinyint": "<i1", "double": "<f8", "float": "<f4", "boolean": "<u1", "timestamp": "<i8", "timestamp_ntz": "<i8", "date": "<i4"}
TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(), "tinyint": T.ByteType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "date": T.DateType()}


def files_at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _put(path: str, name: str, data: bytes) -> None:
    """A file under a temporary name, renamed when it is whole."""
    fs, base = files_at(path)
    folder = f"{base}/{name}".rsplit("/", 1)[0]
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(draft, compression=None) as out:
        out.write(data)
    fs.move(draft, f"{base}/{name}")


def _get(path: str, name: str, at: int = 0, size: int | None = None) -> bytes:
    fs, base = files_at(path)
    with fs.open_input_file(f"{base}/{name}") as f:
        f.seek(at)
        return f.read() if size is None else f.read(size)


def _press(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _open(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


@dataclass(frozen=True)
class Layout:
    """What array.json says. index: rows of (chunk number in each dim, shard, offset of the presence bits and of each
    feature, end), as one array."""

    dims: Sequence[str]
    dim_kinds: Sequence[str]
    coordinates: Sequence[np.ndarray]
    chunks: Sequence[int]
    features: Sequence[str]
    kinds: Sequence[str]
    shards: Sequence[str]
    index: np.ndarray

    @classmethod
    def read(cls, path: str) -> Layout:
        said = json.loads(_get(path, "array.json"))
        coordinates = [np.frombuffer(_open(_get(path, d["file"])), KINDS[d["kind"]]) for d in said["dims"]]
        index = np.frombuffer(_open(_get(path, said["index"])), "<i8").reshape(-1, len(said["dims"]) + len(said["features"]) + 3)
        names, kinds = [f["name"] for f in said["features"]], [f["kind"] for f in said["features"]]
        return cls([d["name"] for d in said["dims"]], [d["kind"] for d in said["dims"]], coordinates, [d["chunk"] for d in said["dims"]], names, kinds, said["shards"], index)

    def schema(self, features: Sequence[str]) -> T.StructType:
        parts = [*zip(self.dims, self.dim_kinds, strict=True), *[(f, self.kinds[self.features.index(f)]) for f in features]]
        return T.StructType([T.StructField(n, TYPES[k]) for n, k in parts])

    def box(self, dim: int, chunk: int) -> int:
        """Steps of a chunk in a dim: the last one may be shorter."""
        return min(self.chunks[dim], len(self.coordinates[dim]) - chunk * self.chunks[dim])


def _number(value, kind: str):
    """A filter's value in the terms of stored coordinates; None if it has none."""
    import datetime

    if kind == "date" and isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return (value - datetime.date(1970, 1, 1)).days
    if kind.startswith("timestamp") and isinstance(value, datetime.datetime):
        zero = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc if value.tzinfo else None)
        if value.tzinfo is None and kind == "timestamp":
            return None  # of the session's zone, which is not known here
        return (value - zero) // datetime.timedelta(microseconds=1)
    return value if isinstance(value, int | float) and not isinstance(value, bool) and kind not in ("date", "timestamp", "timestamp_ntz") else None


class ChunkReader(DataSourceReader):
    """Reads the chunks that a box of coordinates meets; filters on dims narrow the box and stay filters of the rows."""

    def __init__(self, path: str, features: Sequence[str], layout: Layout):
        self.path, self.features, self.layout = path, list(features), layout
        self.steps = [(0, len(c)) for c in layout.coordinates]

    def pushFilters(self, filters):
        for f in filters:
            self._narrow(f)
            yield f  # rows of a chunk that do not fit are Spark's to drop

    def _narrow(self, f) -> None:
        if not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In) or f.attribute[0] not in self.layout.dims:
            return
        d = list(self.layout.dims).index(f.attribute[0])
        c, kind = self.layout.coordinates[d], self.layout.dim_kinds[d]
        values = [_number(v, kind) for v in (f.value if isinstance(f, In) else [f.value])]
        if not values or any(v is None or v != v for v in values):
            return
        low, high = self.steps[d]
        if not isinstance(f, LessThan | LessThanOrEqual):
            low = max(low, int(np.searchsorted(c, min(values), "right" if isinstance(f, GreaterThan) else "left")))
        if not isinstance(f, GreaterThan | GreaterThanOrEqual):
            high = min(high, int(np.searchsorted(c, max(values), "left" if isinstance(f, LessThan) else "right")))
        self.steps[d] = (low, high)

    def chunks(self) -> np.ndarray:
        """Rows of the index that the box meets."""
        index = self.layout.index
        keep = np.ones(len(index), bool)
        for d, ((low, high), size) in enumerate(zip(self.steps, self.layout.chunks, strict=True)):
            keep &= (index[:, d] * size < high) & ((index[:, d] + 1) * size > low) & (low < high)
        return index[keep]

    def partitions(self):
        rows, out, held = self.chunks(), [[]], 0
        for row in rows:
            size = int(row[-1] - row[len(self.layout.dims) + 1])
            if out[-1] and held + size > TASK_BYTES:
                out.append([])
                held = 0
            out[-1].append(row)
            held += size
        return [InputPartition(np.array(p, np.int64)) for p in out]

    def read(self, partition) -> Iterator:
        import pyarrow as pa

        layout, k = self.layout, len(self.layout.dims)
        kinds = [*layout.dim_kinds, *[layout.kinds[list(layout.features).index(f)] for f in self.features]]
        arrow = {"<i8": pa.int64(), "<i4": pa.int32(), "<i2": pa.int16(), "<i1": pa.int8(), "<f8": pa.float64(), "<f4": pa.float32(), "<u1": pa.bool_()}
        named = {"timestamp": pa.timestamp("us", "UTC"), "timestamp_ntz": pa.timestamp("us"), "date": pa.date32()}
        types = [named.get(x) or arrow[KINDS[x]] for x in kinds]

        def column(values: np.ndarray, missing: np.ndarray | None, kind: str, to) -> pa.Array:
            raw = pa.array(values.astype(bool) if kind == "boolean" else values, mask=missing)
            return raw if raw.type == to else raw.cast(to)

        for row in partition.value:
            shape = [layout.box(d, int(row[d])) for d in range(k)]
            shard, at = f"shards/{layout.shards[row[k]]}", row[k + 1 :]
            bits = np.frombuffer(_open(_get(self.path, shard, int(at[0]), int(at[1] - at[0]))), np.uint8)
            there = np.flatnonzero(np.unpackbits(bits, count=math.prod(shape)))
            inside = np.ones(len(there), bool)
            index = np.unravel_index(there, shape)
            for d, (low, high) in enumerate(self.steps):
                step = index[d] + row[d] * layout.chunks[d]
                inside &= (step >= low) & (step < high)
            columns = [column(layout.coordinates[d][index[d][inside] + row[d] * layout.chunks[d]], None, layout.dim_kinds[d], types[d]) for d in range(k)]
            for n, f in enumerate(self.features):
                i = list(layout.features).index(f)
                raw = _open(_get(self.path, shard, int(at[1 + i]), int(at[2 + i] - at[1 + i])))
                valid = np.unpackbits(np.frombuffer(raw, np.uint8, -(-len(there) // 8)), count=len(there)).astype(bool)
                values = np.frombuffer(raw, KINDS[layout.kinds[i]], len(there), -(-len(there) // 8))
                columns.append(column(values[inside], ~valid[inside], layout.kinds[i], types[k + n]))
            yield pa.RecordBatch.from_arrays(columns, [*layout.dims, *self.features])


@dataclass
class Written(WriterCommitMessage):
    shard: str | None
    index: list


class ChunkWriter(DataSourceArrowWriter):
    """Writes whole chunks, which come one after another: a task's chunks are one shard, and the index of all is written at
    the commit. A failed or repeated task leaves a shard that nothing refers to."""

    def __init__(self, path: str, layout: dict):
        self.path, self.layout = path, layout

    def write(self, iterator) -> Written:
        k, features = len(self.layout["dims"]), self.layout["features"]
        body, index = bytearray(), []

        def chunk(held: list) -> None:
            import pyarrow as pa

            table = pa.Table.from_batches(held)
            number = [int(table.column(d)[0].as_py()) for d in range(k)]
            shape = [min(d["chunk"], d["size"] - n * d["chunk"]) for d, n in zip(self.layout["dims"], number, strict=True)]
            place = np.ravel_multi_index([np.asarray(table.column(k + d)) - n * self.layout["dims"][d]["chunk"] for d, n in enumerate(number)], shape)
            order = np.argsort(place, kind="stable")
            if len(order) > 1 and (np.diff(place[order]) == 0).any():
                raise ValueError("two rows for one cell")
            bits = np.zeros(math.prod(shape), bool)
            bits[place] = True
            row = [*number, 0, len(body)]
            body.extend(_press(np.packbits(bits).tobytes()))
            for n, f in enumerate(features):
                row.append(len(body))
                column = table.column(2 * k + n).combine_chunks()
                if f["kind"] in ("timestamp", "timestamp_ntz"):
                    column = column.cast(pa.int64())
                elif f["kind"] == "date":
                    column = column.cast(pa.int32())
                valid = np.asarray(column.is_valid())
                values = np.asarray(column.fill_null(False if f["kind"] == "boolean" else 0)).astype(KINDS[f["kind"]])
                body.extend(_press(np.packbits(valid[order]).tobytes() + values[order].tobytes()))
            index.append([*row, len(body)])

        held, now = [], None
        for batch in iterator:
            numbers = np.stack([np.asarray(batch.column(d)) for d in range(k)]) if batch.num_rows else np.zeros((k, 0))
            cuts = [0, *(np.flatnonzero((numbers[:, 1:] != numbers[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                if held and tuple(numbers[:, a]) != now:
                    chunk(held)
                    held = []
                now = tuple(numbers[:, a])
                held.append(batch.slice(a, b - a))
        if held:
            chunk(held)
        if not index:
            return Written(None, [])
        name = uuid.uuid4().hex
        _put(self.path, f"shards/{name}", bytes(body))
        return Written(name, index)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None and m.shard]
        k = len(self.layout["dims"])
        rows = []
        for n, m in enumerate(done):
            rows += [[*r[:k], n, *r[k + 1 :]] for r in m.index]
        rows.sort()
        if any(a[:k] == b[:k] for a, b in itertools.pairwise(rows)):
            raise ValueError("a chunk was written by two tasks")
        name = f"index-{uuid.uuid4().hex}"
        _put(self.path, name, _press(np.array(rows, "<i8").tobytes()))
        _put(self.path, "array.json", json.dumps({**self.layout, "shards": [m.shard for m in done], "index": name}).encode())

    def abort(self, messages) -> None:
        fs, base = files_at(self.path)
        for m in messages:
            if m is not None and m.shard:
                fs.delete_file(f"{base}/shards/{m.shard}")


class ChunkSource(DataSource):
    """Options: path; features (comma-separated, all if absent); for writing, layout (see ``save``)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _features(self, layout: Layout) -> list[str]:
        wanted = self.options.get("features")
        return list(layout.features) if wanted is None else [f for f in wanted.split(",") if f]

    def schema(self):
        layout = Layout.read(self.options["path"])
        return layout.schema(self._features(layout))

    def reader(self, schema):
        layout = Layout.read(self.options["path"])
        return ChunkReader(self.options["path"], self._features(layout), layout)

    def writer(self, schema, overwrite):
        return ChunkWriter(self.options["path"], json.loads(self.options["layout"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def save(source: Source, path: str, chunks: Mapping[str, int]) -> None:
    """Writes the cells of a source as a chunked array, ``chunks`` steps of each dim in a chunk (all where it names none).

    An array that is there is replaced in one step, when all chunks are written. Of features null and NaN are kept apart;
    they must be numbers, booleans, dates or times. Two cells with the same coordinates are an error. The coordinates of each
    dim pass through the driver and are held by readers, as in any array store: dims have some 10^8 steps at most. Cells do
    not; a chunk is written by one task and has MOST_CELLS places at most.
    """
    spark = source.frame.sparkSession
    dims = source.dim_names
    cells = source.table()
    fields = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    if odd := [f for f in [*dims, *source.feature_names] if fields[f] not in KINDS]:
        raise ValueError(f"no array holds {odd}")
    layout: dict = {"format": 1, "dims": [], "features": [{"name": f, "kind": fields[f]} for f in source.feature_names]}
    placed = cells
    for n, d in enumerate(dims):
        axis = source.axis(d)
        size = source.axis_size(d)
        step = min(max(1, size), chunks.get(d) or max(1, size))
        kind = fields[d]
        as_number = {"timestamp": F.unix_micros(F.col(d)), "timestamp_ntz": F.expr(f"unix_micros(`{d}`::timestamp)"), "date": F.unix_date(F.col(d))}.get(kind, F.col(d))
        if kind == "timestamp_ntz":
            as_number = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(d))
        # one dim's coordinates, as in any array store
        values = np.array([r[0] for r in axis.orderBy("idx").select(as_number).toLocalIterator()], KINDS[kind])
        name = f"dims/{d}-{uuid.uuid4().hex}"
        _put(path, name, _press(values.tobytes()))
        layout["dims"].append({"name": d, "kind": kind, "size": size, "chunk": step, "file": name})
        placed = placed.join(axis.select(d, F.col("idx").alias(f"__i{n}")), d).withColumn(f"__c{n}", F.floor(F.col(f"__i{n}") / step).cast("long"))
    if math.prod(d["chunk"] for d in layout["dims"]) > MOST_CELLS:
        raise ValueError(f"a chunk holds more than {MOST_CELLS} cells")
    numbers = [f"__c{n}" for n in range(len(dims))]
    rows = placed.select(*numbers, *[f"__i{n}" for n in range(len(dims))], *source.feature_names)
    register(spark)
    rows.repartition(*numbers).sortWithinPartitions(*numbers).write.format(FORMAT).mode("overwrite").option("path", path).option("layout", json.dumps(layout)).save()


def load(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> DataFrame:
    """The cells of a chunked array; comparisons of dims with literals open only the chunks they meet, and of a chunk only
    the features asked for are read."""
    register(spark)
    reader = spark.read.format(FORMAT).option("path", path)
    return (reader if features is None else reader.option("features", ",".join(features))).load()


def open_chunks(spark: SparkSession, path: str, name: str, features: Sequence[str] | None = None, **options) -> Source:
    """A source over a chunked array, with the array's dims."""
    return Source(name, load(spark, path, features), Layout.read(path).dims, **options)
