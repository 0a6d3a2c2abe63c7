"""Batches as files that several readers share: each rank opens its own files, and goes on at a position.

A file holds consecutive batches, each a row group of Parquet, so a batch is found by its number in the file; a manifest says
which batches each file has. Files are dealt to ranks in turn. Readers are plain processes: they need pyarrow, not Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.chunks import files_at

MANIFEST = "_manifest"


def write_batches(batched: DataFrame, path: str, per_file: int = 64) -> DataFrame:
    """Writes rows with row and batch (see ``batching.batches``) as files of ``per_file`` batches; the manifest (file,
    number, first, batches, rows) is written last and says what counts.

    Each file is written by one task under a temporary name; one that runs again writes the same rows under a name of its
    own, and the manifest has the one that was committed. Rows of a batch are in the order of ``row``.
    """
    if per_file < 1:
        raise ValueError("per_file must be 1 or more")
    spark = batched.sparkSession
    names = [c for c in batched.columns]
    at = names.index("batch")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, base = files_at(path)
        fs.create_dir(base, recursive=True)
        told: list[tuple] = []
        writer = stream = None
        number = first = rows = groups = 0
        draft = ""

        def close() -> None:
            nonlocal writer
            if writer is not None:
                writer.close()
                stream.close()
                name = f"batches-{number:08d}-{uuid.uuid4().hex[:12]}.parquet"
                fs.move(draft, f"{base}/{name}")
                told.append((name, number, first, groups, rows))
                writer = None

        held: list = []
        now = None

        def put() -> None:
            nonlocal writer, stream, number, first, rows, groups, draft, held
            if not held:
                return
            if writer is None or now // per_file != number:
                close()
                number, first, rows, groups = now // per_file, now, 0, 0
                draft = f"{base}/.{uuid.uuid4().hex}.tmp"
                stream = fs.open_output_stream(draft, compression=None)
                writer = pq.ParquetWriter(stream, held[0].schema)
            table = pa.Table.from_batches(held)
            writer.write_table(table, row_group_size=max(1, table.num_rows))
            rows, groups, held = rows + table.num_rows, groups + 1, []

        for batch in batches:
            numbers = batch.column(at).to_numpy()
            cuts = [0, *((numbers[1:] != numbers[:-1]).nonzero()[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and numbers[a] != now:
                    put()
                now = int(numbers[a])
                held.append(batch.slice(a, b - a))
        put()
        close()
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*told, strict=True)], ["file", "number", "first", "batches", "rows"])

    schema = "file string, number long, first long, batches long, rows long"
    dealt = batched.repartition(F.floor(F.col("batch") / per_file)).sortWithinPartitions("batch", "row")
    dealt.mapInArrow(write, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return spark.read.schema(schema).parquet(f"{path}/{MANIFEST}")


@dataclass
class BatchReader:
    """The batches of one of ``world`` ranks, from ``position``: how many of them it has seen (in this epoch).

    Iterating gives (position after the batch, batch number, pyarrow table). A reader that ended anywhere goes on with the
    last position it was given; ranks together see each batch once an epoch.
    """

    path: str
    rank: int = 0
    world: int = 1
    position: int = 0

    def __post_init__(self):
        if not 0 <= self.rank < self.world:
            raise ValueError("rank must be from 0 to world - 1")

    def files(self) -> list[tuple[str, int, int]]:
        """(file, first batch, batches) of this rank, in order."""
        import pyarrow.parquet as pq
        from pyarrow import fs as pfs

        fs, base = files_at(self.path)
        parts = [f.path for f in fs.get_file_info(pfs.FileSelector(f"{base}/{MANIFEST}")) if f.path.endswith(".parquet")]
        rows = []
        for p in parts:
            with fs.open_input_file(p) as f:
                rows += [(r["number"], r["file"], r["first"], r["batches"]) for r in pq.read_table(f).to_pylist()]
        rows.sort()
        return [(f, first, n) for i, (_, f, first, n) in enumerate(rows) if i % self.world == self.rank]

    def __len__(self) -> int:
        return sum(n for _, _, n in self.files())

    def __iter__(self) -> Iterator[tuple[int, int, object]]:
        import pyarrow.parquet as pq

        fs, base = files_at(self.path)
        seen = 0
        for name, first, n in self.files():
            if seen + n <= self.position:  # a file that was read before is not opened
                seen += n
                continue
            with fs.open_input_file(f"{base}/{name}") as f:
                parts = pq.ParquetFile(f)
                for i in range(max(0, self.position - seen), n):
                    table = parts.read_row_group(i)
                    self.position = seen + i + 1
                    yield self.position, first + i, table
            seen += n


def read_ranks(spark: SparkSession, path: str, world: int, schema: str) -> DataFrame:
    """(rank, then the rows' columns as in ``schema``) as ``world`` ranks read them, each in a task of its own."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for rank in batch.column(0).to_pylist():
                for _, _, table in BatchReader(path, rank, world):
                    for part in table.to_batches():
                        yield pa.RecordBatch.from_arrays([pa.array([rank] * part.num_rows, pa.int64()), *part.columns], ["rank", *part.schema.names])

    return spark.range(world).repartitionById(world, F.col("id").cast("int")).mapInArrow(run, f"rank long, {schema}")
