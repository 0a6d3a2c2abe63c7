"""Stored sources: sparse tables, blocks of arrays, caches of whole sets, samples, outlines, and paths in shared stores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import Source, cache, is_valid


@dataclass(frozen=True)
class SharedPath:
    """A path in any store that Spark reads (file, hdfs, s3a, ...), through its file systems."""

    spark: SparkSession
    uri: str

    def _file_system(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @property
    def name(self) -> str:
        return self.uri.rstrip("/").rsplit("/", 1)[-1]

    @property
    def stem(self) -> str:
        return self.name.rsplit(".", 1)[0] if "." in self.name[1:] else self.name

    @property
    def parent(self) -> SharedPath:
        return replace(self, uri=self.uri.rstrip("/").rsplit("/", 1)[0])

    def join(self, *parts: str) -> SharedPath:
        return replace(self, uri="/".join([self.uri.rstrip("/"), *[p.strip("/") for p in parts]]))

    def exists(self) -> bool:
        path, fs = self._file_system()
        return fs.exists(path)

    def delete(self) -> bool:
        """The file or the whole folder; False if there is none."""
        path, fs = self._file_system()
        return fs.delete(path, True)

    def names(self) -> list[str]:
        """The names in a folder, in order."""
        path, fs = self._file_system()
        return sorted(s.getPath().getName() for s in fs.listStatus(path))

    def read_text(self) -> str:
        path, fs = self._file_system()
        source = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def write_new(self, text: str) -> bool:
        """Writes a small file; False if there is one of this name."""
        path, fs = self._file_system()
        if fs.exists(path):
            return False
        try:
            out = fs.create(path, False)
        except Exception:
            if fs.exists(path):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def children(self) -> list[SharedPath]:
        path, fs = self._file_system()
        return [self.join(s.getPath().getName()) for s in fs.listStatus(path)]


def save_sparse(source: Source, path: str) -> None:
    """The cells with any valid feature; features that are not valid become null."""
    cells = source.cells()
    valid = {f: is_valid(F.col(f), source.invalid_value) for f in source.feature_names}
    some = F.lit(False)
    for v in valid.values():
        some = some | v
    kept = cells.where(some).withColumns({f: F.when(v, F.col(f)) for f, v in valid.items()})
    kept.write.mode("overwrite").parquet(path)


def open_sparse(spark: SparkSession, path: str, name: str, dims: Sequence[str], match_radius: Mapping[str, float | str], **options) -> Source:
    """A sparse source over such a table: what is not stored is missing."""
    return Source(name, spark.read.parquet(path), dims, match_radius=match_radius, sparse=True, **options)


def read_block(cells: DataFrame, ranges: Mapping[str, tuple[int, int]]) -> DataFrame:
    """The cells (with i_<dim>) of a block of steps, ends left out, with steps counted from its corner.

    Ranges stay comparisons of columns with literals, so they prune what is read.
    """
    for d, (low, high) in ranges.items():
        cells = cells.where((F.col(f"i_{d}") >= low) & (F.col(f"i_{d}") < high))
    return cells.withColumns({f"i_{d}": F.col(f"i_{d}") - low for d, (low, _) in ranges.items()})


def cache_all(sources: Sequence[Source], folder: str, overwrite: bool = False) -> list[Source]:
    """All sources of a set, each cached under its own configuration and opened from there."""
    return [cache(s, folder, overwrite) for s in sources]


def cache_blocks(cells: DataFrame, path: str, blocks: Mapping[str, int], halo: Mapping[str, tuple[int, int]]) -> DataFrame:
    """``cells`` (with i_<dim>) as a table with a folder for each block, its halo included: b_<dim> says which.

    A cell is written once for each block whose halo holds it; a block is read without its neighbours.
    """
    out = cells
    for d, size in blocks.items():
        before, after = halo.get(d, (0, 0))
        last = F.floor((F.col(f"i_{d}") + before) / size)
        first = F.greatest(F.lit(0), F.floor((F.col(f"i_{d}") - after) / size))
        out = out.withColumn(f"b_{d}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    names = [f"b_{d}" for d in blocks]
    out.repartition(*[F.col(n) for n in names]).write.mode("overwrite").partitionBy(*names).parquet(path)
    return cells.sparkSession.read.parquet(path)


def save_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").parquet(path)


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_outlines(spark: SparkSession, rings: Mapping[str, Sequence[Sequence[tuple[float, float]]]], path: str) -> None:
    """Regions as a table of their edges (name, ring, x0, y0, x1, y1)."""
    rows = [(name, n, *map(float, a), *map(float, b)) for name, parts in rings.items() for n, ring in enumerate(parts) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    spark.createDataFrame(rows, "name string, ring int, x0 double, y0 double, x1 double, y1 double").write.mode("overwrite").parquet(path)


def load_outlines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sources_of_models(models: Sequence, open_source: Callable[[str], tuple[DataFrame, Sequence[str]]], **options) -> list[Source]:
    """The sources that all models together need: their ``inputs``, like ones of several models once."""
    from ..plans.specs import IOSpec, sources_from

    merged: dict[tuple, IOSpec] = {}
    for m in models:
        for s in m.inputs:
            k = (s.source, tuple(sorted(s.window.items(), key=str)), s.labeled)
            old = merged.get(k)
            merged[k] = s if old is None else replace(old, features=[*old.features, *[f for f in s.features if f not in old.features]])
    return sources_from(list(merged.values()), open_source, **options)
