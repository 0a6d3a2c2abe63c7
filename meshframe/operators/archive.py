"""Archives on a grid: values go to the nearest cell; cells keep sums and counts, so that means grow with new data."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import SharedPath
from .matching import index_of


def placed(df: DataFrame, axes: Mapping[str, DataFrame], mode: str = "nearest", tol: Mapping[str, float] | None = None) -> DataFrame:
    """``df`` with the index i_<dim> of its cell on each axis (dim, idx)."""
    for d, axis in axes.items():
        df = index_of(df, d, axis, d, mode, (tol or {}).get(d), f"i_{d}")
    return df


def cell_sums(df: DataFrame, cells: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(cells..., f__sum, f__count): of the finite values of each feature."""
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)
        aggs += [F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{f}__sum"), F.count(x).alias(f"{f}__count")]
    return df.groupBy(*cells).agg(*aggs)


def merged(old: DataFrame, new: DataFrame, cells: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Sums and counts of both."""
    return old.unionByName(new).groupBy(*cells).agg(*[F.sum(c).alias(c) for f in features for c in (f"{f}__sum", f"{f}__count")])


def means(sums: DataFrame, cells: Sequence[str], features: Sequence[str], keep_sums: bool = False) -> DataFrame:
    """The mean of each cell; null where no finite value came."""
    own = [F.try_divide(F.col(f"{f}__sum"), F.col(f"{f}__count")).alias(f) for f in features]
    return sums.select(*cells, *own, *([c for c in sums.columns if "__" in c] if keep_sums else []))


#: Ranges of cells that a run's files are apart by, and runs of like size in one range that are merged.
ZONES, FAN = 32, 4


class Archive:
    """A log of runs: tables of sums and counts by cell that are never changed, and versions that say which of them count.

    ``stage`` places values on the grid and writes them as a run that does not count yet; ``flush`` writes the next
    version, in which what was staged counts: no cell that was there is written again. Runs lie in zones, ranges of the
    first dim's cells; where FAN runs of like size meet in a zone, they are merged into one (``compact``), so a cell is
    written again only as often as its zone grows FAN-fold. Readers add up the runs of the newest version; the last ``keep``
    versions and their runs stay, for readers that began before. ``existing`` says what to do with an archive that is there:
    "error", "append" (its versions and the runs staged stay) or "overwrite".

    Several writers may share an archive: a version is a file that is created only if it is not there, and whoever comes
    second reads the newest and tries again. Each writer names its ``stream``; names of staged runs, and marks that say
    what was merged, are kept by stream.
    """

    def __init__(self, spark: SparkSession, path: str, axes: Mapping[str, DataFrame], features: Sequence[str], overwrite: bool = False, mode: str = "nearest", tol: Mapping[str, float] | None = None, existing: str = "error", keep: int = 3):
        if existing not in ("error", "append", "overwrite"):
            raise ValueError("existing must be error, append or overwrite")
        self.spark, self.path, self.axes, self.features, self.mode, self.tol = spark, path.rstrip("/"), axes, list(features), mode, tol
        self.cells, self.keep = [f"i_{d}" for d in axes], max(2, keep)
        self._home = SharedPath(spark, self.path)
        if self._home.exists():
            if overwrite or existing == "overwrite":
                self._home.delete()
            elif existing == "error":
                raise FileExistsError(path)
        now = self._version()
        if now["number"] >= 0 and [now["cells"], now["features"]] != [self.cells, sorted(self.features)]:
            raise ValueError("the archive has other dims or features")
        self.zone_cells = now.get("zone_cells") or max(1, -(-self._length() // ZONES))

    def _length(self) -> int:
        """Cells of the first dim."""
        axis = next(iter(self.axes.values()))
        return (axis.agg(F.max("idx")).first()[0] or 0) + 1

    # versions

    def _numbers(self) -> list[int]:
        log = self._home.join("log")
        return sorted(int(n[1:]) for n in (log.names() if log.exists() else []) if n[:1] == "v" and n[1:].isdigit())

    def _version(self, number: int | None = None) -> dict:
        """The newest version, or that of a number; one that its writer has not filled does not count."""
        for n in [number] if number is not None else reversed(self._numbers()):
            said = self._home.join("log", f"v{n}").read_text()
            if said.endswith("\n"):
                return json.loads(said)
        return {"number": -1, "runs": {}, "gone": {}, "marks": {}}

    def _commit(self, change: Callable[[dict], dict | None]) -> dict | None:
        """Writes the next version, what ``change`` makes of the newest; again if another writer was faster. None changes nothing."""
        while True:
            number = max([-1, *self._numbers()]) + 1  # before the newest is read: one that comes in between takes this number
            new = change(self._version())
            if new is None:
                return None
            new |= {"number": number, "cells": self.cells, "features": sorted(self.features), "zone_cells": self.zone_cells}
            if self._home.join("log", f"v{number}").write_new(json.dumps(new) + "\n"):
                return new

    def generation(self) -> int:
        """The number of the newest version, or -1."""
        return self._version()["number"]

    def mark(self, stream: str | None = None) -> int:
        """The greatest mark that a stream, or any, gave to its flushes so far, or -1: what it has merged."""
        marks = self._version()["marks"]
        return max(marks.values(), default=-1) if stream is None else marks.get(stream, -1)

    # runs

    def _run(self, name: str) -> SharedPath:
        return self._home.join("runs", name)

    def fragments(self, stream: str = "") -> list[str]:
        """The runs that a stream has staged whole and that do not count yet."""
        if not self._home.join("runs").exists():
            return []
        now = self._version()
        names = self._home.join("runs").names()
        mine = [n for n in names if n.startswith(f"{stream or 'own'}~") and n not in now["runs"] and n not in now["gone"]]
        return [self._run(n).uri for n in sorted(mine) if self._run(n).join("_SUCCESS").exists()]

    def _write(self, sums: DataFrame, name: str) -> None:
        """A run: its zones are folders, in them cells are in order, and a zone of many rows is several files."""
        zoned = sums.withColumn("zone", F.floor(F.col(self.cells[0]) / self.zone_cells).cast("int"))
        zoned.hint("rebalance", "zone").sortWithinPartitions("zone", *self.cells).write.mode("overwrite").partitionBy("zone").parquet(self._run(name).uri)

    def _rows(self, name: str) -> dict[str, int]:
        """Rows of a run by zone, and so at most as many numbers as the archive has zones."""
        zones = [n for n in self._run(name).names() if n.startswith("zone=")]
        if not zones:
            return {}
        rows = self.spark.read.parquet(self._run(name).uri).groupBy("zone").agg(F.count(F.lit(1)).alias("n")).collect()
        return {str(r["zone"]): r["n"] for r in rows}

    def stage(self, df: DataFrame, name: str | None = None, stream: str = "") -> None:
        """Writes the sums of ``df`` as a run that does not count yet; one of the same name that still waits is replaced, so a
        batch may come again."""
        name = f"{stream or 'own'}~{name or 'f' + uuid.uuid4().hex}"
        now = self._version()
        if name in now["runs"] or name in now["gone"]:
            name += "~" + uuid.uuid4().hex[:8]  # a name of one that counts already
        self._write(cell_sums(placed(df, self.axes, self.mode, self.tol), self.cells, self.features), name)

    def flush(self, mark: int | None = None, stream: str = "") -> None:
        """What the stream has staged counts from now on; ``mark`` is kept with it. Then zones with many runs are compacted."""
        staged = [f.rsplit("/", 1)[1] for f in self.fragments(stream)]
        if not staged:
            return
        rows = {n: self._rows(n) for n in staged}

        def add(now: dict) -> dict:
            now["runs"] |= {n: z for n, z in rows.items() if n not in now["gone"]}
            if mark is not None:
                now["marks"][stream] = max(mark, now["marks"].get(stream, -1))
            return now

        self._commit(add)
        self.compact()
        self._tidy()

    def compact(self) -> None:
        """Merges, in each zone, FAN or more runs of like size (the power of FAN of their rows) into one run."""
        runs = self._version()["runs"]
        tiers: dict[tuple[str, int], list[str]] = {}
        for n, zones in runs.items():
            for z, rows in zones.items():
                tiers.setdefault((z, int(math.log(max(rows, 1), FAN))), []).append(n)
        chosen = {(z, n) for (z, _), names in tiers.items() if len(names) >= FAN for n in names}
        if not chosen:
            return
        name = f"merged~{uuid.uuid4().hex}"
        self._write(self._summed(sorted(self._run(n).join(f"zone={z}").uri for z, n in chosen)), name)
        rows = self._rows(name)

        def replace(now: dict) -> dict | None:
            if any(z not in now["runs"].get(n, {}) for z, n in chosen):
                return None  # another writer merged some of them
            for z, n in chosen:
                del now["runs"][n][z]
            empty = [n for n, zones in now["runs"].items() if not zones]
            for n in empty:
                del now["runs"][n]
                now["gone"][n] = now["number"] + 1
            now["runs"][name] = rows
            return now

        if self._commit(replace) is None:
            self._run(name).delete()

    def _tidy(self) -> None:
        """Removes versions before the last ``keep``, and runs that none of these reads. Names stay known: a stage may come late."""
        numbers = self._numbers()
        now = self._version()
        oldest = numbers[-self.keep] if len(numbers) > self.keep else -1
        for n in numbers[: -self.keep]:
            self._home.join("log", f"v{n}").delete()
        for n, last in now["gone"].items():
            if last <= oldest and self._run(n).exists():
                self._run(n).delete()

    def _summed(self, paths: Sequence[str]) -> DataFrame:
        """The sums and counts of all cells in some runs' zones: merged as they are read."""
        kinds = ", ".join([*[f"{c} long" for c in self.cells], *[f"{f}__sum double, {f}__count long" for f in self.features]])
        if not paths:
            return self.spark.createDataFrame([], kinds)
        rows = self.spark.read.schema(kinds).parquet(*paths)
        return rows.groupBy(*self.cells).agg(*[F.sum(c).alias(c) for f in self.features for c in (f"{f}__sum", f"{f}__count")])

    def sums(self, first: tuple[int, int] | None = None, version: int | None = None) -> DataFrame:
        """Sums and counts by cell, of the newest version or that of a number. With ``first``, a range of cells of the first
        dim (both ends belong to it): only the zones that it meets are opened."""
        runs = self._version(version)["runs"]
        wanted = [(n, z) for n, zones in runs.items() for z in zones if first is None or first[0] // self.zone_cells <= int(z) <= first[1] // self.zone_cells]
        out = self._summed([self._run(n).join(f"zone={z}").uri for n, z in wanted])
        return out if first is None else out.where(F.col(self.cells[0]).between(*first))

    def read(self, first: tuple[int, int] | None = None) -> DataFrame:
        """Means with the cells' coordinates."""
        out = means(self.sums(first), self.cells, self.features)
        for d, axis in self.axes.items():
            out = out.join(axis.select(F.col("idx").alias(f"i_{d}"), d), f"i_{d}")
        return out.select(*self.axes, *self.features)
