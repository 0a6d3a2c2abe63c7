"""From sources to predictions on a grid: extents, matches, windows, a model, an archive, and what follows."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import matching, validity, windows
from ..operators.archive import Archive
from ..sources.grid import Source
from .graph import score


@dataclass
class GriddedRun:
    """A run of a model over the matched windows of sources.

    ``features`` are selectors of the samples, handed to the model as columns of their names. ``model()`` is made once in
    each task and called with pandas frames, which it returns with ``outputs`` (a schema). ``coordinates`` say which
    selector locates a prediction in each dim of the archive, and whether it is a time: times stand at the last step of
    their window, others at its centre. ``graph`` may stand for the model: a function of columns, which stays in the JVM.
    """

    sources: Sequence[Source]
    features: Sequence[str]
    coordinates: Mapping[str, tuple[str, bool]]
    outputs: str = ""
    model: Callable | None = None
    graph: Callable[[dict[str, Column]], dict[str, Column]] | None = None
    method: str = "multi"
    after: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)

    def within(self, extent: Mapping[str, tuple]) -> GriddedRun:
        """The run on a part of the sources, such as an incremental extent."""
        return replace(self, sources=[replace(s, extent={**s.extent, **{d: e for d, e in extent.items() if d in s.dims}}) for s in self.sources])

    def samples(self) -> DataFrame:
        centers = [validity.centers(s) for s in self.sources]
        matches = matching.match([matching.points(s, c) for s, c in zip(self.sources, centers, strict=True)], self.method)
        return windows.samples(self.sources, matches, centers)

    def predictions(self) -> DataFrame:
        """(coordinates..., outputs...): one row for each sample."""
        selector = windows.Selector.of(self.sources)
        places = [windows.representative(selector.column(c), time).alias(d) for d, (c, time) in self.coordinates.items()]
        df = self.samples().select(*places, *[selector.column(f).alias(f) for f in self.features])
        if self.graph:
            out = self.graph({f: F.col(f"`{f}`") for f in self.features})
            return df.select(*self.coordinates, *[self.after.get(k, lambda c: c)(v).alias(k) for k, v in out.items()])
        kept = ", ".join(f"{d} {df.schema[d].dataType.simpleString()}" for d in self.coordinates)
        got = score(df, self.model, f"{kept}, {self.outputs}")
        return got.select(*self.coordinates, *[self.after.get(c, lambda x: x)(F.col(c)).alias(c) for c in got.columns if c not in self.coordinates])

    def into(self, archive: Archive) -> None:
        """Predictions merged into the archive's cells in one generation."""
        archive.stage(self.predictions())
        archive.flush()


@dataclass(frozen=True)
class Outcome:
    """What came of a run; true if it went well, else with the error."""

    error: Exception | None = None

    def __bool__(self) -> bool:
        return self.error is None


def cast(run: GriddedRun, archive: Archive, extents: Sequence[Mapping[str, tuple]] = ({},), before: Callable | None = None, after: Callable | None = None, strict: bool = False) -> Outcome:
    """Runs all extents into the archive; hooks see the run and the archive.

    What fails is logged with its trace and kept in the outcome, so that a schedule may go on with other models;
    ``strict`` raises it.
    """
    try:
        if before:
            run = before(run) or run
        for e in extents:
            run.within(e).into(archive)
        if after:
            after(archive)
    except Exception as error:
        logging.getLogger(__name__).exception("the run failed")
        if strict:
            raise
        return Outcome(error)
    return Outcome()
