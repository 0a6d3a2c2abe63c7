"""Incremental work: extents that advance with new data, and streams that keep archives and running means."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.archive import Archive, cell_sums, means, placed
from ..sources.store import SharedPath


class Extents:
    """Extents of one dim for the next piece of work. The coordinates are an axis; positions move, never back.

    fixed: always the same. steps: k steps on, both ends belong to it, so neighbours share a coordinate; the last may be
    shorter, then nothing. diff: from the last position to the newest coordinate, nothing if there is no newer one. A
    dotted path or a function gives extents of its own.
    """

    def __init__(self, dim: str, strategy: str | Callable, steps: int = 1, extent: Sequence | None = None, position: int = 0):
        if isinstance(strategy, str) and strategy not in ("fixed", "steps", "diff"):
            module, _, name = strategy.rpartition(".")
            if not module:
                raise ValueError("strategy must be fixed, steps, diff or a dotted path")
            strategy = getattr(import_module(module), name)
        if strategy == "steps" and steps < 1:
            raise ValueError("steps must be 1 or more")
        self.dim, self.strategy, self.steps, self.extent, self.position = dim, strategy, steps, extent, position

    def next(self, axis: DataFrame) -> dict[str, tuple]:
        """{dim: (low, high)} or {} if there is nothing new; ``axis`` is (dim, idx)."""
        if callable(self.strategy):
            return self.strategy(self, axis)
        if self.strategy == "fixed":
            return {self.dim: tuple(self.extent)}
        last = axis.agg(F.max("idx")).first()[0]
        if last is None or self.position >= last:
            return {}
        to = last if self.strategy == "diff" else min(last, self.position + self.steps)
        low, high = (axis.where(F.col("idx") == i).first()[self.dim] for i in (self.position, to))
        self.position = to
        return {self.dim: (low, high)}

    def all(self, axis: DataFrame) -> Iterator[dict[str, tuple]]:
        """All extents that are there now; those of steps are found in one pass over the axis."""
        if self.strategy == "steps":
            last = axis.agg(F.max("idx")).first()[0]
            if last is None or self.position >= last:
                return
            here = (F.col("idx") >= self.position) & (((F.col("idx") - self.position) % self.steps == 0) | (F.col("idx") == last))
            ends = [r[0] for r in axis.where(here).orderBy("idx").select(self.dim).collect()]  # one for each step
            for low, high in itertools.pairwise(ends):
                self.position = min(last, self.position + self.steps)
                yield {self.dim: (low, high)}
            return
        while e := self.next(axis):
            yield e
            if self.strategy == "fixed":
                return


def running_mean(stream: DataFrame, keys: Sequence[str], value: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Mean of each key over all that has arrived (for output mode update or complete)."""
    if watermark:
        stream = stream.withWatermark(*watermark)
    return stream.groupBy(*keys).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def windowed(stream: DataFrame, time: str, width: str, late: str, keys: Sequence[str], value: str, slide: str | None = None) -> DataFrame:
    """Sums and counts of event-time windows; with a watermark, so that append mode can close them and state is bounded."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.sum(value).alias("total"), F.count(value).alias("n")).select(F.col("w.start").alias("start"), *keys, "total", "n")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that has this checkpoint folder: made when it first starts, kept in the folder."""
    kept = SharedPath(spark, checkpoint).join("archive-stream")
    kept.write_new(uuid.uuid4().hex)
    return kept.read_text()


def into_archive(stream: DataFrame, archive: Archive, checkpoint: str, every: int = 1):
    """Runs what is there now into the archive: micro-batches are staged and merged, ``every`` so many and at the end.

    A batch is a run under the stream's name and its number, and what is merged is marked with the last batch it holds,
    for each stream. So one that was merged or staged before a restart, with the archive opened to append, is not counted
    again, and streams with checkpoints of their own share an archive, at the same time or one after another.
    """
    if every < 1:
        raise ValueError("every must be 1 or more")
    name = stream_id(archive.spark, checkpoint)
    last = -1

    def merge(batch: DataFrame, epoch: int) -> None:
        nonlocal last
        if archive.mark(name) < epoch:
            archive.stage(batch, f"e{epoch}", name)
            last = epoch
            if (epoch + 1) % every == 0:
                archive.flush(epoch, name)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    staged = [int(f.rsplit("~e", 1)[1]) for f in archive.fragments(name)]
    archive.flush(max([last, *staged]), name)
    return query


def micro_batches(frames: Sequence[DataFrame], axes: Mapping[str, DataFrame], features: Sequence[str]) -> DataFrame:
    """Means on a grid of batches one after another, as sums and counts that are merged; equals one batch of all."""
    cells = [f"i_{d}" for d in axes]
    parts = [cell_sums(placed(f, axes), cells, features) for f in frames]
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    held = held.groupBy(*cells).agg(*[F.sum(c).alias(c) for f in features for c in (f"{f}__sum", f"{f}__count")])
    return means(held, cells, features)


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over the files of a folder, so many for each micro-batch: what waits is bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def epochs(plan: Callable[[int], DataFrame], repeat: bool = False) -> Iterator[DataFrame]:
    """A plan for each epoch, with the epoch's number as its seed."""
    for n in itertools.count() if repeat else range(1):
        yield plan(n)


def keyed_recurrence(stream: DataFrame, key: str, time: str, value: str, step: Callable[[float, float], float], initial: float, late: str, ttl: str | None = None) -> DataFrame:
    """(key, time, value, state) for each event of a stream: state = step(value, state before), by event time for each key.

    For output mode append. Events wait until the watermark, ``late`` behind the newest time, has passed them; then they
    are taken in the order of time (then value), so files may come in any order. An event that comes when its key has gone
    on past its time is dropped, as the watermark says; null keys are one key, events with null times are dropped. Keys
    without events for ``ttl`` of event time begin anew. State, with the events that wait, is kept by key in the stream's
    checkpoint, so a restart goes on.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    ends = pd_timedelta(ttl) if ttl else None

    def run(group: tuple, frames, state: GroupState):
        import pandas as pd

        waiting_t, waiting_v, now, last = (list(x) if isinstance(x, list | tuple) else x for x in state.get) if state.exists else ([], [], initial, None)
        for frame in frames:
            frame = frame[frame[time].notna()]
            waiting_t += frame[time].astype("datetime64[us]").astype("int64").tolist()
            waiting_v += frame[value].astype("float64").tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        events = sorted(zip(waiting_t, waiting_v, strict=True))
        ready = [e for e in events if e[0] < mark]
        events = [e for e in events if e[0] >= mark]
        out = []
        for t, v in ready:
            if last is not None and t < last:
                continue
            if ends is not None and last is not None and t - last > ends:
                now = initial
            now, last = step(v, now), t
            out.append((t, v, now))
        if not events and ends is not None and last is not None and mark - last > ends:
            state.remove()
        else:
            state.update(([t for t, _ in events], [v for _, v in events], now, last))
            wake = min((t for t, _ in events), default=None)
            if wake is None and ends is not None and last is not None:
                wake = last + ends
            if wake is not None:
                state.setTimeoutTimestamp(max(wake // 1000 + 1, mark // 1000 + 1))
        if out:
            t, v, s = zip(*out, strict=True)
            yield pd.DataFrame({key: [group[0]] * len(out), time: pd.to_datetime(list(t), unit="us"), value: v, "state": s})

    rows = stream.withWatermark(time, late).select(key, time, F.col(value).cast("double").alias(value))
    grouped = rows.groupBy(key)
    return grouped.applyInPandasWithState(run, f"`{key}` {fields[key]}, `{time}` {fields[time]}, `{value}` double, state double", "t array<long>, v array<double>, now double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def pd_timedelta(text: str) -> int:
    """Microseconds of a duration such as "2 hours"."""
    import pandas as pd

    return int(pd.Timedelta(text).total_seconds() * 1_000_000)
