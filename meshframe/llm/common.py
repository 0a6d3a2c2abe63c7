"""Pieces shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import fresh_path, shared_dir, stash

__all__ = ["fresh_path", "shared_dir", "stash"]

#: Fixed value of the query contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_BYTES at most: long texts would fill a worker, and its executor's buffers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@lru_cache
def _trim() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc
        return None


def give_back() -> None:
    """Memory that this process has freed goes back to the system: allocators keep it, and workers live on between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], encodes: bool = False) -> Callable[[Iterator], Iterator]:
    """``run``, for mapInArrow, in workers that serve one operator after another.

    Unless it ``encodes``, the tables of an encoder that the worker still has go first; freed memory goes back at the end.
    """

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        if not encodes and (tokens := sys.modules.get(f"{__package__}.tokens")):
            tokens.encoder.cache_clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def cut(text: str | None, fold: bytes, chunk: int) -> Iterator[list[bytes]]:
    """The parts of a text between blanks after ``fold``, a table of bytes; some ``chunk`` bytes at a time, null has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) <= chunk:
        yield raw.translate(fold).split()
        return
    at = 0
    while at < len(raw):
        part = raw[at : at + chunk].translate(fold)
        at += len(part)
        held = [part]
        while at < len(raw) and held[-1][-1:] != b" ":  # to the end of the part
            more = raw[at : at + 65536].translate(fold)
            held.append(more[: more.find(b" ") + 1 or len(more)])
            at += len(held[-1])
        yield b"".join(held).split()


def width(spark: SparkSession) -> int:
    """Partitions for explicit exchanges: what the session gives its shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Most keys that are broadcast for having many rows, and rows that are few whatever the number of all rows.
HOT_KEYS, FEW_ROWS = 100_000, 256


def hot_rows(rows: int) -> int:
    """Rows of a key above which it is hot: at most HOT_KEYS of ``rows`` rows' keys can have so many."""
    return max(FEW_ROWS, rows // HOT_KEYS)


def join_one(rows: DataFrame, one: DataFrame, key: list[str], times: str, limit: int) -> DataFrame:
    """``rows`` joined with ``one``, which has each ``key`` once and in ``times`` how many of the rows have it.

    A key with more than ``limit`` rows (see ``hot_rows``) is broadcast, so its rows stay where they are; the others meet by
    key. A join with an aggregate on its own key is none that Spark splits at run time.
    """
    hot, rest = one.where(F.col(times) > limit).drop(times), one.where(F.col(times) <= limit).drop(times)
    spread = rows.join(F.broadcast(hot), key)  # HOT_KEYS rows at most
    return spread.unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key))


def gapless_rank(df: DataFrame, group: list[str], salt: Column, order: list[Column], out: str, slices: int = 64) -> DataFrame:
    """Number the rows of each group from 0 without gaps, without gathering a group in one task.

    ``salt`` deals the rows of a group over ``slices`` slices; slices are counted (map-side combined), their counts
    summed up to offsets, and rows numbered within (group, slice). Ties of ``order`` are numbered in any order.
    """
    cut = df.withColumn("__slice", F.pmod(salt, F.lit(slices)).cast("int"))
    keys = [*group, "__slice"]
    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = cut.withColumn("__local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    on = [local[k].eqNullSafe(bases[k]) for k in keys]
    joined = local.join(bases, on[0] if len(on) == 1 else _all(on), "left")
    kept = [local[c] for c in df.columns]
    return joined.select(*kept, (bases["__base"] + local["__local"]).cast("long").alias(out))


def _all(conditions: list[Column]) -> Column:
    held = conditions[0]
    for c in conditions[1:]:
        held = held & c
    return held


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has long columns a and b. Returns (node, component): the smallest node that is reachable, for every node of
    an edge. Each step is map-side combined and written to the shared folder; nothing but one count per step reaches the
    driver. Nodes without an edge are left to the caller.
    """
    now = stash(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one"),
        label,
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("times"))
        # Large star: every larger neighbour of u moves to the least of u and its neighbours.
        large = join_one(now.select(F.col("v").alias("c"), F.col("u").alias("x")), least.withColumnRenamed("u", "c"), ["c"], "times", hot_rows(2 * mark[0])).select(F.col("x").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one")
        large = stash(large, label)
        # Small star: u and its smaller neighbours all move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("times"))
        small = join_one(large, low, ["u"], "times", hot_rows(mark[0])).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        following = stash(small.groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one"), label)
        before, now, mark = mark, following, _mark(following)
        if mark == before:
            break
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).groupBy("node").agg(F.min("component").alias("component"))
    )


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    """Number and hash of a set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    # translate looks every character up; most texts need only their line ends replaced
    lines = F.replace(text, F.lit("\n"), F.lit(" "))
    flat = F.when(text.rlike(r"[\t\x0b\x0c\r]"), F.translate(lines, "\t\x0b\x0c\r", "    ")).otherwise(lines)
    return F.array_remove(F.split(F.coalesce(flat, F.lit("")), " "), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
