"""Packing by minimum bin slack: a bitset subset-sum fills each sequence as closely as the pieces left allow."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, gapless_rank, stash, tidy
from .tokens import encoder, tokenizer_path

CAPACITY = 2048
#: Pieces of one length that a task numbers, on average at most.
SLICE_ROWS = 100_000


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum comes closest to ``room`` from below.

    Lengths enter in decreasing order in bundles of 1, 2, 4, ... copies, so bit s of the reachable set says that s can be
    filled; the sets before each bundle are kept to walk back to the counts. Longer pieces are used up first.
    """
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left:
            take = min(bundle, left)
            after = (reach | (reach << (take * length))) & mask
            if after != reach:
                trail.append((length, take, reach))
                reach = after
            left -= take
            bundle *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, pattern) until ``counts`` is used up: the longest piece left, and the best filling of the rest of its bin.

    A pattern is repeated while its counts last, so the plan follows the number of distinct lengths (below the capacity),
    not the number of pieces.
    """
    left = {k: v for k, v in counts.items() if v}
    out = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = fill(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[x] // n for x, n in pattern.items())
        out.append((times, pattern))
        for x, n in pattern.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def pieces(df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids cut at multiples of the capacity: (key, start, length, ids_crc32, doc_tokens).

    Equal texts that come one after another, as the copies of a mix do, are encoded once.
    """
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(path).encode
        for batch in batches:
            keys, rows = [], []
            every, texts = iter(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            for (_, copies), ids in zip(groupby(texts), encode([t for t, _ in groupby(texts)]), strict=True):
                own = []
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    own.append((start, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids)))
                for _ in copies:
                    keys += [next(every)] * len(own)
                    rows += own
            numbers = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *(pa.array(numbers[:, i]) for i in range(4))], ["key", "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(F.col(key).alias("key"), F.col(text)).mapInArrow(tidy(cut, encodes=True), f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Spans of all documents in sequences: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Documents longer than a sequence give full pieces and a rest. The driver sees how many pieces have each length (at
    most ``capacity`` numbers) and plans the patterns; each piece then finds its sequence by its rank among the pieces
    of its length, which is numbered in slices so that a common length is no single task. Null keys are kept, repeated
    rows packed each, null and empty texts are one end id. An empty table gives no spans; further columns are ignored. A text
    of any length is one row in memory with its ids, and is cut as it comes.
    """
    bounded_batches(df.sparkSession)
    cut = stash(pieces(df, key, text, path or tokenizer_path(), capacity), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = plan(counts, capacity)
    # for each length: ranks from which a pattern holds, its pieces a sequence, first sequence, offset, ranks before
    segments: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            segments.setdefault(length, []).append((used.get(length, 0), pattern[length], sequence, offset))
            used[length] = used.get(length, 0) + pattern[length] * times
            offset += length * pattern[length]
        sequence += times
    tables = {x: np.array(rows, np.int64) for x, rows in segments.items()}
    slices = max(16, -(-max(counts.values(), default=0) // SLICE_ROWS))
    ranked = gapless_rank(cut, ["length"], F.xxhash64("key", "start", "ids_crc32"), [F.col("key"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")], "rank", slices)
    kind = cut.schema["key"].dataType.simpleString()

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lengths = np.asarray(batch.column(2))
            ranks = np.asarray(batch.column(5))
            sequences, offsets = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                table = tables[int(length)]
                row = table[np.searchsorted(table[:, 0], ranks[here], "right") - 1]
                since = ranks[here] - row[:, 0]
                sequences[here] = row[:, 2] + since // row[:, 1]
                offsets[here] = row[:, 3] + since % row[:, 1] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences), pa.array(offsets)], [*batch.schema.names[:5], "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.withColumnRenamed("key", key)


def op4_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
