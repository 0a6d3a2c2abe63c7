"""Deterministic range shards of a long key: bounds come from exact sums over the data, never from a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the first cut of the key's range, and of each further cut of a cell.
CELL_BITS, SUB_BITS = 12, 6
#: Bytes a shard holds: a 1024th of all, within these bounds, or what gives MOST_SHARDS.
LEAST_BYTES, MOST_BYTES, MOST_SHARDS = 16 << 20, 128 << 20, 50_000


def shard_bytes(total: int) -> int:
    return max(LEAST_BYTES, min(MOST_BYTES, total // 1024), total // MOST_SHARDS)


def _literal(numbers: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def count_up_to(bounds: list[int], key: Column) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``: a binary search, so their number hardly matters."""
    if not bounds:
        return F.lit(0)
    at = _literal(bounds)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(at, n + step - 1) <= key, n + step).otherwise(n))


def range_shards(df: DataFrame, key: str, weight: Column, target: int | None = None) -> tuple[Column, int]:
    """The shard of a row (int, ascending with ``key``; nulls are in shard 0) as a Column, and the number of shards.

    Cells are keys without their last bits; weights are summed by cell map-side, and a cell above the target is cut again
    until it is below or holds one key. Cells go together until a shard would pass the target. The driver sees one sum
    for each cell; their number is bounded by that of the shards. Any two longs may be keys of one table.
    """
    narrow = df.select(F.col(key).cast("long").alias("k"), weight.cast("long").alias("w"))
    facts = narrow.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("w").alias("all")).first()
    if facts["lo"] is None:
        return F.lit(0), 1
    target = target or shard_bytes(facts["all"] or 0)
    shift = max(0, (facts["hi"] - facts["lo"]).bit_length() - CELL_BITS)
    live, cells = narrow.where("k is not null"), {}
    while True:
        rows = live.groupBy(F.shiftright("k", shift).alias("c")).agg(F.sum("w").alias("w")).collect()
        heavy = [r["c"] for r in rows if r["w"] > target and shift]
        again = set(heavy)
        cells |= {r["c"] << shift: r["w"] for r in rows if r["c"] not in again}
        if not heavy:
            break
        live = live.where(F.shiftright("k", shift).isin(heavy))
        shift = max(0, shift - SUB_BITS)
    bounds, held = [], 0
    for k in sorted(cells):
        if held and held + cells[k] > target:
            bounds.append(k)
            held = 0
        held += cells[k]
    return F.coalesce(count_up_to(bounds, F.col(key).cast("long")), F.lit(0)).cast("int"), len(bounds) + 1
