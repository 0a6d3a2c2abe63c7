"""Blocks with halos: each block of a dim gets the steps beside it under a rule for the ends of the array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDARIES = ("none", "periodic", "nearest", "reflect", "constant")


def boundary_index(i: Column, n: int, boundary: str) -> Column:
    """The step that stands at position i of an array of n; null where nothing does ("none") or a constant ("constant").

    Reflection repeats the edge and may bounce more than once."""
    if boundary == "periodic":
        return F.pmod(i, F.lit(n))
    if boundary == "nearest":
        return F.greatest(F.lit(0), F.least(i, F.lit(n - 1)))
    if boundary == "reflect":
        around = F.pmod(i, F.lit(2 * n))
        return F.when(around < n, around).otherwise(2 * n - 1 - around)
    if boundary in ("none", "constant"):
        return F.when((i >= 0) & (i < n), i)
    raise ValueError(f"boundary must be one of {BOUNDARIES}")


def overlap(df: DataFrame, index: str, value: str, n: int, block: int, before: int, after: int, boundary: str = "none", constant: float | None = None) -> DataFrame:
    """(block, position, value): every block of ``block`` steps with its halo; position counts from the block's first step."""
    out = overlap_nd(df, [index], value, [n], [block], [(before, after)], [boundary], constant)
    return out.withColumnsRenamed({"block_0": "block", "position_0": "position"})


def overlap_nd(df: DataFrame, indexes: Sequence[str], value: str, sizes: Sequence[int], blocks: Sequence[int], depths: Sequence[tuple[int, int]], boundaries: Sequence[str], constant: float | None = None, sparse: bool = False) -> DataFrame:
    """(block_0, ..., position_0, ..., value): every block of an array with its halo along all dims, corners too.

    For each dim: the array's size, the block's, steps before and after, and what stands beyond the array's ends. Each
    position is found per dim and joined to its cell by an equi-join on the steps; what is outside in a dim with
    "constant" is the constant, and in one with "none" is left out. Of a sparse array only stored cells come.
    """
    spark, out = df.sparkSession, None
    dims = range(len(indexes))
    for d, (n, block, (before, after), boundary) in enumerate(zip(sizes, blocks, depths, boundaries, strict=True)):
        spans = spark.range(-(-n // block)).select(F.col("id").cast("int").alias(f"block_{d}"))
        first = F.col(f"block_{d}") * block
        spans = spans.withColumn(f"position_{d}", F.explode(F.sequence(F.lit(-before), F.least(F.lit(block), F.lit(n) - first) - 1 + after)))
        i = first + F.col(f"position_{d}")
        outside = (i < 0) | (i >= n)
        spans = spans.withColumns({f"__at{d}": boundary_index(i, n, boundary), f"__const{d}": outside & F.lit(boundary == "constant")})
        if boundary == "none":
            spans = spans.where(~outside)
        # the positions of all blocks are the result's rows, so this product is no larger than the result
        out = spans if out is None else out.crossJoin(spans)
    out = out.join(df.select(*[F.col(c).alias(f"__at{d}") for d, c in enumerate(indexes)], F.col(value).alias("__v")), [f"__at{d}" for d in dims], "inner" if sparse else "left")
    filled = F.col("__v")
    for d in dims:
        filled = F.when(F.col(f"__const{d}"), F.lit(constant)).otherwise(filled)
    return out.select(*[f"block_{d}" for d in dims], *[f"position_{d}" for d in dims], filled.alias(value))
