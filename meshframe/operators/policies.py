"""What a batch is drawn from: policies of validity and dropped sources in turn, bins by need, tasks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from contextlib import ExitStack
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.grid import Source
from .batching import numbered, shuffle_key
from .stats import sparsity
from .validity import centers


@dataclass(frozen=True)
class Policy:
    """Shares of valid cells by dim, and the labels of sources that are left out."""

    percents: Mapping | None = None
    drop: tuple[str, ...] = ()


def rotation(percents: Sequence[Mapping] = (), drops: Sequence[Sequence[str]] = ()) -> list[Policy]:
    """The policies in turn: lists of one length go together, a list of one or none goes with all."""
    n = max(len(percents), len(drops), 1)
    if len(percents) not in (0, 1, n) or len(drops) not in (0, 1, n):
        raise ValueError("percents and drops must be as many, or one for all")
    pick = [percents[i % len(percents)] if percents else None for i in range(n)]
    left = [tuple(drops[i % len(drops)]) if drops else () for i in range(n)]
    return [Policy(p, d) for p, d in zip(pick, left, strict=True)]


def centers_in_turn(source: Source, dim: str, block: int, policies: Sequence[Policy]) -> DataFrame:
    """(config, cells): centres of blocks of ``block`` steps of a dim, each block under the policy whose turn it is.

    Policies that drop the source give none. One plan holds all policies; the source is read once.
    """
    parts = []
    for k, p in enumerate(policies):
        if source.name in p.drop:
            continue
        own = centers(source, percents=with_percents(source, p.percents) if p.percents is not None else None)
        parts.append(own.where(F.pmod(F.floor(F.col(f"i_{dim}") / block), F.lit(len(policies))) == k).select(F.lit(k).alias("config"), "*"))
    if not parts:
        raise ValueError("every policy drops the source")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_percents(source: Source, percents: Mapping) -> dict:
    """A rule in place of the source's own: dims with a window that it does not name must be wholly valid."""
    named = {d for k in percents for d in ((k,) if isinstance(k, str) else k)}
    unknown = named - set(source.dim_names)
    if unknown:
        raise ValueError(f"{source.name} has no dims {sorted(unknown)}")
    rest = [d for d in source.dim_names if d not in named and source.window.get(d, 0) != 0]
    return {**percents, **dict.fromkeys(rest, 1.0)}


def required_under(sources: Sequence[Source], policies: Sequence[Policy]) -> list[Source]:
    """Sources that any policy drops, or asks nothing of, are optional in all."""

    def free(s: Source, p: Policy) -> bool:
        return s.name in p.drop or bool(p.percents) and any(v == 0 for v in p.percents.values())

    return [replace(s, required=s.required and not any(free(s, p) for p in policies)) for s in sources]


def bin_weights(bins: DataFrame, batches: int, beta: float = 1.0, gamma: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """``bins`` (bin, drawn, share) with weight: the chance of each to be drawn next.

    drawn: how often it was, of at most ``batches``; share: of the blocks that can give it. Bins behind the even share
    gain by exp(beta * deficit), bins that few blocks have by share ** -gamma; bins without blocks weigh 0.
    """
    live = F.col("share") > 0
    mean = bins.agg((F.sum(F.col("drawn") / batches) / F.sum(live.cast("int"))).alias("__mean"))
    raw = F.when(live, F.exp(beta * (F.col("__mean") - F.col("drawn") / batches)) / F.pow(F.col("share") + eps, F.lit(gamma))).otherwise(F.lit(0.0))
    scored = bins.join(F.broadcast(mean)).withColumn("__raw", raw)  # one row
    total = scored.agg(F.sum("__raw").alias("__all"))
    return scored.join(F.broadcast(total)).select(*bins.columns, (F.col("__raw") / F.col("__all")).alias("weight"))


def tasks(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """``df`` with task: groups of at most ``rows`` rows in random order, numbered without a task that holds all."""
    out = numbered(df, [shuffle_key(key, seed), F.col(key)], "__row")
    return out.withColumn("task", F.floor(F.col("__row") / rows).cast("long")).drop("__row")


def sparsest_first(sources: Sequence[Source]) -> list[Source]:
    """Sources with the greatest share of missing values first: what they lack need not be sought in others."""
    share = {id(s): sparsity(s).first()[0] or 0.0 for s in sources}
    return sorted(sources, key=lambda s: -share[id(s)])


def arranged(items: Sequence, key: Callable, reverse: bool = False) -> tuple[list, list[int]]:
    """(items in stable order of ``key``, where each came from); ``restored`` undoes it."""
    at = sorted(range(len(items)), key=lambda i: key(items[i]), reverse=reverse)
    return [items[i] for i in at], at


def restored(items: Sequence, at: Sequence[int]) -> list:
    out = [None] * len(items)
    for x, i in zip(items, at, strict=True):
        out[i] = x
    return out


def is_sorted(df: DataFrame, position: str, columns: Sequence[str], strict: bool = False) -> bool:
    """Whether rows, by their gapless position, ascend in the columns; strictly if no two may be equal.

    Each row meets the next by an equi-join on the position.
    """
    after = df.select((F.col(position) - 1).alias(position), F.struct(*columns).alias("__next"))
    both = df.select(position, F.struct(*columns).alias("__own")).join(after, position)
    wrong = F.col("__own") >= F.col("__next") if strict else F.col("__own") > F.col("__next")
    return not both.where(wrong).limit(1).count()


def ordered(df: DataFrame, keys: Sequence[str], seed: int | None = None) -> DataFrame:
    """Matches in the order of their keys, source by source, or with ``seed`` in a random one that reruns repeat."""
    if seed is None:
        return df.orderBy(*keys)
    said = F.to_json(F.struct(*keys))
    return df.orderBy(F.md5(F.concat(said, F.lit(f"_{seed}"))), *keys)


def merged_chunks(counts: Sequence[Sequence[int]], least: Sequence[int]) -> list[list[int]]:
    """Bins of several vectors, those too small for any vector joined to a neighbour: to the right, then to the left.

    counts: for each vector its elements in each bin; least: the fewest that a bin of each may have.
    """
    bins = [list(b) for b in zip(*counts, strict=True)]
    for _ in range(2):
        joined: list[list[int]] = []
        waiting: list[int] | None = None
        for b in bins:
            waiting = b if waiting is None else [x + y for x, y in zip(waiting, b, strict=True)]
            if all(x >= n for x, n in zip(waiting, least, strict=True)):
                joined.append(waiting)
                waiting = None
        if waiting is not None:
            joined.append(waiting)
        bins = joined[::-1]
    return [list(v) for v in zip(*bins, strict=True)]


def prepared(batches, step):
    """Batches through ``step``: a function, or a factory of a context whose value is one, entered once for all."""
    with ExitStack() as stack:
        made = step if not getattr(step, "is_factory", False) else stack.enter_context(step())
        for b in batches:
            yield made(b)


def factory(make):
    """Marks a function as a factory of contexts for ``prepared``."""
    make.is_factory = True
    return make
