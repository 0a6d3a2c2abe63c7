"""Shuffled, stratified and combined mini-batches of rows, numbered by plans rather than queues."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stash
from .validity import in_bins
from .windows import field_of


def shuffle_key(key: str, seed: int) -> Column:
    """A text that orders rows at random, the same in every engine that has md5."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"_{seed}")))


def numbered(df: DataFrame, order: Sequence[Column], out: str = "row") -> DataFrame:
    """Rows numbered from 0 in the order of ``order``, whose first column is text from ``shuffle_key``.

    The first three digits of the text deal rows into 4096 ordered slices; slices are counted and rows numbered inside, so that
    no task sorts all of them.
    """
    text = order[0]
    sliced = df.withColumn("__s", F.substring(text, 1, 3))
    counts = sliced.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy("__s").orderBy(*order)) - 1
    ranked = sliced.withColumn(out, local).join(bases, "__s")
    return ranked.withColumn(out, F.col("__base") + F.col(out)).select(*df.columns, out)


def in_order(df: DataFrame, keys: Sequence[str | Column], out: str = "row") -> DataFrame:
    """``df`` with its rows numbered from 0 in the order of ``keys``, which tell all rows apart.

    Rows are sorted by ranges of the keys; a row's number is its place in its range and the sizes of the ranges before, of
    which there are as many as partitions. The sorted rows are written once, as ranges that were drawn again might differ.
    """
    mine = F.monotonically_increasing_id()  # the partition above 33 bits, the place in it below
    rows = stash(df.orderBy(*keys).withColumn("__m", mine), "ordered")
    counts = rows.groupBy(F.shiftrightunsigned("__m", 33).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    placed = rows.withColumns({"__p": F.shiftrightunsigned("__m", 33), "__at": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}).join(F.broadcast(bases), "__p")
    return placed.select(*df.columns, (F.col("__base") + F.col("__at")).cast("long").alias(out))


def batches(df: DataFrame, key: str, batch_size: int, seed: int | None = 0, start: int = 0) -> DataFrame:
    """``df`` with row and batch; the last batch may be short. seed None keeps the order of the key."""
    if seed is None:
        out = in_order(df, [key])
    else:
        out = numbered(df, [shuffle_key(key, seed), F.col(key)])
    return out.withColumn("batch", (F.floor(F.col("row") / batch_size) + start).cast("long"))


def numbered_within(df: DataFrame, groups: Sequence[str], order: Column, ties: Sequence[str], out: str = "rank") -> DataFrame:
    """Rows of each group numbered from 0 by a positive number ``order``, then ``ties``; a large group is no single task.

    Rows are dealt by the logarithm of the number, which keeps their order, into slices; slices are counted and rows
    numbered inside.
    """
    sliced = df.withColumn("__o", order)
    sliced = sliced.withColumn("__s", F.floor(F.log2("__o") * 64).cast("int"))
    keys = [*groups, "__s"]
    counts = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = sliced.withColumn("__l", F.row_number().over(Window.partitionBy(*keys).orderBy("__o", *ties)) - 1)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return local.join(bases, same).select(*df.columns, (F.col("__base") + F.col("__l")).cast("long").alias(out))


def draw_key(key: str, seed: int, weight: str | None = None) -> Column:
    """A positive random number of each row: the least of several rows is one's with a chance in proportion to its weight
    (an exponential variable with the weight as its rate)."""
    u = (F.conv(F.substring(shuffle_key(key, seed), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    return -F.ln(u) / (F.col(weight).cast("double") if weight else F.lit(1.0))


def deficit_batches(df: DataFrame, bin_: str, key: str, batch_size: int, weights: Mapping | None = None, drawn: Mapping | None = None, seed: int = 0, row_weight: str | None = None) -> DataFrame:
    """``df`` with row and batch: all rows in an order in which every bin keeps to its share from batch to batch.

    Each draw goes to the bin that is farthest behind: the m-th of a bin of weight w is due at (m + 1/2) / w, so after any
    number of draws no bin is off its share by more than about one row per bin, until it is exhausted; then the others
    share what is left. ``weights``: a whole number for each bin, 1 if absent, 0 leaves it out (``policies.bin_weights`` times
    some 1000, rounded, makes rare bins and such behind come sooner). ``drawn``: what each bin gave in former epochs. In a bin rows
    are drawn at random without replacement, with chances by ``row_weight`` if given (rows whose weight is not above 0
    are left out). Bins without rows are never drawn; null is a bin of its own.

    The order needs no sort of all rows: a row's place follows from its rank in its bin and the bins' counts, of which the
    driver sees one each.
    """
    if row_weight:
        df = df.where(F.col(row_weight) > 0)
    weights, drawn = weights or {}, drawn or {}
    counts = {r[0]: r[1] for r in df.groupBy(bin_).agg(F.count(F.lit(1)).alias("n")).collect()}
    bins = sorted((b for b in counts if weights.get(b, 1) > 0), key=lambda b: (b is not None, b))
    if not bins:
        return df.limit(0).withColumns({"row": F.lit(0).cast("long"), "batch": F.lit(0).cast("long")})
    kind = df.schema[bin_].dataType
    facts = [(i, b, counts[b], int(weights.get(b, 1)), int(drawn.get(b, 0))) for i, b in enumerate(bins)]
    table = df.sparkSession.createDataFrame(facts, f"__i int, __bin {kind.simpleString()}, __n long, __w long, __d long")
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).cast("long").alias("n"), F.lit(w).cast("long").alias("w"), F.lit(d).cast("long").alias("d")) for i, _, n, w, d in facts])
    ranked = numbered_within(df, [bin_], draw_key(key, seed, row_weight), [key], "__k")
    own = ranked.join(F.broadcast(table), ranked[bin_].eqNullSafe(F.col("__bin")))  # a row for each bin
    due = 2 * (F.col("__k") + F.col("__d")) + 1

    def before(b: Column) -> Column:
        """Rows of a bin that come before: their due time is less, or equal in an earlier bin."""
        room = due * b["w"] - F.col("__w")
        first = F.when(b["i"] < F.col("__i"), F.call_function("div", room - F.pmod(room, 2 * F.col("__w")), 2 * F.col("__w")) + 1)
        strict = F.call_function("div", room - 1 - F.pmod(room - 1, 2 * F.col("__w")), 2 * F.col("__w")) + 1
        return F.greatest(F.lit(0), F.least(b["n"], F.coalesce(first, strict) - b["d"]))

    row = F.aggregate(every, F.lit(0).cast("long"), lambda a, b: a + before(b))
    out = own.withColumn("row", row.cast("long"))
    return out.select(*df.columns, "row", F.floor(F.col("row") / batch_size).cast("long").alias("batch"))


def limit_groups(df: DataFrame, groups: Sequence[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n random rows of each group."""
    w = Window.partitionBy(*groups).orderBy(shuffle_key(key, seed), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def block_size(epoch_size: int, batch_size: int, blocks: int) -> int:
    """Samples that each block gives to an epoch."""
    return max(1, epoch_size * batch_size // max(1, blocks))


def sampling_bins(edges, quantiles=None) -> list[dict[str, tuple[float, float]]]:
    """Filters from edges: {feature: edges} gives each feature's bins on their own, {(f, g): [edges, edges]} joint ones.

    A number instead of edges asks for as many bins from ``quantiles(feature, n)``.
    """
    out: list[dict[str, tuple[float, float]]] = []

    def bins(feature: str, e) -> list[tuple[float, float]]:
        e = quantiles(feature, e) if isinstance(e, int) else e
        return list(itertools.pairwise(e))

    for f, e in edges.items():
        if isinstance(f, tuple):
            for combination in itertools.product(*[bins(x, y) for x, y in zip(f, e, strict=True)]):
                out.append(dict(zip(f, combination, strict=True)))
        else:
            out += [{f: b} for b in bins(f, e)]
    return out


def stratified(df: DataFrame, key: str, filters: Sequence[Mapping[str, tuple[float | None, float | None]]], batch_size: int, seed: int = 0) -> DataFrame:
    """(config, batch, row, columns of df): each batch has ``batch_size`` rows of every bin that has any.

    Bins draw from their own shuffle; there are as many batches as the bin with the fewest fills, and every bin weighs the
    same whatever its share of the rows. One pass tags rows with their bins; rows are numbered within each.
    """
    tags = F.array_compact(F.array(*[F.when(in_bins(f), F.lit(i)) for i, f in enumerate(filters)]))
    tagged = df.withColumn("config", F.explode(tags))
    sliced = tagged.withColumn("__s", F.substring(shuffle_key(key, seed), 1, 3))
    counts = sliced.groupBy("config", "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("config").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    least = counts.groupBy("config").agg(F.sum("__n").alias("n")).agg(F.min(F.floor(F.col("n") / batch_size)).alias("__batches"))
    w = Window.partitionBy("config", "__s").orderBy(shuffle_key(key, seed), key)
    ranked = sliced.withColumn("row", F.row_number().over(w) - 1).join(bases, ["config", "__s"])
    ranked = ranked.withColumn("row", F.col("__base") + F.col("row")).withColumn("batch", F.floor(F.col("row") / batch_size).cast("long"))
    kept = ranked.join(F.broadcast(least), F.col("batch") < F.col("__batches"))  # one row
    return kept.select("config", "batch", "row", *df.columns)


def multi_config(frames: Sequence[DataFrame], key: str, batch_size: int, seed: int = 0) -> DataFrame:
    """(config, batch, row, ...): one sub-batch of every frame in each batch; columns a frame lacks are null.

    The number of batches is the least of all frames, short last ones left out unless all are short.
    """
    parts, sizes = [], []
    for i, f in enumerate(frames):
        parts.append(batches(f, key, batch_size, seed).withColumn("config", F.lit(i)))
        sizes.append(f.count())
    whole = min(-(-n // batch_size) for n in sizes)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.where(F.col("batch") < whole)


def stacked(df: DataFrame, features: Sequence[str], by: Sequence[str] = ("batch",), order: str = "row") -> DataFrame:
    """One row for each batch, each feature an array in the rows' order."""
    listed = F.array_sort(F.collect_list(F.struct(order, *features)))
    return df.groupBy(*by).agg(listed.alias("__r")).select(*by, *[field_of("__r", f).alias(f) for f in features])


def nested(row, structure):
    """The values of a batch's row in the nesting of feature names that ``structure`` has."""
    if isinstance(structure, str):
        return {structure: row[structure]}
    if all(isinstance(x, str) for x in structure):
        return {x: row[x] for x in structure}
    return [nested(row, x) for x in structure]


def names_in(structure) -> list[str]:
    return [structure] if isinstance(structure, str) else [n for x in structure for n in names_in(x)]


class Batches:
    """Iterates over batches of features in a nested structure, an epoch or for ever, one batch in memory at a time."""

    def __init__(self, df: DataFrame, key: str, batch_size: int, features, seed: int | None = 0, repeat: bool = False):
        self.df, self.key, self.batch_size, self.features, self.seed, self.repeat = df, key, batch_size, features, seed, repeat

    def plan(self, epoch: int = 0) -> DataFrame:
        seed = None if self.seed is None else self.seed + epoch
        return stacked(batches(self.df, self.key, self.batch_size, seed), names_in(self.features)).orderBy("batch")

    def __iter__(self) -> Iterator:
        for epoch in itertools.count() if self.repeat else (0,):
            for row in self.plan(epoch).toLocalIterator(prefetchPartitions=True):
                yield nested(row, self.features)

    def save(self, path: str) -> None:
        self.plan().write.mode("overwrite").parquet(path)

    def replay(self, path: str, n_samples: int | None = None) -> Iterator:
        """What is stored at ``path``, written by the first run; ``n_samples`` ends it, which a repeating run needs.

        Batches of a later epoch follow those of the first in the same order.
        """
        from ..sources.store import SharedPath

        if self.repeat and n_samples is None:
            raise ValueError("a repeating run needs n_samples")
        spark, left = self.df.sparkSession, n_samples
        if not SharedPath(spark, f"{path}/_SUCCESS").exists():
            self.save(path)
        while left is None or left > 0:
            any_row = False
            for row in spark.read.parquet(path).orderBy("batch").toLocalIterator():
                any_row = True
                yield nested(row, self.features)
                if left is not None:
                    left -= len(row[names_in(self.features)[0]])
                    if left <= 0:
                        return
            if not (self.repeat and any_row):
                return

    @staticmethod
    def load(spark, path: str, features) -> Iterator:
        for row in spark.read.parquet(path).orderBy("batch").toLocalIterator():
            yield nested(row, features)
