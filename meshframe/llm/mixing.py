"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stash, width

#: Fixed values of the query contract.
WEIGHTS: Sequence[float] = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Units that a leaf of the tree has on average, and children of an inner node.
LEAF, FANOUT = 256, 128
#: Equal rows that are written out in one go.
RUN = 4096
#: Sources up to which their table (a few numbers for each) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, weight, target) of a table (source, size).

    Sources in code point order, null last, take ``weights`` in turn. The total is ``share`` times all sizes, dealt by
    weight; a target stops at ``most`` times its source's size and the excess goes to the others by weight. The level at
    which that ends is found directly: sources sorted by cap per weight, the first whose cap is not reached sets it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    per = per.withColumns({"capped": F.coalesce(F.sum("cap").over(up), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(up), F.lit(0.0)), "all_weight": F.sum("weight").over(every)})
    level = (F.col("budget") - F.col("capped")) / (F.col("all_weight") - F.col("gone"))
    per = per.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    # levels fall as long as caps are below them; the first that no cap cuts short is the least
    per = per.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.struct(F.col("cap") / F.col("weight"), F.col("capped")))).over(every))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return per.select("source", "source_size", "n", "weight", target.alias("target"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(units: Column, seed: int) -> Column:
    """Sequential pivotal rounding of an array of units (unit, size, p): struct(done array, carry unit).

    Two units exchange words until one of them is taken whole or not at all; which way is drawn so that each keeps its
    expected share. The words in the pair stay the same, so only the last carry of the tree can miss the target.
    """

    def step(state: Column, j: Column) -> Column:
        i = state["carry"]
        room_i, held_i = (1 - i["p"]) * i["size"], i["p"] * i["size"]
        room_j, held_j = (1 - j["p"]) * j["size"], j["p"] * j["size"]
        u = F.shiftrightunsigned(F.xxhash64(i["unit"], j["unit"], F.lit(seed)), 11) / F.lit(float(2**53))
        moves = F.struct(F.least(room_i, held_j).alias("a"), F.least(room_j, held_i).alias("b"))

        def outcome(m: Column) -> Column:
            to_i = u * (m["a"] + m["b"]) < m["b"]

            def unit(x: Column, p: Column) -> Column:
                return F.struct(x["unit"].alias("unit"), x["size"].alias("size"), p.alias("p"))

            one, nil = F.lit(1.0), F.lit(0.0)
            less_j, less_i = j["p"] - m["a"] / j["size"], i["p"] - m["b"] / i["size"]
            more_i, more_j = i["p"] + m["a"] / i["size"], j["p"] + m["b"] / j["size"]

            def pair(final: Column, carry: Column) -> Column:
                return F.struct(final.alias("final"), carry.alias("carry"))

            return (
                F.when(to_i & (room_i <= held_j), pair(unit(i, one), unit(j, F.greatest(less_j, nil))))
                .when(to_i, pair(unit(j, nil), unit(i, F.least(more_i, one))))
                .when(room_j <= held_i, pair(unit(j, one), unit(i, F.greatest(less_i, nil))))
                .otherwise(pair(unit(i, nil), unit(j, F.least(more_j, one))))
            )

        return _let(_let(moves, outcome), lambda o: F.struct(F.array_append(state["done"], o["final"]).alias("done"), o["carry"].alias("carry")))

    start = F.struct(F.slice(units, 1, 0).alias("done"), F.element_at(units, 1).alias("carry"))
    return F.aggregate(F.slice(units, F.lit(2), F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def _told_apart(rows: DataFrame) -> DataFrame:
    """(unit, size, source, nth): equal rows counted and numbered, so that they are dealt apart.

    Nothing else tells them apart, so which is which does not matter. Many of them are written out in runs by many tasks.
    """
    counted = rows.groupBy("unit", "size", "source").agg(F.count(F.lit(1)).alias("n"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    few = counted.where(F.col("n") <= RUN).select("unit", "size", "source", F.explode(F.sequence(zero, F.col("n") - one)).alias("nth"))
    many = counted.where(F.col("n") > RUN).select("unit", "size", "source", "n", F.explode(F.sequence(zero, F.col("n") - one, F.lit(RUN).cast("long"))).alias("from"))
    many = many.repartition(width(rows.sparkSession), "unit", "from").select("unit", "size", "source", F.explode(F.sequence("from", F.least(F.col("from") + F.lit(RUN), F.col("n")) - one)).alias("nth"))
    return few.unionByName(many)


def mix(df: DataFrame, unit: list[str], size: str = "size", source: str = "source", seed: int = 17, **rules: float) -> DataFrame:
    """(unit columns, size, source, source_size, target, copies): how often the mix takes each row of ``df``.

    A row is expected target / source_size times (at most ``most``): that whole part, and the fraction is rounded
    dependently within the source. Rows are dealt to leaves by a hash; leaves fold their rows, and what each leaves over,
    one unit, goes up a tree of bounded fan-out to one unit for a source, which is rounded to the nearer side. So a hot
    source takes more leaves, not longer ones, and all draws are hashes: reruns agree. Rows of size 0 (null counts as 0)
    take the whole part. Null sources are a source, null units units. An empty table gives none. Equal rows are numbered,
    so they are dealt apart as others are. Further columns are ignored; texts do not come here, only their sizes.
    """
    named = F.struct(*[F.col(c) for c in unit]).alias("unit")
    rows = df.select(named, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.col(source).alias("source"))
    plan = stash(targets(rows.select("source", "size"), **rules), "mix-targets")
    rows = _told_apart(rows).select(F.struct("unit.*", F.col("nth").alias("__nth")).alias("unit"), "size", "source")
    facts = plan.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("n")).first()
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.select(F.col("source").alias("of"), "source_size", "target", share.alias("share"), F.ceil(F.col("n") / LEAF).alias("leaves"))
    side = F.broadcast(plan) if facts["sources"] <= BROADCAST_SOURCES else plan
    dealt = rows.join(side, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole = F.floor("share").cast("int")
    dealt = dealt.withColumns({"whole": whole, "p": F.col("share") - whole})
    keep = ["source", "source_size", "target", "whole"]

    def said(units: DataFrame, took: Column) -> DataFrame:
        return units.select(*[F.col(f"unit.{c}").alias(c) for c in unit], "size", "source", "source_size", "target", (F.col("whole") + took).cast("int").alias("copies"))

    draws = (F.col("size") > 0) & (F.col("p") > 0)
    found = [said(dealt.where(~draws), F.lit(0))]
    now = dealt.where(draws).withColumn("node", F.pmod(F.xxhash64("unit", "size", F.lit(seed)), F.col("leaves")))
    nodes = -(-(facts["n"] or 1) // LEAF)
    while True:
        order = F.reverse(F.sort_array(F.collect_list(F.struct("size", "unit", "p"))))
        level = now.groupBy(*keep, "node").agg(order.alias("units")).withColumn("units", F.transform("units", lambda x: F.struct(x["unit"].alias("unit"), x["size"].alias("size"), x["p"].alias("p"))))
        level = stash(level.select(*keep, "node", _fold(F.col("units"), seed).alias("fold")), "mix-level")
        done = level.select(*keep, F.explode("fold.done").alias("u")).select(*keep, "u.*")
        found.append(said(done, F.col("p")))
        now = level.select(*keep, "node", "fold.carry.*")
        if nodes <= 1:
            break
        nodes = -(-nodes // FANOUT)
        now = now.withColumn("node", F.floor(F.col("node") / FANOUT))
    found.append(said(now, F.round("p")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def op2_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    docs = stash(docs, "mix-sizes")
    return mix(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
