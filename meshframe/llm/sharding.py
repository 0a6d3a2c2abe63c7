"""Sharding by rendezvous hashing: a record's key and the weighted shards decide, so that few records move."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, stash

#: Slices of a shard that are numbered apart: so many, doubled until one has some SLICE_ROWS rows.
SLICES, SLICE_ROWS = 64, 1 << 20


def draw(*parts: Column) -> Column:
    """A number from 0 to 2**52 - 1, by the first 13 hex digits of the MD5 of the parts joined by |; null parts are empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _score(key: Column, shard: int, weight: float) -> Column:
    """Least wins: -ln(u) / weight, where u in (0, 1) is drawn by key and shard."""
    return -F.log((draw(key, F.lit(shard)) + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0..n-1) of a key under weighted rendezvous hashing.

    Every shard scores every key on its own, so another shard takes keys only into itself, and a changed weight moves
    keys only to or from its own shard. Equal keys, null ones too, share a shard. Weights must be above 0.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    return _best(key, dict(enumerate(weights)))["shard"]


def _best(key: Column, weights: Mapping[int, float]) -> Column:
    """The least (score, shard) of some shards."""
    return F.array_min(F.array(*[F.struct(_score(key, j, w).alias("score"), F.lit(j).alias("shard")) for j, w in weights.items()]))


def shard(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """``df`` with shard int, slot long (gapless from 0 within the shard) and grown_shard int (under ``grown``, else null).

    One narrow pass decides the shard. Slots follow a hash of the key, then the key; they are numbered in slices of a
    shard, so no task gathers a whole shard. Null and repeated keys stay rows of their own; columns named shard, slot or
    grown_shard are replaced. An empty table gives none.
    """
    rendezvous(F.col(key), weights)  # says what is wrong with weights
    placed = df.drop("shard", "slot", "grown_shard", "__best").withColumn("__best", _best(F.col(key), dict(enumerate(weights))))
    if grown and list(grown[: len(weights)]) == list(weights):  # the shards that come score against the best so far
        more = {j: w for j, w in enumerate(grown) if j >= len(weights)}
        rendezvous(F.col(key), grown)
        after = (F.least("__best", _best(F.col(key), more)) if more else F.col("__best"))["shard"]
    else:
        after = rendezvous(F.col(key), grown) if grown else F.lit(None)
    placed = stash(placed.withColumns({"shard": F.col("__best")["shard"].cast("int"), "grown_shard": after.cast("int")}).drop("__best"), "shards")
    slices = SLICES
    rows = placed.count()
    while rows > slices * len(weights) * SLICE_ROWS:
        slices *= 2
    order = draw(F.col(key), F.lit("slot"))
    ranked = gapless_rank(placed, ["shard"], order, [order, F.col(key)], "slot", slices)
    return ranked.select(*[c for c in placed.columns if c != "grown_shard"], "slot", "grown_shard")


def op6_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    return shard(rows, "doc_id", [1.0] * 24, [1.0] * 25).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The CRC-32 polynomial is a fixed value.
OP6_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(n AS BIGINT))) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
s AS (SELECT *, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS crc,
  list_transform(range(25), lambda j: -ln((CAST('0x' || md5(k || '|' || j)[1:13] AS BIGINT) + 0.5) / 4503599627370496.0)) AS score, CAST('0x' || md5(k || '|slot')[1:13] AS BIGINT) AS o FROM b, crc),
p AS (SELECT *, list_position(score[1:24], list_min(score[1:24])) - 1 AS shard, list_position(score, list_min(score)) - 1 AS grown FROM s)
SELECT doc_id, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY o % 64, o, doc_id) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM p
"""
