"""URL lists: a blocked Bloom filter of the listed canonical URLs in front of an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

#: Words of 64 bits in a block of the filter; a key sets one bit in each.
WORDS = 8
BITS_PER_KEY = 16
#: Most blocks (8 MB); with more keys the filter lets more through, and the exact join still decides.
MAX_BLOCKS = 1 << 17

_ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _ALPHA, _ALPHA.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): one row for each block in use, so at most ``blocks`` rows."""
    cols = [F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))]
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(*cols)


def judge(df: DataFrame, url: str, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict.

    ``rules``: rule_host, rule_path, verdict. A rule fits its host and all subdomains if the path starts with its path;
    the longest (host and path together, then host) wins, of repeated rules the lesser verdict. Rows without a rule have
    rule null and the verdict ``default``. Repeated rows are judged each; an empty table or no rules give no hits; very long
    urls make as many keys as their host has labels, times the lengths of rules' paths. Null urls and such without :// have empty host and path and fit no rule.

    The suffixes of a host and the starts of a path (only at the lengths that rules have) make the keys of a row that may
    be listed. A key passes the blocked Bloom filter, whose size is bounded by MAX_BLOCKS and which may so be broadcast,
    before it reaches the exact join with the rules. Hits are reduced to one row for each host and path before they meet
    ``df`` again. Columns of ``df`` with the names of results are replaced.
    """
    spark = df.sparkSession
    listed = rules.select(F.translate("rule_host", _ALPHA, _ALPHA.lower()).alias("rule_host"), "rule_path", F.col("verdict").alias("listed"))
    listed = listed.where("rule_host <> '' and rule_path is not null and listed is not null")
    listed = listed.withColumn("key", F.concat("rule_host", "rule_path"))
    # Lengths are bounded: a URL has at most a few thousand characters.
    facts = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.char_length("rule_path")).alias("lengths")).first()
    lengths = sorted(facts["lengths"])
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * WORDS * 64 < facts["n"] * BITS_PER_KEY:
        blocks *= 2
    base = df.drop("host", "path", "rule", "verdict", "__host").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not lengths:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    some = F.split(F.lit(",".join(map(str, lengths))), ",").cast("array<int>")
    starts = F.transform(F.filter(some, lambda n: n <= F.char_length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    urls = base.where("host <> ''").select("host", "path")
    keys = urls.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", F.explode(F.transform(starts, lambda p: F.concat("suffix", p))).alias("key"))
    bloom = bloom_filter(listed, "key", blocks)
    bits = _bits(F.col("key"))
    passing = keys.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(bloom), "block")
    for i, b in enumerate(bits):
        passing = passing.where(F.col(f"w{i}").bitwiseAND(b) == b)
    # hash join on the whole key; host and path lengths tell splits of equal keys apart
    hits = passing.select("host", "path", "key").join(listed, "key")
    own = F.col("host").eqNullSafe(F.col("rule_host")) | F.endswith("host", F.concat(F.lit("."), F.col("rule_host")))
    hits = hits.where(own & F.startswith("path", F.col("rule_path")))
    rank = F.struct(F.char_length("key").alias("n"), F.char_length("rule_host").alias("m"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("key", "listed"), rank).alias("best"))
    tied = hits.groupBy("host", "path", "key").agg(F.min("listed").alias("verdict"))
    best = best.select("host", "path", F.col("best.key").alias("key")).join(tied, ["host", "path", "key"]).select("host", "path", F.col("key").alias("rule"), "verdict")
    # a table, not an aggregate: so Spark splits the join where many rows share host and path
    best = stash(best, "url-rules")
    # rows without a host fit no rule: a key of their own keeps them from meeting in one task
    alone = F.concat(F.lit("\x00"), F.xxhash64(*[F.col(c) for c in df.drop("host", "path", "rule", "verdict").columns]).cast("string"))
    rows = base.withColumn("__host", F.when(F.col("host") == "", alone).otherwise(F.col("host")))
    best = best.withColumnsRenamed({"host": "__h", "path": "__p"})
    out = rows.join(best, (rows["__host"] == best["__h"]) & (rows["path"] == best["__p"]) & (rows["host"] != ""), "left")
    return out.select(*[rows[c] for c in base.columns], "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: Fixed values of the query contract: host, path, verdict.
RULES: Sequence[tuple[str, str, str]] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op8_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(list(RULES), "rule_host string, rule_path string, verdict string")
    return judge(pages, "url", rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block'))
SELECT page_id, host, path,
  (SELECT arg_max(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(v, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM u
"""
