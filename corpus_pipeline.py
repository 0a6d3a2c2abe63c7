"""The corpus pipeline: five stages, each an operator of meshframe.llm whose decisions take effect.

A stage is a function of (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns that they were given; columns of ``docs`` that share a name with a working column are set aside and come back
unchanged. Null ids, texts and sources and repeated rows go through as the operators define; empty tables stay empty. Very long
texts are one row in memory, and are worked on whole. Ties: near_dedup keeps the least id of a group and of rows with one
id and alike texts any one (they differ in other columns at most, the one with the least hash of all columns stays);
mixing and packing break ties by hashes of ids and texts, so reruns agree; quality and substring_dedup know none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshframe.llm.common import n_words, stash
from meshframe.llm.minhash import BROADCAST_IDS, near_duplicates
from meshframe.llm.mixing import mix
from meshframe.llm.packing import pack
from meshframe.llm.quality import measure
from meshframe.llm.substrings import remove_repeats


def _aside(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with working names free."""
    return docs.withColumnsRenamed({n: f"__own_{n}" for n in names if n in docs.columns})


def _back(frame: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of ``docs``; with ``text``, that column is the text and n_chars follows it."""
    out = []
    for c in docs.columns:
        own = f"__own_{c}" if f"__own_{c}" in frame.columns else c
        value = F.col(own)
        if text and c == "text":
            value = F.col(text)
        elif text and c == "n_chars":
            value = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        out.append(value.alias(c))
    return frame.select(*out)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "kept", "__words"]
    return _back(measure(_aside(docs, names)).where("kept"), docs, "cleaned")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8), whatever its id: that with the least id.

    A row is told apart by a hash of id and text. All rows are compared, so rows that share an id stay unless their texts
    are alike. A group with and without ids keeps one row of each kind; rows without words link with nothing and stay.
    """
    own = _aside(docs, ["__key", "__nth"]).withColumn("__key", F.xxhash64("doc_id", "text"))
    keys = stash(own.groupBy("__key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "pipeline-keys")
    again = keys.where("n > 1").select("__key")
    repeated = again.count()
    texts = own.select("__key", "text")
    if repeated:  # equal rows are compared once; few of them are broadcast, so that none is gathered in one task
        again = F.broadcast(again) if repeated <= BROADCAST_IDS else again
        texts = texts.join(again, "__key", "left_anti").unionByName(texts.join(again, "__key", "left_semi").dropDuplicates())
    found = near_duplicates(texts, "__key").join(keys, "__key")
    least = found.where("n_shingles > 0").groupBy("component_id", F.col("doc_id").isNull().alias("no_id")).agg(F.min(F.struct("doc_id", "__key", "n")).alias("least"))
    blank = found.where("n_shingles = 0").select("__key", F.lit(1).cast("long").alias("n"))
    kept = stash(least.select("least.__key", "least.n").unionByName(blank), "pipeline-kept")
    out = own.join(kept.where("n = 1"), "__key", "left_semi")
    if repeated:
        several = kept.where("n > 1")
        several = F.broadcast(several) if repeated <= BROADCAST_IDS else several
        first = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64(*own.columns)))
        out = out.unionByName(own.join(several, "__key", "left_semi").withColumn("__nth", first).where("__nth = 1").drop("__nth"))
    return _back(out, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; texts without repeats stay as they are, emptied ones go."""
    names = ["n_words", "n_removed", "kept_text", "__left", "__key", "__ranges"]
    found = remove_repeats(_aside(docs, names)).where("n_removed = 0 or n_removed < n_words")
    return _back(found.withColumn("__left", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))), docs, "__left")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    own = _aside(docs, ["__h", "__size", "__copies", "__n", "__nth"])
    h = F.xxhash64("text")
    sized = stash(own.select("doc_id", "source", h.alias("__h"), n_words(F.col("text")).alias("__size")), "pipeline-sizes")
    taken = mix(sized, ["doc_id", "__h"], size="__size").groupBy("doc_id", "__h", "source").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__n"))
    left = own.withColumn("__h", h)
    on = [left[c].eqNullSafe(taken[c]) for c in ("doc_id", "__h", "source")]
    both = left.join(taken, on[0] & on[1] & on[2]).select(*[left[c] for c in left.columns], "__copies", "__n")
    nth = F.row_number().over(Window.partitionBy("doc_id", "__h", "source").orderBy("text"))
    times = F.floor(F.col("__copies") / F.col("__n")) + (nth <= F.pmod("__copies", "__n")).cast("long")
    return _back(both.withColumn("__nth", times).where("__nth > 0").withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), "__nth"))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The spans of all documents in sequences."""
    return pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Hashes and a tokenizer decide in it, which SQL cannot express; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return stash(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
