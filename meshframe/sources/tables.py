"""Tables that cut lineage: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where none is set and all runs on one machine a temporary one is."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='meshframe-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/meshframe/{label}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables and files that operators put into the shared folder inside it.

    Results are lazy and may read them: write or count what is to stay before the end.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for p in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
