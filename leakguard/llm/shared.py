"""Shared storage and small helpers for the training-data operators."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="leakguard-llm-")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees; a machine-local one only in local mode."""
    folder = spark.conf.get(CHECKPOINT_CONF, "") or spark.sparkContext.getConf().get(CHECKPOINT_CONF, "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once to shared storage and read again.

    Later steps read files instead of repeating the work, and a lost executor costs
    only its running tasks.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside drop their shuffle files once they end; for steps that are all written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores before it as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
