"""Landing raw log files: every line gets its arrival number.

Raw files hold bare lines.  Arrival order is the order of the files, then of the lines in
them.  Splits of files are read in parallel; a line's number is the number of lines in
earlier splits, a prefix sum over one row per split, plus its position in its split.  So
numbers are dense and unique, and no task orders more than one split.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakguard.operators.skew import ensure_checkpoint_dir

FILE_ORDERS = {
    "name": ["file"],
    "time": ["modified", "file"],  # rotated files: the oldest first
}


def number_splits(lines: DataFrame, split: list[str], order: list[Column], at: str, start: int = 0) -> DataFrame:
    """Add ``seq``: dense numbers by split in ``order``, then by ``at`` inside a split."""
    sizes = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))
    # one row per split passes through this window: input bytes over the split size
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + F.lit(start)).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*split).orderBy(at)) - 1
    return lines.withColumn("_in", inside).join(shifts, split).withColumn("seq", F.col("_in") + F.col("_shift")).drop("_in", "_shift")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, modified, block, at (grows inside a split)."""
    meta = F.col("_metadata")
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        meta["file_path"].alias("file"),
        meta["file_modification_time"].alias("modified"),
        meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def next_seq(spark: SparkSession, target: str) -> int:
    """The first number that no landed line has."""
    top = spark.read.schema("seq long").parquet(target).agg(F.max("seq")).first()[0]
    return 0 if top is None else top + 1


def land_lines(spark: SparkSession, path: str, target: str, order: str = "name", start: int = 0) -> None:
    """Append the lines of the files at ``path`` to the table ``target`` as ``seq, line``.

    ``order`` is ``"name"`` or ``"time"`` (modification time, then name); ``start`` is the
    first number, ``next_seq`` of what landed before.  A line is read once: places are
    stored before lines are numbered, so a retried task cannot number them differently.
    """
    staged = f"{ensure_checkpoint_dir(spark)}/raw-{uuid.uuid4().hex}"
    raw_lines(spark, path).write.parquet(staged)
    lines = spark.read.schema("line string, file string, modified timestamp, block long, at long").parquet(staged)
    split = ["file", "modified", "block"]
    numbered = number_splits(lines, split, [F.col(c) for c in (*FILE_ORDERS[order], "block")], "at", start)
    numbered.select("seq", "line").write.mode("append").parquet(target)


def kafka_lines(records: DataFrame) -> DataFrame:
    """``seq, line`` of records with partition, offset and value.

    Numbers are unique over partitions and grow with the offset inside one: the partition
    stands in the upper 23 bits, the offset in the lower 40.  Producers must key by
    client, so that one client's lines share a partition.
    """
    return records.select(
        (F.shiftleft(F.col("partition").cast("bigint"), 40) + F.col("offset")).alias("seq"),
        F.col("value").cast("string").alias("line"),
    )
