"""Keeping hot keys from landing in one task.

Every helper here keeps results whole: a hot group is split and stitched
together again, never sampled or cut.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS_CONF = "leakguard.hot.rows"
DEFAULT_HOT_ROWS = 1 << 20


def hot_rows_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get(
            "spark.checkpoint.dir", ""
        )
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="leakguard-ckpt-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read again.

    Survives lost executors and cuts the lineage; unlike a checkpoint its size is known
    to the planner, which decides by it what to broadcast.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/leakguard-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_PROBES: OrderedDict = OrderedDict()
_MAX_PROBES = 512


def _probe(df: DataFrame, what: tuple, ask):
    """Answer of ``ask()`` about ``df``, remembered for the same plan and input size.

    Several operators ask the same question about the same frame.  The answer
    only steers how work is spread, never what the result is.  Appended input
    changes the size, so it is asked again.
    """
    size = str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), size, what)
    if key not in _PROBES:
        _PROBES[key] = ask()
        while len(_PROBES) > _MAX_PROBES:
            _PROBES.popitem(last=False)
    return _PROBES[key]


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows (column ``hot_n``), or None.

    Reads only the key columns and counts map-side first.  The list is a table of its own,
    of any length.
    """
    wanted = df.select(*keys)
    heavy = wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_n")).filter(F.col("hot_n") > limit)

    def ask() -> DataFrame | None:
        listed = materialize(heavy)
        return None if listed.isEmpty() else listed

    return _probe(wanted, ("hot", limit), ask)


def split_hot(
    df: DataFrame, keys: list[str], limit: int | None = None
) -> tuple[DataFrame, bool]:
    """Add ``chunk`` if some key is hot: the number of its span for hot keys, else -1.

    Spans are cut by position, whatever the gaps in ``seq``: rows are counted by key and
    stretch of ``seq``, and the stretches of a key are put together until ``limit`` rows
    are full.  ``seq`` is unique, so a stretch has at most ``limit`` rows and a span at
    most twice that.  Without hot keys the frame is returned as it is.
    """
    limit = limit or hot_rows_limit(df.sparkSession)
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return df, False
    stretch = F.coalesce(F.expr(f"seq div {limit}"), F.lit(-(1 << 62)))
    rows = df.withColumn("_stretch", stretch)
    counts = rows.select(*keys, "_stretch").join(hot.select(*keys), keys, "left_semi")
    counts = counts.groupBy(*keys, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    spans = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    spans = materialize(spans.select(*keys, "_stretch", F.expr(f"_before div {limit}").alias("chunk")))
    marked = rows.join(spans, [*keys, "_stretch"], "left").withColumn(
        "chunk", F.coalesce("chunk", F.lit(-1).cast("bigint"))
    )
    return marked.drop("_stretch"), True


def group_columns(keys: list[str], hot: bool) -> list[str]:
    return [*keys, "chunk"] if hot else list(keys)


# Rows without a key match nothing; this many salts spread them.
_NULL_SALTS = 4096


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    hot_limit: int | None = None,
) -> DataFrame:
    """Join against a table that is unique by ``key``.

    Nothing is broadcast by force: Spark does so where the right side's bytes allow, and
    splits a skewed partition of the left side otherwise (adaptive execution).  Left rows
    without a key are spread at random.  With ``hot_limit`` the left side is counted first
    and rows of keys above it are spread over salted copies of their single right row,
    for sessions without adaptive execution.
    """
    known = left.filter(F.col(key).isNotNull())
    hot = None if hot_limit is None else hot_keys(known, [key], hot_limit)
    any_salt = F.xxhash64("seq")
    salt = F.when(F.col(key).isNull(), F.pmod(any_salt, F.lit(_NULL_SALTS)))
    if hot is None:
        spread = left.withColumn("_salt", salt.otherwise(0).cast("int"))
        copied = right.withColumn("_salt", F.lit(0))
    else:
        copies = hot.select(key, F.ceil(F.col("hot_n") / F.lit(hot_limit)).alias("_copies"))
        salt = salt.when(F.col("_copies") > 1, F.pmod(any_salt, F.col("_copies")))
        spread = left.join(copies, key, "left").withColumn("_salt", salt.otherwise(0).cast("int"))
        last = F.coalesce(F.col("_copies"), F.lit(1)).cast("int") - 1
        copied = right.join(copies, key, "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), last))
        )
        spread, copied = spread.drop("_copies"), copied.drop("_copies")
    return spread.join(copied, [key, "_salt"], how).drop("_salt")


def number_rows(
    df: DataFrame, order: list[Column], name: str, seq: str = "seq", limit: int | None = None
) -> DataFrame:
    """1-based row numbers over the whole frame, ``order`` starting with ``seq``.

    Rows are numbered inside spans of ``seq`` and shifted by the size of the
    earlier spans, so no task ever holds more than one span.
    """
    limit = limit or hot_rows_limit(df.sparkSession)
    # rows without a seq come first and keep their numbers
    span = df.withColumn("_span", F.coalesce(F.expr(f"{seq} div {limit}"), F.lit(-(1 << 62))))
    sizes = span.groupBy("_span").agg(F.count(F.lit(1)).alias("_n"))
    # one row per span: bounded by the range of seq over the span width
    before = F.sum("_n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("_span", F.coalesce(before, F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_span").orderBy(*order))
    return (
        span.withColumn("_row", within)
        .join(shifts, "_span")
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_span", "_row", "_shift")
    )
