"""Continuous detection: lines in, ban records out."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakguard.operators import buckets, resolve
from leakguard.operators.bans import BanTable
from leakguard.operators.levels import CLIENT_KEYS, PATH_KEYS
from leakguard.schemas import INVENTORY, Measure, Thresholds
from leakguard.sources.lines import accepted, decode_lines, rejected
from leakguard.streaming import processor

cloudpickle.register_pickle_by_value(processor)

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB, so that it may exceed executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def latest_entries(snapshots: DataFrame) -> DataFrame:
    """The last scanned entry of each path, so that a path appended twice matches once."""
    entry = F.struct(*[c for c in snapshots.columns if c != "path"])
    order = F.struct("scanned_at", "is_dir", "size")
    latest = snapshots.groupBy("path").agg(F.max_by(entry, order).alias("_last"))
    return latest.select("path", "_last.*").select(*snapshots.columns)


class FreshInventory:
    """File inventory that a running stream joins against and that can be renewed.

    The sizes read are kept (on disk) and reused until ``ttl_s`` has passed; then
    ``refresh_if_due`` lists the folder again, so that new files become visible.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_s: int, clock=time.time):
        self.spark, self.path, self.ttl_s, self.clock = spark, path, ttl_s, clock
        self.frame = latest_entries(spark.read.schema(INVENTORY).parquet(path)).persist(
            StorageLevel.DISK_ONLY
        )
        self.read_at = clock()

    def refresh_if_due(self) -> bool:
        if self.clock() - self.read_at < self.ttl_s:
            return False
        self.spark.catalog.refreshByPath(self.path)
        self.read_at = self.clock()
        return True


def _stateful(
    events: DataFrame,
    keys: list[str],
    measures: list[Measure],
    th: Thresholds,
    state_ttl_s: int | None = None,
) -> DataFrame:
    rows = buckets.narrow_events(events, keys, measures)
    ttl_ms = None if state_ttl_s is None else 1000 * state_ttl_s
    fields = [rows.schema[k] for k in (*keys, "seq", "family")]
    fields += [T.StructField("measure", T.IntegerType()), T.StructField("expires_us", T.LongType())]
    return rows.groupBy(*keys).transformWithStateInPandas(
        processor.BucketProcessor(
            buckets.bucket_rule(measures, th.floor),
            keys,
            [m.cost for m in measures],
            th.idle_reset_s,
            ttl_ms,
        ),
        outputStructType=T.StructType(fields),
        outputMode="append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


def stream_client_bans(
    requests: DataFrame, th: Thresholds, state_ttl_s: int | None = None
) -> DataFrame:
    hits = _stateful(requests, CLIENT_KEYS, th.client_measures, th, state_ttl_s)
    return buckets.ban_records(hits, th.client_measures, th)


def stream_path_bans(
    tracked: DataFrame, th: Thresholds, state_ttl_s: int | None = None
) -> DataFrame:
    hits = _stateful(tracked, PATH_KEYS, th.path_measures, th, state_ttl_s)
    return buckets.ban_records(hits, th.path_measures, th)


# Parts that the clients of one path are dealt into: a hot path is that many keys.
SIZE_PARTS = 16
_CARRIED = ["client_key", "url", "seq", "family", "time", "sent"]


def stream_sizes(requests: DataFrame, routes: DataFrame, lookups: DataFrame, ttl_s: int) -> DataFrame:
    """Requests with a route, with ``found``, ``is_dir`` and ``size`` of their path.

    ``lookups`` is a stream of ``path, size, is_dir, scanned_at`` (and ``error``), one row
    for every time a path was looked up: a size and its expiry are state of the path, so
    new answers reach the requests behind them, nothing is broadcast and the table of
    sizes may outgrow any executor.  Clients of a path are dealt into ``SIZE_PARTS`` parts,
    each with a copy of the path's one entry.
    """
    split = resolve.resolve_paths(requests, routes).filter(F.col("path").isNotNull())
    part = F.pmod(F.xxhash64("client_key"), F.lit(SIZE_PARTS)).cast("int")
    sec = F.unix_seconds("time")
    asked = split.select("path", part.alias("part"), F.lit(False).alias("lookup"), sec.alias("sec"), *_CARRIED)
    if "error" in lookups.columns:
        lookups = lookups.filter(~F.coalesce(F.col("error"), F.lit(False)))
    parts = F.explode(F.sequence(F.lit(0), F.lit(SIZE_PARTS - 1)))
    told = lookups.filter(F.col("path").isNotNull() & F.col("scanned_at").isNotNull()).select(
        "path",
        parts.alias("part"),
        F.lit(True).alias("lookup"),
        F.unix_seconds("scanned_at").alias("scanned"),
        F.coalesce("is_dir", F.lit(False)).alias("is_dir"),
        F.col("size").cast("bigint").alias("size"),
    )
    rows = asked.unionByName(told, allowMissingColumns=True)
    fields = [asked.schema[c] for c in _CARRIED]
    fields += [T.StructField("found", T.BooleanType()), T.StructField("is_dir", T.BooleanType()), T.StructField("size", T.LongType())]
    return rows.groupBy("path", "part").transformWithStateInPandas(
        processor.SizeProcessor(_CARRIED, ttl_s), outputStructType=T.StructType(fields), outputMode="append", timeMode="None"
    )


def _tracked(requests: DataFrame, routes: DataFrame, inventory: DataFrame, th: Thresholds) -> DataFrame:
    if not inventory.isStreaming:
        return resolve.trackable(resolve.resolve_sizes(requests, routes, inventory))
    sized = stream_sizes(requests, routes, inventory, th.size_ttl_s)
    found = F.when(F.col("found"), F.lit(True))
    outcome = resolve.size_outcome(F.col("url"), found, F.col("is_dir"), F.col("size"))
    return resolve.trackable(sized.withColumn("outcome", outcome))


def _now() -> datetime:
    return datetime.now(timezone.utc)


def detect_stream(
    lines: DataFrame,
    routes: DataFrame,
    inventory: DataFrame | FreshInventory,
    th: Thresholds,
    ban_table: BanTable,
    checkpoint: str,
    format: str = "nginx",
    envelope: str = "syslog",
    prune: bool = False,
    clock: Callable[[], datetime] = _now,
    trigger: dict | None = None,
    state_ttl_s: int | None = None,
):
    """Start the query: every request updates its client and its path bucket.

    Bans are appended per micro-batch under the batch id, so a replayed batch
    replaces itself.  A failing write stops the query; a restart replays the batch.
    ``state_ttl_s`` drops the state of keys not seen for so many seconds of processing
    time.  That changes results: a key that comes back starts afresh, also when the
    query itself was down for that long.  Without it state is kept for ever.
    ``inventory`` is a table, a ``FreshInventory`` or a stream of lookups (``stream_sizes``),
    the one that grows without bound.
    Limit the micro-batch size on the source (``maxFilesPerTrigger`` or
    ``maxOffsetsPerTrigger``): a client's part of one micro-batch is one group.
    """
    spark = lines.sparkSession
    use_rocksdb(spark)
    # no timers and no watermark here: a batch without data has nothing to do
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    requests = accepted(decode_lines(lines, format, envelope))
    fresh = inventory if isinstance(inventory, FreshInventory) else None
    files = fresh.frame if fresh else inventory
    tracked = _tracked(requests, routes, files, th)
    columns = ["seq", "kind", "prefix", "blame", "expires_at"]
    bans = (
        stream_client_bans(requests, th, state_ttl_s)
        .withColumn("kind", F.lit(0))
        .select(*columns)
        .unionByName(
            stream_path_bans(tracked, th, state_ttl_s).withColumn("kind", F.lit(1)).select(*columns)
        )
    )
    last_prune = clock()

    def store(batch: DataFrame, batch_id: int) -> None:
        nonlocal last_prune
        # before the append: the earlier batches are committed and will not replay, and
        # what an earlier attempt of this one may have left is dropped
        if prune and (clock() - last_prune).total_seconds() >= th.prune_interval_s:
            last_prune = clock()
            ban_table.prune(last_prune, in_flight=batch_id)
        ban_table.add(batch, batch_id)
        if fresh:
            fresh.refresh_if_due()

    writer = bans.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def quarantine_stream(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    format: str = "nginx",
    envelope: str = "syslog",
    trigger: dict | None = None,
):
    """Start the query that keeps rejected lines, one folder per reason."""
    rejects = rejected(decode_lines(lines, format, envelope))
    writer = rejects.writeStream.format("parquet").partitionBy("reject_reason")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
