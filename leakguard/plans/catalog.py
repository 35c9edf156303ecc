"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakguard.functions.fields import epoch_time, seconds_to_us
from leakguard.functions.net import ban_prefix
from leakguard.functions.paths import url_rest, url_tag
from leakguard.operators import bans as ban_ops
from leakguard.operators import buckets, cidr, levels, resolve, stats
from leakguard.operators.skew import ensure_checkpoint_dir
from leakguard.plans import rules as rule_ops
from leakguard.sources import fixtures as fx
from leakguard.sources import landing
from leakguard.sources import lines as line_ops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TH = fx.PROFILE


def query(fn: Callable[[SparkSession, str], DataFrame]):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the tables' times carry no zone; everything is read as UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _key():
    return F.lower(F.hex("client_key")).alias("client_key")


def _us(name: str):
    return F.unix_micros(name).alias(name.split("_")[0] + "_us")


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.trackable(_resolved(spark, sf_dir))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_sizes(
        fx.requests(spark, sf_dir), fx.routes(spark, sf_dir), fx.inventory(spark, sf_dir)
    )


def _client(spark, sf_dir, **options) -> DataFrame:
    return buckets.client_bans(fx.requests(spark, sf_dir), TH, **options)


def _path(spark, sf_dir, **options) -> DataFrame:
    return buckets.path_bans(_tracked(spark, sf_dir), TH, **options)


def _manual(spark, sf_dir) -> DataFrame:
    return ban_ops.manual_bans(fx.manual_ban_lines(spark, sf_dir))[0]


def _stored_manual(spark, sf_dir) -> DataFrame:
    """Manual records as another writer stored them: prefixes unchecked."""
    spec = "prefix string, blame string, expires_at string"
    return (
        fx.manual_ban_lines(spark, sf_dir)
        .select("seq", F.from_json("line", spec).alias("r"))
        .filter("r.prefix is not null")
        .select("seq", "r.prefix", "r.blame", F.col("r.expires_at").try_cast("timestamp").alias("expires_at"))
    )


def _every_ban(spark, sf_dir) -> DataFrame:
    return ban_ops.all_bans(
        _client(spark, sf_dir), _path(spark, sf_dir), _stored_manual(spark, sf_dir)
    )


def _numbered(spark, sf_dir) -> DataFrame:
    return ban_ops.number_bans(_client(spark, sf_dir), _path(spark, sf_dir))


# --- lines and records -----------------------------------------------------


@query
def log_lines_scan(spark, sf_dir):
    """Raw lines in files, numbered on landing in the order of the files."""
    folder = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    raw = fx.dirty_lines(spark, sf_dir).repartitionByRange("seq").sortWithinPartitions("seq")
    raw.select("line").write.text(f"{folder}/raw")
    landing.land_lines(spark, f"{folder}/raw", f"{folder}/landed")
    return line_ops.read_log_lines(spark, f"{folder}/landed", format="parquet")


@query
def syslog_unpack(spark, sf_dir):
    return line_ops.unpack_syslog(fx.dirty_lines(spark, sf_dir)).select("seq", "body")


@query
def parsed_requests(spark, sf_dir):
    requests, _ = line_ops.parse_lines(fx.dirty_lines(spark, sf_dir))
    return requests.select(
        "seq", _us("time"), "client", _key(), "family", "server", "method", "url",
        "status", "sent", "duration_us", "host", "agent",
    )


@query
def rejected_lines(spark, sf_dir):
    _, rejects = line_ops.parse_lines(fx.dirty_lines(spark, sf_dir))
    return rejects.select("seq", "reject_reason", "head")


def _raw_fields(spark, sf_dir):
    bodies = line_ops.unpack_syslog(fx.dirty_lines(spark, sf_dir))
    return bodies.select(
        "seq",
        F.get_json_object("body", "$.time").alias("time_text"),
        F.get_json_object("body", "$.duration").alias("duration_text"),
    )


@query
def parsed_time(spark, sf_dir):
    rows = _raw_fields(spark, sf_dir).withColumn("time", epoch_time(F.col("time_text")))
    return rows.select("seq", "time_text", _us("time"))


@query
def parsed_duration(spark, sf_dir):
    return _raw_fields(spark, sf_dir).select(
        "seq", "duration_text", seconds_to_us(F.col("duration_text")).alias("duration_us")
    )


# --- addresses and prefixes ------------------------------------------------


@query
def client_keys(spark, sf_dir):
    seen = fx.requests(spark, sf_dir).groupBy("client", "client_key", "family").agg(
        F.count(F.lit(1)).alias("requests")
    )
    return seen.select("client", _key(), "family", "requests")


@query
def ban_prefixes(spark, sf_dir):
    prefix = ban_prefix("client_key", "family", TH.v4_prefix, TH.v6_prefix)
    return fx.requests(spark, sf_dir).select("seq", "client", prefix.alias("prefix"))


@query
def valid_prefixes(spark, sf_dir):
    return ban_ops.valid_prefixes(_stored_manual(spark, sf_dir)).select("seq", "prefix")


@query
def prefix_ranges(spark, sf_dir):
    distinct = _every_ban(spark, sf_dir).select("prefix").distinct()
    return cidr.prefix_ranges(distinct).select("prefix", "family", "lo", "hi")


@query
def merged_ranges(spark, sf_dir):
    return cidr.merge_ranges(cidr.prefix_ranges(_every_ban(spark, sf_dir).select("prefix").distinct()))


@query
def minimal_prefixes(spark, sf_dir):
    return cidr.minimal_prefixes(_every_ban(spark, sf_dir)).select("family", "prefix")


# --- routes and files ------------------------------------------------------


@query
def routes_normalized(spark, sf_dir):
    return resolve.normalize_routes(fx.routes(spark, sf_dir))


@query
def file_inventory(spark, sf_dir):
    return fx.inventory(spark, sf_dir).select("path", "size", "is_dir", _us("scanned_at"))


@query
def url_route_parts(spark, sf_dir):
    pages = fx.page_paths(spark, sf_dir)
    return pages.select(
        "page_id", "url", url_tag(F.col("url")).alias("tag"), url_rest(F.col("url")).alias("rest")
    )


@query
def resolved_paths(spark, sf_dir):
    return resolve.resolve_paths(
        fx.requests(spark, sf_dir), fx.routes(spark, sf_dir)
    ).select("seq", "url", "tag", "path")


@query
def size_outcomes(spark, sf_dir):
    return _resolved(spark, sf_dir).select("seq", "path", "outcome", "size")


@query
def trackable_requests(spark, sf_dir):
    return _tracked(spark, sf_dir).select("seq", "path", "size")


@query
def untracked_requests(spark, sf_dir):
    return resolve.untracked(
        fx.requests(spark, sf_dir), fx.routes(spark, sf_dir), fx.inventory(spark, sf_dir)
    ).select("seq", "path")


@query
def file_ratio_cost(spark, sf_dir):
    return _tracked(spark, sf_dir).select("seq", "sent", "size", "ratio_cost")


@query
def fresh_sizes(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(fx.EPOCH_S + 36_000))
    return resolve.fresh_sizes(fx.size_snapshots(spark, sf_dir), now, TH.size_ttl_s).select(
        "path", "size", "is_dir", _us("scanned_at")
    )


# --- levels ----------------------------------------------------------------


@query
def elapsed_seconds(spark, sf_dir):
    return levels.elapsed_seconds(fx.requests(spark, sf_dir, late=True)).select(
        "seq", _key(), "last_sec", "delta"
    )


def _client_level(spark, sf_dir, floor, name):
    wanted = [m for m in TH.client_measures if m.name == name]
    lv = levels.bucket_levels(fx.requests(spark, sf_dir), wanted, floor=floor)
    return lv.select("seq", _key(), f"{name}_level")


@query
def request_levels(spark, sf_dir):
    return _client_level(spark, sf_dir, False, "request")


@query
def byte_levels(spark, sf_dir):
    return _client_level(spark, sf_dir, False, "byte")


@query
def request_levels_floored(spark, sf_dir):
    return _client_level(spark, sf_dir, True, "request")


@query
def byte_levels_floored(spark, sf_dir):
    return _client_level(spark, sf_dir, True, "byte")


@query
def ratio_levels(spark, sf_dir):
    return levels.path_levels(_tracked(spark, sf_dir), TH).select(
        "seq", _key(), "url", "ratio_level"
    )


def _client_levels(spark, sf_dir):
    return levels.client_levels(fx.requests(spark, sf_dir), TH)


@query
def overflow_events(spark, sf_dir):
    return levels.overflow_events(_client_levels(spark, sf_dir), TH.client_measures).select(
        "seq", _key(), "blame", "request_level", "byte_level"
    )


@query
def first_overflow(spark, sf_dir):
    return levels.first_overflow(_client_levels(spark, sf_dir), TH.client_measures).select(
        _key(), "seq", _us("time"), "blame", "request_level", "byte_level"
    )


# --- bans ------------------------------------------------------------------


def _client_rows(bans):
    return bans.select("seq", _key(), "prefix", "blame", _us("expires_at"))


def _path_rows(bans):
    return bans.select("seq", _key(), "url", "prefix", "blame", _us("expires_at"))


@query
def client_bans(spark, sf_dir):
    return _client_rows(_client(spark, sf_dir))


@query
def client_bans_floored(spark, sf_dir):
    return _client_rows(_client(spark, sf_dir, floor=True))


@query
def client_bans_idle_reset(spark, sf_dir):
    return _client_rows(_client(spark, sf_dir, idle_reset_s=fx.IDLE_RESET_S))


@query
def path_bans(spark, sf_dir):
    return _path_rows(_path(spark, sf_dir))


@query
def path_bans_floored(spark, sf_dir):
    return _path_rows(_path(spark, sf_dir, floor=True))


@query
def client_bucket_state(spark, sf_dir):
    return buckets.client_state(fx.requests(spark, sf_dir), TH).select(
        _key(), "requests", "bytes", "last_sec"
    )


@query
def path_bucket_state(spark, sf_dir):
    return buckets.path_state(_tracked(spark, sf_dir), TH).select(
        _key(), "url", "ratio", "last_sec"
    )


@query
def manual_bans(spark, sf_dir):
    return _manual(spark, sf_dir).select("seq", "prefix", "blame", _us("expires_at"))


@query
def all_bans(spark, sf_dir):
    return _every_ban(spark, sf_dir).select("prefix", "blame", _us("expires_at"))


@query
def active_bans(spark, sf_dir):
    return ban_ops.active_bans(_every_ban(spark, sf_dir), fx.NOW).select(
        "prefix", "blame", _us("expires_at")
    )


@query
def pruned_bans(spark, sf_dir):
    """Through the ban table: added, some deleted, then pruned."""
    table = ban_ops.BanTable(spark, f"{ensure_checkpoint_dir(spark)}/bans-{uuid.uuid4().hex}")
    feeds = _client(spark, sf_dir).withColumn("kind", F.lit(0))
    table.add(feeds.unionByName(_path(spark, sf_dir).withColumn("kind", F.lit(1)), allowMissingColumns=True), 0)
    table.delete(table.records().filter("id % 7 = 0"))
    table.prune(fx.NOW)
    return table.records().select("id", "prefix", "blame", _us("expires_at"))


@query
def invalid_bans(spark, sf_dir):
    """How many stored records are skipped for their prefix."""
    return ban_ops.count_invalid(_stored_manual(spark, sf_dir))


@query
def bans_with_ids(spark, sf_dir):
    return _numbered(spark, sf_dir).select(
        "id", "seq", "kind", "prefix", "blame", _us("expires_at")
    )


@query
def bans_after_delete(spark, sf_dir):
    """Every seventh record is deleted; so is id 0, which does not exist."""
    records = _numbered(spark, sf_dir)
    deleted = records.filter(F.col("id") % 7 == 0).select("id").unionByName(
        spark.range(1).select(F.col("id"))
    )
    return ban_ops.without_deleted(records, deleted).select(
        "id", "prefix", "blame", _us("expires_at")
    )


# --- rules and statistics --------------------------------------------------


def _rules(spark, sf_dir):
    return rule_ops.compile_rules(_every_ban(spark, sf_dir), fx.NOW, TH.dst_ports)


@query
def ban_rules(spark, sf_dir):
    return _rules(spark, sf_dir).select(
        F.concat_ws(",", "prefixes").alias("prefixes"),
        F.concat_ws(",", F.col("dst_ports").cast("array<string>")).alias("dst_ports"),
    )


@query
def rules_json(spark, sf_dir):
    return rule_ops.rules_json(_rules(spark, sf_dir))


@query
def tracking_stats(spark, sf_dir):
    return stats.tracking_stats(
        fx.requests(spark, sf_dir),
        _tracked(spark, sf_dir),
        ban_ops.all_bans(_client(spark, sf_dir), _path(spark, sf_dir)),
    )


@query
def index_stats(spark, sf_dir):
    return stats.index_stats(_resolved(spark, sf_dir))
