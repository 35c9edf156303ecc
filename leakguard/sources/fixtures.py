"""Access-log inputs derived from the given ``events`` and ``pages`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakguard.functions.net import address_family, address_key
from leakguard.functions.paths import url_tag
from leakguard.schemas import REQUEST_COLUMNS, Thresholds

PROFILE = Thresholds(
    request_leak=1,
    request_volume=3,
    byte_leak=40_000,
    byte_volume=200_000,
    ratio_leak=40_000,
    ratio_volume=8_000_000,
)
IDLE_RESET_S = 4
NOW = "2024-01-02 00:00:30"
EPOCH_S = 1_704_067_200  # 2024-01-01 00:00:00 UTC
# Seconds of the event table that make one second of a request: the real gaps are too
# long to fill a bucket.
PACE_S = 12 * 3600
PAGES_PER_USER = 5
_PATH_RE = "^[a-z]+://[^/]+(/[^?#]*)"
_HOST_RE = "^[a-z]+://([^/]+)"


# Given schemas spare a metadata job per read.
_TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "pages": "page_id bigint, url string, html string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        f"regexp_extract(url, '{_PATH_RE}', 1) as url",
        f"regexp_extract(url, '{_HOST_RE}', 1) as host",
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the record fields they stand for, joined to their page.

    Every user is a client; three of eight have an IPv6 address.  A user visits a few of
    all pages; an event without a page keeps empty texts.
    """
    pages = page_paths(spark, sf_dir)
    ev = _table(spark, sf_dir, "events").selectExpr(
        "event_id as seq",
        "user_id as u",
        f"unix_seconds(cast(ts as timestamp)) div {PACE_S} - {EPOCH_S // PACE_S} + {EPOCH_S} as epoch_s",
        "event_id % 1000 as ms",
        "if(user_id % 8 < 5, "
        "concat_ws('.', '10', user_id div 256 % 256, user_id % 256, 7 + user_id div 65536 % 240), "
        "concat('2001:db8:', lower(hex(user_id % 65536)), ':', lower(hex(user_id div 65536)), '::1')) as client",
        "case when event_type in ('click', 'view') then 'GET' when event_type = 'purchase' then 'POST' "
        "when event_type = 'signup' then 'PUT' else 'HEAD' end as method",
        "if(event_type = 'error', 500, 200) as status",
        "cast(round(value * 1000) as bigint) as sent",
        "cast(get_json_object(props, '$.k') as bigint) as k",
    )
    count = pages.select(F.max("page_id") + 1).scalar()
    ev = ev.withColumn("page_id", (F.col("u") * 7 + F.col("k") % PAGES_PER_USER * 37) % count)
    return ev.join(pages, "page_id", "left").selectExpr(
        "* except (url, host)",
        "coalesce(url, '') as url",
        "coalesce(host, '') as host",
        "concat('agent-', k % 7) as agent",
    )


def requests(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    """Typed requests; ``late`` moves some events back by five seconds."""
    sec = _LATE_S if late else "epoch_s"
    typed = _events(spark, sf_dir).selectExpr(
        "*",
        f"timestamp_micros({sec} * 1000000 + ms * 1000) as time",
        "'203.0.113.1' as server",
        "k * 1000 as duration_us",
    )
    return typed.withColumns(
        {"client_key": address_key("client"), "family": address_family("client")}
    ).select(*REQUEST_COLUMNS)


_LATE_S = "if(seq % 50 = 7, epoch_s - 5, epoch_s)"
_TIME_TEXT = "concat(epoch_s, '.', lpad(ms, 3, '0'))"
_DURATION_TEXT = "concat('0.', lpad(k, 3, '0'))"


def _json_line(time: str, client: str, duration: str) -> str:
    return (
        f"to_json(struct({time} as time, {client} as client, '203.0.113.1' as server, method, url, "
        f"status, sent, {duration} as duration, host, agent))"
    )


def clean_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq`` and the JSON record of every event, as the web server writes it."""
    return _events(spark, sf_dir).selectExpr(
        "seq", f"{_json_line(_TIME_TEXT, 'client', _DURATION_TEXT)} as line"
    )


def dirty_lines(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    """``seq`` and a syslog line per event; the first matching damage applies.

    ``late`` moves some events back by five seconds.
    """
    time = _TIME_TEXT.replace("epoch_s", _LATE_S) if late else _TIME_TEXT
    body = _json_line(
        f"if(damage = 'time', 'abc', {time})",
        "if(damage = 'client', '999.1.1.1', client)",
        f"if(damage = 'duration', 'x', {_DURATION_TEXT})",
    )
    damaged = _events(spark, sf_dir).selectExpr(
        "*",
        "case when seq % 97 = 0 then 'json' when seq % 101 = 0 then 'client' "
        "when seq % 103 = 0 then 'time' when seq % 107 = 0 then 'duration' else '' end as damage",
    )
    return damaged.selectExpr(
        "seq",
        "concat(if(seq % 2 = 1, '<134>Jan  1 00:00:00 edge nginx: ', "
        "'<134>1 2024-01-01T00:00:00Z edge nginx - - - '), "
        f"if(damage = 'json', 'not json', {body})) as line",
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root per tag seen in the pages; ``de`` is left without one."""
    tags = page_paths(spark, sf_dir).select(url_tag(F.col("url")).alias("tag")).distinct()
    return tags.filter(F.col("tag") != "de").select(
        "tag",
        F.concat(F.lit("/data/"), "tag", F.when(F.col("tag") == "fr", "/").otherwise("")).alias("root"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique by path: size, directory flag and scan time; some sizes unknown, some zero."""
    pages = _table(spark, sf_dir, "pages")
    by_path = (
        pages.select(
            F.regexp_extract("url", _PATH_RE, 1).alias("url"),
            F.octet_length("html").cast("bigint").alias("bytes"),
            "page_id",
        )
        .groupBy("url")
        .agg(F.max("bytes").alias("size"), F.min("page_id").alias("pid"))
    )
    return by_path.filter(F.col("pid") % 20 != 0).select(
        F.concat(F.lit("/data"), "url").alias("path"),
        F.when(F.col("pid") % 23 == 6, 0).when(F.col("pid") % 21 != 5, F.col("size")).alias("size"),
        (F.col("pid") % 33 == 7).alias("is_dir"),
        F.timestamp_seconds(F.lit(EPOCH_S)).alias("scanned_at"),
    )


def size_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lookup per page, spread over ten hours, some of them failed."""
    pages = _table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    return pages.select(
        F.concat(F.lit("/data"), F.regexp_extract("url", _PATH_RE, 1)).alias("path"),
        F.when((pid % 20 == 0) | (pid % 33 == 7), F.lit(None))
        .otherwise(F.octet_length("html"))
        .cast("bigint")
        .alias("size"),
        (pid % 33 == 7).alias("is_dir"),
        F.timestamp_seconds(F.lit(EPOCH_S) + (pid * 7919) % 36000).alias("scanned_at"),
        (pid % 17 == 3).alias("error"),
    )


def manual_ban_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hand-written ban record per page, as JSON; some are unusable."""
    pages = _table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    third = (pid % 256).cast("string")
    prefix = (
        F.when(pid % 10 == 3, "invalid Prefix")
        .when(pid % 10 == 1, F.concat(F.lit("192.0."), third, F.lit(".0/25")))
        .otherwise(F.concat(F.lit("192.0."), third, F.lit(".0/24")))
    )
    expires = F.concat(
        F.lit("2024-01-02T00:"), F.lpad((pid % 60).cast("string"), 2, "0"), F.lit(":00Z")
    )
    return pages.select(
        pid.alias("seq"),
        F.when(pid % 11 == 5, "{bad")
        .otherwise(
            F.to_json(
                F.struct(
                    (pid + 1000).alias("id"),
                    prefix.alias("prefix"),
                    F.lit("manual").alias("blame"),
                    expires.alias("expires_at"),
                )
            )
        )
        .alias("line"),
    )
