"""Routes, file sizes and what makes a request trackable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakguard.functions.paths import (
    SIZE,
    ratio_cost,
    size_outcome,
    trim_root,
    url_rest,
    url_tag,
)
from leakguard.operators.skew import lookup_join


def normalize_routes(routes: DataFrame) -> DataFrame:
    return routes.select("tag", trim_root(F.col("root")).alias("root"))


def resolve_paths(requests: DataFrame, routes: DataFrame, **options) -> DataFrame:
    """Add ``tag`` and ``path``; ``path`` is NULL without a route."""
    split = requests.withColumn("tag", url_tag(F.col("url"))).withColumn(
        "_rest", url_rest(F.col("url"))
    )
    return (
        lookup_join(split, normalize_routes(routes), "tag", **options)
        .withColumn("path", F.concat("root", "_rest"))
        .drop("root", "_rest")
    )


def resolve_sizes(
    requests: DataFrame, routes: DataFrame, inventory: DataFrame, **options
) -> DataFrame:
    """Add ``tag``, ``path``, ``size`` and ``outcome``.

    ``inventory`` is unique by ``path`` (see ``fresh_sizes``).
    """
    files = inventory.select(
        "path", F.col("size").alias("size"), F.col("is_dir").alias("_dir"), F.lit(True).alias("_found")
    )
    found = lookup_join(resolve_paths(requests, routes, **options), files, "path", **options)
    return found.withColumn(
        "outcome",
        size_outcome(F.col("path"), F.col("_found"), F.col("_dir"), F.col("size")),
    ).drop("_dir", "_found")


def trackable(resolved: DataFrame) -> DataFrame:
    """Requests with a usable file size, with their ``ratio_cost``."""
    return resolved.filter(F.col("outcome") == SIZE).withColumn(
        "ratio_cost", ratio_cost(F.col("sent"), F.col("size"))
    )


def untracked(
    requests: DataFrame, routes: DataFrame, inventory: DataFrame, **options
) -> DataFrame:
    """Requests without a usable file size: the complement of ``trackable``."""
    usable = inventory.filter(~F.col("is_dir") & (F.col("size") > 0)).select("path")
    return lookup_join(
        resolve_paths(requests, routes, **options), usable, "path", how="left_anti", **options
    )


def fresh_sizes(snapshots: DataFrame, now, ttl_s: int) -> DataFrame:
    """Latest reusable lookup per path.

    ``snapshots`` has ``path, size, is_dir, scanned_at`` plus an optional
    ``error`` flag.  A missing file (``size`` NULL) and a directory are answers
    and stay reusable; an error is not an answer.
    """
    usable = snapshots
    if "error" in snapshots.columns:
        usable = usable.filter(~F.coalesce(F.col("error"), F.lit(False)))
    expires = F.unix_seconds("scanned_at") + F.lit(ttl_s)
    usable = usable.filter(expires >= F.unix_seconds(F.lit(now).cast("timestamp")))
    latest = usable.groupBy("path").agg(
        # of equal times the larger entry, nulls last: the answer is the same every time
        F.max_by(F.struct("size", "is_dir"), F.struct("scanned_at", "is_dir", "size")).alias("_last"),
        F.max("scanned_at").alias("scanned_at"),
    )
    return latest.select("path", "_last.size", "_last.is_dir", "scanned_at")
