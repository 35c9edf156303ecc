"""Counts about what is tracked and how size lookups end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakguard.schemas import BYTE_BLAME, RATIO_BLAME, REQUEST_BLAME


def tracking_stats(requests: DataFrame, tracked: DataFrame, bans: DataFrame) -> DataFrame:
    """One row: clients, client-paths, events and bans by blame.

    Distinct counts are taken in two grouped steps, each pre-aggregated before
    its shuffle, so that a hot client is only ever a partial count.
    """
    clients = (
        requests.groupBy("client_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count(F.lit(1)).alias("clients"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"))
    )
    paths = (
        tracked.groupBy("client_key", "url")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count(F.lit(1)).alias("client_paths"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("tracked_events"),
        )
    )
    by_blame = bans.agg(
        *[
            F.count_if(F.col("blame") == text).alias(name)
            for name, text in (
                ("request_bans", REQUEST_BLAME),
                ("byte_bans", BYTE_BLAME),
                ("ratio_bans", RATIO_BLAME),
            )
        ]
    )
    # three single-row frames
    one = F.lit(1).alias("_one")
    return (
        clients.select("*", one)
        .join(paths.select("*", one), "_one")
        .join(by_blame.select("*", one), "_one")
        .drop("_one")
    )


def index_stats(resolved: DataFrame) -> DataFrame:
    """Lookups by tag and outcome."""
    return resolved.groupBy("tag", "outcome").agg(F.count(F.lit(1)).alias("lookups"))
