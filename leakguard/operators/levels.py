"""Leaky-bucket levels without reset: running windows only.

Arrival order is ``seq``.  With ``h`` the running maximum of whole event
seconds, each event adds ``cost - leak * (h - previous h)``; the level is the
running sum of that, and the floored level subtracts the running minimum when
it is below zero.

A hot key is cut into spans of ``seq``.  What a span needs from the earlier
ones (running maximum, level, lowest level) is one *carry row* placed in front
of it, so the same windows serve ordinary and hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakguard.operators.skew import group_columns, split_hot
from leakguard.schemas import Measure, Thresholds

CLIENT_KEYS = ["client_key"]
PATH_KEYS = ["client_key", "url"]


def with_seconds(events: DataFrame) -> DataFrame:
    """Add the whole-second event time ``sec`` and the request cost ``one``."""
    return events.withColumn("sec", F.unix_seconds("time")).withColumn(
        "one", F.lit(1).cast("bigint")
    )


def exact_cost(m: Measure) -> Column:
    """A measure's cost, wide enough that no sum of any values runs over."""
    return F.col(m.cost) if m.cost == "one" else F.col(m.cost).cast("decimal(20,0)")


_LARGEST = (1 << 63) - 1


def held(level: Column) -> Column:
    """A level as a long; beyond what a long can hold it stays at the limit."""
    limit = F.lit(_LARGEST)
    return F.greatest(F.least(level, limit), -limit).cast("bigint")


def _order(by: list[str]) -> tuple:
    w = Window.partitionBy(*by).orderBy(F.col("seq").asc_nulls_first())
    return (
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        w.rowsBetween(Window.unboundedPreceding, -1),
    )


def _carry(parts: DataFrame, keys: list[str], measures: list[Measure]) -> DataFrame:
    """One row per later span of a hot key: ``sec`` and ``_in_<measure>``."""
    spans = (
        parts.filter(F.col("chunk") >= 0)
        .groupBy(*keys, "chunk")
        .agg(
            F.max("sec").alias("_max"),
            F.min_by("sec", "seq").alias("_first"),
            *[F.sum(exact_cost(m)).alias(f"_sum_{m.name}") for m in measures],
        )
    )
    w = Window.partitionBy(*keys).orderBy("chunk")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("sec", F.max("_max").over(past)).withColumn(
        "_start", F.first("_first").over(past)
    )
    return spans.select(
        *keys,
        "chunk",
        "sec",
        *[
            (F.sum(f"_sum_{m.name}").over(past) - F.lit(m.leak) * (F.col("sec") - F.col("_start"))).alias(
                f"_in_{m.name}"
            )
            for m in measures
        ],
    ).filter(F.col("sec").isNotNull())


def _joined(parts: DataFrame, carry: DataFrame) -> DataFrame:
    return parts.withColumn("_carry", F.lit(False)).unionByName(
        carry.withColumn("_carry", F.lit(True)), allowMissingColumns=True
    )


def _net_levels(rows: DataFrame, by: list[str], measures: list[Measure]) -> DataFrame:
    upto, before = _order(by)
    rows = rows.withColumn("_prev", F.max("sec").over(before)).withColumns(
        {
            "delta": F.greatest(F.coalesce(F.col("sec") - F.col("_prev"), F.lit(0)), F.lit(0)),
            "last_sec": F.greatest("_prev", "sec"),
        }
    )
    levels = {}
    for m in measures:
        net = exact_cost(m) - F.lit(m.leak) * F.col("delta")
        if f"_in_{m.name}" in rows.columns:
            net = F.when(F.col("_carry"), F.col(f"_in_{m.name}")).otherwise(net)
        levels[f"{m.name}_level"] = F.sum(net).over(upto)
    return rows.withColumns(levels) if levels else rows


def split_levels(
    parts: DataFrame,
    hot: bool,
    keys: list[str],
    measures: list[Measure],
    floor: bool = False,
) -> DataFrame:
    """Levels of a frame that went through ``split_hot``, wide enough for any sum."""
    by = group_columns(keys, hot)
    upto, _ = _order(by)
    if not hot:
        rows = _net_levels(parts, by, measures)
    else:
        carry = _carry(parts, keys, measures)
        rows = _net_levels(_joined(parts, carry), by, measures)
        if floor:
            lows = (
                rows.filter((F.col("chunk") >= 0) & ~F.col("_carry"))
                .groupBy(*by)
                .agg(*[F.min(f"{m.name}_level").alias(f"_low_{m.name}") for m in measures])
            )
            past = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(
                Window.unboundedPreceding, -1
            )
            lows = lows.select(
                *by,
                *[F.min(f"_low_{m.name}").over(past).alias(f"_min_{m.name}") for m in measures],
            )
            rows = _net_levels(_joined(parts, carry.join(lows, by)), by, measures)
    if floor:
        lowest = {}
        for m in measures:
            level = F.col(f"{m.name}_level")
            if hot:
                level = F.when(F.col("_carry"), F.col(f"_min_{m.name}")).otherwise(level)
            lowest[f"_lowest_{m.name}"] = F.min(level).over(upto)
        rows = rows.withColumns(lowest).withColumns(
            {
                f"{m.name}_level": F.col(f"{m.name}_level")
                - F.least(F.lit(0), F.col(f"_lowest_{m.name}"))
                for m in measures
            }
        )
    return rows.filter(~F.col("_carry")) if hot else rows


def _plain(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith("_") or c == "chunk"])


def elapsed_seconds(
    events: DataFrame, keys: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Running ``last_sec`` and the seconds each event lets leak (``delta``)."""
    keys = keys or CLIENT_KEYS
    parts, hot = split_hot(with_seconds(events), keys, limit)
    return _plain(split_levels(parts, hot, keys, [])).drop("one")


def sessions(
    events: DataFrame, keys: list[str], idle_s: int, limit: int | None = None
) -> DataFrame:
    """Add ``session``: a new one starts after a gap of more than ``idle_s``.

    The gap is measured from the latest second the key has shown so far.
    """
    parts, hot = split_hot(events, keys, limit)
    by = group_columns(keys, hot)
    upto, before = _order(by)
    rows = _joined(parts, _carry(parts, keys, [])) if hot else parts
    gap = F.col("sec") - F.col("_prev") > idle_s
    rows = rows.withColumn("_prev", F.max("sec").over(before)).withColumn(
        "_new", F.when(~F.col("_carry") & gap if hot else gap, 1).otherwise(0)
    )
    rows = rows.withColumn("session", F.sum("_new").over(upto))
    if hot:
        starts = rows.filter(F.col("chunk") >= 0).groupBy(*by).agg(F.sum("_new").alias("_n"))
        past = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(
            Window.unboundedPreceding, -1
        )
        shifts = starts.select(*by, F.sum("_n").over(past).alias("_shift"))
        rows = rows.filter(~F.col("_carry")).join(shifts, by, "left").withColumn(
            "session", F.col("session") + F.coalesce("_shift", F.lit(0))
        )
    return _plain(rows)


def bucket_levels(
    events: DataFrame,
    measures: list[Measure],
    keys: list[str] | None = None,
    floor: bool = False,
    idle_reset_s: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Events plus ``last_sec``, ``delta`` and one ``<measure>_level`` each."""
    keys = keys or CLIENT_KEYS
    events = with_seconds(events)
    if idle_reset_s is not None:
        events = sessions(events, keys, idle_reset_s, limit)
        keys = [*keys, "session"]
    parts, hot = split_hot(events, keys, limit)
    rows = _plain(split_levels(parts, hot, keys, measures, floor)).drop("one")
    return rows.withColumns({f"{m.name}_level": held(F.col(f"{m.name}_level")) for m in measures})


def client_levels(requests: DataFrame, th: Thresholds, **options) -> DataFrame:
    options.setdefault("floor", th.floor)
    return bucket_levels(requests, th.client_measures, CLIENT_KEYS, **options)


def path_levels(tracked: DataFrame, th: Thresholds, **options) -> DataFrame:
    options.setdefault("floor", th.floor)
    return bucket_levels(tracked, th.path_measures, PATH_KEYS, **options)


def overflow_events(levels: DataFrame, measures: list[Measure]) -> DataFrame:
    """Events whose level is above the volume; the first measure names the blame."""
    over = [F.col(f"{m.name}_level") > m.volume for m in measures]
    blame = F.coalesce(*[F.when(o, F.lit(m.blame)) for o, m in zip(over, measures)])
    return levels.withColumn("blame", blame).filter(F.col("blame").isNotNull())


def first_overflow(
    levels: DataFrame, measures: list[Measure], keys: list[str] | None = None
) -> DataFrame:
    """Earliest overflow event of each key."""
    keys = keys or CLIENT_KEYS
    return (
        overflow_events(levels, measures)
        .groupBy(*keys)
        .agg(
            F.min("seq").alias("seq"),
            F.min_by("time", "seq").alias("time"),
            F.min_by("blame", "seq").alias("blame"),
            *[F.min_by(f"{m.name}_level", "seq").alias(f"{m.name}_level") for m in measures],
        )
    )
