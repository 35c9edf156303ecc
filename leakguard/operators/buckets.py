"""Buckets that are dropped on overflow: ban events and live bucket state.

Plan for ordinary keys: one shuffle by key, one sort, a window prefilter in the
JVM, and the bucket rule over Arrow batches of the keys that can overflow.

A hot key is cut into spans.  One that never overflows without a reset cannot reset
and needs no state run.  The others are followed by next-overflow links (``links``).  With
a floor, spans run in parallel instead, each from the guess that it starts fresh; spans
whose guess differs from what the span before them left behind run again until all
agree.  Agreement from the first span on is the sequential result, so the answer is
exact.  A floor makes levels forget, so guesses agree soon; spans are widened while they
disagree, which ends the loop at one span per key in the worst case.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakguard.functions.net import ban_prefix
from leakguard.operators import kernel, links
from leakguard.operators.levels import (
    CLIENT_KEYS,
    PATH_KEYS,
    exact_cost,
    sessions,
    split_levels,
    with_seconds,
)
from leakguard.operators.skew import group_columns, materialize, split_hot
from leakguard.schemas import Measure, Thresholds

# Executors need no copy of this package: the bucket rule travels with the task.
cloudpickle.register_pickle_by_value(kernel)

_WIDEN = 4
_ROUNDS_BEFORE_WIDENING = 2


def bucket_rule(measures: list[Measure], floor: bool) -> kernel.Rule:
    return kernel.Rule(
        leak=tuple(m.leak for m in measures),
        volume=tuple(m.volume for m in measures),
        ban_us=tuple(m.ban_s * kernel.US for m in measures),
        floor=floor,
    )


def narrow_events(events: DataFrame, keys: list[str], measures: list[Measure]) -> DataFrame:
    """Only what the bucket rule reads."""
    costs = [F.col(m.cost).cast("bigint").alias(m.cost) for m in measures]
    return with_seconds(events).select(
        *keys, "seq", "family", "sec", F.unix_micros("time").alias("time_us"), *costs
    )


def _state_fields(prefix: str, measures: list[Measure]) -> list[T.StructField]:
    names = [f"{prefix}_last", *[f"{prefix}_{i}" for i in range(len(measures))]]
    return [T.StructField(n, T.LongType()) for n in names]


def _arrival() -> list[Column]:
    """A carry row first, then the events; a row without a carry flag is an event."""
    return [F.desc_nulls_last("carried"), F.col("seq").asc_nulls_first()]


def _sorted(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions(*by, *_arrival())


def _run(rows: DataFrame, by: list[str], measures: list[Measure], floor: bool, emit: str):
    """Apply the bucket rule to sorted rows."""
    kept = [*by, "seq", "family"]
    fields = [rows.schema[k] for k in (kept if emit == "bans" else by)]
    if emit == "bans":
        fields += [T.StructField("measure", T.IntegerType()), T.StructField("expires_us", T.LongType())]
    else:
        fields += _state_fields("out", measures)
    mapper = kernel.bucket_mapper(
        bucket_rule(measures, floor), by, [m.cost for m in measures], kept, emit
    )
    return rows.mapInArrow(mapper, T.StructType(fields))


def _state(prefix: str, measures: list[Measure]):
    """State columns as one struct, NULL for a fresh bucket."""
    names = [f"{prefix}_last", *[f"{prefix}_{i}" for i in range(len(measures))]]
    return F.when(
        F.col(names[0]).isNotNull(),
        F.struct(*[F.col(n).alias(n[len(prefix) + 1 :]) for n in names]),
    )


def _carry_rows(spans: DataFrame, by: list[str], column: str, measures: list[Measure]) -> DataFrame:
    names = ["last", *[str(i) for i in range(len(measures))]]
    states = [F.col(f"{column}.`{n}`").alias(f"in_{n}") for n in names]
    return spans.select(*by, F.lit(True).alias("carried"), *states)


def _no_carry(rows: DataFrame, measures: list[Measure]) -> DataFrame:
    rows = rows.withColumn("carried", F.lit(False))
    for f in _state_fields("in", measures):
        rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    return rows


def _with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    return rows.unionByName(carry, allowMissingColumns=True)


def _settle(
    rows: DataFrame, keys: list[str], measures: list[Measure], floor: bool
) -> tuple[DataFrame, DataFrame]:
    """Find every hot span's starting state.

    Returns the rows with their final ``chunk`` and the spans with ``before``
    and ``after`` states.
    """
    by = [*keys, "chunk"]
    staged = materialize(rows)

    def states(part: DataFrame) -> DataFrame:
        ran = _run(_sorted(part, by), by, measures, floor, "states")
        return ran.select(*by, _state("out", measures).alias("after"))

    first = states(_no_carry(staged, measures))
    shape = first.schema["after"].dataType
    spans = materialize(
        first.select(*by, F.lit(None).cast(shape).alias("before"), "after", F.lit(False).alias("stale"))
    )
    along = Window.partitionBy(*keys).orderBy("chunk")
    rounds = 0
    while True:
        checked = spans.withColumn("want", F.lag("after").over(along)).withColumn(
            "dirty", F.col("stale") | ~F.col("want").eqNullSafe(F.col("before"))
        )
        if checked.filter("dirty").isEmpty():
            return staged, spans.select(*by, "before", "after")
        rounds += 1
        if rounds > _ROUNDS_BEFORE_WIDENING:
            wide = F.expr(f"chunk div {_WIDEN}")
            staged = staged.withColumn("chunk", wide)
            first_of = F.row_number().over(Window.partitionBy(*keys, wide).orderBy("chunk")) == 1
            merged = checked.withColumn("_inner", F.col("dirty") & ~first_of)
            spans = (
                merged.withColumn("_wide", wide)
                .groupBy(*keys, "_wide")
                .agg(
                    F.min_by("before", "chunk").alias("before"),
                    F.max_by("after", "chunk").alias("after"),
                    (F.bool_or("_inner") | F.min_by("stale", "chunk")).alias("stale"),
                )
                .withColumnRenamed("_wide", "chunk")
            )
            checked = spans.withColumn("want", F.lag("after").over(along)).withColumn(
                "dirty", F.col("stale") | ~F.col("want").eqNullSafe(F.col("before"))
            )
        checked = materialize(checked)
        redo = checked.filter("dirty").select(*by, "want")
        again = states(
            _with_carry(
                staged.join(redo.select(*by), by, "left_semi"),
                _carry_rows(redo, by, "want", measures),
            )
        )
        fixed = redo.withColumnRenamed("want", "before").join(again, by)
        spans = materialize(
            checked.filter(~F.col("dirty"))
            .select(*by, "before", "after")
            .unionByName(fixed)
            .withColumn("stale", F.lit(False))
        )


def _overflows(levels: DataFrame, measures: list[Measure]) -> Column:
    over = F.lit(False)
    for m in measures:
        over = over | (F.col(f"{m.name}_level") > m.volume)
    return over


def _candidates(
    rows: DataFrame, keys: list[str], measures: list[Measure], floor: bool
) -> DataFrame:
    """Drop keys whose level never passes a volume; they cannot reset."""
    levels = split_levels(rows, False, keys, measures, floor)
    levels = levels.withColumn("_over", F.max(_overflows(levels, measures)).over(Window.partitionBy(*keys)))
    return levels.filter("_over").select(*rows.columns)


def _can_reset(
    rows: DataFrame, keys: list[str], measures: list[Measure], floor: bool
) -> DataFrame | None:
    """Rows of hot keys with a level above a volume; None if there is no such key."""
    levels = split_levels(rows, True, keys, measures, floor)
    over = materialize(levels.filter(_overflows(levels, measures)).select(*keys).distinct())
    return None if over.isEmpty() else rows.join(over, keys, "left_semi")


def _hot_spans(
    rows: DataFrame, keys: list[str], measures: list[Measure], floor: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows to run, spans, ends)`` of hot keys that can reset.

    The rows of each span to run, with the state ``before`` it, and per key the state
    ``after`` its last event.
    """
    by = [*keys, "chunk"]
    if floor:
        staged, spans = _settle(rows, keys, measures, floor)
        return staged, spans, spans.groupBy(*keys).agg(F.max_by("after", "chunk").alias("after"))
    staged = materialize(rows)
    starts, ends = links.follow(staged, bucket_rule(measures, floor), keys, measures)
    held = F.when(
        ~F.col("fresh"),
        F.struct("last", *[F.col(f"level_{i}").alias(str(i)) for i in range(len(measures))]),
    )
    spans = starts.select(*by, held.alias("before"))
    return staged.join(spans.select(*by), by, "left_semi"), spans, ends.select(*keys, held.alias("after"))


def _unreset(rows: DataFrame, keys: list[str], measures: list[Measure]) -> DataFrame:
    """State of keys that never reset (no floor): sums are enough."""
    total = rows.groupBy(*keys).agg(
        F.max("sec").alias("last"),
        F.min_by("sec", F.struct("seq")).alias("_first"),
        *[F.sum(exact_cost(m)).alias(f"_sum_{i}") for i, m in enumerate(measures)],
    )
    levels = [
        links.stored(F.col(f"_sum_{i}") - F.lit(m.leak) * (F.col("last") - F.col("_first"))).alias(str(i))
        for i, m in enumerate(measures)
    ]
    return total.select(*keys, F.struct("last", *levels).alias("after"))


def _prepare(
    events: DataFrame,
    keys: list[str],
    measures: list[Measure],
    idle_reset_s: int | None,
    limit: int | None,
) -> tuple[DataFrame, bool, list[str]]:
    rows = narrow_events(events, keys, measures)
    if idle_reset_s is not None:
        rows = sessions(rows, keys, idle_reset_s, limit)
        keys = [*keys, "session"]
    parts, hot = split_hot(rows, keys, limit)
    return parts, hot, keys


def bucket_bans(
    events: DataFrame,
    keys: list[str],
    measures: list[Measure],
    floor: bool = False,
    idle_reset_s: int | None = None,
    prefilter: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Ban events: keys, ``seq``, ``family``, ``measure`` and ``expires_us``."""
    rows, hot, by_key = _prepare(events, keys, measures, idle_reset_s, limit)
    by = group_columns(by_key, hot)
    if hot:
        crowded = _can_reset(rows.filter(F.col("chunk") >= 0), by_key, measures, floor)
        rows = rows.filter(F.col("chunk") < 0)
        if prefilter:
            rows = _candidates(rows, by_key, measures, floor)
        if crowded is None:
            rows = _no_carry(rows, measures)
        else:
            staged, spans, _ = _hot_spans(crowded, by_key, measures, floor)
            rows = _with_carry(
                rows.unionByName(staged), _carry_rows(spans, by, "before", measures)
            )
    elif prefilter:
        rows = _no_carry(_candidates(rows, by_key, measures, floor), measures)
    else:
        rows = _no_carry(rows, measures)
    if prefilter and not hot:
        # placed and ordered by the prefilter's windows already: no second shuffle
        ordered = rows.sortWithinPartitions(*by, *_arrival())
    else:
        ordered = _sorted(rows, by)
    return _run(ordered, by, measures, floor, "bans").drop("chunk", "session")


def bucket_states(
    events: DataFrame,
    keys: list[str],
    measures: list[Measure],
    floor: bool = False,
    idle_reset_s: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """State left per key: keys, ``<measure>_level`` and ``last_sec``."""
    parts, hot, by_key = _prepare(events, keys, measures, idle_reset_s, limit)
    by = group_columns(by_key, hot)
    cold = parts.filter(F.col("chunk") < 0) if hot else parts
    ran = _run(_sorted(_no_carry(cold, measures), by), by, measures, floor, "states")
    left = ran.select(*by, _state("out", measures).alias("after"))
    if hot:
        left = left.drop("chunk")
        crowded = parts.filter(F.col("chunk") >= 0)
        resets = crowded if floor else _can_reset(crowded, by_key, measures, floor)
        if not floor:
            calm = crowded if resets is None else crowded.join(resets.select(*by_key).distinct(), by_key, "left_anti")
            left = left.unionByName(_unreset(calm, by_key, measures))
        if resets is not None:
            left = left.unionByName(_hot_spans(resets, by_key, measures, floor)[2])
    latest = [c for c in by_key if c not in keys]
    if latest:
        left = left.groupBy(*keys).agg(F.max_by("after", F.struct(*latest)).alias("after"))
    return left.filter(F.col("after").isNotNull()).select(
        *keys,
        *[F.col(f"after.`{i}`").alias(f"{m.name}_level") for i, m in enumerate(measures)],
        F.col("after.last").alias("last_sec"),
    )


def ban_records(hits: DataFrame, measures: list[Measure], th: Thresholds) -> DataFrame:
    """Bucket hits -> ``prefix``, ``blame``, ``expires_at`` (with the keys and ``seq``)."""
    blame = F.when(F.lit(False), F.lit(""))
    for i, m in enumerate(measures):
        blame = blame.when(F.col("measure") == i, F.lit(m.blame))
    return hits.select(
        *[c for c in hits.columns if c not in ("family", "measure", "expires_us")],
        ban_prefix("client_key", "family", th.v4_prefix, th.v6_prefix, th.unmap_v4).alias("prefix"),
        blame.alias("blame"),
        F.timestamp_micros("expires_us").alias("expires_at"),
    )


def _options(th: Thresholds, options: dict) -> dict:
    return {
        "floor": th.floor,
        "idle_reset_s": th.idle_reset_s,
        **options,
    }


def client_bans(requests: DataFrame, th: Thresholds, **options) -> DataFrame:
    """Request-rate and byte-rate bans, one row per overflow."""
    m = th.client_measures
    opts = {"prefilter": th.prefilter, **_options(th, options)}
    return ban_records(bucket_bans(requests, CLIENT_KEYS, m, **opts), m, th)


def path_bans(tracked: DataFrame, th: Thresholds, **options) -> DataFrame:
    """File-ratio bans; ``tracked`` carries ``ratio_cost``."""
    m = th.path_measures
    opts = {"prefilter": th.prefilter, **_options(th, options)}
    return ban_records(bucket_bans(tracked, PATH_KEYS, m, **opts), m, th)


def client_state(requests: DataFrame, th: Thresholds, **options) -> DataFrame:
    """Live client buckets: ``requests``, ``bytes`` and ``last_sec``."""
    return (
        bucket_states(requests, CLIENT_KEYS, th.client_measures, **_options(th, options))
        .withColumnRenamed("request_level", "requests")
        .withColumnRenamed("byte_level", "bytes")
    )


def path_state(tracked: DataFrame, th: Thresholds, **options) -> DataFrame:
    """Live client-path buckets: ``ratio`` and ``last_sec``."""
    return bucket_states(
        tracked, PATH_KEYS, th.path_measures, **_options(th, options)
    ).withColumnRenamed("ratio_level", "ratio")
