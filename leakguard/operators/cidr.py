"""Union of IP prefixes into the fewest CIDR blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakguard.functions.net import (
    bits_hex32,
    hex33_bits,
    parse_prefix,
    prefix_text,
    range_hi,
    range_lo,
    successor,
)
from leakguard.operators.skew import materialize

_BITS = 132  # 33 hex digits: room for the end of the last address


def parsed_prefixes(prefixes: DataFrame, column: str = "prefix") -> DataFrame:
    """Add ``family``, ``hex32`` and ``bits``; NULL for text that is no prefix."""
    return prefixes.withColumn("_p", parse_prefix(column)).select(
        *prefixes.columns, "_p.family", "_p.hex32", "_p.bits"
    )


def prefix_ranges(prefixes: DataFrame, column: str = "prefix") -> DataFrame:
    """Add ``family``, ``lo`` and ``hi`` (32 hex digits); host bits are dropped."""
    parsed = parsed_prefixes(prefixes, column)
    return parsed.select(
        *prefixes.columns,
        "family",
        "bits",
        range_lo("hex32", "bits").alias("lo"),
        range_hi("hex32", "bits").alias("hi"),
    )


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Overlapping and adjacent ranges -> disjoint ``family, start, end``.

    ``start`` is the first address and ``end`` the one after the last, both with
    33 hex digits.  The distinct ranges are sorted across the cluster by range
    partitioning, so no block of the address space has to fit in one task; each
    partition starts from the farthest end reached by the partitions before it
    (one row per partition).
    """
    points = (
        ranges.select(
            "family", F.concat(F.lit("0"), "lo").alias("start"), successor("hi").alias("end")
        )
        .groupBy("family", "start")
        .agg(F.max("end").alias("end"))
        # on the aggregate, so that the parse is not repeated in a pushed-down filter
        .filter(F.col("end").isNotNull())
    )
    placed = materialize(
        points.repartitionByRange("family", "start")
        .sortWithinPartitions("family", "start")
        .withColumn("part", F.spark_partition_id())
    )
    reach = placed.groupBy("part").agg(F.max(F.struct("family", "end")).alias("far"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.select("part", F.max("far").over(earlier).alias("far"))
    inside = (
        Window.partitionBy("part", "family")
        .orderBy("start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # one row per partition of the sorted frame
    rows = placed.join(F.broadcast(reach), "part").withColumn(
        "_far", F.when(F.col("far.family") == F.col("family"), F.col("far.end"))
    )
    rows = rows.withColumn("_far", F.greatest(F.max("end").over(inside), F.col("_far")))
    rows = rows.withColumn(
        "_opens", F.when(F.col("_far").isNull() | (F.col("start") > F.col("_far")), F.col("start"))
    )
    # the island of a row is the last opening at or before it
    last_open = rows.groupBy("part").agg(
        F.max(F.when(F.col("_opens").isNotNull(), F.struct("family", "_opens"))).alias("open")
    )
    last_open = last_open.select("part", F.max("open").over(earlier).alias("open"))
    upto = (
        Window.partitionBy("part", "family")
        .orderBy("start")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.join(F.broadcast(last_open), "part").withColumn(
        "island", F.coalesce(F.max("_opens").over(upto), F.col("open._opens"))
    )
    return (
        rows.groupBy("family", "island")
        .agg(F.max("end").alias("end"))
        .select("family", F.col("island").alias("start"), "end")
    )


def _tile(number: str, digit: str) -> str:
    """The block at position ``i``: digits before it, then ``digit``, then zeros."""
    bits = f"rpad(concat(substr({number}, 1, i - 1), '{digit}'), {_BITS}, '0')"
    return f"named_struct('hex32', {bits_hex32(bits)}, 'bits', i - {_BITS - 128})"


# Array of ``(hex32, bits)`` that tile ``[s, e)``, given as binary digits.  With
# ``q`` the first digit where both differ, the tiles left of the turning point
# sit at the lowest one of ``s`` and at its zeros between that and ``q``; the
# tiles right of it sit at the ones of ``e`` below ``q``.
_AT = f"sequence(1, {_BITS})"
_Q = f"filter({_AT}, i -> substr(s, i, 1) <> substr(e, i, 1))[0]"
_LOW = f"if(locate('1', s) = 0, 0, {_BITS + 1} - locate('1', reverse(s)))"
_LEFT = (
    f"transform(filter({_AT}, i -> i > q and (i = low or (i < low and substr(s, i, 1) = '0'))), "
    f"i -> {_tile('s', '1')})"
)
_WHOLE = f"transform(array(q), i -> {_tile('s', '0')})"
_RIGHT = f"transform(filter({_AT}, i -> i > q and substr(e, i, 1) = '1'), i -> {_tile('e', '0')})"
_TILES = (
    f"transform(array({_Q}), q -> transform(array({_LOW}), low -> "
    f"concat(if(low > q, {_LEFT}, {_WHOLE}), {_RIGHT}))[0])[0]"
)


def split_ranges(islands: DataFrame) -> DataFrame:
    """Disjoint ranges -> ``family, lo, bits, prefix``."""
    binary = islands.select(
        "family", hex33_bits("start").alias("s"), hex33_bits("`end`").alias("e")
    )
    tiles = binary.select("family", F.explode(F.expr(_TILES)).alias("t"))
    return tiles.select(
        "family",
        F.col("t.hex32").alias("lo"),
        F.col("t.bits").alias("bits"),
    ).withColumn("prefix", prefix_text("family", "lo", "bits"))


def minimal_prefixes(prefixes: DataFrame, column: str = "prefix") -> DataFrame:
    """Fewest CIDR blocks covering exactly the valid prefixes."""
    distinct = prefixes.select(column).distinct()
    return split_ranges(merge_ranges(prefix_ranges(distinct, column)))
