"""Exact deduplication with frequent digests split off (heavy hitters).

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``.
A Misra-Gries summary of each partition, merged in levels, names at most ``COUNTERS``
digests; no digest with more than about ``2 / COUNTERS`` of all rows can be missing.
Their exact counts and winners come from one aggregation with map-side combining and
are broadcast (at most ``COUNTERS`` rows), so rows of hot groups are decided where they
are.  All other digests are shuffled; none of them can hold a large share of the rows.

Defined results: a null text counts as empty, and empty texts are equal to each other.
Of equal texts the row with the most code points stays, then the smallest ``doc_id``
(null last), then the first row read; so of repeated rows exactly one stays.  An empty
table gives an empty result.  Extra columns of any name pass through.
"""

from __future__ import annotations

import math
import sys
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakguard.llm.shared import fresh, materialize, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Digests that the summary keeps; also the bound of the broadcast.
COUNTERS = 256
_WHITE = r"[\x20\x09-\x0D]+"


def normalised(text):
    return F.regexp_replace(text, _WHITE, "")


def shrink(counts: Counter, keep: int) -> Counter:
    """Misra-Gries reduction of weighted counters to at most ``keep``."""
    if len(counts) <= keep:
        return counts
    cut = sorted(counts.values(), reverse=True)[keep]
    return Counter({k: n - cut for k, n in counts.items() if n > cut})


def _summary(keep: int):
    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            for digest, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[digest] += n
                if len(counts) > 32 * keep:
                    counts = shrink(counts, keep)
        counts = shrink(counts, keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"]
        )

    return summarise


def frequent_digests(digests: DataFrame, keep: int = COUNTERS) -> DataFrame:
    """At most ``keep`` digests that include every very frequent one."""
    rows = digests.select("digest", F.lit(1).cast("bigint").alias("n"))
    schema = "digest binary, n bigint"
    first = rows.mapInArrow(_summary(keep), schema)
    fan_in = max(1, math.isqrt(digests.rdd.getNumPartitions()))
    level = first.repartition(fan_in).mapInArrow(_summary(keep), schema)
    return level.coalesce(1).mapInArrow(_summary(keep), schema).select("digest")


def keep_decisions(docs: DataFrame, keep: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept."""
    text = text_or_empty("text")
    digests = materialize(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
            F.length(text).cast("bigint").alias("length"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    # ~x reverses the order of integers without overflow
    rank = F.struct(
        "length",
        F.col("doc_id").isNotNull().alias("known"),
        F.bitwise_not(F.col("doc_id")).alias("smallest"),
        F.bitwise_not("row").alias("earliest"),
    )
    candidates = F.broadcast(frequent_digests(digests, keep))  # at most `keep` rows
    winners = (
        digests.join(candidates, "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("heavy_size"), F.max(rank).alias("heavy_best"))
    )
    marked = digests.join(F.broadcast(winners), "digest", "left")  # at most `keep` rows
    heavy = marked.filter("heavy_size is not null").selectExpr(
        "doc_id", "digest", "row", "heavy_best as best", "heavy_size as group_size"
    )
    group = Window.partitionBy("digest")
    light = marked.filter("heavy_size is null").select(
        "doc_id",
        "digest",
        "row",
        F.max(rank).over(group).alias("best"),
        F.count("*").over(group).alias("group_size"),
    )
    return heavy.union(light).selectExpr(
        "doc_id",
        "digest",
        "if(best.known, ~best.smallest, null) as keep_id",
        "group_size",
        "row = ~best.earliest as kept",
    )


def exact_dedup(docs: DataFrame, keep: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Winners are matched by doc_id and digest; rows that repeat both are one document,
    of which the first by length stays.
    """
    of, length, number, winner, digest = fresh(docs, "of", "length", "number", "winner", "digest")
    winners = keep_decisions(docs, keep).filter("kept").selectExpr(f"doc_id as {winner}", f"digest as {digest}")
    text = text_or_empty("text")
    named = docs.withColumns({of: F.unhex(F.sha2(normalised(text), 256)), length: F.length(text)})
    same = named["doc_id"].eqNullSafe(winners[winner]) & (named[of] == winners[digest])
    one = Window.partitionBy("doc_id", of).orderBy(F.desc(length))
    kept = named.join(winners, same).withColumn(number, F.row_number().over(one)).filter(F.col(number) == 1)
    return kept.select(*docs.columns)
