"""Mixing sources to target weights by Poisson replication.

Each document's repetition count is the inverse of a Poisson distribution at a uniform
number hashed from seed and document; its mean is the repetition rate that brings the
document's source to its target share of characters.  Documents are exploded by their
count and the copies are put in a global order by hash.  The counts do not depend on
partitioning, executors or retries.

The rates need one aggregate row per named source.  The named sources are a parameter of
the caller, so the map of rates is small whatever the input; all sources without a name
share ``other``.

Defined results: null text counts as empty (a length of 0 counts as 1, so that a source
of empty texts has a rate); a null source belongs to ``other``; repeated rows have the
same count, each row on its own; the share of a target source without documents goes to
the other sources in proportion, and nothing is drawn if no source with a share is there;
an empty table gives an empty result.  Texts of any length count whole.  Extra columns
pass through; beside a column named ``copy`` or ``mix_key`` the new one gets an underscore.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakguard.llm.shared import fresh, text_or_empty

# Target shares of characters; what they leave of 1 goes to all other sources.
TARGETS = {"src0": 0.15, "src1": 0.08, "src2": 0.08, "src3": 0.02}
SEED = 17
# A larger mean is drawn as the sum of independent draws of equal parts, which is a
# Poisson draw again; the table of a part then has some 1,100 entries at most.
PART_MEAN = 4096.0
_SPACE = 1 << 52


def uniform(salt: str, *columns: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5 digest."""
    key = F.concat_ws("|", F.lit(salt), *(F.coalesce(c.cast("string"), F.lit("~")) for c in columns))
    digits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint")
    return digits / F.lit(float(_SPACE))


def poisson_cdf(mean: float) -> tuple[int, list[float]]:
    """``(k, [P(X <= k), P(X <= k + 1), ...])`` without the tails that no uniform number reaches."""
    if mean <= 0:
        return 0, [1.0]
    reach = 9 * math.sqrt(mean) + 40
    first = max(0, math.floor(mean - reach))
    total, out = 0.0, []
    for k in range(first, math.ceil(mean + reach) + 1):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        out.append(min(total, 1.0))
        if total >= 1 - 2**-52:
            break
    return first, out


def _drawn(mean: float, seed: int) -> Column:
    """A Poisson count of a row."""
    parts = max(1, math.ceil(mean / PART_MEAN))
    first, cdf = poisson_cdf(mean / parts)
    table = F.array(*(F.lit(p) for p in cdf))
    draw = lambda u: F.size(F.filter(table, lambda p: p <= u)) + first
    if parts == 1:
        return draw(uniform(f"copies{seed}", F.col("doc_id")))
    each = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: draw(uniform(f"copies{seed}", F.col("doc_id"), i)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def rates(docs: DataFrame, targets: Mapping[str, float], budget: float) -> dict[str | None, float]:
    """Mean repetitions by named source; key None: all other sources."""
    if any(w < 0 for w in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target weights are shares of 1")
    bucket = F.when(F.col("source").isin(list(targets)), F.col("source"))
    size = F.greatest(F.length(text_or_empty("text")), F.lit(1))
    rows = docs.groupBy(bucket.alias("bucket")).agg(F.sum(size).alias("chars")).collect()
    chars = {r["bucket"]: r["chars"] for r in rows}  # at most one row per target and one more
    shares = dict(targets) | {None: max(0.0, 1 - sum(targets.values()))}
    # the shares of absent sources go to the others in proportion
    present = sum(shares[s] for s in chars)
    goal = budget * sum(chars.values())
    return {s: shares[s] / present * goal / n if present > 0 else 0.0 for s, n in chars.items()}


def repetitions(docs: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` with a last column, the copies of each row.

    ``budget`` is the wanted size of the result as a multiple of the input.
    """
    by_source = rates(docs, targets, budget)
    count = F.lit(0)
    for source, mean in sorted(by_source.items(), key=lambda x: (x[0] is None, x[0] or "")):
        drawn = _drawn(mean, seed)
        named = F.coalesce(F.col("source").isin(list(targets)), F.lit(False))
        of = ~named if source is None else F.coalesce(F.col("source") == source, F.lit(False))
        count = F.when(of, drawn).otherwise(count)
    return docs.withColumn(fresh(docs, "repeat")[0], count.cast("int"))


def mix(docs: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """Replicated documents in a global hash order, with ``copy`` (from 0) and ``mix_key``."""
    repeat, copy, order = fresh(docs, "repeat", "copy", "mix_key")
    copies = repetitions(docs, targets, budget, seed).filter(F.col(repeat) > 0)
    exploded = copies.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(repeat) - 1)))
    key = uniform(f"order{seed}", F.col("doc_id"), F.col(copy))
    return exploded.drop(repeat).withColumn(order, key).orderBy(order, "doc_id", copy)
