"""Groups of alike nodes by joins, without collecting anything."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakguard.llm.shared import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label: the smallest node reached.

    Each round takes the smallest label of the neighbours (aggregated before it is
    shuffled) and then jumps to that label's own label, so chains shrink by half and
    stars at once.  Rounds are written to shared storage.
    """
    both = links.select("a", "b").filter("a <> b").distinct()
    edges = materialize(both.union(both.select("b", "a")).toDF("node", "other"), "edges")
    labels = materialize(
        edges.groupBy("node").agg(F.min("other").alias("other")).selectExpr("node", "least(node, other) as label"),
        "labels",
    )
    while True:
        seen = (
            edges.join(labels.toDF("other", "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        )
        nearer = labels.join(seen, "node").selectExpr("node", "label as old", "least(label, near) as label")
        above = labels.toDF("label", "top")
        jumped = nearer.join(above, "label").selectExpr("node", "old", "least(label, top) as label")
        step = materialize(jumped, "labels")
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels


def crowded_buckets(members: DataFrame) -> DataFrame:
    """Members (bucket, node, trait) of buckets with two nodes or more, with their number
    ``n`` and the bucket's ``pivot``: the member that meets most others in its buckets.

    Counts are aggregated before they are shuffled, and a large bucket is an ordinary
    skewed join.
    """
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = materialize(members.join(buckets, "bucket"), "crowded")
    weights = crowded.groupBy("node").agg(F.sum("n").alias("weight"))
    central = F.max(F.struct("weight", "node", "trait")).alias("p")
    pivots = crowded.join(weights, "node").groupBy("bucket").agg(central)
    pivots = pivots.selectExpr("bucket", "p.node as pivot", "p.trait as pivot_trait")
    return materialize(crowded.join(pivots, "bucket"), "crowded")


def cross_pairs(strays: DataFrame, others: DataFrame, alike: Callable[[str, str], str]) -> DataFrame:
    """Distinct pairs (a, b) of strays and members of other components in their buckets."""
    left = strays.selectExpr("bucket", "node as a", "trait as a_trait", "label as a_label")
    right = others.selectExpr("bucket", "node as b", "trait as b_trait", "label as b_label", "stray")
    return (
        left.join(right, "bucket")
        .filter("a_label <> b_label and (not stray or a < b)")
        .filter(alike("a_trait", "b_trait"))
        .selectExpr("least(a, b) as a", "greatest(a, b) as b")
        .distinct()
    )


def bucket_components(
    crowded: DataFrame,
    alike: Callable[[str, str], str],
    verify: Callable[[DataFrame], DataFrame],
    large: int | None = None,
    compare: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    verify_strays: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components of the links among nodes that share a bucket.

    ``alike`` gives a condition on two traits that every link fulfils; ``verify`` reduces
    pairs (a, b) to links.  No bucket emits all its pairs: first its members are compared
    with its pivot; then members that did not end in the pivot's component are compared
    with the bucket's members of other components.  A pair within a component cannot
    change it, so no link between members of a bucket is lost.  In buckets of more than
    ``large`` members, ``compare`` does the second step and returns links only.
    ``verify_strays`` takes the place of ``verify`` in the second step, where most pairs are
    no links; both have the same result.
    """
    stars = crowded.filter("node <> pivot").filter(alike("trait", "pivot_trait"))
    stars = materialize(stars.selectExpr("pivot as a", "node as b").distinct(), "stars")
    links = materialize(verify(stars), "links")
    labels = components(links)
    placed = (
        crowded.filter("n > 2")
        .join(labels.toDF("node", "label"), "node", "left")
        .join(labels.toDF("pivot", "pivot_label"), "pivot", "left")
        .selectExpr("bucket", "n", "node", "trait", "pivot", "coalesce(label, node) as label", "coalesce(pivot_label, pivot) as main")
        .withColumn("stray", F.col("label") != F.col("main"))
    )
    placed = materialize(placed, "placed")
    with_strays = placed.filter("stray").select("bucket").distinct()
    placed = materialize(placed.join(with_strays, "bucket").filter("node <> pivot").drop("pivot", "main"), "placed")
    small = placed if large is None else placed.filter(F.col("n") <= large)
    pairs = materialize(cross_pairs(small.filter("stray"), small, alike), "pairs")
    found = (verify_strays or verify)(pairs)
    if large is not None:
        wide = placed.filter(F.col("n") > large)
        found = found.union(compare(wide.filter("stray"), wide))
    return components(links.union(materialize(found, "links")))
