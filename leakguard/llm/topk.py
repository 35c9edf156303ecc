"""Exact top-k inner products: longest vectors first, SVD-rotated partial sums.

All components are taken as floor(1024 x), so scores are exact integers.  A rotation is
made from the Gram matrix of all vectors (one small matrix per task, added up), which
puts most of the length of a typical vector into its leading components.  The vectors,
sorted by length, form blocks; the queries form blocks too.  First the block of the
longest vectors meets every block of queries and gives each query a floor; then every
other block meets every block of queries, and Cauchy-Schwarz bounds on the residuals
drop what cannot reach the floor.  Nothing is sampled; the result is exact.

Queries times vectors is done in blocks of bounded size, and only the k best rows of
each (query, block) are passed on; neither side is broadcast.

Defined results: vectors that are null or hold null or non-finite components take no part,
nor do rows with a null ``vec_id``; a vector's missing tail counts as zeros when lengths
differ; repeated rows are candidates of their own, but a row with the query's own id is
none; scores outside a long are held at its limits; fewer candidates than k give fewer
rows; an empty table gives an empty result.  Extra columns do not matter.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakguard.llm import topk_kernel as kernel
from leakguard.llm.shared import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(kernel)

BLOCK_VECTORS = 4096
BLOCK_QUERIES = 2048
STEP = 512  # vectors of a block between two looks at the floors
CUTS = (8, 16, 32)
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v, norm) of the vectors of finite components, as doubles."""
    # abs(x) < inf is not true for nan, infinities and nulls
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    squares = F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x * x)
    return rows.filter("id is not null and v is not null").filter(finite).withColumn("norm", F.sqrt(squares))


def _padded(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = rows.flatten().to_numpy(zero_copy_only=False), rows.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _gram_task(width: int):
    def gram(batches):
        total = np.zeros((width, width))
        for batch in batches:
            rows = _padded(batch.column(0), width)
            with np.errstate(all="ignore"):
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width, dtype=np.int32)), pa.array(total.ravel())], ["at", "x"])

    return gram


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors: ``width`` x ``width``, whatever their number."""
    sums = rows.select("v").mapInArrow(_gram_task(width), "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    total = np.zeros(width * width)
    for r in sums.collect():
        total[r["at"]] = r["x"]
    if not np.isfinite(total).all():  # too long to square: any rotation gives right results
        return np.eye(width)
    return np.linalg.svd(total.reshape(width, width))[0]


def _search_task(width: int, turn: np.ndarray, k: int):
    cuts = [*(c for c in CUTS if c < width), width]

    def side(table: pa.Table) -> kernel.Side:
        vectors = kernel.integers(_padded(table.column("v"), width))
        return kernel.Side(table.column("id").to_numpy(), vectors, turn, cuts)

    def search(queries: pa.Table, block: pa.Table) -> pa.Table:
        left = side(queries)
        best = kernel.Best(queries.num_rows, k)
        best.floor = queries.column("floor").to_numpy().astype(np.float64)
        block = block.sort_by([("norm", "descending"), ("id", "ascending")])
        for begin in range(0, block.num_rows, STEP):
            kernel.search(left, side(block.slice(begin, STEP)), best, cuts)
        sizes = [len(x) for x in best.ids]
        columns = [np.repeat(left.ids, sizes), np.concatenate([*best.ids, []]), np.concatenate([*best.scores, np.zeros(0, np.int64)])]
        return pa.table([pa.array(c.astype(np.int64), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return search


def _meet(queries: DataFrame, blocks: DataFrame, pairs: DataFrame, task) -> DataFrame:
    """Search every (q_block, block) of ``pairs``."""
    left = queries.join(pairs, "q_block").groupBy("q_block", "block")
    named = pairs.select(F.col("q_block").alias("with"), F.col("block").alias("of"))
    right = blocks.withColumnRenamed("block", "of").join(named, "of").groupBy("with", "of")
    return left.cogroup(right).applyInArrow(task, _FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best candidates of each row that
    ``is_query`` (a condition on ``id``) names; equal ids of queries are one query."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = size["n"], size["width"] or 0
    queries = rows.filter(is_query).dropDuplicates(["id"])
    asked = queries.count()
    if not asked or not width:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    task = _search_task(width, rotation(rows, width), k)
    # ranges of falling length; the id splits equal lengths
    ranged = rows.repartitionByRange(max(1, -(-n // BLOCK_VECTORS)), F.desc("norm"), "id")
    blocks = materialize(ranged.withColumn("block", F.spark_partition_id()), "blocks")
    groups = F.pmod(F.xxhash64("id"), F.lit(-(-asked // BLOCK_QUERIES))).cast("int")
    queries = materialize(queries.withColumn("q_block", groups), "queries")
    lengths = blocks.groupBy("block").agg(F.max("norm").alias("longest"))
    first = blocks.agg(F.min("block")).first()[0]
    q_blocks = queries.select("q_block").distinct()

    start = queries.withColumn("floor", F.lit(float("-inf")))
    near = _meet(start, blocks, q_blocks.withColumn("block", F.lit(first)), task)
    near = materialize(near, "first-block")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
    kth = kth.selectExpr("query_id as id", "cast(score as double) as floor")
    floored = queries.join(kth, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    floored = materialize(floored, "floors")
    # blocks that no query of a block can use are left out before any vector is sent
    reach = floored.groupBy("q_block").agg(F.max("norm").alias("q_longest"), F.min("floor").alias("lowest"))
    pairs = reach.join(
        lengths.filter(F.col("block") != first),
        ~(F.col("q_longest") * F.col("longest") * (1024.0 * 1024.0) * 1.01 + 2048.0 * F.lit(float(width)) * (1 + F.col("q_longest") + F.col("longest")) < F.col("lowest")),
    ).select("q_block", "block")
    rest = _meet(floored, blocks, materialize(pairs, "pairs"), task)
    ranked = near.union(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
