"""Near-duplicate classes by DartMinHash over counted five-word shingles.

Every text throws hashed darts into the regions of its shingles (as wide as the shingle
is frequent in the text) and keeps the earliest dart of each of 128 coordinates; two
coordinates agree with the probability of the weighted Jaccard similarity.  Coordinates
are joined in bands; texts that agree in a band are candidates, and a candidate pair is
a link if the similarity of the whole shingle multisets is 0.8 or more.  Classes are the
connected groups of links.  A pair at 0.8 shares a band with probability 0.99995.

No bucket emits all its pairs.  Texts with equal shingles are one node.  First the
members of a bucket are compared with its most central member.  Of the members that did
not end in that member's component, the rest of the pairs across components is compared:
pairs within a component cannot change it, so no link between candidates is lost.  In
large buckets that is done between blocks of bounded size, of which only links come out.

Shingle arrays are made again from the texts of the nodes that have candidates, by a join
on doc_id and text hash; nothing is collected or broadcast.  Nodes are named by a 64-bit
hash of their multiset, and similarity counts 32-bit hashes of shingles.

Defined results: a null text counts as empty; texts without words are alike only if equal
after removing white space; a text of one to four words is one shingle.  The smallest
doc_id (null last, then the first row read) of a class stays; repeated rows are of one
class.  An empty table gives an empty result.  Extra columns of any name pass through.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakguard.llm import dart_kernel, worker
from leakguard.llm.components import bucket_components, crowded_buckets
from leakguard.llm.shared import fresh, materialize, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(dart_kernel)
cloudpickle.register_pickle_by_value(worker)

COORDINATES = 128
BANDS = 25
BAND_ROWS = 5
SIMILARITY = 0.8
# Members of a bucket beyond which pairs are compared block by block.
LARGE_BUCKET = 32
BLOCK_STRAYS, BLOCK_OTHERS = 256, 1024
_NODES = "doc_id bigint, text_hash bigint, row bigint, node bigint, size int, bands array<bigint>"


def _multiset_key(cells: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    total = np.zeros(count, np.uint64)
    np.add.at(total, owner, cells)
    return dart_kernel.mix(total + np.bincount(owner, minlength=count).astype(np.uint64))


def _wordless_key(text: str) -> int:
    import hashlib

    bare = "".join(text.split()).encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(bare, digest_size=8, person=b"wordless").digest(), "little", signed=True)


def _node_task(batches):
    worker.release()
    for batch in batches:
        texts = batch.column(3).to_pylist()
        for start, part in dart_kernel.chunks(texts):
            n = len(part)
            cells, owner = dart_kernel.elements(part)
            size = np.bincount(owner, minlength=n)
            node = _multiset_key(cells, owner, n).view(np.int64)
            for i in np.flatnonzero(size == 0):
                node[i] = _wordless_key(part[i])
            signature = dart_kernel.signatures(cells, owner, n, COORDINATES).astype(np.uint64)
            bands = np.zeros((n, BANDS), np.uint64)
            for b in range(BANDS):
                h = np.full(n, b + 1, np.uint64)
                for c in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
                    h = dart_kernel.mix(h * np.uint64(0x2545F4914F6CDD1D) + signature[:, c])
                bands[:, b] = h
            has = size > 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)),
                pa.array(bands[has].ravel().view(np.int64)),
            )
            columns = [batch.column(i).slice(start, n) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(node), pa.array(size.astype(np.int32)), lists],
                ["doc_id", "text_hash", "row", "node", "size", "bands"],
            )


def _shingle_task(batches):
    worker.release()
    """node and its sorted 32-bit elements."""
    for batch in batches:
        nodes, texts = batch.column(0), batch.column(1).to_pylist()
        for start, part in dart_kernel.chunks(texts):
            cells, owner = dart_kernel.elements(part)
            short = (cells >> np.uint64(32)).astype("<u4")
            ends = np.cumsum(np.bincount(owner, minlength=len(part)))
            arrays = [np.sort(short[e - c : e]).tobytes() for e, c in zip(ends, np.diff(ends, prepend=0), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [nodes.slice(start, len(part)), pa.array(arrays, pa.binary())], ["node", "shingles"]
            )


def _link_task(least: float):
    def links(batches):
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            keep = []
            for x, y in zip(left, right, strict=True):
                u, v = (np.frombuffer(z.as_buffer(), "<u4") for z in (x, y))
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same >= least * (len(u) + len(v) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return links


def _named(docs: DataFrame) -> DataFrame:
    text = text_or_empty("text")
    return docs.select(
        F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row"), text.alias("text")
    )


def _links(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    left, right = shingles.toDF("a", "left"), shingles.toDF("b", "right")
    attached = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return attached.mapInArrow(_link_task(least), "a bigint, b bigint")


def _block_task(least: float):
    def links(strays: pa.Table, others: pa.Table) -> pa.Table:
        """All links between two blocks of a bucket; memory: the blocks' shingles."""
        left = [np.frombuffer(x.as_buffer(), "<u4") for x in strays.column("shingles")]
        right = [np.frombuffer(x.as_buffer(), "<u4") for x in others.column("shingles")]
        sizes = np.array([len(x) for x in right])
        # numbers for the shingles; the n-th equal one of a text counts as one of its own
        flat, kinds = np.concatenate(left + right), None
        owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
        at = np.arange(len(flat))
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        kinds, number = np.unique(flat.astype(np.uint64) << np.uint64(20) | nth.astype(np.uint64), return_inverse=True)
        ends = np.cumsum([len(x) for x in left])
        mine, theirs = number[: ends[-1]], number[ends[-1] :]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        labels = (strays.column("label").to_numpy(), others.column("label").to_numpy())
        nodes = (strays.column("node").to_numpy(), others.column("node").to_numpy())
        mask, a, b = np.zeros(len(kinds), np.int64), [], []
        for i, end in enumerate(ends):
            own = mine[end - len(left[i]) : end]
            mask[own] = 1
            same = np.add.reduceat(mask[theirs], starts)
            mask[own] = 0
            hit = (same >= least * (len(own) + sizes - same)) & (labels[1] != labels[0][i])
            a += [nodes[0][i]] * int(hit.sum())
            b += nodes[1][hit].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _block_links(strays: DataFrame, others: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """Links across components in large buckets, found block by block; only links come out."""
    counts = others.groupBy("bucket").agg(
        F.ceil(F.count("*") / BLOCK_OTHERS).cast("int").alias("o"),
        F.ceil(F.count(F.when(F.col("stray"), 1)) / BLOCK_STRAYS).cast("int").alias("s"),
    )

    def dealt(side: DataFrame, own: str, other: str, key: list[str]) -> DataFrame:
        sized = side.select("bucket", "node", "label").join(counts, "bucket").join(shingles, "node")
        part = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        sized = sized.withColumn("own", part).withColumn("other", every)
        names = [*key, "node", "label", "shingles"]
        columns = ["bucket", "own", "other", "node", "label", "shingles"]
        # new columns on either side, which come from the same tables
        return sized.toDF(*("_" + c for c in sized.columns)).select(*(F.expr("_" + c).alias(n) for c, n in zip(columns, names, strict=True)))

    left = dealt(strays, "s", "o", ["k", "ks", "ko"]).groupBy("k", "ks", "ko")
    right = dealt(others, "o", "s", ["q", "qo", "qs"]).groupBy("q", "qs", "qo")
    return left.cogroup(right).applyInArrow(_block_task(least), "a bigint, b bigint")


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, class_id, class_size, kept."""
    nodes = materialize(_named(docs).mapInArrow(_node_task, _NODES), "nodes")
    members = nodes.selectExpr("explode(bands) as bucket", "node", "size as trait").distinct()
    crowded = crowded_buckets(materialize(members, "bands"))
    # every node that may be compared, with one document that has it
    wanted = crowded.select("node").distinct()
    known = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    one = nodes.groupBy("node").agg(F.min(known).alias("d")).join(wanted, "node")
    one = one.selectExpr("node", "d.doc_id as doc_id", "d.text_hash as text_hash")
    texts = _named(docs).drop("row")
    same = texts["doc_id"].eqNullSafe(one["doc_id"]) & (texts["text_hash"] == one["text_hash"])
    found = texts.join(one, same).select(one["node"], texts["text"])
    shingles = materialize(found.mapInArrow(_shingle_task, "node bigint, shingles binary"), "shingles")

    alike = lambda x, y: f"least({x}, {y}) >= {least} * greatest({x}, {y})"
    labels = bucket_components(
        crowded,
        alike,
        lambda pairs: _links(pairs, shingles, least),
        LARGE_BUCKET,
        lambda strays, others: _block_links(strays, others, shingles, least),
    )

    own = nodes.select("doc_id", "text_hash", "row", "node").join(labels, "node", "left")
    own = own.withColumn("label", F.coalesce("label", "node")).drop("node")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("best")
    classes = own.groupBy("label").agg(best, F.count("*").alias("class_size"))
    return own.join(classes, "label").selectExpr(
        "doc_id", "text_hash", "best.doc_id as class_id", "class_size", "row = best.row as kept"
    )


def near_dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` of which each class keeps one, with all their columns."""
    of, number, winner, digest = fresh(docs, "of", "number", "winner", "digest")
    winners = near_classes(docs, least).filter("kept").selectExpr(f"doc_id as {winner}", f"text_hash as {digest}")
    named = docs.withColumn(of, F.xxhash64(text_or_empty("text")))
    same = named["doc_id"].eqNullSafe(winners[winner]) & (named[of] == winners[digest])
    one = Window.partitionBy("doc_id", of).orderBy(of)
    kept = named.join(winners, same).withColumn(number, F.row_number().over(one)).filter(F.col(number) == 1)
    return kept.select(*docs.columns)
