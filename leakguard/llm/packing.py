"""Packing documents into sequences: best fit, then swap-based local search.

Documents are encoded and cut into pieces of at most a sequence; only longer documents
are cut, and only their first piece may be shorter than a sequence.  Pieces are dealt by
hash into groups of bounded size.  In each group best fit decreasing gives a first
packing; then bins are taken from the emptiest on and their pieces are moved to fuller
bins, or exchanged one for one, two for one or one for two, whenever that moves tokens
from the emptier to the fuller bin.  Each step increases the sum of squared fills, and
bins run empty.  Bins that stay loose are dealt anew among each other in further rounds,
so what a group could not fill is filled across groups.

Defined results: a null or empty text is one piece with the end id alone; repeated rows
are packed each on its own; null ids are kept; an empty table gives an empty result.
Extra columns do not matter.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakguard.llm import tokens
from leakguard.llm.shared import materialize, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE = 1024
# Mean pieces of a group: bounds the memory of a task, not what is packed.
GROUP_PIECES = 4096
# A bin with at least this share filled stays as it is after a round.
TIGHT = 0.97
MAX_ROUNDS = 4
_PASSES = 3
_PIECES = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PACKED = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint, pid bigint, sequence_id bigint, offset bigint, fill bigint"


def _cut_task(tokenizer: str, end_id: int, size: int, memory: int):
    def cut(batches):
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            texts = (x.as_py() for x in batch.column(2))
            for doc, row, encoded in zip(ids, rows, tokens.encode_all(tokenizer, texts, memory), strict=True):
                data = encoded + end
                total = len(data) // 4
                stop = total % size or size
                begin = piece = 0
                while begin < total:
                    crc = zlib.crc32(data[4 * begin : 4 * stop])
                    for column, value in zip(out, (doc, row, piece, begin, stop - begin, crc), strict=True):
                        column.append(value)
                    begin, stop, piece = stop, stop + size, piece + 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, types, strict=True)],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def cut_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, size: int = SEQUENCE, memory: int = tokens.MEMORY
) -> DataFrame:
    """One row per piece; ``row`` tells repeated documents apart.

    ``memory`` bounds the pieces that a worker remembers, see ``tokens.MEMORY``.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), text_or_empty("text").alias("text")
    )
    return rows.mapInArrow(_cut_task(tokenizer, end_id, size, memory), _PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing; bins as lists of indices."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit f: some bin has f free
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        by_free[free - size].append(b)
        mask |= 1 << (free - size)
    return bins


def _exchange(a: list[int], b: list[int], room: int, sizes: list[int]) -> tuple[list[int], list[int]] | None:
    """What goes from the emptier bin ``a`` to ``b`` and back so that ``b`` gains most."""
    best, found = 0, None
    outs = [([x], sizes[x]) for x in a]
    outs += [([x, y], sizes[x] + sizes[y]) for i, x in enumerate(a) for y in a[i + 1 :]]
    backs = [([], 0)] + [([x], sizes[x]) for x in b]
    pairs = [([x, y], sizes[x] + sizes[y]) for i, x in enumerate(b) for y in b[i + 1 :]]
    for out, n in outs:
        for back, m in backs + pairs if len(out) == 1 else backs:
            if best < n - m <= room:
                best, found = n - m, (out, back)
                if best == room:
                    return found
    return found


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search on the bins that have room; the others stay."""
    full = [b for b in bins if sum(sizes[i] for i in b) == capacity]
    loose = [b for b in bins if sum(sizes[i] for i in b) < capacity]
    for _ in range(_PASSES):
        loose.sort(key=lambda b: sum(sizes[i] for i in b))
        fills = [sum(sizes[i] for i in b) for b in loose]
        changed = False
        vain: set[tuple[int, ...]] = set()  # sizes in bins that found no exchange since the last one
        for at, a in enumerate(loose):
            if fills[at] >= TIGHT * capacity:
                break
            shape = tuple(sorted(sizes[i] for i in a))
            if shape in vain:
                continue
            stuck = True
            # fullest bins first: they close soonest
            for to in range(len(loose) - 1, at, -1):
                room = capacity - fills[to]
                if room == 0 or not a:
                    continue
                swap = _exchange(a, loose[to], room, sizes)
                if swap is None:
                    continue
                out, back = swap
                for x in out:
                    a.remove(x)
                    loose[to].append(x)
                for y in back:
                    loose[to].remove(y)
                    a.append(y)
                moved = sum(sizes[x] for x in out) - sum(sizes[y] for y in back)
                fills[at] -= moved
                fills[to] += moved
                changed, stuck = True, False
                vain.clear()
            if stuck:
                vain.add(shape)
        full += [b for b, f in zip(loose, fills, strict=True) if f == capacity]
        loose = [b for b, f in zip(loose, fills, strict=True) if b and f < capacity]
        if not changed:
            break
    return full + loose


def _pack_task(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("pid", "ascending")])
        sizes = table.column("length").to_pylist()
        bins = improve(best_fit(sizes, capacity), sizes, capacity)
        pids = table.column("pid").to_pylist()
        order, names, offsets, fills = [], [], [], []
        for b in bins:
            at, fill = 0, sum(sizes[i] for i in b)
            for i in b:
                order.append(i)
                names.append(pids[b[0]])  # of a piece that no other bin holds
                offsets.append(at)
                fills.append(fill)
                at += sizes[i]
        out = table.select(["doc_id", "row", "piece", "start", "length", "ids_crc32", "pid"]).take(pa.array(order, pa.int64()))
        for name, values in (("sequence_id", names), ("offset", offsets), ("fill", fills)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    pieces = materialize(pieces.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    tail = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "pid"]
    alone = pieces.filter(F.col("length") >= capacity).select(
        *tail, F.col("pid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.col("length").alias("fill")
    )
    done, open_pieces = [alone], pieces.filter(F.col("length") < capacity).select(*tail)
    last = None
    for number in range(MAX_ROUNDS):
        count = open_pieces.count()
        if count == 0:
            break
        groups = max(1, -(-count // group_pieces))
        dealt = open_pieces.withColumn("group", F.pmod(F.xxhash64("pid", F.lit(number)), F.lit(groups)))
        packed = materialize(dealt.groupBy("group").applyInArrow(_pack_task(capacity), _PACKED), "packed")
        tight = F.col("fill") >= TIGHT * capacity
        # the last round, one group, or a round that could close nothing keeps its loose bins
        if groups == 1 or number == MAX_ROUNDS - 1 or count == last:
            done.append(packed)
            break
        done.append(packed.filter(tight))
        open_pieces, last = packed.filter(~tight).select(*tail), count
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = SEQUENCE,
    group_pieces: int = GROUP_PIECES,
    memory: int = tokens.MEMORY,
) -> DataFrame:
    """Per piece of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    packed = pack_pieces(cut_pieces(docs, tokenizer, end_id, capacity, memory), capacity, group_pieces)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
