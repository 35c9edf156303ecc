"""Resets of hot keys by next-overflow links and pointer doubling.

A hot key is cut into spans.  What its bucket holds at a span depends on every reset
before, but where a *fresh* bucket next overflows does not.  So, for all spans at once:

1. every event's fresh bucket is followed through its span to the last reset inside
   (``links_kernel.Span.links``); the starts that are left, with their state at the end of
   the span, are the nodes;
2. each node is carried over the spans behind it.  Sums and upper bounds of spans, and of
   blocks of ``RADIX`` spans, blocks of such blocks and so on, skip what cannot overflow;
   the span that may is entered with the state reached.  An overflow there leads on to
   that span's own last reset: a link from node to node.  Without one the node goes on;
3. the nodes really passed are the path from the key's first event.  Doubling finds it:
   each round joins the path with links and links with themselves, so n links take log2 n
   rounds.

The spans that a path enters then run once, each from the state its link brought along.
Nothing is guessed and nothing runs again.  A span's events meet in one task; a span that
more buckets enter than a span has rows is copied for parts of them.  Only for buckets
without a floor: a floor makes levels forget, and there guessed starts agree soon.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakguard.operators import links_kernel
from leakguard.operators.levels import exact_cost
from leakguard.operators.skew import hot_rows_limit, materialize
from leakguard.schemas import Measure

cloudpickle.register_pickle_by_value(links_kernel)

RADIX = 64


def stored(level: Column) -> Column:
    """A live level as a long: it is within the volume, and credit stops at the limit."""
    return F.greatest(level, F.lit(-(1 << 62))).cast("bigint")


def _states(n: int) -> list[str]:
    return ["last", *[f"level_{i}" for i in range(n)]]


def _longs(rows: DataFrame, keys: list[str], names: list[str], flags: list[str] = ()) -> T.StructType:
    fields = [rows.schema[k] for k in keys] + [T.StructField(n, T.LongType()) for n in names]
    return T.StructType(fields + [T.StructField(n, T.BooleanType()) for n in flags])


def _helpers(rule, keys, costs, schema):
    """Functions that the tasks share; they see only NumPy and Arrow."""
    from leakguard.operators.links_kernel import Span, stored_level

    names, n_costs = [f.name for f in schema.fields], len(costs)

    def column(table, name):
        values = table.column(name).combine_chunks()
        return values.fill_null(False if pa.types.is_boolean(values.type) else 0).to_numpy(zero_copy_only=False)

    def span(rows):
        order = np.argsort(column(rows, "seq"), kind="stable")
        return Span(rule, column(rows, "sec")[order], [column(rows, c)[order] for c in costs])

    def state(table):
        last = column(table, "last").astype(np.int64)
        levels = [column(table, f"level_{m}").astype(np.int64) for m in range(n_costs)]
        return levels, last, column(table, "fresh").astype(bool)

    def out(like, n, values):
        """A table with the keys of ``like``; NumPy columns by name."""
        held = {k: pa.repeat(like.column(k)[0], n) for k in keys}
        flat = lambda v: pa.array([stored_level(x) for x in v] if v.dtype == object else v)
        return pa.table([held[c] if c in held else flat(values[c]) for c in names], names=names)

    def empty(like):
        types = {k: like.schema.field(k).type for k in keys}
        flags = {"fresh": pa.bool_(), "root": pa.bool_()}
        return pa.table([pa.array([], types.get(c) or flags.get(c, pa.int64())) for c in names], names=names)

    return column, span, state, out, empty


def _nodes(rows: DataFrame, rule, keys: list[str], costs: list[str]) -> DataFrame:
    """Fresh starts not reset again in their span, with the state at its end."""
    states = _states(len(costs))
    schema = _longs(rows, keys, ["from_chunk", "from_at", "chunk", *states], ["fresh", "root"])
    column, span, _, out, _ = _helpers(rule, keys, costs, schema)

    def run(table: pa.Table) -> pa.Table:
        events = span(table)
        way, ends, latest = events.links()
        at = np.unique(way)
        fresh = at == events.n  # nothing is live at the end of the span
        inside = np.minimum(at, events.n - 1)
        chunk = np.full(len(at), column(table, "chunk")[0])
        values = {"from_chunk": chunk, "from_at": at, "chunk": chunk, "last": latest[inside], "fresh": fresh, "root": at == way[0]}
        values |= {f"level_{m}": e[inside] for m, e in enumerate(ends)}
        return out(table, len(at), values)

    return rows.groupBy(*keys, "chunk").applyInArrow(run, schema)


def _advance(pending: DataFrame, ahead: DataFrame, rule, keys: list[str], costs: list[str]) -> DataFrame:
    """Add ``to``: the span each node enters next (-1: none), with the state before it."""
    n = len(costs)
    schema = _longs(pending, keys, ["from_chunk", "from_at", "to", *_states(n)], ["fresh"])
    column, _, state, out, empty = _helpers(rule, keys, costs, schema)

    def run(nodes: pa.Table, blocks: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return empty(nodes)
        names = ["first", "latest", *[f"sum_{m}" for m in range(n)], *[f"bound_{m}" for m in range(n)]]
        listed = sorted(zip(*(map(int, blocks.column(c).to_pylist()) for c in names)))
        steps = [(first, latest, rest[:n], rest[n:]) for first, latest, *rest in listed]
        levels, last, fresh = state(nodes)
        to, levels, last = links_kernel.skip_ahead(rule, levels, last, fresh, steps)
        values = {"from_chunk": column(nodes, "from_chunk"), "from_at": column(nodes, "from_at"), "to": to, "last": last, "fresh": fresh}
        return out(nodes, len(to), values | {f"level_{m}": x for m, x in enumerate(levels)})

    by = [*keys, "chunk"]
    return pending.groupBy(*by).cogroup(ahead.groupBy(*by)).applyInArrow(run, schema)


def _enter(moved: DataFrame, rows: DataFrame, rule, keys: list[str], costs: list[str]) -> DataFrame:
    """Run nodes into the span ``to``: ``at`` is the node reached there (-1: no overflow).

    The state is the one before the span for a link, else the one at its end.
    """
    n = len(costs)
    schema = _longs(moved, keys, ["from_chunk", "from_at", "chunk", "at", *_states(n)], ["fresh"])
    column, span, state, out, empty = _helpers(rule, keys, costs, schema)

    def run(nodes: pa.Table, table: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return empty(table)
        events = span(table)
        levels, last, fresh = state(nodes)
        over, ends, top = events.enter(levels, last, fresh)
        way, _, _ = events.links()
        hit = (over < events.n) | fresh
        # a fresh bucket starts with the span, any other starts anew behind its overflow
        at = np.where(hit, way[np.where(fresh, 0, np.minimum(over + 1, events.n))], -1)
        values = {
            "from_chunk": column(nodes, "from_chunk"),
            "from_at": column(nodes, "from_at"),
            "chunk": column(nodes, "to"),
            "at": at,
            "last": np.where(hit, last, top),
            "fresh": fresh & hit,
        }
        return out(nodes, len(at), values | {f"level_{m}": np.where(hit, x, e) for m, (x, e) in enumerate(zip(levels, ends))})

    limit = hot_rows_limit(moved.sparkSession)
    place = [*keys, "to"]
    crowds = moved.groupBy(*place).agg(F.ceil(F.count("*") / F.lit(limit)).cast("int").alias("copies"))
    rows = rows.withColumnRenamed("chunk", "to").join(crowds, place)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    part = F.pmod(F.xxhash64("from_chunk", "from_at"), F.col("copies")).cast("int")
    moved = moved.join(crowds, place).withColumn("part", part).drop("copies")
    by = [*place, "part"]
    return moved.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(run, schema)


def span_summaries(rows: DataFrame, keys: list[str], measures: list[Measure]) -> DataFrame:
    """Per span: ``latest`` second, ``sum_i`` of costs and ``bound_i`` (see ``skip_ahead``)."""
    w = Window.partitionBy(*keys, "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    costs = {f"_cost_{i}": exact_cost(m) for i, m in enumerate(measures)}
    run = rows.withColumns(costs).withColumns({f"_run_{i}": F.sum(f"_cost_{i}").over(w) for i in range(len(measures))})
    wide = lambda c: c.cast("decimal(38,0)")
    return run.groupBy(*keys, "chunk").agg(
        F.max("sec").alias("latest"),
        *[wide(F.sum(f"_cost_{i}")).alias(f"sum_{i}") for i in range(len(measures))],
        *[
            wide(F.max(F.col(f"_run_{i}") - F.lit(m.leak) * F.col("sec"))).alias(f"bound_{i}")
            for i, m in enumerate(measures)
        ],
    )


def _ahead(spans: DataFrame, keys: list[str], n: int) -> DataFrame:
    """What lies ahead of each span: the rest of its block, then the rest of the larger one, ...

    At most ``RADIX - 1`` rows a span and level.
    """
    top = spans.agg(F.max("chunk")).first()[0] or 0
    out, width = None, 1
    while out is None or width <= top:
        block = F.expr(f"chunk div {width}L")
        past = Window.partitionBy(*keys, "block").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = {f"_past_{i}": F.coalesce(F.sum(f"sum_{i}").over(past), F.lit(0)) for i in range(n)}
        blocks = spans.withColumn("block", block).withColumns(sums)
        blocks = blocks.groupBy(*keys, "block").agg(
            F.min("chunk").alias("first"),
            F.max("latest").alias("latest"),
            *[F.sum(f"sum_{i}").cast("decimal(38,0)").alias(f"sum_{i}") for i in range(n)],
            *[F.max(F.col(f"_past_{i}") + F.col(f"bound_{i}")).cast("decimal(38,0)").alias(f"bound_{i}") for i in range(n)],
        )
        blocks = blocks.withColumn("parent", F.expr(f"block div {RADIX}L"))
        own = spans.select(*keys, "chunk", block.alias("own"), F.expr(f"chunk div {width * RADIX}L").alias("parent"))
        level = own.join(blocks, [*keys, "parent"]).filter("block > own").drop("own", "block", "parent")
        out = level if out is None else out.unionByName(level)
        width *= RADIX
    return out


def _path(roots: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes on the way from the roots along the links: keys, chunk, at."""
    node = [*keys, "chunk", "at"]
    jump = links.select(*keys, "from_chunk", "from_at", "chunk", "at")
    entered = jump.select(*node).union(roots.select(*node)).distinct()
    as_from = lambda df: df.withColumnsRenamed({"chunk": "from_chunk", "at": "from_at"})
    on = [*keys, "from_chunk", "from_at"]
    jump = materialize(jump.join(as_from(entered), on, "left_semi"))
    found = materialize(roots.select(*node))
    while not jump.isEmpty():
        found = materialize(found.union(as_from(found).join(jump, on).select(*node)))
        far = jump.withColumnsRenamed({"chunk": "via_chunk", "at": "via_at"})
        step = jump.withColumnsRenamed({"from_chunk": "via_chunk", "from_at": "via_at"})
        jump = materialize(far.join(step, [*keys, "via_chunk", "via_at"]).select(*on, "chunk", "at"))
    return found


def follow(rows: DataFrame, rule, keys: list[str], measures: list[Measure]) -> tuple[DataFrame, DataFrame]:
    """``(starts, ends)`` of the hot keys in ``rows`` (stored, with ``chunk``).

    ``starts``: every span with an overflow or a first event, and the state before it;
    ``ends``: the state each key is left with.  ``fresh`` marks that no bucket is live.
    """
    costs = [m.cost for m in measures]
    states = [*_states(len(costs)), "fresh"]
    ahead = materialize(_ahead(materialize(span_summaries(rows, keys, measures)), keys, len(costs)))
    nodes = materialize(_nodes(rows, rule, keys, costs))
    first = nodes.groupBy(*keys).agg(F.min("chunk").alias("chunk"))
    roots = nodes.filter("root").join(first, [*keys, "chunk"]).withColumn("at", F.col("from_at"))
    links = finals = None
    pending = nodes
    while not pending.isEmpty():
        moved = materialize(_advance(pending, ahead, rule, keys, costs))
        done = moved.filter("to < 0").drop("to")
        entered = materialize(_enter(moved.filter("to >= 0"), rows, rule, keys, costs))
        hits = entered.filter("at >= 0")
        finals = done if finals is None else finals.unionByName(done)
        links = hits if links is None else links.unionByName(hits)
        pending = entered.filter("at < 0")
    path = _path(roots, links, keys).withColumnsRenamed({"chunk": "from_chunk", "at": "from_at"})
    on = [*keys, "from_chunk", "from_at"]
    unknown = [F.lit(None).cast("bigint").alias(s) for s in states[:-1]]
    starts = links.join(path, on, "left_semi").select(*keys, "chunk", *states)
    starts = starts.unionByName(first.select(*keys, "chunk", *unknown, F.lit(True).alias("fresh")))
    return starts, finals.join(path, on, "left_semi").select(*keys, *states)
