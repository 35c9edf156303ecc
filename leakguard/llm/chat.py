"""Reply trees as conversations: root-to-leaf paths, ranked, each formatted as one text.

A row is a message; its parent is the message named in the column ``parent``, or, without
that column, the message before it in its conversation.  Iterative self-joins find, for
every leaf, all messages above it: each round doubles the distance that a pointer spans,
so a path of n messages takes log2(n) rounds of narrow rows.  Paths are ranked by score
and written in a template:

    <|im_start|>role\\ntext<|im_end|>\\n

Inside texts and roles every ``<|`` gets one more bar (``<||``, ``<|||``, ...), so a
marker can only come from the template; taking the bar away again restores the text.
Line ends inside roles are written as ``<|n|``, which no escaped text can hold.  ``loss``
has the spans of assistant texts (code points, end exclusive) in the formatted text.

One conversation is one output row, so its messages meet in one task; only ids and
numbers pass through the self-joins, keyed by message, whatever the conversation.

Defined results: a null text is empty, a null role is empty; messages are ordered by turn
(null first), then role, then text, so ties and repeated rows are messages of their own;
of a repeated turn, ``parent`` means the first message.  A parent that is missing or does
not come before its child is ignored: the message starts a path.  A null score counts as
0.  A null ``conv_id`` is a conversation.  An empty table gives an empty result.  Extra
columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakguard.llm.shared import materialize, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START, END = "<|im_start|>", "<|im_end|>"
_LINE = "<|n|"
_BARS = re.compile(r"<(\|+)")
_MORE_BARS = re.compile(r"<\|(\|+)")
_ROW = "conv_id bigint, leaf int, path_rank int, score double, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"


def escape(text: str) -> str:
    return _BARS.sub(r"<|\1", text)


def unescape(text: str) -> str:
    return _MORE_BARS.sub(r"<\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the spans of assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = START + escape(role).replace("\n", _LINE) + "\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` wrote."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1].replace(_LINE, "\n")), unescape(m[2])))
        at = m.end()
    return turns


def messages(rows: DataFrame) -> DataFrame:
    """Numbered messages: conv_id, node, parent (a node or null), role, text, score."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    named = rows.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        text_or_empty("role").alias("role"),
        text_or_empty("text").alias("text"),
        *([F.col("parent").cast("bigint")] if "parent" in rows.columns else []),
        (F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in rows.columns else F.lit(0.0)).alias("score"),
    ).withColumn("node", F.row_number().over(order))
    if "parent" not in rows.columns:
        return materialize(
            named.withColumn("up", F.when(F.col("node") > 1, F.col("node") - 1)).drop("turn"), "messages"
        )
    named = materialize(named, "messages")
    first = named.groupBy("conv_id", "turn").agg(F.min("node").alias("up"))
    first = first.selectExpr("conv_id as c", "turn as t", "up")
    joined = named.join(first, named["conv_id"].eqNullSafe(first["c"]) & (named["parent"] == first["t"]), "left")
    up = F.when(F.col("up") < F.col("node"), F.col("up"))
    return joined.withColumn("up", up).drop("c", "t", "turn", "parent")


def paths(nodes: DataFrame) -> DataFrame:
    """(conv_id, leaf, node): every message on the path from each leaf up to its root."""
    links = nodes.select("conv_id", "node", "up")
    inner = links.filter("up is not null").select("conv_id", F.col("up").alias("node")).distinct()
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["node"] == b["node"])
    leaves = links.join(inner, same(links, inner), "left_anti").select("conv_id", "node")
    found = materialize(leaves.selectExpr("conv_id", "node as leaf", "node"), "paths")
    jump = materialize(links.filter("up is not null").selectExpr("conv_id", "node", "up"), "jumps")
    while not jump.isEmpty():
        # all pairs at less than 2^i are known; the pointers span 2^i
        above = found.join(jump, same(found, jump)).select(found["conv_id"], "leaf", F.col("up").alias("node"))
        found = materialize(found.union(above), "paths")
        far = jump.selectExpr("conv_id", "node", "up as via")
        step = jump.selectExpr("conv_id as c", "node as via_node", "up")
        jump = materialize(
            far.join(step, far["conv_id"].eqNullSafe(step["c"]) & (far["via"] == step["via_node"])).select("conv_id", "node", "up"),
            "jumps",
        )
    return found


def _format_task(batches):
    for batch in batches:
        texts, spans = [], []
        for turns in batch.column(5).to_pylist():
            formatted, loss = render([(t["role"], t["text"]) for t in turns])
            texts.append(formatted)
            spans.append([{"start": a, "end": b} for a, b in loss])
        loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(5)), pa.array(texts, pa.string()), pa.array(spans, loss_type)],
            ["conv_id", "leaf", "path_rank", "score", "n_turns", "formatted", "loss"],
        )


def format_trees(rows: DataFrame, best: int | None = None) -> DataFrame:
    """One row per root-to-leaf path: conv_id, leaf, path_rank, score, n_turns, formatted, loss.

    A path's score is the mean of its messages' scores; ``best`` keeps only so many
    paths of each conversation (None: all).
    """
    nodes = messages(rows)
    found = paths(nodes)
    of = found["conv_id"].eqNullSafe(nodes["conv_id"]) & (found["node"] == nodes["node"])
    turns = found.join(nodes, of).select(found["conv_id"], "leaf", found["node"], "role", "text", "score")
    whole = turns.groupBy("conv_id", "leaf").agg(
        F.avg("score").alias("score"),
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("node", "role", "text"))).alias("turns"),
    )
    if best is not None or "parent" in rows.columns:
        scores = turns.groupBy("conv_id", "leaf").agg(F.avg("score").alias("score"))
        rank = Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")
        ranked = scores.select(F.col("conv_id").alias("c"), F.col("leaf").alias("l"), F.row_number().over(rank).alias("path_rank"))
        if best is not None:
            ranked = ranked.filter(F.col("path_rank") <= best)
        whole = whole.join(ranked, whole["conv_id"].eqNullSafe(ranked["c"]) & (whole["leaf"] == ranked["l"]))
    else:
        whole = whole.withColumn("path_rank", F.lit(1))  # without parents a conversation is one path
    return whole.select("conv_id", "leaf", "path_rank", "score", "n_turns", "turns").mapInArrow(_format_task, _ROW)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _read_task(batches):
    for batch in batches:
        n, turn_sums, chars, loss_sums, sizes = [], [], [], [], []
        for formatted, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = parse(formatted)
            under = "".join(unescape(formatted[s["start"] : s["end"]]) for s in loss)
            n.append(len(turns))
            turn_sums.append(_sha("".join(f"{role}\n{text}\n" for role, text in turns)))
            chars.append(len(under))
            loss_sums.append(_sha(under))
            sizes.append(len(formatted))
        arrays = [
            pa.array(v, t)
            for v, t in zip((n, turn_sums, chars, loss_sums, sizes), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *arrays], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted rows hold: turns, text under the loss mask, size."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_read_task, schema)
