"""Conversation structure repair: the cheapest edits that make a dialogue well formed.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``: nothing,
or an optional system turn and then user and assistant in turn.  Rows come in order of
turn (null first), then role, then text.  A row's first fault counts: *blank* (only
``\\x20\\x09-\\x0D``), *duplicate* (role and text of an earlier row), *truncated* (the last
character that is not one of those is not ``.``, ``!`` or ``?``).  Edits and costs:

    Keep 0 | Rerole to user or assistant 1 | Delete 2 | Insert an empty user or assistant turn 5

A blank or duplicate row must be deleted; a truncated row that stays costs 5 more.  Of the
edits of least cost, the ones whose initials in order are least in ASCII win.

The search is depth-first branch and bound with an explicit stack.  A node is (rows
decided, place in the pattern); its suffix bound, summed up from the end, is the least that
the remaining rows can cost from that place.  The incumbent starts at the bound of the whole
and only a cheaper result replaces it; a prefix goes when its cost and its suffix bound do
not stay below the incumbent.  Edits are tried in the order of their letters, so prefixes
come in the order of their audits.  An audit fixes its cost, so of two prefixes of equal
cost at one node neither is the beginning of the other, and what follows cannot turn their
order around: a node's dominance table holds the least cost that reached it, and a later
prefix of the same cost or more is worse.  An empty stack proves the incumbent (cost, audit)
best.  Time and memory grow with the rows of the conversation.

One conversation is one output row, so its rows meet in one task, in sorted order.

Defined results: nulls become one space first (in role, text, and in the text that picks
the damage), a null turn is left out of ``gaps``, a null ``conv_id`` is a conversation,
repeated rows and equal turns are rows of their own (the later is a duplicate if role and
text agree), a conversation without rows gives zeros and an empty result, an empty table
an empty one.  Texts of any length are read whole.  Extra columns do not matter.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANK = " \t\n\x0b\x0c\r"  # the characters \x20 and \x09-\x0D
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# Short conversations with the same faults and roles have the same edits.
LONGEST_REMEMBERED, MOST_REMEMBERED = 32, 1 << 14

# Places in the pattern: nothing yet, after system, after user, after assistant.
_NEW, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_NEW: ("u", _USER), _SYSTEM: ("u", _USER), _USER: ("a", _ASSISTANT), _ASSISTANT: ("u", _USER)}
_COMPLETE = (_NEW, _ASSISTANT)
_ROLE = {"u": "user", "a": "assistant"}

ROW = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired array<struct<role:string,text:string>>"
)


def _choices(place: int, initial: str, fault: str) -> list[tuple[str, int, int]]:
    """Edits of one row at a place, in the order of their letters: (letter, cost, next place)."""
    if fault in "bd":
        return [("D", DELETE, place)]
    wanted, then = _NEXT[place]
    stays = TRUNCATED if fault == "t" else 0
    out = [("D", DELETE, place)]
    if initial == wanted:
        out.append(("K", KEEP + stays, then))
    elif initial == "s" and place == _NEW:
        out.append(("K", KEEP + stays, _SYSTEM))
    return [*out, ("R", REROLE + stays, then)]


def _with_inserts(least: list[int]) -> list[int]:
    """Least costs by place when inserts may come first."""
    user = min(least[_USER], least[_ASSISTANT] + INSERT)
    assistant = min(least[_ASSISTANT], user + INSERT)
    user = min(user, assistant + INSERT)
    return [min(least[_NEW], user + INSERT), min(least[_SYSTEM], user + INSERT), user, assistant]


def suffix_bounds(facts) -> list[list[int]]:
    """Per row and place, what the rows from there on cost at least."""
    never = 1 << 60
    bounds = [_with_inserts([0 if place in _COMPLETE else never for place in range(4)])]
    for initial, fault in reversed(facts):
        after = bounds[-1]
        one = [min(cost + after[then] for _, cost, then in _choices(place, initial, fault)) for place in range(4)]
        bounds.append(_with_inserts(one))
    bounds.reverse()
    return bounds


def best_edits(facts) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits; a fact is a role initial and a fault (b, d, t or -)."""
    n, bounds = len(facts), suffix_bounds(facts)
    incumbent, audit = bounds[0][_NEW] + 1, ""
    least: dict = {}  # dominance: the least cost that reached a node
    path = bytearray()
    stack = [(0, _NEW, 0, 0, "")]
    while stack:
        at, place, cost, depth, letter = stack.pop()
        if cost + bounds[at][place] >= incumbent or least.get((at, place), incumbent) <= cost:
            continue
        least[at, place] = cost
        if letter:
            path[depth - 1 :] = letter.encode()
        if at == n and place in _COMPLETE:
            incumbent, audit = cost, path[:depth].decode()
            continue
        edits = [(at + 1, then, more, choice) for choice, more, then in _choices(place, *facts[at])] if at < n else []
        edits.append((at, _NEXT[place][1], INSERT, "I"))
        for next_at, then, more, choice in sorted(edits, key=lambda e: e[3], reverse=True):
            stack.append((next_at, then, cost + more, depth + 1, choice))
    return incumbent, audit


def _remembered(facts: tuple, known: dict) -> tuple[int, str]:
    if len(facts) > LONGEST_REMEMBERED:
        return best_edits(facts)
    if facts not in known:
        if len(known) >= MOST_REMEMBERED:
            known.clear()
        known[facts] = best_edits(facts)
    return known[facts]


def apply_edits(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The repaired (role, text) rows that an audit describes."""
    out: list[tuple[str, str]] = []
    place, at = _NEW, 0
    for letter in audit:
        wanted, then = _NEXT[place]
        if letter == "D":
            at += 1
            continue
        if letter == "I":
            out.append((_ROLE[wanted], ""))
        else:
            role, text = rows[at]
            at += 1
            if letter == "R":
                role = _ROLE[wanted]
            elif place == _NEW and role[:1] == "s":
                then = _SYSTEM
            out.append((role, text))
        place = then
    return out


def repair_rows(turns: list, rows: list[tuple[str, str]], known: dict) -> tuple:
    """Counts, cost, audit and repaired rows of one conversation in its order."""
    seen: set = set()
    facts, counts = [], {"b": 0, "d": 0, "t": 0, "-": 0}
    for role, text in rows:
        bare = text.strip(BLANK)
        fault = "b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        counts[fault] += 1
        facts.append((role[:1], fault))
    at = [t for t in turns if t is not None]
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
    cost, audit = _remembered(tuple(facts), known)
    return gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, apply_edits(rows, audit)


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_TYPES = [*[pa.int64()] * 7, pa.string(), _TURNS]
_NAMES = [c.split()[0] for c in ROW.split(", ")]


def _repair_task(batches):
    """Sorted rows (conv_id, turn, role, text, gone) in, one row per conversation out."""

    def batch_of(done):
        columns = list(zip(*done, strict=True))
        columns[-1] = [[{"role": r, "text": t} for r, t in rows] for rows in columns[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    known: dict = {}
    current, turns, rows, open_ = None, [], [], False
    for batch in batches:
        done = []
        for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if open_ and conv != current:
                done.append((current, *repair_rows(turns, rows, known)))
                turns, rows = [], []
            current, open_ = conv, True
            if not gone:
                turns.append(turn)
                rows.append((role, text))
        if done:
            yield batch_of(done)
    if open_:
        yield batch_of([(current, *repair_rows(turns, rows, known))])


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null: one space) and ``gone`` (false)."""
    return conversations.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.lit(False).alias("gone"),
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20; a dropped row stays as ``gone``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = plain(conversations).withColumn("_how", F.crc32(key.cast("binary")) % 20)
    how = F.col("_how")
    copies = F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(how == 1, F.lit("")).when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(how == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (how == 0).alias("gone"), F.explode(copies)
    ).drop("col")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``plain`` or ``damage`` rows: counts, cost, audit, repaired turns."""
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.select("conv_id", "turn", "role", "text", "gone").mapInArrow(_repair_task, ROW)


def digest(repaired: DataFrame) -> DataFrame:
    """The report with the repaired turns as the digest of their ``role:text`` lines."""
    lines = F.transform("repaired", lambda t: F.concat_ws(":", t["role"], t["text"]))
    return repaired.withColumn("repaired_sha256", F.sha2(F.concat_ws("\n", lines).cast("binary"), 256)).drop("repaired")
