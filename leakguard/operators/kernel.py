"""The bucket rule for one key's events in arrival order.

Shared by batch and stream.  Only NumPy and Arrow are used, so the functions
can be shipped to Python workers by value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

US = 1_000_000
_MIN_STEP = 64
_MAX_STEP = 1 << 16
_BIG = 1 << 62


@dataclass(frozen=True)
class Rule:
    """Per-measure settings, in order of precedence."""

    leak: tuple
    volume: tuple
    ban_us: tuple
    floor: bool


def step(rule, state, sec, time_us, cost):
    """One event: ``(new state, None or (measure, expires_us))``.

    Order: add the cost, leak for the elapsed seconds, compare.  A fresh bucket
    (``state`` is ``None``) leaks nothing on its first event.  An overflow drops
    the bucket.
    """
    if state is None:
        levels, last, moved, elapsed = cost, sec, True, 0
    else:
        held, last = state
        elapsed = sec - last
        moved = elapsed > 0
        if moved:
            last = sec
            levels = [h + c - leak * elapsed for h, c, leak in zip(held, cost, rule.leak)]
        else:
            levels = [h + c for h, c in zip(held, cost)]
        if rule.floor:
            levels = [0 if x < 0 else x for x in levels]
    for m, volume in enumerate(rule.volume):
        if levels[m] > volume:
            base = time_us if moved else last * US
            return None, (m, base + rule.ban_us[m])
    return (levels, last), None


def _fits(rule, state, sec, costs):
    """Whether every sum of a slice stays within 64 bits."""
    n, elapsed = len(sec), max(int(sec.max()) - state[1], 0)
    return all(
        abs(level) + n * max(int(c.max()), -int(c.min())) + leak * elapsed < _BIG
        for level, leak, c in zip(state[0], rule.leak, costs)
    )


def run_bucket(rule, sec, time_us, costs, state):
    """Feed events to a bucket that is dropped whenever it overflows.

    ``state`` is ``None`` for a fresh bucket, else ``(levels, last_sec)``.
    Returns the state left behind and ``[(index, measure, expires_us), ...]``.

    Short buckets go event by event.  A bucket that outlives a slice goes on
    with whole slices: the levels of all its events are computed at once and
    the slice ends at its first overflow.  A slice whose sums could run over 64 bits
    goes event by event, in Python's integers.
    """
    hits = []
    n = len(sec)
    i = 0
    width = _MIN_STEP
    while i < n:
        j = min(n, i + width)
        if width == _MIN_STEP or not _fits(rule, state, sec[i:j], [c[i:j] for c in costs]):
            found = len(hits)
            rows = zip(sec[i:j].tolist(), time_us[i:j].tolist(), zip(*[c[i:j].tolist() for c in costs]))
            for at, (s, t, cost) in enumerate(rows, i):
                state, hit = step(rule, state, s, t, cost)
                if hit is not None:
                    hits.append((at, *hit))
            i = j
            keeps = found == len(hits) and state is not None
            width = min(width * 2, _MAX_STEP) if keeps else _MIN_STEP
            continue
        s = sec[i:j]
        levels, start = state
        last = np.maximum(np.maximum.accumulate(s), start)
        elapsed = last - start
        reached, over = [], []
        for m, cost in enumerate(costs):
            level = levels[m] + np.cumsum(cost[i:j]) - rule.leak[m] * elapsed
            if rule.floor:
                level = level - np.minimum(np.minimum.accumulate(level), 0)
            reached.append(level)
            over.append(level > rule.volume[m])
        any_over = over[0] if len(over) == 1 else np.logical_or.reduce(over)
        k = int(any_over.argmax())
        if not any_over[k]:
            state = (tuple(int(level[-1]) for level in reached), int(last[-1]))
            i = j
            width = min(width * 2, _MAX_STEP)
            continue
        m = next(m for m in range(len(over)) if over[m][k])
        before = int(last[k - 1]) if k else start
        base = int(time_us[i + k]) if int(s[k]) > before else int(last[k]) * US
        hits.append((i + k, m, base + rule.ban_us[m]))
        state = None
        i += k + 1
        width = _MIN_STEP
    return state, hits


def run_with_idle(rule, sec, time_us, costs, state, seen_max, idle_s):
    """``run_bucket`` with a fresh bucket after every gap above ``idle_s``.

    ``seen_max`` is the latest second ever seen for the key; it outlives bans.
    Returns ``(state, seen_max, hits)``.
    """
    top = np.maximum.accumulate(sec)
    if seen_max is not None:
        top = np.maximum(top, seen_max)
    prev = np.empty_like(top)
    prev[1:] = top[:-1]
    prev[0] = sec[0] if seen_max is None else seen_max
    cuts = [0, *np.flatnonzero(sec - prev > idle_s).tolist(), len(sec)]
    hits = []
    for at, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if at:
            state = None
        if a == b:
            continue
        state, part = run_bucket(
            rule, sec[a:b], time_us[a:b], [c[a:b] for c in costs], state
        )
        hits.extend((a + i, m, e) for i, m, e in part)
    return state, int(top[-1]), hits


def bucket_mapper(rule, keys, costs, keep, emit):
    """``mapInArrow`` function over rows sorted by ``keys`` and ``seq``.

    A row flagged ``carried`` in front of a group hands in its starting state
    (``in_last`` and ``in_<i>``).  ``emit`` is ``"bans"`` (columns ``keep`` of the
    overflowing event, ``measure``, ``expires_us``) or ``"states"`` (``keys``,
    ``out_last``, ``out_<i>``, NULL after a ban).  Only the running state is held
    between Arrow batches.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    state_types = [pa.int64()] * (1 + len(costs))

    def ints(column):
        return column.fill_null(0).to_numpy(zero_copy_only=False)

    def state_batch(rows, states):
        picked = pa.concat_tables([pa.Table.from_batches([r]) for r in rows])
        arrays = [picked.column(k).combine_chunks() for k in keys]
        lasts = [None if s is None else s[1] for s in states]
        levels = [[None if s is None else max(s[0][m], -_BIG) for s in states] for m in range(len(costs))]
        arrays += [pa.array(v, t) for v, t in zip([lasts, *levels], state_types)]
        names = [*keys, "out_last", *[f"out_{m}" for m in range(len(costs))]]
        return pa.RecordBatch.from_arrays(arrays, names)

    def group_starts(batch, previous):
        n = batch.num_rows
        change = np.zeros(n, dtype=bool)
        change[0] = previous is None
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k))
            if n > 1:
                change[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(
                    zero_copy_only=False
                )
            if previous is not None and not change[0]:
                old = previous.column(previous.schema.get_field_index(k))
                change[0] = column[0].as_py() != old[0].as_py()
        return np.flatnonzero(change)

    def run(batches):
        previous = None
        state = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = group_starts(batch, previous)
            col = {name: batch.column(at) for at, name in enumerate(batch.schema.names)}
            sec, time_us = ints(col["sec"]), ints(col["time_us"])
            cost = [ints(col[c]) for c in costs]
            carried = col["carried"].fill_null(False).to_numpy(zero_copy_only=False)
            bounds = starts.tolist()
            if not bounds or bounds[0] != 0:
                bounds = [0, *bounds]
                opened = False
            else:
                opened = True
            bounds.append(n)
            picked, which, expires = [], [], []
            done_rows, done_states = [], []
            for at, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if at or opened:
                    if at or previous is not None:
                        done_rows.append(batch.slice(a - 1, 1) if a else previous)
                        done_states.append(state)
                    state = None
                if carried[a]:
                    last = col["in_last"][a].as_py()
                    state = (
                        None
                        if last is None
                        else (tuple(col[f"in_{m}"][a].as_py() for m in range(len(costs))), last)
                    )
                    a += 1
                if a == b:
                    continue
                state, hits = run_bucket(
                    rule, sec[a:b], time_us[a:b], [c[a:b] for c in cost], state
                )
                for i, m, e in hits:
                    picked.append(a + i)
                    which.append(m)
                    expires.append(e)
            previous = batch.slice(n - 1, 1)
            if emit == "states":
                if done_rows:
                    yield state_batch(done_rows, done_states)
            elif picked:
                taken = batch.take(pa.array(picked, pa.int64()))
                arrays = [taken.column(taken.schema.get_field_index(k)) for k in keep]
                arrays += [pa.array(which, pa.int32()), pa.array(expires, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "measure", "expires_us"])
        if emit == "states" and previous is not None:
            yield state_batch([previous], [state])

    return run
