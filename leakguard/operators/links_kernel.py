"""Next-overflow links inside one span of a key's events.

A bucket that starts fresh at event ``j`` has at event ``i`` the level

    sum(cost[j..i]) - leak * (max(sec[j..i]) - sec[j])

and overflows at the first ``i`` where a measure's level is above its volume.  The latest
second counted is the bucket's own, so a late event may be ahead of it although the key
has seen later ones.  Leaving the maximum out gives an upper bound that needs no range:
``cost sum - leak * sec[i]`` against a number of the bucket alone.  The first event above
that number is found in a tree of maxima, for all buckets at once, then checked exactly;
in the order of time bound and level are equal, so the first one found is the answer.

Only NumPy is used: the functions travel to the Python workers by value.
"""

from __future__ import annotations

import numpy as np

_BIG = 1 << 62


def stored_level(value: int) -> int:
    """A level as a long: a live one is within its volume, and credit stops at a limit."""
    return max(-_BIG, min(int(value), (1 << 63) - 1))


class MaxTree:
    """Maxima over aligned blocks of a power of two; answers many queries at once."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        size = 1
        while size < n:
            size *= 2
        low = -(1 << 200) if values.dtype == object else np.iinfo(np.int64).min
        tree = np.full(2 * size, low, dtype=values.dtype)
        tree[size : size + n] = values
        at = size
        while at > 1:
            tree[at // 2 : at] = np.maximum(tree[at : 2 * at : 2], tree[at + 1 : 2 * at : 2])
            at //= 2
        self.n, self.size, self.tree, self.low = n, size, tree, low

    def first_above(self, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Per query the first index from ``start`` on with a value above ``limit``, else n."""
        node = start + self.size
        found = np.full(len(start), self.n, dtype=np.int64)
        live = np.flatnonzero(start < self.n)
        inside = []
        while live.size:
            hit = self.tree[node[live]] > limit[live]
            inside.append(live[hit])
            live = live[~hit]
            # the next block to the right, as large as its place allows
            node[live] += 1
            node[live] //= node[live] & -node[live]
            live = live[node[live] > 1]
        down = np.concatenate(inside) if inside else live
        while True:
            below = down[node[down] < self.size]
            if not below.size:
                break
            left = 2 * node[below]
            node[below] = left + ~(self.tree[left] > limit[below]).astype(bool)
        found[down] = node[down] - self.size
        return found

    def largest(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Per query the maximum of ``start <= index < stop``."""
        a, b = start + self.size, stop + self.size
        out = np.full(len(start), self.low, dtype=self.tree.dtype)
        while (a < b).any():
            odd = (a < b) & (a & 1 == 1)
            out[odd] = np.maximum(out[odd], self.tree[a[odd]])
            a[odd] += 1
            odd = (a < b) & (b & 1 == 1)
            b[odd] -= 1
            out[odd] = np.maximum(out[odd], self.tree[b[odd]])
            a >>= 1
            b >>= 1
        return out


class Span:
    """One span of events in arrival order."""

    def __init__(self, rule, sec: np.ndarray, costs: list[np.ndarray]):
        self.rule, self.n = rule, len(sec)
        span_s = max(abs(int(sec.max())), abs(int(sec.min()))) + 1
        sums = [max(int(c.max()), -int(c.min())) * self.n for c in costs]
        worst = max(s + 4 * leak * span_s + abs(v) for s, leak, v in zip(sums, rule.leak, rule.volume))
        kind = np.int64 if worst < _BIG else object
        self.kind = kind
        self.sec = sec.astype(kind)
        self.before = [np.concatenate([[0], np.cumsum(c.astype(kind))]).astype(kind) for c in costs]
        self.ahead = [MaxTree(p[1:] - leak * self.sec) for p, leak in zip(self.before, rule.leak)]
        self.ordered = bool((sec[1:] >= sec[:-1]).all())
        self.clock = None if self.ordered else MaxTree(self.sec)

    def _latest(self, start: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.sec[at] if self.ordered else self.clock.largest(start, at + 1)

    def first_over(self, start, base, last) -> np.ndarray:
        """First overflow of each bucket, n without one.

        At event ``i >= start`` a bucket's level of a measure is ``base + before[i + 1] -
        leak * max(latest second since start - last, 0)``.
        """
        limits = [v - b - leak * last for v, b, leak in zip(self.rule.volume, base, self.rule.leak)]
        at = start.astype(np.int64)
        out = np.full(len(at), self.n, dtype=np.int64)
        live = np.arange(len(at))
        while live.size:
            nearest = np.full(live.size, self.n, dtype=np.int64)
            for tree, limit in zip(self.ahead, limits):
                nearest = np.minimum(nearest, tree.first_above(at[live], limit[live]))
            keep = nearest < self.n
            live, nearest = live[keep], nearest[keep]
            if not live.size:
                break
            gone = np.maximum(self._latest(start[live], nearest) - last[live], 0)
            over = np.zeros(live.size, dtype=bool)
            for m, leak in enumerate(self.rule.leak):
                level = base[m][live] + self.before[m][nearest + 1] - leak * gone
                over |= (level > self.rule.volume[m]).astype(bool)
            out[live[over]] = nearest[over]
            live = live[~over]
            at[live] = nearest[~over] + 1
        return out

    def links(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Where a bucket fresh at each event leads to inside the span.

        Returns the last fresh start on its way (n: none is live at the end), and the
        levels and latest second that a bucket fresh at each event has at the end.
        """
        starts = np.arange(self.n)
        base = [-p[:-1] for p in self.before]
        over = self.first_over(starts, base, self.sec)
        way = np.append(np.where(over < self.n, over + 1, starts), self.n)
        while True:
            further = way[way]
            if (further == way).all():
                break
            way = further
        latest = np.maximum.accumulate(self.sec[::-1])[::-1]
        ends = [b + p[-1] - leak * (latest - self.sec) for b, p, leak in zip(base, self.before, self.rule.leak)]
        return way, ends, latest

    def enter(self, levels: list[np.ndarray], last: np.ndarray, fresh: np.ndarray):
        """First overflow of buckets that come in with a state, and their state at the end."""
        start = np.zeros(len(last), dtype=np.int64)
        kind = object if self.kind is object or any(x.dtype == object for x in levels) else np.int64
        base = [np.where(fresh, 0, x).astype(kind) for x in levels]
        last = np.where(fresh, self.sec[0], last).astype(kind)
        over = self.first_over(start, base, last)
        top = np.maximum(last, self.sec.max())
        ends = [b + p[-1] - leak * (top - last) for b, p, leak in zip(base, self.before, self.rule.leak)]
        return over, ends, top


def skip_ahead(rule, levels, last, fresh, blocks):
    """Carry buckets over blocks of spans that cannot make them overflow.

    ``blocks`` are, in order, ``(first span, latest second, sums, bounds)``; a bound is the
    largest ``cost sum - leak * sec`` in the block.  Returns the first span of the block
    that may (-1: none) and the state in front of it, or at the end.
    """
    worst = max((abs(x) for _, _, sums, bounds in blocks for x in (*sums, *bounds)), default=0)
    kind = np.int64 if worst < _BIG >> 2 and last.dtype != object else object
    to = np.full(len(last), -1, dtype=np.int64)
    levels, last = [x.astype(kind) for x in levels], last.astype(kind)
    live = np.arange(len(last))
    for first, latest, sums, bounds in blocks:
        may = fresh[live].copy()
        for level, leak, volume, bound in zip(levels, rule.leak, rule.volume, bounds):
            may |= (level[live] + leak * last[live] + bound > volume).astype(bool)
        to[live[may]] = first
        live = live[~may]
        if not live.size:
            break
        top = np.maximum(last[live], latest)
        for level, leak, total in zip(levels, rule.leak, sums):
            # no overflow in the block, so the level ends within the volume
            level[live] = np.maximum(level[live] + total - leak * (top - last[live]), -_BIG)
        last[live] = top
    return to, levels, last
