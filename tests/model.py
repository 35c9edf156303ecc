"""Plain sequential model of the bucket rules, written apart from the library."""

from __future__ import annotations

US = 1_000_000


def simulate(events, measures, floor=False, idle_s=None, reset=True):
    """``events``: ``(key, seq, time_us, costs)`` in any order.

    Returns bans ``[(key, seq, measure, expires_us)]``, levels per ``(key, seq)``
    and the final state per key.
    """
    bans, levels, live, seen = [], {}, {}, {}
    for key, seq, time_us, costs in sorted(events, key=lambda e: e[1]):
        sec = time_us // US
        if idle_s is not None and key in seen and sec - seen[key] > idle_s:
            live.pop(key, None)
        seen[key] = max(seen.get(key, sec), sec)
        bucket = live.get(key)
        if bucket is None:
            bucket = {"level": [0] * len(costs), "last": sec, "exact": time_us}
            delta = 0
        else:
            delta = sec - bucket["last"]
            bucket["exact"] = bucket["last"] * US
        if delta > 0:
            bucket["last"] = sec
            bucket["exact"] = time_us
        for i, cost in enumerate(costs):
            x = bucket["level"][i] + cost
            if delta > 0:
                x -= measures[i].leak * delta
            bucket["level"][i] = max(0, x) if floor else x
        levels[key, seq] = tuple(bucket["level"])
        live[key] = bucket
        if not reset:
            continue
        for i, m in enumerate(measures):
            if bucket["level"][i] > m.volume:
                bans.append((key, seq, i, bucket["exact"] + m.ban_s * US))
                del live[key]
                break
    states = {k: (*b["level"], b["last"]) for k, b in live.items()}
    return bans, levels, states
