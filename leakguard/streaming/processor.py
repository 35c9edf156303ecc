"""State for one key in a stream: buckets, and the last known size of a path.

Self-contained, like the bucket rule: it travels to the Python workers by value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from leakguard.operators.kernel import run_bucket, run_with_idle


class BucketProcessor(StatefulProcessor):
    """Feeds each micro-batch of a key to the bucket rule, in arrival order.

    A ban clears the bucket state.  ``seen`` (latest second of the key) is kept
    across bans; it is only used with an idle reset.  There is no watermark:
    late events are accepted without limit.
    """

    def __init__(self, rule, keys, costs, idle_s=None, ttl_ms=None):
        self.rule = rule
        self.keys = keys
        self.costs = costs
        self.idle_s = idle_s
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        levels = ", ".join(f"l{i} long" for i in range(len(self.costs)))
        self.bucket = handle.getValueState("bucket", f"last long, {levels}", self.ttl_ms)
        self.seen = handle.getValueState("seen", "sec long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        # bounded by the micro-batch, whose size the trigger options limit
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        sec = pdf["sec"].to_numpy(np.int64)
        time_us = pdf["time_us"].to_numpy(np.int64)
        costs = [pdf[c].to_numpy(np.int64) for c in self.costs]
        stored = self.bucket.get() if self.bucket.exists() else None
        state = None if stored is None else (tuple(stored[1:]), stored[0])
        if self.idle_s is None:
            state, hits = run_bucket(self.rule, sec, time_us, costs, state)
        else:
            seen = self.seen.get()[0] if self.seen.exists() else None
            state, seen, hits = run_with_idle(
                self.rule, sec, time_us, costs, state, seen, self.idle_s
            )
            self.seen.update((seen,))
        if state is not None:
            self.bucket.update((int(state[1]), *[int(x) for x in state[0]]))
        elif stored is not None:
            self.bucket.clear()
        if hits:
            at = [i for i, _, _ in hits]
            out = pdf.iloc[at][["seq", "family"]].reset_index(drop=True)
            for name, value in reversed(list(zip(self.keys, key))):
                out.insert(0, name, [value] * len(out))
            out["measure"] = np.array([m for _, m, _ in hits], dtype=np.int32)
            out["expires_us"] = np.array([e for _, _, e in hits], dtype=np.int64)
            yield out

    def close(self) -> None:
        pass


class SizeProcessor(StatefulProcessor):
    """Gives requests the last looked-up size of their path.

    Rows are lookups (``lookup`` true) and requests of one part of a path's clients.
    The lookups of a micro-batch count before its requests.  An entry is good for
    ``ttl_s`` after its scan, by the time of the request; failed lookups are not kept.
    """

    def __init__(self, carried, ttl_s):
        self.carried = carried
        self.ttl_s = ttl_s

    def init(self, handle) -> None:
        self.entry = handle.getValueState("entry", "scanned long, is_dir boolean, size long")

    def handleInputRows(self, key, rows, timerValues):
        # bounded by the micro-batch, whose size the trigger options limit
        pdf = pd.concat(list(rows), ignore_index=True)
        stored = self.entry.get() if self.entry.exists() else None
        best = None if stored is None else (stored[0], bool(stored[1]), -1 if stored[2] is None else stored[2])
        found = pdf[pdf["lookup"]]
        for scanned, is_dir, size in zip(found["scanned"], found["is_dir"], found["size"]):
            # of equal times the larger entry: the answer is the same every time
            entry = (int(scanned), bool(is_dir), -1 if pd.isna(size) else int(size))
            best = entry if best is None else max(best, entry)
        if len(found):
            self.entry.update((best[0], best[1], None if best[2] < 0 else best[2]))
        asked = pdf[~pdf["lookup"].astype(bool)]
        if len(asked):
            out = asked[self.carried].reset_index(drop=True)
            good = np.zeros(len(out), dtype=bool)
            if best is not None:
                good = asked["sec"].to_numpy(np.int64) <= best[0] + self.ttl_s
                # a looked-up file that is not there is known to be missing
                good &= best[1] or best[2] >= 0
            out["found"] = good
            out["is_dir"] = good & (best is not None and best[1])
            size = best[2] if best is not None and best[2] >= 0 else None
            out["size"] = pd.array([size if g else None for g in good], dtype="Int64")
            yield out

    def close(self) -> None:
        pass
