"""Bucket kernel, levels, bans and states against the sequential model."""

import random

import numpy as np
import pytest

from leakguard.operators import buckets, kernel, levels, links, links_kernel
from leakguard.schemas import Measure
from tests.model import US, simulate

MEASURES = [
    Measure("request", "one", 1, 3, 100, "r"),
    Measure("byte", "sent", 400, 2500, 200, "b"),
]


def random_events(rng, n, keys=3, late=0.1, gap=3, hot=None):
    clock = {}
    out = []
    for seq in range(n):
        key = 0 if hot and rng.random() < hot else rng.randrange(keys)
        clock[key] = clock.get(key, 1000) + (rng.randrange(gap + 1) if rng.random() < 0.5 else 0)
        if rng.random() < 0.02:
            clock[key] += rng.randrange(30)
        sec = clock[key] - (rng.randrange(8) if rng.random() < late else 0)
        out.append((key, seq, sec * US + rng.randrange(US), (1, rng.randrange(2000))))
    return out


def arrays(events):
    sec = np.array([e[2] // US for e in events], dtype=np.int64)
    time_us = np.array([e[2] for e in events], dtype=np.int64)
    costs = [np.array([e[3][i] for e in events], dtype=np.int64) for i in range(2)]
    return sec, time_us, costs


@pytest.mark.parametrize("floor", [False, True])
@pytest.mark.parametrize("volume", [3, 40, 400])
def test_kernel_equals_model(floor, volume):
    rng = random.Random(volume)
    measures = [
        Measure("request", "one", 1, volume, 100, "r"),
        Measure("byte", "sent", 400, volume * 900, 200, "b"),
    ]
    rule = buckets.bucket_rule(measures, floor)
    for _ in range(60):
        events = random_events(rng, rng.randrange(1, 1500), keys=1, gap=rng.choice([0, 1, 3]))
        bans, _, states = simulate(events, measures, floor)
        cut = rng.randrange(len(events) + 1)
        state, hits = None, []
        for a, b in ((0, cut), (cut, len(events))):
            if a == b:
                continue
            state, part = kernel.run_bucket(rule, *arrays(events[a:b]), state)
            hits += [(0, a + i, m, e) for i, m, e in part]
        assert hits == bans
        expected = states.get(0)
        assert (None if state is None else (*state[0], state[1])) == expected


@pytest.mark.parametrize("floor", [False, True])
def test_kernel_idle_reset(floor):
    rng = random.Random(5)
    rule = buckets.bucket_rule(MEASURES, floor)
    for _ in range(200):
        events = random_events(rng, rng.randrange(1, 120), keys=1)
        bans, _, _ = simulate(events, MEASURES, floor, idle_s=4)
        cut = rng.randrange(len(events) + 1)
        state, seen, hits = None, None, []
        for a, b in ((0, cut), (cut, len(events))):
            if a == b:
                continue
            state, seen, part = kernel.run_with_idle(rule, *arrays(events[a:b]), state, seen, 4)
            hits += [(0, a + i, m, e) for i, m, e in part]
        assert hits == bans


def frame(spark, events):
    rows = [
        (bytearray([0] * 15 + [k]), seq, 4, t, c[1]) for k, seq, t, c in events
    ]
    df = spark.createDataFrame(rows, "client_key binary, seq long, family int, t long, sent long")
    return df.selectExpr("client_key", "seq", "family", "timestamp_micros(t) as time", "sent")


def got_bans(df):
    return sorted(
        (r.client_key[-1], r.seq, r.measure, r.expires_us) for r in df.collect()
    )


@pytest.mark.parametrize("floor", [False, True])
@pytest.mark.parametrize("idle", [None, 4])
@pytest.mark.parametrize("limit", [None, 40])
def test_spark_bans_and_states(spark, floor, idle, limit):
    rng = random.Random(11)
    events = random_events(rng, 1200, keys=6, hot=0.4)
    bans, _, states = simulate(events, MEASURES, floor, idle)
    df = frame(spark, events)
    opts = dict(floor=floor, idle_reset_s=idle, limit=limit)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for prefilter in (True, False) if limit is None else (True,):
            got = buckets.bucket_bans(
                df, ["client_key"], MEASURES, prefilter=prefilter, **opts
            )
            assert got_bans(got) == sorted(bans)
        left = buckets.bucket_states(df, ["client_key"], MEASURES, **opts).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got_states = {r.client_key[-1]: (r.request_level, r.byte_level, r.last_sec) for r in left}
    assert got_states == states


def counted_runs(monkeypatch):
    """How many frames the bucket rule is run over."""
    ran = []
    plain = buckets._run
    monkeypatch.setattr(buckets, "_run", lambda *args: ran.append(args) or plain(*args))
    return ran


def test_dense_resets_that_never_forget(spark, monkeypatch):
    """No leak and equal costs: the phase of the first reset lasts for ever.

    The links find it in one run of the spans and a logarithm of rounds.
    """
    measures = [Measure("request", "one", 0, 6, 100, "r"), Measure("byte", "sent", 0, 10**9, 1, "b")]
    events = [(0, seq, 1000 * US + seq, (1, 1)) for seq in range(600)]
    bans, _, states = simulate(events, measures)
    ran = counted_runs(monkeypatch)
    rounds = []
    plain = links.materialize
    monkeypatch.setattr(links, "materialize", lambda df: rounds.append(df) or plain(df))
    got = buckets.bucket_bans(frame(spark, events), ["client_key"], measures, limit=25)
    assert got_bans(got) == bans
    assert len(ran) == 1 and len(rounds) < 22  # 24 spans, 85 resets
    left = buckets.bucket_states(frame(spark, events), ["client_key"], measures, limit=25).collect()
    assert {r.client_key[-1]: (r.request_level, r.byte_level, r.last_sec) for r in left} == states


def test_forty_spans_without_a_reset_need_no_state_run(spark, monkeypatch):
    measures = [Measure("request", "one", 2, 50, 100, "r"), Measure("byte", "sent", 10, 10**9, 1, "b")]
    events = [(0, 17 * seq, (1000 + seq) * US, (1, 7)) for seq in range(1000)]
    _, _, states = simulate(events, measures)
    monkeypatch.setattr(links, "follow", lambda *args: pytest.fail("links followed"))
    ran = counted_runs(monkeypatch)
    assert got_bans(buckets.bucket_bans(frame(spark, events), ["client_key"], measures, limit=25)) == []
    left = buckets.bucket_states(frame(spark, events), ["client_key"], measures, limit=25).collect()
    assert {r.client_key[-1]: (r.request_level, r.byte_level, r.last_sec) for r in left} == states
    # the frames that the rule runs over have no row of the key
    assert all(rows.count() == 0 for rows, *_ in ran)


@pytest.mark.parametrize("late,radix", [(0, 64), (0.1, 2), (0.7, 64)])
def test_links_equal_model(spark, monkeypatch, late, radix):
    """Windows from a few events to many spans; late events after resets; gaps in seq."""
    monkeypatch.setattr(links, "RADIX", radix)
    rng = random.Random(int(late * 10) + radix)
    events = []
    measures = [Measure("request", "one", 1, 12, 100, "r"), Measure("byte", "sent", 300, 60_000, 200, "b")]
    for key, n, gap in ((0, 500, 0), (1, 400, 1), (2, 300, 3), (3, 30, 1)):
        for i, (_, _, time_us, cost) in enumerate(random_events(rng, n, keys=1, late=late, gap=gap)):
            if rng.random() < 0.01:
                time_us += rng.randrange(-50, 50) * US
            events.append((key, 1000 * i * (key + 1) + key, time_us, cost))
    bans, _, states = simulate(events, measures)
    assert len(bans) > 20
    df = frame(spark, events)
    assert got_bans(buckets.bucket_bans(df, ["client_key"], measures, limit=16)) == sorted(bans)
    left = buckets.bucket_states(df, ["client_key"], measures, limit=16).collect()
    assert {r.client_key[-1]: (r.request_level, r.byte_level, r.last_sec) for r in left} == states


@pytest.mark.parametrize("floor", [False, True])
@pytest.mark.parametrize("limit", [None, 30])
def test_huge_costs_neither_fail_nor_wrap(spark, floor, limit):
    rng = random.Random(21)
    most = (1 << 63) - 1
    events = random_events(rng, 400, keys=3, hot=0.5)
    events = [(k, s, t, (1, most if s % 40 in (3, 4, 5) else c[1])) for k, s, t, c in events]
    # a volume that one huge cost does not pass: sums run over a long before they overflow
    measures = [Measure("request", "one", 1, 300, 100, "r"), Measure("byte", "sent", 400, most, 200, "b")]
    bans, _, states = simulate(events, measures, floor)
    _, plain, _ = simulate(events, measures, floor, reset=False)
    assert bans
    df = frame(spark, events)
    for prefilter in (True, False) if limit is None else (True,):
        got = buckets.bucket_bans(df, ["client_key"], measures, floor=floor, prefilter=prefilter, limit=limit)
        assert got_bans(got) == sorted(bans)
    left = buckets.bucket_states(df, ["client_key"], measures, floor=floor, limit=limit).collect()
    assert {r.client_key[-1]: (r.request_level, r.byte_level, r.last_sec) for r in left} == states
    got = levels.bucket_levels(df, measures, ["client_key"], floor=floor, limit=limit).collect()
    assert {(r.client_key[-1], r.seq): (r.request_level, r.byte_level) for r in got} == {
        k: (a, max(-most, min(most, b))) for k, (a, b) in plain.items()
    }


def test_span_links_equal_steps():
    rng = random.Random(1)
    for trial in range(150):
        measures = [
            Measure("request", "one", rng.choice([0, 1, 2]), rng.choice([3, 20, 100]), 100, "r"),
            Measure("byte", "sent", rng.choice([0, 400]), rng.choice([2500, 40000]), 200, "b"),
        ]
        rule = buckets.bucket_rule(measures, False)
        events = random_events(rng, rng.randrange(1, 200), keys=1, late=rng.choice([0, 0.1, 0.6]), gap=rng.choice([0, 1, 3]))
        sec, time_us, costs = arrays(events)
        if trial % 5 == 0:
            costs[1][rng.randrange(len(events))] = (1 << 63) - 1
        span, n = links_kernel.Span(rule, sec, costs), len(sec)

        def walk(state, at):
            """Index of the first overflow and of the last start, and the state at the end."""
            first, start = n, at
            for k in range(at, n):
                state, hit = kernel.step(rule, state, int(sec[k]), int(time_us[k]), [int(c[k]) for c in costs])
                if hit is not None:
                    first, start = min(first, k), k + 1
            return first, start, state

        way, ends, latest = span.links()
        for j in range(0, n, 7):
            _, start, state = walk(None, j)
            assert way[j] == start
            if state is not None:
                assert (tuple(int(e[start]) for e in ends), int(latest[start])) == (tuple(state[0]), state[1])
        entered = [
            (rng.random() < 0.2, (rng.randrange(-50, 3), rng.randrange(-5000, 2000)), int(sec[0]) + rng.randrange(-20, 20))
            for _ in range(10)
        ]
        fresh = np.array([f for f, _, _ in entered])
        held = [np.array([state[m] for _, state, _ in entered]) for m in range(2)]
        over, ends, top = span.enter(held, np.array([last for _, _, last in entered]), fresh)
        for x, (new, state, last) in enumerate(entered):
            first, _, state = walk(None if new else (state, last), 0)
            assert over[x] == first
            if first == n:
                assert (tuple(int(e[x]) for e in ends), int(top[x])) == (tuple(state[0]), state[1])


@pytest.mark.parametrize("floor", [False, True])
@pytest.mark.parametrize("limit", [None, 50])
def test_levels_equal_model(spark, floor, limit):
    rng = random.Random(3)
    events = random_events(rng, 900, keys=5, hot=0.4)
    _, expected, _ = simulate(events, MEASURES, floor, reset=False)
    got = levels.bucket_levels(
        frame(spark, events), MEASURES, ["client_key"], floor=floor, limit=limit
    ).collect()
    assert {
        (r.client_key[-1], r.seq): (r.request_level, r.byte_level) for r in got
    } == expected


@pytest.mark.parametrize("limit", [None, 50])
def test_idle_levels_equal_model(spark, limit):
    rng = random.Random(4)
    events = random_events(rng, 900, keys=5, hot=0.4)
    _, expected, _ = simulate(events, MEASURES, False, idle_s=4, reset=False)
    got = levels.bucket_levels(
        frame(spark, events), MEASURES, ["client_key"], idle_reset_s=4, limit=limit
    ).collect()
    assert {
        (r.client_key[-1], r.seq): (r.request_level, r.byte_level) for r in got
    } == expected


def test_first_overflow_is_first_ban(spark):
    rng = random.Random(9)
    events = random_events(rng, 400, keys=8)
    bans, _, _ = simulate(events, MEASURES)
    first = {}
    for key, seq, m, _ in bans:
        first.setdefault(key, (seq, MEASURES[m].blame))
    lv = levels.bucket_levels(frame(spark, events), MEASURES, ["client_key"])
    got = levels.first_overflow(lv, MEASURES, ["client_key"]).collect()
    assert {r.client_key[-1]: (r.seq, r.blame) for r in got} == first


CASES = [
    # level equal to the volume is no ban, one more is
    ([(0, 1), (0, 1), (0, 1)], []),
    ([(0, 1), (0, 1), (0, 1), (0, 1)], [(3, 0)]),
    # a late event adds its cost and leaks nothing
    ([(5, 1), (1, 1), (2, 1), (3, 1)], [(3, 0)]),
    # the event after a ban starts a fresh bucket
    ([(0, 1)] * 8, [(3, 0), (7, 0)]),
    # both measures overflow on one event: requests win
    ([(0, 1), (0, 1), (0, 1), (0, 3000)], [(3, 0)]),
    ([(0, 3000)], [(0, 1)]),
]


@pytest.mark.parametrize("events,expected", CASES)
def test_bucket_cases(events, expected):
    rows = [(0, i, (1000 + s) * US + 7, (1, b)) for i, (s, b) in enumerate(events)]
    _, hits = kernel.run_bucket(buckets.bucket_rule(MEASURES, False), *arrays(rows), None)
    assert [(i, m) for i, m, _ in hits] == expected


def test_expiry_keeps_the_fraction_only_when_the_clock_moved():
    rule = buckets.bucket_rule(MEASURES, False)
    moved = [(0, 0, 1000 * US + 5, (1, 3000))]
    _, hits = kernel.run_bucket(rule, *arrays(moved), None)
    assert hits[0][2] == 1000 * US + 5 + 200 * US
    same = [(0, 0, 1000 * US + 5, (1, 0)), (0, 1, 1000 * US + 9, (1, 3000))]
    _, hits = kernel.run_bucket(rule, *arrays(same), None)
    assert hits[0][2] == 1000 * US + 200 * US
