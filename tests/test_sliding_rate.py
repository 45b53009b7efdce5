"""Z3 with a sliding window."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from lectern.operators import product as Z

START = datetime(2024, 5, 1, 12, 0, 0)


def rates(spark, events, **options):
    df = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(events)], "event_id int, user_id string, ts timestamp")
    return {r.event_id: (r.uploads, r.over_limit) for r in Z.sliding_rate(df.repartition(3), "user_id", "ts", **options).collect()}


def test_a_burst_across_a_minute_counts_whole(spark):
    events = [("a", START + timedelta(seconds=55 + i)) for i in range(11)] + [("a", START + timedelta(seconds=125)), ("b", None)]
    found = rates(spark, events)
    assert [found[i] for i in range(11)] == [(i + 1, i == 10) for i in range(11)]
    assert found[11] == (1, False) and found[12] == (None, None)
    tumbling = Z.rate_per_minute(spark.createDataFrame(events[:11], "user_id string, ts timestamp"), "user_id", "ts").collect()
    assert not any(r.over_limit for r in tumbling)


def test_slices_do_not_change_the_counts(spark):
    rng = random.Random(3)
    events = [(rng.choice("aab"), START + timedelta(microseconds=rng.randrange(0, 4_000_000_000, 250_000))) for _ in range(600)] + [("a", START)] * 30
    expected = {i: sum(v == u and timedelta(0) <= t - s < timedelta(seconds=60) for v, s in events) for i, (u, t) in enumerate(events)}
    for slices in (1, 7, 1000):
        assert {i: n for i, (n, _) in rates(spark, events, limit=5, slice_windows=slices).items()} == expected
