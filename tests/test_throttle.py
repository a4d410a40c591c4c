import random
from collections import deque
from datetime import datetime, timedelta, timezone

import pytest

from freshet.operators.throttle import still_counting, throttle

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def brute(rows, window):
    out, logs = {}, {}
    for event, limit, client, at, most in sorted(rows, key=lambda r: (r[3], r[0])):
        log = logs.setdefault((limit, client), deque())
        while log and log[0] <= at - timedelta(seconds=window):
            log.popleft()
        if len(log) >= most:
            left = log[0] + timedelta(seconds=window) - at
            out[event] = (False, left // timedelta(microseconds=1))
        else:
            log.append(at)
            out[event] = (True, window * 1_000_000)
    return out


def made(seed, n=1500):
    rng, rows, now = random.Random(seed), [], START
    for i in range(n):
        now += timedelta(seconds=rng.choice([0, 0.2, 1, 1, 3, 40, 200 if rng.random() < 0.2 else 2]))
        client = "hot" if rng.random() < 0.5 else f"c{rng.randrange(4)}"
        limit, most = rng.choice([("a", 3), ("b", 7)])
        rows.append((i, limit, client, now, most))
    return rows


SCHEMA = "event_id long, limit_name string, client string, ts timestamp, most int"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_one_by_one(spark, seed):
    rows = made(seed)
    found = throttle(spark.createDataFrame(rows, SCHEMA), 10).collect()
    assert {r["event_id"]: (r["allowed"], r["retry_micros"]) for r in found} == brute(rows, 10)
    assert len(found) == len(rows)


def test_carried_requests_count(spark):
    rows = made(9, 800)
    first, second = rows[:400], rows[400:]
    early = throttle(spark.createDataFrame(first, SCHEMA), 10)
    carried = still_counting(early.filter("allowed").select("limit_name", "client", "at"), 10)
    late = throttle(spark.createDataFrame(second, SCHEMA), 10, carried)
    found = {r["event_id"]: (r["allowed"], r["retry_micros"]) for r in early.unionByName(late).collect()}
    assert found == brute(rows, 10)


def test_limits(spark):
    at = [START + timedelta(seconds=s) for s in (0, 1, 2, 59, 60, 61)]
    rows = [(i, "x", "one", t, 2) for i, t in enumerate(at)] + [(9, "x", "two", at[2], 2), (10, "y", "one", at[2], 2)]
    found = {r["event_id"]: r["allowed"] for r in throttle(spark.createDataFrame(rows, SCHEMA), 60).collect()}
    assert found == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 9: True, 10: True}
