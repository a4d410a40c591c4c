"""Keyed stream state: processors against plain Python over random batches, and an alert that no row brings about."""

import random
import time
from collections import deque
from datetime import datetime, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from freshet.plans.streams import workdir
from freshet.streaming import keyed

SECOND = 1_000_000


class Value:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Listed(Value):
    def get(self):
        return iter(self.held or [])

    def put(self, values):
        self.held = list(values)


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):  # noqa: N802
        return Value()

    def getListState(self, name, schema):  # noqa: N802
        return Listed()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at


def drive(processor, batches, watermark=None):
    """Rows that a processor writes for one key; after each batch the timers up to its watermark fire."""
    handle, out = Handle(), []
    processor.init(handle)
    for batch in batches:
        if batch:
            out += list(processor.handleInputRows(("k",), iter(batch), None))
        for at in sorted(t for t in handle.timers if watermark is not None and batch and t <= watermark(batch)):
            handle.timers.discard(at)
            out += list(processor.handleExpiredTimer(("k",), None, Expired(at)))
    return out


def batches_of(rows, pick):
    """Consecutive batches of rows, each in any order."""
    out, at = [], 0
    while at < len(rows):
        n = pick.randint(0, 7)
        batch = rows[at : at + n]
        pick.shuffle(batch)
        out.append(batch)
        at += n
    return out


def clock(batch):
    return max(r["at"] for r in batch) // 1000


@pytest.mark.parametrize("seed", range(20))
def test_status_fold(seed):
    pick = random.Random(seed)
    rows, at = [], 0
    for seq in range(60):
        at += pick.choice([0, 5, 60]) * SECOND
        status = pick.choice(["ok", "ok", "ok", "error"])
        rows.append(Row(at=at, seq=seq, status=status, jobs_found=pick.choice([0, 0, 3]), duration_ms=seq, error=None, validator=pick.choice([None, f"v{seq}"]), changed=pick.choice([True, False, None])))
    batches = batches_of(rows, pick)
    out = drive(keyed.StatusFold(), [b for batch in batches for b in (batch, batch)])  # every batch comes twice
    streak, validator, changed = 0, None, None
    for r in rows:
        streak = streak + 1 if r["status"] == "ok" and r["jobs_found"] == 0 else 0
        validator = r["validator"] or validator
        changed = r["at"] if r["changed"] else changed
    last = out[-1].asDict()
    assert (last["seq"], last["empty"], last["validator"], last["changed_at"]) == (59, streak, validator, changed)
    assert len(out) == sum(1 for b in batches if b)  # a repeated batch writes nothing


def test_long_streak_is_pruned():
    rows = [Row(at=i, seq=i, status="ok", jobs_found=int(i % 5000 == 0), duration_ms=1, error=None, validator=None, changed=False) for i in range(20_003)]
    random.Random(1).shuffle(rows)
    assert drive(keyed.StatusFold(), [rows])[0]["empty"] == 2


@pytest.mark.parametrize("seed", range(20))
def test_throttle(seed):
    pick = random.Random(seed)
    rows, at = [], 0
    for event in range(120):
        at += pick.choice([0, 1, 3, 20]) * SECOND
        rows.append(Row(at=at, event_id=event, most=3))
    processor = keyed.Throttle(10)
    out = {r["event_id"]: (r["allowed"], r["retry_micros"]) for r in drive(processor, batches_of(rows, pick), clock)}
    log, expected = deque(), {}
    for r in rows:
        while log and log[0] <= r["at"] - 10 * SECOND:
            log.popleft()
        if len(log) < 3:
            log.append(r["at"])
            expected[r["event_id"]] = (True, 10 * SECOND)
        else:
            expected[r["event_id"]] = (False, log[0] + 10 * SECOND - r["at"])
    assert out == expected
    drive_on = [t for t in sorted(processor.handle.timers)]
    for t in drive_on:
        list(processor.handleExpiredTimer(("k",), None, Expired(t)))
    assert not list(processor.taken.get())  # timers forget a client


@pytest.mark.parametrize("seed", range(20))
def test_first_seen(seed):
    pick = random.Random(seed)
    rows = [Row(seq=i, posted=pick.choice([0, 30, 59, 60, 61, 300, -30, -60, -61, -4000]) * SECOND + pick.randint(-3, 3)) for i in range(40)]
    out = drive(keyed.FirstSeen(60), batches_of(rows, pick))
    stored = None
    for r in rows:
        if stored is None or (r["posted"] <= stored + 60 * SECOND and abs(r["posted"] - stored) >= 60 * SECOND):
            stored = r["posted"]
    assert out[-1]["posted"] == stored


@pytest.mark.parametrize("seed", range(20))
def test_stale_boards(seed):
    pick = random.Random(seed)
    times, at = [], 0
    for _ in range(60):
        at += pick.choice([0, 1, 9, 10, 11, 50]) * SECOND
        times.append(at)
    out = drive(keyed.StaleBoards(10, True), batches_of([Row(at=t) for t in times], pick), lambda b: clock(b) - 1)
    expected = []
    for a, b in zip(sorted(set(times)), sorted(set(times))[1:]):
        if b - a > 10 * SECOND:
            expected += [(a + 10 * SECOND, True), (b, False)]
    assert [(r["at"], r["stale"]) for r in out] == expected


@pytest.mark.parametrize("seed", range(20))
def test_live_rows(seed):
    pick = random.Random(seed)
    day = 86_400 * SECOND
    times, at = [], 0
    for _ in range(60):
        at += pick.choice([0, 1, 3, 4, 9]) * day
        times.append(at)
    out = drive(keyed.LiveRows(4), [*batches_of([Row(at=t) for t in times], pick)], clock)
    expected, since = [], None
    for t in times:
        if since is None or t >= since + 4 * day:
            expected += [] if since is None else [(since + 4 * day, False)]
            expected.append((t, True))
            since = t
    assert [(r["at"], r["live"]) for r in out][: len(expected)] == expected and len(out) <= len(expected) + 1


def test_alert_without_input(spark):
    """One crawl and then nothing: the alert comes by the clock alone."""
    root = workdir(spark)
    rows = spark.createDataFrame([("quiet", datetime(2024, 1, 1, tzinfo=timezone.utc))], "board string, ts timestamp")
    rows.write.parquet(f"{root}/landed")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/landed")
    running = keyed.start(keyed.stale_changes(stream, 5, None), f"{root}/out", f"{root}/checkpoint", processingTime="1 second")
    try:
        found, until = [], time.time() + 120
        while not found and time.time() < until:
            time.sleep(2)
            assert running.exception() is None
            if running.recentProgress:
                found = [tuple(r) for r in spark.read.schema("board string, at long, stale boolean").parquet(f"{root}/out/*").collect()]
        alert_at = time.time()
    finally:
        running.stop()
    assert [(b, s) for b, _, s in found] == [("quiet", True)]
    assert alert_at - 120 < found[0][1] / SECOND < alert_at
    assert sum(p["numInputRows"] for p in running.recentProgress) == 1


def test_expiry_and_reappearance(spark):
    """Seen again while live: nothing. Seen again after its age: removed and added. Never seen again: removed by the watermark."""
    days = [("a", 0), ("a", 5), ("b", 40), ("b", 44), ("c", 80), ("a", 120), ("a", 122)]
    root = workdir(spark)
    start = datetime(2020, 1, 1, tzinfo=timezone.utc).timestamp()
    for name, day in days:
        row = spark.createDataFrame([(name, start + day * 86_400)], "id string, s double").select("id", F.timestamp_seconds("s").alias("posted_at"))
        row.write.mode("append").parquet(f"{root}/landed")
    stream = spark.readStream.schema("id string, posted_at timestamp").option("maxFilesPerTrigger", 3).parquet(f"{root}/landed")
    keyed.start(keyed.live_changes(stream, 15, "1 hour"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    found = {(r["id"], round((r["at"] / SECOND - start) / 86_400), r["live"]) for r in spark.read.parquet(f"{root}/out").collect()}
    assert found == {("a", 0, True), ("a", 15, False), ("a", 120, True), ("b", 40, True), ("b", 55, False), ("c", 80, True), ("c", 95, False)}


class Counting(Value):
    """A value state that counts how often the store is asked."""

    def __init__(self):
        super().__init__()
        self.asked = 0

    def get(self):
        self.asked += 1
        return super().get()

    def update(self, value):
        self.asked += 1
        super().update(value)

    def clear(self):
        self.asked += 1
        super().clear()


class GroupHandle(Handle):
    def getValueState(self, name, schema):  # noqa: N802
        self.state = Counting()
        return self.state


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


def drive_group(make, out, batches):
    """Rows of many keys through one group, timers up to the watermark after each batch; and how often the store was asked."""
    import pandas as pd

    columns = [c for c in batches[0][0] if c != "id"]
    processor, handle, found, calls = keyed.Grouped(make(), ["id"], columns, out), GroupHandle(), [], 0
    processor.init(handle)
    for batch in batches:
        found += [tuple(r) for f in processor.handleInputRows((7,), iter([pd.DataFrame(batch[:5]), pd.DataFrame(batch[5:])]), None) for r in f.itertuples(index=False)]
        calls += 1
        now = max(r["at"] for r in batch) // 1000
        for at in sorted(t for t in handle.timers if t < now):
            handle.timers.discard(at)
            calls += 1
            found += [tuple(r) for f in processor.handleExpiredTimer((7,), Watermark(now), Expired(at)) for r in f.itertuples(index=False)]
    return found, handle.state.asked, calls


@pytest.mark.parametrize("seed", range(5))
def test_group_of_keys_asks_the_store_once(seed):
    """Many keys in one group give what each gives alone, and the store is read and written once a visit."""
    pick = random.Random(seed)
    day = 86_400 * SECOND
    batches = [
        [{"id": f"i{k}", "at": (10 * b + pick.randint(0, 9)) * day, "seq": b, "posted": pick.randint(-200, 200) * SECOND} for k in pick.sample(range(60), 50) for _ in range(2)]
        for b in range(6)
    ]
    now = {id(b): max(r["at"] for r in b) // 1000 for b in batches}
    for make, out in ((lambda: keyed.LiveRows(4), keyed.LiveRows.OUT), (lambda: keyed.FirstSeen(60), keyed.FirstSeen.OUT)):
        expected = []
        for key in sorted({r["id"] for b in batches for r in b}):
            processor, handle = make(), Handle()
            processor.init(handle)
            for b in batches:
                own = [Row(**r) for r in b if r["id"] == key]
                expected += list(processor.handleInputRows((key,), iter(own), None)) if own else []
                for at in sorted(t for t in handle.timers if t < now[id(b)]):
                    handle.timers.discard(at)
                    expected += list(processor.handleExpiredTimer((key,), None, Expired(at)))
        found, asked, calls = drive_group(make, out, batches)
        assert sorted(found) == sorted(tuple(r) for r in expected) and found
        assert asked <= 2 * calls and calls <= 3 * len(batches)


def test_null_numbers_in_groups(spark):
    """A null among a group's numbers is a null to the processor, and no number loses digits by it."""
    big = 2**53 + 1
    root = workdir(spark)
    rows = spark.createDataFrame([("a", 0, None), ("a", 1, None), ("b", 0, big)], "id string, seq int, posted long")
    rows.write.parquet(f"{root}/landed")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/landed")
    changes = keyed.in_groups(stream, ["id"], ["seq", "posted"], keyed.FirstSeen(60), keyed.FirstSeen.OUT, "Update", "None", groups=1)
    keyed.start(changes, f"{root}/out", f"{root}/checkpoint", "update").awaitTermination()
    found = {tuple(r)[:3] for r in spark.read.parquet(f"{root}/out").select("id", "posted", "corrections").collect()}
    assert found == {("a", None, 1), ("b", big, 0)}
