"""Per-key state of streams in Spark's state store: folds, limits, first dates, staleness and expiry.

Each processor keeps a small state per key in the store (RocksDB, so it need not fit in memory) and
writes only what changes; nothing is reread or rewritten from batch to batch, and a stream started again
goes on from its checkpoint. Times in state are microseconds since 1970, timers milliseconds.

Rows of a key may come in any order within a micro-batch and in time order from one to the next. In
event time a row older than the watermark is late and dropped by Spark.

Streams with very many small keys keep them in groups by a hash of the key (`Grouped`): the store is asked
once for a group and not several times for every key, which is what such a stream's time went into.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which keyed state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def start(changes: DataFrame, out: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Write the changes of every micro-batch to a folder of its own under `out`; a repeated batch overwrites it."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with rocksdb(changes.sparkSession):
        stream = changes.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
        return stream.trigger(**(trigger or {"availableNow": True})).start()


def newest(changes: DataFrame, key: str) -> DataFrame:
    """The last change of every key; `batch` is the micro-batch that wrote it."""
    columns = [c for c in changes.columns if c not in (key, "batch")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_row")).select(key, "_row.*")


NOTHING = -(2**63)  # stands for a null on the way to Python, as pandas would make fractions of whole numbers with nulls
GROUPS = 4096  # of keys, by hash; fixed for the life of a checkpoint, a group grows with the number of live keys


class _Single:
    """A value state of the key at hand, in its group's memory."""

    def __init__(self, group: Grouped) -> None:
        self.group, self.of = group, {}

    def get(self):
        return self.of.get(self.group.key)

    def update(self, value) -> None:
        self.of[self.group.key] = value

    def clear(self) -> None:
        self.of.pop(self.group.key, None)


class _Several(_Single):
    """A list state of the key at hand."""

    def get(self):
        return iter(self.of.get(self.group.key, ()))

    def put(self, values) -> None:
        self.of[self.group.key] = list(values)


class _Expiry:
    def __init__(self, at: int) -> None:
        self.at = at

    def getExpiryTimeInMs(self) -> int:  # noqa: N802
        return self.at


class Grouped(StatefulProcessor):
    """Runs a processor for every key of a group, whose states and timers lie in the store as one value.

    To the processor it is the handle of the key at hand. The group's own timer stands at the first of
    its keys' timers. A task holds one group at a time: its states and its rows of the micro-batch.
    """

    def __init__(self, inner: StatefulProcessor, keys: Sequence[str], columns: Sequence[str], out: str) -> None:
        self.inner, self.keys, self.columns = inner, list(keys), list(columns)
        self.out = [c.split(" ")[0] for c in out.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store, self.held = handle, handle.getValueState("held", "held binary")
        self.states: dict[str, _Single] = {}
        self.timers: dict[tuple, set[int]] = {}
        self.key = None
        self.inner.init(self)

    def getValueState(self, name: str, schema) -> _Single:  # noqa: N802
        return self.states.setdefault(name, _Single(self))

    def getListState(self, name: str, schema) -> _Several:  # noqa: N802
        return self.states.setdefault(name, _Several(self))

    def registerTimer(self, at: int) -> None:  # noqa: N802
        self.timers.setdefault(self.key, set()).add(at)

    def _load(self) -> int | None:
        held = self.held.get()
        states, self.timers = pickle.loads(bytes(held[0])) if held else ({}, {})
        for name, state in self.states.items():
            state.of = states.get(name, {})
        return self._first()

    def _first(self) -> int | None:
        return min((at for several in self.timers.values() for at in several), default=None)

    def _save(self, timer: int | None) -> None:
        """Write the group back; `timer` stands already."""
        states = {name: state.of for name, state in self.states.items() if state.of}
        if states or self.timers:
            self.held.update((pickle.dumps((states, self.timers), protocol=5),))
        else:
            self.held.clear()
        first = self._first()
        if first is not None and first != timer:
            self.store.registerTimer(first)

    def _frame(self, rows: list[Row]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([[r[c] for c in self.out] for r in rows], columns=self.out, dtype=object)

    def _column(self, frame: pd.DataFrame, name: str) -> list:
        return [None if v == NOTHING else v for v in frame[name].tolist()]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        by_key: dict[tuple, list[tuple]] = {}
        for frame in rows:
            own = zip(*[frame[k].tolist() for k in self.keys])
            for k, row in zip(own, zip(*[self._column(frame, c) for c in self.columns])):
                by_key.setdefault(k, []).append(row)

        def given(held: list[tuple]) -> Iterator[dict]:
            while held:
                yield dict(zip(self.columns, held.pop()))

        timer, out = self._load(), []
        for self.key, held in by_key.items():
            out += self.inner.handleInputRows(self.key, given(held), timerValues)
        self._save(timer)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All timers of the group's keys that are over by now, each key's in their order."""
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        self._load()
        out = []
        for self.key, several in list(self.timers.items()):
            over = sorted(t for t in several if t <= at or t < now)
            several.difference_update(over)
            for t in over:
                out += self.inner.handleExpiredTimer(self.key, timerValues, _Expiry(t))
            if not several:
                del self.timers[self.key]
        if out or self._first() != at:
            self._save(None)
        yield from self._frame(out)


def in_groups(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], inner: StatefulProcessor, out: str, mode: str, times: str, groups: int = GROUPS) -> DataFrame:
    """A processor over `rows` grouped by the strings `keys`, which reads the whole numbers `columns` of them; in event time or without timers."""
    # The hash takes null keys too.
    placed = rows.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int"))
    placed = placed.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(NOTHING)) for c in columns})
    return placed.groupBy("_group").transformWithStateInPandas(Grouped(inner, keys, columns, out), out, mode, times)


class StatusFold(StatefulProcessor):
    """Latest crawl of a board, its streak of empty crawls and its sticky values.

    Only the empty crawls after the last one that was not are held while a batch is read. A row that is
    not newer than the board's latest crawl of an earlier batch was folded already and is passed over.
    """

    STATE = "at long, seq long, status string, jobs_found long, duration_ms long, error string, validator string, changed_at long, empty long"
    OUT = f"board string, {STATE}"
    NAMES = [c.split(" ")[0] for c in STATE.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", self.STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.state.get()
        seen = (old[0], old[1]) if old else None
        last = broken = marked = None
        changed = old[7] if old else None
        tail: list[tuple[int, int]] = []
        held = 1000
        for r in rows:
            at = (r["at"], r["seq"])
            if seen and at <= seen:
                continue
            if last is None or at > (last["at"], last["seq"]):
                last = r
            if r["validator"] is not None and (marked is None or at > marked[0]):
                marked = (at, r["validator"])
            if r["changed"]:
                changed = at[0] if changed is None else max(changed, at[0])
            if r["status"] != "ok" or r["jobs_found"] != 0:
                broken = at if broken is None else max(broken, at)
            elif broken is None or at > broken:
                tail.append(at)
                if len(tail) > held and broken:
                    tail = [x for x in tail if x > broken]
                    held = 2 * len(tail) + 1000
        if last is None:
            return
        empty = sum(broken is None or x > broken for x in tail) + (old[8] if old and broken is None else 0)
        validator = marked[1] if marked else old[6] if old else None
        new = (last["at"], last["seq"], last["status"], last["jobs_found"], last["duration_ms"], last["error"], validator, changed, empty)
        self.state.update(new)
        yield Row(board=key[0], **dict(zip(self.NAMES, new)))


def status_changes(log: DataFrame) -> DataFrame:
    """The state of every board that a micro-batch of the crawl log touches."""
    rows = log.withColumn("at", F.unix_micros("ts")).select("board", "at", "seq", "status", "jobs_found", "duration_ms", "error", "validator", "changed")
    return rows.groupBy("board").transformWithState(StatusFold(), StatusFold.OUT, "Update", "None")


def board_state(changes: DataFrame) -> DataFrame:
    """The stored form of the newest states."""
    return newest(changes, "board").select(
        "board", "status", "jobs_found", "duration_ms", "error", "validator", F.col("empty").alias("consecutive_empty"),
        F.timestamp_micros("changed_at").alias("changed_at"), F.timestamp_micros("at").alias("crawled_at"),
    )


class Throttle(StatefulProcessor):
    """Allow a request while fewer than `most` allowed ones lie in the trailing window.

    The store lists the allowed times of a client that still count, at most its limit of them. A timer
    forgets them when the watermark has passed the window of the last one.
    """

    OUT = "event_id long, allowed boolean, retry_micros long"

    def __init__(self, window_seconds: int) -> None:
        self.window = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.taken = handle, handle.getListState("taken", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        taken = deque(sorted(x[0] for x in self.taken.get()))
        out = []
        for at, event, most in sorted((r["at"], r["event_id"], r["most"]) for r in rows):
            while taken and taken[0] <= at - self.window:
                taken.popleft()
            allowed = len(taken) < most
            out.append(Row(event_id=event, allowed=allowed, retry_micros=self.window if allowed else taken[0] + self.window - at))
            if allowed:
                taken.append(at)
        if taken:
            self.taken.put([(x,) for x in taken])
            self.handle.registerTimer((taken[-1] + self.window) // 1000 + 1)
        else:
            self.taken.clear()
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        over = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.window
        kept = [x for x in self.taken.get() if x[0] > over]
        self.taken.put(kept) if kept else self.taken.clear()
        return iter(())


def throttle_changes(requests: DataFrame, window_seconds: int, lateness: str) -> DataFrame:
    """A decision for every request (event_id, limit_name, client, ts, most)."""
    rows = requests.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    return in_groups(rows, ["limit_name", "client"], ["at", "event_id", "most"], Throttle(window_seconds), Throttle.OUT, "Append", "EventTime")


class FirstSeen(StatefulProcessor):
    """The date a posting was first seen with.

    A later date is a re-post and ignored, an earlier one a correction; a difference under the tolerance is
    none. Rows are taken in the order of `seq`. A change is the first date or a correction.
    """

    OUT = "id string, posted long, corrections int"

    def __init__(self, tolerance_seconds: int) -> None:
        self.tolerance = tolerance_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "posted long, corrections int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.first.get()
        posted, corrections = (old[0], old[1]) if old else (None, -1)
        for _, new in sorted((r["seq"], r["posted"]) for r in rows):
            if posted is None or (new <= posted + self.tolerance and abs(new - posted) >= self.tolerance):
                posted, corrections = new, corrections + 1
        if old is None or posted != old[0] or corrections != old[1]:
            self.first.update((posted, corrections))
            yield Row(id=key[0], posted=posted, corrections=corrections)


def first_seen_changes(sightings: DataFrame, tolerance_seconds: int) -> DataFrame:
    """New and corrected dates of sightings (id, seq, posted_at)."""
    rows = sightings.select("id", "seq", F.unix_micros("posted_at").alias("posted"))
    return in_groups(rows, ["id"], ["seq", "posted"], FirstSeen(tolerance_seconds), FirstSeen.OUT, "Update", "None")


class StaleBoards(StatefulProcessor):
    """An alert when a board has not been crawled for so long, and its end with the next crawl.

    A timer stands at the end of each board's grace, so the alert needs no row: in event time it comes
    when the watermark passes, in processing time when the clock does.
    """

    OUT = "board string, at long, stale boolean"

    def __init__(self, grace_seconds: int, event_time: bool) -> None:
        self.grace, self.event_time = grace_seconds * 1_000_000, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long, alerted boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.latest.get()
        last, alerted = (old[0], old[1]) if old else (None, False)
        now = None if self.event_time else timerValues.getCurrentProcessingTimeInMs() * 1000
        for at in sorted({r["at"] for r in rows} if now is None else {now for _ in rows}):
            if last is not None and at <= last:
                continue
            if last is not None and at > last + self.grace:
                if not alerted:
                    yield Row(board=key[0], at=last + self.grace, stale=True)
                yield Row(board=key[0], at=at, stale=False)
            last, alerted = at, False
        if old is None or last != old[0]:
            self.latest.update((last, alerted))
            self.handle.registerTimer((last + self.grace) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        last, alerted = self.latest.get()
        if not alerted and last + self.grace < expiredTimerInfo.getExpiryTimeInMs() * 1000:  # no crawl since the timer was set
            self.latest.update((last, True))
            yield Row(board=key[0], at=last + self.grace, stale=True)


def stale_changes(log: DataFrame, grace_seconds: int, lateness: str | None) -> DataFrame:
    """Alerts and their ends (board, at, stale); lateness None: by the clock, without any watermark."""
    rows = (log.withWatermark("ts", lateness) if lateness else log).select("board", "ts", F.unix_micros("ts").alias("at"))
    how = StaleBoards(grace_seconds, lateness is not None)
    return rows.groupBy("board").transformWithState(how, StaleBoards.OUT, "Append", "EventTime" if lateness else "ProcessingTime")


class LiveRows(StatefulProcessor):
    """An id is added when it comes and is not live, and removed when its age is over.

    A row of a live id changes nothing. Removals come out when the watermark passes, or with a later row of
    the id, so tables behind the stream can follow.
    """

    OUT = "id string, at long, live boolean"

    def __init__(self, days: int) -> None:
        self.age = days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.since.get()
        since = old[0] if old else None
        for at in sorted({r["at"] for r in rows}):
            if since is not None and at < since + self.age:
                continue
            if since is not None:
                yield Row(id=key[0], at=since + self.age, live=False)
            since = at
            yield Row(id=key[0], at=at, live=True)
        if since is not None and (old is None or since != old[0]):
            self.since.update((since,))
            self.handle.registerTimer((since + self.age) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        old = self.since.get()
        if old and (old[0] + self.age) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.since.clear()
            yield Row(id=key[0], at=old[0] + self.age, live=False)


def live_changes(rows: DataFrame, days: int, lateness: str) -> DataFrame:
    """Additions and removals (id, at, live) of rows (id, posted_at)."""
    timed = rows.withWatermark("posted_at", lateness).select("id", "posted_at", F.unix_micros("posted_at").alias("at"))
    return in_groups(timed, ["id"], ["at"], LiveRows(days), LiveRows.OUT, "Append", "EventTime")
