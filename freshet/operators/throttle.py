"""Sliding-log throttle: which requests of a client stay under its limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.skew import salted_join

OUT = "event_id long, limit_name string, client string, at long, allowed boolean, retry_micros long"
KEYS = ["limit_name", "client"]


def _decide(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, taken = None, deque()  # at most `most` times, carried from batch to batch
        for batch in batches:
            out = []
            for event, limit, client, stretch, at, most, given in batch.itertuples(index=False, name=None):
                if group != (limit, client, stretch):
                    group, taken = (limit, client, stretch), deque()
                while taken and taken[0] <= at - window:
                    taken.popleft()
                if given:
                    taken.append(at)
                elif len(taken) >= most:
                    out.append((event, limit, client, at, False, taken[0] + window - at))
                else:
                    taken.append(at)
                    out.append((event, limit, client, at, True, window))
            if out:
                yield pd.DataFrame(out, columns=["event_id", "limit_name", "client", "at", "allowed", "retry_micros"])

    return run


def throttle(events: DataFrame, window_seconds: int, carried: DataFrame | None = None) -> DataFrame:
    """Allow a request while fewer than `most` allowed ones lie in the trailing window.

    `events` has event_id, limit_name, client, ts and most. Rejected requests do not count, so a
    decision depends on earlier decisions. Only crowded stretches need them in sequence: in a
    window-long slot that holds, with the slot before it, at most `most` requests, all are allowed.
    Each run of crowded slots is decided on its own, after the requests of the quiet slot before
    it, streaming through a task with a bounded memory. Only a client that is crowded without a
    break is one single run.

    `carried` holds allowed requests (limit_name, client, at) from before these events.
    """
    window = window_seconds * 1_000_000
    columns = ["event_id", *KEYS, "at", "most", "given"]
    rows = events.withColumns({"at": F.unix_micros("ts"), "given": F.lit(False)}).select(*columns)
    if carried is not None:
        most = events.groupBy(*KEYS).agg(F.max("most").alias("most"))
        before = carried.join(most, KEYS).withColumns({"event_id": F.lit(-1).cast("long"), "given": F.lit(True)})
        rows = rows.unionByName(before.select(*columns))
    rows = rows.withColumn("slot", F.floor(F.col("at") / window))

    # One row per client and slot; a client has as many as the log has slots.
    slots = rows.groupBy(*KEYS, "slot").agg(F.count("*").alias("n"), F.max("most").alias("most"))
    by_client = Window.partitionBy(*KEYS).orderBy("slot")
    previous = F.when(F.lag("slot").over(by_client) == F.col("slot") - 1, F.lag("n").over(by_client))
    slots = slots.withColumn("crowded", F.col("n") + F.coalesce(previous, F.lit(0)) > F.col("most"))
    was_crowded = (F.lag("slot").over(by_client) == F.col("slot") - 1) & F.lag("crowded").over(by_client)
    starts = F.col("crowded") & ~F.coalesce(was_crowded, F.lit(False))
    slots = slots.withColumn("starts", starts)
    next_starts = (F.lead("slot").over(by_client) == F.col("slot") + 1) & F.lead("starts").over(by_client)
    slots = slots.select(
        *KEYS, "slot", "n",
        F.when(F.col("crowded"), F.max(F.when(F.col("starts"), F.col("slot"))).over(by_client)).alias("stretch"),
        F.when(~F.col("crowded") & next_starts, F.col("slot") + 1).alias("leads_into"),
    )
    placed = salted_join(rows, slots, [*KEYS, "slot"], "n", ["event_id", "at"])

    quiet = placed.filter(F.col("stretch").isNull() & ~F.col("given")).select(
        "event_id", *KEYS, "at", F.lit(True).alias("allowed"), F.lit(window).cast("long").alias("retry_micros")
    )
    sequence = ["event_id", *KEYS, "stretch", "at", "most", "given"]
    crowded = placed.filter("stretch is not null").select(*sequence).unionByName(
        placed.filter("leads_into is not null")
        .withColumns({"stretch": F.col("leads_into"), "given": F.lit(True)}).select(*sequence)
    )
    decided = (
        crowded.repartition(*KEYS, "stretch").sortWithinPartitions(*KEYS, "stretch", "at", F.desc("given"), "event_id")
        .mapInPandas(_decide(window), OUT)
    )
    return quiet.unionByName(decided)


def still_counting(allowed: DataFrame, window_seconds: int) -> DataFrame:
    """Allowed requests that lie in the window before each client's last request; at most the limit."""
    newest = allowed.groupBy(*KEYS).agg(F.max("at").alias("last"), F.count("*").alias("n"))
    window = window_seconds * 1_000_000
    return salted_join(allowed, newest, KEYS, "n", ["at"]).filter(F.col("at") > F.col("last") - window).select(*KEYS, "at")
