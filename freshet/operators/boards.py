"""Feed registry, crawl log and board health."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import vocab
from freshet.operators.skew import global_rank, salted_join

# Board summary of a stretch of the crawl log. Summaries of consecutive stretches can be merged.
SUMMARY = (
    "board string, seq struct<ts:timestamp,n:bigint>, status string, jobs_found bigint, duration_ms bigint, error string, "
    "validator string, changed_at timestamp, empty_tail bigint, broken boolean"
)


def crawlable(registry: DataFrame) -> DataFrame:
    """S10."""
    return registry.filter(F.col("status") != "dead").orderBy("board")


def by_keys(registry: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry rows of the asked boards, and the asked boards that are not registered."""
    return registry.join(keys, "board", "left_semi"), keys.join(registry, "board", "left_anti")


def left_over(asked: DataFrame, done: DataFrame) -> DataFrame:
    """J14."""
    return asked.join(done.select("board"), "board", "left_anti")


def add_new(registry: DataFrame, seed: DataFrame) -> DataFrame:
    """Insert-or-ignore by board."""
    fresh_rows = seed.dropDuplicates(["board"]).join(registry.select("board"), "board", "left_anti")
    return registry.unionByName(fresh_rows)


def sweep_slices(registry: DataFrame, ticks: int = vocab.TICKS_PER_SWEEP) -> DataFrame:
    """Contiguous slices of the ordered registry, sizes within one of each other."""
    ranked = global_rank(registry, [F.asc("board")], "rank")
    size = ranked.count()
    edge = (F.col("rank") + 1) * ticks
    return ranked.withColumn("slice", F.floor((edge + (size - 1)) / F.lit(max(size, 1))) - 1)


def work_batches(registry: DataFrame, per_batch: int = vocab.BOARDS_PER_MESSAGE) -> DataFrame:
    """Boards in order, a fixed number to a batch."""
    ranked = global_rank(registry, [F.asc("board")], "rank")
    return (
        ranked.withColumn("batch", F.floor(F.col("rank") / per_batch))
        .groupBy("batch").agg(F.array_sort(F.collect_list("board")).alias("boards"))
    )


def tick_ordinal(ts: Column) -> Column:
    """Number of the tick inside its sweep."""
    return F.pmod(F.floor(F.unix_seconds(ts) / vocab.TICK_SECONDS), F.lit(vocab.TICKS_PER_SWEEP))


def summarise_log(log: DataFrame) -> DataFrame:
    """One summary per board.

    The streak of empty crawls is the number of empty crawls after the last one that was not.
    Finding that last one combines map-side; only the empty crawls then join it, salted, so a
    board with most of the log is still spread over many tasks.
    """
    seq = F.struct(F.col("ts"), F.col("seq").alias("n"))
    empty = (F.col("status") == "ok") & (F.col("jobs_found") == 0)
    log = log.withColumns({"_seq": seq, "_empty": empty})
    latest = log.groupBy("board").agg(
        F.max_by(F.struct("status", "jobs_found", "duration_ms", "error"), "_seq").alias("row"),
        F.max("_seq").alias("seq"),
        F.max_by("validator", F.when(F.col("validator").isNotNull(), F.col("_seq"))).alias("validator"),
        F.max(F.when(F.col("changed"), F.col("ts"))).alias("changed_at"),
        F.max(F.when(~F.col("_empty"), F.col("_seq"))).alias("last_break"),
        F.count_if("_empty").alias("_n"),
    )
    breaks = latest.filter("_n > 0").select("board", "last_break", "_n")
    empties = log.filter("_empty").select("board", "_seq")
    after = F.col("last_break").isNull() | (F.col("_seq") > F.col("last_break"))
    tails = (
        salted_join(empties, breaks, ["board"], "_n", ["_seq"]).filter(after)
        .groupBy("board").agg(F.count("*").alias("empty_tail"))
    )
    return latest.join(tails, "board", "left").select(
        "board", "seq", "row.status", "row.jobs_found", "row.duration_ms", "row.error", "validator", "changed_at",
        F.coalesce("empty_tail", F.lit(0)).alias("empty_tail"), F.col("last_break").isNotNull().alias("broken"),
    )


def merge_state(state: DataFrame, newer: DataFrame) -> DataFrame:
    """Fold the summary of newer crawls into the stored one; both have one row per board."""
    old, new = state.alias("old"), newer.alias("new")
    both = old.join(new, F.col("old.board") == F.col("new.board"), "full_outer")
    seen = F.col("new.board").isNotNull()

    def latest(name: str) -> Column:
        return F.when(seen, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    carried = F.when(F.coalesce("new.broken", F.lit(False)), F.lit(0)).otherwise(F.coalesce("old.empty_tail", F.lit(0)))
    return both.select(
        F.coalesce("new.board", "old.board").alias("board"),
        *[latest(c) for c in ("seq", "status", "jobs_found", "duration_ms", "error")],
        F.coalesce("new.validator", "old.validator").alias("validator"),
        F.coalesce("new.changed_at", "old.changed_at").alias("changed_at"),
        (carried + F.coalesce("new.empty_tail", F.lit(0))).alias("empty_tail"),
        (F.coalesce("old.broken", F.lit(False)) | F.coalesce("new.broken", F.lit(False))).alias("broken"),
    )


def board_state(summary: DataFrame) -> DataFrame:
    """The stored form: latest crawl, empty streak and sticky values per board."""
    return summary.select(
        "board", "status", "jobs_found", "duration_ms", "error", "validator",
        F.col("empty_tail").alias("consecutive_empty"), "changed_at", F.col("seq.ts").alias("crawled_at"),
    )


def drifted(state: DataFrame, least: int = vocab.DRIFT_MIN_EMPTY) -> DataFrame:
    """T3."""
    return state.filter(F.col("consecutive_empty") >= least).select("board", "consecutive_empty")


def health_changes(registry: DataFrame, drift: DataFrame) -> DataFrame:
    """Boards whose status changes, with the new one; dead boards stay dead."""
    flagged = registry.join(drift.select("board", F.lit(True).alias("is_drifted")), "board", "left")
    down = (F.col("status") == "active") & F.col("is_drifted").isNotNull()
    up = (F.col("status") == "degraded") & F.col("is_drifted").isNull()
    return flagged.filter(down | up).select("board", F.when(down, "degraded").otherwise("active").alias("status"))


def apply_health(registry: DataFrame, changes: DataFrame) -> DataFrame:
    renamed = changes.withColumnRenamed("status", "_new")
    return registry.join(renamed, "board", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def changed_since(state: DataFrame, since: datetime) -> DataFrame:
    """One row, whether any board changed."""
    return state.agg(F.coalesce(F.bool_or(F.col("changed_at") >= F.lit(since)), F.lit(False)).alias("changed"))


def latest_crawl(state: DataFrame) -> DataFrame:
    """A6."""
    return state.agg(F.max("crawled_at").alias("latest"))


def staleness(state: DataFrame, as_of: datetime, minutes: int = vocab.STALE_MINUTES) -> DataFrame:
    """One row; no crawl at all is stale too."""
    limit = as_of - timedelta(minutes=minutes)
    return latest_crawl(state).withColumn("stale", F.col("latest").isNull() | (F.col("latest") < F.lit(limit)))


def run_rollup(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Boards, outcomes, postings found and whether anything was written."""
    ok = F.col("status") == "ok"
    return results.groupBy(*(group or [])).agg(
        F.count("*").alias("boards"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("jobs_found"))), F.lit(0)).alias("discovered"),
        F.sum("duration_ms").alias("duration_ms"),
        F.bool_or("wrote").alias("wrote"),
    )


def skipped(asked: DataFrame, results: DataFrame) -> DataFrame:
    """How many asked boards have no result."""
    return left_over(asked, results).agg(F.count("*").alias("skipped"))
