"""Registered queries: crawl log, registry, sweep slices, throttle and run roll-ups."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import boards
from freshet.operators.throttle import throttle
from freshet.plans.binding import (
    LOG_SQL, REGISTRY_SQL, STATE_SQL, crawl_log, events_as_of, registry, stamp,
)
from freshet.session import read_table

QUERIES, SQL = {}, {}
AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
STATE = f"WITH {STATE_SQL}"
DRIFT = 2  # the events table has few empty crawls in a row


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


def log(spark: SparkSession, sf: str) -> DataFrame:
    return crawl_log(read_table(spark, sf, "events"))


def state(spark: SparkSession, sf: str) -> DataFrame:
    return boards.board_state(boards.summarise_log(log(spark, sf)))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return registry(read_table(spark, sf, "events"))


def printed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: stamp(c) for c in ("changed_at", "crawled_at", "latest") if c in rows.columns})


STATE_COLUMNS = f"""board, status, jobs_found, duration_ms, error, validator, consecutive_empty,
{AT.format('changed_at')} AS changed_at, {AT.format('crawled_at')} AS crawled_at"""


@query(f"{STATE} SELECT {STATE_COLUMNS} FROM state")
def status_fold(spark, sf):
    return printed(state(spark, sf))


@query(f"{STATE} SELECT {STATE_COLUMNS} FROM state")
def status_fold_merged(spark, sf):
    """The log folded in two stretches and merged, as the stream does it."""
    rows = log(spark, sf)
    middle = F.lit(events_as_of(spark, sf) - timedelta(days=12))
    early = boards.summarise_log(rows.filter(F.col("ts") < middle))
    late = boards.summarise_log(rows.filter(F.col("ts") >= middle))
    return printed(boards.board_state(boards.merge_state(early, late)))


@query(f"{STATE} SELECT board, consecutive_empty FROM state WHERE consecutive_empty >= {DRIFT}")
def drifted_boards(spark, sf):
    return boards.drifted(state(spark, sf), DRIFT)


HEALTH = f"""{STATE}, {REGISTRY_SQL}, drift AS (SELECT board FROM state WHERE consecutive_empty >= {DRIFT}),
moves AS (SELECT board, CASE WHEN status = 'active' THEN 'degraded' ELSE 'active' END AS status FROM registry r
WHERE (status = 'active' AND board IN (FROM drift)) OR (status = 'degraded' AND board NOT IN (FROM drift)))"""


def moves(spark, sf) -> DataFrame:
    return boards.health_changes(sources(spark, sf), boards.drifted(state(spark, sf), DRIFT))


@query(f"{HEALTH} SELECT board, status FROM moves")
def health_transition(spark, sf):
    return moves(spark, sf)


@query(f"{HEALTH} SELECT r.board, coalesce(m.status, r.status) AS status, label FROM registry r LEFT JOIN moves m ON r.board = m.board")
def health_applied(spark, sf):
    return boards.apply_health(sources(spark, sf), moves(spark, sf))


@query(f"{STATE} SELECT bool_or(coalesce(changed_at >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE, FALSE)) AS changed FROM state")
def change_gate(spark, sf):
    return boards.changed_since(state(spark, sf), events_as_of(spark, sf) - timedelta(minutes=30))


@query(f"WITH {LOG_SQL} SELECT {AT.format('max(ts)')} AS latest, max(ts) < (SELECT max(ts) FROM events) + INTERVAL 70 MINUTE - INTERVAL 60 MINUTE AS stale FROM log")
def staleness(spark, sf):
    return printed(boards.staleness(state(spark, sf), events_as_of(spark, sf) + timedelta(minutes=70)))


@query(f"WITH {REGISTRY_SQL} SELECT board, status, label FROM registry WHERE status <> 'dead'")
def crawlable_boards(spark, sf):
    return boards.crawlable(sources(spark, sf))


# Asked boards: one per customer, of which only those with a user of the same number are registered.
ASKED_SQL = "asked AS (SELECT 'u' || c_custkey AS board FROM customer)"


def asked(spark, sf) -> DataFrame:
    return read_table(spark, sf, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("board"))


@query(f"WITH {REGISTRY_SQL}, {ASKED_SQL} SELECT board, status, label FROM registry WHERE board IN (FROM asked)")
def registry_lookup(spark, sf):
    return boards.by_keys(sources(spark, sf), asked(spark, sf))[0]


@query(f"WITH {REGISTRY_SQL}, {ASKED_SQL} SELECT board FROM asked WHERE board NOT IN (SELECT board FROM registry)")
def unknown_boards(spark, sf):
    return boards.by_keys(sources(spark, sf), asked(spark, sf))[1]


@query(f"""WITH {REGISTRY_SQL}, {ASKED_SQL} SELECT board, status, label FROM registry
UNION ALL SELECT board, 'active', NULL FROM asked WHERE board NOT IN (SELECT board FROM registry)""")
def seed_registry(spark, sf):
    seed = asked(spark, sf).select("board", F.lit("active").alias("status"), F.lit(None).cast("string").alias("label"))
    return boards.add_new(sources(spark, sf), seed)


@query(f"""WITH {ASKED_SQL}, ranked AS (SELECT board, row_number() OVER (ORDER BY board) - 1 AS rank, count(*) OVER () AS n FROM asked),
edges AS (SELECT k, k * n // 4 AS lo, (k + 1) * n // 4 AS hi FROM range(4) t(k), (SELECT count(*) AS n FROM asked))
SELECT board, rank, k AS slice FROM ranked JOIN edges ON rank >= lo AND rank < hi""")
def sweep_slices(spark, sf):
    return boards.sweep_slices(asked(spark, sf))


@query(f"""WITH {ASKED_SQL}, ranked AS (SELECT board, row_number() OVER (ORDER BY board) - 1 AS rank FROM asked)
SELECT rank // 8 AS batch, string_agg(board, ',' ORDER BY board) AS boards FROM ranked GROUP BY 1""")
def work_batches(spark, sf):
    return boards.work_batches(asked(spark, sf)).select("batch", F.array_join("boards", ",").alias("boards"))


@query("SELECT event_id, CAST(floor(epoch(ts) / 1800) AS BIGINT) % 4 AS tick FROM events")
def tick_ordinals(spark, sf):
    rows = read_table(spark, sf, "events")
    return rows.select("event_id", boards.tick_ordinal(F.col("ts").cast("timestamp")).alias("tick"))


RUN_SQL = """count(*) AS boards, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed,
CAST(coalesce(sum(jobs_found) FILTER (status = 'ok'), 0) AS BIGINT) AS discovered, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, bool_or(changed) AS wrote"""


@query(f"WITH {LOG_SQL} SELECT {AT.format('time_bucket(INTERVAL 30 MINUTE, ts)')} AS tick, {RUN_SQL} FROM log GROUP BY 1")
def tick_rollup(spark, sf):
    rows = log(spark, sf).withColumn("tick", F.window("ts", "30 minutes")["start"]).withColumnRenamed("changed", "wrote")
    return boards.run_rollup(rows, ["tick"]).withColumn("tick", stamp("tick"))


@query(f"WITH {LOG_SQL} SELECT {RUN_SQL} FROM log")
def run_rollup(spark, sf):
    return boards.run_rollup(log(spark, sf).withColumnRenamed("changed", "wrote"))


@query(f"WITH {LOG_SQL}, {ASKED_SQL} SELECT count(*) AS skipped FROM asked WHERE board NOT IN (SELECT board FROM log)")
def skipped_boards(spark, sf):
    return boards.skipped(asked(spark, sf), log(spark, sf))


@query(f"WITH {LOG_SQL} SELECT {AT.format('time_bucket(INTERVAL 1 HOUR, ts)')} AS hour, status, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM log GROUP BY 1, 2")
def metrics_rollup(spark, sf):
    from freshet.streaming.metrics import request_metrics

    rows = request_metrics(log(spark, sf), ["status"], "1 hour")
    return rows.select(stamp("start").alias("hour"), "status", "n", *[F.round(c, 6).alias(c) for c in ("mean_ms", "p95_ms")])


WINDOW_SECONDS, MOST = 2 * 86400, 3  # the events are sparse, so the window is long


def requests(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("event_type").alias("limit_name"), F.col("user_id").cast("string").alias("client"),
        F.col("ts").cast("timestamp").alias("ts"), F.lit(MOST).cast("int").alias("most"),
    )


@query(f"""WITH lists AS (SELECT user_id, event_type, list(event_id ORDER BY ts, event_id) AS ids, list(epoch_us(ts) ORDER BY ts, event_id) AS times
FROM events GROUP BY 1, 2),
taken AS (SELECT user_id, event_type, ids, times, list_reduce(list_transform(times, lambda t: [t]), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda a: a > x[1] - {WINDOW_SECONDS}000000)) < {MOST} THEN list_concat(acc, x) ELSE acc END) AS allowed FROM lists),
each AS (SELECT unnest(ids) AS event_id, unnest(times) AS t, allowed FROM taken)
SELECT event_id, list_contains(allowed, t) AS allowed, CASE WHEN list_contains(allowed, t) THEN {WINDOW_SECONDS}000000
  ELSE list_min(list_filter(allowed, lambda a: a > t - {WINDOW_SECONDS}000000 AND a <= t)) + {WINDOW_SECONDS}000000 - t END AS retry_micros FROM each""")
def throttle_flags(spark, sf):
    return throttle(requests(read_table(spark, sf, "events")), WINDOW_SECONDS).select("event_id", "allowed", "retry_micros")
