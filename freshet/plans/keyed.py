"""Registered queries: streams with keyed state over whole tables, which arrive in slices.

Every slice is a run of its own from the same checkpoint, so each query also shows that state survives
a restart. The number of slices is fixed; a slice grows with its table and is read in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.functions import vocab
from freshet.plans import binding, health
from freshet.plans.binding import POSTINGS_SQL, postings, stamp
from freshet.plans.streams import finish, workdir
from freshet.session import cut, read_table
from freshet.streaming import keyed

QUERIES, SQL = {}, {}
SLICES = 5
LATENESS, LATENESS_SQL = "1 hour", "INTERVAL 1 HOUR"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


def time_slice(rows: DataFrame, column: str) -> Column:
    """0 to SLICES - 1 in the order of a timestamp; slices hold about equally many rows, equal times one slice."""
    at = rows.select(F.unix_micros(column).cast("double").alias("at"))
    edges = at.approxQuantile("at", [k / SLICES for k in range(1, SLICES)], 0.001)
    return sum((F.when(F.unix_micros(column) > edge, 1).otherwise(0) for edge in edges), F.lit(0))


def in_slices(rows: DataFrame, number: Column, changes: Callable[[DataFrame], DataFrame], mode: str = "append", root: str | None = None) -> DataFrame:
    """What a keyed stream writes while the rows land slice after slice; it is started anew after each."""
    spark = rows.sparkSession
    root = root or workdir(spark)
    parted = cut(rows.withColumn("_slice", number.cast("int")), "_slice")
    for k in range(SLICES):
        parted.filter(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/landed")
        finish(keyed.start(changes(stream), f"{root}/out", f"{root}/checkpoint", mode))
    return spark.read.parquet(f"{root}/out")


@query(health.SQL["status_fold"])
def keyed_status_fold(spark, sf):
    rows = health.log(spark, sf)
    return health.printed(keyed.board_state(in_slices(rows, time_slice(rows, "ts"), keyed.status_changes, "update")))


@query(health.SQL["throttle_flags"])
def keyed_throttle(spark, sf):
    rows = health.requests(read_table(spark, sf, "events"))
    return in_slices(rows, time_slice(rows, "ts"), lambda s: keyed.throttle_changes(s, health.WINDOW_SECONDS, LATENESS)).drop("batch")


# Every posting is seen SLICES times, each time with its date moved by one of these many seconds.
MOVED = (0, 30, 172_800, -45, -86_400, 90)


def sightings(spark: SparkSession, sf: str) -> DataFrame:
    rows = postings(spark, sf).select("id", "num", "posted_at", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("seq"))
    moved = F.element_at(F.array(*[F.lit(m) for m in MOVED]), (F.pmod(F.col("num") + F.col("seq"), F.lit(len(MOVED))) + 1).cast("int"))
    return rows.select("id", "seq", F.timestamp_seconds(F.unix_seconds("posted_at") + moved).alias("posted_at"))


@query(f"""WITH {POSTINGS_SQL}, seen AS (SELECT id, list_transform(range(0, {SLICES}), lambda k: [CAST(epoch(posted_at) AS BIGINT) + list_extract({list(MOVED)}, CAST((num + k) % {len(MOVED)} + 1 AS BIGINT)), 0]) AS s FROM postings),
folded AS (SELECT id, list_reduce(s, lambda a, x: CASE WHEN x[1] > a[1] + 60 OR abs(x[1] - a[1]) < 60 THEN a ELSE [x[1], a[2] + 1] END) AS f FROM seen)
SELECT id, strftime(make_timestamp(f[1] * 1000000), '%Y-%m-%d %H:%M:%S') AS posted_at, CAST(f[2] AS INT) AS corrections FROM folded""")
def keyed_first_seen(spark, sf):
    """T7 over dates that move forward, backward and within the tolerance."""
    rows = sightings(spark, sf)
    changes = in_slices(rows, F.col("seq"), lambda s: keyed.first_seen_changes(s, vocab.POSTED_DRIFT_SECONDS), "update")
    return keyed.newest(changes, "id").select("id", stamp(F.timestamp_micros("posted")).alias("posted_at"), "corrections")


GRACE_HOURS = 24  # the events are sparse


@query(f"""WITH {binding.LOG_SQL}, span AS (SELECT date_trunc('day', min(ts)) AS first, date_trunc('millisecond', max(ts)) - {LATENESS_SQL} AS last FROM log),
ticks AS (SELECT unnest(generate_series(first, last, INTERVAL 1 DAY)) AS tick FROM span),
latest AS (SELECT tick, board, max(ts) AS latest FROM ticks JOIN log ON ts <= tick GROUP BY 1, 2)
SELECT strftime(tick, '%Y-%m-%d %H:%M:%S') AS tick, board FROM latest WHERE latest < tick - INTERVAL {GRACE_HOURS} HOUR""")
def keyed_stale_boards(spark, sf):
    """Boards that are stale at each day's tick, from alerts and their ends."""
    rows = health.log(spark, sf).select("board", "ts")
    changes = in_slices(rows, time_slice(rows, "ts"), lambda s: keyed.stale_changes(s, GRACE_HOURS * 3600, LATENESS))
    last = F.lit(binding.events_as_of(spark, sf)) - F.expr(f"INTERVAL {LATENESS}")
    # Alerts and ends of a board take turns; there is at most one alert in each stretch of the grace.
    following = F.lead("at").over(Window.partitionBy("board").orderBy("at"))
    spells = changes.withColumn("end", following).filter("stale")
    day = F.expr("INTERVAL 1 DAY")
    after = F.timestamp_micros(F.col("at"))
    first = F.date_trunc("day", after) + day
    until = F.least(F.coalesce(F.timestamp_micros(F.col("end") - 1), last), last)
    ticks = spells.select("board", F.when(first <= until, F.sequence(first, until, day)).alias("ticks"))
    return ticks.select(F.explode("ticks").alias("tick"), "board").select(stamp("tick").alias("tick"), "board")


LIVE_DAYS = 15
AGAIN_DAYS, SOON_DAYS = 40, 5  # every posting comes again: two of three when it has expired, the others while it is live


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    rows = postings(spark, sf).select("id", "num", "posted_at")
    days = F.when(F.col("num") % 3 == 0, SOON_DAYS).otherwise(AGAIN_DAYS)
    again = rows.withColumn("posted_at", F.timestamp_seconds(F.unix_seconds("posted_at") + days * 86_400))
    return rows.unionByName(again).select("id", "posted_at")


@query(f"""WITH {POSTINGS_SQL}, came AS (SELECT id, num, posted_at AS t FROM postings
  UNION ALL SELECT id, num, posted_at + CASE WHEN num % 3 = 0 THEN INTERVAL {SOON_DAYS} DAY ELSE INTERVAL {AGAIN_DAYS} DAY END FROM postings),
adds AS (SELECT id, min(t) AS t FROM came GROUP BY id UNION ALL SELECT id, max(t) FROM came WHERE num % 3 <> 0 GROUP BY id),
changes AS (SELECT id, t, TRUE AS live FROM adds
  UNION ALL SELECT id, t + INTERVAL {LIVE_DAYS} DAY, FALSE FROM adds WHERE t + INTERVAL {LIVE_DAYS} DAY < (SELECT max(t) FROM came) - {LATENESS_SQL})
SELECT id, strftime(t, '%Y-%m-%d %H:%M:%S') AS changed_at, live FROM changes""")
def keyed_live_changes(spark, sf):
    """Additions and removals of all postings, two thirds of which come back after their removal."""
    rows = arrivals(spark, sf)
    changes = in_slices(rows, time_slice(rows, "posted_at"), lambda s: keyed.live_changes(s, LIVE_DAYS, LATENESS))
    return changes.select("id", stamp(F.timestamp_micros("at")).alias("changed_at"), "live")


@query(f"""WITH {POSTINGS_SQL} SELECT id, CAST(CASE WHEN num % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS times FROM postings""")
def stream_live_rows(spark, sf):
    """How often each posting became live: again where it came back after its age."""
    return keyed_live_changes(spark, sf).filter("live").groupBy("id").agg(F.count("*").alias("times"))
