"""Registered queries that run a stream over a given table to its end."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.functions.scalars import freshness_cutoff
from freshet.operators import boards, counting, facets as facet_ops, search
from freshet.plans import binding, changes, feeds as feed_plans, health
from freshet.plans.binding import crawl_log, postings, stamp
from freshet.session import cut, read_table, shared_dir, shuffle_width, unpacked_sizes
from freshet.sources import feeds, telemetry
from freshet.sources.ingest import last_per_id
from freshet.sources.store import PublishedTables
from freshet.streaming import folds
from freshet.streaming.metrics import RANK_ERROR, duration_sketches, live_rows, merged_quantiles, request_metrics_stream

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


def workdir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/freshet-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = read_table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def finish(running) -> None:
    running.awaitTermination()
    if running.exception():
        raise running.exception()


def written(spark: SparkSession, stream: DataFrame, root: str) -> DataFrame:
    """The rows a stream appends, by way of a Parquet folder."""
    finish(
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query(health.SQL["status_fold"])
def stream_status_fold(spark, sf):
    root = workdir(spark)
    tables = PublishedTables(spark, f"{root}/tables", folds.SUMMARY_TABLE)
    finish(folds.fold_boards(crawl_log(stream_of(spark, sf, "events")), tables, f"{root}/checkpoint"))
    return health.printed(boards.board_state(tables.read("board_summary")))


@query(health.SQL["throttle_flags"])
def stream_throttle(spark, sf):
    root = workdir(spark)
    tables = PublishedTables(spark, f"{root}/tables", folds.THROTTLE_TABLES)
    requests = health.requests(stream_of(spark, sf, "events"))
    finish(folds.flag_requests(requests, tables, f"{root}/decisions", f"{root}/checkpoint", health.WINDOW_SECONDS))
    return spark.read.parquet(f"{root}/decisions").select("event_id", "allowed", "retry_micros")


def place_rows(rows: DataFrame) -> DataFrame:
    """Location rows of postings that carry their resolved place."""
    city = F.coalesce("city", F.lit(""))
    return rows.select(F.col("id").alias("job_id"), "board", city.alias("city"), "country")


def title_terms(rows: DataFrame) -> DataFrame:
    terms = search.build_index(rows, "id", ["title"]).terms
    return terms.join(rows.select(F.col("id").alias("doc_id"), "board"), "doc_id")


PAGE_ROWS = 500  # postings of an edited snapshot's page, about
WAVES = 3  # micro-batches in which a snapshot's pages arrive
STATE_SLICES = 4  # at least, of the tables that follow the boards


def paged(rows: DataFrame) -> DataFrame:
    """Rows of boards as landed pages of about PAGE_ROWS items; a board has as many pages as its rows need."""
    sizes = rows.groupBy("board").agg(F.ceil(F.count("*") / PAGE_ROWS).cast("int").alias("pages"))
    sizes = cut(sizes)
    item = F.struct(*[c for c in rows.columns if c != "board"])
    page = F.pmod(F.xxhash64("id"), F.col("pages")).cast("int")
    filled = rows.join(sizes, "board").groupBy("board", page.alias("page")).agg(F.collect_list(item).alias("items"))
    every = sizes.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    return every.join(filled, ["board", "page"], "left").select(
        F.substring_index("board", "/", 1).alias("provider"), F.substring_index("board", "/", -1).alias("board"), F.lit(1).cast("long").alias("snapshot"),
        "page", "pages", F.coalesce("items", F.array().cast(filled.schema["items"].dataType)).alias("items"),
    )


COUNTED = {
    "place_counts": counting.Counted("places", "job_id", ("country", "city"), counting.place_units),
    "company_counts": counting.Counted("postings", "id", ("company",), counting.value_units("company")),
}


def folded_snapshots(spark: SparkSession, sf: str) -> PublishedTables:
    """The edited orders arrive page by page, a board's pages in different micro-batches."""
    with unpacked_sizes(spark):
        return _folded_snapshots(spark, sf)


def _folded_snapshots(spark: SparkSession, sf: str) -> PublishedTables:
    root = workdir(spark)
    stored = cut(changes.stored_rows(spark, sf).drop("num"))
    first = {"postings": stored, "places": place_rows(stored), "terms": title_terms(stored)}
    pages = paged(changes.edited(changes.stored_rows(spark, sf))).repartition(landing_parts(spark), "provider", "board", "page")
    counts = {name: c.of(first[c.source]) for name, c in COUNTED.items()}
    schemas = {**{name: df.schema for name, df in first.items()}, "waiting": pages.schema, **{name: c.schema() for name, c in COUNTED.items()}}
    tables = PublishedTables(spark, f"{root}/tables", schemas, {name: "board" for name in (*first, "waiting")}, STATE_SLICES)
    tables.publish({**first, **counts})

    def parse(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
        board = F.concat_ws("/", "provider", "board")
        crawled = whole.groupBy(board.alias("board")).agg((F.max(F.col("board").cast("int")) % 4 != 2).alias("complete"))
        return whole.select(board.alias("board"), F.explode("items").alias("i")).select("board", "i.*"), crawled

    derived = {"places": folds.Derived("job_id", place_rows, only_location=True), "terms": folds.Derived("doc_id", title_terms)}
    arrive(pages, root, [1], lambda stream: folds.apply_snapshots(stream, tables, f"{root}/checkpoint", changes.BEGINNING, parse, binding.as_of(spark, sf), derived, COUNTED))
    return tables


def arrive(pages: DataFrame, root: str, snapshots: list[int], run) -> None:
    """Land snapshot after snapshot, each in one parallel write of pages in any order, and run the stream over it.

    Its files come in WAVES micro-batches, however many they are, so the pages of a board are parted. Pages of
    a snapshot are computed as they are written, in `landing_parts` parts by provider, board and page.
    """
    spark, path = pages.sparkSession, f"{root}/landed"
    files = landing_parts(spark)
    for snapshot in snapshots:
        pages.filter(F.col("snapshot") == snapshot).write.mode("append").parquet(path)
        finish(run(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", -(-files // WAVES)).parquet(path)))


def landing_parts(spark: SparkSession) -> int:
    return max(WAVES, shuffle_width(spark))


@query(changes.SQL["upsert_result"])
def stream_cdc(spark, sf):
    return folded_snapshots(spark, sf).read("postings").select(
        "id", "title", "company", "city", stamp("posted_at").alias("posted_at"), stamp("created_at").alias("created_at")
    )


RESULT = f"""{changes.CHANGES}, result AS (SELECT c.id, CASE WHEN action IN ('insert', 'update') THEN new_title ELSE old_title END AS title,
CASE WHEN action IN ('insert', 'update') THEN new_city ELSE old_city END AS city FROM changes c WHERE c.id NOT IN (SELECT id FROM deletes))"""


@query(f"{RESULT} SELECT id AS job_id, coalesce(city, '') AS city FROM result")
def stream_cdc_places(spark, sf):
    return folded_snapshots(spark, sf).read("places").select("job_id", "city")


@query(f"{RESULT} SELECT id AS doc_id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS term FROM result) GROUP BY 1, 2")
def stream_cdc_terms(spark, sf):
    return folded_snapshots(spark, sf).read("terms").select("doc_id", "term", F.size("positions").cast("long").alias("tf"))


@query(f"""{RESULT}, located AS (SELECT r.id, coalesce(r.city, '') AS city, coalesce(s.country, f.country) AS country FROM result r LEFT JOIN stored s ON r.id = s.id LEFT JOIN fetched f ON r.id = f.id)
SELECT country, city, count(DISTINCT id) AS count FROM located WHERE city <> '' GROUP BY 1, 2 UNION ALL SELECT country, NULL, count(DISTINCT id) FROM located GROUP BY 1""")
def stream_place_counts(spark, sf):
    """Counts per city and country kept in step with the stream's changes."""
    return folded_snapshots(spark, sf).read("place_counts")


@query(f"""{RESULT} SELECT CASE WHEN c.action IN ('insert', 'update') THEN c.new_company ELSE c.old_company END AS company, count(*) AS count
FROM result r JOIN changes c ON r.id = c.id GROUP BY 1""")
def stream_company_counts(spark, sf):
    return folded_snapshots(spark, sf).read("company_counts")


# Landed feed pages to stored postings, end to end ---------------------------------------------------

EMPTY_BOARD, SMALL_BOARD, LOST_BOARD = "b3", "b9", "b5"


def landed_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots of the ashby boards. In the second one a board has nothing, another little, both have
    lost all they had, one lacks a page, and every board whose number is divisible by four is as before."""
    rows = postings(spark, sf, busy=True)
    number = F.pmod(F.floor(F.col("num") / feed_plans.PER_PAGE), F.lit(feed_plans.FEED_BOARDS))
    small = number == int(SMALL_BOARD[1:])
    first = rows.filter(~small | (F.col("num") % 500 == 0))
    n = F.col("num")
    same = number % 4 == 0
    second = first.filter(same | ((n % 10 != 3) & ~number.isin(int(EMPTY_BOARD[1:]), int(SMALL_BOARD[1:]))))
    second = second.withColumn("title", F.when(~same & (n % 6 == 1), F.concat("title", F.lit(" II"))).otherwise(F.col("title")))
    # Pages are numbered anew, so that a snapshot's pages are 0 to n - 1; a changed page has no validator of the old one.
    # Only the keys pass the window; the numbers join the pages in the parts in which these are put together.
    turns, own, key = {"ashby": F.lit(True)}, ["provider", "board", "snapshot"], ["provider", "board", "page"]
    parts = landing_parts(spark)
    provider = F.lit("ashby").alias("provider")
    kept = [feed_plans.on_pages(part).select(provider, "board", "page", F.lit(i).cast("long").alias("snapshot")).distinct() for i, part in ((1, first), (2, second))]
    lost_all = kept[0].filter(F.col("board").isin(EMPTY_BOARD, SMALL_BOARD)).select("provider", "board").distinct()
    nothing = lost_all.select("provider", "board", F.lit(0).alias("page"), F.lit(2).cast("long").alias("snapshot"))
    keys = kept[0].unionByName(kept[1]).withColumn("void", F.lit(False)).unionByName(nothing.withColumn("void", F.lit(True)))
    place, every = Window.partitionBy(*own).orderBy("page"), Window.partitionBy(*own)
    keys = keys.withColumn("pages", F.count("*").over(every).cast("int")).withColumn("number", (F.row_number().over(place) - 1).cast("int"))
    lost = (F.col("board") == LOST_BOARD) & (F.col("snapshot") == 2) & (F.col("page") == F.col("pages") - 1)
    keys = cut(keys)

    def numbered(pages: DataFrame, numbers: DataFrame, snapshot: int) -> DataFrame:
        met = pages.drop("validator").join(numbers.filter(F.col("snapshot") == snapshot).drop("snapshot").hint("shuffle_hash"), key)
        none = F.lit(None).cast("string").alias("validator")
        return met.select("provider", "board", F.lit(snapshot).cast("long").alias("snapshot"), F.col("number").alias("page"), none, "body", "pages")

    full = keys.filter(~F.col("void")).drop("void")
    one, two = (numbered(feed_plans.landed(part, turns, parts), full, i) for i, part in ((1, first), (2, second)))
    void = keys.filter("void").select("provider", "board", "snapshot", F.col("number").alias("page"), F.lit(None).cast("string").alias("validator"), F.lit('{"jobs":[]}').alias("body"), "pages")
    return one.unionByName(two).unionByName(void).filter(~lost)


def parse_pages(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole landed pages to postings and boards; a board with a broken page is not compared at all."""
    opened = feeds.open_pages(whole.select("provider", "board", "page", "validator", "body"), ["ashby"])
    board = F.concat_ws("/", "provider", "board").alias("board")
    none = F.lit(None).cast("string")
    rows = last_per_id(feeds.read_feeds(opened, ["ashby"])).select(
        "id", board, "posted_at", "title", "company", "location", "department", "url", "source", "salary", "locations",
        none.alias("level"), none.alias("city"), none.alias("country"), "is_remote",
    )
    good = feeds.completeness(opened, "ashby").join(feeds.failed_boards(opened, "ashby"), ["provider", "board"], "left_anti")
    return rows, good.select(board, "complete")


def crawled_boards(spark: SparkSession, sf: str) -> PublishedTables:
    with unpacked_sizes(spark):
        return _crawled_boards(spark, sf)


def _crawled_boards(spark: SparkSession, sf: str) -> PublishedTables:
    root = workdir(spark)
    pages = landed_snapshots(spark, sf)
    none, at = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    shape = changes.edited(changes.stored_rows(spark, sf)).select(
        "id", "board", "posted_at", "title", "company", "location", "department", "url", "source", "salary", "locations",
        none.alias("level"), none.alias("city"), none.alias("country"), "is_remote", at.alias("created_at"),
    ).schema
    schemas = {"postings": shape, "waiting": pages.schema, "seen": "provider string, board string, page int, mark string", **folds.SUMMARY_TABLE}
    tables = PublishedTables(spark, f"{root}/tables", schemas, dict.fromkeys(schemas, "board"), STATE_SLICES)
    arrive(pages, root, [1, 2], lambda stream: folds.apply_snapshots(stream, tables, f"{root}/checkpoint", changes.BEGINNING, parse_pages, binding.as_of(spark, sf)))
    return tables


CRAWL_SQL = f"""WITH {binding.POSTINGS_SQL}, {feed_plans.PAGED_SQL},
rows AS (SELECT num, title, feed_board, CAST(substr(feed_board, 2) AS INT) % 4 = 0 AS same, num % 23 <> 0 AS good FROM paged
  WHERE feed_board NOT IN (FROM broken) AND (feed_board <> '{SMALL_BOARD}' OR num % 500 = 0)),
one AS (SELECT * FROM rows WHERE good),
two AS (SELECT * REPLACE (CASE WHEN NOT same AND num % 6 = 1 THEN title || ' II' ELSE title END AS title) FROM one
  WHERE same OR (num % 10 <> 3 AND feed_board NOT IN ('{EMPTY_BOARD}', '{SMALL_BOARD}'))),
boards AS (SELECT feed_board, count(*) AS n, count(*) FILTER (num NOT IN (SELECT num FROM two)) AS missing FROM one GROUP BY 1),
left_alone AS (SELECT feed_board FROM boards WHERE feed_board = '{LOST_BOARD}'),
guarded AS (SELECT feed_board FROM boards WHERE n >= 10 AND missing > n * 0.5),
final AS (
  SELECT num, title, feed_board FROM one WHERE feed_board IN (FROM left_alone)
  UNION ALL SELECT num, title, feed_board FROM two WHERE feed_board NOT IN (FROM left_alone)
  UNION ALL SELECT num, title, feed_board FROM one WHERE feed_board IN (FROM guarded) AND feed_board NOT IN (FROM left_alone) AND num NOT IN (SELECT num FROM two))"""


@query(f"{CRAWL_SQL} SELECT 'ab-' || feed_board || '-' || num AS id, 'ashby/' || feed_board AS board, title FROM final")
def stream_crawl(spark, sf):
    """Landed pages in many micro-batches: skip-unchanged, parse, compare, guard, write, fold."""
    return crawled_boards(spark, sf).read("postings").select("id", "board", "title")


@query(f"""{CRAWL_SQL}, last AS (SELECT feed_board, count(*) AS jobs FROM one WHERE feed_board IN (FROM left_alone) GROUP BY 1
UNION ALL SELECT b.feed_board, count(t.num) FROM boards b LEFT JOIN two t USING (feed_board) WHERE b.feed_board NOT IN (FROM left_alone) GROUP BY 1)
SELECT 'ashby/' || feed_board AS board, jobs AS jobs_found, CAST(CASE WHEN jobs = 0 THEN 1 ELSE 0 END AS BIGINT) AS consecutive_empty FROM last""")
def stream_crawl_state(spark, sf):
    return boards.board_state(crawled_boards(spark, sf).read("board_summary")).select("board", "jobs_found", "consecutive_empty")


@query(f"""WITH {binding.LOG_SQL}, hours AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, status, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms,
  round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM log GROUP BY 1, 2)
SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, status, n, mean_ms, p95_ms FROM hours
WHERE hour + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM log) - INTERVAL 30 MINUTE""")
def stream_metrics(spark, sf):
    """Windows that the watermark has closed by the end of the table."""
    rows = crawl_log(stream_of(spark, sf, "events"))
    closed = written(spark, request_metrics_stream(rows, ["status"], "1 hour", "30 minutes"), workdir(spark))
    return closed.select(stamp("start").alias("hour"), "status", "n", *[F.round(c, 6).alias(c) for c in ("mean_ms", "p95_ms")])


@query(f"""WITH {binding.LOG_SQL}, hours AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, status, count(*) AS n FROM log GROUP BY 1, 2)
SELECT strftime(date_trunc('day', hour), '%Y-%m-%d') AS day, status, CAST(sum(n) AS BIGINT) AS n, TRUE AS p50_right, TRUE AS p95_right FROM hours
WHERE hour + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM log) - INTERVAL 30 MINUTE GROUP BY 1, 2""")
def stream_quantiles(spark, sf):
    """Hourly sketches of a stream merged into days; each quantile's rank among the day's own rows is near enough."""
    shares = {"p50": 0.5, "p95": 0.95}
    rows = crawl_log(stream_of(spark, sf, "events")).withWatermark("ts", "30 minutes")
    hours = written(spark, duration_sketches(rows, ["status"], "1 hour"), workdir(spark))
    days = merged_quantiles(hours, "day", ["status"], shares)
    log = health.log(spark, sf).withColumn("hour", F.date_trunc("hour", "ts")).join(hours.select(F.col("start").alias("hour"), "status"), ["hour", "status"])
    both = log.withColumn("start", F.date_trunc("day", "ts")).join(days, ["start", "status"])
    under = [F.count_if(F.col("duration_ms") < F.col(p)).alias(f"{p}_under") for p in shares]
    upto = [F.count_if(F.col("duration_ms") <= F.col(p)).alias(f"{p}_upto") for p in shares]
    ranks = both.groupBy("start", "status").agg(F.max("n").alias("n"), F.count("*").alias("rows"), *under, *upto)
    near = [((F.col(f"{p}_under") <= (s + RANK_ERROR) * F.col("rows")) & (F.col(f"{p}_upto") >= (s - RANK_ERROR) * F.col("rows"))).alias(f"{p}_right") for p, s in shares.items()]
    return ranks.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "status", "n", *near)


LIVE_DAYS = 15
SLICE_DAYS = 14  # less than LIVE_DAYS, so no row of a slice is late, however micro-batches part it
LANDED_FILES = 32  # files a micro-batch


def land_in_order(rows: DataFrame, path: str) -> None:
    """Rows with `posted_at` as files that arrive in its order: slice after slice of SLICE_DAYS, each written in parallel.

    The number of slices follows the calendar, not the rows.
    """
    since = F.lit("1970-01-01").cast("date")
    rows = rows.withColumn("slice", F.floor(F.datediff("posted_at", since) / SLICE_DAYS).cast("int"))
    rows = cut(rows.repartitionByRange("posted_at", "id"), "slice")
    for r in rows.select("slice").distinct().orderBy("slice").collect():
        rows.filter(F.col("slice") == r["slice"]).drop("slice").write.mode("append").parquet(path)


def live_of_landed(spark: SparkSession, root: str) -> DataFrame:
    """Live rows of what has landed under `root`, by way of micro-batches."""
    stream = spark.readStream.schema("id string, posted_at timestamp").option("maxFilesPerTrigger", LANDED_FILES).parquet(f"{root}/landed")
    return written(spark, live_rows(stream, LIVE_DAYS), root)


@query(f"""WITH {binding.POSTINGS_SQL} SELECT 'o' || num AS id, strftime(min(posted_at), '%Y-%m-%d %H:%M:%S') AS posted_at, count(*) AS times
FROM postings GROUP BY num""")
def stream_live_postings(spark, sf):
    """Every posting of every month under its whole id; none is late, each is live once."""
    root = workdir(spark)
    land_in_order(postings(spark, sf).select(F.concat(F.lit("o"), F.col("num").cast("string")).alias("id"), "posted_at"), f"{root}/landed")
    return live_of_landed(spark, root).groupBy("id").agg(stamp(F.min("posted_at")).alias("posted_at"), F.count("*").alias("times"))


@query(f"""WITH {binding.LOG_SQL}, runs AS (SELECT CAST(floor(epoch(time_bucket(INTERVAL 30 MINUTE, ts)) / 1800) AS BIGINT) AS tick, {health.RUN_SQL} FROM log GROUP BY 1)
SELECT 'crawl_tick' AS index, 'sweep_' || (tick % 4) || ',' || CASE WHEN failed > 0 THEN 'partial' ELSE 'ok' END AS blobs,
concat_ws(',', duration_ms::DOUBLE, boards::DOUBLE, ok::DOUBLE, failed::DOUBLE, discovered::DOUBLE, '0.0', '0.0', '0.0') AS doubles FROM runs""")
def telemetry_points(spark, sf):
    rows = health.log(spark, sf).withColumn("sweep", boards.tick_ordinal(F.col("ts")))
    rows = rows.withColumn("tick", F.window("ts", "30 minutes")["start"]).withColumnRenamed("changed", "wrote")
    runs = boards.run_rollup(rows, ["tick", "sweep"]).withColumn("skipped", F.lit(0))
    root = workdir(spark)
    telemetry.append(telemetry.crawl_points(runs), f"{root}/points")
    points = spark.read.parquet(f"{root}/points")
    return points.select("index", F.array_join("blobs", ",").alias("blobs"), F.array_join(F.col("doubles").cast("array<string>"), ",").alias("doubles"))


def appended(spark: SparkSession, points: DataFrame) -> DataFrame:
    """Points by way of the store they are appended to, twice."""
    root = workdir(spark)
    telemetry.append(points, f"{root}/points")
    telemetry.append(points, f"{root}/points")
    found = spark.read.parquet(f"{root}/points")
    return found.select("index", F.array_join("blobs", ",").alias("blobs"), F.array_join(F.col("doubles").cast("array<string>"), ",").alias("doubles"))


@query("""WITH e AS (SELECT event_type, event_id, value FROM events UNION ALL SELECT event_type, event_id, value FROM events)
SELECT 'api_request' AS index, '/' || event_type || ',' || CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS blobs,
CAST(CAST(100 + event_id % 900 AS DOUBLE) AS VARCHAR) AS doubles FROM e""")
def telemetry_requests(spark, sf):
    rows = read_table(spark, sf, "events").select(
        F.concat(F.lit("/"), "event_type").alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.lit(100) + F.col("event_id") % 900).alias("duration_ms"),
    )
    return appended(spark, telemetry.request_points(rows))


SWEEP = f"""WITH {binding.POSTINGS_SQL}, {binding.FACETS_SQL}, ranked AS (SELECT id, row_number() OVER g AS rn, min(source) OVER p AS lo, max(source) OVER p AS hi
FROM fresh WHERE city IS NOT NULL AND country IS NOT NULL
WINDOW p AS (PARTITION BY company, lower(title), city), g AS (PARTITION BY company, lower(title), city ORDER BY posted_at, source, id)),
twins AS (SELECT id FROM ranked WHERE rn > 1 AND lo <> hi),
gone AS (SELECT id FROM twins UNION ALL SELECT id FROM postings, clock WHERE posted_at < cutoff)"""


def swept(spark, sf):
    from freshet.plans.reads import cutoff_of

    return folds.sweep(postings(spark, sf), binding.facets(spark, sf), cutoff_of(spark, sf))


@query(f"{SWEEP} SELECT id FROM postings WHERE id NOT IN (FROM gone)")
def sweep_postings(spark, sf):
    return swept(spark, sf)[0].select("id")


@query(f"{SWEEP} SELECT job_id, city, country FROM facets WHERE job_id NOT IN (FROM gone)")
def sweep_facets(spark, sf):
    return swept(spark, sf)[1].select("job_id", "city", "country")


@query(f"""{SWEEP}, n AS (SELECT (SELECT count(*) FROM gone) - (SELECT count(*) FROM twins) AS removed, (SELECT count(*) FROM twins) AS deduped)
SELECT 'crawl_cleanup' AS index, '' AS blobs, removed::DOUBLE || ',' || deduped::DOUBLE AS doubles FROM n, range(2)""")
def telemetry_cleanup(spark, sf):
    return appended(spark, telemetry.cleanup_points(swept(spark, sf)[2]))


@query(f"""WITH {binding.POSTINGS_SQL}, {binding.FACETS_SQL}, located AS (SELECT f.* FROM facets f JOIN fresh ON job_id = id)
SELECT 'recent_links' AS view, least(count(*), 200) AS rows FROM shown
UNION ALL SELECT 'company_index', count(DISTINCT company) FROM fresh WHERE company <> ''
UNION ALL SELECT 'location_counts', count(*) FROM (SELECT DISTINCT country, city FROM located WHERE city <> '')""")
def view_refresh(spark, sf):
    """Nothing without a change, links after one, all views at the start of a sweep."""
    cutoff = freshness_cutoff(binding.as_of(spark, sf), binding.DAYS)
    views = PublishedTables(spark, f"{workdir(spark)}/views", folds.VIEWS)
    rows = cut(postings(spark, sf))
    located = cut(facet_ops.fresh_facets(binding.facets(spark, sf), rows, cutoff))
    for number, (changed, full) in enumerate(((False, True), (True, False), (True, True))):
        folds.refresh_views(rows, located, views, cutoff, changed, full, f"tick-{number}")
    return reduce(DataFrame.unionByName, [views.read(name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("view"), "rows") for name in folds.VIEWS])


@query(f"{SWEEP} SELECT (SELECT count(*) FROM gone) - (SELECT count(*) FROM twins) AS removed, (SELECT count(*) FROM twins) AS deduped")
def sweep_counts(spark, sf):
    return swept(spark, sf)[2]
