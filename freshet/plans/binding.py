"""The given tables seen as postings, location facets, crawl log, registry and landed payloads.

Every function has its SQL twin, so that each registered query can be checked on the same data.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.session import read_table, spread

DAYS = 90  # freshness window of the registered queries, the longest one that is accepted
BOARDS = 16


_CLOCKS: dict[tuple[str, str, str], datetime] = {}


def _latest(spark: SparkSession, sf_dir: str, table: str, column: str) -> datetime:
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _CLOCKS:
        newest = read_table(spark, sf_dir, table).agg(F.max(F.col(column).cast("timestamp_ntz")))
        _CLOCKS[key] = newest.first()[0]
    return _CLOCKS[key]


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """The newest order date stands in for the clock."""
    return _latest(spark, sf_dir, "orders", "o_orderdate")


def events_as_of(spark: SparkSession, sf_dir: str) -> datetime:
    return _latest(spark, sf_dir, "events", "ts")


def stamp(column: str | Column) -> Column:
    """Timestamps leave a query as text, so both engines print them alike."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def order_id(key: str) -> Column:
    return F.concat_ws("-", F.lit("od"), F.pmod(key, F.lit(BOARDS)).cast("string"), F.col(key).cast("string"))


def _chosen(column: str, values: dict[str, str], otherwise: str) -> Column:
    result = F.lit(otherwise)
    for key, value in reversed(values.items()):
        result = F.when(F.col(column) == key, F.lit(value)).otherwise(result)
    return result


def _case(column: str, values: dict[str, str], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{otherwise}' END"


RANKS = {"1-URGENT": "Principal ", "2-HIGH": "Senior ", "4-NOT SPECIFIED": "Junior ", "5-LOW": "Intern, "}
ROLES = {
    "AUTOMOBILE": "Software Engineer", "BUILDING": "Site Operations Planner", "FURNITURE": "Product Designer",
    "HOUSEHOLD": "Customer Support Agent", "MACHINERY": "Data Analyst",
}
STATUS_LEVELS = {"F": "senior", "O": "mid"}
STATUS_SOURCES = {"F": "greenhouse", "O": "lever"}


def postings(spark: SparkSession, sf_dir: str, busy: bool = False) -> DataFrame:
    """`busy`: the caller does costly work per row."""
    places = read_table(spark, sf_dir, "nation").join(
        read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("c_nationkey"), F.lower("n_name").alias("nation"), F.lower("r_name").alias("region"))
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(places, "c_nationkey")
    orders = read_table(spark, sf_dir, "orders")
    orders = (spread(orders) if busy else orders).withColumnRenamed("o_custkey", "c_custkey")
    key = F.col("o_orderkey")
    remote = F.pmod("c_custkey", F.lit(7)) == 0
    identity = order_id("o_orderkey")
    location = F.concat_ws(", ", F.when(remote, F.lit("remote")).otherwise(F.col("nation")), F.col("region"))
    url = (
        F.when(key % 97 == 0, F.concat(F.lit("javascript:show("), key.cast("string"), F.lit(")")))
        .when(key % 89 == 0, F.concat(F.lit("/jobs/"), key.cast("string")))
        .otherwise(F.concat(F.lit("https://jobs.example.org/"), identity))
    )
    return orders.join(customers, "c_custkey").select(
        identity.alias("id"),
        F.concat_ws("/", F.lit("od"), F.pmod("o_orderkey", F.lit(BOARDS)).cast("string")).alias("board"),
        F.concat(_chosen("o_orderpriority", RANKS, ""), _chosen("c_mktsegment", ROLES, "Coordinator")).alias("title"),
        F.concat_ws(" ", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("company"),
        location.alias("location"),
        F.lower(F.substr("o_orderpriority", F.lit(3))).alias("department"),
        url.alias("url"),
        F.col("o_orderdate").cast("timestamp").alias("posted_at"),
        _chosen("o_orderstatus", STATUS_SOURCES, "ashby").alias("source"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("$100,000 – $120,000")).otherwise(F.lit("")).alias("salary"),
        F.array(location).alias("locations"),
        _chosen("o_orderstatus", STATUS_LEVELS, "entry").alias("level"),
        F.when(~remote, F.col("nation")).alias("city"),
        F.col("region").alias("country"),
        remote.alias("is_remote"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        key.alias("num"),
    )


POSTINGS_SQL = f"""
postings AS (
  SELECT *, [location] AS locations FROM (
  SELECT 'od-' || (o_orderkey % {BOARDS}) || '-' || o_orderkey AS id,
         'od/' || (o_orderkey % {BOARDS}) AS board,
         {_case('o_orderpriority', RANKS, '')} || {_case('c_mktsegment', ROLES, 'Coordinator')} AS title,
         lower(c_mktsegment) || ' ' || c_nationkey AS company,
         CASE WHEN c_custkey % 7 = 0 THEN 'remote' ELSE lower(n_name) END || ', ' || lower(r_name) AS location,
         lower(substr(o_orderpriority, 3)) AS department,
         CASE WHEN o_orderkey % 97 = 0 THEN 'javascript:show(' || o_orderkey || ')'
              WHEN o_orderkey % 89 = 0 THEN '/jobs/' || o_orderkey
              ELSE 'https://jobs.example.org/od-' || (o_orderkey % {BOARDS}) || '-' || o_orderkey END AS url,
         o_orderdate AS posted_at,
         {_case('o_orderstatus', STATUS_SOURCES, 'ashby')} AS source,
         CASE WHEN o_orderpriority = '1-URGENT' THEN '$100,000 – $120,000' ELSE '' END AS salary,
         {_case('o_orderstatus', STATUS_LEVELS, 'entry')} AS level,
         CASE WHEN c_custkey % 7 <> 0 THEN lower(n_name) END AS city,
         lower(r_name) AS country,
         c_custkey % 7 = 0 AS is_remote,
         o_orderdate AS created_at,
         o_orderkey AS num
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)),
clock AS (SELECT max(o_orderdate) AS as_of, date_trunc('hour', max(o_orderdate)) - INTERVAL {DAYS} DAY AS cutoff FROM orders),
fresh AS (SELECT p.* FROM postings p, clock WHERE posted_at >= cutoff),
shown AS (SELECT * FROM fresh WHERE url LIKE 'https://%')
"""


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order with several supplier nations is a posting with several offices."""
    places = read_table(spark, sf_dir, "nation").join(
        read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("s_nationkey"), F.lower("n_name").alias("nation"), F.lower("r_name").alias("country"))
    city = F.when(F.pmod("s_suppkey", F.lit(13)) == 0, F.lit("")).otherwise(F.col("nation"))
    offices = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(places, "s_nationkey").select(
        F.col("s_suppkey").alias("l_suppkey"), city.alias("city"), "country"
    )
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    # The id is built after the distinct, so that the shuffle carries the numeric key.
    distinct = lines.join(offices, "l_suppkey").select("l_orderkey", "city", "country").distinct()
    return distinct.select(order_id("l_orderkey").alias("job_id"), "city", "country")


FACETS_SQL = f"""
facets AS (
  SELECT DISTINCT 'od-' || (l_orderkey % {BOARDS}) || '-' || l_orderkey AS job_id,
         CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE lower(n_name) END AS city, lower(r_name) AS country
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

EMPTY_BELOW = 12.0


def crawl_log(events: DataFrame) -> DataFrame:
    """Events as crawls: the user is the board."""
    failed = F.col("event_type") == "error"
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("board"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(failed, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.when(failed | (F.col("value") < EMPTY_BELOW), F.lit(0)).otherwise(F.floor("value")).cast("long").alias("jobs_found"),
        (F.lit(100) + F.col("event_id") % 900).cast("long").alias("duration_ms"),
        F.when(failed, F.concat(F.lit("http 50"), (F.col("event_id") % 4).cast("string"))).alias("error"),
        F.when(k % 3 == 0, F.concat(F.lit("v"), k.cast("string"))).alias("validator"),
        (F.col("event_type") == "purchase").alias("changed"),
    )


LOG_SQL = f"""
log AS (
  SELECT 'u' || user_id AS board, ts, event_id AS seq,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN event_type = 'error' OR value < {EMPTY_BELOW} THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS jobs_found,
         100 + event_id % 900 AS duration_ms,
         CASE WHEN event_type = 'error' THEN 'http 50' || (event_id % 4) END AS error,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 3 = 0 THEN 'v' || json_extract_string(props, '$.k') END AS validator,
         event_type = 'purchase' AS changed
  FROM events)
"""

STATE_SQL = LOG_SQL.strip() + """,
flagged AS (
  SELECT *, status = 'ok' AND jobs_found = 0 AS is_empty,
         row_number() OVER (PARTITION BY board ORDER BY ts DESC, seq DESC) AS back FROM log),
grouped AS (
  SELECT *, sum(CASE WHEN is_empty THEN 0 ELSE 1 END) OVER (PARTITION BY board ORDER BY ts DESC, seq DESC
         ROWS UNBOUNDED PRECEDING) AS breaks_after FROM flagged),
state AS (
  SELECT board,
         max(CASE WHEN back = 1 THEN status END) AS status,
         max(CASE WHEN back = 1 THEN jobs_found END) AS jobs_found,
         max(CASE WHEN back = 1 THEN duration_ms END) AS duration_ms,
         max(CASE WHEN back = 1 THEN error END) AS error,
         arg_max(validator, (ts, seq)) FILTER (validator IS NOT NULL) AS validator,
         count(*) FILTER (breaks_after = 0) AS consecutive_empty,
         max(ts) FILTER (changed) AS changed_at,
         max(ts) AS crawled_at
  FROM grouped GROUP BY board)
"""


def registry(events: DataFrame) -> DataFrame:
    boards = events.select("user_id").distinct()
    turn = F.pmod("user_id", F.lit(6))
    return boards.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("board"),
        F.when(turn == 0, "dead").when(turn.isin(1, 2), "degraded").otherwise("active").alias("status"),
        F.when(turn == 3, F.concat(F.lit("Label "), F.col("user_id").cast("string"))).alias("label"),
    )


REGISTRY_SQL = """
registry AS (
  SELECT 'u' || user_id AS board,
         CASE WHEN user_id % 6 = 0 THEN 'dead' WHEN user_id % 6 IN (1, 2) THEN 'degraded' ELSE 'active' END AS status,
         CASE WHEN user_id % 6 = 3 THEN 'Label ' || user_id END AS label
  FROM (SELECT DISTINCT user_id FROM events))
"""
