"""Registered queries: feed readers over payloads that Spark builds from the orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.classify import department_dictionary
from freshet.plans.binding import DAYS, POSTINGS_SQL, as_of, postings, stamp
from freshet.plans.texts import TITLE_DEPARTMENT
from freshet.session import cut, read_table, spread
from freshet.sources import feeds
from freshet.sources.ingest import Ingested, ingest, last_per_id

QUERIES, SQL = {}, {}
WITH = f"WITH {POSTINGS_SQL}"
FEED_BOARDS, PER_PAGE = 40, 100
BROKEN_BOARD = "b7"
TOTAL_FOUND = 400


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


def _json(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), value, F.lit('"')), F.lit("null"))


def _object(**members: Column) -> Column:
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _posting_json(provider: str) -> Column:
    """One posting as its feed would send it; every 23rd has a number for a title."""
    n, at = F.col("num"), F.col("posted_at")
    title = F.when(n % 23 == 0, F.lit("5")).otherwise(_json(F.col("title")))
    department = F.when(n % 3 != 2, F.col("department"))
    hour_later = F.timestamp_seconds(F.unix_seconds(at) + 3600)
    if provider == "greenhouse":
        pay = _object(
            min=(n + 50000).cast("string"), max=(n + 60000).cast("string"),
            currency=F.when(n % 3 == 0, F.lit('"USD"')).when(n % 6 == 1, F.lit('"CHF"')).otherwise(F.lit("null")),
        )
        fields = F.concat(
            F.lit("["), _object(name=F.lit('"Team"'), value=_json(F.col("department")), value_type=F.lit('"single_select"')),
            F.lit(","), _object(name=F.lit('"Pay band"'), value=pay, value_type=F.lit('"currency_range"')), F.lit("]"),
        )
        place = F.when(n % 5 == 0, F.concat("location", F.lit("; Second"))).otherwise(F.col("location"))
        return _object(
            id=n.cast("string"), title=title, location=_object(name=_json(place)), updated_at=_json(_iso(hour_later)),
            first_published=_json(F.when(n % 2 == 0, _iso(at))), absolute_url=_json(F.col("url")),
            metadata=F.when(n % 3 == 2, F.lit("null")).otherwise(fields),
        )
    if provider == "lever":
        return _object(
            id=_json(n.cast("string")), text=title,
            categories=_object(
                department=_json(department), team=_json(F.col("level")), location=_json(F.when(n % 4 != 0, F.col("location")))
            ),
            createdAt=F.unix_millis(at).cast("string"), hostedUrl=_json(F.col("url")),
        )
    if provider == "ashby":
        return _object(
            id=_json(n.cast("string")), title=title, department=_json(department), team=_json(F.col("level")),
            location=_json(F.col("location")), publishedAt=_json(_iso(at)), jobUrl=_json(F.col("url")),
            isRemote=F.when(n % 4 == 0, "true").when(n % 4 == 1, "false").otherwise("null"),
        )
    if provider == "smartrecruiters":
        label = F.when(n % 3 == 2, F.lit("{}")).otherwise(_object(label=_json(F.col("department"))))
        place = _object(fullLocation=_json(F.when(n % 4 != 1, F.col("location"))), remote=(n % 4 < 2).cast("string"))
        return _object(
            id=_json(n.cast("string")), name=title, uuid=_json(F.concat(F.lit("u"), n.cast("string"))),
            releasedDate=_json(_iso(at)), company=_object(identifier=_json(F.col("company"))),
            location=F.when(n % 9 == 0, F.lit("null")).otherwise(place), department=label, function=_object(label=_json(F.col("level"))),
        )
    listed = F.concat(F.lit("["), _object(city=_json(F.col("city")), country=_json(F.col("country"))), F.lit("]"))
    return _object(
        title=title, shortcode=_json(n.cast("string")), telecommuting=(n % 4 == 0).cast("string"), department=_json(department),
        url=_json(F.when(n % 2 == 0, F.col("url"))), shortlink=_json(F.col("url")),
        published_on=_json(F.when(n % 5 != 0, F.date_format(at, "yyyy-MM-dd"))), created_at=_json(F.when(n % 10 != 0, _iso(hour_later))),
        country=_json(F.col("country")), city=_json(F.col("city")), locations=F.when(n % 3 == 0, F.lit("null")).otherwise(listed),
    )


def on_pages(rows: DataFrame) -> DataFrame:
    """Rows with the board and page of a feed that has them."""
    hundred = F.floor(F.col("num") / PER_PAGE)
    board = F.concat(F.lit("b"), F.pmod(hundred, F.lit(FEED_BOARDS)).cast("string"))
    return rows.withColumns({"board": board, "page": F.floor(hundred / FEED_BOARDS).cast("int")})


def landed(rows: DataFrame, turns: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Pages of at most 100 postings; one board's first page is cut off in the middle.

    `turns` says which rows each provider sends; a row may go to several. `parts`: the pages come in so
    many parts by provider, board and page, so that a write in that order moves them no more.
    """
    # Only names pass the higher-order function, which Spark interprets; the payload is compiled code, one branch a row.
    to = F.array_compact(F.array(*[F.when(turn, F.lit(name)) for name, turn in turns.items()]))
    json = F.lit(None).cast("string")
    for name in turns:
        json = F.when(F.col("provider") == name, _posting_json(name)).otherwise(json)
    rows = rows.withColumn("provider", F.explode(to)).withColumn("json", json)
    listed = F.sort_array(F.collect_list(F.struct("num", "json")))
    own = ["provider", "board", "page"]
    sent = on_pages(rows).select(*own, "num", "json")
    sent = sent.repartition(parts, *own) if parts else sent
    pages = sent.groupBy(*own).agg(
        F.concat(F.lit("["), F.array_join(listed["json"], ","), F.lit("]")).alias("items")
    )
    items = F.col("items")
    body = (
        F.when(F.col("provider") == "lever", items)
        .when(F.col("provider") == "smartrecruiters", F.concat(F.lit(f'{{"totalFound":{TOTAL_FOUND},"content":'), items, F.lit("}")))
        .otherwise(F.concat(F.lit('{"jobs":'), items, F.lit("}")))
    )
    broken = (F.col("board") == BROKEN_BOARD) & (F.col("page") == 0)
    body = F.when(broken, F.left(body, F.lit(50))).otherwise(body)
    etag = F.when(F.crc32("board") % 4 == 0, F.concat(F.lit("etag-"), "board"))
    return pages.select("provider", "board", "page", etag.alias("validator"), body.alias("body"))


def arrived(pages: DataFrame) -> DataFrame:
    """The payloads as a landed table, which readers scan more than once."""
    return spread(cut(pages))


def read(spark: SparkSession, sf: str, provider: str) -> DataFrame:
    opened = feeds.open_pages(arrived(landed(postings(spark, sf, busy=True), {provider: F.lit(True)})), [provider])
    rows = feeds.read_feeds(opened, [provider])
    return rows.select(
        "id", "title", "company", "location", F.array_join("locations", "|").alias("locations"), "department",
        F.array_join("hints", "|").alias("hints"), "url", stamp("posted_at").alias("posted_at"), "source", "salary", "is_remote",
    )


PAGED_SQL = f"""paged AS (SELECT *, 'b' || ((num // {PER_PAGE}) % {FEED_BOARDS}) AS feed_board, CAST((num // {PER_PAGE}) // {FEED_BOARDS} AS INT) AS page FROM postings),
broken AS (SELECT DISTINCT feed_board FROM paged WHERE feed_board = '{BROKEN_BOARD}' AND page = 0),
valid AS (SELECT * FROM paged WHERE feed_board NOT IN (FROM broken) AND num % 23 <> 0)"""
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def feed_sql(prefix: str, source: str, **columns: str) -> str:
    given = {"locations": "location", "department": "CASE WHEN num % 3 <> 2 THEN department ELSE '' END", "hints": "level", "url": "url",
             "location": "location", "posted_at": STAMP.format("valid.posted_at"), "salary": "''", "is_remote": "FALSE", **columns}
    listed = ", ".join(f"{text} AS {name}" for name, text in given.items())
    return f"""{WITH}, {PAGED_SQL} SELECT '{prefix}-' || feed_board || '-' || num AS id, title, feed_board AS company, '{source}' AS source, {listed} FROM valid"""


HOUR_LATER = "(valid.posted_at + INTERVAL 1 HOUR)"
_SIGN = "CASE WHEN num % 3 = 0 THEN '$' WHEN num % 6 = 1 THEN 'CHF' || chr(160) ELSE '' END"


@query(feed_sql(
    "gh", "greenhouse", hints="''", locations="location || CASE WHEN num % 5 = 0 THEN '|Second' ELSE '' END",
    posted_at=STAMP.format(f"CASE WHEN num % 2 = 0 THEN valid.posted_at ELSE {HOUR_LATER} END"),
    salary=f"CASE WHEN num % 3 = 2 THEN '' ELSE {_SIGN} || format('{{:,}}', num + 50000) || ' – ' || {_SIGN} || format('{{:,}}', num + 60000) END",
))
def parse_greenhouse(spark, sf):
    return read(spark, sf, "greenhouse")


_LEVER_PLACE = "CASE WHEN num % 4 <> 0 THEN location ELSE '' END"


@query(feed_sql("lv", "lever", location=_LEVER_PLACE, locations=_LEVER_PLACE))
def parse_lever(spark, sf):
    return read(spark, sf, "lever")


_ASHBY_PLACE = "CASE WHEN num % 4 = 0 AND location NOT LIKE 'remote%' THEN 'Remote — ' || location ELSE location END"


@query(feed_sql("ab", "ashby", location=_ASHBY_PLACE, locations=_ASHBY_PLACE, is_remote="num % 4 = 0"))
def parse_ashby(spark, sf):
    return read(spark, sf, "ashby")


_SR_PLACE = """CASE WHEN num % 9 = 0 THEN 'Unknown' WHEN num % 4 = 1 THEN 'Remote' WHEN num % 4 = 0 THEN 'Remote — ' || location ELSE location END"""


@query(feed_sql(
    "sr", "smartrecruiters", location=_SR_PLACE, locations=_SR_PLACE, is_remote="num % 9 <> 0 AND num % 4 < 2",
    url="'https://careers.smartrecruiters.com/' || feed_board || '/u' || num",
))
def parse_smartrecruiters(spark, sf):
    return read(spark, sf, "smartrecruiters")


_WB_PLACE = "concat_ws(', ', city, country)"
_WB_PRIMARY = f"CASE WHEN num % 4 = 0 THEN 'Remote — ' || {_WB_PLACE} ELSE {_WB_PLACE} END"


@query(feed_sql(
    "wb", "workable", hints="''", location=_WB_PRIMARY, is_remote="num % 4 = 0",
    locations=f"CASE WHEN num % 3 = 0 THEN '' ELSE {_WB_PLACE} || '|' END || {_WB_PRIMARY}",
    posted_at=STAMP.format(f"CASE WHEN num % 5 <> 0 THEN date_trunc('day', valid.posted_at) ELSE {HOUR_LATER} END"),
) + " WHERE num % 10 <> 0")
def parse_workable(spark, sf):
    return read(spark, sf, "workable")


def each(spark: SparkSession, sf: str, run) -> DataFrame:
    pages = arrived(landed(postings(spark, sf, busy=True), {name: F.lit(True) for name in feeds.PROVIDERS}))
    opened = feeds.open_pages(pages)
    return reduce(DataFrame.unionByName, [run(opened, name) for name in feeds.PROVIDERS])


NAMES = "providers(provider, field) AS (VALUES ('greenhouse', 'title'), ('lever', 'text'), ('ashby', 'title'), ('smartrecruiters', 'name'), ('workable', 'title'))"


@query(f"""{WITH}, {PAGED_SQL}, {NAMES}, bad AS (
SELECT provider, field, feed_board AS board, num, page, num % 23 = 0 AS untitled, provider = 'workable' AND num % 10 = 0 AS undated FROM paged, providers
WHERE NOT (feed_board = '{BROKEN_BOARD}' AND page = 0))
SELECT provider, board, count(*) AS skipped,
arg_min(CASE WHEN untitled THEN field || ': expected string' ELSE 'missing posting date' END, num) AS reason
FROM bad WHERE untitled OR undated GROUP BY 1, 2""")
def skip_summary(spark, sf):
    return each(spark, sf, feeds.skip_summary)


@query(f"""{WITH}, {PAGED_SQL}, {NAMES} SELECT provider, feed_board AS board,
provider <> 'smartrecruiters' OR (max((page + 1) * {PER_PAGE}) >= {TOTAL_FOUND}
  AND count(DISTINCT page) FILTER ((page + 1) * {PER_PAGE} <= {TOTAL_FOUND}) = {TOTAL_FOUND // PER_PAGE}) AS complete
FROM paged, providers WHERE NOT (feed_board = '{BROKEN_BOARD}' AND page = 0) GROUP BY 1, 2""")
def completeness(spark, sf):
    return each(spark, sf, feeds.completeness)


@query(f"{WITH}, {PAGED_SQL}, {NAMES} SELECT provider, feed_board AS board FROM broken, providers")
def failed_boards(spark, sf):
    return each(spark, sf, feeds.failed_boards)


@query(f"""{WITH}, {PAGED_SQL}, p AS (SELECT DISTINCT provider, feed_board AS board, page, CAST(substr(feed_board, 2) AS INT) AS n
  FROM paged, (VALUES ('ashby'), ('lever')) f(provider)),
changed AS (SELECT DISTINCT provider, board FROM p WHERE provider = 'lever' OR (n % 3 = 0 AND page % 2 = 1) OR n % 5 = 0 OR n % 7 = 0)
SELECT provider, board, page FROM p JOIN changed USING (provider, board)""")
def unchanged_snapshot(spark, sf):
    """One feed was seen before and the other, of the same board names, was not. Of the seen boards some
    have changed on odd pages only, some have lost a page since, and of some one page had not been seen."""
    pages = arrived(landed(postings(spark, sf, busy=True), {"ashby": F.lit(True), "lever": F.lit(True)}))
    number = F.substr("board", F.lit(2)).cast("int")
    last = pages.filter(F.col("provider") == "ashby").select("provider", "board", "page", feeds.page_mark().alias("mark"))
    old = F.when((number % 3 == 0) & (F.col("page") % 2 == 1), F.lit("old")).otherwise(F.col("mark"))
    extra = last.filter((number % 5 == 0) & (F.col("page") == 0)).select("provider", "board", F.lit(9999).alias("page"), F.lit("gone").alias("mark"))
    seen = last.withColumn("mark", old).filter(~((number % 7 == 0) & (F.col("page") == 0))).unionByName(extra)
    return feeds.changed_boards(pages, seen).select("provider", "board", "page")


def place_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """The regions as countries and the nations as their cities."""
    nation, region = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    none = F.lit(None).cast("string")
    overrides = F.lit(None).cast("map<string,string>")
    country = F.lower("r_name")
    countries = region.select(
        country.alias("token"), country.alias("country"), none.alias("region_country"), none.alias("city"),
        none.alias("city_country"), overrides.alias("overrides"), F.col("r_regionkey").cast("int").alias("ord"),
    )
    city = F.lower("n_name")
    cities = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        city.alias("token"), none.alias("country"), none.alias("region_country"), city.alias("city"), country.alias("city_country"),
        overrides.alias("overrides"), (F.col("n_nationkey") + 1000).cast("int").alias("ord"),
    )
    return countries.unionByName(cities)


def feed_registry(pages: DataFrame) -> DataFrame:
    label = F.when(F.col("provider") == "lever", F.concat(F.lit("Label-"), F.upper("board"), F.lit(" (Group)")))
    return pages.select("provider", F.col("board").alias("name"), label.alias("label")).distinct()


def ingested(spark: SparkSession, sf: str) -> Ingested:
    """Every order goes through one of the five feeds."""
    pages = arrived(landed(postings(spark, sf, busy=True), {name: F.col("num") % 5 == i for i, name in enumerate(feeds.PROVIDERS)}))
    return ingest(feeds.read_feeds(feeds.open_pages(pages)), feed_registry(pages), place_dictionary(spark, sf), department_dictionary(spark), as_of(spark, sf), DAYS)


_ORDER = ", ".join(f"('{name}', '{prefix}', {i})" for i, (name, prefix) in enumerate(
    {"greenhouse": "gh", "lever": "lv", "ashby": "ab", "smartrecruiters": "sr", "workable": "wb"}.items()))
INGEST_SQL = f"""{WITH}, {PAGED_SQL}, feeds(provider, prefix, turn) AS (VALUES {_ORDER}),
sent AS (SELECT *, CASE provider
    WHEN 'greenhouse' THEN CASE WHEN num % 2 = 0 THEN v.posted_at ELSE v.posted_at + INTERVAL 1 HOUR END
    WHEN 'workable' THEN CASE WHEN num % 5 <> 0 THEN date_trunc('day', v.posted_at) ELSE v.posted_at + INTERVAL 1 HOUR END
    ELSE v.posted_at END AS sent_at
  FROM valid v JOIN feeds ON num % 5 = turn WHERE NOT (provider = 'workable' AND num % 10 = 0)),
offered AS (SELECT * FROM sent, clock WHERE sent_at >= cutoff AND (provider = 'smartrecruiters' OR url LIKE 'https://%')),
flags AS (SELECT *,
    CASE provider WHEN 'lever' THEN num % 4 = 0 WHEN 'smartrecruiters' THEN num % 9 = 0 OR num % 4 = 1 ELSE FALSE END AS placeless,
    CASE provider WHEN 'ashby' THEN num % 4 = 0 WHEN 'workable' THEN num % 4 = 0 WHEN 'smartrecruiters' THEN num % 9 <> 0 AND num % 4 < 2 ELSE FALSE END AS flagged,
    provider = 'workable' AND is_remote AS hidden
  FROM offered),
placed AS (SELECT *, (is_remote AND NOT placeless AND NOT hidden) OR flagged AS away FROM flags)"""


@query(f"""{INGEST_SQL} SELECT prefix || '-' || feed_board || '-' || num AS id, title,
CASE WHEN provider = 'lever' THEN 'label ' || feed_board ELSE feed_board END AS company,
CASE WHEN title LIKE 'Principal%' THEN 'lead' WHEN title LIKE 'Senior%' THEN 'senior' WHEN title LIKE 'Intern%' THEN 'intern'
WHEN title LIKE 'Junior%' THEN 'entry' ELSE 'mid' END AS level,
{TITLE_DEPARTMENT} AS department,
CASE WHEN away THEN CASE WHEN placeless THEN 'remote' ELSE 'remote, ' || country END
WHEN placeless THEN 'unknown' WHEN hidden THEN country ELSE city || ', ' || country END AS location,
CASE WHEN NOT away AND NOT placeless AND NOT hidden THEN city END AS city, CASE WHEN NOT placeless THEN country END AS country, away AS is_remote,
{STAMP.format('sent_at')} AS posted_at FROM placed""")
def ingest_postings(spark, sf):
    rows = ingested(spark, sf).postings
    return rows.select("id", "title", "company", "level", "department", "location", "city", "country", "is_remote", stamp("posted_at").alias("posted_at"))


@query(f"""{INGEST_SQL}, offices AS (
SELECT prefix || '-' || feed_board || '-' || num AS job_id, CASE WHEN away OR hidden THEN '' ELSE city END AS city, country FROM placed WHERE NOT placeless
UNION SELECT prefix || '-' || feed_board || '-' || num, coalesce(city, ''), country FROM placed WHERE provider = 'workable' AND num % 3 <> 0)
SELECT * FROM offices""")
def ingest_facets(spark, sf):
    return ingested(spark, sf).facets


@query(f"""{INGEST_SQL} SELECT CASE WHEN provider = 'lever' THEN 'Label-' || upper(feed_board) || ' (Group)' ELSE feed_board END AS company, count(*) AS rejected
FROM sent WHERE provider <> 'smartrecruiters' AND url NOT LIKE 'https://%' GROUP BY 1""")
def rejected_urls(spark, sf):
    return ingested(spark, sf).rejected_urls


@query(f"""{INGEST_SQL}, names AS (SELECT CASE WHEN provider = 'lever' THEN 'label ' || feed_board ELSE feed_board END AS company,
CASE WHEN num % 3 <> 2 THEN department END AS first, CASE WHEN provider IN ('lever', 'ashby', 'smartrecruiters') THEN level END AS second FROM placed),
listed AS (SELECT DISTINCT company, name FROM (SELECT company, first AS name FROM names UNION ALL SELECT company, second FROM names) WHERE name IS NOT NULL)
SELECT company, count(*) AS distinct_names, string_agg(name, ';' ORDER BY name) AS sample FROM listed GROUP BY 1""")
def ingest_unmapped(spark, sf):
    return ingested(spark, sf).unmapped.withColumn("sample", F.array_join("sample", ";"))


@query("""SELECT 'x-' || l_orderkey AS id, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS part FROM lineitem GROUP BY l_orderkey""")
def last_posting_per_id(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    pos = F.struct("l_partkey", "l_suppkey", "l_extendedprice")
    rows = lines.select(
        F.concat(F.lit("x-"), F.col("l_orderkey").cast("string")).alias("id"), F.col("l_linenumber").alias("page"), pos.alias("pos"),
        F.col("l_partkey").alias("part"),
    )
    return last_per_id(rows).select("id", "part")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a;b' WHEN event_id % 3 = 1 THEN 'fallback' ELSE '' END AS locations FROM events""")
def stored_locations(spark, sf):
    from freshet.operators.listing import stored_locations as read_locations

    n = F.col("event_id") % 3
    raw = F.when(n == 0, '["a", 5, "b", null]').when(n == 1, F.concat(F.lit('{"broken'), "event_type")).otherwise("[]")
    found = read_locations(raw, F.lit("fallback"))
    return read_table(spark, sf, "events").select("event_id", F.array_join(found, ";").alias("locations"))
