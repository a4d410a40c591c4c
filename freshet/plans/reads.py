"""Registered queries: pages, filters, facets and exports."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.scalars import age_bucket, freshness_cutoff, is_http_url, posted_today
from freshet.functions.text import company_from_slug, fold, from_slug, role_key, sanitize, to_slug
from freshet.operators import exports, facets as facet_ops, listing
from freshet.plans.binding import (
    DAYS, FACETS_SQL, POSTINGS_SQL, as_of, facets, postings, stamp,
)
from freshet.session import cut, read_table, spread

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


def cutoff_of(spark: SparkSession, sf: str):
    return freshness_cutoff(as_of(spark, sf), DAYS)


def shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[stamp(c).alias(c) if c in ("posted_at", "last_posted_at") else F.col(c) for c in columns])


PAGE = ("id", "title", "company", "department", "level", "posted_at")
PAGE_SQL = "id, title, company, department, level, strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at"
WITH = f"WITH {POSTINGS_SQL}"
WITH_FACETS = f"WITH {POSTINGS_SQL}, {FACETS_SQL}"

URGENT = listing.SearchRequest(department="Urgent", limit=50)


def filtered(spark, sf, request: listing.SearchRequest, place=None) -> DataFrame:
    return listing.filter_postings(postings(spark, sf), facets(spark, sf), request, as_of(spark, sf), DAYS, place)


@query(f"{WITH} SELECT {PAGE_SQL} FROM shown WHERE department = 'urgent' ORDER BY shown.posted_at DESC, id DESC LIMIT 50")
def fresh_page(spark, sf):
    return shown(listing.page(filtered(spark, sf, URGENT), listing.newest_order(), URGENT), *PAGE)


@query(f"{WITH} SELECT count(*) AS total FROM shown WHERE department = 'urgent'")
def fresh_total(spark, sf):
    return listing.total(filtered(spark, sf, URGENT))


@query(f"{WITH} SELECT {PAGE_SQL} FROM shown ORDER BY company, shown.posted_at DESC, id DESC LIMIT 40 OFFSET 20")
def company_sort_page(spark, sf):
    request = listing.SearchRequest(sort="company", limit=40, offset=20)
    return shown(listing.page(filtered(spark, sf, request), listing.list_order("company"), request), *PAGE)


@query(f"""{WITH}, first AS (SELECT * FROM shown ORDER BY posted_at DESC, id DESC LIMIT 30),
last AS (SELECT posted_at, id FROM first ORDER BY posted_at, id LIMIT 1)
SELECT {PAGE_SQL.replace('(posted_at', '(s.posted_at').replace('id, title', 's.id AS id, title')} FROM shown s, last
WHERE s.posted_at < last.posted_at OR (s.posted_at = last.posted_at AND s.id < last.id)
ORDER BY s.posted_at DESC, s.id DESC LIMIT 30""")
def keyset_page(spark, sf):
    request = listing.SearchRequest(limit=1, offset=29)
    rows = filtered(spark, sf, request)
    last = listing.page(rows, listing.newest_order(), request).select("posted_at", "id").first()
    if last is None:
        return shown(rows.limit(0), *PAGE)
    return shown(listing.page_after(rows, last["posted_at"], last["id"], 30), *PAGE)


@query(f"""{WITH} SELECT {PAGE_SQL} FROM shown, clock WHERE shown.posted_at >= as_of - INTERVAL 7 DAY
ORDER BY shown.posted_at DESC, id DESC LIMIT 500""")
def posted_window(spark, sf):
    request = listing.SearchRequest(posted="week", limit=500)
    return shown(listing.page(filtered(spark, sf, request), listing.newest_order(), request), *PAGE)


@query(f"{WITH} SELECT {PAGE_SQL} FROM fresh WHERE id >= 'od-1-' AND id < 'od-1.'")
def prefix_range(spark, sf):
    return shown(listing.board_postings(postings(spark, sf), "od-1-", cutoff_of(spark, sf)), *PAGE)


@query(f"{WITH} SELECT id, location FROM shown WHERE location ILIKE '%ion\\_1, a%' ESCAPE '\\'")
def like_escape(spark, sf):
    return filtered(spark, sf, listing.SearchRequest(location="ion_1, A")).select("id", "location")


@query(f"{WITH} SELECT id, location FROM shown WHERE is_remote")
def remote_filter(spark, sf):
    request = listing.SearchRequest(location="remote, asia")
    return filtered(spark, sf, request, listing.Place(country="asia", remote=True)).select("id", "location")


@query(f"""{WITH_FACETS} SELECT id, location FROM shown
WHERE EXISTS (SELECT 1 FROM facets WHERE job_id = id AND city = 'nation_7' AND country = 'asia')""")
def facet_match_semi(spark, sf):
    request = listing.SearchRequest(city="NATION_7", country="Asia")
    return filtered(spark, sf, request).select("id", "location")


@query(f"""{WITH_FACETS} SELECT id, location FROM shown WHERE level = 'senior'
AND EXISTS (SELECT 1 FROM facets WHERE job_id = id AND country = 'europe')""")
def country_and_level(spark, sf):
    request = listing.SearchRequest(location="europe", level="Senior")
    return filtered(spark, sf, request, listing.Place(country="europe")).select("id", "location")


@query(f"{WITH} SELECT company AS value, count(DISTINCT id) AS count FROM fresh WHERE company <> '' GROUP BY 1")
def facet_companies(spark, sf):
    return facet_ops.value_counts(postings(spark, sf), "company", cutoff_of(spark, sf))


@query(f"{WITH} SELECT department AS value, count(DISTINCT id) AS count FROM fresh WHERE department <> '' GROUP BY 1")
def facet_departments(spark, sf):
    return facet_ops.value_counts(postings(spark, sf), "department", cutoff_of(spark, sf))


def located(spark, sf) -> DataFrame:
    return facet_ops.fresh_facets(facets(spark, sf), postings(spark, sf), cutoff_of(spark, sf))


LOCATED = f"{WITH_FACETS}, located AS (SELECT f.* FROM facets f JOIN fresh ON job_id = id)"
COUNTRIES = "countries AS (SELECT country, count(DISTINCT job_id) AS n FROM located GROUP BY 1)"
CITIES = "cities AS (SELECT country, city, count(DISTINCT job_id) AS n FROM located WHERE city <> '' GROUP BY 1, 2)"


@query(f"{LOCATED}, {COUNTRIES} SELECT country, n AS count FROM countries")
def facet_countries(spark, sf):
    return facet_ops.country_counts(located(spark, sf))


@query(f"{LOCATED}, {CITIES} SELECT country, city, n AS count FROM cities")
def facet_cities(spark, sf):
    return facet_ops.city_counts(located(spark, sf))


@query(f"""{LOCATED}, {COUNTRIES}, {CITIES},
lists AS (SELECT country, string_agg(city || '=' || n, ';' ORDER BY n DESC, city) AS cities FROM cities GROUP BY 1)
SELECT c.country AS value, n AS count, coalesce(cities, '') AS cities FROM countries c LEFT JOIN lists l ON c.country = l.country""")
def facet_tree(spark, sf):
    tree = facet_ops.facet_tree(located(spark, sf))
    flat = F.array_join(F.transform("cities", lambda c: F.concat_ws("=", c["value"], c["count"].cast("string"))), ";")
    return tree.select("value", "count", flat.alias("cities"))


@query(f"""{LOCATED}, {COUNTRIES}, {CITIES}
SELECT 0 AS section, 'remote' AS value, CAST(0 AS BIGINT) AS count UNION ALL SELECT 1, country, n FROM countries
UNION ALL SELECT 2, city || ', ' || country, n FROM cities""")
def location_options(spark, sf):
    return facet_ops.location_options(located(spark, sf))


def index_of(spark, sf) -> DataFrame:
    return facet_ops.company_index(postings(spark, sf), cutoff_of(spark, sf))


INDEX = f"{WITH}, companies AS (SELECT company AS name, max(posted_at) AS last_at FROM fresh WHERE company <> '' GROUP BY 1)"
AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(f"{INDEX} SELECT name, {AT.format('last_at')} AS last_posted_at FROM companies")
def company_index(spark, sf):
    return shown(index_of(spark, sf), "name", "last_posted_at")


@query(f"{INDEX} SELECT {AT.format('max(last_at)')} AS last_posted_at FROM companies")
def newest_date(spark, sf):
    return shown(facet_ops.newest_date(index_of(spark, sf)), "last_posted_at")


@query(f"""{INDEX} SELECT 'https://listings.example.org' AS url, {AT.format('max(last_at)')} AS last_modified,
'hourly' AS frequency, 1.0::DOUBLE AS priority FROM companies
UNION ALL SELECT 'https://listings.example.org/company/' || replace(name, ' ', '%20'), {AT.format('last_at')}, 'daily', 0.7::DOUBLE
FROM companies""")
def sitemap_rows(spark, sf):
    rows = exports.sitemap(index_of(spark, sf), "https://listings.example.org")
    return rows.withColumn("last_modified", stamp("last_modified"))


def recent(spark, sf, limit: int) -> DataFrame:
    return listing.newest(postings(spark, sf), cutoff_of(spark, sf), limit)


RECENT = f"{WITH}, recent AS (SELECT * FROM shown ORDER BY posted_at DESC, id DESC LIMIT {{}})"


@query(f"{RECENT.format(200)} SELECT id, title, company, url, location, {AT.format('recent.posted_at')} AS posted_at FROM recent")
def recent_links(spark, sf):
    return shown(recent(spark, sf, 200), "id", "title", "company", "url", "location", "posted_at")


@query(f"""{RECENT.format(100)} SELECT id, '<item>' || chr(10) || '<title>' || title || ' at ' || company || '</title>' || chr(10)
|| '<link>' || url || '</link>' || chr(10) || '<guid isPermaLink="true">' || url || '</guid>' || chr(10)
|| '<pubDate>' || strftime(recent.posted_at, '%a, %d %b %Y %H:%M:%S') || ' GMT</pubDate>' || chr(10)
|| '<description>' || company || ' · ' || location || '</description>' || chr(10) || '</item>' AS item FROM recent""")
def rss_items(spark, sf):
    return exports.feed_items(recent(spark, sf, 100))


@query(f"""{RECENT.format(200)} SELECT id, '- [' || title || ' at ' || company || '](' || url || ')'
|| CASE WHEN location <> '' THEN ' - ' || location ELSE '' END AS line FROM recent""")
def link_lines(spark, sf):
    return exports.link_lines(recent(spark, sf, 200))


@query(f"""{RECENT.format(50)} SELECT id, '{{{{"id":"' || id || '","title":"' || title || '","company":"' || company
|| '","location":"' || location || '","url":"' || url || '","source":"' || source || '","postedAt":"'
|| strftime(recent.posted_at, '%Y-%m-%dT%H:%M:%S.000Z') || '"' || CASE WHEN salary <> '' THEN ',"salary":"' || salary || '"' ELSE '' END
|| '}}}}' AS json FROM recent""".replace("{{", "{").replace("}}", "}"))
def public_json(spark, sf):
    return exports.public_json(recent(spark, sf, 50))


@query(f"""{WITH} SELECT id, {AT.format('fresh.posted_at')} AS posted_at FROM fresh WHERE company = 'machinery 3'
AND url LIKE 'https://%'""")
def company_page(spark, sf):
    return shown(listing.company_postings(postings(spark, sf), "machinery 3", cutoff_of(spark, sf)), "id", "posted_at")


@query(f"""{WITH}, roles AS (SELECT company || '|' || lower(title) AS key, count(*) AS openings, arg_max(id, (posted_at, id)) AS id, max(posted_at) AS posted_at
  FROM shown WHERE company = 'machinery 3' GROUP BY 1)
SELECT id, openings, row_number() OVER (ORDER BY posted_at DESC, id DESC) AS position FROM roles""")
def company_roles(spark, sf):
    """A company's page: its postings, one row per role, in their places."""
    from freshet.operators.upkeep import collapse_roles, list_positions

    own = listing.company_postings(postings(spark, sf), "machinery 3", cutoff_of(spark, sf))
    roles = collapse_roles(own, role_key(F.col("company"), F.col("title")), ["id", "company", "posted_at"], ["posted_at", "id"])
    return list_positions(roles).select("id", "openings", "position")


@query(f"""{WITH_FACETS} SELECT {PAGE_SQL} FROM shown WHERE level = 'senior'
AND EXISTS (SELECT 1 FROM facets WHERE job_id = id AND country = 'europe') ORDER BY shown.posted_at DESC, id DESC LIMIT 500 OFFSET 5""")
def typed_location_page(spark, sf):
    """A strict request whose location text is resolved first."""
    from freshet.operators.places import resolve_literal
    from freshet.plans.feeds import place_dictionary

    request = listing.read_request({"location": " Europe ", "level": "Senior", "limit": "900", "offset": " 5 rows"})
    place = resolve_literal(spark, request.location, place_dictionary(spark, sf))
    return shown(listing.page(filtered(spark, sf, request, place), listing.list_order(request.sort), request), *PAGE)


@query(f"{WITH} SELECT {PAGE_SQL} FROM shown WHERE department = 'urgent' ORDER BY company, shown.posted_at DESC, id DESC LIMIT 50")
def lenient_page(spark, sf):
    """Bad values of a request are dropped one by one."""
    request = listing.read_lenient({"q": "x" * 201, "level": "boss", "sort": "company", "department": " Urgent ", "location": " "})
    return shown(listing.page(filtered(spark, sf, request), listing.list_order(request.sort), request), *PAGE)


@query(f"""{WITH}, placed AS (SELECT *, row_number() OVER (ORDER BY posted_at DESC, id DESC) - 1 AS place FROM shown)
SELECT id, CAST(place // 400 AS BIGINT) AS page FROM placed WHERE place < 10400""")
def every_page(spark, sf):
    """Page after page of 400 for as long as another one is worth asking for."""
    request = listing.SearchRequest(limit=400)
    rows = cut(filtered(spark, sf, request).select("id", "posted_at"))
    total, pages = listing.total(rows).first()["total"], []
    while True:
        page = cut(listing.page(rows, listing.newest_order(), request).select("id", F.lit(len(pages)).cast("long").alias("page")))
        pages.append(page)
        if not listing.more_pages(page.count(), request.limit, request.offset, total):
            return reduce(DataFrame.unionByName, pages)
        request = replace(request, offset=request.offset + request.limit)


@query(f"""{RECENT.format(100)}, marked AS (SELECT * REPLACE (title || ' <R&D> "' || company || chr(39) || 's"' AS title) FROM recent),
safe AS (SELECT *, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') AS plain FROM marked)
SELECT id, '<title>' || plain || ' at ' || company || '</title>' AS line FROM safe""")
def rss_marks(spark, sf):
    """Items whose titles hold the marks that XML gives a meaning."""
    title = F.concat("title", F.lit(' <R&D> "'), "company", F.lit("'s\""))
    items = exports.feed_items(recent(spark, sf, 100).withColumn("title", title))
    return items.select("id", F.split("item", "\n")[1].alias("line"))


# Scalar functions over whole tables ---------------------------------------------------------------

ACCENT_SQL = "strip_accents(lower({}))"
for _letter, _plain in {"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ł": "l", "ı": "i"}.items():
    ACCENT_SQL = f"replace({ACCENT_SQL}, '{_letter}', '{_plain}')"


@query(f"SELECT doc_id, md5({ACCENT_SQL.format('text')}) AS folded FROM documents")
def fold_keys(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


SANITIZE_SQL = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({}, '\([^)]*\)', ' ', 'g')), '[-–—]+', ' ', 'g'), '\s+', ' ', 'g'))"
LABEL_SQL = "'  ' || p_brand || ' (' || p_type || ') –- ' || p_name || '  '"


@query(f"SELECT p_partkey, {SANITIZE_SQL.format(LABEL_SQL)} AS clean FROM part")
def sanitize_values(spark, sf):
    raw = F.concat(F.lit("  "), "p_brand", F.lit(" ("), "p_type", F.lit(") –- "), "p_name", F.lit("  "))
    return read_table(spark, sf, "part").select("p_partkey", sanitize(raw).alias("clean"))


@query(f"""SELECT p_partkey, replace(replace(replace(url_encode(name), '%28', '('), '%29', ')'), '%21', '!') AS slug, name AS decoded,
{SANITIZE_SQL.format('name')} AS company, '' AS malformed FROM (SELECT p_partkey, p_name || '+ (' || p_brand || ')!' AS name FROM part)""")
def slug_roundtrip(spark, sf):
    name = F.concat("p_name", F.lit("+ ("), "p_brand", F.lit(")!"))
    slug = to_slug(name)
    return read_table(spark, sf, "part").select(
        "p_partkey", slug.alias("slug"), from_slug(slug).alias("decoded"), company_from_slug(slug).alias("company"),
        from_slug(F.concat(slug, F.lit("%E0%A4%A"))).alias("malformed"),
    )


@query(r"""WITH u AS (SELECT page_id, 'page' AS origin, url FROM pages
UNION ALL SELECT page_id, 'script', 'javascript:' || url FROM pages
UNION ALL SELECT page_id, 'upper', upper(substr(url, 1, 5)) || substr(url, 6) FROM pages
UNION ALL SELECT page_id, 'path', regexp_replace(url, '^https?://[^/]*', '') FROM pages
UNION ALL SELECT page_id, 'marks', url || ' b|{c}' FROM pages
UNION ALL SELECT page_id, 'host', 'https://a_' || page_id || '.example/' FROM pages
UNION ALL SELECT page_id, 'spaced', 'https://a ' || page_id || '.example/' FROM pages)
SELECT page_id, origin, regexp_matches(url, '^(?i:https?)://[^/ ?#]+([/?#]|$)') AS safe FROM u""")
def url_safety(spark, sf):
    page = read_table(spark, sf, "pages").select("page_id", "url")
    kinds = F.explode(F.array(
        F.struct(F.lit("page").alias("origin"), F.col("url").alias("link")),
        F.struct(F.lit("script").alias("origin"), F.concat(F.lit("javascript:"), "url").alias("link")),
        F.struct(F.lit("upper").alias("origin"), F.concat(F.upper(F.substring("url", 1, 5)), F.substr("url", F.lit(6))).alias("link")),
        F.struct(F.lit("path").alias("origin"), F.regexp_replace("url", "^https?://[^/]*", "").alias("link")),
        F.struct(F.lit("marks").alias("origin"), F.concat("url", F.lit(" b|{c}")).alias("link")),
        F.struct(F.lit("host").alias("origin"), F.concat(F.lit("https://a_"), F.col("page_id").cast("string"), F.lit(".example/")).alias("link")),
        F.struct(F.lit("spaced").alias("origin"), F.concat(F.lit("https://a "), F.col("page_id").cast("string"), F.lit(".example/")).alias("link")),
    ))
    return page.select("page_id", kinds.alias("k")).select("page_id", "k.origin", is_http_url(F.col("k.link")).alias("safe"))


@query("""WITH c AS (SELECT max(ts) - INTERVAL 2 HOUR AS now FROM events),
a AS (SELECT event_id, greatest(epoch_us(date_trunc('second', now)) // 1000000 - epoch_us(date_trunc('second', ts)) // 1000000, 0) AS age
FROM events, c)
SELECT event_id, CASE WHEN age < 60 THEN 'now' WHEN age < 3600 THEN (age // 60) || 'm' WHEN age < 86400 THEN (age // 3600) || 'h'
ELSE (age // 86400) || 'd' END AS age, age < 86400 AS today FROM a""")
def age_buckets(spark, sf):
    from freshet.plans.binding import events_as_of

    now = F.lit(events_as_of(spark, sf) - timedelta(hours=2))
    at = F.col("ts").cast("timestamp")
    return read_table(spark, sf, "events").select("event_id", age_bucket(at, now).alias("age"), posted_today(at, now).alias("today"))


@query(f"{WITH} SELECT id, lower(company) || '|' || lower(title) AS key FROM postings")
def role_keys(spark, sf):
    return postings(spark, sf).select("id", role_key(F.col("company"), F.col("title")).alias("key"))


@query(f"""{WITH}, grouped AS (SELECT company || '|' || lower(title) AS key, count(*) AS openings,
arg_max(id, (posted_at, id)) AS id FROM postings GROUP BY 1) SELECT * FROM grouped""")
def role_collapse(spark, sf):
    from freshet.operators.upkeep import collapse_roles

    key = role_key(F.col("company"), F.col("title"))
    return collapse_roles(postings(spark, sf), key, ["id"], ["posted_at", "id"]).select("key", "openings", "id")


@query(f"{WITH} SELECT id, company, row_number() OVER (PARTITION BY company ORDER BY posted_at DESC, id DESC) AS position FROM postings")
def list_position(spark, sf):
    from freshet.operators.upkeep import list_positions

    return list_positions(postings(spark, sf)).select("id", "company", "position")
