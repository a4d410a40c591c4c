"""Registered queries: classification, places, index and ranked search."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import vocab
from freshet.functions.classify import (
    department_dictionary, department_key, department_of_title, level_of, map_department,
)
from freshet.functions.scalars import place_text
from freshet.operators import listing, places, search
from freshet.operators.segments import SegmentedIndex
from freshet.plans.binding import DAYS, POSTINGS_SQL, as_of, facets, postings, stamp
from freshet.session import read_table, shared_dir, spread
from freshet.sources.ingest import unmapped_report

QUERIES, SQL = {}, {}
WITH = f"WITH {POSTINGS_SQL}"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "documents").select("doc_id", "text"))


# Classification ----------------------------------------------------------------------------------

@query(f"""{WITH} SELECT id, CASE WHEN title LIKE 'Principal%' THEN 'lead' WHEN title LIKE 'Senior%' THEN 'senior'
WHEN title LIKE 'Intern%' THEN 'intern' WHEN title LIKE 'Junior%' THEN 'entry' ELSE 'mid' END AS level FROM postings""")
def detect_level(spark, sf):
    return postings(spark, sf).select("id", level_of(F.col("title")).alias("level"))


TITLE_DEPARTMENT = """CASE WHEN title LIKE '%Software%' THEN 'engineering' WHEN title LIKE '%Product Design%' THEN 'product'
WHEN title LIKE '%Customer Support%' THEN 'customer support' WHEN title LIKE '%Analyst%' THEN 'data & analytics'
WHEN title LIKE '%Operations%' THEN 'operations' ELSE 'general' END"""


@query(f"{WITH} SELECT id, {TITLE_DEPARTMENT} AS department FROM postings")
def infer_department(spark, sf):
    return postings(spark, sf).select("id", department_of_title(F.col("title")).alias("department"))


BREAK = r"\b"


def _rules_sql(rules, column: str, fallback: str) -> str:
    from freshet.functions.classify import word_pattern

    cases = " ".join(f"WHEN regexp_matches({column}, '{word_pattern(words, BREAK, BREAK)}') THEN '{name}'" for name, words in rules)
    return f"CASE {cases} ELSE '{fallback}' END"


@query(f"""SELECT doc_id, {_rules_sql(vocab.LEVEL_WORDS, "strip_accents(lower(text))", "mid")} AS level,
{_rules_sql(vocab.DEPARTMENT_WORDS, "lower(text)", "general")} AS department FROM documents""")
def classify_documents(spark, sf):
    """The title rules over whole texts."""
    text = F.col("text")
    docs = documents(spark, sf)
    return docs.select("doc_id", level_of(text).alias("level"), department_of_title(text).alias("department"))


HINTS_SQL = """hints AS (SELECT id, company,
CASE num % 5 WHEN 0 THEN '77 - Commercial' WHEN 1 THEN 'Technology' WHEN 2 THEN 'None' WHEN 3 THEN 'Foundry ' || (num % 31) ELSE 'Müller  Werk' END AS first,
CASE num % 3 WHEN 0 THEN 'Personnel' WHEN 1 THEN 'n/a' ELSE 'Squad ' || (num % 23) END AS second FROM postings),
keyed AS (SELECT id, company, lower(regexp_replace(first, '^[0-9]+ - ', '')) AS k1, lower(second) AS k2 FROM hints),
mapped AS (SELECT id, company, CASE WHEN k1 = 'commercial' THEN 'sales' WHEN k1 = 'technology' THEN 'engineering' END AS b1,
CASE WHEN k2 = 'personnel' THEN 'people' END AS b2,
CASE WHEN k1 = 'müller  werk' THEN 'muller werk' WHEN k1 LIKE 'foundry%' THEN k1 END AS u1, CASE WHEN k2 LIKE 'squad%' THEN k2 END AS u2 FROM keyed)"""


def hinted(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("num")
    first = (
        F.when(n % 5 == 0, "77 - Commercial").when(n % 5 == 1, "Technology").when(n % 5 == 2, "None")
        .when(n % 5 == 3, F.concat(F.lit("Foundry "), (n % 31).cast("string"))).otherwise("Müller  Werk")
    )
    second = F.when(n % 3 == 0, "Personnel").when(n % 3 == 1, "n/a").otherwise(F.concat(F.lit("Squad "), (n % 23).cast("string")))
    return postings(spark, sf).select("id", "company", F.array(first, second).alias("hints"))


@query(f"""{WITH}, {HINTS_SQL} SELECT id, coalesce(b1, b2) AS department,
concat_ws(';', CASE WHEN b1 IS NULL THEN u1 END, CASE WHEN b1 IS NULL AND b2 IS NULL THEN u2 END) AS unmapped FROM mapped""")
def map_departments(spark, sf):
    found = map_department(hinted(spark, sf).select("id", "hints"), "hints", "id", department_dictionary(spark))
    return found.select("id", "department", F.array_join("unmapped", ";").alias("unmapped"))


@query(f"""{WITH}, {HINTS_SQL}, names AS (SELECT DISTINCT company, name FROM (
SELECT company, u1 AS name FROM mapped WHERE b1 IS NULL AND u1 IS NOT NULL
UNION ALL SELECT company, u2 FROM mapped WHERE b1 IS NULL AND b2 IS NULL AND u2 IS NOT NULL)),
placed AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY name) AS n FROM names)
SELECT company, count(*) AS distinct_names, string_agg(name, ';' ORDER BY name) FILTER (n <= 10) AS sample FROM placed GROUP BY 1""")
def unmapped_names(spark, sf):
    rows = hinted(spark, sf)
    found = map_department(rows.select("id", "hints"), "hints", "id", department_dictionary(spark))
    names = found.select("id", F.explode("unmapped").alias("name")).join(rows.select("id", "company"), "id")
    return unmapped_report(names.select("company", "name"), "company").withColumn("sample", F.array_join("sample", ";"))


@query("SELECT s_suppkey, lower(replace(s_name, '#', ' unit ')) AS key FROM supplier")
def department_keys(spark, sf):
    raw = F.concat((F.col("s_suppkey") + 10).cast("string"), F.lit(" - "), F.replace(F.col("s_name"), F.lit("#"), F.lit("  Unit ")))
    return read_table(spark, sf, "supplier").select("s_suppkey", department_key(raw).alias("key"))


# Places ------------------------------------------------------------------------------------------

# Location text per nation number, and the place it should resolve to under the default gazetteer.
PLACE_CASES = (
    ("Hamburg", "hamburg", "germany", False),  # a city by its name
    ("Sao Paulo", "sao paulo", "brazil", False),
    ("Singapore", "singapore", "singapore", False),
    ("Rijeka, Croatia", "rijeka", "croatia", False),  # with its country
    ("Leeds, England", "leeds", "united kingdom", False),
    ("Deutschland", None, "germany", False),  # a country alone
    ("Great Britain", None, "united kingdom", False),
    ("Atlantis", None, None, False),  # neither
    ("Portland, Oregon", None, "united states", False),  # a region stands for its country
    ("Red Deer, Alberta", None, "canada", False),
    ("Omaha, NE 68102", "omaha", "united states", False),  # a postal code goes
    ("us-co-denver", "denver", "united states", False),  # dashes of a site code
    ("US-NV-Henderson", None, "united states", False),
    ("Remote — Portugal", None, "portugal", True),
    ("UK (Remote)", None, "united kingdom", True),
    ("Anywhere", None, None, True),
    ("Remotely Ltd, Paris", "paris", "france", False),  # no whole word "remote"
    ("Santiago, Spain", "santiago de compostela", "spain", False),  # the country chooses between two cities
    ("Hamilton, New Zealand", "hamilton", "new zealand", False),
    ("Hamilton, Norway", None, "norway", False),
    ("Stockholm Office 3", "stockholm", "sweden", False),  # a city's words inside other text
    ("Paris or Berlin", "berlin", "germany", False),
    ("40 Harbour Road, Milwaukee", "milwaukee", "united states", False),  # a street
    ("7 Hill Lane, Vienna, Ohio", None, "united states", False),
    ("worldwide", None, None, False),
)


def _literal(value: object) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value).upper()


CASES_SQL = "cases(n, text, city, country, remote) AS (VALUES " + ", ".join(
    f"({n}, {', '.join(_literal(v) for v in case)})" for n, case in enumerate(PLACE_CASES)
) + ")"
RAW_SQL = "text || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' - ' || c_mktsegment ELSE '  ' END"


def _case_text(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c[0]) for c in PLACE_CASES]), F.pmod(number, F.lit(len(PLACE_CASES))).cast("int") + 1)


def place_jobs(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.pmod("c_custkey", F.lit(3))
    tail = F.when(turn == 0, F.lit("")).when(turn == 1, F.concat(F.lit(" - "), "c_mktsegment")).otherwise(F.lit("  "))
    return read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(_case_text(F.col("c_nationkey")), tail).alias("location"),
        F.array(_case_text(F.col("c_nationkey") + 1)).alias("locations"),
        (F.pmod("c_custkey", F.lit(31)) == 0).alias("is_remote"),
    )


@query(f"""WITH {CASES_SQL} SELECT DISTINCT {RAW_SQL} AS raw, city, country, remote, city IS NOT NULL OR country IS NOT NULL OR remote AS resolved
FROM customer JOIN cases ON n = c_nationkey % 25""")
def resolve_places(spark, sf):
    raws = place_jobs(spark, sf).select(F.col("location").alias("raw")).distinct()
    return places.resolve_places(raws, places.default_gazetteer(spark))


DERIVED_SQL = f"""{CASES_SQL}, jobs AS (SELECT c_custkey AS id, a.city, a.country, a.remote, b.city AS city2, b.country AS country2, b.remote AS remote2
FROM customer JOIN cases a ON a.n = c_nationkey % 25 JOIN cases b ON b.n = (c_nationkey + 1) % 25)"""


@query(f"""WITH {DERIVED_SQL} SELECT id, CASE WHEN remote THEN 'remote' || coalesce(', ' || country, '')
ELSE coalesce(nullif(concat_ws(', ', city, country), ''), 'unknown') END AS location,
city, country, remote OR remote2 OR id % 31 = 0 AS is_remote FROM jobs""")
def derive_fields(spark, sf):
    jobs = place_jobs(spark, sf)
    placed = places.office_places(jobs, places.default_gazetteer(spark))
    return places.derive_location(jobs, placed).select("id", "location", "city", "country", "is_remote")


@query(f"""WITH {DERIVED_SQL} SELECT id AS job_id, coalesce(city, '') AS city, country FROM jobs WHERE country IS NOT NULL
UNION SELECT id, coalesce(city2, ''), country2 FROM jobs WHERE country2 IS NOT NULL""")
def derive_facets(spark, sf):
    jobs = place_jobs(spark, sf)
    return places.location_facets(places.office_places(jobs, places.default_gazetteer(spark)))


@query("""WITH parts AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, l_suppkey % 4 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, 'Site ' || l_suppkey || CASE k WHEN 0 THEN '|A/B|' || l_returnflag WHEN 1 THEN '/' || l_returnflag WHEN 2 THEN '|' || l_linestatus ELSE '' END AS offices,
CASE k WHEN 0 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS n FROM parts""")
def split_offices(spark, sf):
    k = F.col("l_suppkey") % 4
    tail = (
        F.when(k == 0, F.concat(F.lit(" ; A/B  •"), F.lit(" | "), F.col("l_returnflag"), F.lit(" / "))).when(k == 1, F.concat(F.lit("/"), "l_returnflag"))
        .when(k == 2, F.concat(F.lit(" / "), "l_linestatus")).otherwise(F.lit(" ;"))
    )
    raw = F.concat(F.lit("Site "), F.col("l_suppkey").cast("string"), tail)
    offices = places.split_offices(raw)
    return read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array_join(offices, "|").alias("offices"), F.size(offices).alias("n")
    )


@query(f"""{WITH} SELECT id, CASE WHEN is_remote THEN 'remote, ' || country WHEN num % 3 = 0 THEN city || ', ' || country
WHEN num % 3 = 1 THEN city ELSE 'unknown' END AS place FROM postings""")
def place_texts(spark, sf):
    n = F.col("num") % 3
    country = F.when(F.col("is_remote") | (n == 0), F.col("country"))
    city = F.when(n != 2, F.col("city"))
    return postings(spark, sf).select("id", place_text(city, country, F.col("is_remote")).alias("place"))


# Search ------------------------------------------------------------------------------------------

FIELDS = ("title", "company", "location", "department")


PART_FIELDS = ("p_name", "p_brand", "p_type")
_STORED: dict[tuple[str, str, str], str] = {}


def kept_index(spark: SparkSession, sf: str, name: str) -> search.SearchIndex:
    """The written index of postings, parts or documents; the first search of an application writes it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        built = {
            "postings": lambda: search.build_index(postings(spark, sf, busy=True), "id", FIELDS, ["id"]),
            "part": lambda: search.build_index(read_table(spark, sf, "part"), "p_partkey", PART_FIELDS, ["p_partkey"]),
            "documents": lambda: search.build_index(documents(spark, sf), "doc_id", ["text"]),
        }[name]()
        folder = f"{shared_dir(spark)}/freshet-index/{uuid.uuid4().hex}"
        search.store_index(built, folder)
        _STORED[key] = folder
    return search.stored_index(spark, _STORED[key])


def part_index(spark: SparkSession, sf: str) -> search.SearchIndex:
    return kept_index(spark, sf, "part")


def toks(column: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(CAST({column} AS VARCHAR))), '[\\p{{L}}\\p{{N}}]+')"


def _tf(phrase: search.Phrase, words: str) -> str:
    if phrase.prefix:
        return f"len(list_filter({words}, lambda w: starts_with(w, '{phrase.terms[0]}')))"
    tests = " AND ".join(f"{words}[i + {k}] = '{t}'" for k, t in enumerate(phrase.terms))
    return f"len(list_filter(range(1, len({words}) + 1), lambda i: {tests}))"


def ranking_sql(table: str, id_col: str, fields, unsearched, q: str) -> str:
    """CTEs docs -> tf -> stats -> scored(doc_id, title_score, score)."""
    phrases = search.read_query(q)
    words = ", ".join(f"{toks(f)} AS w{j}" for j, f in enumerate(fields))
    size = " + ".join([f"len(w{j})" for j in range(len(fields))] + [f"len({toks(u)})" for u in unsearched])
    tf_title = ", ".join(f"{_tf(p, 'w0')} AS t{i}" for i, p in enumerate(phrases))
    tf_all = ", ".join(" + ".join(_tf(p, f"w{j}") for j in range(len(fields))) + f" AS a{i}" for i, p in enumerate(phrases))
    counts = ", ".join(f"count(*) FILTER (a{i} > 0) AS n{i}" for i in range(len(phrases)))
    idf = ", ".join(f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END AS idf{i}" for i in range(len(phrases)))

    def score(kind: str) -> str:
        return "-(" + " + ".join(f"idf{i} * {kind}{i} * 2.2 / ({kind}{i} + 1.2 * (0.25 + 0.75 * d / mean))" for i in range(len(phrases))) + ")"

    every = " AND ".join(f"a{i} > 0" for i in range(len(phrases)))
    return f"""docs AS (SELECT {id_col} AS doc_id, *, {words} FROM {table}),
tf AS (SELECT doc_id, CAST({size} AS DOUBLE) AS d, {tf_title}, {tf_all} FROM docs),
stats AS (SELECT count(*) AS n, avg(d) AS mean, {counts} FROM tf),
weights AS (SELECT *, {idf} FROM stats),
scored AS (SELECT doc_id, {score('t')} AS title_score, {score('a')} AS score FROM tf, weights WHERE {every})"""


@query(f"WITH docs AS (SELECT {' + '.join(f'len({toks(f)})' for f in (*PART_FIELDS, 'p_partkey'))} AS d FROM part) SELECT count(*) AS docs, round(avg(d), 6) AS mean_length, CAST(sum(d) AS BIGINT) AS tokens FROM docs")
def index_stats(spark, sf):
    lengths = part_index(spark, sf).lengths
    return lengths.agg(F.count("*").alias("docs"), F.round(F.avg("length"), 6).alias("mean_length"), F.sum("length").alias("tokens"))


@query(f"""WITH words AS (SELECT doc_id, unnest({toks('text')}) AS term, generate_subscripts({toks('text')}, 1) - 1 AS pos FROM documents)
SELECT doc_id, term, count(*) AS tf, CAST(min(pos) AS BIGINT) AS first_pos, CAST(sum(pos) AS BIGINT) AS pos_sum FROM words GROUP BY 1, 2""")
def build_index(spark, sf):
    """Every term of every document with its positions."""
    terms = search.build_index(documents(spark, sf), "doc_id", ["text"]).terms
    return terms.select(
        "doc_id", "term", F.size("positions").cast("long").alias("tf"), F.col("positions")[0].cast("long").alias("first_pos"),
        F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p).alias("pos_sum"),
    )


PART_QUERY = "small-ring eco"


@query(f"WITH {ranking_sql('part', 'p_partkey', PART_FIELDS, ['p_partkey'], PART_QUERY)} SELECT doc_id, round(title_score, 6) AS title_score, round(score, 6) AS score FROM scored")
def bm25_parts(spark, sf):
    found = search.bm25(part_index(spark, sf), search.read_query(PART_QUERY), "p_name", PART_FIELDS)
    return found.select("doc_id", F.round("title_score", 6).alias("title_score"), F.round("score", 6).alias("score"))


DOC_QUERY = "that the-and er"


@query(f"WITH {ranking_sql('documents', 'doc_id', ['text'], [], DOC_QUERY)} SELECT doc_id, round(score, 6) AS score FROM scored")
def bm25_documents(spark, sf):
    found = search.bm25(kept_index(spark, sf, "documents"), search.read_query(DOC_QUERY), "text", ["text"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


SCAN_QUERY = "the er-on"


@query(f"WITH {ranking_sql('documents', 'doc_id', ['text'], [], SCAN_QUERY)} SELECT doc_id, round(score, 6) AS score FROM scored")
def bm25_scan(spark, sf):
    """Texts that have no index, in one pass."""
    found = search.bm25(search.TextScan(documents(spark, sf), "doc_id", ["text"]), search.read_query(SCAN_QUERY), "text", ["text"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {ranking_sql('postings', 'id', FIELDS, ['id'], 'data-analyst eur').replace('docs AS', f'{POSTINGS_SQL.strip()}, docs AS', 1)}
SELECT doc_id, round(title_score, 6) AS title_score, round(score, 6) AS score FROM scored""")
def bm25_index(spark, sf):
    """Scores of the whole postings table through an index."""
    found = search.bm25(kept_index(spark, sf, "postings"), search.read_query("data-analyst eur"), "title", FIELDS)
    return found.select("doc_id", F.round("title_score", 6).alias("title_score"), F.round("score", 6).alias("score"))


@query(f"WITH {ranking_sql('part', 'p_partkey', PART_FIELDS, ['p_partkey'], 'brand blue')} SELECT doc_id FROM scored")
def match_all_terms(spark, sf):
    return search.match_ids(part_index(spark, sf), search.read_query("brand blue"), "p_name", PART_FIELDS)


@query(f"""WITH {ranking_sql('part', 'p_partkey', PART_FIELDS, ['p_partkey'], 'brand blue')} SELECT q, count(s.doc_id) AS found
FROM (VALUES ('+++ --'), ('brand blue'), ('brand nosuchword')) v(q) LEFT JOIN scored s ON q = 'brand blue' GROUP BY 1""")
def match_nothing(spark, sf):
    """A query without words finds nothing, nor does one with a word that stands nowhere."""
    index = part_index(spark, sf)
    counts = [
        search.match_ids(index, search.read_query(q), "p_name", PART_FIELDS).agg(F.count("*").alias("found")).select(F.lit(q).alias("q"), "found")
        for q in ("+++ --", "brand blue", "brand nosuchword")
    ]
    return reduce(DataFrame.unionByName, counts)


RANKED_QUERY = "senior data-analyst asia"
RANKED_SQL = f"""{WITH}, {ranking_sql('postings', 'id', FIELDS, ['id'], RANKED_QUERY)},
found AS (SELECT f.*, 1 + (epoch_us(f.posted_at) - epoch_us(cutoff)) / 86400e6 / {DAYS} AS boost, title_score, score
FROM shown f JOIN scored ON doc_id = f.id, clock)"""


def ranked_rows(spark: SparkSession, sf: str):
    request = listing.SearchRequest(q=RANKED_QUERY)
    rows = listing.filter_postings(postings(spark, sf), facets(spark, sf), request, as_of(spark, sf), DAYS)
    return search.search(rows, kept_index(spark, sf, "postings"), request, as_of(spark, sf), "title", FIELDS, DAYS)


@query(f"""{RANKED_SQL} SELECT id, title, round(title_score * boost, 6) AS title_rank, round(score * boost, 6) AS rank FROM found
ORDER BY title_score * boost, score * boost, id DESC LIMIT 50""")
def ranked_page(spark, sf):
    page, _ = ranked_rows(spark, sf)
    return page.select("id", "title", F.round("title_rank", 6).alias("title_rank"), F.round("rank", 6).alias("rank"))


@query(f"{RANKED_SQL} SELECT count(*) AS total FROM found")
def ranked_total(spark, sf):
    return ranked_rows(spark, sf)[1]


@query(f"""{RANKED_SQL} SELECT id, strftime(found.posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at FROM found ORDER BY found.posted_at DESC, id DESC LIMIT 10""")
def search_newest(spark, sf):
    request = listing.SearchRequest(q=RANKED_QUERY, sort="newest", limit=10)
    rows = listing.filter_postings(postings(spark, sf), facets(spark, sf), request, as_of(spark, sf), DAYS)
    page, _ = search.search(rows, kept_index(spark, sf, "postings"), request, as_of(spark, sf), "title", FIELDS, DAYS)
    return page.select("id", stamp("posted_at").alias("posted_at"))


SEGMENT_WAVES = 5
SEGMENT_QUERY = "zebra the"
EDITED_SQL = f"""edited AS (SELECT doc_id, text || ' zebra' AS text FROM documents WHERE doc_id % {7 * SEGMENT_WAVES} >= {SEGMENT_WAVES})"""


def segmented_documents(spark: SparkSession, sf: str) -> SegmentedIndex:
    """All documents, then waves that change a fifth of them each and remove some."""
    kept = SegmentedIndex(spark, f"{shared_dir(spark)}/freshet-segments/{uuid.uuid4().hex}", "bigint")
    rows = documents(spark, sf)
    kept.update(search.build_index(rows, "doc_id", ["text"]), rows)
    for wave in range(SEGMENT_WAVES):
        touched = rows.filter(F.col("doc_id") % SEGMENT_WAVES == wave)
        there = touched.filter(F.col("doc_id") % (7 * SEGMENT_WAVES) != wave).withColumn("text", F.concat("text", F.lit(" zebra")))
        kept.update(search.build_index(there, "doc_id", ["text"]), touched)
    return kept


@query(f"WITH {EDITED_SQL}, {ranking_sql('edited', 'doc_id', ['text'], [], SEGMENT_QUERY)} SELECT doc_id, round(score, 6) AS score FROM scored")
def index_segments(spark, sf):
    """K7: scores from an index that was updated segment by segment."""
    found = search.bm25(segmented_documents(spark, sf).index(), search.read_query(SEGMENT_QUERY), "text", ["text"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {EDITED_SQL} SELECT count(*) AS n, CAST(sum(len({toks('text')})) AS BIGINT) AS total FROM edited")
def index_segment_stats(spark, sf):
    """A16 by addition: no document is counted again."""
    return segmented_documents(spark, sf).index().summary


@query(f"""WITH docs AS (SELECT p_partkey, unnest(list_concat({toks("p_name || CASE WHEN p_partkey % 4 = 0 THEN ' renewed' ELSE '' END")}, {toks('p_brand')})) AS term FROM part)
SELECT p_partkey AS doc_id, term, count(*) AS tf FROM docs GROUP BY 1, 2""")
def index_update(spark, sf):
    """A quarter of the documents change; only their rows are replaced."""
    part = read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    renamed = part.withColumn("p_name", F.when(F.col("id") % 4 == 0, F.concat("p_name", F.lit(" renewed"))).otherwise(F.col("p_name")))
    touched = part.filter("id % 4 = 0").select("id")
    old = search.build_index(part, "id", ("p_name", "p_brand"))
    new = search.build_index(search.index_rows(renamed, touched), "id", ("p_name", "p_brand"))
    merged = search.update_index(old, new, touched.select(F.col("id").alias("doc_id")))
    return merged.terms.groupBy("doc_id", "term").agg(F.sum(F.size("positions")).alias("tf"))
