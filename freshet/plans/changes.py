"""Registered queries: snapshot comparison, keyed rewrites, clean-up."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import vocab
from freshet.functions.scalars import remap_level
from freshet.operators import cdc, upkeep
from freshet.plans.binding import BOARDS, FACETS_SQL, POSTINGS_SQL, as_of, facets, postings, stamp
from freshet.plans.reads import cutoff_of
from freshet.session import cut, read_table
from freshet.sources.layout import Clustered, bucketed

QUERIES, SQL = {}, {}
WITH = f"WITH {POSTINGS_SQL}"
AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
BEGINNING = datetime(1990, 1, 1)
ROW = ("title", "company", "location", "department", "url", "source", "salary", "locations", "level", "city", "country", "is_remote")


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


def stored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The stored postings; some have an empty list of offices, which a feed sends as null."""
    none = F.array().cast("array<string>")
    return postings(spark, sf).withColumn("locations", F.when(F.col("num") % 17 == 0, none).otherwise(F.col("locations")))


def edited(stored: DataFrame) -> DataFrame:
    """A later snapshot of the stored postings: rows gone, re-dated, renamed, moved and added."""
    n = F.col("num")
    board = n % BOARDS
    whole = F.floor(n / BOARDS)
    gone = (n % 10 == 3) | ((board == 5) & (whole % 3 != 0))
    shift = F.when(n % 7 == 1, 30).when(n % 7 == 2, 86400).when(n % 7 == 3, -86400).otherwise(0)
    moved = n % 12 == 5
    kept = stored.filter(~gone).withColumns({
        "posted_at": F.timestamp_seconds(F.unix_seconds("posted_at") + shift),
        "title": F.when(n % 6 == 1, F.concat("title", F.lit(" II"))).otherwise(F.col("title")),
        "city": F.when(moved, F.lit("elsewhere")).otherwise(F.col("city")),
        "company": F.when(n % 8 == 2, F.concat("company", F.lit(" group"))).otherwise(F.col("company")),
        "locations": F.when(n % 17 != 0, F.when(n % 9 == 4, F.array(F.lit("a"), "location")).otherwise(F.col("locations"))),
    })
    added = stored.filter(n % 20 == 0).withColumn("id", F.concat_ws("-", F.lit("od"), board.cast("string"), F.concat(F.lit("n"), n.cast("string"))))
    return kept.unionByName(added).select("id", "board", "posted_at", *ROW)


def snapshot_boards(rows: DataFrame) -> DataFrame:
    """Boards in the snapshot, a small table; every fourth one is only partly fetched."""
    number = F.substring_index("board", "/", -1).cast("int")
    return cut(rows.select("board").distinct().withColumn("complete", number % 4 != 2))


EDITS_SQL = f"""
stored AS (SELECT * REPLACE (CASE WHEN num % 17 = 0 THEN CAST([] AS VARCHAR[]) ELSE locations END AS locations) FROM postings),
kept AS (SELECT * REPLACE (
    posted_at + CASE num % 7 WHEN 1 THEN INTERVAL 30 SECOND WHEN 2 THEN INTERVAL 1 DAY WHEN 3 THEN INTERVAL (-1) DAY ELSE INTERVAL 0 SECOND END AS posted_at,
    CASE WHEN num % 6 = 1 THEN title || ' II' ELSE title END AS title,
    CASE WHEN num % 12 = 5 THEN 'elsewhere' ELSE city END AS city,
    CASE WHEN num % 8 = 2 THEN company || ' group' ELSE company END AS company,
    CASE WHEN num % 17 = 0 THEN NULL WHEN num % 9 = 4 THEN ['a', location] ELSE locations END AS locations)
  FROM stored WHERE NOT (num % 10 = 3 OR (num % {BOARDS} = 5 AND (num // {BOARDS}) % 3 <> 0))),
fetched AS (SELECT * FROM kept UNION ALL BY NAME
  SELECT * REPLACE ('od-' || (num % {BOARDS}) || '-n' || num AS id) FROM stored WHERE num % 20 = 0),
joined AS (
  SELECT coalesce(n.id, o.id) AS id, coalesce(n.board, o.board) AS board, o.id IS NOT NULL AS was_stored, n.id IS NOT NULL AS was_fetched,
         o.posted_at AS old_at, n.title AS new_title, n.city AS new_city, o.company AS old_company, n.company AS new_company, o.title AS old_title, o.city AS old_city,
         o.created_at AS old_created,
         CASE WHEN o.id IS NULL THEN n.posted_at WHEN n.posted_at > o.posted_at + INTERVAL 60 SECOND THEN o.posted_at ELSE n.posted_at END AS posted_at,
         o.id IS NOT NULL AND n.id IS NOT NULL AND (o.city IS DISTINCT FROM n.city OR list_sort(coalesce(o.locations, [])) <> list_sort(coalesce(n.locations, []))) AS location_changed,
         o.id IS NOT NULL AND n.id IS NOT NULL AND (o.title <> n.title OR o.company <> n.company) AS core_changed
  FROM stored o FULL JOIN fetched n ON o.id = n.id),
changes AS (
  SELECT *, CASE WHEN NOT was_stored THEN 'insert' WHEN NOT was_fetched THEN 'missing'
    WHEN location_changed OR core_changed OR abs(epoch(posted_at) - epoch(old_at)) >= 60 THEN 'update' ELSE 'unchanged' END AS action
  FROM joined),
guarded AS (
  SELECT board, count(*) FILTER (was_stored) AS stored, count(*) FILTER (action = 'missing') AS missing,
         count(*) FILTER (action = 'insert') AS inserts, count(*) FILTER (action = 'update') AS updates,
         CAST(split_part(board, '/', 2) AS INT) % 4 <> 2 AS complete
  FROM changes GROUP BY board),
judged AS (SELECT *, stored >= 10 AND missing > stored * 0.5 AS suspicious FROM guarded),
deletes AS (SELECT c.id FROM changes c JOIN judged j ON c.board = j.board WHERE action = 'missing' AND complete AND NOT suspicious)
"""
CHANGES = f"WITH {POSTINGS_SQL}, {EDITS_SQL}"


def snapshot(spark: SparkSession, sf: str):
    stored = stored_rows(spark, sf)
    fetched = edited(stored)
    boards = snapshot_boards(fetched)
    live = cdc.stored_of(stored, boards, BEGINNING)
    return stored, boards, cut(cdc.diff(live, fetched))  # every later step reads the changes


@query(f"""{CHANGES} SELECT id, board, action, location_changed, core_changed, {AT.format('changes.posted_at')} AS posted_at FROM changes
WHERE action <> 'missing' UNION ALL SELECT id, board, action, FALSE, FALSE, NULL FROM changes WHERE action = 'missing'""")
def snapshot_diff(spark, sf):
    stored = stored_rows(spark, sf)
    fetched = edited(stored)
    changes = cdc.diff(cdc.stored_of(stored, snapshot_boards(fetched), BEGINNING), fetched)
    at = F.when(F.col("action") != "missing", stamp("posted_at"))
    return changes.select("id", "board", "action", "location_changed", "core_changed", at.alias("posted_at"))


DIFF_BUCKETS = 16


@query(f"""{CHANGES} SELECT id, board, action, {AT.format('changes.posted_at')} AS posted_at FROM changes
WHERE action <> 'missing' UNION ALL SELECT id, board, action, NULL FROM changes WHERE action = 'missing'""")
def snapshot_diff_bucketed(spark, sf):
    """J5 against a stored table that lies in buckets by id: only the snapshot moves."""
    stored = stored_rows(spark, sf)
    fetched = edited(stored)
    changes = cdc.diff(bucketed(stored.drop("num"), "id", DIFF_BUCKETS), fetched)
    at = F.when(F.col("action") != "missing", stamp("posted_at"))
    return changes.select("id", "board", "action", at.alias("posted_at"))


@query(f"""WITH {POSTINGS_SQL} SELECT id, {AT.format('fresh.posted_at')} AS posted_at, title FROM fresh WHERE id >= 'od-3-' AND id < 'od-3.'""")
def board_rows_clustered(spark, sf):
    """One board's fresh rows from a table clustered on id and date."""
    kept = Clustered.write(postings(spark, sf).select("id", "posted_at", "title"), ("id", "posted_at"))
    rows = kept.read(("od-3-", "od-3."), (cutoff_of(spark, sf), None))
    return rows.select("id", stamp("posted_at").alias("posted_at"), "title")


@query(f"""{CHANGES} SELECT board, complete, stored, missing, inserts, updates, complete AND suspicious AS suspicious,
CASE WHEN complete AND NOT suspicious THEN missing ELSE 0 END AS deletes,
inserts > 0 OR updates > 0 OR (complete AND NOT suspicious AND missing > 0) AS wrote FROM judged""")
def diff_guard(spark, sf):
    _, boards, changes = snapshot(spark, sf)
    return cdc.board_outcome(cdc.guard(changes), boards)


@query(f"{CHANGES} SELECT id FROM deletes")
def allowed_deletes(spark, sf):
    _, boards, changes = snapshot(spark, sf)
    return cdc.allowed_deletes(changes, cdc.guard(changes), boards)


@query(f"""{CHANGES} SELECT c.id, CASE WHEN action IN ('insert', 'update') THEN new_title ELSE old_title END AS title,
CASE WHEN action IN ('insert', 'update') THEN new_company ELSE old_company END AS company, CASE WHEN action IN ('insert', 'update') THEN new_city ELSE old_city END AS city,
{AT.format("CASE WHEN action IN ('insert', 'update') THEN c.posted_at ELSE old_at END")} AS posted_at,
{AT.format('coalesce(old_created, as_of)')} AS created_at
FROM changes c, clock WHERE c.id NOT IN (SELECT id FROM deletes)""")
def upsert_result(spark, sf):
    stored, boards, changes = snapshot(spark, sf)
    written = cdc.upsert(stored, cdc.puts_of(changes, F.lit(as_of(spark, sf))))
    left = cdc.without_ids(written, cdc.allowed_deletes(changes, cdc.guard(changes), boards))
    return left.select("id", "title", "company", "city", stamp("posted_at").alias("posted_at"), stamp("created_at").alias("created_at"))


@query(f"""{CHANGES}, {FACETS_SQL} SELECT job_id, city, country FROM facets WHERE job_id NOT IN (SELECT id FROM deletes)""")
def cascade_delete(spark, sf):
    _, boards, changes = snapshot(spark, sf)
    gone = cdc.allowed_deletes(changes, cdc.guard(changes), boards)
    return cdc.without_ids(facets(spark, sf), gone, "job_id")


@query(f"""{CHANGES}, {FACETS_SQL}, touched AS (SELECT id, new_city FROM changes WHERE location_changed)
SELECT job_id, city, country FROM facets WHERE job_id NOT IN (SELECT id FROM touched)
UNION ALL SELECT id, coalesce(new_city, ''), 'moved' FROM touched""")
def facet_rewrite(spark, sf):
    _, _, changes = snapshot(spark, sf)
    touched = changes.filter("location_changed")
    new = touched.select(F.col("id").alias("job_id"), F.coalesce("city", F.lit("")).alias("city"), F.lit("moved").alias("country"))
    return cdc.replace_facets(facets(spark, sf), touched.select("id"), new)


@query(f"""{WITH}, ranked AS (SELECT id, row_number() OVER g AS rn, min(source) OVER p AS lo, max(source) OVER p AS hi
FROM fresh WHERE city IS NOT NULL AND country IS NOT NULL
WINDOW p AS (PARTITION BY company, lower(title), city), g AS (PARTITION BY company, lower(title), city ORDER BY posted_at, source, id))
SELECT id FROM ranked WHERE rn > 1 AND lo <> hi""")
def duplicate_postings(spark, sf):
    return upkeep.duplicate_postings(postings(spark, sf), cutoff_of(spark, sf)).select("id")


@query("""WITH ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, lower(text) ORDER BY source, doc_id) AS rn,
min(source) OVER (PARTITION BY lang, lower(text)) AS lo, max(source) OVER (PARTITION BY lang, lower(text)) AS hi FROM documents)
SELECT doc_id FROM ranked WHERE rn > 1 AND lo <> hi""")
def cross_source_dedupe(spark, sf):
    # The whole text decides; its digest keeps the text itself out of the shuffles.
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "source", F.sha2(F.lower("text"), 256).alias("digest"))
    keys = {"_lang": F.col("lang"), "_text": F.col("digest")}
    return upkeep.cross_source_duplicates(docs, keys, ["source", "doc_id"], "source").select("doc_id")


STALE = f"{WITH}, stale AS (SELECT id, posted_at FROM postings, clock WHERE posted_at < cutoff)"


@query(f"{STALE} SELECT p.id, {AT.format('p.posted_at')} AS posted_at FROM postings p WHERE id NOT IN (SELECT id FROM stale)")
def stale_sweep(spark, sf):
    rows = postings(spark, sf)
    return upkeep.without_stale(rows, cutoff_of(spark, sf)).select("id", stamp("posted_at").alias("posted_at"))


@query(f"{STALE} SELECT id FROM stale ORDER BY posted_at, id LIMIT 1500")
def stale_round(spark, sf):
    taken, _ = upkeep.bounded_round(upkeep.stale_ids(postings(spark, sf), cutoff_of(spark, sf)), ["posted_at", "id"], vocab.CLEANUP_ROUND)
    return taken.select("id")


@query(f"{STALE} SELECT least(count(*), 1500) AS taken, greatest(count(*) - 1500, 0) AS deferred FROM stale")
def stale_deferred(spark, sf):
    _, counts = upkeep.bounded_round(upkeep.stale_ids(postings(spark, sf), cutoff_of(spark, sf)), ["posted_at", "id"], vocab.CLEANUP_ROUND)
    return counts


@query(f"{WITH}, {FACETS_SQL} SELECT f.job_id, f.city, f.country FROM facets f WHERE job_id NOT IN (SELECT id FROM shown)")
def orphan_facets(spark, sf):
    live = postings(spark, sf).filter((F.col("posted_at") >= F.lit(cutoff_of(spark, sf))) & F.col("url").startswith("https://"))
    return upkeep.orphan_facets(facets(spark, sf), live)


@query("""SELECT DISTINCT 'l' || l_orderkey AS job_id, 's' || l_suppkey AS city, l_returnflag AS country FROM lineitem""")
def exact_dup_facets(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    raw = lines.select(
        F.concat(F.lit("l"), F.col("l_orderkey").cast("string")).alias("job_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("city"), F.col("l_returnflag").alias("country"),
    )
    return upkeep.exact_facets(raw)


OLD = "CASE num % 8 WHEN 0 THEN 'staff' WHEN 1 THEN 'vp' WHEN 2 THEN 'c_suite' WHEN 3 THEN 'intern' WHEN 4 THEN 'senior' WHEN 5 THEN 'entry' WHEN 6 THEN 'director' ELSE 'associate' END"


@query(f"""{WITH}, old AS (SELECT id, {OLD} AS old_level FROM postings) SELECT id, old_level, CASE WHEN old_level IN ('intern', 'entry', 'senior') THEN old_level
WHEN old_level IN ('staff', 'vp', 'c_suite', 'director') THEN 'lead' ELSE 'mid' END AS level FROM old""")
def level_remap(spark, sf):
    old = postings(spark, sf).select("id", F.expr(OLD).alias("old_level"))
    return old.withColumn("level", remap_level(F.col("old_level")))


MESSY = f"""messy AS (SELECT id, upper(company) AS company, CASE WHEN is_remote THEN 'Remote' ELSE upper(location) END AS location,
upper(city) AS city, CASE WHEN country = 'asia' THEN 'Korea' ELSE country END AS country FROM postings)"""


@query(f"""{WITH}, {MESSY} SELECT id, lower(company) AS company, lower(location) AS location, lower(city) AS city,
CASE WHEN lower(country) = 'korea' THEN 'south korea' ELSE lower(country) END AS country, lower(location) = 'remote' AS is_remote FROM messy""")
def backfill_normalise(spark, sf):
    rows = postings(spark, sf).select(
        "id", F.upper("company").alias("company"),
        F.when(F.col("is_remote"), F.lit("Remote")).otherwise(F.upper("location")).alias("location"),
        F.upper("city").alias("city"), F.when(F.col("country") == "asia", F.lit("Korea")).otherwise(F.col("country")).alias("country"),
        F.lit(False).alias("is_remote"),
    )
    return upkeep.normalise_stored(rows)


@query(f"""WITH {FACETS_SQL} SELECT DISTINCT job_id, city, CASE WHEN country = 'asia' THEN 'south korea' ELSE country END AS country FROM facets""")
def backfill_facets(spark, sf):
    """Every row stands twice, in two spellings of city and country."""
    asia = F.col("country") == "asia"
    spellings = F.array(
        F.struct(F.upper("city").alias("city"), F.when(asia, F.lit("Korea")).otherwise(F.upper("country")).alias("country")),
        F.struct(F.initcap("city").alias("city"), F.when(asia, F.lit("South Korea")).otherwise(F.initcap("country")).alias("country")),
    )
    raw = facets(spark, sf).select("job_id", F.explode(spellings).alias("s")).select("job_id", "s.city", "s.country")
    return upkeep.normalise_facets(raw)
