"""Place resolution: location text to city, country and remote flag, as joins with a gazetteer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import vocab
from freshet.functions.scalars import place_text
from freshet.functions.text import WORD_END, WORD_START, fold, squeeze
from freshet.operators.listing import Place
from freshet.operators.skew import salted_join

GAZETTEER = (
    "token string, country string, region_country string, city string, city_country string, "
    "overrides map<string,string>, ord int"
)
FUZZY_MIN_LENGTH = 5

# Patterns of place text.
REMOTE = rf"{WORD_START}remote{WORD_END}|^(?:anywhere|work from home|wfh){WORD_END}|^distributed$"
SEGMENT_BREAK = r"[,/•|;—–]+|\s+-\s+"
OFFICE_BREAK = r"\s*[;•|]\s*|\s+/\s+"
STREET = r"^\d+\s+\w+"
COUNT_OF_PLACES = r"\d+\s+locations?"
ZIP_TAIL = r"\s+\d{5}(?:-\d{4})?$"
NOISE = r"^[\s\-().]*$"


def default_gazetteer(spark: SparkSession) -> DataFrame:
    """Our own small gazetteer; a larger one with the same columns can take its place."""
    rows: dict[str, dict] = {}

    def at(token: str) -> dict:
        return rows.setdefault(token, {"token": token, "ord": len(rows)})

    for country in vocab.COUNTRIES:
        at(country)["country"] = country
    for alias, country in vocab.COUNTRY_ALIASES.items():
        at(alias)["country"] = country
    for country, tokens in vocab.REGIONS.items():
        for token in tokens:
            at(token)["region_country"] = country
    for country, names in vocab.CITIES.items():
        for alias, city in names.items():
            at(alias).update(city=city, city_country=country)
    for alias, (country, city) in vocab.CITY_ONLY_UNDER_OVERRIDE.items():
        at(alias).update(city=city, city_country=country)
    for (alias, country), city in vocab.CITY_OVERRIDES.items():
        at(alias).setdefault("overrides", {})[country] = city
    names = ["token", "country", "region_country", "city", "city_country", "overrides", "ord"]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows.values()], GAZETTEER)


def split_offices(raw: Column) -> Column:
    """offices of one location text; a slash divides only with spaces around it."""
    return F.filter(F.transform(F.split(raw, OFFICE_BREAK), lambda p: F.trim(p)), lambda p: p != "")


def clean_segment(segment: Column) -> Column:
    """F11, on folded text."""
    bare = F.regexp_replace(segment, ZIP_TAIL, "")
    return squeeze(F.regexp_replace(bare, r"^[-–—()\s]+|[-–—()\s]+$", ""))


def _segments(lowered: Column) -> Column:
    parts = F.transform(F.split(lowered, SEGMENT_BREAK), clean_segment)
    return F.filter(parts, lambda s: ~s.rlike(NOISE))


def _without_remote(segment: Column) -> Column:
    return clean_segment(F.regexp_replace(segment, f"(?s)^(.*?)(?:{REMOTE})", "$1 "))


def _exact(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """What the dictionary knows about the segments of each text, one row per text."""
    segment = F.explode(F.concat(
        F.transform("segments", lambda s, i: F.struct(F.lit("s").alias("kind"), i.alias("pos"), s.alias("token"))),
        F.transform("bare", lambda s, i: F.struct(F.lit("r").alias("kind"), i.alias("pos"), s.alias("token"))),
        F.array(F.struct(F.lit("w").alias("kind"), F.lit(0).alias("pos"), F.col("whole").alias("token"))),
    ))
    known = texts.select("raw", segment.alias("s")).select("raw", "s.*").join(gazetteer, "token")

    def country(kind: str) -> Column:
        here = F.col("kind") == kind
        last = F.max_by("country", F.when(here & F.col("country").isNotNull(), F.col("pos")))
        first = F.min_by("region_country", F.when(here & F.col("region_country").isNotNull(), F.col("pos")))
        return F.coalesce(last, first)

    has_city = F.col("city").isNotNull()
    hit = F.when((F.col("kind") == "s") & has_city, F.struct("pos", "city", "city_country", F.map_entries("overrides").alias("overrides")))
    return known.groupBy("raw").agg(
        country("s").alias("explicit"),
        country("r").alias("remote_country"),
        F.array_sort(F.collect_list(hit)).alias("hits"),  # as many as the text has segments
        F.bool_or((F.col("kind") == "w") & has_city).alias("whole_city"),
    )


def _grams(width: int) -> Column:
    """Runs of `width` words in column `words`."""
    starts = F.when(F.size("words") >= width, F.sequence(F.lit(1), F.size("words") - (width - 1)))
    none = F.array().cast("array<int>")
    return F.transform(F.coalesce(starts, none), lambda i: F.array_join(F.slice("words", i, width), " "))


def _fuzzy(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Longest city alias that stands in the text as whole words.

    Word n-grams make it an equi-join; the pattern then checks the exact spelling.
    """
    aliases = gazetteer.filter(F.col("city").isNotNull() & (F.length("token") >= FUZZY_MIN_LENGTH)).select(
        "token", "city", "city_country", "ord", F.regexp_extract_all("token", F.lit(r"(\w+)"), 1).alias("words")
    )
    longest = aliases.agg(F.max(F.size("words"))).first()[0] or 1
    aliases = aliases.select("token", "city", "city_country", "ord", F.array_join("words", " ").alias("gram"))
    words = texts.select("raw", "lowered", F.regexp_extract_all("lowered", F.lit(r"(\w+)"), 1).alias("words"))
    grams = F.concat(*[_grams(n) for n in range(1, longest + 1)])
    candidates = words.select("raw", "lowered", F.explode(F.array_distinct(grams)).alias("gram")).join(aliases, "gram")
    stands = F.regexp_like("lowered", F.concat(F.lit(WORD_START + r"\Q"), F.col("token"), F.lit(r"\E" + WORD_END)))
    return candidates.filter(stands).groupBy("raw").agg(
        F.max_by(F.struct("city", "city_country"), F.struct(F.length("token"), -F.col("ord"))).alias("fuzzy")
    )


def resolve_places(raws: DataFrame, gazetteer: DataFrame, no_places: Sequence[str] = vocab.NO_PLACES) -> DataFrame:
    """(raw, resolved, city, country, remote) for distinct texts in column `raw`.

    Empty texts, `no_places` (lower case) and bare numbers of places name none.
    """
    trimmed = F.trim("raw")
    texts = raws.select("raw", trimmed.alias("text"), fold(trimmed).alias("folded")).withColumns({
        "garbage": F.lower("text").isin("", *no_places) | F.lower("text").rlike(f"^{COUNT_OF_PLACES}$"),
        "street": F.col("text").rlike(STREET),
        "whole": clean_segment(F.col("folded")),
        "lowered": F.regexp_replace("folded", r"^us-([a-z]{2})-(.+)$", "$2, $1"),
    })
    texts = texts.withColumn("segments", _segments(F.col("lowered")))
    texts = texts.withColumn("remote", F.exists("segments", lambda s: s.rlike(REMOTE)))
    no_text = F.array().cast("array<string>")
    bare = F.filter(F.transform("segments", _without_remote), lambda s: s != "")
    texts = texts.withColumn("bare", F.when(F.col("remote"), bare).otherwise(no_text))

    known = texts.filter(~F.col("garbage")).join(_exact(texts.filter(~F.col("garbage")), gazetteer), "raw", "left")
    explicit = F.col("explicit")

    def override(hit: Column) -> Column:
        return F.try_element_at(F.map_from_entries(hit["overrides"]), explicit)

    fits = F.filter(
        "hits",
        lambda h: explicit.isNull() | override(h).isNotNull() | (explicit == h["city_country"])
        | (F.coalesce(F.size(h["overrides"]), F.lit(0)) <= 0),
    )
    known = known.withColumn("hit", F.try_element_at(fits, F.lit(1)))
    known = known.withColumns({
        "forced": override(F.col("hit")),
        "seg_city": F.coalesce(override(F.col("hit")), F.col("hit.city")),
        "seg_country": F.coalesce(explicit, F.col("hit.city_country")),
    })
    is_street = F.col("street") & ~F.coalesce("whole_city", F.lit(False))
    empty = ~F.col("remote") & F.col("seg_city").isNull() & F.col("seg_country").isNull()
    found = known.join(_fuzzy(known.filter(is_street | empty), gazetteer), "raw", "left")

    by_fuzzy = F.col("fuzzy").isNotNull() & (is_street | empty)
    remote = F.col("remote") & ~by_fuzzy
    result = found.select(
        "raw",
        F.when(by_fuzzy, F.col("fuzzy.city")).when(~remote, F.col("seg_city")).alias("city"),
        F.when(by_fuzzy, F.col("fuzzy.city_country")).when(remote, F.col("remote_country"))
        .otherwise(F.col("seg_country")).alias("country"),
        remote.alias("remote"),
    )
    resolved = F.col("city").isNotNull() | F.col("country").isNotNull() | F.col("remote")
    nothing = texts.filter("garbage").select(
        "raw", F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("country"), F.lit(False).alias("remote")
    )
    return result.unionByName(nothing).withColumn("resolved", resolved)


def resolve_literal(spark: SparkSession, text: str, gazetteer: DataFrame) -> Place | None:
    """The place of one request value."""
    row = resolve_places(spark.createDataFrame([(text,)], "raw string"), gazetteer).first()
    return Place(row["city"], row["country"], row["remote"]) if row and row["resolved"] else None


def office_places(jobs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Resolved place per office text of each posting: (id, pos, raw, city, country, remote, resolved).

    Position 0 is the display location. Distinct texts are resolved once and joined back salted,
    since one text ("remote") may stand in a large part of all rows.
    """
    texts = F.concat(F.array(F.col("location")), F.coalesce("locations", F.array().cast("array<string>")))
    offices = jobs.select("id", F.posexplode(texts).alias("pos", "raw")).filter(F.col("raw").isNotNull())
    sizes = offices.groupBy("raw").agg(F.count("*").alias("_n"))
    resolved = resolve_places(sizes.select("raw"), gazetteer).join(sizes, "raw")
    return salted_join(offices, resolved, ["raw"], "_n", ["id", "pos"]).drop("_n")


def derive_location(jobs: DataFrame, placed: DataFrame) -> DataFrame:
    """display text, city, country and remote flag of each posting."""
    first = F.max(F.when(F.col("pos") == 0, F.struct("city", "country", "remote")))
    per_job = placed.groupBy("id").agg(first.alias("place"), F.bool_or("remote").alias("any_remote"))
    place = F.col("place")
    return jobs.join(per_job, "id", "left").withColumns({
        "location": place_text(place["city"], place["country"], F.coalesce(place["remote"], F.lit(False))),
        "city": F.when(~place["remote"], place["city"]),
        "country": place["country"],
        "is_remote": F.coalesce("is_remote", F.lit(False)) | F.coalesce("any_remote", F.lit(False)),
    }).drop("place", "any_remote")


def location_facets(placed: DataFrame) -> DataFrame:
    """Distinct (job_id, city, country); country-only and remote places have an empty city."""
    city = F.when(F.col("remote"), F.lit("")).otherwise(F.coalesce("city", F.lit("")))
    return (
        placed.filter(F.col("country").isNotNull())
        .select(F.col("id").alias("job_id"), city.alias("city"), "country").distinct()
    )
