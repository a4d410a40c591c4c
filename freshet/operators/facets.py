"""Counts behind the filter options, and the company index."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.scalars import is_fresh


def fresh(postings: DataFrame, cutoff: datetime) -> DataFrame:
    return postings.filter(is_fresh(F.col("posted_at"), cutoff))


def value_counts(postings: DataFrame, column: str, cutoff: datetime) -> DataFrame:
    """A1: postings per non-empty value. Ids are unique, so a plain count combines map-side."""
    rows = fresh(postings, cutoff).filter(F.col(column) != "")
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).orderBy("value")


def fresh_facets(facets: DataFrame, postings: DataFrame, cutoff: datetime) -> DataFrame:
    """Location rows of fresh postings, once per (posting, city, country)."""
    ids = fresh(postings, cutoff).select(F.col("id").alias("job_id"))
    return facets.join(ids, "job_id")


def place_counts(located: DataFrame) -> DataFrame:
    """(country, city, count) of postings: a row per city, and one with a null city per country.

    One pass over the join. A posting's cities in a country are gathered first, so that it counts once
    for the country; location rows are unique, so a city's rows are its postings.
    """
    per_posting = located.groupBy("job_id", "country").agg(F.collect_set(F.when(F.col("city") != "", F.col("city"))).alias("cities"))
    none = F.lit(None).cast("string")
    each = per_posting.select("country", F.explode(F.concat(F.array(none), "cities")).alias("city"))
    return each.groupBy("country", "city").agg(F.count("*").alias("count"))


def country_counts(located: DataFrame) -> DataFrame:
    """A2: a posting with several offices in a country counts once there."""
    once = located.select("job_id", "country").distinct()
    return once.groupBy("country").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "country")


def city_counts(located: DataFrame) -> DataFrame:
    """A3: location rows are unique per posting, city and country, so a plain count combines map-side."""
    rows = located.filter(F.col("city") != "")
    return rows.groupBy("country", "city").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "country", "city")


def facet_tree(located: DataFrame) -> DataFrame:
    """Countries with their cities nested, both by count.

    Only aggregated rows are nested: one per city that the gazetteer can name.
    """
    of_city = F.when(F.col("city").isNotNull(), F.struct((-F.col("count")).alias("rank"), "city", "count"))
    nested = F.transform(F.array_sort(F.collect_list(of_city)), lambda c: F.struct(c["city"].alias("value"), c["count"].alias("count")))
    return (
        place_counts(located).groupBy(F.col("country").alias("value"))
        .agg(F.max(F.when(F.col("city").isNull(), F.col("count"))).alias("count"), nested.alias("cities"))
        .orderBy(F.desc("count"), "value")
    )


def location_options(located: DataFrame) -> DataFrame:
    """U2/O9: "remote", then countries by count, then "city, country" by count."""
    spark = located.sparkSession
    remote = spark.range(1).select(F.lit(0).alias("section"), F.lit("remote").alias("value"), F.lit(0).cast("long").alias("count"))
    counted = place_counts(located).select(
        F.when(F.col("city").isNull(), 1).otherwise(2).alias("section"), F.concat_ws(", ", "city", "country").alias("value"), "count"
    )
    return remote.unionByName(counted).orderBy("section", F.desc("count"), "value")


def company_index(postings: DataFrame, cutoff: datetime) -> DataFrame:
    """A4."""
    rows = fresh(postings, cutoff).filter(F.col("company") != "")
    return rows.groupBy(F.col("company").alias("name")).agg(F.max("posted_at").alias("last_posted_at")).orderBy("name")


def newest_date(index: DataFrame) -> DataFrame:
    """A13."""
    return index.agg(F.max("last_posted_at").alias("last_posted_at"))
