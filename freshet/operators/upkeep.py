"""Clean-up jobs: expiry, cross-source and exact duplicates, orphans, back-fills, role collapse."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.scalars import is_fresh
from freshet.operators.skew import grouped_rank, salted_join


def stale_ids(postings: DataFrame, cutoff: datetime) -> DataFrame:
    """K4: ids older than the cutoff."""
    return postings.filter(F.col("posted_at") < F.lit(cutoff)).select("id", "posted_at")


def bounded_round(doomed: DataFrame, order: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first `most` ids, and a row with how many were taken and how many are left.

    For a caller that can only delete so many at once; the clean-up jobs take all of `doomed`.
    """
    taken = doomed.orderBy(*order).limit(most)
    counts = doomed.agg(
        F.least(F.count("*"), F.lit(most)).alias("taken"),
        F.greatest(F.count("*") - most, F.lit(0)).alias("deferred"),
    )
    return taken, counts


def without_stale(postings: DataFrame, cutoff: datetime) -> DataFrame:
    """K4: the table after expiry; a row without a date stays."""
    at = F.col("posted_at")
    return postings.filter(at.isNull() | (at >= F.lit(cutoff)))


def cross_source_duplicates(rows: DataFrame, keys: dict[str, Column], order: Sequence[str], source: str) -> DataFrame:
    """Rows to delete where one role is listed by several sources.

    The earliest row of a group stays. A group is reduced to its first row and its lowest and
    highest source before the shuffle, so no task ever holds a whole group; the rows then meet
    their group through a salted join.
    """
    keyed = rows.withColumns(keys)
    names = list(keys)
    groups = keyed.groupBy(*names).agg(
        F.min(F.struct(*order)).alias("_first"),
        F.min(source).alias("_lo"),
        F.max(source).alias("_hi"),
        F.count("*").alias("_n"),
    ).filter(F.col("_lo") != F.col("_hi"))
    met = salted_join(keyed, groups, names, "_n", [order[-1]])
    return met.filter(F.struct(*order) != F.col("_first")).select(*rows.columns)


def duplicate_postings(postings: DataFrame, cutoff: datetime) -> DataFrame:
    """K5: fresh postings with a city and a country, keyed by company, title and city."""
    rows = postings.filter(is_fresh(F.col("posted_at"), cutoff) & F.col("city").isNotNull() & F.col("country").isNotNull())
    keys = {"_company": F.col("company"), "_title": F.lower("title"), "_city": F.col("city")}
    return cross_source_duplicates(rows, keys, ["posted_at", "source", "id"], "source")


def exact_facets(facets: DataFrame) -> DataFrame:
    """A14."""
    return facets.dropDuplicates(["job_id", "city", "country"])


def orphan_facets(facets: DataFrame, postings: DataFrame) -> DataFrame:
    """Facet rows whose posting is gone."""
    return facets.join(postings.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def collapse_roles(rows: DataFrame, key: Column, shown: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Newest row per role and the number of openings, combined before the shuffle."""
    return (
        rows.select(key.alias("key"), F.struct(*shown).alias("row"), F.struct(*newest).alias("at"))
        .groupBy("key")
        .agg(F.max_by("row", "at").alias("row"), F.count("*").alias("openings"))
        .select("key", "openings", "row.*")
    )


def list_positions(postings: DataFrame) -> DataFrame:
    """1-based position in a company's newest-first list."""
    return grouped_rank(postings, ["company"], [F.desc("posted_at"), F.desc("id")], "position", ["id"])


# Fixed value: the one country that older rows spell in two ways.
COUNTRY_MERGES = {"korea": "south korea"}


def _merged_country(country: Column) -> Column:
    result = F.lower(country)
    for old, new in COUNTRY_MERGES.items():
        result = F.when(result == old, F.lit(new)).otherwise(result)
    return result


def normalise_stored(postings: DataFrame) -> DataFrame:
    """lower-case the filter columns, merge country spellings, repair the remote flag."""
    return postings.withColumns({
        "company": F.lower("company"),
        "location": F.lower("location"),
        "city": F.lower("city"),
        "country": _merged_country(F.col("country")),
        "is_remote": F.col("is_remote") | (F.lower("location") == "remote"),
    })


def normalise_facets(facets: DataFrame) -> DataFrame:
    return exact_facets(facets.withColumns({"city": F.lower("city"), "country": _merged_country(F.col("country"))}))
