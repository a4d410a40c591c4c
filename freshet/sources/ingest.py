"""Landed payloads to stored postings and location facets."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import vocab
from freshet.functions.classify import department_of_title, level_of, map_department
from freshet.functions.scalars import freshness_cutoff, is_fresh, is_http_url
from freshet.functions.text import sanitize
from freshet.operators.listing import to_stored
from freshet.operators.places import derive_location, location_facets, office_places
from freshet.operators.skew import salted_join
from freshet.session import cut


@dataclass(frozen=True)
class Ingested:
    postings: DataFrame
    facets: DataFrame
    unmapped: DataFrame
    rejected_urls: DataFrame


def last_per_id(postings: DataFrame) -> DataFrame:
    """The last of several postings with one id, by page and position."""
    row = F.struct(*[c for c in postings.columns if c != "id"])
    return postings.groupBy("id").agg(F.max_by(row, F.struct("page", "pos")).alias("row")).select("id", "row.*")


def label_companies(postings: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry label, else the board name, as the company."""
    labels = registry.select(F.col("provider"), F.col("name").alias("_board"), "label")
    sizes = postings.groupBy("provider", F.col("board").alias("_board")).agg(F.count("*").alias("_n"))
    named = sizes.join(labels, ["provider", "_board"], "left")
    rows = postings.withColumn("_board", F.col("board"))
    return (
        salted_join(rows, named, ["provider", "_board"], "_n", ["id"])
        .withColumn("company", F.coalesce(F.when(F.col("label") != "", F.col("label")), "board"))
        .drop("_board", "_n", "label")
    )


def rejected_urls(postings: DataFrame) -> DataFrame:
    """A12."""
    bad = F.count_if(~is_http_url(F.col("url")))
    return postings.groupBy("company").agg(bad.alias("rejected")).filter("rejected > 0")


def unmapped_report(names: DataFrame, group: str, sample: int = vocab.UNMAPPED_SAMPLE) -> DataFrame:
    """A10: distinct unknown names per group with the first few of them.

    `names` has `group` and `name`. The sample is taken by a top-k window over distinct names, whose
    partial top-k runs before the shuffle; the list itself has at most `sample` entries.
    """
    distinct = names.select(group, "name").distinct()
    counts = distinct.groupBy(group).agg(F.count("*").alias("distinct_names"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("name"))
    top = distinct.withColumn("_place", place).filter(F.col("_place") <= sample)
    shown = top.groupBy(group).agg(F.array_sort(F.collect_list("name")).alias("sample"))
    return counts.join(shown, group)


def ingest(
    raw: DataFrame, registry: DataFrame, gazetteer: DataFrame, departments: DataFrame, as_of: datetime,
    days: int = vocab.FRESHNESS_DAYS,
) -> Ingested:
    """P10, P11, F2, F5, F9, F14, U1 over the postings that the feed readers return."""
    # Parsing JSON is the costly part and several outputs come from the same rows.
    labelled = label_companies(cut(last_per_id(raw).drop("page", "pos")), registry)
    cutoff = freshness_cutoff(as_of, days)
    kept = cut(labelled.filter(is_http_url(F.col("url")) & is_fresh(F.col("posted_at"), cutoff)))
    hints = kept.select("id", F.concat(F.array("department"), "hints").alias("hints"))
    mapped = map_department(hints, "hints", "id", departments)
    placed = office_places(kept, gazetteer)
    postings = (
        derive_location(kept, placed)
        .drop("department", "hints")
        .join(mapped, "id")
        .withColumns({
            "company": sanitize(F.col("company")),
            "level": level_of(F.col("title")),
            "department": F.coalesce("department", department_of_title(F.col("title"))),
            "created_at": F.lit(as_of),
        })
    )
    names = postings.select("company", F.explode("unmapped").alias("name"))
    return Ingested(to_stored(postings.drop("unmapped")), location_facets(placed), unmapped_report(names, "company"), rejected_urls(labelled))
