"""Text and JSON exports of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.text import to_slug, xml_escape


def feed_items(recent: DataFrame) -> DataFrame:
    """One RSS item per row; the channel frame around the rows is fixed text."""
    link = xml_escape(F.col("url"))
    when = F.concat(F.date_format("posted_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    item = F.concat_ws(
        "\n",
        F.lit("<item>"),
        F.concat(F.lit("<title>"), xml_escape(F.concat_ws(" at ", "title", "company")), F.lit("</title>")),
        F.concat(F.lit("<link>"), link, F.lit("</link>")),
        F.concat(F.lit('<guid isPermaLink="true">'), link, F.lit("</guid>")),
        F.concat(F.lit("<pubDate>"), when, F.lit("</pubDate>")),
        F.concat(F.lit("<description>"), xml_escape(F.concat_ws(" · ", "company", "location")), F.lit("</description>")),
        F.lit("</item>"),
    )
    return recent.select("id", item.alias("item"))


def link_line() -> Column:
    """A markdown bullet; an empty location leaves no suffix."""
    place = F.when(F.coalesce(F.col("location"), F.lit("")) != "", F.concat(F.lit(" - "), F.col("location")))
    return F.concat(
        F.lit("- ["), F.col("title"), F.lit(" at "), F.col("company"), F.lit("]("), F.col("url"), F.lit(")"),
        F.coalesce(place, F.lit("")),
    )


def link_lines(recent: DataFrame) -> DataFrame:
    return recent.select("id", link_line().alias("line"))


def sitemap(index: DataFrame, site: str) -> DataFrame:
    """The site with the newest date, then one row per company."""
    top = index.agg(F.max("last_posted_at").alias("last_modified")).select(
        F.lit(site).alias("url"), "last_modified", F.lit("hourly").alias("frequency"), F.lit(1.0).alias("priority")
    )
    pages = index.select(
        F.concat(F.lit(f"{site}/company/"), to_slug(F.col("name"))).alias("url"),
        F.col("last_posted_at").alias("last_modified"), F.lit("daily").alias("frequency"), F.lit(0.7).alias("priority"),
    )
    return top.unionByName(pages)


def public_json(rows: DataFrame) -> DataFrame:
    """Public columns as JSON; an empty salary is left out."""
    shown = F.struct(
        "id", "title", "company", "location", "url", "source",
        F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("postedAt"),
        F.when(F.col("salary") != "", F.col("salary")).alias("salary"),
    )
    return rows.select("id", F.to_json(shown).alias("json"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)
