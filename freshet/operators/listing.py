"""Search requests, filters, ordering and paging over the postings table."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import vocab
from freshet.functions.scalars import freshness_cutoff, is_fresh, is_http_url
from freshet.functions.text import escape_like, sanitize_literal


class RequestError(ValueError):
    """A request that the strict reader turns down."""


@dataclass(frozen=True)
class SearchRequest:
    q: str = ""
    company: str = ""
    location: str = ""
    city: str = ""
    country: str = ""
    posted: str = ""
    department: str = ""
    level: str = ""
    sort: str = ""
    limit: int = vocab.PAGE_LIMIT
    offset: int = 0


@dataclass(frozen=True)
class Place:
    city: str | None = None
    country: str | None = None
    remote: bool = False


TEXT_FIELDS = tuple(f.name for f in fields(SearchRequest) if f.type == "str")
LENIENT_FIELDS = ("q", "company", "location", "level", "department", "sort")


def _max_length(name: str) -> int:
    return vocab.QUERY_LENGTH_MAX if name == "q" else vocab.FILTER_LENGTH_MAX


def _leading_int(raw: str | None) -> int | None:
    found = re.match(r"\s*([+-]?\d+)", raw or "")
    return int(found.group(1)) if found else None


def read_request(params: Mapping[str, str]) -> SearchRequest:
    """Strict reading, one bad value fails the request."""
    values = {name: (params.get(name) or "").strip() for name in TEXT_FIELDS}
    for name, value in values.items():
        if len(value) > _max_length(name):
            raise RequestError("param_too_long")
    if values["posted"] and values["posted"] not in vocab.POSTED_WINDOWS:
        raise RequestError("invalid_posted")
    limit, offset = _leading_int(params.get("limit")), _leading_int(params.get("offset"))
    if (offset or 0) > vocab.OFFSET_MAX:
        raise RequestError("offset_too_large")
    return clamp_page(SearchRequest(
        **values,
        limit=vocab.PAGE_LIMIT if limit is None else limit,
        offset=offset or 0,
    ))


def read_lenient(params: Mapping[str, str]) -> SearchRequest:
    """Each bad value is dropped alone."""
    kept = {}
    for name in LENIENT_FIELDS:
        value = (params.get(name) or "").strip()
        known = {"level": vocab.LEVELS, "sort": vocab.SORTS}.get(name)
        if value and len(value) <= _max_length(name) and (known is None or value in known):
            kept[name] = value
    return SearchRequest(**kept)


def clamp_page(request: SearchRequest) -> SearchRequest:
    """O4."""
    return replace(request, limit=min(max(request.limit, 1), vocab.PAGE_LIMIT_MAX), offset=max(request.offset, 0))


def more_pages(page_size: int, limit: int, offset: int, total: int | None) -> bool:
    """Whether another page is worth asking for."""
    following = offset + page_size
    return page_size >= limit and following <= vocab.OFFSET_MAX and (total is None or following < total)


def id_prefix(prefix: str, column: str = "id") -> Column:
    """Ids of one board, as a range that Parquet statistics can prune on.

    The upper bound swaps the closing dash for the next character, so a longer sibling name
    is left out.
    """
    return (F.col(column) >= prefix) & (F.col(column) < prefix[:-1] + ".")


def board_postings(postings: DataFrame, prefix: str, cutoff: datetime) -> DataFrame:
    """The fresh stored rows of one board."""
    return postings.filter(id_prefix(prefix) & is_fresh(F.col("posted_at"), cutoff))


def text_contains(column: str, raw: str) -> Column:
    """Case-insensitive substring with literal wildcards."""
    return F.col(column).ilike(f"%{escape_like(raw)}%")


def with_facet(postings: DataFrame, facets: DataFrame, city: str | None, country: str | None) -> DataFrame:
    """Postings that have a facet row for the city and/or country."""
    wanted = facets
    if city:
        wanted = wanted.filter(F.col("city") == city.lower())
    if country:
        wanted = wanted.filter(F.col("country") == country.lower())
    return postings.join(wanted.select(F.col("job_id").alias("id")), "id", "left_semi")


def conditions(request: SearchRequest, as_of: datetime, days: int) -> Column:
    """The row conditions of a request; an empty filter adds none."""
    posted_at = F.col("posted_at")
    parts = [is_fresh(posted_at, freshness_cutoff(as_of, days)), is_http_url(F.col("url"))]
    for column in ("company", "department", "level"):
        value = getattr(request, column)
        if value:
            parts.append(F.col(column) == sanitize_literal(value))
    window = vocab.POSTED_WINDOWS.get(request.posted)
    if window:
        length = timedelta(days=int(window.split()[0]))
        parts.append(posted_at >= F.lit(as_of - length))  # from the exact time, not the hour
    return reduce(lambda a, b: a & b, parts)


def filter_postings(
    postings: DataFrame,
    facets: DataFrame,
    request: SearchRequest,
    as_of: datetime,
    days: int = vocab.FRESHNESS_DAYS,
    place: Place | None = None,
) -> DataFrame:
    """Every filter but the text query. `place` is the resolved `request.location`."""
    rows = postings.filter(conditions(request, as_of, days))
    if request.location:
        if place and place.remote:
            rows = rows.filter("is_remote")
        elif place and (place.city or place.country):
            rows = with_facet(rows, facets, place.city, place.country)
        else:
            rows = rows.filter(text_contains("location", request.location))
    if request.city or request.country:
        rows = with_facet(rows, facets, request.city, request.country)
    return rows


def newest_order() -> list[Column]:
    return [F.desc("posted_at"), F.desc("id")]


def list_order(sort: str) -> list[Column]:
    """O1/O2: any unknown sort means newest first."""
    return [F.asc("company"), *newest_order()] if sort == "company" else newest_order()


def page(rows: DataFrame, order: list[Column], request: SearchRequest) -> DataFrame:
    """One page; offset + limit is at most 10,500 rows, taken as a distributed top-k."""
    request = clamp_page(request)
    return rows.orderBy(*order).offset(request.offset).limit(request.limit)


def page_after(rows: DataFrame, posted_at: datetime, last_id: str, limit: int) -> DataFrame:
    """Keyset form of O1: the page after a known last row, at any depth."""
    at = F.col("posted_at")
    later = (at < F.lit(posted_at)) | ((at == F.lit(posted_at)) & (F.col("id") < last_id))
    return rows.filter(later).orderBy(*newest_order()).limit(limit)


def total(rows: DataFrame) -> DataFrame:
    """A5."""
    return rows.agg(F.count("*").alias("total"))


def newest(postings: DataFrame, cutoff: datetime, limit: int) -> DataFrame:
    """O6."""
    fresh = postings.filter(is_fresh(F.col("posted_at"), cutoff) & is_http_url(F.col("url")))
    return fresh.orderBy(*newest_order()).limit(limit)


def company_postings(postings: DataFrame, company: str, cutoff: datetime) -> DataFrame:
    """O7."""
    own = postings.filter((F.col("company") == company) & is_fresh(F.col("posted_at"), cutoff))
    return own.filter(is_http_url(F.col("url"))).orderBy(*newest_order())


def stored_locations(raw: Column, fallback: Column) -> Column:
    """JSON text to a list of strings; anything but an array gives the display location."""
    listed = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    strings = F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(strings, lambda v: v.cast("string")), F.array(fallback))


def to_stored(jobs: DataFrame) -> DataFrame:
    """Defaults of a stored row."""
    return jobs.withColumns({
        "department": F.trim("department"),
        "salary": F.coalesce("salary", F.lit("")),
        "locations": F.coalesce("locations", F.array("location")),
        "is_remote": F.coalesce("is_remote", F.lit(False)),
    })
