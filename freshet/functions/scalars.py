"""Dates, links, salary text and the other per-row rules."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet.functions import vocab


def freshness_days(raw: object, default: int = vocab.FRESHNESS_DAYS) -> int:
    """Whole days inside the accepted range; anything else is ignored."""
    try:
        days = float(raw)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    low, high = vocab.FRESHNESS_DAYS_RANGE
    return math.floor(days) if math.isfinite(days) and low <= days <= high else default


def freshness_cutoff(as_of: datetime, days: int = vocab.FRESHNESS_DAYS) -> datetime:
    """Start of the hour of `as_of`, `days` back."""
    return as_of.replace(minute=0, second=0, microsecond=0) - timedelta(days=days)


def is_fresh(posted_at: Column, cutoff: datetime) -> Column:
    """Null dates drop out."""
    return posted_at >= F.lit(cutoff)


# A scheme, optional user and port, and a host of any characters that a browser accepts in one.
HTTP_URL = r"(?i)^https?://(?:[^\s/?#@]*@)?(?:[^\s/?#@:<>^|%\\\[\]]+|\[[0-9a-f:.]+\])(?::[0-9]*)?(?:[/?#\\]|$)"


def is_http_url(url: Column) -> Column:
    """P10: absolute http(s) link: scheme and host, whatever stands in path, query and fragment."""
    return F.coalesce(F.trim(url).rlike(HTTP_URL), F.lit(False))


def age_seconds(posted_at: Column, as_of: Column) -> Column:
    return F.greatest(F.unix_seconds(as_of) - F.unix_seconds(posted_at), F.lit(0))


def age_bucket(posted_at: Column, as_of: Column) -> Column:
    """now / minutes / hours / days."""
    age = age_seconds(posted_at, as_of)

    def whole(unit: int, suffix: str) -> Column:
        return F.concat(F.floor(age / unit).cast("string"), F.lit(suffix))

    return (
        F.when(age < 60, F.lit("now")).when(age < 3600, whole(60, "m")).when(age < 86400, whole(3600, "h"))
        .otherwise(whole(86400, "d"))
    )


def posted_today(posted_at: Column, as_of: Column) -> Column:
    return age_seconds(posted_at, as_of) < 86400


def _amount(value: Column) -> Column:
    return F.format_number(F.floor(value + 0.5), 0)


def salary_range(low: Column, high: Column, currency: Column) -> Column:
    """two amounts with the currency's sign, or its code where no sign is known; without a code of
    three letters bare numbers. Equal amounts are printed once, as an approximate one."""
    signs = F.create_map(*[F.lit(x) for pair in vocab.CURRENCY_SYMBOLS.items() for x in pair])
    code = F.when(currency.rlike("^[A-Za-z]{3}$"), F.concat(F.upper(currency), F.lit("\u00a0")))
    sign = F.coalesce(F.try_element_at(signs, F.upper(currency)), code, F.lit(""))
    least, most = F.concat(sign, _amount(low)), F.concat(sign, _amount(high))
    both = F.when((least == most) & (sign != ""), F.concat(F.lit("~"), least)).otherwise(F.concat(least, F.lit(" – "), most))
    return F.when(low.isNotNull() & high.isNotNull(), both)


ISO_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
)


def parse_date(text: Column) -> Column:
    """ISO text with or without a time; null when it is neither."""
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in ISO_FORMATS])


def remap_level(old: Column) -> Column:
    """the finer, older vocabulary to the five levels."""
    result = F.lit("mid")
    for level, names in vocab.OLD_LEVELS.items():
        result = F.when(old.isin(*names), F.lit(level)).otherwise(result)
    return result


def place_text(city: Column, country: Column, remote: Column) -> Column:
    """display text of a resolved place."""
    return (
        F.when(remote, F.concat_ws(", ", F.lit("remote"), country))
        .when(city.isNotNull() | country.isNotNull(), F.concat_ws(", ", city, country))
        .otherwise(F.lit("unknown"))
    )
