"""Counts that follow changes: rows that go and rows that come alter multiplicities, nothing is counted anew."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Counted:
    """A kept table of counts over the rows of `source`, a table with the ids of postings in `key`.

    `units` turns rows of any set of postings into one row of `keys` for each that is to be counted; all
    rows of a posting come together, so a posting can count once for several rows.
    """

    source: str
    key: str
    keys: Sequence[str]
    units: Callable[[DataFrame], DataFrame]

    def schema(self) -> str:
        return ", ".join(f"{k} string" for k in self.keys) + ", count bigint"

    def of(self, rows: DataFrame) -> DataFrame:
        """A first count of all rows."""
        return self.units(rows).groupBy(*self.keys).agg(F.count("*").alias("count"))


def place_units(rows: DataFrame) -> DataFrame:
    """A2/A3: a posting counts once in each of its cities, and once (city null) in each of its countries."""
    cities = rows.filter(F.col("city") != "").select("job_id", "country", "city")
    countries = rows.select("job_id", "country", F.lit(None).cast("string").alias("city"))
    return cities.unionByName(countries).distinct().select("country", "city")


def value_units(column: str) -> Callable[[DataFrame], DataFrame]:
    """A1: a posting counts for its value, unless that is empty."""
    return lambda rows: rows.filter(F.col(column) != "").select(column)


def deltas(counted: Counted, gone: DataFrame, come: DataFrame) -> DataFrame:
    """How much each count changes when the rows `gone` are replaced by the rows `come`."""
    signed = [counted.units(rows).groupBy(*counted.keys).agg((sign * F.count("*")).alias("count")) for rows, sign in ((gone, -1), (come, 1))]
    return reduce(DataFrame.unionByName, signed)


def applied(counts: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The counts after the changes; what comes to nothing goes."""
    both = counts.unionByName(changes).groupBy(*keys).agg(F.sum("count").alias("count"))
    return both.filter("count <> 0")


def expired(rows: DataFrame, before, after) -> DataFrame:
    """Postings that a cutoff moved from `before` to `after` leaves behind: one stretch of dates."""
    return rows.filter((F.col("posted_at") >= F.lit(before)) & (F.col("posted_at") < F.lit(after)))
