"""Windowed roll-ups of requests and crawls, in batch and in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_metrics(rows: DataFrame, by: list[str], width: str) -> DataFrame:
    """Count, mean and 95th percentile of `duration_ms` per window and group.

    The percentile is exact: it keeps one counter per distinct duration, whole milliseconds.
    """
    return (
        rows.groupBy(F.window("ts", width), *by)
        .agg(
            F.count("*").alias("n"),
            F.avg("duration_ms").alias("mean_ms"),
            F.percentile("duration_ms", F.lit(0.95)).alias("p95_ms"),
        )
        .select(F.col("window.start").alias("start"), *by, "n", "mean_ms", "p95_ms")
    )


def request_metrics_stream(rows: DataFrame, by: list[str], width: str, lateness: str) -> DataFrame:
    """The same over a stream; a window closes once the watermark has passed it."""
    return request_metrics(rows.withWatermark("ts", lateness), by, width)


def duration_sketches(rows: DataFrame, by: list[str], width: str) -> DataFrame:
    """T12 with bounded state: per window and group the count and a KLL sketch of `duration_ms`, which can be merged."""
    grouped = rows.groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint("duration_ms").alias("sketch"))
    return grouped.select(F.col("window.start").alias("start"), *by, "n", "sketch")


def merged_quantiles(sketches: DataFrame, unit: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Quantiles over longer stretches from the windows' sketches; their rank is off by RANK_ERROR at most, usually by less."""
    rows = sketches.groupBy(F.date_trunc(unit, "start").alias("start"), *by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return rows.select("start", *by, "n", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(share)).alias(name) for name, share in shares.items()])


RANK_ERROR = 0.02


def live_rows(rows: DataFrame, days: int) -> DataFrame:
    """First row per id in a stream; an id that comes again after its row has expired is live anew."""
    return rows.withWatermark("posted_at", f"{days} days").dropDuplicatesWithinWatermark(["id"])
