"""Append-only run metrics (index, blobs, doubles), one Parquet row per point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _point(df: DataFrame, index: str, blobs: list, doubles: list) -> DataFrame:
    return df.select(
        F.lit(index).alias("index"),
        F.array(*blobs).cast("array<string>").alias("blobs"),
        F.array(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in doubles]).alias("doubles"),
    )


def crawl_points(runs: DataFrame) -> DataFrame:
    """One point per run roll-up; two slots stay empty so that positions hold."""
    outcome = F.when(F.col("failed") > 0, "partial").otherwise("ok")
    blobs = [F.concat(F.lit("sweep_"), F.col("sweep").cast("string")), outcome]
    empty = F.lit(0)
    return _point(runs, "crawl_tick", blobs, ["duration_ms", "boards", "ok", "failed", "discovered", empty, empty, "skipped"])


def cleanup_points(counts: DataFrame) -> DataFrame:
    return _point(counts, "crawl_cleanup", [], ["removed", "deduped"])


def request_points(requests: DataFrame) -> DataFrame:
    return _point(requests, "api_request", [F.col("path"), F.col("status").cast("string")], ["duration_ms"])


def append(points: DataFrame, path: str) -> None:
    points.write.mode("append").partitionBy("index").parquet(path)
