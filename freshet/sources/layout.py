"""Tables laid out for how they are read: bucketed by id for keyed joins, clustered for ranges of two columns.

`bucketed` writes a table whose rows of an id lie in one of a fixed number of buckets, sorted by it; a join
on the id then moves only the other side. `clustered` orders rows along a Z-curve over the ranks of two
columns, so every file covers a small stretch of both, and keeps the least and greatest value of either
in one row per file; a read opens only the files whose stretches meet its bounds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.session import cut, shared_dir, shuffle_width

RANK_BITS = 5  # ranks of each column along the curve: 2 ** RANK_BITS ranges


def bucketed(df: DataFrame, column: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write `df` in buckets by `column` and read it back; the table is known to this application's catalog."""
    spark = df.sparkSession
    name = f"freshet_{uuid.uuid4().hex}"
    path = path or f"{shared_dir(spark)}/freshet-bucketed/{name}"
    df.write.bucketBy(buckets, column).sortBy(column).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def curve(first: Column, second: Column) -> Column:
    """Place on the Z-curve: the bits of two ranks in turn."""
    out = F.lit(0)
    for bit in range(RANK_BITS):
        for side, rank in enumerate((second, first)):
            out = out + F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)), 2 * bit + side)
    return out


def _ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rank of a column's range among 2 ** RANK_BITS about equal ones, by Spark's range partitions."""
    return df.repartitionByRange(1 << RANK_BITS, column).withColumn(name, F.spark_partition_id())


class Clustered:
    """A table clustered on two columns; `files` has a row per file: path and the bounds of both."""

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, str]) -> None:
        self.spark, self.path, self.columns = spark, path, columns

    @classmethod
    def write(cls, df: DataFrame, columns: tuple[str, str], files: int | None = None, path: str | None = None) -> Clustered:
        spark = df.sparkSession
        path = path or f"{shared_dir(spark)}/freshet-clustered/{uuid.uuid4().hex}"
        ranked = cut(_ranked(cut(_ranked(df, columns[0], "_first")), columns[1], "_second"))
        placed = ranked.withColumn("_curve", curve(F.col("_first"), F.col("_second"))).drop("_first", "_second")
        # Files are cut along the curve alone, so that none reaches from one end of it to the other.
        width = files or 4 * shuffle_width(spark)
        placed.repartitionByRange(width, "_curve", *columns).sortWithinPartitions(*columns).drop("_curve").write.parquet(f"{path}/rows")
        bounds = [f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("least", F.min), ("greatest", F.max))]
        rows = spark.read.parquet(f"{path}/rows")
        rows.groupBy(F.input_file_name().alias("file")).agg(*bounds).coalesce(1).write.parquet(f"{path}/files")
        return cls(spark, path, columns)

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files")

    def opened(self, first: tuple | None = None, second: tuple | None = None) -> list[str]:
        """Files that may hold rows with `least <= column < end`, either of which may be None; a name per file to be read."""
        keep = F.lit(True)
        for i, bounds in enumerate((first, second)):
            least, end = bounds or (None, None)
            if least is not None:
                keep = keep & (F.col(f"greatest_{i}") >= F.lit(least))
            if end is not None:
                keep = keep & (F.col(f"least_{i}") < F.lit(end))
        return sorted(r["file"] for r in self.files().filter(keep).select("file").collect())

    def read(self, first: tuple | None = None, second: tuple | None = None) -> DataFrame:
        """The rows within the bounds, from the files that may hold them."""
        whole = self.spark.read.parquet(f"{self.path}/rows")
        files = self.opened(first, second)
        rows = self.spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
        for column, bounds in zip(self.columns, (first, second)):
            least, end = bounds or (None, None)
            if least is not None:
                rows = rows.filter(F.col(column) >= F.lit(least))
            if end is not None:
                rows = rows.filter(F.col(column) < F.lit(end))
        return rows
