"""Bucketed and clustered tables: what a join moves and what a read opens."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from freshet.operators import cdc
from freshet.plans import changes
from freshet.sources.layout import Clustered, bucketed


def test_a_diff_moves_only_the_snapshot(spark, sf):
    stored = changes.stored_rows(spark, sf)
    table = bucketed(stored.drop("num"), "id", 8)
    fetched = changes.cut(changes.edited(stored))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = cdc.diff(table, fetched)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    stored_side = plan[plan.index("SortMergeJoin"):].split("Exchange")[0]
    assert "freshet_" in stored_side  # the stored table is read under the join without an exchange


def test_a_board_s_fresh_rows_open_few_files(spark):
    start = datetime(2024, 1, 1)
    rows = spark.range(40_000).select(
        F.format_string("b%02d-%06d", F.col("id") % 40, F.col("id")).alias("id"),
        (F.lit(start) + F.make_dt_interval(F.floor(F.rand(3) * 300).cast("int"))).cast("timestamp").alias("posted_at"),
    )
    kept = Clustered.write(rows, ("id", "posted_at"), files=128)
    bounds = ("b07-", "b07."), (start + timedelta(days=285), None)
    files, opened = kept.files().count(), kept.opened(*bounds)
    assert files >= 100 and 0 < len(opened) < files / 10
    whole = spark.read.parquet(f"{kept.path}/rows")
    expected = whole.filter((F.col("id") >= "b07-") & (F.col("id") < "b07.") & (F.col("posted_at") >= F.lit(bounds[1][0])))
    assert {tuple(r) for r in kept.read(*bounds).collect()} == {tuple(r) for r in expected.collect()} and expected.count() > 0
    assert whole.count() == 40_000 and kept.read().count() == 40_000
    assert kept.read(("zzz", None)).count() == 0


def test_null_values_and_an_empty_table(spark):
    rows = spark.createDataFrame([("a", None), (None, datetime(2024, 1, 1)), ("b", datetime(2024, 1, 2))], "id string, posted_at timestamp")
    kept = Clustered.write(rows, ("id", "posted_at"))
    assert kept.read().count() == 3 and kept.read(("a", None)).count() == 2
    assert Clustered.write(rows.limit(0), ("id", "posted_at")).read(("a", None)).count() == 0
