"""Counts that follow changes against a full recount, and what their plan reads."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from freshet.operators import counting, facets

PLACES = counting.Counted("places", "job_id", ("country", "city"), counting.place_units)
SCHEMA = "job_id string, city string, country string"


def offices(pick, ids):
    return [(i, pick.choice(["", "a", "b", "c"]), pick.choice(["x", "y"])) for i in ids for _ in range(pick.randint(0, 3))]


def test_same_as_a_recount(spark):
    pick = random.Random(4)
    rows = offices(pick, [f"j{i}" for i in range(80)])
    counts = PLACES.of(spark.createDataFrame(rows, SCHEMA))
    for wave in range(3):
        ids = {f"j{pick.randrange(100)}" for _ in range(25)}
        come = offices(pick, sorted(ids - {x for x in ids if pick.random() < 0.4}))
        gone = [r for r in rows if r[0] in ids]
        counts = counting.applied(counts, counting.deltas(PLACES, spark.createDataFrame(gone, SCHEMA), spark.createDataFrame(come, SCHEMA)), PLACES.keys)
        rows = [r for r in rows if r[0] not in ids] + come
        expected = PLACES.of(spark.createDataFrame(rows, SCHEMA))
        assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in expected.collect()}
    # the batch counts of the same rows, which the filter options show
    batch = facets.place_counts(spark.createDataFrame(rows, SCHEMA).distinct())
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in batch.collect()}


def test_empty_changes(spark):
    none = spark.createDataFrame([], SCHEMA)
    counts = PLACES.of(spark.createDataFrame([("j", "a", "x")], SCHEMA))
    assert {tuple(r) for r in counting.applied(counts, counting.deltas(PLACES, none, none), PLACES.keys).collect()} == {("x", "a", 1), ("x", None, 1)}
    gone = counting.deltas(PLACES, spark.createDataFrame([("j", "a", "x")], SCHEMA), none)
    assert counting.applied(counts, gone, PLACES.keys).collect() == []


def test_a_moved_cutoff(spark, tmp_path):
    """Only the dates between the two cutoffs are read for the postings that expire."""
    path = str(tmp_path / "postings")
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("company"), F.timestamp_seconds(F.col("id") * 86_400).alias("posted_at"))
    rows.repartitionByRange(8, "posted_at").sortWithinPartitions("posted_at").write.parquet(path)
    stored, days = spark.read.parquet(path), [datetime(1970, 1, 1).fromtimestamp(d * 86_400) for d in (100, 130)]
    company = counting.Counted("postings", "id", ("company",), counting.value_units("company"))
    fresh = [stored.filter(F.col("posted_at") >= F.lit(d)) for d in days]
    gone = counting.expired(stored, *days)
    moved = counting.applied(company.of(fresh[0]), counting.deltas(company, gone, stored.limit(0)), company.keys)
    assert {tuple(r) for r in moved.collect()} == {tuple(r) for r in company.of(fresh[1]).collect()}
    assert "PushedFilters" in gone._jdf.queryExecution().toString() and "LessThan(posted_at" in gone._jdf.queryExecution().toString()
