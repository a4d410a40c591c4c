import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import skew
from freshet.operators.skew import global_rank, grouped_rank, salted_join


def hot_rows(spark, n=3000):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", rng.randrange(30)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, key string, at int").repartition(6)


@pytest.mark.parametrize("least", [100, 10_000])
def test_salted_join_keeps_every_row(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "HOT_ROWS", least)
    rows, df = hot_rows(spark)
    sizes = df.groupBy("key").agg(F.count("*").alias("n"))
    met = salted_join(df, sizes, ["key"], "n", ["id"]).collect()
    expected = {}
    for _, key, _ in rows:
        expected[key] = expected.get(key, 0) + 1
    assert len(met) == len(rows)
    assert all(r["n"] == expected[r["key"]] for r in met)


def test_salted_join_spreads_the_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    _, df = hot_rows(spark)
    sizes = df.groupBy("key").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = salted_join(df, sizes, ["key"], "n", ["id"]).filter("key = 'hot'")
        parts = met.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(parts) > 1


def test_left_join_keeps_unmatched(spark):
    _, df = hot_rows(spark, 200)
    sizes = df.filter("key <> 'hot'").groupBy("key").agg(F.count("*").alias("n"))
    assert salted_join(df, sizes, ["key"], "n", ["id"], "left").count() == 200


def test_global_rank(spark):
    rows, df = hot_rows(spark)
    found = {r["id"]: r["rank"] for r in global_rank(df, [F.desc("at"), F.asc("id")], "rank").collect()}
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert found == {r[0]: i for i, r in enumerate(order)}


def test_grouped_rank(spark):
    rows, df = hot_rows(spark)
    found = {r["id"]: r["place"] for r in grouped_rank(df, ["key"], [F.desc("at"), F.desc("id")], "place", ["id"]).collect()}
    seen, expected = {}, {}
    for id_, key, _ in sorted(rows, key=lambda r: (-r[2], -r[0])):
        seen[key] = seen.get(key, 0) + 1
        expected[id_] = seen[key]
    assert found == expected
