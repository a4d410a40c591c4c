from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freshet.operators import cdc, upkeep

AT = datetime(2024, 5, 1, 9)
SCHEMA = (
    "id string, board string, title string, company string, location string, department string, url string, source string, salary string, "
    "locations array<string>, level string, city string, country string, is_remote boolean, posted_at timestamp, created_at timestamp"
)
BASE = dict(
    board="gh/x", title="Clerk", company="x", location="berlin, germany", department="legal", url="https://a.example", source="greenhouse", salary="",
    locations=["a", "b"], level="mid", city="berlin", country="germany", is_remote=False, posted_at=AT, created_at=AT,
)


def table(spark, rows):
    return spark.createDataFrame([{**BASE, **r} for r in rows], SCHEMA)


def one(spark, **change):
    old, new = table(spark, [{"id": "1"}]), table(spark, [{"id": "1", **change}]).drop("created_at")
    return cdc.diff(old, new).first()


@pytest.mark.parametrize(("change", "action", "location", "core"), [
    ({}, "unchanged", False, False),
    ({"title": "Lead"}, "update", False, True),
    ({"company": "y"}, "update", False, True),
    ({"level": "lead"}, "update", False, True),
    ({"salary": None}, "unchanged", False, False),
    ({"salary": "$1"}, "update", False, True),
    ({"city": None}, "update", True, False),
    ({"is_remote": True}, "update", True, False),
    ({"locations": ["b", "a"]}, "unchanged", False, False),
    ({"locations": ["b", "a", "a"]}, "update", True, False),
    ({"posted_at": AT + timedelta(seconds=30)}, "unchanged", False, False),
    ({"posted_at": AT - timedelta(seconds=59)}, "unchanged", False, False),
    ({"posted_at": AT - timedelta(seconds=60)}, "update", False, False),
    ({"posted_at": AT + timedelta(days=1)}, "unchanged", False, False),
])
def test_changes(spark, change, action, location, core):
    row = one(spark, **change)
    assert (row["action"], row["location_changed"], row["core_changed"]) == (action, location, core)


def test_later_date_keeps_the_first(spark):
    assert one(spark, title="Lead", posted_at=AT + timedelta(days=1))["posted_at"] == AT
    assert one(spark, posted_at=AT - timedelta(days=1))["posted_at"] == AT - timedelta(days=1)
    assert one(spark, title="Lead", posted_at=AT + timedelta(seconds=60))["posted_at"] == AT + timedelta(seconds=60)


@pytest.mark.parametrize(("stored", "missing", "suspicious"), [(100, 50, False), (100, 51, True), (9, 9, False), (10, 6, True), (10, 5, False)])
def test_guard(spark, stored, missing, suspicious):
    rows = table(spark, [{"id": str(i)} for i in range(stored)])
    changes = cdc.diff(rows, rows.filter(F.col("id").cast("int") >= missing).drop("created_at"))
    guarded = cdc.guard(changes)
    boards = spark.createDataFrame([("gh/x", True)], "board string, complete boolean")
    assert guarded.first()["suspicious"] is suspicious
    assert cdc.allowed_deletes(changes, guarded, boards).count() == (0 if suspicious else missing)
    partial = boards.withColumn("complete", F.lit(False))
    assert cdc.allowed_deletes(changes, guarded, partial).count() == 0
    outcome = cdc.board_outcome(guarded, boards).first()
    assert outcome["wrote"] is (not suspicious)


def test_empty_snapshot_of_a_small_board(spark):
    rows = table(spark, [{"id": "1"}])
    boards = spark.createDataFrame([("gh/x", True), ("gh/none", True)], "board string, complete boolean")
    changes = cdc.diff(rows, rows.limit(0).drop("created_at"))
    outcome = {r["board"]: (r["deletes"], r["wrote"]) for r in cdc.board_outcome(cdc.guard(changes), boards).collect()}
    assert outcome == {"gh/x": (1, True), "gh/none": (0, False)}


def test_stored_of_leaves_expired_and_other_boards(spark):
    rows = table(spark, [{"id": "1"}, {"id": "2", "posted_at": AT - timedelta(days=20)}, {"id": "3", "board": "gh/y"}])
    boards = spark.createDataFrame([("gh/x",)], "board string")
    assert [r["id"] for r in cdc.stored_of(rows, boards, AT - timedelta(days=15)).collect()] == ["1"]


def test_upsert_keeps_some_columns(spark):
    stored = table(spark, [{"id": "1"}, {"id": "2"}])
    later = AT + timedelta(days=2)
    puts = table(spark, [{"id": "1", "title": "Lead", "company": "z", "source": "lever", "created_at": later}, {"id": "3", "company": "n", "created_at": later}])
    rows = {r["id"]: (r["title"], r["company"], r["source"], r["created_at"]) for r in cdc.upsert(stored, puts).collect()}
    assert rows == {"1": ("Lead", "z", "greenhouse", AT), "2": ("Clerk", "x", "greenhouse", AT), "3": ("Clerk", "n", "greenhouse", later)}
    taken = {r["id"]: (r["company"], r["source"]) for r in cdc.upsert(stored, puts, kept=("company", "created_at")).collect()}
    assert taken["1"] == ("x", "lever")


def test_duplicates_need_two_sources(spark):
    rows = table(spark, [
        {"id": "a", "title": "Clerk"}, {"id": "b", "title": "CLERK", "source": "lever", "posted_at": AT + timedelta(days=1)},
        {"id": "c", "posted_at": AT + timedelta(days=2)},
        {"id": "d", "title": "Cook"}, {"id": "e", "title": "Cook", "posted_at": AT + timedelta(days=1)},
        {"id": "f", "title": "Chef", "city": None}, {"id": "g", "title": "Chef", "city": None, "source": "lever"},
        {"id": "h", "title": "Vet"}, {"id": "i", "title": "Vet", "source": "lever", "posted_at": AT - timedelta(days=40)},
        {"id": "j", "title": "Guide", "country": "x"}, {"id": "k", "title": "Guide", "country": "y", "source": "ashby"},
    ])
    found = upkeep.duplicate_postings(rows, AT - timedelta(days=15))
    assert sorted(r["id"] for r in found.collect()) == ["b", "c", "j"]


def test_bounded_round(spark):
    doomed = spark.range(1700).select(F.col("id").cast("string").alias("id"), F.col("id").alias("at"))
    taken, counts = upkeep.bounded_round(doomed, ["at", "id"], 1500)
    assert taken.agg(F.max("at")).first()[0] == 1499
    assert tuple(counts.first()) == (1500, 200)


def test_packed_ids_are_not_broadcast(spark, monkeypatch):
    """Files of ordered ids are small, the hash table that the driver would build of them is not."""
    from freshet.operators.cdc import without_ids
    from freshet.plans import streams
    from freshet.session import cut, unpacked_sizes

    def plan(rows: int) -> str:
        ids = cut(spark.range(rows).select(F.concat(F.lit("od-"), F.col("id").cast("string")).alias("id")))
        table = cut(ids.withColumn("title", F.col("id")))
        return without_ids(table, ids)._jdf.queryExecution().executedPlan().toString()

    assert "Broadcast" in plan(400_000)  # Spark's own estimate
    with unpacked_sizes(spark):
        assert "Broadcast" not in plan(400_000)
        assert "Broadcast" in plan(100)
    assert "Broadcast" in plan(400_000)
    factor = "spark.sql.sources.fileCompressionFactor"
    for name in ("folded_snapshots", "crawled_boards"):
        monkeypatch.setattr(streams, f"_{name}", lambda session, sf: float(session.conf.get(factor)))
        assert getattr(streams, name)(spark, "") > 1
