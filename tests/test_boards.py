import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freshet.operators import boards
from freshet.session import shared_dir
from freshet.sources import store
from freshet.streaming import folds

START = datetime(2024, 1, 1)
LOG = "board string, ts timestamp, seq bigint, status string, jobs_found bigint, duration_ms bigint, error string, validator string, changed boolean"


def brute(rows):
    state = {}
    for board, ts, _, status, found, took, error, validator, changed in sorted(rows, key=lambda r: (r[1], r[2])):
        old = state.get(board, (None,) * 8)
        empty = (old[5] or 0) + 1 if status == "ok" and found == 0 else 0
        state[board] = (status, found, took, error, validator or old[4], empty, ts if changed else old[6], ts)
    return state


def made(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        board = "hot" if rng.random() < 0.4 else f"b{rng.randrange(8)}"
        status = "error" if rng.random() < 0.1 else "ok"
        found = 0 if status == "error" or rng.random() < 0.6 else rng.randrange(1, 9)
        rows.append((board, START + timedelta(minutes=i // 3), i, status, found, rng.randrange(99), "x" if status == "error" else None,
                     f"v{i}" if rng.random() < 0.2 else None, rng.random() < 0.1))
    return rows


def collected(state):
    return {r["board"]: tuple(r)[1:] for r in state.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_like_one_by_one(spark, seed):
    rows = made(seed)
    assert collected(boards.board_state(boards.summarise_log(spark.createDataFrame(rows, LOG)))) == brute(rows)


def test_merge_equals_one_fold(spark):
    rows = made(7)
    state = spark.createDataFrame([], boards.SUMMARY)
    for part in (rows[:120], rows[120:130], rows[130:]):
        state = boards.merge_state(state, boards.summarise_log(spark.createDataFrame(part, LOG)))
    assert collected(boards.board_state(state)) == brute(rows)


def test_stream_of_small_batches_equals_batch(spark):
    rows = made(4, 90)
    root = f"{shared_dir(spark)}/boards-{random.getrandbits(60)}"
    for i in range(3):
        spark.createDataFrame(rows[i * 30:(i + 1) * 30], LOG).coalesce(1).write.parquet(f"{root}/log/part={i}")
    tables = store.PublishedTables(spark, f"{root}/tables", folds.SUMMARY_TABLE)
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{root}/log/*")
    folds.fold_boards(log, tables, f"{root}/checkpoint").awaitTermination()
    assert tables.current()["token"] == "boards-2"
    assert collected(boards.board_state(tables.read("board_summary"))) == brute(rows)


def test_health_and_drift(spark):
    registry = spark.createDataFrame([("a", "active"), ("b", "degraded"), ("c", "dead"), ("d", "active"), ("e", "degraded")], "board string, status string")
    state = spark.createDataFrame([("a", 6), ("b", 7), ("c", 9), ("d", 5)], "board string, consecutive_empty bigint")
    drift = boards.drifted(state)
    assert {r["board"] for r in drift.collect()} == {"a", "b", "c"}
    moves = boards.health_changes(registry, drift)
    assert {tuple(r) for r in moves.collect()} == {("a", "degraded"), ("e", "active")}
    applied = {r["board"]: r["status"] for r in boards.apply_health(registry, moves).collect()}
    assert applied == {"a": "degraded", "b": "degraded", "c": "dead", "d": "active", "e": "active"}


@pytest.mark.parametrize("n", [0, 1, 3, 19, 40])
def test_slices_cover_each_board_once(spark, n):
    registry = spark.createDataFrame([(f"b{i:03d}",) for i in range(n)], "board string")
    rows = sorted((r["board"], r["slice"]) for r in boards.sweep_slices(registry).collect())
    expected = [(f"b{i:03d}", k) for k in range(4) for i in range(k * n // 4, (k + 1) * n // 4)]
    assert rows == expected


def test_batches(spark):
    registry = spark.createDataFrame([(f"b{i:03d}",) for i in range(19)], "board string")
    batches = {r["batch"]: r["boards"] for r in boards.work_batches(registry).collect()}
    assert [len(batches[i]) for i in range(3)] == [8, 8, 3]
    assert batches[2] == ["b016", "b017", "b018"]


def test_staleness_and_gate(spark):
    state = spark.createDataFrame([("a", START, START - timedelta(hours=2))], "board string, crawled_at timestamp, changed_at timestamp")
    assert boards.staleness(state, START + timedelta(minutes=60)).first()["stale"] is False
    assert boards.staleness(state, START + timedelta(minutes=61)).first()["stale"] is True
    assert boards.staleness(state.limit(0), START).first()["stale"] is True
    assert boards.changed_since(state, START - timedelta(hours=2)).first()[0] is True
    assert boards.changed_since(state, START).first()[0] is False
    assert boards.changed_since(state.limit(0), START).first()[0] is False


def test_publish(spark, monkeypatch):
    monkeypatch.setattr(store, "SLICE_ROWS", 10)
    root = f"{shared_dir(spark)}/store-{random.getrandbits(60)}"
    tables = store.PublishedTables(spark, root, {"rows": "id int, board string", "names": "name string"}, {"rows": "board"})
    assert tables.read("rows").count() == 0
    rows = spark.range(40).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("b"), (F.col("id") % 5).cast("string")).alias("board"))
    tables.publish({"rows": rows}, "one")
    assert tables.current()["tables"]["rows"]["slices"] == 4  # as many as the rows ask for
    tables.publish({"rows": rows.limit(0)}, "one")  # repeated token
    assert tables.read("rows").count() == 40
    touched = tables.slices_with("rows", spark.createDataFrame([("b3",)], "board string"), "board")
    own = tables.read_slices("rows", touched)
    left = own.filter("board <> 'b3' or id < 10")
    tables.publish({"rows": left, "names": spark.createDataFrame([("x",)], "name string")}, "two", {"rows": touched})
    assert tables.read("rows").count() == 40 - 6 and tables.read("names").count() == 1
    tables.publish({"rows": tables.read("rows").limit(0)}, "three", {"rows": touched})  # a slice that becomes empty goes
    assert tables.read_slices("rows", touched).count() == 0
    tables.publish({"names": spark.createDataFrame([("y",)], "name string")}, "four")
    assert [r[0] for r in tables.read("names").collect()] == ["y"]


def test_failed_write_leaves_the_old_version(spark):
    root = f"{shared_dir(spark)}/store-{random.getrandbits(60)}"
    tables = store.PublishedTables(spark, root, {"rows": "id bigint", "other": "id bigint"})
    tables.publish({"rows": spark.range(3), "other": spark.range(3)}, "one")
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception):  # noqa: B017
        tables.publish({"rows": spark.range(9), "other": broken}, "two")
    assert tables.read("rows").count() == 3 and tables.current()["token"] == "one"


def test_views_follow_changes(spark):
    root = f"{shared_dir(spark)}/views-{random.getrandbits(60)}"
    views = store.PublishedTables(spark, root, folds.VIEWS)
    rows = spark.createDataFrame([("1", "t", "c", "https://a.example", "berlin", START)], "id string, title string, company string, url string, location string, posted_at timestamp")
    located = spark.createDataFrame([("1", "berlin", "germany")], "job_id string, city string, country string")
    cutoff = START - timedelta(days=1)
    assert folds.refresh_views(rows, located, views, cutoff, False, True, "a") == []
    assert folds.refresh_views(rows, located, views, cutoff, True, False, "b") == ["recent_links"]
    assert folds.refresh_views(rows, located, views, cutoff, True, True, "c") == ["company_index", "location_counts", "recent_links"]
    assert views.read("company_index").count() == 1


def test_snapshots_split_over_batches(spark):
    """Boards split over batches, in any order; a lost page; an empty board; a repeated page."""
    at = START - timedelta(days=1)
    item = "id string, title string, company string, location string, locations array<string>, department string, url string, posted_at timestamp, source string, salary string, level string, city string, country string, is_remote boolean"
    page = f"provider string, board string, snapshot bigint, page int, pages int, items array<struct<{item.replace(' string', ':string').replace(' array', ':array').replace(' timestamp', ':timestamp').replace(' boolean', ':boolean')}>>"
    stored_schema = f"{item}, board string, created_at timestamp"

    def posting(board, i, title="t"):
        return (f"{board}-{i}", title, "c", "l", ["l"], "d", "https://a.example", at, "gh", "", "mid", None, "x", False)

    stored = spark.createDataFrame([(*posting(b, i), f"gh/{b}", at) for b, n in (("a", 40), ("b", 8), ("c", 6)) for i in range(n)], stored_schema)
    batches = [
        [("gh", "a", 1, 0, 2, [posting("a", i) for i in range(15)]), ("gh", "c", 1, 0, 2, [posting("c", 0)])],
        [("gh", "b", 1, 0, 1, [])],
        [("gh", "a", 1, 1, 2, [posting("a", i) for i in range(15, 40)]), ("gh", "a", 1, 0, 2, [posting("a", i) for i in range(15)])],
        [("gh", "a", 2, 0, 1, [posting("a", i, "new" if i == 3 else "t") for i in range(39)])],
    ]
    root = f"{shared_dir(spark)}/pages-{random.getrandbits(60)}"
    for rows in batches:
        spark.createDataFrame(rows, page).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    tables = store.PublishedTables(spark, f"{root}/tables", {"postings": stored.schema, "waiting": page}, {"postings": "board"})
    tables.publish({"postings": stored})

    def parse(whole):
        board = F.concat_ws("/", "provider", "board").alias("board")
        return whole.select(board, F.explode("items").alias("i")).select("board", "i.*"), whole.select(board, F.lit(True).alias("complete")).distinct()

    stream = spark.readStream.schema(page).option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")
    folds.apply_snapshots(stream, tables, f"{root}/checkpoint", at - timedelta(days=9), parse, START).awaitTermination()
    rows = {r["id"]: r for r in tables.read("postings").collect()}
    assert {k for k in rows if k.startswith("a")} == {f"a-{i}" for i in range(39)}
    assert rows["a-3"]["title"] == "new" and all(r["created_at"] == at for r in rows.values())
    assert not [k for k in rows if k.startswith("b")]  # an empty board of less than ten rows is cleared
    assert len([k for k in rows if k.startswith("c")]) == 6  # its second page never came
    assert [(r["board"], r["page"]) for r in tables.read("waiting").collect()] == [("c", 0)]


def test_only_pages_that_came_again_are_moved(spark):
    rows = [("a", "x", 1, 0, "one"), ("a", "x", 1, 0, "one"), ("a", None, 1, 0, "n"), ("a", None, 1, 0, "n"), ("a", "x", 1, 1, "two"), ("a", "x", 2, 0, None)]
    pages = spark.createDataFrame(rows, "provider string, board string, snapshot bigint, page int, body string")
    assert folds.once_each(pages).count() == 4
    alone = pages.dropDuplicates(["provider", "board", "snapshot", "page"])
    assert folds.once_each(alone) is alone
