"""Crawl streams folded into published tables, one micro-batch at a time.

Each micro-batch runs the same DataFrame code as the batch jobs: the stream adds the checkpoint,
the token of the batch makes a repeated batch a no-op.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshet.functions import vocab
from freshet.operators import boards, cdc, counting, facets as facet_ops, listing, upkeep
from freshet.operators.throttle import still_counting, throttle
from freshet.session import cut
from freshet.sources import feeds
from freshet.sources.store import PublishedTables

SUMMARY_TABLE = {"board_summary": boards.SUMMARY}


def _start(stream: DataFrame, step, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def fold_boards(log: DataFrame, tables: PublishedTables, checkpoint: str) -> StreamingQuery:
    """Crawl log into one summary per board."""
    def step(batch: DataFrame, number: int) -> None:
        newer = boards.summarise_log(cut(batch))
        tables.publish({"board_summary": boards.merge_state(tables.read("board_summary"), newer)}, f"boards-{number}")

    return _start(log, step, checkpoint)


@dataclass(frozen=True)
class Derived:
    """A table computed from postings and kept in step with them: facets, search terms.

    `compute` returns rows with `board` and the posting id in `key`.
    """

    key: str
    compute: Callable[[DataFrame], DataFrame]
    only_location: bool = False  # recomputed only where a location field changed


#: What a stream of snapshots carries besides the page itself: pages of a board's snapshot arrive in any
#: number of micro-batches, `pages` says how many there are. A board that has nothing sends one empty page.
PAGE_KEY = ("provider", "board", "snapshot", "page")

#: Whole pages to (postings, boards); boards have board (provider/board) and complete, also those without any posting.
Parse = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def once_each(pages: DataFrame) -> DataFrame:
    """Pages without repeated ones. Only keys are compared; only the pages that came again are moved."""
    again = cut(pages.groupBy(*PAGE_KEY).agg(F.count("*").alias("n")).filter("n > 1").select(*[F.col(k).alias(f"_{k}") for k in PAGE_KEY]))
    if again.isEmpty():
        return pages
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in PAGE_KEY])
    first = cut(pages.join(again, same, "left_semi").dropDuplicates([*PAGE_KEY]))
    return pages.join(again, same, "left_anti").unionByName(first)


def whole_snapshots(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages of each board's newest whole snapshot, pages that have to wait).

    A snapshot is whole once every one of its pages is there. Pages of older snapshots of a board than
    its newest whole one are dropped; those of newer ones wait for the rest.
    """
    own = ["provider", "board"]
    counts = pages.groupBy(*own, "snapshot").agg(F.count("*").alias("n"), F.max("pages").alias("pages"))
    newest = counts.filter(F.col("n") >= F.col("pages")).groupBy(*own).agg(F.max("snapshot").alias("newest"))
    # One row per board. The pages themselves are read again by either side, not written in between.
    met = pages.join(cut(newest), own, "left")
    whole = met.filter(F.col("snapshot") == F.col("newest")).drop("newest")
    waiting = met.filter(F.col("newest").isNull() | (F.col("snapshot") > F.col("newest"))).drop("newest")
    return whole, waiting


def apply_snapshots(
    pages: DataFrame, tables: PublishedTables, checkpoint: str, cutoff: datetime, parse: Parse, created_at: datetime,
    derived: Mapping[str, Derived] | None = None, counted: Mapping[str, counting.Counted] | None = None,
) -> StreamingQuery:
    """Arriving pages of board snapshots into the stored tables.

    A board is compared only when a snapshot of it is whole; until then its pages wait in the table
    `waiting`. An empty snapshot counts as one. Where `tables` has `seen`, boards whose pages all carry
    the marks of the last time are left alone (S9). Of every table that is sliced by board, `waiting`, `seen`
    and `board_summary` too, only the slices of the boards at hand are read and rewritten; all tables are
    published together. The tables of `counted` follow the rows that go and come (K10): only those are counted.
    """
    def step(batch: DataFrame, number: int) -> None:
        token = f"snapshots-{number}"
        if tables.current()["token"] == token:
            return
        out, replace = {}, {}

        def near(name: str, keys: DataFrame) -> DataFrame:
            """The rows of a table that may belong to the boards; its other slices stay as they are."""
            if name not in tables.by:
                return tables.read(name)
            replace[name] = tables.slices_with(name, keys, "board")
            return tables.read_slices(name, replace[name])

        arrived = cut(batch)
        whole, out["waiting"] = whole_snapshots(once_each(near("waiting", arrived).unionByName(arrived)))
        if "seen" in tables.schemas:
            key, own = ["provider", "board", "page", "mark"], ["provider", "board"]
            marked = cut(whole.withColumn("mark", feeds.page_mark()).select(*key))
            met = cut(marked.select(*own).distinct())
            seen = near("seen", met)
            whole = feeds.changed_boards(whole, seen.join(met, own, "left_semi"), marked)
            out["seen"] = seen.join(met, own, "left_anti").unionByName(marked)
        rows, crawled = parse(whole)
        rows, crawled = cut(rows), cut(crawled)
        if not crawled.isEmpty():
            touched = {name: tables.slices_with(name, crawled, "board") for name in ("postings", *(derived or {}))}
            stored = tables.read_slices("postings", touched["postings"])
            fetched = rows.select(*[c for c in stored.columns if c != "created_at"])
            changes = cut(cdc.diff(cdc.stored_of(stored, crawled, cutoff), fetched))
            guarded = cut(cdc.guard(changes))
            outcome = cut(cdc.board_outcome(guarded, crawled))
            if "board_summary" in tables.schemas:
                newer = boards.summarise_log(_crawl_rows(whole, rows, outcome))
                out["board_summary"] = boards.merge_state(near("board_summary", crawled), newer)
            if not outcome.filter("wrote").isEmpty():
                deletes = cut(cdc.allowed_deletes(changes, guarded, crawled))
                written = cdc.upsert(stored, cdc.puts_of(changes, F.lit(created_at)))
                out["postings"] = cdc.without_ids(written, deletes)
                put_ids = changes.filter(F.col("action").isin("insert", "update")).select("id")
                moved = {"postings": (put_ids.unionByName(deletes), written.join(put_ids, "id", "left_semi"))}
                for name, spec in (derived or {}).items():
                    puts = changes.filter(F.col("action").isin("insert", "update"))
                    if spec.only_location:
                        puts = puts.filter((F.col("action") == "insert") | F.col("location_changed"))
                    cleared = puts.select("id").unionByName(deletes)
                    kept = cdc.without_ids(tables.read_slices(name, touched[name]), cleared, spec.key)
                    fresh = spec.compute(puts).select(*kept.columns)
                    out[name] = kept.unionByName(fresh)
                    moved[name] = (cleared, fresh)
                for name, count in (counted or {}).items():
                    ids, come = moved[count.source]
                    before = tables.read_slices(count.source, touched[count.source])
                    gone = before.join(ids.select(F.col("id").alias(count.key)), count.key, "left_semi")
                    out[name] = counting.applied(tables.read(name), counting.deltas(count, gone, come), count.keys)
                replace |= {name: touched[name] for name in touched if name in out}
        tables.publish(out, token, replace)

    return _start(pages, step, checkpoint)


def _crawl_rows(whole: DataFrame, rows: DataFrame, outcome: DataFrame) -> DataFrame:
    """Crawl-log rows of the boards at hand: the snapshot number is the time in seconds."""
    found = rows.groupBy("board").agg(F.count("*").alias("jobs_found"))
    at = whole.groupBy(F.concat_ws("/", "provider", "board").alias("board")).agg(F.max("snapshot").alias("snapshot"))
    own = outcome.join(found, "board", "left").join(at, "board")
    none = F.lit(None).cast("string")
    return own.select(
        "board", F.timestamp_seconds("snapshot").alias("ts"), F.col("snapshot").cast("long").alias("seq"), F.lit("ok").alias("status"),
        F.coalesce("jobs_found", F.lit(0)).cast("long").alias("jobs_found"), F.lit(0).cast("long").alias("duration_ms"), none.alias("error"),
        none.alias("validator"), F.col("wrote").alias("changed"),
    )


def flag_requests(
    requests: DataFrame, tables: PublishedTables, out: str, checkpoint: str, window_seconds: int,
) -> StreamingQuery:
    """T11 over a stream: each batch writes its decisions to its own folder under `out`, and the
    allowed requests that later ones still have to count are carried over."""
    def step(batch: DataFrame, number: int) -> None:
        carried = tables.read("counting")
        decided = cut(throttle(cut(batch), window_seconds, carried))
        decided.select("event_id", "allowed", "retry_micros").write.mode("overwrite").parquet(f"{out}/batch={number}")
        allowed = decided.filter("allowed").select("limit_name", "client", "at")
        tables.publish({"counting": still_counting(carried.unionByName(allowed), window_seconds)}, f"requests-{number}")

    return _start(requests, step, checkpoint)


THROTTLE_TABLES = {"counting": "limit_name string, client string, at bigint"}

VIEWS = {
    "recent_links": "id string, title string, company string, url string, location string, posted_at timestamp",
    "company_index": "name string, last_posted_at timestamp",
    "location_counts": "country string, city string, count bigint",
}


def refresh_views(
    postings: DataFrame, located: DataFrame, views: PublishedTables, cutoff: datetime, changed: bool, full: bool, token: str,
) -> list[str]:
    """Nothing without a change; recent links after any change; the rest at a sweep start."""
    if not changed:
        return []
    recent = listing.newest(postings, cutoff, vocab.RECENT_LIMIT)
    fresh = {"recent_links": recent.select("id", "title", "company", "url", "location", "posted_at")}
    if full:
        fresh["company_index"] = facet_ops.company_index(postings, cutoff)
        fresh["location_counts"] = facet_ops.city_counts(located)
    views.publish(fresh, token)
    return sorted(fresh)


def sweep(postings: DataFrame, facets: DataFrame, cutoff: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean-up of one sweep: expired and cross-source duplicate postings go, with their facet rows.

    Returns the postings and facets that stay and one row of counts (removed, deduped).
    """
    stale = cut(upkeep.stale_ids(postings, cutoff).select("id"))
    live = upkeep.without_stale(postings, cutoff)
    twins = cut(upkeep.duplicate_postings(live, cutoff).select("id"))
    gone = stale.unionByName(twins)
    kinds = stale.select(F.lit("removed").alias("kind")).unionByName(twins.select(F.lit("deduped").alias("kind")))
    counts = kinds.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("removed", "deduped")])
    return cdc.without_ids(live, twins), cdc.without_ids(facets, gone, "job_id"), counts
