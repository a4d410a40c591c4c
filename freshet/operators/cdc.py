"""Snapshot comparison, the deletion guard and keyed rewrites of the stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import vocab
from freshet.functions.scalars import is_fresh
from freshet.operators.skew import salted_join

LOCATION_FIELDS = ("location", "city", "country", "is_remote")
CORE_FIELDS = ("company", "title", "department", "url", "salary", "level")
# Columns an existing row keeps when it is written again.
KEPT_ON_CONFLICT = ("source", "created_at")
DRIFT_MICROS = vocab.POSTED_DRIFT_SECONDS * 1_000_000


def _differs(names: Sequence[str]) -> Column:
    def value(side: str, name: str) -> Column:
        column = F.col(f"{side}.{name}")
        return F.coalesce(column, F.lit("")) if name == "salary" else column

    return reduce(lambda a, b: a | b, [~value("old", n).eqNullSafe(value("new", n)) for n in names])


def reconciled_date(old: Column, new: Column) -> Column:
    """A later date is a re-post and keeps the first one; an earlier date is a correction."""
    return F.when(F.unix_micros(new) > F.unix_micros(old) + DRIFT_MICROS, old).otherwise(new)


def same_date(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) < DRIFT_MICROS


def stored_of(stored: DataFrame, boards: DataFrame, cutoff: datetime) -> DataFrame:
    """Fresh stored rows of the boards in this run. Expired rows belong to the stale sweep."""
    # `boards` is a written table of a run's boards: Spark knows its size and broadcasts it only if it is small.
    return stored.filter(is_fresh(F.col("posted_at"), cutoff)).join(boards.select("board"), "board", "left_semi")


def diff(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row per id with action insert / update / unchanged / missing.

    Both sides are unique by id, so the join key cannot be skewed. `fetched` columns that are null
    on a missing row are kept under their own names.
    """
    old, new = stored.alias("old"), fetched.alias("new")
    both = old.join(new, F.col("old.id") == F.col("new.id"), "full_outer")
    date = reconciled_date(F.col("old.posted_at"), F.col("new.posted_at"))
    none = F.array().cast("array<string>")  # no list and an empty one are the same offices
    listed = [F.array_sort(F.coalesce(f"{side}.locations", none)) for side in ("old", "new")]
    offices = ~listed[0].eqNullSafe(listed[1])
    location_changed = _differs(LOCATION_FIELDS) | offices
    core_changed = _differs(CORE_FIELDS)
    action = (
        F.when(F.col("old.id").isNull(), "insert").when(F.col("new.id").isNull(), "missing")
        .when(location_changed | core_changed | ~same_date(F.col("old.posted_at"), date), "update")
        .otherwise("unchanged")
    )
    both_sides = F.col("old.id").isNotNull() & F.col("new.id").isNotNull()
    row = [F.col(f"new.{c}") for c in fetched.columns if c not in ("id", "board", "posted_at")]
    return both.select(
        F.coalesce("new.id", "old.id").alias("id"),
        F.coalesce("new.board", "old.board").alias("board"),
        action.alias("action"),
        (both_sides & location_changed).alias("location_changed"),
        (both_sides & core_changed).alias("core_changed"),
        F.when(F.col("old.id").isNull(), F.col("new.posted_at")).otherwise(date).alias("posted_at"),
        F.col("old.id").isNotNull().alias("was_stored"),
        *row,
    )


def guard(changes: DataFrame) -> DataFrame:
    """Stored and missing rows per board, and whether that looks like a broken feed."""
    missing = F.col("action") == "missing"
    return changes.groupBy("board").agg(
        F.count_if("was_stored").alias("stored"),
        F.count_if(missing).alias("missing"),
        F.count_if(F.col("action") == "insert").alias("inserts"),
        F.count_if(F.col("action") == "update").alias("updates"),
    ).withColumn(
        "suspicious",
        (F.col("stored") >= vocab.GUARD_MIN_STORED) & (F.col("missing") > F.col("stored") * vocab.GUARD_MAX_SHARE),
    )


def allowed_deletes(changes: DataFrame, guarded: DataFrame, boards: DataFrame) -> DataFrame:
    """Ids to delete: missing from a complete snapshot of a board that is not suspicious.

    `boards` has board and complete.
    """
    deletable = guarded.filter(~F.col("suspicious") & (F.col("missing") > 0)).join(
        boards.filter("complete").select("board"), "board", "left_semi"
    )
    gone = changes.filter(F.col("action") == "missing").select("id", "board")
    return salted_join(gone, deletable.select("board", "missing"), ["board"], "missing", ["id"]).select("id")


def board_outcome(guarded: DataFrame, boards: DataFrame) -> DataFrame:
    """Per board: rows written or deleted, and whether anything changed. A partial or suspicious
    snapshot deletes nothing."""
    deletes = F.when(F.col("complete") & ~F.coalesce("suspicious", F.lit(False)), F.col("missing")).otherwise(F.lit(0))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("stored", "missing", "inserts", "updates")}
    return (
        boards.join(guarded, "board", "left").withColumns(counts)
        .withColumn("suspicious", F.col("complete") & F.coalesce("suspicious", F.lit(False)))
        .withColumn("deletes", deletes)
        .withColumn("wrote", (F.col("inserts") > 0) | (F.col("updates") > 0) | (F.col("deletes") > 0))
    )


def upsert(table: DataFrame, puts: DataFrame, kept: Sequence[str] = KEPT_ON_CONFLICT) -> DataFrame:
    """K1/K2: rows of `puts` replace or join the table by id; `kept` columns stay as stored."""
    old, new = table.alias("old"), puts.alias("new")
    both = old.join(new, F.col("old.id") == F.col("new.id"), "full_outer")
    touched = F.col("new.id").isNotNull()

    def pick(name: str) -> Column:
        if name == "id":
            return F.coalesce("new.id", "old.id")
        if name not in puts.columns:
            return F.col(f"old.{name}")
        taken = F.when(touched, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        return F.when(F.col("old.id").isNotNull(), F.col(f"old.{name}")).otherwise(taken) if name in kept else taken

    return both.select(*[pick(c).alias(c) for c in table.columns])


def puts_of(changes: DataFrame, created_at: Column) -> DataFrame:
    rows = changes.filter(F.col("action").isin("insert", "update")).withColumn("created_at", created_at)
    return rows.drop("action", "location_changed", "core_changed", "was_stored")


def without_ids(table: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """K3: the table without the given ids."""
    return table.join(ids.select(F.col("id").alias(column)), column, "left_anti")


def replace_facets(facets: DataFrame, touched_ids: DataFrame, new_facets: DataFrame) -> DataFrame:
    """K2/K9: clear the facet rows of the touched ids, add the recomputed ones."""
    return without_ids(facets, touched_ids, "job_id").unionByName(new_facets.select(*facets.columns))
