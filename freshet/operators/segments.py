"""A search index that is kept by adding segments: an update reads and writes the touched documents alone.

A segment is a folder that is never changed: the terms of the documents of one update, in files by document
and sorted runs in each (a search opens the pages of every file that may hold its words), the lengths of these
documents as rows without a term, and the ids that the update replaced or removed (`gone`), which hide their
rows in earlier segments. Terms go straight from their documents to these files: they are neither written
before nor shuffled, as either would take as much disk again as the index. The table `live` (sliced by document) says how long each document is now, so the number of
documents and their total length are kept by addition. Small neighbouring segments are merged once there
are FAN of them; a merge drops hidden rows, so a document is rewritten about as often as the logarithm of
the index's size says, not with every update. Segments that were merged go with the next update.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators.search import RUN_WORDS, SearchIndex
from freshet.session import cut, lean_writes
from freshet.sources.store import PublishedTables

FAN = 4
SEGMENT = "number bigint, folder string, rows bigint, n bigint, total bigint"


def rows_of(index: SearchIndex) -> DataFrame:
    """`SearchIndex.rows` of an index that was not built in one pass."""
    return index.lengths.unionByName(index.terms, allowMissingColumns=True).sortWithinPartitions("term", "doc_id")


class SegmentedIndex:
    """For one writer at a time; `id_type` is the SQL type of document ids."""

    def __init__(self, spark: SparkSession, root: str, id_type: str, slices: int = 16):
        self.spark, self.root, self.id_type = spark, root.rstrip("/"), id_type
        live = f"doc_id {id_type}, length bigint"
        self.tables = PublishedTables(spark, f"{self.root}/tables", {"live": live, "segments": SEGMENT}, {"live": "doc_id"}, slices)

    def segments(self) -> list:
        """A handful of rows: their number grows with the logarithm of the index."""
        return sorted(self.tables.read("segments").collect(), key=lambda r: r["number"])

    def _rows(self, segment) -> DataFrame:
        """Terms, and lengths as rows without one."""
        schema = f"doc_id {self.id_type}, field string, term string, length bigint, positions array<int>"
        return self.spark.read.schema(schema).parquet(f"{segment['folder']}/terms").withColumn("number", F.lit(segment["number"]))

    def _gone(self, segment) -> DataFrame:
        return self.spark.read.schema(f"doc_id {self.id_type}").parquet(f"{segment['folder']}/gone").withColumn("hides", F.lit(segment["number"]))

    def _last(self, segments: list) -> DataFrame:
        """The last of the segments that hides an id."""
        return reduce(DataFrame.unionByName, map(self._gone, segments)).groupBy("doc_id").agg(F.max("hides").alias("hides"))

    def _visible(self, segments: list) -> DataFrame:
        """Terms of the segments without those that a later one of them hides."""
        rows = reduce(DataFrame.unionByName, map(self._rows, segments)).filter(F.col("term").isNotNull())
        if len(segments) == 1:
            return rows
        hidden = rows.join(self._last(segments[1:]), "doc_id", "left")
        return hidden.filter(F.col("hides").isNull() | (F.col("number") >= F.col("hides"))).drop("hides")

    def _kept(self, segments: list) -> DataFrame:
        """Rows of the segments, to be merged, without those that a later one hides.

        Which documents are hidden is found out from their ids alone, so that only these meet the rows, by a broadcast
        where they are few, and the rows of an index do not move. Where none is hidden, large segments are copied as they are:
        their runs are long enough to search, and sorting them anew would spill as much as they hold.
        """
        rows = reduce(DataFrame.unionByName, map(self._rows, segments))
        ids = rows.filter(F.col("term").isNull()).select("number", "doc_id").distinct()
        hidden = cut(ids.join(self._last(segments[1:]), "doc_id").filter(F.col("number") < F.col("hides")).select("number", "doc_id"))
        if not hidden.isEmpty():
            return rows.join(hidden, ["number", "doc_id"], "left_anti").sortWithinPartitions("term", "doc_id")
        large = [self._rows(s) for s in segments if s["rows"] > RUN_WORDS]
        small = [self._rows(s) for s in segments if s["rows"] <= RUN_WORDS]
        again = [reduce(DataFrame.unionByName, small).sortWithinPartitions("term", "doc_id")] if small else []
        return reduce(DataFrame.unionByName, large + again)

    def _write(self, rows: DataFrame, gone: DataFrame) -> str:
        folder = f"{self.root}/segments/{uuid.uuid4().hex}"
        rows.select("doc_id", "field", "term", "length", "positions").write.parquet(f"{folder}/terms")
        gone.select("doc_id").write.parquet(f"{folder}/gone")
        return folder

    def update(self, built: SearchIndex, touched: DataFrame) -> None:
        """K7: `touched` has the doc_id of every document that is new, changed or removed; `built` indexes those that are there now."""
        with lean_writes(self.spark):
            self._update(built, touched)

    def _update(self, built: SearchIndex, touched: DataFrame) -> None:
        touched = cut(touched.select("doc_id").distinct())
        known = self.segments()
        slices = self.tables.slices_with("live", touched, "doc_id") if known else None
        live = self.tables.read("live") if slices is None else self.tables.read_slices("live", slices)
        before = cut(live.join(touched, "doc_id", "left_semi"))
        left = before.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        number = known[-1]["number"] + 1 if known else 1
        folder = self._write(built.rows if built.rows is not None else rows_of(built), before)
        written = self._rows({"folder": folder, "number": number})
        lengths = written.filter(F.col("term").isNull()).select("doc_id", "length")
        come = lengths.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        now = (number, folder, self._n_terms(written), come[0] - left[0], come[1] - left[1])
        listed = [tuple(s) for s in known] + [now]
        merged = self._merged(listed)
        after = live.join(touched, "doc_id", "left_anti").unionByName(lengths)
        replace = {} if slices is None else {"live": slices}
        unused = sorted({s[1] for s in listed} - {s[1] for s in merged})
        self.tables.publish({"live": after, "segments": self.spark.createDataFrame(merged, SEGMENT)}, replace=replace, unused=unused)

    def _n_terms(self, rows: DataFrame) -> int:
        return rows.agg(F.count("term")).first()[0]

    def _merged(self, listed: list[tuple]) -> list[tuple]:
        """Merge the newest segments from the first on that is no larger than all newer ones together, once they are FAN.

        What stays unmerged shrinks by half or more from segment to segment, but for the newest FAN.
        """
        names, rows = [c.split(" ")[0] for c in SEGMENT.split(", ")], [s[2] for s in listed]
        first = next(i for i in range(len(listed)) if rows[i] <= sum(rows[i + 1 :]) or i == len(listed) - 1)
        if len(listed) - first < FAN:
            return listed
        some = [dict(zip(names, s)) for s in listed[first:]]
        gone = reduce(DataFrame.unionByName, map(self._gone, some))
        folder = self._write(self._kept(some), gone.distinct() if first else gone.limit(0))  # nothing older, nothing to hide
        merged = {"folder": folder, "number": some[-1]["number"]}
        return [*listed[:first], (merged["number"], folder, self._n_terms(self._rows(merged)), sum(s["n"] for s in some), sum(s["total"] for s in some))]

    def index(self) -> SearchIndex:
        """What the searches read; N and the total length are sums over the segments."""
        listed = self.segments()
        summary = self.spark.createDataFrame([(sum(s["n"] for s in listed), sum(s["total"] for s in listed))], "n bigint, total bigint")
        return SearchIndex(self._visible(listed).drop("number"), self.tables.read("live"), summary)
