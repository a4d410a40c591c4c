"""Benchmark decontamination by winnowing.

Each text is cut into hashes of K words; of every W neighbouring ones the least (of equal ones the
rightmost) is a fingerprint. A span of WINDOW = K + W - 1 equal words holds W equal K-grams, so both
sides choose the same fingerprint in it: joining fingerprints misses no shared window. Each joined
fingerprint is then extended: the WINDOW-word windows that chose it are compared whole with the
benchmark's windows. An item shorter than WINDOW is a window by itself; documents are searched for
its length at every place.

Defined cases: null or empty text has no words and no hit; repeated rows and equal keys are handled
row by row; an empty benchmark hits nothing; other columns of either table are ignored. Windows are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.session import cut

WINDOW, K = 10, 5
W = WINDOW - K + 1
WORD_BYTES = common.byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
FILTER_ROWS = 1_000_000  # up to so many benchmark hashes (8 MB) go to the tasks to drop other rows early

_PIECES = "_key long, _sign long, n_words long, print long, starts array<int>, width int, windows array<long>"


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item: its windows, with the fingerprint that each chooses."""
    for (key, _), data in common.chunks(batches):
        hashed, bounds = common.words(data, WORD_BYTES)
        for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if a == b:
                continue
            width = min(WINDOW, int(b - a))
            windows = common.grams(hashed[a:b], width)
            if width == WINDOW:
                small = common.grams(hashed[a:b], K)
                prints = small[common.lowest_of_windows(small, W)]
            else:
                prints = windows
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[row].as_py()] * len(windows), pa.int64()), pa.array(prints.view(np.int64)),
                 pa.array(np.full(len(windows), width, np.int32)), pa.array(windows.view(np.int64))],
                ["item_id", "print", "width", "window"],
            )


def _pieces_of(short: list[int], wanted: np.ndarray | None) -> Callable:
    """Of each document: its word count, and its fingerprints with the windows that chose them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, sign), data in common.chunks(batches):
            hashed, bounds = common.words(data, WORD_BYTES)
            n_words = np.diff(bounds)
            owner = np.repeat(np.arange(len(data)), n_words)
            parts = []
            ends = np.repeat(bounds[1:], n_words)
            if (n := len(hashed) - WINDOW + 1) > 0:
                small = common.grams(hashed, K)
                chosen = common.lowest_of_windows(small, W)[:n]
                start = np.flatnonzero(np.arange(n) + WINDOW <= ends[:n])
                parts.append((start, small[chosen[start]], WINDOW))
            for width in short:
                start = np.flatnonzero(np.arange(len(hashed)) + width <= ends)
                parts.append((start, common.grams(hashed, width)[start] if len(start) else np.zeros(0, np.uint64), width))
            out_row, out_print, out_starts, out_width, out_windows, sizes = [], [], [], [], [], []
            for start, prints, width in parts:
                if wanted is not None and len(start):
                    at = np.searchsorted(wanted, prints)
                    hit = wanted[np.minimum(at, len(wanted) - 1)] == prints if len(wanted) else np.zeros(len(prints), bool)
                    start, prints = start[hit], prints[hit]
                if not len(start):
                    continue
                run_of = np.flatnonzero(np.concatenate(([True], (prints[1:] != prints[:-1]) | (np.diff(start) != 1) | (np.diff(owner[start]) != 0))))
                out_row.append(owner[start[run_of]])
                out_print.append(prints[run_of])
                out_starts.append(start - bounds[owner[start]])
                out_width.append(np.full(len(run_of), width, np.int32))
                out_windows.append(common.grams(hashed, width)[start])
                sizes.append(np.diff(np.append(run_of, len(start))))
            row = np.concatenate([np.arange(len(data)), *out_row]).astype(np.int64)
            plain = np.zeros(len(data), np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.concatenate([plain, *sizes])))).astype(np.int32)
            empty = np.arange(len(row)) < len(data)
            nested = lambda v, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, kind), *v]).astype(kind)))
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(row)).cast(pa.int64()), sign.take(pa.array(row)).cast(pa.int64()), pa.array(n_words[row]),
                 pa.array(np.concatenate([plain.view(np.uint64), *out_print]).view(np.int64), mask=empty),
                 nested(out_starts, np.int32), pa.array(np.concatenate([plain.astype(np.int32), *out_width])),
                 nested([x.view(np.int64) for x in out_windows], np.int64)],
                ["_key", "_sign", "n_words", "print", "starts", "width", "windows"],
            )

    return run


def _covered(spans: Column) -> Column:
    """Words inside any of the (start, end) spans."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["reach"]))).alias("n"),
        F.greatest(acc["reach"], x["end"]).alias("reach"),
    )
    return F.aggregate(F.array_sort(spans), begin, step, lambda acc: acc["n"].cast("long"))


def contamination(documents: DataFrame, benchmark: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document: its key, n_words, n_hit, items (sorted as text) and n_items."""
    windows = cut(
        common.texts(benchmark, item_key, text)
        .select(F.col("_key").cast("long"), F.lit(0).alias("_sign"), "_text")
        .mapInArrow(_windows_of, "item_id long, print long, width int, window long")
    )
    short = [r["width"] for r in windows.filter(F.col("width") < WINDOW).select("width").distinct().collect()]  # at most WINDOW - 1
    prints = windows.select("print").distinct()
    wanted = None
    if prints.limit(FILTER_ROWS + 1).count() <= FILTER_ROWS:
        wanted = np.sort(np.array([r["print"] for r in prints.collect()], dtype=np.int64).view(np.uint64))
    docs = common.texts(documents, doc_key, text).select(F.col("_key").cast("long"), F.xxhash64("_text").alias("_sign"), "_text")
    pieces = cut(docs.mapInArrow(_pieces_of(sorted(short), wanted), _PIECES))
    hits = (
        pieces.filter(F.col("print").isNotNull())
        .join(prints, "print", "left_semi")
        .select("_key", "_sign", "width", F.explode(F.arrays_zip("starts", "windows")).alias("at"))
        .select("_key", "_sign", "width", F.col("at.starts").alias("start"), F.col("at.windows").alias("window"))
        .join(windows.select("item_id", "width", "window").distinct(), ["width", "window"])
        .groupBy("_key", "_sign")
        .agg(
            _covered(F.collect_set(F.struct("start", (F.col("start") + F.col("width")).alias("end")))).alias("n_hit"),
            F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string"))).alias("items"),
        )
        .select(F.col("_key").alias("_k"), F.col("_sign").alias("_s"), "n_hit", "items")
    )
    counts = pieces.filter(F.col("print").isNull()).select("_key", "_sign", "n_words")
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_sign") == F.col("_s"))
    none = F.array().cast("array<string>")
    return counts.join(hits, same, "left").select(
        F.col("_key").alias(doc_key), "_sign", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"),
    ).withColumn("n_items", F.size("items").cast("long"))


def untouched(documents: DataFrame, benchmark: DataFrame, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any benchmark window."""
    found = contamination(documents, benchmark, doc_key=doc_key, text=text).filter(F.col("n_hit") > 0)
    return common.without(documents, found.select(F.col(doc_key).alias("_key"), "_sign").distinct(), doc_key, text)
