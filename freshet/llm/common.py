"""What the text operators share: reading texts in bounded chunks, words and n-grams as 64-bit hashes.

Texts are taken as UTF-8 bytes, whole. Every helper works on numpy arrays inside a task; Spark deals
out the rows. Two different words, shingles or windows get the same 64-bit hash with a chance of
about 5e-20 a pair; results that rest on equality of hashes say so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20  # texts handled at once in a task; one longer text is a chunk of its own
ARROW_ROWS = "1000"  # rows sent to a Python worker at once
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def lean(df: DataFrame) -> DataFrame:
    """Small Arrow batches for what follows: a batch of long texts has to fit beside a second worker's."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, under names that no other column can clash with; null text is empty."""
    return lean(df.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")))


def remainder(key: str, divisor: int) -> Column:
    """crc32 of a key's text, modulo `divisor`; a null key counts as 0."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(0)) % divisor


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list[pa.Array], list[bytes]]]:
    """(the other columns, texts as bytes) of at most `limit` bytes; the text is the last column of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()
        start = size = 0
        for end, value in enumerate(data):
            if size + len(value) > limit and end > start:
                yield [c.slice(start, end - start) for c in batch.columns[:-1]], data[start:end]
                start, size = end, 0
            size += len(value) + 1
        yield [c.slice(start) for c in batch.columns[:-1]], data[start:]


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, CHUNK_BYTES + (1 << 16)), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(excluded: Sequence[tuple[int, int]]) -> np.ndarray:
    """Which bytes belong to words, once A-Z are lower case: all but those in the ranges."""
    keep = np.ones(256, dtype=bool)
    for low, high in excluded:
        keep[low : high + 1] = False
    keep[0x41:0x5B] = keep[0x61:0x7B]
    return keep


def words(data: Sequence[bytes], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, A-Z taken as a-z; first word of each text and the end of the last)."""
    buffer = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    starts_of = np.concatenate(([0], np.cumsum(lengths + 1)))
    inside = keep[buffer]
    inside[starts_of[1:] - 1] = False
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edge[0::2], edge[1::2]
    fold = _BYTES.copy()
    fold[0x41:0x5B] = _BYTES[0x61:0x7B]
    total = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(fold[buffer] * _power("up", _BASE, len(buffer)), out=total[1:], dtype=np.uint64)
    hashed = (total[last] - total[first]) * _power("down", _INVERSE, len(buffer))[first]
    hashed = mix(hashed + (last - first).astype(np.uint64))
    return hashed, np.searchsorted(first, starts_of)


def grams(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each place; the caller leaves out those that cross a text's end."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashed[j : j + n]
    return mix(out + np.uint64(k))


def lowest_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value of each window of `width` values, of equal ones the rightmost."""
    n = len(values) - width + 1
    best, at = values[:n].copy(), np.arange(n)
    for j in range(1, width):
        value = values[j : j + n]
        lower = value <= best
        best[lower] = value[lower]
        at[lower] = np.flatnonzero(lower) + j
    return at


def filtered(df: DataFrame, text: str, keep: Callable[[list[bytes]], np.ndarray], limit: int = CHUNK_BYTES) -> DataFrame:
    """The rows, all columns as they are, for whose texts `keep` says so; null text is judged as empty.

    `keep` gets at most `limit` bytes of texts at once, one longer text by itself.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.compute.fill_null(batch.column(at).cast(pa.large_binary()), b"")
            start = 0
            for _, some in chunks(iter([pa.RecordBatch.from_arrays([data], ["_text"])]), limit):
                yield batch.slice(start, len(some)).filter(pa.array(keep(some)))
                start += len(some)

    return lean(df).mapInArrow(run, df.schema)


def _signed(df: DataFrame, marked: DataFrame, key: str, text: str, how: str) -> DataFrame:
    own = df.withColumn("_own_sign", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    marked = marked.select(F.col("_key").alias("_marked_key"), F.col("_sign").alias("_marked_sign"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("_marked_key")) & (F.col("_own_sign") == F.col("_marked_sign"))
    return own.join(marked, same, how).select(*[F.col(f"`{c}`") for c in df.columns])


def without(df: DataFrame, marked: DataFrame, key: str, text: str) -> DataFrame:
    """The rows whose (key, xxhash64 of the text) is not among `marked` (_key, _sign)."""
    return _signed(df, marked, key, text, "left_anti")


def among(df: DataFrame, marked: DataFrame, key: str, text: str) -> DataFrame:
    """The rows whose (key, xxhash64 of the text) is among `marked` (_key, _sign)."""
    return _signed(df, marked, key, text, "left_semi")


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the group, place in the group) for groups of the given sizes, laid end to end."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def numbered(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(number of each piece, distinct pieces) of UTF-8 text cut at `starts`, the first of which is 0."""
    offsets = pa.py_buffer(np.append(starts, len(buffer)).astype(np.int64))
    pieces = pa.LargeStringArray.from_buffers(len(starts), offsets, pa.py_buffer(buffer)).dictionary_encode()
    return pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Ids of the words that a task has encoded: the place of each word, and the ids of all places end to end."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.held, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)  # with room for more

    @property
    def n_ids(self) -> int:
        return int(self.ends[len(self.place)])

    def add(self, words: Sequence[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct words not known yet, with their ids end to end and the number of ids of each."""
        n, at = len(self.place), self.n_ids
        more = n + len(words)
        if more + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros(more + 1, np.int64)))
        if at + len(ids) > len(self.held):
            self.held = np.concatenate((self.held, np.zeros(at + len(ids), np.int32)))
        self.ends[n + 1 : more + 1] = at + np.cumsum(counts)
        self.held[at : at + len(ids)] = ids
        self.place.update(zip(words, range(n, more)))

    def places(self, words: Sequence[str]) -> np.ndarray:
        """Place of each word, -1 where it is not known."""
        known = self.place
        return np.array([known.get(w, -1) for w in words], np.int64)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words at these places, end to end; number of ids of each)."""
        starts = self.ends[places]
        counts = self.ends[places + 1] - starts
        at = np.repeat(starts - (np.cumsum(counts) - counts), counts)
        at += np.arange(len(at))
        return self.held[at], counts
