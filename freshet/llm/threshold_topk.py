"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Each component x of a vector becomes floor(SCALE * x); the score of two vectors is their integer inner
product. Every row goes to one block of at most about BLOCK_ROWS rows, by a hash. A task sorts a
block's rows along every dimension; a query then walks the lists of the dimensions it is not zero in,
from the largest component down where its own is positive and from the smallest up where it is
negative, some entries of every list a round. A row that a list shows for the first time is scored at
once (random access). No row that all lists have still to show can score more than the sum of the
query's components times the next entries of the lists; once that bound is below the k-th best score,
the block is done. Rows of equal score count by the smaller key, so the walk goes on while the bound
equals the k-th score. Results of the blocks are merged by (score, key), k a block at most.

Queries are sent to every block in turn, block rows first, so a task holds one block and one Arrow
batch of queries, however many queries there are. Nothing is broadcast or collected.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, as query
or as candidate; an empty vector takes part and scores 0 with all; of vectors of different lengths the
shorter one counts as ended by zeros; rows with the query's own key are no candidates of it, and
repeated query rows are one query where they are equal in key and vector, otherwise one each; a row
with a null key is no query, and as a candidate comes after all others of its score; a score beyond 64
bits counts as the nearest long; an empty table gives no rows; other columns are ignored. The key has
to be an integer column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import lean
from freshet.session import cut, shuffle_width

SCALE = 256
BLOCK_ROWS = 8192  # rows of a block at most, on average
LEAST_ROWS = 1024  # a block of fewer is not parted further to occupy more tasks
FIRST_DEPTH = 32  # entries of every list in the first round; each later round takes as many as all before it
EXACT = 1 << 53  # integers below it are exact as doubles
LONGEST = np.iinfo(np.int64).max
FOUND = "query_id long, _sign long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def integers(vectors: list, dimensions: int) -> np.ndarray:
    """Rows of floor(SCALE * x), ended by zeros; Python integers where doubles would not be exact."""
    out = np.zeros((len(vectors), dimensions))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(out * SCALE)
    if np.isfinite(out).all():
        return out
    # A finite component may leave the range of doubles when multiplied.
    return np.array([[math.floor(int(x) * SCALE) if abs(x) > 2.0**60 else math.floor(x * SCALE) for x in [*v, *[0.0] * (dimensions - len(v))]] for v in vectors], object)


class Block:
    """Rows of a block with one sorted list per dimension."""

    def __init__(self, keys: np.ndarray, null_key: np.ndarray, rows: np.ndarray) -> None:
        order = np.lexsort((keys, null_key))  # places in key order, so that of equal scores the smaller place counts
        self.keys, self.null_key, self.rows = keys[order], null_key[order], rows[order]
        self.size = float(max((abs(x) for x in (rows.min(), rows.max())), default=0)) if rows.size else 0.0
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)  # per dimension, smallest first
        self.lists = np.take_along_axis(self.rows.T, self.order, axis=1) if rows.size else self.rows.T

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best rows for the query, best first."""
        n, dims = self.rows.shape
        rows, lists = self.rows, self.lists
        exact = rows.dtype != object and query.dtype != object and max(dims, 1) * self.size * float(np.abs(query).max(initial=0)) < EXACT
        if not exact:
            rows, lists, query = (np.frompyfunc(int, 1, 1)(x) for x in (rows, lists, query))
        product = (lambda x: x @ query) if exact else (lambda x: np.clip(x @ query, -LONGEST, LONGEST).astype(np.int64))
        up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        scored = (self.keys == own) & ~self.null_key  # the query's own rows are no candidates
        seen = scored.copy()
        best_at, best = np.zeros(0, np.int64), product(rows[:0])
        depth, step = 0, FIRST_DEPTH
        while True:
            end = min(depth + step, n)
            seen[self.order[up, depth:end].ravel()] = True
            seen[self.order[down, n - end : n - depth].ravel()] = True
            if end == n:
                seen[:] = True  # nothing is left, also for a query of zeros
            new = np.flatnonzero(seen & ~scored)
            scored |= seen
            if len(new):
                at, score = np.concatenate((best_at, new)), np.concatenate((best, product(rows[new])))
                keep = np.lexsort((at, -score))[:k]
                best_at, best = at[keep], score[keep]
            if end == n:
                return best_at, best
            if len(best) == k:
                if lists[up, end] @ query[up] + lists[down, n - 1 - end] @ query[down] < best[-1]:
                    return best_at, best
            depth, step = end, end


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition (_block, _kind, _key, _sign, _vector): a block's rows, then its queries."""
    held: list[tuple] = []
    block, number = None, None
    for batch in batches:
        numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = (np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if b == a:
                continue
            keys, vectors = batch.column(2).slice(a, b - a), batch.column(4).slice(a, b - a).to_pylist()
            if number != numbers[a]:
                number, held, block = numbers[a], [], None
            if kinds[a] == 0:
                held.append((keys.fill_null(LONGEST).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), vectors))
                continue
            if block is None:
                if not held:
                    continue
                stored = [v for part in held for v in part[2]]
                block = Block(np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held]), integers(stored, max(map(len, stored))))
                held = []
            width = block.rows.shape[1]
            signs, out = batch.column(3).slice(a, b - a).to_pylist(), []
            for own, sign, query in zip(keys.to_pylist(), signs, integers([v[:width] for v in vectors], width)):
                places, scores = block.top(query, own, k)
                found = [None if null else key for key, null in zip(block.keys[places].tolist(), block.null_key[places])]
                out += [(own, sign, key, int(score)) for key, score in zip(found, scores)]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "_sign", "vec_id", "score"])


def top_k(df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for every row for which `queries` is true."""
    spark = df.sparkSession
    one, none = F.col(f"`{vector}`"), F.lit(None).cast("long")
    rows = cut(df.filter(usable(one)).select(F.col(f"`{key}`").cast("long").alias("_key"), one.cast("array<double>").alias("_vector"), F.coalesce(queries, F.lit(False)).alias("_asks")))
    n_rows, width = rows.count(), shuffle_width(spark)
    blocks = max(math.ceil(n_rows / BLOCK_ROWS), min(width, math.ceil(n_rows / LEAST_ROWS)), 1)
    block = F.pmod(F.xxhash64("_key", "_vector"), F.lit(blocks)).cast("int")
    stored = rows.select(block.alias("_block"), F.lit(0).alias("_kind"), "_key", none.alias("_sign"), "_vector")
    asked = rows.filter(F.col("_asks") & F.col("_key").isNotNull()).withColumn("_sign", F.xxhash64("_vector")).dropDuplicates(["_key", "_sign"])
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(1).alias("_kind"), "_key", "_sign", "_vector")
    dealt = stored.unionByName(asked).repartitionByRange(min(blocks, 4 * width), "_block").sortWithinPartitions("_block", "_kind")
    found = lean(dealt).mapInArrow(lambda batches: _search(batches, k), FOUND)
    best = Window.partitionBy("query_id", "_sign").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
