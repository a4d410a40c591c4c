"""Jaccard join of shingle sets over signature trees.

A document's set holds the distinct shingles of `SHINGLE` words (fewer words: the whole sequence).
Two sets link when they share at least SHARE percent of their union.

1. Sets are marked by an order-free 64-bit hash; copies are one set from here on.
2. Linked sets must share one of the first n - ceil(n * SHARE / 100) + 1 shingles of each in any common
   order. The order is rare first: a table of RARITY_BUCKETS counters, filled from the shingles that
   repeat within a task, ranks them; the shuffle groups sets by these shingles, and groups are cut where
   sizes part by more than the share. The set of least mark is the hub of its group; all groups of a hub
   are one neighbourhood, to which every text goes once. A neighbourhood of more than RUN sets is dealt
   out as pairs of hashed parts, each in a task of its own.
3. A neighbourhood is searched through signature trees, first over narrow bitmaps, which tell the sets
   that may link with any other and whose texts are worth moving, then over wide ones. In a tree, nodes
   hold the OR-combined bitmaps of their sets' shingles, the bits that all of them have, and the range
   of their sizes. Dual traversal goes down pairs of nodes and drops a pair when the greatest overlap
   that bitmaps and sizes allow is less than the least sizes need, or when both lie within one component.
   Pairs of sets that are left are checked exactly. First the hub is compared with all; then sets of one
   component stand together, so that a group of near copies is joined up without comparing all its pairs.
4. Links of all neighbourhoods are contracted to components. A pair that links shares a group and so a
   neighbourhood, where it was checked unless both were connected by checked links: no link is lost.

Defined cases: null text, and text without words, has an empty set, which links with nothing; a null key
takes part, and the least key of a component leaves nulls out unless there are only nulls; repeated rows
get a row each; an empty table gives no row; other columns are ignored. Equality of shingles and sets
is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.session import cut

SHINGLE, SHARE = 5, 75
WORD_BYTES = common.byte_class([(0x20, 0x20), (0x09, 0x0D)])
RARITY_BUCKETS = 1 << 20
RARITY_ROWS = 2_000_000  # shingles compared for repeats at once in a task
LEAST_REPEATS = 8
FILTER_BITS = 1 << 21  # of members' marks, to leave other texts out before a shuffle
BITS_PER_SHINGLE = 4
RUN = 4096
FAN = 8
SEEN_MOST = 1_000_000


def sets_of(data: list[bytes]) -> list[np.ndarray]:
    """Sorted shingle hashes of each text."""
    hashed, bounds = common.words(data, WORD_BYTES)
    whole = common.grams(hashed, SHINGLE)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= SHINGLE:
            one = np.sort(whole[a : b - SHINGLE + 1])
            out.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
        else:
            out.append(common.grams(hashed[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def mark_of(one: np.ndarray) -> int:
    """Order-free hash of a set."""
    return int(np.bitwise_xor.reduce(common.mix(one * np.uint64(0x9FB21C651E98DF25))).view(np.int64)) ^ len(one) if len(one) else 0


def prefix_size(n: int) -> int:
    return n - -(-n * SHARE // 100) + 1


def bitmap_of(one: np.ndarray, per_shingle: int = BITS_PER_SHINGLE) -> np.ndarray:
    """Bits of the shingles; the width is a power of two, so that a narrower one is the OR of its halves."""
    width = max(64, 1 << (per_shingle * max(len(one), 1) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(one & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: key, sign, mark, size and narrow bitmap of its set; and shingles that repeat within the task."""
    names, held, n_held, seen = ["_key", "_sign", "mark", "n", "bits", "shingle", "repeats"], [], 0, set()

    def repeats() -> pa.RecordBatch:
        every, counts = np.unique(np.concatenate(held), return_counts=True)
        every, counts = every[counts > 1], counts[counts > 1]
        none = pa.nulls(len(every), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(every), pa.binary()), pa.array(every.view(np.int64)), pa.array(counts)], names)

    for (keys, signs), data in common.chunks(batches):
        found = sets_of(data)
        marks = [mark_of(x) for x in found]
        rows = [keys.cast(pa.int64()), signs, pa.array(marks, pa.int64()), pa.array([len(x) for x in found], pa.int64())]
        rows.append(pa.array([bitmap_of(x, 1).tobytes() for x in found], pa.binary()))
        yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64())], names)
        for mark, one in zip(marks, found):
            if mark not in seen and len(one):
                seen.add(mark)
                held.append(one)
                n_held += len(one)
        if n_held >= RARITY_ROWS:
            yield repeats()
            held, n_held, seen = [], 0, set()
    if held:
        yield repeats()


def _postings(rarity: np.ndarray) -> Callable:
    """Rows of (shingle, mark, size) for the rarest shingles of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data in common.chunks(batches):
            shingles, marks, sizes = [], [], []
            for one in sets_of(data):
                mark = mark_of(one)
                if not len(one) or mark in seen:
                    continue
                if len(seen) >= SEEN_MOST:
                    seen = set()
                seen.add(mark)
                rank = rarity[(one & np.uint64(RARITY_BUCKETS - 1)).astype(np.int64)]
                first = one[np.argsort(rank, kind="stable")[: prefix_size(len(one))]]
                shingles.append(first)
                marks.append(np.full(len(first), mark, np.int64))
                sizes.append(np.full(len(first), len(one), np.int32))
            if shingles:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(marks)), pa.array(np.concatenate(sizes))], ["shingle", "mark", "n"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, mark) of sets that share a shingle, from rows in order of shingle, size and mark."""

    def cut_up(s: np.ndarray, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])))
        s, k, n = s[fresh], k[fresh], n[fresh].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (n[:-1] * 100 < n[1:] * SHARE))))
        sizes = np.diff(np.append(starts, len(s)))
        several = np.repeat(sizes > 1, sizes)
        pairs = np.stack((np.repeat(np.minimum.reduceat(k, starts), sizes)[several], k[several]), axis=1)
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["hub", "mark"])

    held: list[tuple[np.ndarray, ...]] = []
    n_held = 0
    for batch in batches:
        s, k, n = (batch.column(i).to_numpy() for i in range(3))
        if not len(s):
            continue
        last = np.searchsorted(s, s[-1])  # rows of the last shingle wait for the next batch
        if last and n_held + last >= 100_000:
            yield cut_up(*(np.concatenate(x) for x in zip(*held, (s[:last], k[:last], n[:last]))))
            held, n_held = [(s[last:], k[last:], n[last:])], len(s) - last
        else:
            held.append((s, k, n))
            n_held += len(s)
    if held:
        yield cut_up(*(np.concatenate(x) for x in zip(*held)))


def _member_texts(wanted: np.ndarray) -> Callable:
    """mark and text of the sets whose marks may be wanted; copies once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data in common.chunks(batches):
            rows = []
            for one, text in zip(sets_of(data), data):
                mark = mark_of(one)
                if not len(one) or not wanted[mark & (FILTER_BITS - 1)] or mark in seen:
                    continue
                if len(seen) >= SEEN_MOST:
                    seen = set()
                seen.add(mark)
                rows.append((mark, text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], ["mark", "text"])

    return run


class Tree:
    """A signature tree over sets in their given order: FAN children to a node."""

    def __init__(self, sizes: np.ndarray, bits: list[np.ndarray], component: np.ndarray) -> None:
        words = min(len(b) for b in bits)
        any_ = np.stack([fold(b, words) for b in bits])
        self.levels = [(any_, any_, sizes, sizes, component)]  # OR, AND, least and greatest size, component (-1: several)
        while len(self.levels[-1][2]) > 1:
            any_, all_, low, high, part = self.levels[-1]
            starts = np.arange(0, len(low), FAN)
            one = np.minimum.reduceat(part, starts)
            same = one == np.maximum.reduceat(part, starts)
            self.levels.append((
                np.bitwise_or.reduceat(any_, starts), np.bitwise_and.reduceat(all_, starts), np.minimum.reduceat(low, starts),
                np.maximum.reduceat(high, starts), np.where(same, one, -1),
            ))

    def _open(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which node pairs may hold a link between different components."""
        any_, all_, low, high, part = self.levels[level]
        keep = (part[i] != part[j]) | (part[i] < 0)
        need = SHARE * (low[i] + low[j])  # overlap * (100 + SHARE) has to reach this
        keep &= (100 + SHARE) * np.minimum(high[i], high[j]) >= need
        at = np.flatnonzero(keep)
        for a in range(0, len(at), 20_000):
            p = at[a : a + 20_000]
            x, y = i[p], j[p]
            left = high[x] - np.bitwise_count(all_[x] & ~any_[y]).sum(axis=1, dtype=np.int64)
            right = high[y] - np.bitwise_count(all_[y] & ~any_[x]).sum(axis=1, dtype=np.int64)
            keep[p] = (100 + SHARE) * np.minimum(left, right) >= need[p]
        return keep

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Dual traversal: pairs of sets (i < j) in different components that may link."""
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            n = len(self.levels[level - 1][2])
            out = []
            for a in range(0, len(i), 10_000):
                x = (i[a : a + 10_000, None, None] * FAN + np.arange(FAN)[None, :, None]).repeat(FAN, axis=2).ravel()
                y = (j[a : a + 10_000, None, None] * FAN + np.arange(FAN)[None, None, :]).repeat(FAN, axis=1).ravel()
                fits = (x < n) & (y < n) & ((x < y) if level == 1 else (x <= y))
                x, y = x[fits], y[fits]
                keep = self._open(level - 1, x, y)
                out.append((x[keep], y[keep]))
            i, j = (np.concatenate(z) for z in zip(*out)) if out else (i[:0], j[:0])
        return (i, j) if len(self.levels) > 1 else (i[:0], j[:0])


class Neighbourhood:
    """Sets that may link with one another, and what is known to link."""

    def __init__(self, marks: list[int], sets: list[np.ndarray]) -> None:
        order = sorted(range(len(marks)), key=lambda i: len(sets[i]))
        self.marks, self.sets = [marks[i] for i in order], [sets[i] for i in order]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        self.bits = [bitmap_of(x) for x in self.sets]
        self.up = list(range(len(marks)))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def check(self, i: int, others: np.ndarray) -> Iterator[tuple[int, int]]:
        """Exact: which of the others link with set i."""
        others = np.array([j for j in others.tolist() if self.top(j) != self.top(i)], np.int64)
        for a in range(0, len(others), 500):
            some = others[a : a + 500]
            one, flat = self.sets[i], np.concatenate([self.sets[j] for j in some])
            shared = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
            sizes = self.sizes[some]
            shared = np.add.reduceat(shared.astype(np.int64), np.cumsum(sizes) - sizes)
            for j in some[100 * shared >= SHARE * (len(one) + sizes - shared)].tolist():
                if self.top(i) != self.top(j):
                    self.up[self.top(j)] = self.top(i)
                yield self.marks[i], self.marks[j]

    def links(self) -> Iterator[tuple[int, int]]:
        """Links that connect all that is linked."""
        n = len(self.marks)
        tree = Tree(self.sizes, self.bits, np.arange(n))
        hub = self.marks.index(min(self.marks))
        others = np.delete(np.arange(n), hub)
        yield from self.check(hub, others[tree._open(0, np.full(n - 1, hub), others)])
        parts = np.array([self.top(i) for i in range(n)])
        if (parts == parts[0]).all():
            return
        order = np.lexsort((self.sizes, parts))
        i, j = Tree(self.sizes[order], [self.bits[k] for k in order], parts[order]).pairs()
        i, j = order[i], order[j]
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        starts = np.flatnonzero(np.concatenate((np.ones(min(len(i), 1), bool), i[1:] != i[:-1])))
        for a, b in zip(starts, np.append(starts[1:], len(i))):
            yield from self.check(int(i[a]), j[a:b])


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of a neighbourhood that narrow bitmaps leave at least one partner; rows (hub, part, other, mark,
    n, bits) in order of the first three."""

    def left(held: list[tuple]) -> list[int]:
        if len(held) < 2:
            return []
        held = sorted(held, key=lambda h: h[1])
        tree = Tree(np.array([h[1] for h in held], np.int64), [np.frombuffer(h[2], np.uint64) for h in held], np.arange(len(held)))
        return [held[i][0] for i in np.unique(np.concatenate(tree.pairs())).tolist()]

    held: list[tuple] = []
    last: tuple | None = None
    for batch in batches:
        out: list[tuple] = []
        for *name, mark, n, bits in zip(*(c.to_pylist() for c in batch.columns)):
            if tuple(name) != last and held:
                out.extend((*last, x) for x in left(held))
                held = []
            last = tuple(name)
            held.append((mark, n, bits))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _NAMED)], ["hub", "part", "other", "mark"])
    if out := [(*last, x) for x in left(held)] if held else []:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _NAMED)], ["hub", "part", "other", "mark"])


_NAMED = (pa.int64(), pa.int32(), pa.int32(), pa.int64())


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of neighbourhoods; rows (hub, part, other, mark, text) in order of the first three."""
    held: list[tuple[int, np.ndarray]] = []
    last: tuple | None = None
    out: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        out.clear()
        return batch

    for keys, data in common.chunks(batches):
        names = list(zip(*(k.to_pylist() for k in keys[:3])))
        for name, mark, one in zip(names, keys[3].to_pylist(), sets_of(data)):
            if name != last and held:
                out.extend(Neighbourhood(*map(list, zip(*held))).links() if len(held) > 1 else ())
                held = []
            last = name
            held.append((mark, one))
        if len(out) > 50_000:
            yield flush()
    if len(held) > 1:
        out.extend(Neighbourhood(*map(list, zip(*held))).links())
    if out:
        yield flush()


def contract(links: DataFrame) -> DataFrame:
    """(mark, component) of every mark in `links` (a, b): the least mark reachable.

    Every round each vertex points to the least of its neighbours and itself, pointers are followed one
    step further, and the edges are those between what is pointed at; vertices at least halve.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    found = cut(edges.select(F.col("a").alias("mark")).union(edges.select("b")).distinct().withColumn("component", F.col("mark")))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        point = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p")))
        ahead = point.select(F.col("v").alias("p"), F.col("p").alias("q"))
        point = cut(point.join(ahead, "p").select("v", F.col("q").alias("p")))
        found = cut(found.join(point, found["component"] == point["v"], "left").select("mark", F.coalesce("p", "component").alias("component")))
        pa_, pb_ = point.select(F.col("v").alias("a"), F.col("p").alias("pa")), point.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = cut(
            edges.join(pa_, "a").join(pb_, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .filter(F.col("a") != F.col("b")).distinct()
        )
    return found


def rarity_table(survey: DataFrame) -> np.ndarray:
    """A rank for each bucket of shingles, from the repeats found in tasks: at most RARITY_BUCKETS counters."""
    counts = survey.filter(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("repeats").alias("n")).filter(F.col("n") >= LEAST_REPEATS)
    buckets = counts.groupBy(F.col("shingle").bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int").alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY_BUCKETS, np.uint8)
    out[buckets["bucket"].to_numpy()] = np.minimum(1 + 6 * np.log2(buckets["n"].to_numpy()), 255).astype(np.uint8)
    return out


def links_of(df: DataFrame, survey: DataFrame, key: str, text: str) -> DataFrame:
    """Links (a, b) between marks that connect every two sets that link, directly or through others."""
    rows = common.texts(df, key, text)
    postings = rows.mapInArrow(_postings(rarity_table(survey)), "shingle long, mark long, n int")
    grouped = postings.repartition("shingle").sortWithinPartitions("shingle", "n", "mark")
    near = cut(grouped.mapInArrow(_neighbours, "hub long, mark long").distinct())
    # A neighbourhood in k parts is searched as all pairs of parts; most have one.
    parts = near.groupBy("hub").agg(F.ceil(F.count("*") / RUN).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("mark"), F.col("k")).cast("int")
    placed = near.join(parts, "hub").withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    placed = placed.select("hub", F.least("own", "with").alias("part"), F.greatest("own", "with").alias("other"), "mark")
    name = ["hub", "part", "other"]
    narrow = survey.filter(F.col("bits").isNotNull()).select("mark", "n", "bits").join(near.select("mark").distinct(), "mark", "left_semi").dropDuplicates(["mark"])
    signed = placed.join(narrow, "mark").select(*name, "mark", "n", "bits").repartition(*name).sortWithinPartitions(*name)
    # Most sets that share a rare shingle share little else: only the others' texts are moved.
    near = cut(signed.mapInArrow(_survivors, "hub long, part int, other int, mark long"))
    wanted = np.zeros(FILTER_BITS, bool)
    wanted[near.select(F.col("mark").bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int").alias("bucket")).distinct().toArrow()["bucket"].to_numpy()] = True
    texts = rows.mapInArrow(_member_texts(wanted), "mark long, text binary").dropDuplicates(["mark"])
    dealt = near.join(texts, "mark").select(*name, "mark", "text").repartition(*name)
    return cut(dealt.sortWithinPartitions(*name).mapInArrow(_search, "a long, b long"))


def _placed(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row: _key, _sign (hash of the text), n (set size), component (null for an empty set)."""
    texts = common.texts(df, key, text).select("_key", F.xxhash64("_text").alias("_sign"), "_text")
    survey = cut(texts.mapInArrow(_survey, "_key long, _sign long, mark long, n long, bits binary, shingle long, repeats long"))
    found = contract(links_of(df, survey, key, text)).withColumnRenamed("mark", "_mark")
    rows = survey.filter(F.col("shingle").isNull()).select("_key", "_sign", "mark", "n")
    part = F.when(F.col("n") > 0, F.coalesce("component", "mark"))
    return cut(rows.join(found, rows["mark"] == found["_mark"], "left").select("_key", "_sign", "n", part.alias("component")))


def components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, n_shingles, component_id (least key reachable by links, its own included)."""
    placed = _placed(df, key, text)
    least = placed.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("_key").alias("component_id"))
    return placed.join(least, "component", "left").select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_key").alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group that links, directly or through others: that of least key, of equal keys by hash of
    the text, of equal rows any one. Null keys come last. Rows without words all stay.
    """
    placed = _placed(df, key, text).filter(F.col("component").isNotNull())
    each = placed.groupBy("component", "_key", "_sign").agg(F.count("*").alias("copies"))
    first = each.groupBy("component").agg(F.min(F.struct(F.col("_key").isNull().alias("no"), "_key", "_sign")).alias("first"))
    several = each.groupBy("component").agg(F.sum("copies").alias("n")).filter(F.col("n") > 1).select("component")
    met = cut(each.join(several, "component", "left_semi").join(first, "component"))
    same = F.col("_key").eqNullSafe(F.col("first._key")) & (F.col("_sign") == F.col("first._sign"))
    kept = common.without(df, met.filter(~same), key, text)
    again = met.filter(same & (F.col("copies") > 1))
    if again.isEmpty():
        return kept
    return common.without(kept, again, key, text).unionByName(common.among(kept, again, key, text).dropDuplicates([key, text]))
