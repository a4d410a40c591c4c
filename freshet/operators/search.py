"""Inverted index and bm25-ranked phrase search."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import vocab
from freshet.functions.scalars import freshness_cutoff
from freshet.functions.text import let, runs, strip_marks, tokens, unaccent
from freshet.operators.listing import SearchRequest, list_order, page, total
from freshet.session import cut

# The usual bm25 constants and the floor for very common phrases.
BM25_K1, BM25_B, BM25_MIN_IDF = 1.2, 0.75, 1e-6
PREFIX_MIN = 2
RUN_WORDS = 1 << 21  # words sorted at once in a task; one document of more words is sorted by itself
BATCH_ROWS = 1 << 16  # rows handed back to Spark at once


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens; with `prefix`, the (only) token may continue."""

    terms: tuple[str, ...]
    prefix: bool = False


def _searchable(char: str) -> bool:
    return unicodedata.category(char)[0] in "LN"


def _split_tokens(text: str) -> tuple[str, ...]:
    plain = strip_marks(text, "NFD").lower()
    return tuple("".join(c if _searchable(c) else " " for c in plain).split())


def read_query(raw: str) -> list[Phrase]:
    """phrases that must all match; empty when nothing in the text is searchable."""
    words = [w for w in raw.split() if any(map(_searchable, w))]
    phrases = []
    for position, word in enumerate(words):
        whole = len(word) >= PREFIX_MIN and all(map(_searchable, word))
        phrases.append(Phrase(_split_tokens(word), whole and position == len(words) - 1))
    return [p for p in phrases if p.terms]


@dataclass(frozen=True)
class SearchIndex:
    terms: DataFrame  # doc_id, field, term, length, positions
    lengths: DataFrame  # doc_id, length (tokens of every indexed field)
    summary: DataFrame | None = None  # one row: n, total; where it is kept, no search reads the lengths
    # Terms and lengths from one pass over the texts: rows without a field and a term are those of `lengths`, the
    # others those of `terms`, in runs that are sorted by term.
    rows: DataFrame | None = None

    def stats(self) -> tuple[int, float]:
        """Number of documents and mean length, one row."""
        n, total = (self.summary or summary_of(self.lengths)).first()
        return n, total / n if n else 0.0


def summary_of(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"))


def store_index(index: SearchIndex, folder: str) -> None:
    """Write an index for searching by term: terms in ranges, sorted, so that a search opens only the row
    groups whose statistics admit its words; each row carries its document's length. A common term has
    as many ranges as its documents need. The terms are written before, as finding the ranges reads them once more."""
    cut(index.terms).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{folder}/terms")
    index.lengths.write.parquet(f"{folder}/lengths")
    lengths = index.lengths.sparkSession.read.parquet(f"{folder}/lengths")
    summary_of(lengths).coalesce(1).write.parquet(f"{folder}/summary")


def stored_index(spark: SparkSession, folder: str) -> SearchIndex:
    return SearchIndex(*[spark.read.parquet(f"{folder}/{name}") for name in ("terms", "lengths", "summary")])


def _term_places(lists: Column) -> Column:
    """Distinct terms of lists of words, each with its places in order (term, positions)."""
    def placed(words: Column) -> Column:
        return F.transform(words, lambda term, pos: F.struct(term.alias("term"), pos.alias("pos")))

    def starts(every: Column) -> Column:
        """Where another term begins."""
        return F.filter(
            F.transform(every, lambda _, at: at), lambda at: (at == 0) | (F.get(every, at)["term"] != F.get(every, at - 1)["term"])
        )

    def cut_at(every: Column, first: Column) -> Column:
        def term(at: Column, k: Column) -> Column:
            own = F.slice(every, at + 1, F.coalesce(F.get(first, k + 1), F.size(every)) - at)
            return F.struct(F.get(every, at)["term"].alias("term"), F.transform(own, lambda p: p["pos"]).alias("positions"))

        return F.transform(first, term)

    return let(F.sort_array(F.flatten(F.transform(lists, placed))), lambda every: let(starts(every), lambda first: cut_at(every, first)))


def _stable_order(values: np.ndarray) -> np.ndarray:
    """`argsort` of numbers from 0 on, equal ones as they stand: by 16 bits at a time, which numpy sorts by counting."""
    by = np.argsort(values.astype(np.uint16), kind="stable")
    shift = 16
    while int(values.max(initial=0)) >> shift:
        by = by[np.argsort((values[by] >> shift).astype(np.uint16), kind="stable")]
        shift += 16
    return by


def _run_of(batches: Sequence[pa.RecordBatch], fields: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows of `SearchIndex.rows` for some documents: their lengths, then the terms of each field in order.

    The batches have doc_id and per field the words of each of the document's rows.
    """
    every = pa.Table.from_batches(batches).combine_chunks()
    ids, *texts = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in every.columns]
    n = len(ids)
    n_rows = pa.compute.list_value_length(texts[0]).to_numpy(zero_copy_only=False).astype(np.int64)
    doc_of_row, first = np.repeat(np.arange(n), n_rows), np.cumsum(n_rows) - n_rows
    lists = [t.flatten() for t in texts]
    sizes = [pa.compute.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    length = np.sum(sizes, axis=0)

    def batch(docs: np.ndarray, field: str | None, terms: pa.Array, lengths: np.ndarray, positions: pa.Array) -> Iterator[pa.RecordBatch]:
        names = pa.repeat(pa.scalar(field, pa.string()), len(docs))
        out = pa.RecordBatch.from_arrays(
            [ids.take(pa.array(docs)), names, terms.cast(pa.string()), pa.array(lengths), positions], ["doc_id", "field", "term", "length", "positions"])
        for start in range(0, len(docs), BATCH_ROWS):
            yield out.slice(start, BATCH_ROWS)

    every_row = len(length)
    yield from batch(doc_of_row, None, pa.nulls(every_row, pa.string()), length, pa.nulls(every_row, pa.list_(pa.int32())))
    for field, rows, size in zip(fields, lists, sizes):
        words = rows.flatten().dictionary_encode()
        if not len(words):
            continue
        known = words.dictionary
        order = pa.compute.sort_indices(known).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
        term, doc = rank[words.indices.to_numpy()], np.repeat(doc_of_row, size)
        # Words come by document, those of a document's one row by place.
        by = _stable_order(term) if every_row == n else np.lexsort((place, doc, term))
        term, doc = term[by], doc[by]
        starts = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))))
        docs, terms = doc[starts], known.take(pa.array(order[term[starts]]))
        positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(by)), pa.int32()), pa.array(place[by], pa.int32()))
        yield from batch(docs, field, terms, length[first[docs]], positions)


def _sorted_runs(fields: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows + sum(len(c.flatten().flatten()) for c in batch.columns[1:])
            if size >= RUN_WORDS:
                yield from _run_of(held, fields)
                held, size = [], 0
        if held:
            yield from _run_of(held, fields)

    return run


def build_index(docs: DataFrame, id_col: str, fields: Sequence[str], unsearched: Sequence[str] = ()) -> SearchIndex:
    """K8: term positions per document and field.

    Whole documents move by id, also where they come as one split; rows of one id are one document. Its
    words are sorted inside its own row, so neither the network nor a grouping sees single tokens.
    """
    every = (*fields, *unsearched)
    none = F.array().cast("array<string>")
    plain = docs.repartition(id_col).select(F.col(id_col).alias("doc_id"), F.struct(*[unaccent(F.col(f).cast("string")).alias(f"t{i}") for i, f in enumerate(every)]).alias("texts"))

    def words(i: int) -> Callable[[Column], Column]:
        return lambda texts: F.coalesce(runs(texts[f"t{i}"]), none)

    def length(texts: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.size(words(i)(texts)) for i in range(len(every))]).cast("long")

    whole = plain.groupBy("doc_id").agg(F.collect_list("texts").alias("rows"))
    split = whole.select("doc_id", *[F.transform("rows", words(i)).alias(f"w{i}") for i in range(len(every))])
    size = reduce(lambda a, b: a + b, [F.size(F.col(f"w{i}")[0]) for i in range(len(every))]).cast("long").alias("length")
    per_field = F.array(*[F.struct(F.lit(f).alias("field"), _term_places(F.col(f"w{i}")).alias("terms")) for i, f in enumerate(fields)])
    found = split.select("doc_id", size, F.explode(per_field).alias("f"))
    terms = found.select("doc_id", "f.field", "length", F.explode("f.terms").alias("t")).select("doc_id", "field", "t.term", "length", "t.positions")
    kind = plain.schema["doc_id"].dataType.simpleString()
    rows = split.mapInArrow(_sorted_runs(fields), f"doc_id {kind}, field string, term string, length bigint, positions array<int>")
    return SearchIndex(terms, plain.select("doc_id", length(F.col("texts")).alias("length")), rows=rows)


def index_rows(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored rows of the given ids, to be indexed again."""
    return postings.join(ids.select("id"), "id", "left_semi")


def update_index(index: SearchIndex, touched: SearchIndex, touched_ids: DataFrame) -> SearchIndex:
    """K7: drop the rows of the touched documents, add their new rows. `touched_ids` has `doc_id`."""
    return SearchIndex(
        index.terms.join(touched_ids, "doc_id", "left_anti").unionByName(touched.terms),
        index.lengths.join(touched_ids, "doc_id", "left_anti").unionByName(touched.lengths),
    )


def _term_filter(phrases: Sequence[Phrase]) -> Column:
    exact = sorted({t for p in phrases if not p.prefix for t in p.terms})
    tests = [F.col("term").isin(*exact)] if exact else []
    tests += [F.col("term").startswith(p.terms[0]) for p in phrases if p.prefix]
    return reduce(lambda a, b: a | b, tests)


def _moved_back(positions: Column, step: int) -> Column:
    return F.transform(positions, lambda p: p - step)


def _occurrences(phrase: Phrase, places: dict[str, Column]) -> Column:
    """How often a phrase stands in one field of one document."""
    starts = places[phrase.terms[0]]
    for step, term in enumerate(phrase.terms[1:], start=1):
        starts = F.array_intersect(starts, _moved_back(places[term], step))
    return F.coalesce(F.size(starts), F.lit(0)).cast("long")


def _places_by_term(terms: Sequence[str], prefix: str) -> dict[str, Column]:
    return {t: F.col(f"{prefix}{i}") for i, t in enumerate(terms)}


def _exact_terms(phrases: Sequence[Phrase]) -> list[str]:
    return sorted({t for p in phrases if not p.prefix for t in p.terms})


def phrase_counts(index: SearchIndex, phrases: Sequence[Phrase], title: str, fields: Sequence[str]) -> DataFrame:
    """Per document: occurrences of phrase i in the title (t_i) and in all searched fields (a_i)."""
    hits = index.terms.filter(F.col("field").isin(*fields) & _term_filter(phrases))
    exact = _exact_terms(phrases)
    term = F.col("term")
    found = [F.max(F.when(term == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(exact)]
    found += [
        F.sum(F.when(term.startswith(p.terms[0]), F.size("positions")).otherwise(0)).alias(f"x{i}")
        for i, p in enumerate(phrases) if p.prefix
    ]
    per_field = hits.groupBy("doc_id", "field").agg(F.first("length").alias("length"), *found)
    places = _places_by_term(exact, "p")
    counts = [F.col(f"x{i}") if p.prefix else _occurrences(p, places) for i, p in enumerate(phrases)]
    in_title = F.col("field") == title
    per_field = per_field.select("doc_id", "field", "length", *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    return per_field.groupBy("doc_id").agg(
        F.first("length").alias("length"),
        *[F.sum(F.when(in_title, F.col(f"c{i}")).otherwise(0)).alias(f"t{i}") for i in range(len(counts))],
        *[F.sum(f"c{i}").alias(f"a{i}") for i in range(len(counts))],
    )


def _count_in(words: Column, phrase: Phrase) -> Column:
    """Occurrences of a phrase in an array of words."""
    if phrase.prefix:
        return F.size(F.filter(words, lambda w: w.startswith(phrase.terms[0]))).cast("long")
    if len(phrase.terms) == 1:
        return F.size(F.filter(words, lambda w: w == phrase.terms[0])).cast("long")

    def starts(word: Column, at: Column) -> Column:
        rest = [F.get(words, at + k) == t for k, t in enumerate(phrase.terms) if k]
        return reduce(lambda a, b: a & b, [word == phrase.terms[0], *rest])

    return F.size(F.filter(words, starts)).cast("long")


@dataclass(frozen=True)
class TextScan:
    """Search without an index: one pass over the documents, no shuffle.

    For a single query over texts that have no stored index; an index pays off when it is kept.
    """

    docs: DataFrame
    id_col: str
    fields: Sequence[str]
    unsearched: Sequence[str] = ()

    def counts(self, phrases: Sequence[Phrase], title: str) -> DataFrame:
        """Every document with its length and the columns of `phrase_counts`."""
        every = (*self.fields, *self.unsearched)
        none = F.array().cast("array<string>")
        words = self.docs.select(
            F.col(self.id_col).alias("doc_id"),
            *[F.coalesce(tokens(F.col(f).cast("string")), none).alias(f"w{j}") for j, f in enumerate(every)],
        )
        searched = range(len(self.fields))
        in_title = F.col(f"w{list(self.fields).index(title)}")

        def add(parts: list[Column]) -> Column:
            return reduce(lambda a, b: a + b, parts)

        return words.select(
            "doc_id", add([F.size(f"w{j}") for j in range(len(every))]).cast("long").alias("length"),
            *[_count_in(in_title, p).alias(f"t{i}") for i, p in enumerate(phrases)],
            *[add([_count_in(F.col(f"w{j}"), p) for j in searched]).alias(f"a{i}") for i, p in enumerate(phrases)],
        )


def _every_phrase(phrases: Sequence[Phrase]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"a{i}") > 0 for i in range(len(phrases))])


def match_ids(source: SearchIndex | TextScan, phrases: Sequence[Phrase], title: str, fields: Sequence[str]) -> DataFrame:
    """Documents in which every phrase stands somewhere; none for an empty query."""
    if not phrases:
        ids = source.docs.select(F.col(source.id_col).alias("doc_id")) if isinstance(source, TextScan) else source.lengths.select("doc_id")
        return ids.filter(F.lit(False))
    counts = source.counts(phrases, title) if isinstance(source, TextScan) else phrase_counts(source, phrases, title, fields)
    return counts.filter(_every_phrase(phrases)).select("doc_id")


def bm25(source: SearchIndex | TextScan, phrases: Sequence[Phrase], title: str, fields: Sequence[str]) -> DataFrame:
    """(doc_id, title_score, score), lower is better, for documents matching every phrase."""
    if not phrases:
        return match_ids(source, phrases, title, fields).select(
            "doc_id", F.lit(0.0).alias("title_score"), F.lit(0.0).alias("score"))
    wide = range(len(phrases))
    having = [F.count_if(F.col(f"a{i}") > 0) for i in wide]
    # The counts are read twice, for the statistics and for the scores, so they are written once: a
    # few numbers per document.
    if isinstance(source, TextScan):
        counts = cut(source.counts(phrases, title))
        n_docs, mean, *found = counts.agg(F.count("*"), F.avg("length"), *having).first()
        matched = counts.filter(_every_phrase(phrases))
    else:
        counts = cut(phrase_counts(source, phrases, title, fields))
        (n_docs, mean), found = source.stats(), counts.agg(*having).first()
        matched = counts.filter(_every_phrase(phrases))
    idf = [math.log((n_docs - n + 0.5) / (n + 0.5)) for n in found]
    idf = [x if x > 0 else BM25_MIN_IDF for x in idf]
    norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("length") / F.lit(mean or 1.0))

    def scored(kind: str) -> Column:
        parts = [F.lit(idf[i]) * F.col(f"{kind}{i}") * (BM25_K1 + 1) / (F.col(f"{kind}{i}") + norm) for i in wide]
        return -reduce(lambda a, b: a + b, parts)

    return matched.select("doc_id", scored("t").alias("title_score"), scored("a").alias("score"))


def boost(posted_at: Column, cutoff: datetime, days: int) -> Column:
    """1 at the cutoff, about 2 for a posting of today."""
    micros = F.unix_micros(posted_at) - F.unix_micros(F.lit(cutoff))
    return 1 + micros / F.lit(86400e6) / F.lit(days)


def ranked(postings: DataFrame, scores: DataFrame, as_of: datetime, days: int = vocab.FRESHNESS_DAYS) -> DataFrame:
    """Filtered postings with their freshness-weighted scores."""
    fresher = boost(F.col("posted_at"), freshness_cutoff(as_of, days), days)
    return postings.join(scores.withColumnRenamed("doc_id", "id"), "id").withColumns({
        "title_rank": F.col("title_score") * fresher,
        "rank": F.col("score") * fresher,
    })


def relevance_order() -> list[Column]:
    return [F.asc("title_rank"), F.asc("rank"), F.desc("id")]


def search(
    postings: DataFrame,
    index: SearchIndex | TextScan,
    request: SearchRequest,
    as_of: datetime,
    title: str,
    fields: Sequence[str],
    days: int = vocab.FRESHNESS_DAYS,
) -> tuple[DataFrame, DataFrame | None]:
    """A ranked or sorted page of already filtered postings, and the total on the first page."""
    phrases = read_query(request.q)
    rows = postings
    if request.q and phrases and not request.sort:
        rows = ranked(postings, bm25(index, phrases, title, fields), as_of, days)
        order = relevance_order()
    else:
        if request.q:
            found = match_ids(index, phrases, title, fields)
            rows = postings.join(found.withColumnRenamed("doc_id", "id"), "id", "left_semi")
        order = list_order(request.sort)
    return page(rows, order, request), (total(rows) if request.offset == 0 else None)
