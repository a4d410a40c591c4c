"""Alignment of the tokens of two tokenizers by the byte offsets where both end a token.

Tokenizer A is a byte-level BPE of the tokenizers library and reads space + text, B a SentencePiece BPE
that puts the space there itself; both then spell the same bytes. The cumulative ends of each become a
dictionary from byte offset to index. Offsets in both dictionaries, sorted, slice both id lists into
groups, and within a group every A and B token that share a byte are linked.

A text is cut where white space ends and both tokenizers begin anew whatever stands around: before a
run of spaces after another character. Every distinct piece between such places is encoded and aligned
once in a task and remembered; groups never reach across, as both end a token there.

How often a pair of ids is linked (in how many documents) is counted over the whole corpus. A task
deals with chunks of documents and writes one row a chunk: the documents' figures and their links as
places in the chunk's list of distinct pairs, and that list with the number of documents of each. The
counts are summed by pair, and every chunk gets back the counts of its own list, so a pair that all
documents hold is one row a chunk, and nothing needs the whole table of pairs.

Defined cases: texts that are null, empty, or hold characters that B spells in other bytes (U+2581)
have no tokens: zeros and an empty hash; strings of special tokens are ordinary text; repeated rows and
equal keys count as documents of their own; texts may be of any length and are taken whole; an empty
table gives no rows; other columns are ignored. Refused: byte-level models with a normaliser or a
pre-tokenizer of their own, SentencePiece models with a space inside a piece.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.session import cut

SPACE = "▁"
KEPT_BYTES = 32 << 20  # size of the text pieces that a task remembers; after that it starts anew
PIECE_BYTES = 64  # what a piece counts for besides its text; it holds some times as much
CHUNK_BYTES = 2 << 20
AT_ONCE = 4096  # pieces encoded and aligned at once
_SPACED = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")  # no white space of Unicode is \S to Python


@dataclass(frozen=True)
class Alignment:
    """Groups and links of two token lists that spell the same bytes.

    ends: byte offsets where both end a token; cut_a, cut_b: tokens before each; links: A id << 32 | B id
    in order; link_ends: the byte offset where each link's shared bytes end.
    """

    ends: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    links: np.ndarray
    link_ends: np.ndarray


def align(ids_a: np.ndarray, ids_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> Alignment:
    """The cumulative ends as dictionaries from offset to index; common keys, sorted, slice both lists.

    Within a slice the ends of both sides part its bytes into stretches that one A and one B token cover:
    each stretch is a link, so a slice of m and n tokens has m + n - 1.
    """
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    at_a, at_b = ({end: i for i, end in enumerate(ends.tolist(), 1)} for ends in (ends_a, ends_b))
    common = sorted(at_a.keys() & at_b.keys())
    cut_a, cut_b = (np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (at_a, at_b))
    stretches = np.union1d(ends_a, ends_b)
    links = ids_a[np.searchsorted(ends_a, stretches)] << 32 | ids_b[np.searchsorted(ends_b, stretches)]
    return Alignment(np.array(common, np.int64), cut_a, cut_b, links, stretches)


class Aligner:
    """Both tokenizers, and the pieces of text that are encoded and aligned already, by number."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        with open(byte_path, encoding="utf-8") as file:
            stated = json.load(file)
        pre = stated.get("pre_tokenizer") or {}
        if stated.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level models are handled as A")
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("only models without a space inside a piece are handled as B")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lone_space = [self.b.piece_to_id(SPACE)]
        self.size_a, self.size_b = (np.array([len(x) for x in spelled], np.int64) for spelled in (self.bytes_a, self.bytes_b))
        # An id as text with what follows it: a comma inside a group's list, | after the A ids, ; after the B ids.
        self.shown_a, self.shown_b = (np.array([f"{i}{mark}" for i in range(len(spelled)) for mark in marks], object) for spelled, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []  # groups as text; empty for a piece whose tokens do not spell it
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.figures, self.links = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        self.n_known = 0

    def split(self, text: str) -> list[str]:
        """Pieces of space + text, each without its first space."""
        if _SPACED.search(text) or text[0] == " ":
            return [p[1:] for p in _CUT.split(" " + text)]
        return text.split(" ")

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A and B ids of pieces laid end to end; only the last ones may end in white space."""
        ends = [not p or p[-1].isspace() for p in pieces]
        solid = ends.index(True) if True in ends else len(pieces)
        parts = [" " + " ".join(pieces[:solid])] if solid else []
        ids_a = [i for e in self.a.encode_batch_fast([*parts, *[" " + p for p in pieces[solid:]]], add_special_tokens=False) for i in e.ids]
        ids_b = list(chain.from_iterable([ids or self.lone_space for ids in self.b.encode(pieces, num_threads=1)]))
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64)

    def _add(self, pieces: list[str]) -> None:
        """Encode and align new pieces at once: all begin anew at their space, so their bytes are laid end to end."""
        pieces = sorted(pieces, key=lambda p: not p or p[-1].isspace())
        whole = [f" {p}".encode() for p in pieces]
        ids_a, ids_b = self._encode(pieces)
        if any(b"".join([spelled[i] for i in ids.tolist()]) != b"".join(whole) for spelled, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
            if len(pieces) > 1:  # look for the piece whose tokens spell other bytes
                self._add(pieces[: len(pieces) // 2])
                self._add(pieces[len(pieces) // 2 :])
                return
            texts, figures, links = [""], np.zeros((1, 4), np.int64), np.zeros(0, np.int64)
        else:
            found = align(ids_a, ids_b, self.size_a[ids_a], self.size_b[ids_b])
            bounds = np.cumsum([len(w) for w in whole])
            last = np.searchsorted(found.ends, bounds)  # the group that ends with each piece
            tokens = np.stack((found.cut_a[last], found.cut_b[last], last + 1, np.searchsorted(found.link_ends, bounds) + 1), axis=1)
            figures, links = np.diff(tokens, axis=0, prepend=0), found.links
            shown = np.empty(len(ids_a) + len(ids_b), object)
            for ids, cuts, others, table in ((ids_a, found.cut_a, np.append(0, found.cut_b[:-1]), self.shown_a), (ids_b, found.cut_b, found.cut_a, self.shown_b)):
                closes = np.zeros(len(ids), np.int64)
                closes[cuts - 1] = 1
                shown[np.arange(len(ids)) + np.repeat(others, np.diff(cuts, prepend=0))] = table[2 * ids + closes]
            spans, fragments = np.cumsum(figures[:, 0] + figures[:, 1]).tolist(), shown.tolist()
            texts = ["".join(fragments[a:b])[:-1] for a, b in zip([0, *spans], spans)]
        self.number.update(zip(pieces, range(len(self.texts), len(self.texts) + len(pieces))))
        self.texts += texts
        self.held.append((figures, links))
        self.n_known += sum(map(len, whole)) + PIECE_BYTES * len(pieces)

    def remember(self, pieces: set[str]) -> None:
        """Give every piece a number; `figures` (n_a, n_b, n_groups, n_links) and `links` hold what is known of them in that order."""
        if self.n_known > KEPT_BYTES:
            self.forget()
        fresh = list(pieces.difference(self.number))
        for start in range(0, len(fresh), AT_ONCE):
            self._add(fresh[start : start + AT_ONCE])
        if self.held:
            self.figures = np.concatenate([self.figures, *[f for f, _ in self.held]])
            self.links = np.concatenate([self.links, *[x for _, x in self.held]])
            self.held = []

    def numbers(self, text: str) -> list[int]:
        """Numbers of a text's pieces; none if it has no tokens."""
        if not text:
            return []
        names = self.split(text)
        self.remember(set(names))
        found = [self.number[n] for n in names]
        return found if all(self.texts[i] for i in found) else []


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner_of(byte_path: str, piece_path: str) -> Aligner:
    if (byte_path, piece_path) not in _loaded:
        _loaded[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _loaded[byte_path, piece_path]


def _narrow(values: np.ndarray) -> bytes:
    """The values in the narrowest width that holds them; the first byte is that width."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _chunk(aligner: Aligner, data: Sequence[str]) -> dict:
    """A chunk's documents and distinct pairs."""
    n, split = len(data), [aligner.split(x) if x else [] for x in data]
    aligner.remember(set().union(*split))
    number, texts, figures = aligner.number, aligner.texts, aligner.figures
    hashes, totals, owners, held = [""] * n, np.zeros((n, 4), np.int64), [], []
    for d, words in enumerate(split):
        own = [number[w] for w in words]
        shown = [texts[i] for i in own]
        if own and all(shown):
            hashes[d] = hashlib.sha256(";".join(shown).encode()).hexdigest()
            used, times = np.unique(np.array(own, np.int64), return_counts=True)
            totals[d] = times @ figures[used]
            owners.append(d)
            held.append((used, times))
    # (document, piece) with its number of occurrences, then (document, pair) with the links' occurrences.
    piece, times = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
    doc = np.repeat(np.array(owners, np.int64), [len(used) for used, _ in held])
    n_links = figures[:, 3]
    group, within = common.places(n_links[piece])
    link = (np.cumsum(n_links) - n_links)[piece[group]] + within
    pairs, slot = np.unique(aligner.links[link], return_inverse=True)
    key, back = np.unique(doc[group] * max(len(pairs), 1) + slot, return_inverse=True)
    times = np.bincount(back, weights=times[group], minlength=len(key)).astype(np.int64)
    doc, slot = np.divmod(key, max(len(pairs), 1))
    return {
        **dict(zip(LONGS, totals.T.tolist())), "hashes": hashes, "sizes": _narrow(np.bincount(doc, minlength=n)), "slots": _narrow(slot), "times": _narrow(times),
        "pairs": pairs.tolist(), "docs": np.bincount(slot, minlength=len(pairs)).tolist(),
    }


LONGS = ("n_a", "n_b", "n_groups", "n_links")
CHUNK = f"chunk long, keys array<long>, {', '.join(f'{c} array<long>' for c in LONGS)}, hashes array<string>, sizes binary, slots binary, times binary, pairs array<long>, docs array<long>"


def _chunks(df: DataFrame, byte_path: str, piece_path: str, key: str, text: str) -> DataFrame:
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2]
    names = [c.strip().split(" ")[0] for c in CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = aligner_of(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for (keys,), data in common.chunks(_gathered(batches), CHUNK_BYTES):
            made = _chunk(aligner, [x.decode("utf-8", "replace") for x in data]) | {"chunk": number, "keys": keys.to_pylist()}
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([made[c]], k) for c, k in zip(names, kinds)], names)

    return common.texts(df.withColumn(key, F.col(f"`{key}`").cast("long")), key, text).mapInArrow(run, CHUNK)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches together, up to CHUNK_BYTES, so that short texts make no small chunks."""
    held, size = [], 0
    for batch in batches:
        if size and size + batch.nbytes > CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), n (documents that hold it linked), best (n is its A id's highest)."""
    rows = chunks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = rows.groupBy("pair").agg(F.sum("docs").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # an A id has at most as many rows as B has ids
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def digests(df: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    chunks = cut(_chunks(df, byte_path, piece_path, key, text))
    counts = cut(pair_counts(chunks))
    lists = chunks.select("chunk", F.posexplode("pairs").alias("slot", "pair")).join(counts, "pair")
    back = lists.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("slot", "n", "best"))).alias("c")).select("chunk", F.col("c.n").alias("n"), F.col("c.best").alias("best"))
    names = [key, *LONGS, "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                sizes, slots, times = (_wide(row[c]) for c in ("sizes", "slots", "times"))
                doc = np.repeat(np.arange(len(sizes)), sizes)
                n, best = np.array(row["n"] or [], np.int64), np.array(row["best"] or [], bool)
                totals = np.zeros(len(sizes), np.int64)
                np.add.at(totals, doc, times * n[slots])
                fit = np.bincount(doc, weights=times * best[slots], minlength=len(sizes)).astype(np.int64)
                columns = [row["keys"], *[row[c] for c in LONGS], fit, totals]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(row["hashes"], pa.string())], names)

    needed = chunks.drop("pairs", "docs").join(back, "chunk", "left")
    return common.lean(needed).mapInArrow(run, ", ".join(f"`{c}` long" for c in names[:-1]) + ", groups_sha256 string")


def aligned(df: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, groups as (end, a, b): the byte offset in space + text, and the ids of both tokenizers."""
    kind = pa.list_(pa.struct([("end", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(byte_path, piece_path)
        for (keys,), data in common.chunks(batches):
            out = []
            for x in data:
                end, groups = 0, []
                for piece in aligner.numbers(x.decode("utf-8", "replace")):
                    for group in aligner.texts[piece].split(";"):
                        a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                        end += sum(len(aligner.bytes_a[i]) for i in a)
                        groups.append({"end": end, "a": a, "b": b})
                out.append(groups)
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(out, kind)], [key, "groups"])

    return common.texts(df, key, text).mapInArrow(run, f"`{key}` long, groups array<struct<end:long,a:array<long>,b:array<long>>>")
