"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is escaped (a space becomes U+2581, one is put in front), cut where no piece of the model can
reach across, and every distinct word is encoded once: the symbols of all words lie end to end in flat
arrays. In each round the best pair of every word (least rank, of equal ones the leftmost) is found by
a segmented minimum and merged; equal pairs further right merge in the same round if no better pair can
arise from the merged piece. Where one can, and the word has LONG_RUN pairs of that rank or more (long runs
of spaces), all pairs of the rank merge in the round from left to right on a stack, up to the first
better one, so a run costs no more rounds than other words. The arrays are compacted and the rounds go on
until no word has a pair.
Ranks are looked up in a hash table, after a round only for the pairs beside a merge. Characters without a
piece become byte pieces. Decoding joins the pieces, turns bytes into text (malformed ones into U+FFFD) and
takes away the first space. The digests are taken from the ids of a whole chunk of texts: each id's digits,
and each id's piece, are laid end to end and cut by text.

Models: BPE with byte fallback, identity normaliser, leading dummy space, no removal of extra spaces;
others are refused. Defined cases: null and empty text have no ids and decode to empty text; repeated
rows and equal keys give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from freshet.llm import common

SPACE = "▁"
KEPT_WORDS = 400_000  # encoded words that a task remembers; after that it starts anew
NONE = np.int32(1 << 30)
SLOTS = 1 << 20
LONG_RUN = 8


class PieceModel:
    """Tables of a model file: symbols by character, merges by pair, texts by id."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback, identity normaliser and dummy prefix are handled")
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        if 4 in kinds or 5 in kinds:
            raise ValueError("models with user-defined or unused pieces are not handled")
        normal = {p: i for i, (p, kind) in enumerate(zip(self.pieces, kinds)) if kind == 1}
        self.byte_id = np.zeros(256, np.int64)
        self.byte_of: dict[int, int] = {}
        for i, (p, kind) in enumerate(zip(self.pieces, kinds)):
            if kind == 6:
                self.byte_id[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
        # Of each id: its digits and a comma; the bytes it stands for.
        self.digits = pa.array([b"%d," % i for i in range(len(self.pieces))], pa.large_binary())
        self.spelled = pa.array([bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)], pa.large_binary())
        self.special = {i for i, kind in enumerate(kinds) if kind in (2, 3)}
        # Characters of pieces that are no pieces themselves get symbols beyond the ids.
        symbol = {c: normal[c] for p in normal for c in p if c in normal}
        for c in sorted({c for p in normal for c in p} - set(symbol)):
            symbol[c] = len(self.pieces) + len(symbol)
        self.no_symbol = len(self.pieces) + len(symbol) + 1
        self.table = np.full(0x110000, self.no_symbol, np.int32)
        for c, i in symbol.items():
            self.table[ord(c)] = i
        score = {p: model.pieces[i].score for p, i in normal.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs, best_with = [], {}
        for p, i in normal.items():
            for at in range(1, len(p)):
                left, right = p[:at], p[at:]
                a, b = normal.get(left, symbol.get(left)), normal.get(right, symbol.get(right))
                if a is None or b is None:
                    continue
                rank = order[score[p]]
                pairs.append((a << 20 | b, rank, i))
                best_with[a] = min(best_with.get(a, 1 << 40), rank)
                best_with[b] = min(best_with.get(b, 1 << 40), rank)
        pairs.sort()
        self.pair_key = np.array([p[0] for p in pairs], np.int64)
        self.pair_rank = np.array([p[1] for p in pairs], np.int32)
        self.pair_piece = np.array([p[2] for p in pairs], np.int32)
        self.pair_at = self._hash_table()
        # A merge is settled if no pair with the merged piece ranks before it or beside it.
        self.pair_settled = np.array([best_with.get(p[2], 1 << 40) > p[1] for p in pairs], bool)
        # Which neighbours occur in a piece, by a hash of both: a false yes only makes a word longer.
        self.bigrams = np.zeros(1 << 22, bool)
        beside = np.array([(ord(p[j]), ord(p[j + 1])) for p in normal for j in range(len(p) - 1)], np.int64)
        self.bigrams[self._beside(beside[:, 0], beside[:, 1])] = True
        self.words = common.WordIds()
        self.pairs: dict[int, tuple[int, int]] = {}

    @staticmethod
    def _beside(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left * 40503 + right * 9) & ((1 << 22) - 1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * np.int64(0x1E3779B97F4A7C15) >> 40) & (SLOTS - 1)

    def _hash_table(self) -> np.ndarray:
        """Index of the pair in each slot (-1: none); a taken slot sends a pair to the next one."""
        table = np.full(SLOTS, -1, np.int32)
        left, slot = np.arange(len(self.pair_key), dtype=np.int32), self._slot(self.pair_key)
        while len(left):
            free = table[slot] < 0
            table[slot[free]] = left[free]  # of several for one slot the last stays
            out = table[slot] != left
            left, slot = left[out], (slot[out] + 1) & (SLOTS - 1)
        return table

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, index of the pair) of each pair; NONE where it is no pair."""
        key = left.astype(np.int64) << 20 | right
        slot = self._slot(key)
        at = self.pair_at[slot]
        found = (at >= 0) & (self.pair_key[at] == key)
        open_ = np.flatnonzero((at >= 0) & ~found)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
            at[open_] = self.pair_at[slot[open_]]
            open_ = open_[at[open_] >= 0]
            same = self.pair_key[at[open_]] == key[open_]
            found[open_[same]] = True
            open_ = open_[~same]
        return np.where(found, self.pair_rank[at], NONE), at

    def merge(self, symbols: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge rounds over words laid end to end; sizes: characters of each symbol, lengths: symbols of each word.

        Returns the symbols, their sizes in characters and the number of symbols of each word.
        """
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts = lengths[lengths > 0]
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        rank, entry = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int32)
        fresh = np.arange(len(symbols))  # places whose pair is not looked up yet
        while len(symbols):
            inner = fresh[fresh + 1 < len(word)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[fresh] = NONE
            rank[inner], entry[inner] = self._look_up(symbols[inner], symbols[inner + 1])
            starts = np.cumsum(counts) - counts
            least = np.minimum.reduceat(rank, starts)
            open_word = least < NONE
            if not open_word.all():
                open_ = np.repeat(open_word, counts)
                shut = ~open_
                done.append((word[shut], symbols[shut], sizes[shut]))
                symbols, sizes, word, rank, entry = (x[open_] for x in (symbols, sizes, word, rank, entry))
                counts, least = counts[open_word], least[open_word]
                if not len(symbols):
                    break
                starts = np.cumsum(counts) - counts
            at = np.flatnonzero(rank == np.repeat(least, counts))
            owner = word[at]
            first = np.concatenate(([True], owner[1:] != owner[:-1]))
            group = np.cumsum(first) - 1  # each open word has one group
            settled = self.pair_settled[entry[at]]
            all_settled = np.logical_and.reduceat(settled, np.flatnonzero(first))
            # In a run of overlapping pairs every second one merges, from the left.
            touching = np.concatenate(([False], (np.diff(at) == 1) & ~first[1:]))
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
            take = first | (all_settled[group] & (run % 2 == 0))
            keep = np.ones(len(symbols), bool)
            renew = np.zeros(len(symbols) + 1, bool)  # one place more, before the first
            crowded = np.flatnonzero(~all_settled & (np.bincount(group) >= LONG_RUN))
            if len(crowded):
                take &= ~np.isin(group, crowded)
            at = at[take]
            symbols[at] = self.pair_piece[entry[at]]
            sizes[at] += sizes[at + 1]
            keep[at + 1] = False
            renew[at] = renew[at + 1] = True
            counts = counts - np.bincount(group[take], minlength=len(counts))
            for g in crowded.tolist():
                a, b = int(starts[g]), int(starts[g] + counts[g])
                pieces, chars = self.merge_rank(symbols[a:b].tolist(), sizes[a:b].tolist(), int(least[g]))
                symbols[a : a + len(pieces)], sizes[a : a + len(pieces)] = pieces, chars
                keep[a + len(pieces) : b] = False
                renew[a + 1 : b + 1] = True
                counts[g] = len(pieces)
            # The pair before a merged one ends in a new piece; if its own left half is gone, the merge there is renewed.
            renew = renew[1:]
            symbols, sizes, word, rank, entry = (x[keep] for x in (symbols, sizes, word, rank, entry))
            fresh = np.flatnonzero(renew[keep])
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        word, symbols, sizes = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], sizes[order], np.bincount(word, minlength=len(lengths))

    def _pair(self, left: int, right: int) -> tuple[int, int]:
        """(rank, piece) of a pair."""
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            rank, at = self._look_up(np.array([left]), np.array([right]))
            found = self.pairs[key] = int(rank[0]), int(self.pair_piece[at[0]])
        return found

    def merge_rank(self, symbols: list[int], sizes: list[int], rank: int) -> tuple[list[int], list[int]]:
        """One word's merges of its least rank, the leftmost first, until none is left or a better pair arises.

        No pair of that rank is left on the stack, so the next leftmost one is at its top.
        """
        out, chars = [], []
        for i, symbol in enumerate(symbols):
            out.append(symbol)
            chars.append(sizes[i])
            while len(out) > 1:
                found, piece = self._pair(out[-2], out[-1])
                if found < rank:
                    return out + symbols[i + 1 :], chars + sizes[i + 1 :]
                if found > rank:
                    break
                right = chars.pop()
                out.pop()
                out[-1], chars[-1] = piece, chars[-1] + right
                if i + 1 < len(symbols) and self._pair(piece, symbols[i + 1])[0] < rank:
                    return out + symbols[i + 1 :], chars + sizes[i + 1 :]
        return out, chars

    def encode_flat(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of escaped words, none of which a piece could join to its neighbour, end to end; ids of each word."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        # Words are cut further where two characters stand side by side in no piece.
        cut_here = np.concatenate(([True], ~self.bigrams[self._beside(flat[:-1], flat[1:])]))
        cut_here[np.cumsum(lengths) - lengths] = True
        starts = np.flatnonzero(cut_here)
        symbols, sizes, counts = self.merge(self.table[flat], np.ones(len(flat), np.int32), np.diff(np.append(starts, len(flat))))
        owner = np.repeat(np.repeat(np.arange(len(lengths)), lengths)[starts], counts)
        plain = symbols < len(self.pieces)
        if plain.all():
            return symbols, np.bincount(owner, minlength=len(words))
        place = np.cumsum(sizes, dtype=np.int64) - sizes
        width = np.ones(len(symbols), np.int64)
        spelled = [chr(flat[i]).encode("utf-8", "replace") for i in place[~plain]]
        width[~plain] = [len(b) for b in spelled]
        ids = np.repeat(symbols, width)
        ids[np.repeat(~plain, width)] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, np.bincount(owner, weights=width, minlength=len(words)).astype(np.int64)

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of escaped words, none of which a piece could join to its neighbour."""
        ids, counts = self.encode_flat(words)
        flat_ids, ends = ids.tolist(), np.cumsum(counts).tolist()
        return [flat_ids[a:b] for a, b in zip([0, *ends], ends)]

    @property
    def known(self) -> dict[str, int]:
        """Places of the words that the task remembers."""
        return self.words.place

    def remember(self, words: Collection[str]) -> np.ndarray:
        """Places of distinct words; those not yet known are encoded and their ids kept."""
        if len(self.known) > KEPT_WORDS:
            self.words = common.WordIds()
        places, words = self.words.places(words), list(words)
        new = np.flatnonzero(places < 0)
        places[new] = np.arange(len(self.known), len(self.known) + len(new))
        fresh = [words[i] for i in new.tolist()]
        self.words.add(fresh, *self.encode_flat(fresh))
        return places

    def encode_texts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, end to end; ids of each text. Every distinct word is encoded once, split as by `split`."""
        escaped = [SPACE + x.replace(" ", SPACE) if x else "" for x in texts]
        data = [x.encode("utf-8", "replace") for x in escaped]
        buffer = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        space = np.zeros(len(buffer) + 3, bool)
        space[3 : len(buffer) + 1] = (buffer[:-2] == 0xE2) & (buffer[1:-1] == 0x96) & (buffer[2:] == 0x81)
        begins = space[3:].copy()
        begins &= ~space[:-3]
        begins[ends[:-1][ends[:-1] < len(buffer)]] = True
        starts = np.flatnonzero(begins)
        number, distinct = common.numbered(buffer, starts)
        places = self.remember(distinct)[number]
        ids, counts = self.words.ids(places)
        before = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, ends)]
        return ids, np.diff(before, prepend=0)

    def split(self, text: str) -> list[str]:
        """Escaped text cut before every run of spaces; no piece has a space after another character."""
        out, held = [], ""
        for part in text.replace(" ", SPACE).split(SPACE):
            if part:
                out.append(held + SPACE + part)
                held = ""
            else:
                held += SPACE
        if held:
            out.append(held)
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for ids in self.encode_words(self.split(text)) for i in ids]

    def decode_words(self, places: Sequence[int]) -> str:
        """The text that `decode` gives for known whole words laid end to end: no character spans two of them."""
        return b"".join(self.spelled.take(pa.array(self.words.ids(np.array(places, np.int64))[0])).to_pylist()).decode()[1:]

    def texts_of(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[memoryview, memoryview]]:
        """Of each text: its ids joined by commas, and the text that `decode` gives for them.

        The ids are those of whole texts, so their byte pieces stand for whole characters.
        """
        ends = np.cumsum(counts)
        digits, spelled = (_laid(shown.take(pa.array(ids)), ends) for shown in (self.digits, self.spelled))
        for (one, a, b), (other, c, d) in zip(digits, spelled):
            yield one[a : max(a, b - 1)], other[min(c + 1, d) : d]

    def decode(self, ids: Sequence[int], first: bool = True) -> str:
        """Text of ids; control pieces are silent, byte pieces are joined before they are decoded.

        first: the ids begin a text, so its dummy space is taken away.
        """
        out: list[str] = []
        held = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_bytes_text(bytes(held)))
                held = bytearray()
                first = False
            if i is None or i in self.special and i != 0:
                continue
            piece = " ⁇ " if i == 0 else self.pieces[i]
            if first and i != 0 and piece.startswith(SPACE):
                piece = piece[1:]
            first = False
            out.append(piece.replace(SPACE, " ") if i else piece)
        return "".join(out)


def _bytes_text(held: bytes) -> str:
    """Bytes as text; each byte that belongs to no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(held):
        for n in (1, 2, 3, 4):
            try:
                out.append(held[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _laid(shown: pa.LargeBinaryArray, ends: np.ndarray) -> Iterator[tuple[memoryview, int, int]]:
    """(all values end to end, begin, end) of the groups of values that end at `ends`."""
    _, offsets, data = shown.buffers()
    at = np.frombuffer(offsets, np.int64)[ends].tolist() if len(shown) else [0] * len(ends)
    view = memoryview(data) if data is not None else memoryview(b"")
    return ((view, a, b) for a, b in zip([0, *at], at))


_loaded: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def digests(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for (keys,), data in common.chunks(batches):
            flat, n = model.encode_texts([x.decode("utf-8", "replace") for x in data])
            shown = [[hashlib.sha256(x).hexdigest() for x in pair] for pair in model.texts_of(flat, n)]
            ids, decoded = zip(*shown)
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
    return common.texts(df, key, text).mapInArrow(run, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, ids and the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for (keys,), data in common.chunks(batches):
            ids = [model.encode(x.decode("utf-8", "replace")) for x in data]
            yield pa.RecordBatch.from_arrays(
                [keys.cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids])], [key, "ids", "decoded"]
            )

    return common.texts(df, key, text).mapInArrow(run, f"`{key}` long, ids array<int>, decoded string")
