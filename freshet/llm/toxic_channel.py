"""Toxicity after noisy-channel deobfuscation.

Disguised words are found by their shape: look-alike signs inside or at the edge of a word, letters
set apart by spaces or dots, letters repeated three times or more. Each is a lattice: a sign may stand
for the letters it looks like, a separator or a repetition may be dropped. Viterbi decoding takes the
path that a character trigram model, counted over all documents, finds likeliest; the restored word
replaces the disguised one and the restored text is scored. A span of DIGITS digits or more is parted at
its separators and numbers first, and a part whose restored form is still unlikely stays as a code.

The scorer adds up evidence. A subword (N_MIN to N_MAX characters, word edges included) weighs as much as
the logarithm of how much more it fills toxic texts than others, less DOUBT standard errors, counted
over a sample of about SAMPLE_ROWS toxic and CLEAN_ROWS other labelled documents (chosen by a hash; near
copies count once, so that what merely stands beside a toxic word in them does not). Every subword whose
weight is positive counts, however rare, with the logarithm of its occurrences; a text's evidence is their
sum over the root of its number of subwords. The sample is parted into FOLDS by a hash of the text: each
part is scored by the weights of the others, and those scores and labels set the bound between the classes
and the slope of the logistic curve that turns evidence into a score. No other filter is applied to what
was learned, so wrong labels only widen the doubt.

Defined cases: null and empty text have no evidence and the lowest score, under 0.5; without toxic
labels every score is 0; texts of any length are taken whole; several labels of a document count as toxic if one does; repeated rows get equal scores; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.llm.subword_langid import letter_table
from freshet.session import cut, shuffle_width

SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
SEPARATORS = " .-_*"
SIGN_COST, REPEAT_COST, DROP_COST, SEPARATOR_COST = 0.7, 0.3, 8.0, 0.3
N_MIN, N_MAX = 4, 6
BUCKETS = 1 << 21
SAMPLE_ROWS, CLEAN_ROWS = 3000, 12_000
DOUBT = 3.0  # standard errors by which a subword's weight is lessened
FOLDS = 5
SHORT = 100  # subwords added to a text's own, so that a few in a short text do not outweigh all
CAREFUL = 0.5  # the bound between the classes is where the F measure of this beta is best: precision counts twice
WORD_BYTES = common.byte_class([(0x20, 0x20), (0x09, 0x0D)])
KEPT_TOKENS = 100_000
CHUNK_BYTES = 1 << 18  # texts handled at once: their subwords take some 100 times as many bytes
DIGITS = 8  # a span of as many digits is parted, and its parts that look like codes stay
NUMBER = 4  # digits in a row that are a number
STRANGE = 1.0  # a restored part that costs so much more a character than usual is a code
_CLASSES = 64
_NUMBER = re.compile(rf"[0-9]{{{NUMBER},}}")
_PIECE = re.compile(r"[0-9A-Za-z@$!|+(\u00aa-\u0dff\u1100-\u1fff]+")  # neither separators nor scripts without spaces

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_LETTER = _ASCII_LETTER.copy()
_LETTER[0x80:] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in {*SIGNS, *SEPARATORS} - {" "}]] = True
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "0123456789@$(|+"]] = True
_APART = np.zeros(256, bool)
_APART[[ord(c) for c in SEPARATORS]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def _class_of(points: np.ndarray) -> np.ndarray:
    """0 for what is no letter, 1 to 26 for a to z, 27 to 63 for other letters by code point."""
    low = (points >= 97) & (points <= 122)
    return np.where(low, points - 96, np.where(letter_table()[points], 27 + points % 37, 0)).astype(np.int64)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CLASSES**3, np.int64)
    for _, data in common.chunks(batches, CHUNK_BYTES):
        text = "\n\n".join(x.decode("utf-8", "replace").lower() for x in data) + "\n\n"
        kind = _class_of(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
        keep = (kind > 0) | np.concatenate(([True], kind[:-1] > 0))  # one break between words
        kind = np.concatenate(([0, 0], kind[keep]))
        kind = np.repeat(kind, np.where(kind == 0, 2, 1))  # a word starts after two breaks
        code = (kind[:-2] * _CLASSES + kind[1:-1]) * _CLASSES + kind[2:]
        total += np.bincount(code, minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["trigram", "n"])


class CharacterModel:
    """Negative log probability of a character after two others, mixed with that after one."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype(float)
        two = three.sum(axis=0)
        one = (two + 0.5 / _CLASSES) / (two.sum(axis=1, keepdims=True) + 0.5)
        share = (three + 4 * one[None]) / (three.sum(axis=2, keepdims=True) + 4)
        self.cost = -np.log(share).astype(np.float32)
        whole = max(three.sum(), 1)
        self.usual = float((three * self.cost).sum() / whole)  # what a character costs on average
        self.known: dict[str, str] = {}

    def restore(self, token: str) -> str:
        """The likeliest word behind a disguised one."""
        if token not in self.known:
            if len(self.known) > KEPT_TOKENS:
                self.known = {}
            self.known[token] = self._viterbi(token)
        return self.known[token]

    def strange(self, word: str) -> bool:
        """Whether a word is so unlikely that it is no word but a code."""
        kinds = [0, 0, *_class_of(np.array([ord(c) for c in word], np.int64)).tolist(), 0]
        costs = [float(self.cost[a, b, c]) for a, b, c in zip(kinds, kinds[1:], kinds[2:])]
        return sum(costs) > (self.usual + STRANGE) * len(costs)

    def _viterbi(self, token: str) -> str:
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        before = ""
        for c in token:
            options: list[tuple[str, float]] = []
            if c in SIGNS:
                options += [(x, SIGN_COST) for x in SIGNS[c]]
            if c in SEPARATORS:
                options.append(("", SEPARATOR_COST))
            elif c in SIGNS:
                options.append(("", DROP_COST))
            if c.isalpha():
                options.append((c, 0.0))
                if c == before:
                    options.append(("", REPEAT_COST))
            elif not options:
                options.append(("", SEPARATOR_COST))
            before = c
            kinds = _class_of(np.array([ord(x) if x else 0 for x, _ in options], np.int64)).tolist()
            reached: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in states.items():
                for (x, price), kind in zip(options, kinds):
                    if x:
                        key, total, way = (b, kind), cost + price + float(self.cost[a, b, kind]) - self.usual, (path, x)
                    else:
                        key, total, way = (a, b), cost + price, path
                    if key not in reached or total < reached[key][0]:
                        reached[key] = (total, way)
            states = reached
        _, path = min((cost + float(self.cost[a, b, 0]), path) for (a, b), (cost, path) in states.items())
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))


def disguised(buffer: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of what looks like a disguised word in bytes; in order, none overlaps another."""
    n = len(buffer)
    if n < 3:
        return []
    letter, sign, space = _LETTER[buffer], _SIGN[buffer], _SPACE[buffer]
    marks = np.zeros(n, bool)
    edge = np.flatnonzero(np.diff(sign, prepend=False, append=False))
    first, last = edge[0::2], edge[1::2]  # runs of signs
    after = np.concatenate((letter, [False]))[last]
    ahead = np.concatenate(([False], letter))[first]
    opens = np.concatenate(([True], space))[first] & after & (last - first <= 2) & _EDGE[buffer[first]]
    closes = np.concatenate((space, [True]))[last] & ahead & (last - first <= 2) & _EDGE[buffer[first]] & _EDGE[buffer[last - 1]]
    marks[first[(after & ahead) | opens | closes]] = True
    low = _FOLD[buffer]
    marks[2:] |= _ASCII_LETTER[buffer[2:]] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    out: list[tuple[int, int]] = []
    at = np.flatnonzero(marks)
    if len(at):
        gaps = np.flatnonzero(space)
        where = np.searchsorted(gaps, at)
        starts = np.where(where > 0, gaps[np.maximum(where - 1, 0)] + 1, 0) if len(gaps) else np.zeros(len(at), np.int64)
        ends = np.where(where < len(gaps), gaps[np.minimum(where, len(gaps) - 1)], n) if len(gaps) else np.full(len(at), n)
        out += sorted(set(zip(starts.tolist(), ends.tolist())))
    # letters set apart: letter, separator, letter, separator, letter ...
    lone = (_ASCII_LETTER[buffer] | _EDGE[buffer]) & np.concatenate(([True], _APART[buffer[:-1]] | space[:-1])) & np.concatenate((_APART[buffer[1:]] | space[1:], [True]))
    begin = np.flatnonzero(lone[:-4] & lone[2:-2] & lone[4:]) if n >= 5 else np.zeros(0, np.int64)
    done = -1
    for a in begin.tolist():
        if a <= done:
            continue
        b = a
        while b + 2 < n and lone[b + 2] and not space[b + 1] or b + 2 < n and lone[b + 2] and buffer[b + 1] == 0x20:
            b += 2
        if b - a >= 4:
            out.append((a, b + 1))
        done = max(done, b)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def parts(span: str) -> list[tuple[int, int]]:
    """(start, end) of what may each be a word in a span of many digits: without the numbers, parted at
    separators and at scripts without spaces; single signs set apart stay together, without runs of digits."""
    out: list[tuple[int, int]] = []
    lone: list[tuple[int, int]] = []

    def close() -> None:
        shape = "".join("0" if span[a].isdigit() else "x" for a, _ in lone)
        at = 0
        for run in [*_NUMBER.finditer(shape), None]:
            end = run.start() if run else len(lone)
            if end > at:
                out.append((lone[at][0], lone[end - 1][1]))
            at = run.end() if run else end
        lone.clear()

    for found in _PIECE.finditer(span):
        a, b = found.span()
        if lone and (b - a > 1 or a - lone[-1][1] > 1):
            close()
        if b - a == 1:
            lone.append((a, b))
        elif sum(c.isdigit() for c in span[a:b]) < DIGITS:
            out.append((a, b))
        else:
            ends = [a, *(a + x for run in _NUMBER.finditer(span[a:b]) for x in run.span()), b]
            out += [(x, y) for x, y in zip(ends[0::2], ends[1::2]) if y > x]
    close()
    return out


def restored_parts(span: str, model: CharacterModel) -> str:
    """A span of many digits with those of its parts restored that are disguised and no codes."""
    out, at = [], 0
    for a, b in parts(span):
        if disguised(np.frombuffer(span[a:b].encode(), np.uint8)):
            word = model.restore(span[a:b].lower())
            if not model.strange(word):
                out += [span[at:a], word]
                at = b
    return "".join([*out, span[at:]])


def restored(data: bytes, model: CharacterModel) -> bytes:
    """The text with its disguised words restored."""
    spans = disguised(np.frombuffer(data, np.uint8))
    if not spans:
        return data
    out, at = [], 0
    for a, b in spans:
        span = data[a:b].decode("utf-8", "replace")
        many = sum(0x30 <= c <= 0x39 for c in data[a:b]) >= DIGITS
        out += [data[at:a], (restored_parts(span, model) if many else model.restore(span.lower())).encode()]
        at = b
    return b"".join([*out, data[at:]])


def subwords(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every subword: runs of characters inside a word, its edges included."""
    lowered = [x.decode("utf-8", "replace").lower() for x in data]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    owner = np.concatenate(([0], np.repeat(np.arange(len(data)), lengths + 1)))
    letter = letter_table()[points]
    keep = letter | np.concatenate(([True], letter[:-1])) | np.concatenate((letter[1:], [False]))
    points, owner, letter = points[keep].astype(np.uint64), owner[keep], letter[keep]
    points = np.where(letter, points, np.uint64(0))
    breaks = np.concatenate(([0], np.cumsum(~letter)))
    out, whose = [], []
    code = points
    for n in range(2, N_MAX + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n < N_MIN:
            continue
        inner = breaks[n - 1 : n - 1 + m] == breaks[1 : 1 + m]
        out.append((common.mix(code[inner] + np.uint64(n)) >> np.uint64(43)).astype(np.int64))
        whose.append(owner[1 : 1 + m][inner])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(whose)


class Scorer:
    """Weights by bucket; `bound` is the evidence that scores 0.5, `slope` how fast scores rise there."""

    def __init__(self, characters: CharacterModel, weights: dict[int, float], bound: float = 1.0, slope: float = 1.0) -> None:
        self.characters, self.bound, self.slope = characters, bound, slope
        self.table = np.zeros(BUCKETS, np.float32)
        self.table[list(weights)] = list(weights.values())
        self.any = bool(weights)

    def __getstate__(self) -> dict:
        used = np.flatnonzero(self.table)
        return {"characters": self.characters, "bound": self.bound, "slope": self.slope, "used": used, "value": self.table[used]}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["characters"], dict(zip(state["used"].tolist(), state["value"].tolist())), state["bound"], state["slope"])

    def evidence(self, data: list[bytes]) -> np.ndarray:
        bucket, owner = subwords([restored(x, self.characters) for x in data])
        return evidence(self.table, bucket, owner, len(data))

    def score(self, data: list[bytes]) -> np.ndarray:
        if not self.any:
            return np.zeros(len(data))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.evidence(data) - self.bound), -30, 30)))


def evidence(table: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of weight times log2(1 + occurrences), over the root of the number of subwords."""
    size = np.bincount(owner, minlength=n)
    weighs = table[bucket] > 0
    found, times = np.unique(owner[weighs] * BUCKETS + bucket[weighs], return_counts=True)
    total = np.bincount(found // BUCKETS, weights=table[found % BUCKETS] * np.log2(1 + times), minlength=n)
    return total / np.sqrt(size + SHORT)


def boundary(found: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(bound, slope) from evidence, labels and weights of rows that were scored by others' weights."""
    order = np.argsort(-found, kind="stable")
    found, toxic, weight = found[order], toxic[order].astype(bool), weight[order]
    right, wrong = np.cumsum(weight * toxic), np.cumsum(weight * ~toxic)
    f = (1 + CAREFUL**2) * right / (right + wrong + CAREFUL**2 * right[-1])
    last = np.append(found[1:] != found[:-1], True)  # rows of equal evidence are on one side
    f = np.where(last & (found > 0), f, 0)
    at = int(f.argmax())
    if not f[at] > 0:
        return float("inf"), 1.0  # nothing tells the classes apart
    below = found[at + 1] if at + 1 < len(found) else 0.0
    bound = max((found[at] + 2 * below) / 3, 1e-6)
    slopes = np.geomspace(0.05, 20, 60) / bound
    loss = [(weight * np.logaddexp(0, np.where(toxic, -1, 1) * s * (found - bound))).sum() for s in slopes]
    return float(bound), float(slopes[int(np.argmin(loss))])


def character_model(df: DataFrame, text: str = "text", key: str = "doc_id") -> CharacterModel:
    """Trigrams of characters counted over all whole texts; at most 64 cubed counts reach the driver."""
    rows = common.texts(df, key, text).select("_text").mapInArrow(_count_trigrams, "trigram long, n long")
    counts = np.zeros(_CLASSES**3, np.int64)
    for row in rows.groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        counts[row["trigram"]] = row["n"]
    return CharacterModel(counts)


def _count(batches: Iterator[pa.RecordBatch], characters: CharacterModel) -> Iterator[pa.RecordBatch]:
    """Sorted by fold: (bucket, fold, documents and occurrences of either class)."""
    docs, times = (np.zeros((2, BUCKETS), kind) for kind in (np.int32, np.float32))
    current = None

    def counted() -> pa.RecordBatch:
        used = np.flatnonzero(docs.any(axis=0))
        out = [pa.array(used), pa.array(np.full(len(used), current, np.int32)), *[pa.array(docs[k][used]) for k in (0, 1)], *[pa.array(times[k][used]) for k in (0, 1)]]
        docs[:], times[:] = 0, 0
        return pa.RecordBatch.from_arrays(out, ["bucket", "fold", "clean_docs", "toxic_docs", "clean", "toxic"])

    for (label, fold), data in common.chunks(batches, CHUNK_BYTES):
        label, fold = label.to_numpy(), fold.to_numpy()
        bucket, owner = subwords([restored(x, characters) for x in data])
        once, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
        owner, bucket = once // BUCKETS, once % BUCKETS
        for k in np.unique(fold):
            if k != current:
                if current is not None:
                    yield counted()
                current = k
            for side in (0, 1):
                own = (fold[owner] == k) & (label[owner] == side)
                docs[side] += np.bincount(bucket[own], minlength=BUCKETS).astype(np.int32)
                times[side] += np.bincount(bucket[own], weights=np.log2(1 + n[own]), minlength=BUCKETS).astype(np.float32)
    if current is not None:
        yield counted()


def _weights(counts: DataFrame) -> DataFrame:
    """bucket, w (from all folds) and w0, w1, ... (from all but one), null where there is no evidence."""
    names = ("clean_docs", "toxic_docs", "clean", "toxic")
    sums = counts.groupBy("bucket").agg(*[F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).cast("double").alias(f"{c}{k}") for c in names for k in range(FOLDS)])
    totals = counts.groupBy("fold").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()  # FOLDS rows
    whole = {c: {r["fold"]: r[c] for r in totals} for c in ("clean", "toxic")}

    def weight(left_out: int | None):
        folds = [k for k in range(FOLDS) if k != left_out]
        clean_docs, toxic_docs, clean, toxic = (sum((F.col(f"{c}{k}") for k in folds), F.lit(0.0)) for c in names)
        all_clean, all_toxic = (sum(whole[c].get(k, 0.0) for k in folds) for c in ("clean", "toxic"))
        if not all_toxic or not all_clean:
            return F.lit(None).cast("double")
        share = F.log((toxic + 0.5) / all_toxic) - F.log((clean + 0.5) / all_clean)
        lessened = share - DOUBT * F.sqrt(1 / (toxic_docs + 0.5) + 1 / (clean_docs + 0.5))
        return F.when(lessened > 0, lessened)

    found = sums.select("bucket", weight(None).alias("w"), *[weight(k).alias(f"w{k}") for k in range(FOLDS)])
    return found.filter(F.greatest("w", *[f"w{k}" for k in range(FOLDS)]).isNotNull())


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mark that near copies of a text mostly share: its least shingle of five words."""
    for (toxic,), data in common.chunks(batches, CHUNK_BYTES):
        hashed, bounds = common.words(data, WORD_BYTES)
        family = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            shingles = common.grams(hashed[a:b], min(5, int(b - a))) if b > a else np.zeros(1, np.uint64)
            family.append(int(shingles.min().view(np.int64)))
        yield pa.RecordBatch.from_arrays([toxic, pa.array(family, pa.int64()), pa.array(data, pa.binary()).cast(pa.string())], ["_toxic", "_family", "_text"])


def train(df: DataFrame, labels: DataFrame, labelled: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """Count characters over all of `df`, learn rules from rows of `labels` for which `labelled` holds."""
    marks = labels.filter(labelled & F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    marks = marks.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max((F.col(f"`{label}`") > 0).cast("int")).alias("_toxic"))
    sizes = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    characters = character_model(df, text, key)
    if not sizes.get(1):
        return Scorer(characters, {})
    wanted = F.lit(False)
    for side, n in sizes.items():
        most = SAMPLE_ROWS if side else CLEAN_ROWS
        top = (1 << 63) - 1 if n <= most else int((most / n * 2 - 1) * ((1 << 63) - 1))
        wanted = wanted | ((F.col("_toxic") == side) & (F.xxhash64(F.lit(3), "_key") <= top))
    some = F.broadcast(marks.filter(wanted))  # about SAMPLE_ROWS + CLEAN_ROWS keys
    texts = common.texts(df, key, text).join(some, "_key").select("_toxic", "_text")
    families = texts.mapInArrow(_families, "_toxic int, _family long, _text string").groupBy("_family")
    one = families.agg(F.max(F.struct("_toxic", "_text")).alias("one")).select("one.*")  # the same one in every run
    fold = F.pmod(F.xxhash64(F.lit(11), "_text"), F.lit(FOLDS)).cast("int")
    sample = cut(one.select("_toxic", fold.alias("_fold"), "_text"))
    kinds = {r["_toxic"]: r["n"] for r in sample.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if not kinds.get(1) or not kinds.get(0):
        return Scorer(characters, {})
    dealt = common.lean(sample.repartitionByRange(FOLDS, "_fold").sortWithinPartitions("_fold"))
    counts = cut(dealt.mapInArrow(lambda b: _count(b, characters), "bucket long, fold int, clean_docs int, toxic_docs int, clean float, toxic float"))
    rows = _weights(counts).collect()  # buckets with evidence, at most BUCKETS
    weights = [{r["bucket"]: r[c] for r in rows if r[c] is not None} for c in ("w", *[f"w{k}" for k in range(FOLDS)])]
    apart = [Scorer(characters, w) for w in weights[1:]]

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (label, fold), data in common.chunks(batches, CHUNK_BYTES):
            fold = fold.to_numpy()
            bucket, owner = subwords([restored(x, characters) for x in data])
            found = np.zeros(len(data))
            for k in np.unique(fold):
                found = np.where(fold == k, evidence(apart[k].table, bucket, owner, len(data)), found)
            yield pa.RecordBatch.from_arrays([label, pa.array(found)], ["toxic", "found"])

    scored = common.lean(sample).repartition(shuffle_width(df.sparkSession)).mapInArrow(out_of_fold, "toxic int, found double").toPandas()  # two numbers for each row of the sample
    toxic = scored["toxic"].to_numpy()
    weight = np.where(toxic == 1, sizes[1] / kinds[1], sizes.get(0, 0) / kinds[0])
    return Scorer(characters, weights[0], *boundary(scored["found"].to_numpy(), toxic, weight))


def score(df: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, _sign (hash of the text), score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys, sign), data in common.chunks(batches, CHUNK_BYTES):
            value = scorer.score(data)
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), sign, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [key, "_sign", "score", "predicted"])

    rows = common.texts(df, key, text).select("_key", F.xxhash64("_text").alias("_sign"), "_text")
    return rows.mapInArrow(run, f"`{key}` long, _sign long, score double, predicted int")


def clean(df: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic."""
    return common.filtered(df, text, lambda data: scorer.score(data) < 0.5, CHUNK_BYTES)
