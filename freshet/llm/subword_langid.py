"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is its letters in lower case, words set apart by one mark; its subwords are all runs of
N_MIN to N_MAX characters, hashed into BUCKETS. The embeddings of all subwords are averaged and a
linear layer with softmax gives the languages' probabilities. Both are trained by stochastic gradient
descent in numpy on a bounded sample of every label's rows, chosen by a hash of key and text: about
SAMPLE_ROWS of a label, fewer where there are more than TOTAL_ROWS / SAMPLE_ROWS labels, and of a row
about SAMPLE_SUBWORDS different subwords, chosen by a hash, so the sample's bytes are bounded too.

A fifth of the sample is kept apart and calibrates. It sets a temperature that makes the scores honest
probabilities, and two bounds beyond which a prediction is rejected, each set so that the share REJECTED
of the rows that were predicted right falls beyond it: a floor under the score, for texts between
languages, and a bound on the share of runs of N_MAX characters that no row of the training sample holds
(less ALLOWANCE over the root of their number, since short texts vary more), for gibberish and languages
that were never learned. With fewer than LEAST_APART rows kept apart there are no bounds and only texts
without a letter are rejected.

Since average and linear layer are linear, prediction adds up one number per subword and language, over
the whole text. Defined cases: null text, or text without a letter, is `und` with score 0 and rejected;
a table without labelled rows predicts `und` everywhere; repeated rows get equal predictions; texts may
be of any length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.session import cut

N_MIN, N_MAX = 2, 4
BUCKETS = 1 << 15
SAMPLE_ROWS = 1000
TOTAL_ROWS = 16_000
LEAST_ROWS = 20  # of a label, however many labels there are
SAMPLE_SUBWORDS = 1024
DIMENSIONS = 16
EPOCHS, LEAST_STEPS, STEP, BATCH = 4, 500, 8.0, 64
REJECTED = 0.002
LEAST_APART = 50
ALLOWANCE = 1.0
GRAM_BITS = 22  # runs of N_MAX characters are known by a hash of so many bits
UNKNOWN = "und"
CHUNK_BYTES = 1 << 18  # texts handled at once: their subwords take some 100 times as many bytes
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point: 1 if it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _letters[0]


def subwords(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each subword, text that it belongs to, texts that have a letter, hash of each run of N_MAX, its text)."""
    lowered = [x.decode("utf-8", "replace").lower() for x in data]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    owner = np.repeat(np.arange(len(data)), lengths + 1)[: len(points)]
    letter = letter_table()[points]
    has = np.bincount(owner[letter], minlength=len(data)) > 0
    points = np.where(letter, points, 0)
    last = np.zeros(len(points), bool)  # the break after a text stays, so that no subword joins two texts
    last[np.cumsum(lengths + 1)[:-1] - 1] = True
    keep = letter | last | np.concatenate(([False], letter[:-1]))
    points, owner = points[keep].astype(np.uint64), owner[keep]
    out, whose = [], []
    runs = runs_of = np.zeros(0, np.int64)
    code = points.copy()
    for n in range(2, N_MAX + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n < N_MIN:
            continue
        same = owner[:m] == owner[n - 1 :]
        mixed = common.mix(code + np.uint64(n))[same]
        out.append((mixed >> np.uint64(49)).astype(np.int64))
        whose.append(owner[:m][same])
        if n == N_MAX:
            runs, runs_of = (mixed >> np.uint64(64 - GRAM_BITS)).astype(np.int64), whose[-1]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has, runs, runs_of
    return np.concatenate(out), np.concatenate(whose), has, runs, runs_of


def strangeness(known: np.ndarray, runs: np.ndarray, runs_of: np.ndarray, n: int) -> np.ndarray:
    """Share of a text's runs that are not known, less the allowance for its length."""
    total = np.bincount(runs_of, minlength=n)
    strange = np.bincount(runs_of[~known[runs]], minlength=n)
    return strange / np.maximum(total, 1) - ALLOWANCE / np.sqrt(np.maximum(total, 1))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data in common.chunks(batches, CHUNK_BYTES):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(subwords(data)[3]))], ["run"])


def _sample_rows(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    for (label, apart), data in common.chunks(batches, CHUNK_BYTES):
        bucket, owner, _, runs, runs_of = subwords(data)
        pairs, counts = np.unique(owner * BUCKETS + bucket, return_counts=True)
        kept = np.bincount(pairs // BUCKETS, minlength=len(data))
        chance = np.minimum(SAMPLE_SUBWORDS / np.maximum(kept, 1), 1.0)[pairs // BUCKETS]
        drawn = common.mix((pairs % BUCKETS + BUCKETS * kept[pairs // BUCKETS]).astype(np.uint64))  # the row's own number of subwords varies what stays
        thin = (drawn >> np.uint64(11)).astype(float) * 2.0**-53 < chance
        pairs, counts = pairs[thin], counts[thin]
        ends = np.searchsorted(pairs, np.arange(len(data) + 1) * BUCKETS).astype(np.int32)
        lists = lambda v, t: pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(t)))
        strange = strangeness(known, runs, runs_of, len(data))
        yield pa.RecordBatch.from_arrays(
            [label, apart, pa.array(strange), lists(pairs % BUCKETS, np.int32), lists(counts, np.int32)], ["label", "apart", "strange", "at", "n"]
        )


class Model:
    """known: runs of characters of the training sample; None where there was too little to set bounds."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0) -> None:
        self.languages, self.weights, self.bias, self.temperature = languages, weights, bias, temperature
        self.floor, self.strangest, self.known = 0.0, 1.0, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": None if self.known is None else np.packbits(self.known)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.known is not None:
            self.known = np.unpackbits(self.known).astype(bool)

    def logits(self, bucket: np.ndarray, owner: np.ndarray, n: int, value: np.ndarray | None = None) -> np.ndarray:
        total = np.maximum(np.bincount(owner, weights=value, minlength=n), 1)
        sums = [np.bincount(owner, weights=self.weights[bucket, j] if value is None else self.weights[bucket, j] * value, minlength=n) for j in range(len(self.languages))]
        return np.stack(sums, axis=1) / total[:, None] + self.bias

    def predict(self, data: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        if not self.languages:
            return [UNKNOWN] * len(data), np.zeros(len(data)), np.ones(len(data), bool)
        bucket, owner, has, runs, runs_of = subwords(data)
        chance = softmax(self.logits(bucket, owner, len(data)) / self.temperature)
        best = chance.argmax(axis=1)
        score = np.where(has, chance[np.arange(len(data)), best], 0.0)
        rejected = ~has | (score < self.floor)
        if self.known is not None:
            rejected |= strangeness(self.known, runs, runs_of, len(data)) > self.strangest
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)], score, rejected


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(labels: list[str], held: np.ndarray, strange: np.ndarray, at: list[np.ndarray], counts: list[np.ndarray], known: np.ndarray | None = None, seed: int = 7) -> Model:
    """Train on sparse bags of subwords of the rows that are not `held` apart, calibrate on the others; rows come in a fixed order."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    place = {x: i for i, x in enumerate(languages)}
    target = np.array([place[x] for x in labels])
    rng = np.random.default_rng(seed)
    apart, rest = np.flatnonzero(held), np.flatnonzero(~held)
    if not len(apart) or not len(rest):
        apart = rest = np.arange(len(labels))
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    share = [c / max(c.sum(), 1) for c in counts]
    batches = -(-len(rest) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps, done = epochs * batches, 0
    for _ in range(epochs):
        rng.shuffle(rest)
        for a in range(0, len(rest), BATCH):
            rows = rest[a : a + BATCH]
            index = np.concatenate([at[r] for r in rows])
            value = np.concatenate([share[r] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(at[r]) for r in rows])
            used, place = np.unique(index, return_inverse=True)
            bag = np.zeros((len(rows), len(used)))
            bag[owner, place] = value
            hidden = bag @ table[used]
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(rows)), target[rows]] -= 1
            rate = STEP * (1 - done / steps)
            down = error @ layer.T
            layer -= rate * hidden.T @ error / len(rows)
            bias -= 0.1 * rate * error.mean(axis=0)
            table[used] -= rate * bag.T @ down
            done += 1
    model = Model(languages, table @ layer, bias)
    owner = np.repeat(np.arange(len(apart)), [len(at[r]) for r in apart])
    raw = model.logits(np.concatenate([at[r] for r in apart]), owner, len(apart), np.concatenate([counts[r] for r in apart]).astype(float))
    truth = target[apart]
    # One row's worth of doubt is spread over the other languages, so that rows without an error do not make every score 1.
    doubt = 1 / (len(apart) + 2)
    goal = np.full((len(apart), len(languages)), doubt / max(len(languages) - 1, 1))
    goal[np.arange(len(apart)), truth] = 1 - doubt
    loss = lambda t: -(goal * np.log(softmax(raw / t) + 1e-300)).sum(axis=1).mean()
    model.temperature = float(min(np.geomspace(0.01, 100, 120), key=loss))
    chance = softmax(raw / model.temperature)
    right = chance.argmax(axis=1) == truth
    if right.sum() >= LEAST_APART:
        score = np.clip(chance.max(axis=1)[right], 1e-9, 1 - 1e-9)
        model.floor = float(1 / (1 + np.exp(extreme(-np.log(score / (1 - score))))))
        model.strangest, model.known = extreme(strange[apart][right]), known
    return model


def extreme(values: np.ndarray) -> float:
    """The value that a share REJECTED exceeds; of fewer values than show it, the largest moved out as an exponential tail would be."""
    top = float(np.quantile(values, 1 - REJECTED, method="higher"))
    missing = max(np.log(1 / REJECTED) / np.log(len(values)) - 1, 0.0)
    return top + (top - float(np.median(values))) * missing


def train(df: DataFrame, labelled: Column, label: str = "lang", key: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample of the rows for which `labelled` holds and the label is known."""
    rows = common.lean(df).filter(labelled & F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.select(F.col(f"`{label}`").cast("string").alias("_label"), F.xxhash64(F.lit(5), F.col(f"`{key}`"), F.col(f"`{text}`")).alias("_hash"), F.col(f"`{text}`").alias("_text"))
    sizes = cut(rows.groupBy("_label").agg(F.count("*").alias("_n")))
    n_labels = max(sizes.count(), 1)
    each = max(min(SAMPLE_ROWS, TOTAL_ROWS // n_labels), LEAST_ROWS)
    # About `each` rows of every label: each is chosen with the same chance.
    top = F.when(F.col("_n") <= each, F.lit((1 << 63) - 1)).otherwise(((F.lit(float(each)) / F.col("_n") * 2 - 1) * float((1 << 63) - 1024)).cast("long"))
    chosen = rows.join(sizes.select("_label", top.alias("_top")), "_label").filter(F.col("_hash") <= F.col("_top"))
    sample = cut(chosen.select("_label", (F.pmod(F.xxhash64(F.lit(9), "_hash"), F.lit(5)) == 0).alias("_apart"), "_text"))
    known = np.zeros(1 << GRAM_BITS, bool)
    learned = common.lean(sample.filter("not _apart").select("_text")).mapInArrow(_runs, "run long").distinct()
    known[learned.toArrow()["run"].to_numpy()] = True  # at most 2 ** GRAM_BITS numbers
    found = common.lean(sample).mapInArrow(lambda b: _sample_rows(b, known), "label string, apart boolean, strange double, at array<int>, n array<int>").toArrow()
    labels = found["label"].to_pylist()
    at, counts = ([x.values.to_numpy() for x in found[c].combine_chunks()] if len(labels) else [] for c in ("at", "n"))
    held, strange = found["apart"].to_numpy(), found["strange"].to_numpy()
    # the order in which tasks end does not matter
    order = sorted(range(len(labels)), key=lambda i: (labels[i], held[i], len(at[i]), strange[i], int(at[i][:9].sum()), int(counts[i].sum())))
    return fit([labels[i] for i in order], held[order].astype(bool), strange[order], [at[i] for i in order], [counts[i] for i in order], known)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, _sign (hash of the text), lang_pred, score, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys, sign), data in common.chunks(batches, CHUNK_BYTES):
            language, score, rejected = model.predict(data)
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), sign, pa.array(language), pa.array(score), pa.array(rejected)], [key, "_sign", "lang_pred", "score", "rejected"])

    rows = common.texts(df, key, text).select("_key", F.xxhash64("_text").alias("_sign"), "_text")
    return rows.mapInArrow(run, f"`{key}` long, _sign long, lang_pred string, score double, rejected boolean")


def recognised(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not rejected."""
    return common.filtered(df, text, lambda data: ~model.predict(data)[2], CHUNK_BYTES)
