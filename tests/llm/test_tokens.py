import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from freshet.llm import pfor_tokens as pt
from freshet.llm import piece_bpe
from freshet.llm.registry import tokenizer_file
from tests.llm.helpers import TEXTS, documents, sha

BYTE, PIECE = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
LETTERS = "abc the 'sdre  \n\t　 éñ日🙂09#!.<|endoftext|>▁\x00\x1c\x85"


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 90))) for _ in range(1500)] + ["a" * 2000, "ab" * 700, "é" * 300, "\n ", " \n", "  x"]


@pytest.mark.parametrize("width", [0, 1, 7, 8, 16, 17, 31])
def test_block_round_trip(width):
    ids = np.random.default_rng(width).integers(5, 5 + (1 << width), 777).astype(np.uint32)
    ids[[3, 700]] = 4_000_000_000
    assert (pt.unpack_block(pt.pack_block(ids)) == ids).all()
    packed = pt.pack_block(ids)
    assert packed[4] == int(np.sort(ids - ids.min())[770]).bit_length()  # the 99th percentile's width


def test_file_round_trip():
    class Sink:
        def __init__(self):
            self.buffer = pa.BufferOutputStream()

        def write(self, data):
            self.buffer.write(data)

        def close(self):
            self.data = self.buffer.getvalue()

    rng, sink = np.random.default_rng(1), Sink()
    writer, parts = pt.Writer(sink), [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 5000, 1024, 3, 70_000)]
    for part in parts:
        writer.add(part)
    writer.close()
    whole, reader = np.concatenate(parts), pt.Reader(pa.BufferReader(sink.data))
    for start, n in ((0, len(whole)), (1023, 2), (5, 0), (76_000, 27), (1024, 1024)):
        assert (reader.ids(start, n) == whole[start : start + n]).all()


def test_words_give_the_ids_of_the_whole_text(odd):
    encoder = pt.WordEncoder(BYTE)
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    for text, ids in zip(odd, encoder.encode(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files(spark):
    texts = [*TEXTS, "z", "z"]
    rows = documents(spark, texts).selectExpr("CASE WHEN doc_id < 2 THEN 1 ELSE doc_id END AS doc_id", "text", "1 AS at", "2 AS part")
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    ids = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    expected, start = [], 0
    for i, one in enumerate(ids):
        expected.append((max(i, 1), start, len(one), zlib.crc32(np.array(one, "<u4").tobytes())))
        start += len(one)
    assert sorted(map(tuple, pt.read(pt.write(rows, BYTE, 2)).collect())) == sorted(expected)
    assert pt.read(pt.write(rows.limit(0), BYTE, 2)).count() == 0


def test_pieces_like_the_library(odd):
    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECE), piece_bpe.PieceModel(PIECE)
    for text in [*odd, *[t for t in TEXTS if t]]:
        ids = library.encode(text)
        assert model.encode(text) == ids, repr(text[:80])
        assert model.decode(ids) == library.decode(ids), repr(text[:80])
        words = model.split(text)
        model.remember(set(words))
        if words:
            assert model.decode_words([model.known[w] for w in words]) == library.decode(ids)


def test_decode_of_any_ids():
    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECE), piece_bpe.PieceModel(PIECE)
    rng = random.Random(9)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(3, 32000), 259 + rng.randrange(60)]) for _ in range(rng.randrange(0, 9))]
        assert model.decode(ids) == library.decode(ids), ids


def test_piece_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = documents(spark).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "_text")
    found = {r["doc_id"]: tuple(r[1:]) for r in piece_bpe.digests(rows, PIECE).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "")
        assert found[i] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))), i
    assert {r["doc_id"]: r["ids"] for r in piece_bpe.encoded(rows, PIECE).collect()}[0] == library.encode(TEXTS[0])
    assert piece_bpe.digests(rows.limit(0), PIECE).count() == 0


def test_long_runs():
    """Runs whose merges all have one rank: equal to the library, and a megabyte of spaces in seconds."""
    import time

    plain, model = sentencepiece.SentencePieceProcessor(model_file=PIECE), piece_bpe.PieceModel(PIECE)
    rng = random.Random(8)
    texts = [" " * n + x for n in (1, 7, 13, 14, 15, 16, 17, 31, 100, 1003) for x in ("", "foo", "  x ", "=")]
    texts += ["".join(rng.choice([" ", "  ", "=", "==", "aa", "-", "x"]) * rng.randrange(1, 40) for _ in range(30)) for _ in range(60)]
    for text in texts:
        assert model.encode(text) == plain.encode(text), repr(text)
    began = time.time()
    assert model.encode(" " * 1_000_000) == plain.encode(" " * 1_000_000)
    assert time.time() - began < 10


def test_pairs_are_looked_up_beside_merges_only():
    """No more pairs are looked up than there are at first and beside merges."""
    model, rng, pairs = piece_bpe.PieceModel(PIECE), random.Random(6), []
    words = sorted({"▁" + "".join(rng.choice("etaoinshrdluéñ.日") for _ in range(rng.randrange(1, 40))) for _ in range(2000)})
    look_up = model._look_up
    model._look_up = lambda left, right: (pairs.append(len(left)), look_up(left, right))[1]
    chars = sum(map(len, words))
    merged = chars - sum(map(len, model.encode_words(words)))
    assert sum(pairs) <= chars + 2 * merged + 2 * len(words)


def test_pieces_of_chunks_like_the_library(odd, monkeypatch):
    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECE), piece_bpe.PieceModel(PIECE)
    monkeypatch.setattr(piece_bpe, "KEPT_WORDS", 300)
    texts = ["", *odd, "", *[t or "" for t in TEXTS], " ", "▁", ""]
    for some in (*(texts[a : a + 60] for a in range(0, len(texts), 60)), [""], ["", ""], texts[:5]):
        flat, n = model.encode_texts(some)
        assert len(n) == len(some)
        for text, ids, shown in zip(some, np.split(flat, np.cumsum(n)), model.texts_of(flat, n)):
            assert ids.tolist() == library.encode(text), repr(text[:80])
            assert tuple(bytes(x).decode() for x in shown) == (",".join(map(str, ids)), library.decode(ids.tolist())), repr(text[:80])


def test_library_encodes_many_words_at_once(monkeypatch):
    """One call for the new words of a chunk and one for the rest; a word and the mark after it are remembered apart."""
    encoder, library = pt.WordEncoder(BYTE), Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    given = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.append(list(texts))
            return library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(encoder, "tokenizer", Counted())
    texts = [f"Head{i} some word{'.,!?'[i % 4]} and éré{'.,;:'[i % 4]} more" for i in range(400)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(given) <= 4
    assert sum(x.count(" word") for texts in given for x in texts) == 1


def test_word_cuts_beside_odd_characters(monkeypatch):
    """Spaces before white space of any kind, marks after letters and signs of any kind."""
    encoder, library = pt.WordEncoder(BYTE), Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    monkeypatch.setattr(pt, "KEPT_IDS", 2000)
    monkeypatch.setattr(pt, "AT_ONCE", 7)
    rng, signs = random.Random(7), [*" \t\n.,'’!-_«(×÷éßàªºaZ7²日🙂", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\u3001", "\u0301", "'s", "'ll", "<|endoftext|>", " the", "  "]
    texts = ["", *["".join(rng.choice(signs) for _ in range(rng.randrange(0, 30))) for _ in range(6000)], ""]
    for some in (texts[:50], texts[50:3000], texts[3000:], [""], ["", ""]):
        for text, ids in zip(some, encoder.encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
