"""Alignment against the two libraries run over whole texts, and counts over all documents in plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from freshet.llm import token_alignment as ta
from freshet.llm.registry import tokenizer_file
from tests.llm.helpers import TEXTS, documents, sha

BYTE, PIECE = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
LETTERS = "abc the 'sdre  \n\t　  éñ日🙂09#!.<|endoftext|>\x00\x1c\x85 "
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_table():
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(BYTE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
        self.table = byte_table()

    def tokens(self, text):
        """(A ids, B ids, spans of both), or None."""
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False), self.b.encode(text)
        spelled_a = [bytes(self.table[c] for c in t) for t in a.tokens]
        spelled_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in b)]
        if b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            return None
        spans = []
        for spelled in (spelled_a, spelled_b):
            at, own = 0, []
            for s in spelled:
                own.append((at, at + len(s)))
                at += len(s)
            spans.append(own)
        return a.ids, b, *spans

    def document(self, text):
        """(n_a, n_b, n_groups, links, digest)."""
        found = self.tokens(text)
        if found is None:
            return 0, 0, 0, [], ""
        a, b, spans_a, spans_b = found
        links, start = [], 0
        for i, (low, high) in enumerate(spans_a):
            while start < len(b) and spans_b[start][1] <= low:
                start += 1
            j = start
            while j < len(b) and spans_b[j][0] < high:
                links.append((a[i], b[j]))
                j += 1
        common = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        ends_a, ends_b = [e for _, e in spans_a], [e for _, e in spans_b]
        shown, pa, pb = [], 0, 0
        for end in common:
            na, nb = ends_a.index(end, pa) + 1, ends_b.index(end, pb) + 1
            shown.append(",".join(map(str, a[pa:na])) + "|" + ",".join(map(str, b[pb:nb])))
            pa, pb = na, nb
        return len(a), len(b), len(common), links, sha(";".join(shown))


def brute(texts):
    plain = Plain()
    found = [plain.document(t) for t in texts]
    counts = Counter(p for d in found for p in set(d[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (i, n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest)
        for i, (n_a, n_b, n_groups, links, digest) in enumerate(found)
    ]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(7)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 90))) for _ in range(600)]
    return [*TEXTS, *texts, "a" * 2000, "é" * 300, "\n ", " \n", "  x", "x  ", "x ", "   ", "x \n  y ", "日本語" * 50, "<0x41> <unk>", " ".join(["the cat"] * 50), "don't can't  we'll  it's"]


def test_equals_whole_texts(spark, odd):
    found = ta.digests(documents(spark, odd).repartition(5), BYTE, PIECE)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == brute(odd)


def test_small_memory_and_chunks(spark, odd, monkeypatch):
    """Forgotten pieces and many small chunks change nothing."""
    aligner = ta.Aligner(BYTE, PIECE)
    monkeypatch.setattr(ta, "KEPT_BYTES", 50)
    monkeypatch.setattr(ta, "AT_ONCE", 7)
    plain = Plain()
    for text in odd:
        own = aligner.numbers(text or "")
        n_a, n_b, n_groups, links, digest = plain.document(text)
        assert aligner.figures[own].sum(axis=0).tolist() == [n_a, n_b, n_groups, len(links)], text
        ends = np.cumsum(aligner.figures[:, 3])
        assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for i in own for x in aligner.links[ends[i] - aligner.figures[i, 3] : ends[i]]] == links
        assert digest == (sha(";".join(aligner.texts[i] for i in own)) if own else "")


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "Same words here"), (1, "Same words here"), (None, "Same words"), (2, None), (3, ""), (4, "a▁b")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, chunk string, pairs long")
    found = sorted(map(tuple, ta.digests(df, BYTE, PIECE).collect()), key=repr)
    expected = [(rows[r[0]][0], *r[1:]) for r in brute([t for _, t in rows])]
    assert found == sorted(expected, key=repr)
    assert ta.digests(df.limit(0), BYTE, PIECE).collect() == []


def test_groups(spark):
    text = "Tokenizers disagree: naïveté, 12345, 日本"
    found = ta.aligned(documents(spark, [text, None, "a▁b"]), BYTE, PIECE).orderBy("doc_id").collect()
    plain = Plain()
    a, b, spans_a, spans_b = plain.tokens(text)
    groups = found[0]["groups"]
    assert [i for g in groups for i in g["a"]] == a and [i for g in groups for i in g["b"]] == b
    assert [g["end"] for g in groups] == sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    assert found[1]["groups"] == [] and found[2]["groups"] == []


def test_other_models_are_refused(tmp_path):
    import json

    with open(BYTE, encoding="utf-8") as file:
        stated = json.load(file)
    stated["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(stated))
    with pytest.raises(ValueError):
        ta.Aligner(str(path), PIECE)
