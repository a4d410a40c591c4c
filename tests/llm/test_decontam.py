import random
import re

import pytest

from freshet.llm import winnow_decontam as wd
from tests.llm.helpers import LONG, TEXTS, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = {}
    for i, text in enumerate(texts):
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out[i] = (len(w), len(hit), sorted(map(str, found)), len(found))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.choice([3, 9, 10, 11, 30])))) for i in range(25)]
    items += [(100, items[0][1]), (101, None), (102, ""), (103, "Solo"), (104, LONG[:400]), (9, items[4][1].upper())]
    texts = list(TEXTS)
    for _ in range(150):
        parts = [" ".join(rng.choice("abcdefgxyz") for _ in range(rng.randrange(0, 30)))]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items)[1] or ""
            at = rng.randrange(0, 8)
            parts += [" ".join(w.split()[at : at + rng.randrange(5, 25)]), rng.choice(["-", "x1", "ÉÉ", "solo,"])]
        texts.append(" ".join(parts))
    return texts, items


@pytest.mark.parametrize("most", [wd.FILTER_ROWS, 0])
def test_like_brute_force(spark, case, most, monkeypatch):
    monkeypatch.setattr(wd, "FILTER_ROWS", most)  # 0: the fingerprints of all documents are joined
    texts, items = case
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, print int")
    rows = wd.contamination(documents(spark, texts).withColumnRenamed("lang", "n_hit"), bench).collect()
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["n_items"]) for r in rows}
    assert found == brute(texts, items) and any(v[1] for v in found.values())


def test_rows(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = spark.createDataFrame([(None, "x one two three"), (2, "one two"), (2, "One TWO three four"), (2, "one two")], "doc_id long, text string")
    found = sorted((r[0] or 0, r["n_words"], r["n_hit"]) for r in wd.contamination(rows, bench).collect())
    assert found == [(0, 4, 3), (2, 2, 0), (2, 2, 0), (2, 4, 3)]
    assert sorted(r["text"] for r in wd.untouched(rows, bench).collect()) == ["one two", "one two"]
    assert {r["n_hit"] for r in wd.contamination(rows, bench.limit(0)).collect()} == {0}
    assert wd.contamination(rows.limit(0), bench).count() == 0
