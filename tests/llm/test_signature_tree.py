import re

import numpy as np

from freshet.llm import signature_tree as st
from tests.llm.helpers import TEXTS, documents


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(texts):
    """(size, component) by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    least = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    return {i: (len(s), least[i]) for i, s in enumerate(sets)}


def found(spark, texts):
    rows = st.components(documents(spark, texts).withColumnRenamed("source", "mark")).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def near_copies(rng, families, members, edits, length=60):
    out = []
    for f in range(families):
        base = [f"f{f}w{i}" for i in range(length)]
        for _ in range(members):
            one = list(base)
            for _ in range(int(rng.integers(0, edits + 1))):
                one[int(rng.integers(0, length))] = f"e{rng.integers(0, 10**9)}"
            out.append(" ".join(one))
    return out


def test_like_all_pairs(spark):
    rng = np.random.default_rng(5)
    shared = " ".join(f"common{i}" for i in range(55))
    passages = [shared + " " + " ".join(f"own{i}x{j}" for j in range(12 + i)) for i in range(20)]
    texts = TEXTS + near_copies(rng, 6, 25, 3) + passages + near_copies(rng, 1, 60, 4) + ["The QUICK brown fox jumps"] * 2 + ["the quick brown"] * 2
    assert found(spark, texts) == brute(texts)


def test_large_neighbourhoods_are_searched_in_parts(spark, monkeypatch):
    monkeypatch.setattr(st, "RUN", 16)
    texts = near_copies(np.random.default_rng(8), 2, 70, 4, 50)
    assert found(spark, texts) == brute(texts)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    texts = [t.encode() for t in near_copies(rng, 3, 40, 3)]
    sets = sorted(st.sets_of(texts), key=len)
    tree = st.Tree(np.array([len(s) for s in sets]), [st.bitmap_of(s) for s in sets], np.arange(len(sets)))
    kept = set(zip(*(x.tolist() for x in tree.pairs())))
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert links <= kept and len(kept) < len(sets) * (len(sets) - 1) // 2


def test_contract(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45), (7, 7)], "a long, b long")
    got = {r["mark"]: r["component"] for r in st.contract(links).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 45: 40, 50: 40}


def test_null_keys_ties_and_empty(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "A b c d e f"), (4, "a b c d e f"), (9, ""), (None, None)], "doc_id long, text string")
    got = sorted((r[0] or -1, r[1], r[2] if r[2] is not None else -1) for r in st.components(rows).collect())
    assert got == [(-1, 0, -1), (-1, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9)]
    assert st.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
