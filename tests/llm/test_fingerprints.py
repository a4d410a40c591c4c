import re
import struct

import xxhash

from freshet.llm import winnow_fingerprint as wf
from tests.llm.helpers import TEXTS, documents, sha


def long_of(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
    return long_of(seed)


def of_texts(parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
    return long_of(seed)


def brute(text):
    words = [w for w in re.split(r"[ \t-\r]+", (text or "").lower()) if w]
    hashes = []
    for w in words:  # a long word counts as its runs of characters
        if len(w) > wf.LONG_WORD:
            hashes += [of_texts(w[i : i + wf.CHARS]) for i in range(len(w) - wf.CHARS + 1)]
        else:
            hashes.append(of_texts([w]))
    if not hashes:
        return []
    grams = [chained(hashes[i : i + wf.K]) for i in range(len(hashes) - wf.K + 1)] or [chained(hashes)]
    kept = []
    width = max(min(len(grams) // wf.SPREAD, wf.WINDOW), 1)
    for i in range(len(grams) - width + 1):
        window = grams[i : i + width]
        least = min(window)
        place = i + max(j for j, g in enumerate(window) if g == least)
        if place not in kept:
            kept.append(place)
    return [(p, grams[p]) for p in kept]


def spelled(prints):
    return " ".join(f"{p}:{g % (1 << 64):x}" for p, g in prints)


def like(a, b):
    x, y = {g for _, g in a}, {g for _, g in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_like_brute_force(spark):
    texts = [t.replace("İ", "i") if t else t for t in TEXTS]
    found = {r["doc_id"]: r for r in wf.compare(documents(spark, texts).withColumnRenamed("source", "_text")).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        text, following = text or "", texts[(i + 1) % len(texts)] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        a, b, c = brute(text), brute(edited), brute(following)
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        # hex() of Spark writes no leading zeros and upper case
        assert r["fingerprint"] == spelled(a) and r["edited_fingerprint"] == spelled(b), i
        assert abs(r["near_edited"] - like(a, b)) < 1e-12 and abs(r["near_next"] - like(a, c)) < 1e-12


def test_scripts_without_spaces_and_short_texts(spark):
    """Three quarters of a text stay: that shows without spaces, and in few words."""
    import random

    rng = random.Random(6)
    signs = [chr(0x4E00 + rng.randrange(3000)) for _ in range(400)]
    texts = ["".join(rng.choice(signs) for _ in range(2000)) for _ in range(4)]
    texts += [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (12, 10, 11, 16, 24, 40)]
    found = {r["doc_id"]: r for r in wf.compare(documents(spark, texts)).collect()}
    for i in range(3):  # the fourth ends in the words of the next text
        assert found[i]["near_edited"] > 0.4 and found[i]["near_next"] < 0.05, (i, found[i]["near_edited"])
    for i in range(3, 9):
        assert found[i]["near_edited"] > 0.15, (i, found[i]["near_edited"])
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        q = len(text) // 4
        assert found[i]["fingerprint"] == spelled(brute(text)) and found[i]["edited_fingerprint"] == spelled(brute(text[: len(text) - q] + following[:q])), i


def test_shared_spans_share_a_hash(spark):
    span = " ".join(f"s{i}" for i in range(wf.K + wf.WINDOW - 1))
    a, b = f"p q r {span} t u", f"v {span} w x y z"
    rows = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    prints = [{x["hash"] for x in r["p"]} for r in rows.select(wf.fingerprint(rows["text"]).alias("p")).collect()]
    assert prints[0] & prints[1]


def test_keys_null_tied_single_and_empty(spark):
    schema = "doc_id long, text string"
    tied = spark.createDataFrame([(None, "n n"), (5, "b b b b"), (5, "a a a a"), (7, "c"), (7, "c")], schema)
    order = [r["_next_text"] for r in sorted(wf.with_next(tied, "doc_id", "text").collect(), key=lambda r: (r["_key"] is not None, r["_key"] or 0, r["_text"]))]
    assert order == ["a a a a", "b b b b", "c", "c", "n n"]
    one = wf.compare(spark.createDataFrame([(3, "x y z w x y z w")], schema)).collect()
    assert one[0]["near_next"] == 1.0
    assert wf.compare(spark.createDataFrame([], schema)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = wf.compare(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
