"""An index kept in segments against one built anew, and what an update reads and writes."""

import os
import random
import time
from collections import Counter

import pytest

from freshet.operators import search
from freshet.operators.segments import FAN, SegmentedIndex
from freshet.plans.streams import workdir

WORDS = "red green blue small large round flat old new".split()


def built(spark, docs):
    rows = spark.createDataFrame([(i, t) for i, t in sorted(docs.items())], "doc_id bigint, text string")
    return search.build_index(rows, "doc_id", ["text"])


def ids(spark, some):
    return spark.createDataFrame([(i,) for i in sorted(some)], "doc_id bigint")


def scores(index, query):
    return {r["doc_id"]: (round(r["title_score"], 9), round(r["score"], 9)) for r in search.bm25(index, search.read_query(query), "text", ["text"]).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_rebuild(spark, seed):
    pick = random.Random(seed)
    text = lambda: " ".join(pick.choice(WORDS) for _ in range(pick.randint(0, 9)))
    docs = {i: text() for i in range(60)}
    kept = SegmentedIndex(spark, workdir(spark), "bigint", slices=4)
    kept.update(built(spark, docs), ids(spark, docs))
    for wave in range(6):
        touched = {pick.randrange(75) for _ in range(pick.choice([1, 8, 20]))}
        for i in touched:
            docs.pop(i, None)
            if pick.random() < 0.7:
                docs[i] = text()
        kept.update(built(spark, {i: docs[i] for i in touched if i in docs}), ids(spark, touched))
    listed, fresh = kept.segments(), built(spark, docs)
    assert kept.index().stats() == fresh.stats()
    for query in ("red", "small blue", "large-round", "ne"):
        assert scores(kept.index(), query) == scores(fresh, query), query
    assert len(listed) <= FAN + 2 and [s["number"] for s in listed] == sorted({s["number"] for s in listed})


def test_an_update_writes_its_own_documents_only(spark):
    docs = {i: "red green " * (i % 5 + 1) for i in range(400)}
    kept = SegmentedIndex(spark, workdir(spark), "bigint", slices=32)
    kept.update(built(spark, docs), ids(spark, docs))
    before = kept.tables.current()["tables"]["live"]["folders"]
    kept.update(built(spark, {7: "blue"}), ids(spark, [7, 8]))
    first, second = kept.segments()
    assert (second["rows"], second["n"]) == (1, -1) and first["n"] == 400
    after = kept.tables.current()["tables"]["live"]["folders"]
    assert sum(before[s] != after.get(s) for s in before) <= 2  # the slices of two documents
    assert scores(kept.index(), "blue").keys() == {7} and 8 not in scores(kept.index(), "red")


def left_over(spark):
    """Names of the shuffle files that this session holds; they go a moment after their query."""
    def held():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {b for b in blocks.split() if b.startswith("shuffle_")}
    return held


def test_updates_hold_no_more_disk_than_their_segments(spark, monkeypatch):
    from freshet.operators import segments

    written = []
    monkeypatch.setattr(segments, "cut", lambda df, *a, f=segments.cut: written.append(df.columns) or f(df, *a))
    held, before = left_over(spark), left_over(spark)()
    root = workdir(spark)
    kept = SegmentedIndex(spark, root, "bigint", slices=4)
    docs = {i: f"red w{i % 7} green " * (i % 5 + 1) for i in range(80)}
    kept.update(built(spark, docs), ids(spark, docs))
    known = set()
    for wave in range(5):
        touched = [i for i in docs if i % 5 == wave]
        known = {s["folder"].rsplit("/", 1)[1] for s in kept.segments()}
        kept.update(built(spark, {i: docs[i] + " blue" for i in touched}), ids(spark, touched))
    now = {s["folder"].rsplit("/", 1)[1] for s in kept.segments()}
    assert len(now) < 6  # some were merged
    assert set(os.listdir(f"{root}/segments")) <= now | known  # what was replaced goes with the next update
    assert not any("positions" in columns for columns in written)  # terms are written once, in their segment
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
    assert scores(kept.index(), "blue") == scores(built(spark, {i: t + " blue" for i, t in docs.items()}), "blue")


def test_rows_of_one_pass_are_the_terms_and_the_lengths(spark, monkeypatch):
    table = [
        (1, "red Röd red", "Ab-c"), (2, "", None), (3, None, "x x"), (None, "blue", "of none"), (4, "small blue small", "red red"),
        (4, "small blue small", "red red"), (5, "ﬁ ß Ågren _ 7½", "naïve"), (6, "word " * 40, "y"),
    ]
    docs = spark.createDataFrame(table, "id bigint, title string, company string")
    plain = lambda df: Counter((r["doc_id"], r["field"], r["term"], r["length"], tuple(r["positions"])) for r in df.collect())
    index = search.build_index(docs, "id", ["title", "company"], ["id"])
    assert plain(index.rows.filter("term IS NOT NULL")) == plain(index.terms)
    lengths = index.rows.filter("term IS NULL")
    assert Counter(map(tuple, lengths.select("doc_id", "length").collect())) == Counter(map(tuple, index.lengths.collect()))
    assert lengths.filter("field IS NOT NULL OR positions IS NOT NULL").count() == 0


def test_runs_are_sorted_also_beyond_65536_terms():
    import pyarrow as pa

    words = [[[f"t{(i * 7919) % 70001}" for i in range(140000)]], [["b", "a", "b"]], [[]]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array(words, pa.list_(pa.list_(pa.string())))], ["doc_id", "w0"])
    rows = [r for b in search._sorted_runs(["text"])(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["length"]) for r in rows if r["term"] is None] == [(1, 140000), (2, 3), (3, 0)]
    found = [r for r in rows if r["term"] is not None]
    assert [(r["term"], r["doc_id"]) for r in found] == sorted((r["term"], r["doc_id"]) for r in found) and len(found) == 70003
    assert all([words[r["doc_id"] - 1][0][p] for p in r["positions"]] == [r["term"]] * len(r["positions"]) for r in found)
    assert sum(len(r["positions"]) for r in found) == 140003 and all(r["positions"] == sorted(r["positions"]) for r in found)


def test_unaccented_by_kinds_of_characters():
    import sys

    from freshet.functions.text import WIDE_KINDS, _unaccented, strip_marks

    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    some = random.Random(5).sample(every, 4000) + [chr(c) for c in range(0x80, 0x600)] + ["e\u0301\u0323", "ÅΣ Σας ΟΔΟΣ", "İi", "각"]
    texts = [" ".join(random.Random(i).choices(some, k=1 + i % 9)) + "aΣ" for i in range(3000)] + some
    texts += ["".join(every[0x80 : 0x80 + WIDE_KINDS + 1]), "".join(every[0xC0:0x17F])]
    assert [_unaccented(t) for t in texts] == [strip_marks(t, "NFD").lower() for t in texts]


def test_large_segments_are_merged_as_they_are(spark, monkeypatch):
    from freshet.operators import segments

    monkeypatch.setattr(segments, "RUN_WORDS", 20)
    docs = {i: f"red w{i % 7} green" for i in range(80)}
    kept = SegmentedIndex(spark, workdir(spark), "bigint", slices=4)
    kept.update(built(spark, docs), ids(spark, docs))
    for some in (range(0, 6), range(6, 14), range(14, 22), range(22, 40)):  # 24 to 72 rows, but none of them twice
        docs |= {i: "blue small flat old" for i in some}
        kept.update(built(spark, {i: docs[i] for i in some}), ids(spark, some))
    assert len(kept.segments()) == 2
    assert scores(kept.index(), "blue") == scores(built(spark, docs), "blue")
    assert scores(kept.index(), "w3") == scores(built(spark, docs), "w3")
