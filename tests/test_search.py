import random
import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freshet.operators import listing, search
from freshet.operators.search import Phrase, read_query

FIELDS = ("title", "company", "location", "department")
WORDS = ["senior", "data", "engineer", "full-stack", "München", "designer", "go", "frontend", "front", "lead", "c++", "straße"]


def test_read_query():
    assert read_query("front") == [Phrase(("front",), True)]
    assert read_query("senior front") == [Phrase(("senior",)), Phrase(("front",), True)]
    assert read_query('c" ++ go') == [Phrase(("c",)), Phrase(("go",), True)]
    assert read_query("c++") == [Phrase(("c",))]
    assert read_query("r") == [Phrase(("r",))]
    assert read_query("full-stack") == [Phrase(("full", "stack"))]
    assert read_query("Müller") == [Phrase(("muller",), True)]
    assert read_query(" ++ ") == []


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [
        (f"gh-acme-{i}", *[" ".join(rng.choices(WORDS, k=rng.randint(1, 6))) for _ in FIELDS]) for i in range(120)
    ]
    return rows, spark.createDataFrame(rows, "id string, title string, company string, location string, department string")


@pytest.mark.parametrize("indexed", [True, False])
@pytest.mark.parametrize("query", ["front", "senior data", "full-stack", "engineer full-stack go", "c++", "munchen straße", "strasse", "lead de"])
def test_bm25_like_a_text_index(spark, docs, query, indexed):
    rows, df = docs
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, company, location, department, id)")
    con.executemany("INSERT INTO t(id, title, company, location, department) VALUES (?, ?, ?, ?, ?)", rows)
    words = query.split()
    last = words[-1]
    terms = [f'"{w}"' for w in words[:-1]] + [f'"{last}"*' if len(last) > 1 and last.isalnum() else f'"{last}"']
    match = "{title company location department} : (" + " ".join(terms) + ")"
    expected = {
        r[0]: (r[1], r[2])
        for r in con.execute("SELECT id, bm25(t, 1, 0, 0, 0, 0), bm25(t, 1, 1, 1, 1, 0) FROM t WHERE t MATCH ?", (match,))
    }
    index = search.build_index(df, "id", FIELDS, ["id"]) if indexed else search.TextScan(df, "id", FIELDS, ["id"])
    found = {r["doc_id"]: (r["title_score"], r["score"]) for r in search.bm25(index, read_query(query), "title", FIELDS).collect()}
    assert set(found) == set(expected)
    for doc, scores in expected.items():
        assert found[doc] == pytest.approx(scores, abs=1e-9)
    ids = {r[0] for r in search.match_ids(index, read_query(query), "title", FIELDS).collect()}
    assert ids == set(expected)


def test_nothing_searchable_matches_nothing(spark, docs):
    index = search.build_index(docs[1], "id", FIELDS, ["id"])
    assert search.match_ids(index, read_query("+++"), "title", FIELDS).count() == 0


NOW = datetime(2024, 6, 1, 12, 30)


def postings(spark, rows):
    base = {"company": "acme", "location": "berlin, germany", "department": "engineering", "level": "mid", "url": "https://a.example/1",
            "is_remote": False, "posted_at": NOW - timedelta(hours=1)}
    full = [{**base, **r} for r in rows]
    return spark.createDataFrame(full, "id string, title string, company string, location string, department string, level string, url string, is_remote boolean, posted_at timestamp")


def test_title_match_leads_then_freshness(spark):
    rows = [{"id": "a", "title": "Data Engineer", "posted_at": NOW - timedelta(days=5)}, {"id": "b", "title": "Clerk", "company": "data engineer inc"}]
    rows += [{"id": f"z{i}", "title": "Nurse"} for i in range(8)]
    df = postings(spark, rows)
    request = listing.SearchRequest(q="data engineer")
    page, total = search.search(df, search.build_index(df, "id", FIELDS, ["id"]), request, NOW, "title", FIELDS)
    assert [r["id"] for r in page.collect()] == ["a", "b"]
    assert total.first()[0] == 2


def test_paging_without_gaps(spark):
    df = postings(spark, [{"id": f"p{i:03d}", "title": "x"} for i in range(120)])
    rows = listing.filter_postings(df, None, listing.SearchRequest(), NOW)
    seen = []
    for offset in (0, 50, 100):
        request = listing.SearchRequest(limit=50, offset=offset)
        seen += [r["id"] for r in listing.page(rows, listing.newest_order(), request).collect()]
    assert seen == [f"p{i:03d}" for i in reversed(range(120))]
    after, last = [], None
    while True:
        page = (listing.page(rows, listing.newest_order(), listing.SearchRequest(limit=50)) if last is None
                else listing.page_after(rows, last["posted_at"], last["id"], 50)).collect()
        after += [r["id"] for r in page]
        if len(page) < 50:
            break
        last = page[-1]
    assert after == seen


def test_filters(spark):
    df = postings(spark, [
        {"id": "a", "title": "x"}, {"id": "b", "title": "x", "url": "javascript:x"}, {"id": "c", "title": "x", "posted_at": NOW - timedelta(days=16)},
        {"id": "d", "title": "x", "location": "100% here", "level": "senior"}, {"id": "e", "title": "x", "is_remote": True, "company": "north star"},
        {"id": "f", "title": "x", "posted_at": NOW - timedelta(days=3)},
    ])
    facets = spark.createDataFrame([("a", "berlin", "germany"), ("d", "", "germany")], "job_id string, city string, country string")

    def ids(place=None, **given):
        return sorted(r["id"] for r in listing.filter_postings(df, facets, listing.SearchRequest(**given), NOW, 15, place).collect())

    assert ids() == ["a", "d", "e", "f"]
    assert ids(posted="today") == ["a", "d", "e"]
    assert ids(posted="someday") == ["a", "d", "e", "f"]
    assert ids(company="North-Star (x)") == ["e"]
    assert ids(level="Senior") == ["d"]
    assert ids(location="0% H") == ["d"]
    assert ids(location="remote, germany", place=listing.Place(country="germany", remote=True)) == ["e"]
    assert ids(location="germany", place=listing.Place(country="germany")) == ["a", "d"]
    assert ids(city="Berlin") == ["a"]


def test_prefix_excludes_longer_siblings(spark):
    df = spark.createDataFrame([("gh-x-1",), ("gh-xy-1",), ("gh-x-",), ("gh-x",)], "id string")
    assert sorted(r[0] for r in df.filter(listing.id_prefix("gh-x-")).collect()) == ["gh-x-", "gh-x-1"]


def test_strict_and_lenient_requests():
    good = listing.read_request({"q": " data ", "limit": "900", "offset": "10abc", "sort": "odd"})
    assert (good.q, good.limit, good.offset, good.sort) == ("data", 500, 10, "odd")
    for bad, code in [({"posted": "year"}, "invalid_posted"), ({"offset": "10001"}, "offset_too_large"), ({"company": "x" * 101}, "param_too_long"), ({"q": "x" * 201}, "param_too_long")]:
        with pytest.raises(listing.RequestError, match=code):
            listing.read_request(bad)
    kept = listing.read_lenient({"q": "x" * 201, "level": "boss", "sort": "company", "department": " legal "})
    assert kept == listing.SearchRequest(sort="company", department="legal")


@pytest.mark.parametrize(("size", "offset", "total", "more"), [(50, 0, 51, True), (50, 0, 50, False), (49, 0, None, False), (50, 10_000, None, False), (50, 9_950, None, True)])
def test_more_pages(size, offset, total, more):
    assert listing.more_pages(size, 50, offset, total) is more


def test_boost_spans_one_to_two(spark):
    cutoff = datetime(2024, 1, 1)
    row = spark.createDataFrame([(cutoff, cutoff + timedelta(days=15))], "a timestamp, b timestamp").select(
        search.boost(F.col("a"), cutoff, 15), search.boost(F.col("b"), cutoff, 15)).first()
    assert list(row) == [1.0, 2.0]


def test_common_term_has_several_ranges(spark, tmp_path):
    """Rows of one term are spread over tasks, and rows of one id are one document."""
    adaptive = "spark.sql.adaptive.enabled"  # it would join the few rows of a test again
    spark.conf.set(adaptive, "false")
    try:
        rows = spark.range(4000).select(F.col("id"), F.lit("same").alias("text"))
        search.store_index(search.build_index(rows, "id", ["text"]), str(tmp_path))
        files = spark.read.parquet(f"{tmp_path}/terms").filter("term = 'same'").groupBy(F.input_file_name()).count().collect()
        assert sum(r["count"] for r in files) == 4000 and len(files) > 1 and max(r["count"] for r in files) < 3000
    finally:
        spark.conf.set(adaptive, "true")


def test_index_of_odd_documents(spark):
    rows = [(1, "b a b", "x"), (1, "b a b", "x"), (2, None, "Émile émile"), (3, "", None), (None, "a", "a")]
    index = search.build_index(spark.createDataFrame(rows, "id int, t string, u string"), "id", ["t", "u"])
    found = {(r["doc_id"], r["field"], r["term"]): (r["length"], list(r["positions"])) for r in index.terms.collect()}
    assert found == {
        (1, "t", "b"): (4, [0, 0, 2, 2]), (1, "t", "a"): (4, [1, 1]), (1, "u", "x"): (4, [0, 0]),
        (2, "u", "emile"): (2, [0, 1]), (None, "t", "a"): (2, [0]), (None, "u", "a"): (2, [0]),
    }
    assert sorted(r["length"] for r in index.lengths.collect()) == [0, 2, 2, 4, 4]
