import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from freshet.functions.classify import department_dictionary
from freshet.operators.places import default_gazetteer
from freshet.sources import feeds
from freshet.sources.ingest import ingest

AT = "2024-05-01T09:00:00Z"
GOOD = {
    "greenhouse": {"id": 7, "title": "Clerk", "location": {"name": "Berlin; Paris"}, "updated_at": AT, "absolute_url": "https://a.example/7"},
    "lever": {"id": "7", "text": "Clerk", "categories": {"location": "Berlin"}, "createdAt": 1714554000000, "hostedUrl": "https://a.example/7"},
    "ashby": {"id": "7", "title": "Clerk", "location": "Berlin", "publishedAt": AT, "jobUrl": "https://a.example/7"},
    "smartrecruiters": {
        "id": "7", "name": "Clerk", "uuid": "u-7", "releasedDate": AT, "company": {"identifier": "x"}, "department": {}, "function": {},
        "location": {"fullLocation": "Berlin"}},
    "workable": {"title": "Clerk", "shortcode": "7", "published_on": "2024-05-01", "city": "Berlin", "country": "Germany", "url": "https://a.example/7"},
}
PREFIX = {"greenhouse": "gh", "lever": "lv", "ashby": "ab", "smartrecruiters": "sr", "workable": "wb"}


def body(provider, postings, total=None):
    if provider == "lever":
        return json.dumps(postings)
    if provider == "smartrecruiters":
        return json.dumps({"totalFound": len(postings) if total is None else total, "content": postings})
    return json.dumps({"jobs": postings})


def landed(spark, rows):
    return spark.createDataFrame([(*r, None)[:5] if len(r) == 5 else (r[0], r[1], r[2], None, r[3]) for r in rows], feeds.LANDED)


def read(spark, provider, *postings):
    pages = landed(spark, [(provider, "x", 0, body(provider, list(postings)))])
    return feeds.read_feeds(feeds.open_pages(pages, [provider]), [provider]).orderBy("pos").collect()


@pytest.mark.parametrize("provider", sorted(GOOD))
def test_good_posting(spark, provider):
    row = read(spark, provider, GOOD[provider])[0]
    assert row["id"] == f"{PREFIX[provider]}-x-7"
    assert (row["title"], row["company"], row["source"], row["department"], row["hints"], row["salary"]) == ("Clerk", "x", provider, "", [], "")
    assert row["posted_at"] == (datetime(2024, 5, 1) if provider == "workable" else datetime(2024, 5, 1, 9))
    assert row["is_remote"] is False
    expected = {"greenhouse": ["Berlin", "Paris"], "workable": ["Berlin, Germany"]}.get(provider, ["Berlin"])
    assert row["locations"] == expected and row["location"] == expected[0]


@pytest.mark.parametrize(("provider", "change", "reason"), [
    ("greenhouse", {"id": "7"}, "id: expected number"), ("greenhouse", {"title": 5}, "title: expected string"),
    ("greenhouse", {"location": None}, "location.name: expected string"), ("greenhouse", {"metadata": {}}, "metadata: expected array"),
    ("greenhouse", {"metadata": [{"value": 1}]}, "metadata: expected named fields"),
    ("lever", {"createdAt": "x"}, "createdAt: expected number"), ("lever", {"categories": []}, "categories: expected object"),
    ("ashby", {"isRemote": "yes"}, "isRemote: expected boolean"), ("ashby", {"location": None}, "location: expected string"),
    ("smartrecruiters", {"department": {"label": 3}}, "department.label: expected string"), ("smartrecruiters", {"uuid": None}, "uuid: expected string"),
    ("workable", {"published_on": None}, "missing posting date"), ("workable", {"locations": "x"}, "locations: expected array"),
])
def test_bad_posting_is_skipped_alone(spark, provider, change, reason):
    postings = [GOOD[provider], {**GOOD[provider], **change}, {**GOOD[provider], **change}, "nonsense"]
    pages = feeds.open_pages(landed(spark, [(provider, "x", 0, body(provider, postings))]), [provider])
    assert feeds.read_feeds(pages, [provider]).count() == 1
    summary = feeds.skip_summary(pages, provider).first()
    assert (summary["skipped"], summary["reason"]) == (3, reason)


@pytest.mark.parametrize("provider", sorted(GOOD))
def test_broken_page_fails_the_board_only(spark, provider):
    good = body(provider, [GOOD[provider]])
    pages = landed(spark, [(provider, "x", 0, good), (provider, "x", 1, "<html>"), (provider, "y", 0, good), (provider, "z", 0, '{"other":1}'), (provider, "n", 0, None)])
    pages = feeds.open_pages(pages, [provider])
    found = {r["board"] for r in feeds.read_feeds(pages, [provider]).collect()}
    failed = {r["board"] for r in feeds.failed_boards(pages, provider).collect()}
    assert found == {"y"}
    assert failed == ({"x", "n"} if provider == "workable" else {"x", "z", "n"})


def test_greenhouse_fields(spark):
    pay = {"name": "Salary band", "value": {"min": 1000, "max": 2000.5, "currency": "EUR"}, "value_type": "currency_range"}
    posting = {**GOOD["greenhouse"], "first_published": "2024-04-01T00:00:00+02:00",
               "metadata": [{"name": "Area", "value": None}, {"name": "Department", "value": "Legal"}, pay]}
    row = read(spark, "greenhouse", posting)[0]
    assert (row["department"], row["salary"], row["posted_at"]) == ("", "€1,000 – €2,001", datetime(2024, 3, 31, 22))
    posting["metadata"] = [{"name": "Business area", "value": "no"}, {"name": "Job Category", "value": 12}, {**pay, "value": {"min": "a"}}]
    row = read(spark, "greenhouse", posting)[0]
    assert (row["department"], row["salary"]) == ("12", "")


def test_remote_forms(spark):
    rows = read(spark, "ashby", {**GOOD["ashby"], "isRemote": True}, {**GOOD["ashby"], "isRemote": True, "location": "REMOTE (EU)"})
    assert [r["location"] for r in rows] == ["Remote — Berlin", "REMOTE (EU)"]
    base = GOOD["smartrecruiters"]
    rows = read(spark, "smartrecruiters", {**base, "location": {"remote": True}}, {**base, "location": None}, {**base, "location": {"remote": True, "fullLocation": "Rome"}})
    assert [(r["location"], r["is_remote"]) for r in rows] == [("Remote", True), ("Unknown", False), ("Remote — Rome", True)]
    base = {**GOOD["workable"], "telecommuting": True, "locations": [{"city": "Rome", "country": "Italy"}, {"city": "", "country": None}]}
    rows = read(spark, "workable", base, {**base, "city": None, "country": None, "locations": None, "url": None, "shortlink": "https://s.example"})
    assert [(r["location"], r["locations"], r["url"]) for r in rows] == [
        ("Remote — Berlin, Germany", ["Rome, Italy", "Remote — Berlin, Germany"], "https://a.example/7"), ("Remote", ["Remote"], "https://s.example")]


def test_pages_and_completeness(spark):
    posting = GOOD["smartrecruiters"]
    hundred = [{**posting, "id": str(i)} for i in range(100)]
    fifty = [{**posting, "id": str(i)} for i in range(100, 150)]
    rows = [("a", 0, body("smartrecruiters", hundred, 150)), ("a", 1, body("smartrecruiters", fifty, 150)), ("b", 0, body("smartrecruiters", hundred, 150)),
            ("c", 0, body("smartrecruiters", hundred, 900)), ("c", 1, body("smartrecruiters", [], 900)),
            ("d", 0, body("smartrecruiters", hundred, 250)), ("d", 2, body("smartrecruiters", fifty, 250)),
            ("e", 0, body("smartrecruiters", fifty, 50)), ("e", 0, body("smartrecruiters", fifty, 50))]
    pages = feeds.open_pages(landed(spark, [("smartrecruiters", *r) for r in rows]), ["smartrecruiters"])
    assert feeds.read_feeds(pages, ["smartrecruiters"]).filter("board = 'a'").count() == 150
    assert {r["board"]: r["complete"] for r in feeds.completeness(pages, "smartrecruiters").collect()} == {
        "a": True, "b": False, "c": True, "d": False, "e": True}


def test_unknown_provider():
    with pytest.raises(ValueError, match="unknown provider"):
        feeds.provider("other")


def test_changed_boards(spark):
    rows = [("lever", "a", 0, "v1", "x"), ("lever", "b", 0, None, "x"), ("lever", "c", 0, "v2", "x"), ("lever", "d", 0, None, "y"),
            ("ashby", "a", 0, "v1", "x"), ("lever", "e", 0, "v1", "x"), ("lever", "e", 1, "v2", "x"), ("lever", "f", 0, "v1", "x")]
    pages = spark.createDataFrame(rows, feeds.LANDED)
    digest = pages.select(F.sha2(F.lit("x"), 256)).first()[0]
    marks = [("a", 0, "v1"), ("b", 0, digest), ("c", 0, "v1"), ("d", 0, digest), ("e", 0, "v1"), ("e", 1, "v1"), ("f", 0, "v1"), ("f", 1, "v1")]
    seen = spark.createDataFrame([("lever", *m) for m in marks], "provider string, board string, page int, mark string")
    found = sorted((r["provider"], r["board"], r["page"]) for r in feeds.changed_boards(pages, seen).collect())
    # another feed's board of the same name, a whole board for one changed page, a board that lost a page
    assert found == [("ashby", "a", 0), ("lever", "c", 0), ("lever", "d", 0), ("lever", "e", 0), ("lever", "e", 1), ("lever", "f", 0)]


def test_ingest(spark):
    base = GOOD["ashby"]
    postings = [
        {**base, "id": "1", "title": "Senior Counsel", "department": "Unit 4", "team": "Human Resources"},
        {**base, "id": "2", "jobUrl": "javascript:x"}, {**base, "id": "3", "publishedAt": "2023-01-01"}, {**base, "id": "4", "publishedAt": "soon"},
        {**base, "id": "5", "location": "nowhere", "isRemote": True}, {**base, "id": "1", "title": "Head of Legal", "department": "Unit 4"},
    ]
    pages = landed(spark, [("ashby", "x", 0, body("ashby", postings))])
    registry = spark.createDataFrame([("ashby", "x", "North Star (Holding)")], "provider string, name string, label string")
    done = ingest(feeds.read_feeds(feeds.open_pages(pages)), registry, default_gazetteer(spark), department_dictionary(spark), datetime(2024, 5, 10, 12, 30))
    rows = {r["id"]: r for r in done.postings.collect()}
    assert set(rows) == {"ab-x-1", "ab-x-5"}
    one, five = rows["ab-x-1"], rows["ab-x-5"]
    assert (one["company"], one["level"], one["department"], one["city"], one["location"]) == ("north star", "lead", "legal", "berlin", "berlin, germany")
    assert (five["location"], five["is_remote"], five["department"]) == ("remote", True, "general")
    assert [tuple(r) for r in done.facets.collect()] == [("ab-x-1", "berlin", "germany")]
    assert [(r["company"], r["distinct_names"], r["sample"]) for r in done.unmapped.collect()] == [("north star", 1, ["unit 4"])]
    assert [r["rejected"] for r in done.rejected_urls.collect()] == [1]
