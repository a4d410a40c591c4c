from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freshet.functions import text, vocab
from freshet.functions.classify import department_key, department_of_title, level_of, map_department
from freshet.functions.scalars import (
    age_bucket, freshness_cutoff, freshness_days, is_http_url, parse_date, remap_level, salary_range,
)


def column(spark, values, schema, expr):
    rows = [(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def table(spark, cases, expr):
    found = column(spark, [c[0] for c in cases], "x string", expr(F.col("x")))
    assert found == [c[1] for c in cases]


def test_fold(spark):
    table(spark, [
        ("KÖLN", "koln"), ("Übersee", "ubersee"), ("Fußgänger", "fussganger"), ("Ærø", "aero"), ("Œuvre", "oeuvre"),
        ("Łukasz", "lukasz"), ("Diyarbakır", "diyarbakir"), ("éclair", "eclair"), ("ﬁne", "fine"), ("", ""), (None, None),
    ], text.fold)


def test_sanitize(spark):
    table(spark, [
        ("North Star (Holding)", "north star"), ("one–two — three", "one two three"), ("  A   B (c) d ", "a b d"),
        ("x & y", "x & y"), ("a.b c.", "a.b c."),
    ], text.sanitize)
    assert text.sanitize_literal("North-Star (Holding) X") == "north star x"
    for word in (*vocab.LEVELS, *vocab.DEPARTMENTS):
        assert text.sanitize_literal(word) == word


def test_slug(spark):
    table(spark, [("two words", "two%20words"), ("a+b", "a%2Bb"), ("50%", "50%25"), ("it's (ok)!~*", "it's%20(ok)!~*"), ("é/&", "%C3%A9%2F%26")], text.to_slug)
    table(spark, [("two%20words", "two words"), ("two+words", "two words"), ("a%2Bb", "a+b"), ("%E4%B8%A", ""), ("%zz", "")], text.from_slug)
    table(spark, [("Two+Words%20(x)", "two words")], text.company_from_slug)


def test_xml_and_like(spark):
    table(spark, [("a & b < \"c\" > 'd'", "a &amp; b &lt; &quot;c&quot; &gt; &apos;d&apos;")], text.xml_escape)
    assert text.escape_like("5%_\\") == "5\\%\\_\\\\"


def test_urls(spark):
    table(spark, [
        ("https://a.example/x?y=1", True), ("http://a.example", True), ("HTTPS://A.example", True), ("javascript:void(0)", False),
        ("data:text/html,x", False), ("/jobs/4", False), ("https://a.example/b c", True), ("https://a.example/b|c", True),
        ("https://a.example/{id}", True), ("https://a_b.example", True), (" https://u:p@a.example:8080?q#f ", True), ("https://[::1]/x", True),
        ("https://", False), ("https:///x", False), ("https://a b.example", False), ("ftp://a.example", False), ("", False), ("mailto:a@b.example", False), (None, False),
    ], is_http_url)


def test_age(spark):
    now = datetime(2024, 5, 6, 7, 8, 9)
    cases = [
        (timedelta(seconds=59), "now"), (timedelta(seconds=-90), "now"), (timedelta(minutes=1), "1m"), (timedelta(minutes=59, seconds=59), "59m"),
        (timedelta(hours=1), "1h"), (timedelta(hours=23, minutes=59), "23h"), (timedelta(days=1), "1d"), (timedelta(days=9, hours=5), "9d"),
    ]
    found = column(spark, [now - c[0] for c in cases], "x timestamp", age_bucket(F.col("x"), F.lit(now)))
    assert found == [c[1] for c in cases]


@pytest.mark.parametrize(("raw", "days"), [(7, 7), ("30", 30), (1.9, 1), (0, 15), (91, 15), (90, 90), ("x", 15), (None, 15), (float("nan"), 15)])
def test_freshness_days(raw, days):
    assert freshness_days(raw) == days


def test_cutoff_is_hourly():
    assert freshness_cutoff(datetime(2024, 3, 20, 10, 59, 59), 15) == datetime(2024, 3, 5, 10)


def test_salary(spark):
    rows = [
        (90000.0, 110000.0, "USD"), (90000.4, 110000.5, "EUR"), (1.0, 2.0, None), (1000.0, 2000.0, "XX"), (None, 2.0, "USD"), (5.0, 6.0, "chf"),
        (7000.0, 7000.0, "USD"), (7.0, 7.0, None),
    ]
    found = column(spark, rows, "a double, b double, c string", salary_range(F.col("a"), F.col("b"), F.col("c")))
    assert found == ["$90,000 – $110,000", "€90,000 – €110,001", "1 – 2", "1,000 – 2,000", None, "CHF\u00a05 – CHF\u00a06", "~$7,000", "7 – 7"]


def test_dates(spark):
    table(spark, [
        ("2024-02-03T04:05:06Z", datetime(2024, 2, 3, 4, 5, 6)), ("2024-02-03T04:05:06.789Z", datetime(2024, 2, 3, 4, 5, 6, 789000)),
        ("2024-02-03T04:05:06+02:00", datetime(2024, 2, 3, 2, 5, 6)), ("2024-02-03", datetime(2024, 2, 3)), ("soon", None), ("", None),
    ], parse_date)


def test_levels(spark):
    table(spark, [
        ("Data Engineering Intern", "intern"), ("Summer Internship", "intern"), ("Co-op Student", "intern"), ("Werkstudent", "intern"),
        ("Analyst, New Grad", "entry"), ("Jr. Buyer", "entry"), ("Entry-Level Clerk", "entry"), ("Senior Nurse", "senior"), ("Sr. Clerk", "senior"),
        ("Senior Principal Chemist", "lead"), ("Head of Legal", "lead"), ("VP, Sales", "lead"), ("Shift Lead", "lead"), ("Junior Baker to Senior Baker", "senior"),
        ("Internal Audit", "mid"), ("Leadership Coach", "mid"), ("Associate", "mid"), ("Chemist I", "mid"), ("", "mid"), ("SÉNIOR Clerk", "senior"),
    ], level_of)


def test_departments(spark):
    table(spark, [
        ("Staff Software Engineer", "engineering"), ("Product Designer", "product"), ("UX Writer", "design"), ("Account Executive", "sales"),
        ("Growth Manager", "marketing"), ("Talent Partner", "people"), ("Payroll Clerk", "finance"), ("Customer Support Agent", "customer support"),
        ("Business Intelligence Lead", "data & analytics"), ("Paralegal", "legal"), ("Logistics Planner", "operations"), ("Receptionist", "general"),
        ("Air Hostess", "general"), ("AI Trainer", "engineering"),
    ], department_of_title)
    table(spark, [("41 - Press", "press"), ("  Law   and Order ", "law and order"), ("9-Pins Bühne", "pins buhne")], department_key)


def test_department_hints(spark):
    names = spark.createDataFrame([("sales", "sales"), ("human resources", "people")], "key string, bucket string")
    rows = [
        (1, ["Unit 9", "Human Resources"]), (2, ["Sales", "Unit 9"]), (3, ["Other", "n/a"]), (4, []), (5, None), (6, ["Unit 9", "Unit 8"]),
        (7, ["", "040 - SALES"]),
    ]
    df = spark.createDataFrame(rows, "id int, hints array<string>")
    found = {r["id"]: (r["department"], r["unmapped"]) for r in map_department(df, "hints", "id", names).collect()}
    assert found == {
        1: ("people", ["unit 9"]), 2: ("sales", []), 3: (None, []), 4: (None, []), 5: (None, []), 6: (None, ["unit 9", "unit 8"]), 7: ("sales", []),
    }


def test_old_levels(spark):
    table(spark, [("vp", "lead"), ("staff", "lead"), ("entry", "entry"), ("associate", "mid"), ("senior", "senior"), (None, "mid")], remap_level)
