"""Physical plans of the registered queries."""

import re

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
# Streams and jobs that write tables before they return; their parts are covered by other queries.
# The numbered operators and the pipeline have tests of their own.
PLAIN = sorted(n for n in QUERIES if not n.startswith(("stream_", "keyed_", "index_segment", "ingest_", "sweep_", "telemetry_")) and n != "rejected_urls" and not re.match(r"op\d+_|pipeline$", n))


def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_join_and_no_single_task_window(spark, sf, name):
    text = plan(spark, sf, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for window in re.findall(r"Window \[.*?\], \[(.*?)\]", text):
        assert window, text


def test_page_is_a_top_k_with_pushed_filters(spark, sf):
    text = plan(spark, sf, "fresh_page")
    assert "TakeOrderedAndProject" in text
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)
    assert "o_totalprice" not in text


def test_facets_read_two_columns_of_the_lines(spark, sf):
    text = plan(spark, sf, "facet_cities")
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in text


def test_the_diff_shuffles_each_side_once(spark, sf):
    text = plan(spark, sf, "snapshot_diff")
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 2


def test_expiry_needs_no_join_of_the_table_with_itself(spark, sf):
    text = plan(spark, sf, "stale_sweep")
    assert "Anti" not in text and len(re.findall(r"FileScan parquet \[o_", text)) == 1


def test_facet_levels_come_from_one_join(spark, sf):
    text = plan(spark, sf, "facet_tree")
    assert len(re.findall(r"FileScan parquet \[l_orderkey", text)) == 1
    assert "count(distinct" not in plan(spark, sf, "facet_cities")


def test_search_reads_the_index_by_term(spark, sf):
    from freshet.operators import search
    from freshet.plans.texts import FIELDS, kept_index

    phrases = search.read_query("data-analyst eur")
    counts = search.phrase_counts(kept_index(spark, sf, "postings"), phrases, "title", FIELDS)
    text = counts._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet .*", text)
    assert scans and all("freshet-index" in s and "StringStartsWith(term,eur)" in s and "term,analyst" in s.replace(" ", "") or "In(term" in s for s in scans), scans
    assert "o_orderkey" not in text and "o_orderkey" not in plan(spark, sf, "bm25_index")
