"""What reaches the scan, and how joins and skewed groups are planned."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseload.operators import filters, sync, widgets
from caseload.operators.distribution import summarize
from caseload.plans import fixtures as fx
from caseload.session import scratch_path
from caseload.sources import tables

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch_path(spark, "stored")
    tables.store_by_month(fx.desk(spark, SF_DIR), path, "create_ts_utc")
    return spark.read.parquet(path)


def scan_lines(plan):
    return [line for line in plan.splitlines() if "FileScan parquet" in line]


def test_range_prunes_month_folders_and_columns(stored):
    df = widgets.performance_vs_volume(stored, fx.TICKETS_AS_OF, range_="ytd")
    (scan,) = scan_lines(plan_of(df))
    assert "PartitionFilters: [isnotnull(create_month" in scan
    # Only the columns the count needs: time for the range, pipeline for spam, owner for the team.
    schema = scan.split("ReadSchema: ")[1]
    assert set(c.split(":")[0] for c in schema[len("struct<"):].rstrip(">").split(",")) == {
        "create_ts_utc", "pipeline", "case_owner"}


def test_stored_report_equals_report_on_the_fly(spark, stored):
    fresh = widgets.weekly_response_breakdown(fx.desk(spark, SF_DIR), fx.TICKETS_AS_OF, range_="ytd")
    kept = widgets.weekly_response_breakdown(stored, fx.TICKETS_AS_OF, range_="ytd")
    assert sorted(map(tuple, fresh.collect())) == sorted(map(tuple, kept.collect()))


def test_incremental_filter_reaches_the_scan(stored):
    df = sync.incremental(stored, dt.datetime(2001, 6, 1), fx.TICKETS_AS_OF).select("ticket_id")
    (scan,) = scan_lines(plan_of(df))
    assert "GreaterThanOrEqual(last_modified_ts_utc" in scan


def test_list_filter_reaches_the_scan(stored):
    df = filters.in_list(stored, "case_owner", ["Nova"]).select("ticket_id")
    assert any("PushedFilters" in s and "case_owner" in s for s in scan_lines(plan_of(df)))


def test_upsert_does_not_shuffle_the_base_for_a_small_delta(spark, stored):
    """With a delta below the broadcast threshold neither join moves the stored rows."""
    base = stored.select("ticket_id", "subject", "priority")
    delta = spark.createDataFrame([(1, "s", "p")], "ticket_id bigint, subject string, priority string")
    out = sync.upsert_merge(base, delta, "ticket_id")
    out.collect()
    final = plan_of(out).split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final and "BroadcastHashJoin" in final


def test_upsert_of_odd_keys_brings_no_table_to_one_task(spark):
    from caseload.plans import catalog

    catalog.load()
    assert "Window" not in plan_of(catalog.QUERIES["u1_upsert_odd_keys"](spark, SF_DIR))


def test_counts_combine_before_the_shuffle(stored):
    plan = plan_of(stored.groupBy("case_owner").agg(F.count("*")))
    assert "partial_count" in plan


def test_quantiles_read_the_table_once(spark, stored):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(summarize(stored.select("case_owner", "first_response_hours"), ["case_owner"], "first_response_hours"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(scan_lines(plan)) == 1 and "ReusedExchange" in plan


def test_month_bounds_do_not_cut_rows(stored):
    start, end = dt.datetime(1998, 1, 31, 23, 59), dt.datetime(1998, 4, 1)
    by_month = filters.between(stored, "create_ts_utc", start, end).count()
    plain = filters.between(stored.drop("create_month"), "create_ts_utc", start, end).count()
    assert by_month == plain > 0


ONE_SCAN = ["a5_ticket_cards", "c5_human_metrics", "c13_agent_chat_stats", "c17_agent_performance_table", "g1_agent_stats", "g5_pipeline_distribution", "m2_response_metrics",
            "m6_chat_metrics"]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_report_reads_the_table_once(spark, name):
    from caseload.plans import catalog

    catalog.load()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(catalog.QUERIES[name](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(scan_lines(plan)) == 1
