"""The stored rollup against the tickets it was made from."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseload.operators import rollup, ticket_reports, widgets
from caseload.plans import fixtures as fx
from caseload.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())


@pytest.fixture(scope="module")
def desk(spark):
    path = scratch_path(spark, "desk")
    fx.desk(spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


def table(spark, tickets):
    t = rollup.RollupTable(spark, scratch_path(spark, "rollup"))
    t.build(tickets)
    return t


REPORTS = [
    ("weekly_response_breakdown", {"range_": "12w"}), ("weekly_response_breakdown", {"range_": "13w", "stat": "mean"}),
    ("agent_response_time_comparison", {"range_": "ytd"}), ("volume_daily_historic", {"range_": "7d"}),
    ("agent_weekly_ticket_volume_by_agent", {"range_": "8w"})]


@pytest.mark.parametrize("as_of", [dt.datetime(2001, 8, 2), dt.datetime(2001, 3, 20, 13, 27, 5), dt.datetime(1999, 11, 2, 4, 59, 59)])
def test_any_minute_gives_the_rows_of_the_tickets(spark, desk, as_of):
    """Tickets lie around the last minute of the range, and one exactly on it."""
    near = desk.limit(1).withColumns({
        "create_ts_utc": F.explode(F.array(*[F.lit(as_of + dt.timedelta(minutes=m)).cast("timestamp_ntz") for m in (-70, -10, 0, 1, 50)])),
        "case_owner": F.lit("Nova")}).withColumn("create_ts_local", F.col("create_ts_utc") - F.expr("interval 4 hours"))
    tickets = desk.unionByName(near)
    cells = table(spark, tickets).read_until(tickets, as_of)
    for name, params in REPORTS:
        want = widgets.run_report(name, tickets, as_of=as_of, **params)
        assert rows(widgets.run_report(name, cells, as_of=as_of, **params)) == rows(want), name


def test_syncs_add_up(spark, desk):
    """New, late, changed, moved and deleted tickets; a month that loses all its tickets; tickets without a time."""
    first = desk.where("ticket_id % 7 <> 0")
    t = table(spark, first)
    month = F.trunc(F.to_date("create_ts_utc"), "month")
    gone = first.where(month == F.lit(dt.date(1998, 5, 1)))
    moved = first.where("ticket_id % 11 = 1").where(month != F.lit(dt.date(1998, 5, 1)))
    after = moved.withColumns({"case_owner": F.lit("Girly"), "first_response_hours": F.col("first_response_hours") + 1})
    late = desk.where("ticket_id % 7 = 0")
    timeless = late.limit(3).withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("create_ts_utc", "create_ts_local")})
    timeless = spark.createDataFrame(timeless.collect(), timeless.schema)
    delta = rollup.change(moved.unionByName(gone), after.unionByName(late).unionByName(timeless))
    now = desk.join(moved.unionByName(gone).select("ticket_id"), "ticket_id", "left_anti").unionByName(after).unionByName(timeless)
    t.add(delta, 5)
    want = rows(rollup.cells(now).select(*rollup.KEYS, rollup.WEIGHT))
    get = lambda: rows(t.read().select(*rollup.KEYS, rollup.WEIGHT))
    assert get() == want
    t.add(delta, 5)  # the same sync again, and an older one
    t.add(delta, 4)
    assert get() == want
    assert rows(ticket_reports.weekly_response(t.read())) == rows(ticket_reports.weekly_response(now))
    t.add(rollup.change(after, moved), 6)  # and back
    back = desk.join(gone.select("ticket_id"), "ticket_id", "left_anti").unionByName(timeless)
    assert get() == rows(rollup.cells(back).select(*rollup.KEYS, rollup.WEIGHT))
    t.add(delta.where("false"), 7)


def test_a_sync_that_stopped_half_way_is_finished(spark, desk):
    first, late = desk.where("ticket_id % 3 <> 0"), desk.where("ticket_id % 3 = 0")
    t = table(spark, first)
    delta = rollup.change(first.where("false"), late)
    t.add(delta.where("create_ts_utc < '1998-01-01'"), 1)  # some months were replaced before the driver was lost
    t.add(delta, 1)
    assert rows(t.read().select(*rollup.KEYS, rollup.WEIGHT)) == rows(rollup.cells(desk).select(*rollup.KEYS, rollup.WEIGHT))


def test_a_sync_leaves_other_months_alone(spark, desk):
    t = table(spark, desk)
    files = lambda: {f for f in t.read().inputFiles()}
    before = files()
    some = desk.where("create_ts_utc >= '1996-03-01' and create_ts_utc < '1996-04-01'").limit(2)
    t.add(rollup.change(some, some.withColumn("case_owner", F.lit("Nova"))), 1)
    changed = {f.split("create_month=")[1][:7] for f in before ^ files()}
    assert changed == {"1996-03"}
