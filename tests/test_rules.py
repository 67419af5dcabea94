"""Hand-written edge rows for the scalar rules, filters and joins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseload import dims, schema
from caseload.functions import times, values
from caseload.operators import chats as chat_ops
from caseload.operators import filters, joins, widgets
from caseload.operators import tickets as ticket_ops
from caseload.operators import trends
from caseload.sources import files

D = dt.datetime


def one(rows, data, kind, expr):
    df = rows([(i, v) for i, v in enumerate(data)], f"i int, x {kind}")
    return [r["y"] for r in df.withColumn("y", expr(F.col("x"))).orderBy("i").collect()]


def test_weekend_window(rows):
    moments = [D(2025, 10, 3, 17, 59, 59), D(2025, 10, 3, 18), D(2025, 10, 4, 12), D(2025, 10, 5, 23, 59),
               D(2025, 10, 6, 4, 59, 59), D(2025, 10, 6, 5), D(2025, 10, 8, 3), None]
    assert one(rows, moments, "timestamp_ntz", times.desk_weekend) == [
        False, True, True, True, True, False, False, False]
    assert one(rows, moments, "timestamp_ntz", times.calendar_weekend) == [
        False, False, True, True, False, False, False, False]


def test_business_hours(rows):
    moments = [D(2025, 10, 6, 8, 59), D(2025, 10, 6, 9), D(2025, 10, 6, 16, 59), D(2025, 10, 6, 17), D(2025, 10, 4, 12), None]
    assert one(rows, moments, "timestamp_ntz", times.business_hours) == [False, True, True, False, False, False]


def test_week_conventions(rows):
    moments = [D(2025, 9, 29, 8), D(2025, 9, 30, 8), D(2025, 10, 6)]
    assert one(rows, moments, "timestamp_ntz", lambda c: times.bucket(c, "week_tue")) == [
        dt.date(2025, 9, 23), dt.date(2025, 9, 30), dt.date(2025, 9, 30)]
    assert one(rows, moments, "timestamp_ntz", lambda c: times.bucket(c, "week_mon")) == [
        dt.date(2025, 9, 29), dt.date(2025, 9, 29), dt.date(2025, 10, 6)]
    with pytest.raises(ValueError):
        times.bucket(F.lit(1), "decade")


def test_central_wall_clock_at_clock_changes(rows):
    walls = [D(2025, 3, 9, 2, 30), D(2025, 11, 2, 1, 30), D(2025, 3, 9, 1, 59), D(2025, 3, 9, 3), D(2025, 7, 1, 12),
             D(2025, 11, 2, 0, 59), D(2025, 11, 2, 2), None]
    df = ticket_ops.central_to_eastern(rows([(i, w) for i, w in enumerate(walls)], "i int, x timestamp_ntz"), ["x"])
    got = [r["x"] for r in df.orderBy("i").collect()]
    # 08:00 UTC and 07:30 UTC for the gap and the repeated hour.
    assert got == [D(2025, 3, 9, 4), D(2025, 11, 2, 2, 30), D(2025, 3, 9, 3, 59), D(2025, 3, 9, 4), D(2025, 7, 1, 13),
                   D(2025, 11, 2, 1, 59), D(2025, 11, 2, 3), None]


def test_parse_utc_never_fails(rows):
    texts = ["2025-01-02 03:04:05", "2025-01-02T03:04:05Z", "2025-01-02T03:04:05+02:00", "01/02/2025 03:04", "soon", "", None]
    assert one(rows, texts, "string", times.parse_utc) == [
        D(2025, 1, 2, 3, 4, 5), D(2025, 1, 2, 3, 4, 5), D(2025, 1, 2, 1, 4, 5), D(2025, 1, 2, 3, 4), None, None, None]


def test_first_response(rows):
    base = D(2025, 5, 5, 10)
    data = [(1, "Support Pipeline", base, base + dt.timedelta(hours=2)), (2, "Support Pipeline", base, base),
            (3, "Support Pipeline", base, base - dt.timedelta(hours=1)), (4, "Support Pipeline", base, None),
            (5, "Live Chat", base, base + dt.timedelta(hours=2)), (6, "Live Chat ", None, None),
            (7, None, base, base + dt.timedelta(microseconds=1))]
    df = rows(data, "i int, pipeline string, create_ts_utc timestamp_ntz, first_response_ts_utc timestamp_ntz")
    get = lambda d: [r["first_response_hours"] for r in d.orderBy("i").collect()]
    assert get(ticket_ops.first_response(df)) == [2.0, None, None, None, 30 / 3600, 30 / 3600, 1 / 3.6e9]
    assert get(ticket_ops.first_response(df, strict_space=True)) == [2.0, None, None, None, 2.0, 30 / 3600, 1 / 3.6e9]


def test_ratings(rows):
    texts = [None, "", "not rated", "rated good", "rated bad", "BAD", "4", "9", "abc", "0.5", " 5 ", "good but bad"]
    assert one(rows, texts, "string", values.rating) == [
        None, None, None, 5.0, 1.0, 1.0, 4.0, None, None, None, 5.0, 1.0]
    assert one(rows, [5, 4, 3, 2, 1, None], "int", values.score_text) == [
        "rated good", "rated good", "not rated", "rated bad", "rated bad", "not rated"]


def test_bins(rows):
    hours = [0.0, 1.0, 4.0, 24.0, 24.1, 72.0, 80.0, -1.0, None]
    assert one(rows, hours, "double", values.response_bin) == [
        "< 1 hour", "< 1 hour", "1-4 hours", "4-24 hours", "1-3 days", "1-3 days", "3+ days", None, None]
    assert one(rows, [0, 6, 7, 12, 18, 23, None], "int", values.time_period) == [
        "Night (0-6)", "Night (0-6)", "Morning (6-12)", "Morning (6-12)", "Afternoon (12-18)", "Evening (18-24)", None]


def test_hms(rows):
    texts = ["01:30:45", "01:30", "2.5", "", "x:y", "1:2:3:4", None, " 3 "]
    got = one(rows, texts, "string", values.hms_hours)
    assert got[0] == pytest.approx(1.5125) and got[1:5] == [1.5, 2.5, None, None]
    assert got[5] == pytest.approx(1 + 2 / 60) and got[6:] == [None, 3.0]


def test_readable_duration(rows):
    assert one(rows, [0, None, 250, 999, 1500, 58250, 1050, 59999, 120000], "bigint", values.readable_ms) == [
        "N/A", "N/A", "250ms", "999ms", "1.5s", "58.2s", "1.1s", "60.0s", "2.0m"]


def test_team_names(rows):
    names = ["Nora N", " GILLIE ", "Erin", "Richie", "test chris", "Chris", "Somebody", None, "", "admin"]
    assert one(rows, names, "string", values.team_member) == [
        "Nova", "Girly", None, None, None, "Francis", None, None, None, None]


def test_truncate_and_rounding(rows):
    assert one(rows, ["abc", "abcd"], "string", lambda c: values.truncate_text(c, 3)) == ["abc", "abc...[TRUNCATED]"]
    assert one(rows, [35.4 / 24, -0.25, None], "double", lambda c: values.rounded(c, 2))[0] == 1.48


def test_off_shift(rows):
    data = [("Nova", D(2025, 10, 7, 10, 29)), ("Nova", D(2025, 10, 7, 10, 30)), ("Nova", D(2025, 10, 7, 19)),
            ("Francis", D(2025, 10, 7, 18, 30)), ("Francis", D(2025, 10, 7, 4, 59)), ("Francis", D(2025, 10, 7, 5)),
            ("Francis", D(2025, 10, 10, 2)), ("Nobody", D(2025, 10, 7, 4, 30)), (None, D(2025, 10, 7, 12)),
            ("Girly", D(2025, 10, 4, 12)), ("Girly", None), (" Girly ", D(2025, 10, 7, 9))]
    df = rows([(i, *d) for i, d in enumerate(data)], "i int, case_owner string, create_ts_local timestamp_ntz")
    got = [r["off_shift"] for r in ticket_ops.off_shift(df).orderBy("i").collect()]
    assert got == [True, False, True, False, False, True, True, False, False, True, False, False]


def test_off_shift_full_day_and_missing_day(rows):
    schedule = {"Ann": {"tuesday": "full"}}
    df = rows([(1, "Ann", D(2025, 10, 7, 3)), (2, "Ann", D(2025, 10, 8, 12))], "i int, case_owner string, create_ts_local timestamp_ntz")
    got = ticket_ops.off_shift(df, schedule, {"monday": []}).orderBy("i").collect()
    assert [r["off_shift"] for r in got] == [False, True]


def test_file_dates(rows):
    names = ["/x/ticket-export-03092025.csv", "/x/a_03-09-2025.csv", "/x/2025-09-03.csv", "/x/20250903.csv", "/x/none.csv",
             "/x/99999999.csv"]
    day = dt.date(2025, 9, 3)
    assert one(rows, names, "string", files.file_date) == [day, day, day, day, None, None]


def test_named_ranges():
    as_of = D(2025, 10, 20, 16)  # 12:00 Eastern summer time, a Monday
    assert filters.named_range("all", "tickets", as_of) == (None, None)
    assert filters.named_range("7d", "tickets", as_of)[0] == D(2025, 10, 9, 4)
    assert filters.named_range("8w", "tickets", as_of)[0] == D(2025, 8, 25, 4)
    assert filters.named_range("ytd", "tickets", as_of)[0] == D(2025, 1, 1, 5)
    assert filters.named_range("13w", "tickets", as_of)[0] == D(2025, 1, 1, 5)
    # The offset of "now" holds for the whole range, also across the clock change.
    assert filters.named_range("52w", "tickets", as_of)[0] == D(2024, 10, 21, 4)
    assert filters.named_range("26w", "tickets", D(2025, 12, 1, 12))[0] == D(2025, 6, 2, 5)
    assert filters.named_range("7d", "chats", D(2025, 10, 19, 15))[0] == D(2025, 10, 9, 3)
    with pytest.raises(ValueError):
        filters.named_range("3y", "tickets", as_of)


def test_calendar_bounds():
    assert filters.calendar_bounds("week", dt.date(2025, 9, 29)) == (D(2025, 9, 29, 4), D(2025, 10, 6, 3, 59, 59))
    assert filters.calendar_bounds("day", dt.date(2025, 1, 1)) == (D(2025, 1, 1, 5), D(2025, 1, 2, 4, 59, 59))
    with pytest.raises(ValueError):
        filters.calendar_bounds("week", dt.date(2025, 9, 30))
    with pytest.raises(ValueError):
        filters.calendar_bounds("custom", dt.date(2025, 9, 30), dt.date(2025, 9, 1))


def test_relative_bounds():
    day = dt.date(2025, 2, 17)
    assert filters.relative_bounds("last month", day) == (dt.date(2025, 1, 1), dt.date(2025, 1, 31))
    assert filters.relative_bounds("past 90 days", day)[0] == dt.date(2024, 11, 19)
    assert filters.relative_bounds("this quarter", day)[0] == dt.date(2025, 1, 1)
    with pytest.raises(ValueError):
        filters.relative_bounds("some day", day)


def test_exclusions_keep_missing_values(rows):
    df = rows([(1, "SPAM Tickets", None), (2, None, "x"), (3, "Success", "y")], "i int, pipeline string, case_owner string")
    assert [r["i"] for r in filters.drop_spam(df).orderBy("i").collect()] == [2, 3]
    assert [r["i"] for r in filters.in_list(df, "pipeline", ["Success"], negate=True).orderBy("i").collect()] == [1, 2]
    assert filters.in_list(df, "pipeline", None).count() == 3
    assert filters.support_team(df, ["y"]).count() == 1


def test_dedup_keeps_first_and_is_cut_before_the_shuffle(rows):
    df = rows([(7, 2, 30.0), (7, 1, 10.0), (7, 3, 20.0), (8, 1, 5.0)], "chat_id int, load_seq int, d double")
    out = joins.dedup(df, "chat_id", ["load_seq"])
    assert sorted((r["chat_id"], r["d"]) for r in out.collect()) == [(7, 10.0), (8, 5.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Children are printed below their parents: the partial limit runs before the exchange.
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
    assert plan.index("Exchange") < plan.index(limits[-1]) and "Partial" in limits[-1]


def test_review_merge(rows):
    main = rows([(1, "old", "keep"), (2, "old", "keep"), (None, "old", "keep")], "ticket_id int, `QA - A` string, s string")
    qa = rows([(1, 2, "second", None), (1, 1, "first", "b"), (None, 1, "x", "y"), (9, 1, "z", "z")],
              "ticket_id int, seq int, A string, B string")
    got = {r["ticket_id"]: (r["QA - A"], r["QA - B"], r["s"]) for r in joins.integrate_qa(main, qa, order=["seq"]).collect()}
    assert got == {1: ("first", "b", "keep"), 2: ("old", "", "keep"), None: ("old", "", "keep")}


def test_lookup_with_repeated_key_keeps_rows(rows):
    tickets = rows([(1, "a"), (2, "b"), (3, None)], "i int, ticket_owner string")
    owners = rows([("a", "Ann"), ("a", "Anna")], "id string, name string")
    got = [r["ticket_owner"] for r in joins.lookup_owner(tickets, owners).orderBy("i").collect()]
    assert got == ["Anna", "b", None]


def test_human_agents_list(rows):
    df = rows([(1, "Chris,Gillie"), (2, " nora n "), (3, "Somebody"), (4, ""), (5, None)], "i int, human_agents string")
    got = sorted((r["i"], r["human_agent"]) for r in joins.explode_agents(df).collect())
    assert got == [(1, "Francis"), (1, "Girly"), (2, "Nova")]


def test_trend_of_single_row_and_gaps(rows):
    single = trends.with_trend(rows([(1, 5)], "d int, n int"), "d", {"n": "t"}).collect()
    assert single[0]["t"] is None
    gap = trends.with_trend(rows([(1, 1.0), (2, None), (3, 3.0)], "d int, n double"), "d", {"n": "t"})
    assert [r["t"] for r in gap.orderBy("d").collect()] == pytest.approx([1.0, 2.0, 3.0])


def test_ties_are_broken_by_name(rows):
    from caseload.operators import chat_reports

    df = rows([("2024-01-01", 9), ("2024-01-02", 9), ("2024-01-02", 8), ("2024-01-01", 8)], "d string, hour int").withColumn(
        "date", F.to_date("d"))
    assert {r["peak_day"] for r in chat_reports.chat_volume(df).collect()} == {dt.date(2024, 1, 1)}
    assert {r["peak_hour"] for r in chat_reports.chat_hourly(df).collect()} == {8}


def test_chat_trend_with_too_little_data(rows):
    from caseload.operators import chat_reports

    empty = rows([], "date date")
    assert chat_reports.chat_trend(empty).first().asDict() == {
        "trend": "insufficient_data", "trend_slope": 0.0, "trend_direction": "stable", "growth_rate": 0.0}
    day = rows([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 1),)], "date date")
    assert chat_reports.chat_trend(day).first()["trend_direction"] == "stable"


def test_last_twelve_weeks(rows):
    from caseload.operators import chat_reports

    start = D(2024, 1, 2)
    data = [(i, start + dt.timedelta(weeks=i), "bot", 5.0, True, False) for i in range(20)]
    df = rows(data, "chat_id int, created_ts_local timestamp_ntz, agent_type string, rating_value double, "
                    "has_rating boolean, bot_transfer boolean")
    weeks = sorted(r["week"] for r in chat_reports.weekly_chat_volume(df).collect())
    assert len(weeks) == 12 and weeks[-1] == dt.date(2024, 5, 14)
    assert len(chat_reports.weekly_satisfaction(df).collect()) == 12


def test_reports_check_their_arguments(rows):
    with pytest.raises(ValueError):
        widgets.bot_volume_duration(None, D(2024, 1, 1), range_="7d")
    with pytest.raises(KeyError):
        widgets.run_report("nothing", as_of=D(2024, 1, 1))
    assert len(widgets.REPORTS) == 17


def test_column_resolution(rows):
    df = rows([("1", "3")], "`Ticket ID` string, `Case Owner` string")
    got = schema.resolve_columns(df, schema.TICKET_COLUMNS).first()
    assert (got["ticket_id"], got["ticket_owner"], got["subject"]) == ("1", "3", None)
    minutes = schema.resolve_columns(rows([(2.5,)], "duration_minutes double"), schema.CHAT_COLUMNS).first()
    assert float(minutes["duration_raw"]) == 150.0
    assert schema.to_store_names(rows([("a", "b")], "`Ticket ID` string, `Some Field (x)` string")).columns == [
        "ticket_id", "some_field_x"]


def test_bot_repair_by_word(rows):
    df = rows([(1, "Craig"), (2, "Nora"), (3, "ChatBot"), (4, None)], "i int, display_agent string")
    got = [r["agent_type"] for r in schema.ensure_chat_columns(df).orderBy("i").collect()]
    assert got == ["bot", "human", "bot", "human"]


def test_extra_bots(rows):
    more = dims.AGENTS.with_bots({"Site Bot": "Agent Scrape"})
    df = rows([("Site Bot", None)], "primary_agent_raw string, secondary_agent_raw string")
    r = chat_ops.display_agent(chat_ops.classify_agent(df, more), more).first()
    assert (r["agent_type"], r["display_agent"]) == ("bot", "Agent Scrape")


def test_no_team_name_contains_an_excluded_word():
    assert not [n for n in dims.TEAM_NAMES for w in dims.NON_TEAM_WORDS if w in n]
    assert dims.SPAM_DISPLAY not in dims.PIPELINE_DISPLAY.values()


def test_not_a_number_is_missing(rows):
    assert one(rows, ["nan", "NaN", "3", "x", None], "string", values.number_or_zero) == [0.0, 0.0, 3.0, 0.0, 0.0]
    assert one(rows, ["nan", "nan:30", "1:nan"], "string", values.hms_hours) == [None, None, None]
    df = rows([(float("nan"),), (2.0,), (0.0,)], "first_response_hours double")
    assert [r[0] for r in filters.valid_hours(df).collect()] == [2.0]


def test_bare_clocks_and_years_are_no_times(spark):
    from pyspark.sql import functions as F

    from caseload.functions import times

    rows = spark.createDataFrame([("10:15",), ("2024",), ("T10:15:00",), ("2024-05-01 10:15:00",), (None,)], "t string")
    got = rows.select(times.parse_utc(F.col("t")).alias("u"), times.parse_iso(F.col("t")).alias("i")).collect()
    assert [r["u"] is None for r in got] == [True, True, True, False, True]
    assert [r["i"] is None for r in got] == [True, True, True, False, True]


def test_all_response_columns_are_analysed(spark):
    from caseload.operators import ticket_reports

    df = spark.createDataFrame([("01:00:00",) * 5], ", ".join(f"response_time_{i} string" for i in range(5)))
    assert ticket_reports.hms_response_analysis(df).count() == 5


def test_off_shift_with_a_schedule_table(rows, spark):
    """The same flags from a table; an agent without an entry for the day is off, others use the fallback."""
    import datetime as dt

    from caseload.operators import tickets as ticket_ops

    schedule = {"Nova": {"monday": [("22:00", "06:00")], "tuesday": "full"}, "Odd": {"friday": [("09:00", "10:00")]}}
    start = dt.datetime(2025, 3, 3)
    df = rows([(d * 100 + h, who, start + dt.timedelta(days=d, hours=h)) for d in range(5) for h in range(0, 24, 3) for who in ("Nova ", "Odd", "Else", None)],
              "i int, case_owner string, create_ts_local timestamp_ntz")
    table = ticket_ops.schedule_frame(spark, schedule, {}).where("agent is not null").repartition(3)
    get = lambda s: sorted((r["i"], str(r["case_owner"]), r["off_shift"]) for r in ticket_ops.off_shift(df, s).collect())
    got = get(table)
    assert got == get(schedule)
    flags = {(i, who): f for i, who, f in got}
    assert not flags[100, "Nova "] and not flags[121, "Nova "] and flags[200, "Nova "] and flags[21, "Nova "]
    assert flags[409, "Odd"] is False and flags[9, "Odd"] is True and flags[9, "Else"] is False and flags[9, "None"] is False
