"""Upserts, snapshots, retention and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseload.operators import logs, sync
from caseload.session import scratch_path
from caseload.sources import files
from caseload.sources.months import FOLDER, MonthTable
from caseload.streaming import feeds

D = dt.datetime
SHAPE = "id int, a string, rate_raw string"


def rowset(df):
    return sorted(tuple(r) for r in df.select("id", "a", "rate_raw").collect())


@pytest.fixture
def base(rows):
    return rows([(1, "x", "good"), (2, "y", "bad")], SHAPE)


def test_merge_keeps_missing_fields_but_always_writes_rate(rows, base):
    delta = rows([(1, None, None), (3, "z", "ok")], SHAPE)
    assert rowset(sync.upsert_merge(base, delta, "id")) == [(1, "x", ""), (2, "y", "bad"), (3, "z", "ok")]


def test_merge_is_idempotent(rows, base):
    delta = rows([(1, "n", "g"), (3, "z", "ok")], SHAPE)
    once = sync.upsert_merge(base, delta, "id")
    assert rowset(sync.upsert_merge(once, delta, "id")) == rowset(once)


def test_merge_takes_latest_present_value(rows, base):
    delta = rows([(1, "new", "r1", 1), (1, None, "r2", 2)], SHAPE + ", seq int")
    assert rowset(sync.upsert_merge(base, delta, "id", "seq"))[0] == (1, "new", "r2")


def test_replace_overwrites_whole_rows(rows, base):
    delta = rows([(1, None, "r", 1), (1, "late", None, 2), (4, "w", "q", 1)], SHAPE + ", seq int")
    assert rowset(sync.upsert_replace(base, delta, "id", "seq")) == [(1, "late", None), (2, "y", "bad"), (4, "w", "q")]


def test_retention_keeps_rows_without_time(rows):
    df = rows([(1, D(2025, 1, 1)), (2, D(2024, 1, 1)), (3, None)], "id int, ts timestamp_ntz")
    assert sorted(r["id"] for r in sync.retain(df, "ts", 30, D(2025, 1, 15)).collect()) == [1, 3]


def test_state(rows, spark):
    as_of = D(2025, 1, 1)
    state = sync.state_row(spark, "tickets", D(2024, 12, 1), 5, "success", as_of)
    assert sync.load_state(state, "tickets", as_of) == D(2024, 12, 1)
    assert sync.load_state(state, "chats", as_of) == as_of - dt.timedelta(days=365)


MSHAPE = "id int, a string, month string"
content = lambda df: sorted(tuple(r) for r in df.select("id", "a", "month").collect())


@pytest.fixture
def table(spark):
    return MonthTable(spark, scratch_path(spark, "t"))


def months(t):
    """The data files of every month."""
    out = {}
    for f in t._open().inputFiles():
        out.setdefault(f.split(f"{FOLDER}=")[1].split("/")[0], set()).add(f)
    return out


def test_months_start_empty_and_are_replaced_as_a_whole(rows, table):
    assert table.read() is None and not table.has_batch(("feed", 0))
    table.write(rows([(1, "x", "a"), (2, "y", "b")], MSHAPE))
    table.write(rows([(3, "z", "b"), (4, "w", "c")], MSHAPE))
    assert content(table.read()) == [(3, "z", "b"), (4, "w", "c")]
    table.write(rows([], MSHAPE))
    assert table.read() is None or table.read().count() == 0


@pytest.mark.parametrize("fixed", [False, True])
def test_replayed_batch_has_no_second_effect(rows, spark, fixed):
    table = MonthTable(spark, scratch_path(spark, "t"), fixed=fixed)
    table.write(rows([(1, "x", "a"), (2, "y", "b")], MSHAPE))
    table.merge(rows([(1, "first", "a")], MSHAPE), "id", batch=("feed", 0))
    table.merge(rows([(1, "again", "a")], MSHAPE), "id", batch=("feed", 0))
    table.merge(rows([(2, "other", "b")], MSHAPE), "id", batch=("another", 0))
    assert content(table.read()) == [(1, "first", "a"), (2, "other", "b")]
    table.merge(rows([], MSHAPE), "id", batch=("feed", 1))
    assert table.has_batch(("feed", 1)) and not table.has_batch(("feed", 2))


def test_merge_rewrites_only_touched_months(rows, table):
    start = rows([(i, "old", f"m{i % 4}") for i in range(12)], MSHAPE)
    table.write(start)
    before = months(table)
    # One changed key, one new key, one key that moves to another month.
    delta = rows([(0, "new", None), (100, "new", "m1"), (5, "moved", "m9")], MSHAPE)
    table.merge(delta, "id")
    after = months(table)
    same = {bytes.fromhex(m[1:]).decode() for m in before if before[m] == after.get(m)}
    assert same == {"m2", "m3"}
    expected = content(sync.upsert_merge(start, delta, "id"))
    assert content(table.read()) == expected
    table.merge(delta, "id")  # the same change again
    assert content(table.read()) == expected


def test_a_change_that_stopped_half_way_is_finished(rows, table, monkeypatch):
    start, delta = rows([(1, "x", "a"), (2, "y", "b")], MSHAPE), rows([(1, None, "b"), (3, "z", "c")], MSHAPE)
    table.write(start)

    def lost(*args):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(table, "_apply", lost)
    with pytest.raises(RuntimeError):
        table.merge(delta, "id", batch=("feed", 0))
    monkeypatch.undo()
    monkeypatch.setattr(table, "_delete", lost)  # the next one stops after the months were replaced
    with pytest.raises(RuntimeError):
        table.read()
    monkeypatch.undo()
    assert content(table.read()) == content(sync.upsert_merge(start, delta, "id")) == [(1, "x", "b"), (2, "y", "b"), (3, "z", "c")]
    assert table.has_batch(("feed", 0))
    start.write.parquet(f"{table.path}/redo/rows")  # without its mark, a change was never made
    assert content(table.read()) == [(1, "x", "b"), (2, "y", "b"), (3, "z", "c")]
    table.merge(rows([(9, "w", "c")], MSHAPE), "id")
    assert len(content(table.read())) == 4


def test_fixed_months_read_only_the_months_of_a_change(rows, spark):
    table = MonthTable(spark, scratch_path(spark, "t"), fixed=True)
    table.write(rows([(i, "old", f"m{i % 4}") for i in range(12)], MSHAPE))
    before = months(table)
    table.replace(rows([(0, "new", "m0"), (100, "new", "m0")], MSHAPE), "id")
    after = months(table)
    assert {m for m in before if before[m] != after[m]} == {"m" + b"m0".hex().upper()}
    assert len(content(table.read())) == 13


def test_retention_drops_whole_months(rows, table):
    table.write(rows([(1, D(2024, 1, 5), "a"), (2, D(2025, 1, 5), "b"), (3, D(2025, 1, 20), "b"), (4, None, "c")],
                     "id int, ts timestamp_ntz, month string"))
    before = months(table)
    table.retain("ts", 20, D(2025, 1, 31))
    after = months(table)
    assert sorted(r["id"] for r in table.read().collect()) == [3, 4]
    rewritten = {m for m in after if after[m] != before[m]}
    assert len(after) == 2 and rewritten == {"m" + b"b".hex().upper()}
    table.retain("ts", 20, D(2024, 1, 31))  # nothing is old
    assert months(table) == after


def test_replace_into_stored_table(rows, table):
    shape = MSHAPE + ", seq int"
    delta = rows([(1, "late", None, 2), (1, "early", "r", 1), (4, "w", "q", 1)], shape)
    table.write(rows([(1, "x", "a"), (2, "y", "b")], MSHAPE))
    table.replace(delta.where("id = 4"), "id", "seq")
    table.replace(delta, "id", "seq")
    got = {r["id"]: (r["a"], r["month"]) for r in table.read().collect()}
    assert got == {1: ("late", None), 2: ("y", "b"), 4: ("w", "q")}


def test_stream_result_is_batch_result(rows, spark, base):
    delta = rows([(1, "n", "g"), (3, "z", "ok"), (2, None, "p")], SHAPE)
    path = scratch_path(spark, "in")
    for i in (1, 2, 3):
        delta.where(F.col("id") == i).coalesce(1).write.mode("append").parquet(path)
    table = MonthTable(spark, scratch_path(spark, "t"), month="a")
    table.write(base)
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(path)
    feeds.stream_upsert(stream, table, "id", scratch_path(spark, "c"))
    assert rowset(table.read()) == rowset(sync.upsert_merge(base, delta, "id"))


def test_files_are_read_once(rows, spark):
    inbox, target, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    run = lambda: feeds.run_available(feeds.stream_files(spark, inbox, ["id", "a"]), target, check)
    files.write_csv(rows([(1, "x"), (2, "None")], "id int, a string"), inbox)
    run()
    files.write_csv(rows([(3, 'say "hi", twice\nplease')], "id int, a string"), inbox, mode="append")
    run()
    run()
    got = sorted((int(r["id"]), r["a"]) for r in spark.read.parquet(target).collect())
    assert got == [(1, "x"), (2, None), (3, 'say "hi", twice\nplease')]


def test_run_records(spark):
    entry = "array<struct<timestamp:string,level:string,stage:string,message:string>>"
    data = [("r1", 1500, [("t", "ERROR" if i == 0 else "INFO", "S", f"m{i}") for i in range(12)]), ("r2", 0, None), ("r3", 5, [])]
    runs = spark.createDataFrame(data, f"run_id string, total_duration_ms bigint, log_entries {entry}")
    got = {r["run_id"]: r for r in logs.run_details(runs).collect()}
    assert got["r1"]["details"].startswith("[S] m2 | ") and got["r1"]["details"].endswith("[S] m11")
    assert (got["r1"]["error_count"], got["r1"]["duration_readable"]) == (1, "1.5s")
    assert got["r2"]["details"] == "" and got["r3"]["details"] == ""


def test_discovery_and_latest(rows, spark):
    base = scratch_path(spark, "data")
    one = rows([(1,)], "id int")
    files.write_csv(one, f"{base}/tickets/first.csv")
    found = files.discover(spark, base).collect()
    assert all(r["path"].endswith(".csv") for r in found)
    files.write_csv(rows([(2,)], "id int"), f"{base}/tickets/second.csv")
    assert [r["id"] for r in files.latest_table(spark, f"{base}/tickets").collect()] == ["2"]
    with pytest.raises(ValueError):
        files.read_tickets_csv(spark, [f"{base}/missing.csv"])


def test_repeated_keys_without_order_give_one_row_per_key(spark):
    from caseload.operators import sync

    base = spark.createDataFrame([(1, "old")], "id long, v string")
    delta = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (2, None)], "id long, v string")
    for fn in (sync.upsert_merge, sync.upsert_replace):
        for parts in (1, 4):
            assert sorted(map(tuple, fn(base, delta.repartition(parts), "id").collect())) == [(1, "b"), (2, "d")]


def test_equal_order_values_have_a_fixed_winner(spark):
    from caseload.operators import sync

    base = spark.createDataFrame([(1, "old")], "id long, v string")
    delta = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "z", 4)], "id long, v string, seq long")
    for fn in (sync.upsert_merge, sync.upsert_replace):
        assert sorted(map(tuple, fn(base, delta.repartition(3), "id", seq="seq").select("id", "v").collect())) == [(1, "b")]


def test_late_originals_are_kept_and_copies_dropped(spark, rows):
    shape = "chat_id int, created_ts_utc timestamp_ntz, v string"
    source, target, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    files_ = [[(1, D(2024, 1, 10), "a")], [(2, D(2024, 1, 5), "a"), (3, D(2024, 1, 11), "a"), (3, D(2024, 1, 11), "b")],
              [(1, D(2024, 1, 1), "late copy"), (4, D(2023, 1, 1), "a"), (None, None, "x")], [(None, None, "y"), (2, D(2024, 1, 5), "a")]]

    def drain():
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        feeds.stream_dedup(stream, target, check)

    for part in files_:
        rows(part, shape).coalesce(1).write.mode("append").parquet(source)
        drain()
    got = {r["chat_id"]: r["v"] for r in feeds.read_deduped(spark, target).collect()}
    assert got == {1: "a", 2: "a", 3: "a", 4: "a", None: "x"}
    assert feeds.read_deduped(spark, target).count() == 5


def test_month_values_of_any_text_survive_merges(rows, spark):
    table = MonthTable(spark, scratch_path(spark, "t"), month="label")
    shape = "id int, a string, label string"
    start = [(1, "x", "a/b"), (2, "y", None), (3, "z", None), (4, "w", "007"), (5, "v", "")]
    table.write(rows(start, shape))
    get = lambda: sorted(map(tuple, table.read().select("id", "a", "label").collect()))
    assert get() == start
    table.merge(rows([(6, "new", None), (1, "x2", None)], shape), "id")
    assert get() == [(1, "x2", "a/b"), *start[1:], (6, "new", None)]


def test_missing_keys_and_maps(spark):
    shape = "id int, v string, m map<string,int>"
    base = spark.createDataFrame([(None, "x", {"a": 1}), (1, "y", None)], shape)
    delta = spark.createDataFrame([(None, "x2", None), (2, "z", {"b": 2}), (2, "z", {"c": 3}), (2, None, None)], shape)
    get = lambda df: sorted(((r["id"], r["v"], str(r["m"])) for r in df.collect()), key=str)
    once = sync.upsert_merge(base, delta, "id")
    want = [(1, "y", "None"), (2, "z", "{'c': 3}"), (None, "x2", "{'a': 1}")]
    assert get(once) == want and get(sync.upsert_merge(once, delta, "id")) == want
    replaced = sync.upsert_replace(base, delta.where("v is not null"), "id")
    assert get(replaced) == [(1, "y", "None"), (2, "z", "{'c': 3}"), (None, "x2", "None")]
    assert get(sync.upsert_replace(replaced, delta.where("v is not null"), "id")) == get(replaced)


def test_dedup_state_survives_a_restart_and_reads_no_earlier_rows(spark, rows):
    import shutil

    shape = "chat_id int, v string"
    source, target, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    rows([(1, "a"), (2, "a")], shape).coalesce(1).write.parquet(source)
    run = lambda: feeds.stream_dedup(spark.readStream.schema(shape).parquet(source), target, check)
    run()
    shutil.rmtree(f"{target}/batch=0")  # later micro-batches don't need the earlier ones
    rows([(2, "copy"), (3, "a"), (1, "copy")], shape).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(map(tuple, feeds.read_deduped(spark, target).collect())) == [(3, "a")]
