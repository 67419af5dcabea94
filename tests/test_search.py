"""Trigram postings against the scan, and reconciliation of contents."""

import random

from caseload.operators import filters, joins
from caseload.operators.search import SearchIndex
from caseload.session import scratch_path

SHAPE = "ticket_id int, subject string, note string, n int, month string"
PARTS = ["ab", "A", "bca", "ß", "漢字", "\U0001F600", "x y", "", " ", "İ", "aaaa", "\n"]


def table(spark, rng, n, month=None):
    word = lambda: None if rng.random() < 0.1 else "".join(rng.choice(PARTS) for _ in range(rng.randrange(4)))
    rows = [(i if i % 9 else None, word(), word(), i, month or f"m{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, SHAPE)


def test_index_gives_what_the_scan_gives(spark):
    rng = random.Random(4)
    df = table(spark, rng, 150)
    index = SearchIndex(spark, scratch_path(spark, "i"), month="month")
    index.build(df)
    for q in ["a", "B", "ab", "bca", "aaa", "aaaaa", "字", "漢字", "\U0001F600", "x y", " ", "ya", "AbA", "ca\n", "m1", "zzz", "ß漢", ""]:
        key = lambda d: sorted(map(str, d.collect()))
        assert key(index.search(df, q, 1000)) == key(filters.search(df, q, 1000)), q
        ids = lambda d: [r["ticket_id"] for r in d.collect()]
        assert ids(index.search(df, q, 3)) == ids(filters.search(df, q, 3))


def test_a_month_is_built_again_by_itself(spark):
    rng = random.Random(9)
    old = table(spark, rng, 60)
    index = SearchIndex(spark, scratch_path(spark, "i"), month="month")
    index.build(old)
    files = lambda: {f for f in spark.read.parquet(index.path).inputFiles() if "6D31" not in f}
    before = files()
    new = old.where("month <> 'm1'").unionByName(spark.createDataFrame([(999, "fresh text", None, 0, "m1")], SHAPE))
    index.build(new.where("month = 'm1'"))
    assert files() == before
    for q in ("fresh", "ab", "a"):
        assert sorted(map(str, index.search(new, q, 500).collect())) == sorted(map(str, filters.search(new, q, 500).collect()))
    plan = index.candidates("fresh")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_rows_are_dealt_out_before_their_postings(spark, monkeypatch):
    """Every task of a build makes the postings of a bounded number of letters; no key or month is one task's."""
    from caseload.operators import search

    monkeypatch.setattr(search, "LETTERS", 1000)
    df = spark.range(400).selectExpr(
        "cast(if(id % 4 > 0, null, 1) as int) AS ticket_id", "concat('text ', id) AS subject", "'same' AS note", "'m' AS month")
    index = SearchIndex(spark, scratch_path(spark, "i"), month="month")
    index.build(df)
    files = spark.read.parquet(index.path).inputFiles()
    counts = [spark.read.parquet(f).count() for f in files]
    assert len(files) >= 4 and sum(counts) == search.postings(df, "ticket_id").count() and max(counts) < 3 * sum(counts) / len(files)


def test_texts_longer_than_a_row_of_marks(spark):
    long = "".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(200))
    df = spark.createDataFrame([(1, long), (1, long[:150]), (2, long[250:]), (None, long[:390])], "ticket_id int, subject string")
    index = SearchIndex(spark, scratch_path(spark, "i"))
    index.build(df)
    for q in (long, long[:150], long[100:300], long[1:64], long[260:]):
        assert sorted(map(str, index.search(df, q, 9).collect())) == sorted(map(str, filters.search(df, q, 9).collect()))


def test_contents_are_reconciled(spark):
    shape = "id int, a string, m map<string,int>, x int"
    left = [(1, "s", {"k": 1}, 1), (2, "s", None, None), (3, None, None, 3), (4, "t", None, 4), (None, "n", None, 0),
            (6, "twice", None, 1), (6, "twice", None, 1), (7, "two", None, 1), (7, "other", None, 1), (8, "a", None, None)]
    right = [(1, "s", {"k": 2}, 1), (2, None, None, 5), (4, "t", None, 4), (5, "new", None, 1), (None, "N", None, 0),
             (6, "twice", None, 1), (6, "twice", None, 1), (7, "two", None, 1), (7, "two", None, 1), (8, None, None, None)]
    a, b = spark.createDataFrame(left, shape), spark.createDataFrame(right, shape)
    for buckets in (1, 4, 1024):
        got = {r["id"]: (r["kind"], r["fields"]) for r in joins.reconcile_contents(a, b, "id", buckets).collect()}
        assert got == {1: ("changed", ["m"]), 2: ("changed", ["a", "x"]), 3: ("left only", None), 5: ("right only", None),
                       None: ("changed", ["a"]), 7: ("repeated", None), 8: ("changed", ["a"])}
    assert joins.reconcile_contents(a, a.repartition(3), "id").collect() == []
    # Other types and further columns: shared columns are compared as text.
    wide = a.where("id in (1, 4)").selectExpr("cast(id as string) id", "a", "x", "1 AS extra")
    got = joins.reconcile_contents(a.where("id in (1, 4)"), wide.where("id = 1"), "id").collect()
    assert [(r["id"], r["kind"]) for r in got] == [("4", "left only")]


def test_equal_tables_shuffle_only_checksums(spark):
    df = spark.range(5000).selectExpr("id", "concat('v', id) AS v")
    out = joins.reconcile_contents(df, df, "id")
    assert out.collect() == []
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final and "FullOuter" not in final
