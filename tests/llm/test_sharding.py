import zlib
from collections import Counter

from pyspark.sql import functions as F

from caseload.llm import sharding


def check(df, shards=40):
    got = sharding.report(df, shards).collect()
    rows = df.collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} <= {"rows"} and {r["grown_shard"] for r in got} <= {None}
    counts = Counter(r["shard"] for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts.get(s, 0)))
    return got


def test_every_row_has_one_place(docs, edge, nothing):
    check(docs)
    check(edge)
    check(edge, 3)
    assert sharding.report(nothing).count() == 0


def test_same_result_in_other_partitions(docs):
    assert sorted(map(str, sharding.report(docs).collect())) == sorted(map(str, sharding.report(docs.repartition(7)).collect()))


def test_shards_have_the_mixture_of_the_whole(spark):
    df = spark.range(10_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    share = {r["source"]: r["n"] / 10_000 for r in df.groupBy("source").agg(F.count("*").alias("n")).collect()}
    out = sharding.sharded_documents(df)
    for r in out.groupBy("shard", "source").agg(F.count("*").alias("n")).collect():
        assert abs(r["n"] - share[r["source"]] * 250) <= 2.001, r


def test_brute_force_ranks(spark, docs):
    """The cells give the same order as one sort of all rows."""
    df = docs.select("doc_id", "source", "text")
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleave(df, ["doc_id", "text"]).select("row.doc_id", "shard", "slot").collect()}
    mark = F.xxhash64(F.lit(sharding.SEED), F.col("doc_id").cast("string"), F.col("text"))
    src = F.concat(F.lit("="), "source")
    rows = df.select("doc_id", src.alias("src"), F.xxhash64(F.lit(sharding.SEED), src).alias("tie"), mark.alias("mark")).collect()
    by, part = {}, []
    cells = max(1, -(-len(rows) // 1000))
    for r in rows:
        by.setdefault(r["src"], []).append(r)
    for s, rs in by.items():
        rs.sort(key=lambda r: ((((r["mark"] & (2**64 - 1)) >> 16) % cells), r["mark"]))
        part += [((i + 0.5) / len(rs), r["tie"], s, r["doc_id"]) for i, r in enumerate(rs)]
    n = len(part)
    for at, (_, _, _, d) in enumerate(sorted(part)):
        shard = at * 40 // n
        assert got[d] == (shard, at - (shard * n + 39) // 40)


def test_all_columns_stay(clashing, nothing):
    out = sharding.sharded_documents(clashing)
    assert out.columns == [c for c in clashing.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert out.count() == clashing.count()
    assert sharding.sharded_documents(nothing).count() == 0


def test_no_python_and_no_cross_join(docs):
    plan = sharding.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if w in plan]
