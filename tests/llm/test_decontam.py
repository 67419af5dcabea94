import hashlib
import re

import numpy as np
import pytest

from caseload.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for name, t in items:
            iw = words(t)
            n = min(13, len(iw))
            for i in range(len(iw) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == iw[i:i + n]:
                        hit |= set(range(j, j + n))
                        found.add("" if name is None else str(name))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([
        (1, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma delta alpha beta gamma"), (2, "lazy DOG"),
        (3, None), (4, ""), (5, "... --"), (6, "größer"), (7, "quick brown fox jumps over the lazy dog near the old river bank today again"),
        (7, "quick brown fox jumps over the lazy dog near the old river bank today again"), (10, "lazy dog"), (None, "word")],
        "item_id long, text string")


def test_same_as_brute_force(spark, edge, items):
    small = edge.where("text is null or length(text) < 1000")
    got = [tuple(r) for r in decontam.report(small, items).collect()]
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert sorted(got, key=key) == sorted(brute(rows, [tuple(r) for r in items.collect()]), key=key)


def test_benchmark_in_blocks_gives_the_same(edge, items):
    whole = decontam.search(edge, items).select("row.doc_id", "found").collect()
    parts = decontam.search(edge, items, block_bytes=1).select("row.doc_id", "found").collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))


def test_shards_of_a_batch_give_the_same(spark, edge, items, monkeypatch):
    seqs = [np.array([1, 2, 3, 1, 2, 3, 4], np.uint32), np.array([], np.uint32), np.array([3, 1, 2, 3], np.uint32)]
    it = decontam.Items(3)
    it.add("a", b"x y z q")
    it.add("b", b"z x")
    it.close()
    assert it.ids == {b"x": 1, b"y": 2, b"z": 3, b"q": 4}
    got = decontam.scan_shard(seqs, it)
    assert got == [([(0, 7)], {"a", "b"}, 4), ([], set(), 0), ([(0, 4)], {"a", "b"}, 3)]
    assert [decontam.scan_shard([s], it)[0] for s in seqs] == got


def test_longest_match(spark, items):
    docs = spark.createDataFrame(
        [(1, "so the quick brown fox jumps over the lazy dog near the old river bank today again and again")], "doc_id long, text string")
    found = decontam.search(docs, items).first()["found"]
    assert found["longest"] == 15 and found["items"] == ["10", "2", "7"] and [tuple(h) for h in found["hits"]] == [(2, 17)]


def test_clean_keeps_the_rest_and_all_columns(clashing, nothing, items):
    left = decontam.clean(clashing, items)
    assert left.columns == clashing.columns and left.schema == clashing.schema
    bad = decontam.report(clashing, items).where("contaminated").count()
    assert bad and left.count() == clashing.count() - bad
    assert decontam.report(nothing, items).count() == 0
    assert decontam.clean(clashing, items.limit(0)).count() == clashing.count()


def test_no_shuffle(docs, spark, small_dir):
    plan = decontam.report(docs, spark.read.parquet(f"{small_dir}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
