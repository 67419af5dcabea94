import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from caseload.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Levels from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i:i + 8])) for i in range(0, len(now), 8)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        lo = at // 8 * 8
        yield "".join(level[lo:at]), "".join(level[at + 1:lo + 8])
        at //= 8


def leaf_of(r, text):
    def part(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    return h("".join(map(part, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for k in langs:
        by[k].sort(key=lambda x: x[:3])
        trees[k] = tree([x[2] for x in by[k]])
    top = tree([trees[k][-1][0] for k in langs]) if langs else None
    out = []
    for j, k in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(by[k]):
            path = [*siblings(trees[k], i), *siblings(top, j)]
            cur, text = leaf, r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                cur = leaf_of(r, text.translate({c: c + 32 for c in range(65, 91)}))
            for left, right in path:
                cur = h(left + cur + right)
            out.append((r["doc_id"], leaf, trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in path)), cur, cur == top[-1][0]))
    return out


def check(df):
    got = [tuple(r) for r in merkle.report(df).collect()]
    assert Counter(got) == Counter(expected(df.collect()))
    return got


def test_brute_force(docs, edge, nothing):
    got = check(docs)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)
    check(edge)
    assert merkle.report(nothing).collect() == []


def test_tree_shapes(spark):
    """One leaf, a full run, one more than a run, and a last run of one node on an upper level."""
    for n in (1, 8, 65, 513):
        check(spark.range(n).select(
            F.col("id").alias("doc_id"), F.concat(F.lit("T"), F.col("id")).alias("text"), F.lit("en").alias("lang"),
            F.lit("s").alias("source"), F.col("id").alias("n_chars")))


def test_many_trees(spark):
    check(spark.range(300).select(
        F.col("id").alias("doc_id"), F.lit("Text").alias("text"), F.concat(F.lit("é"), F.col("id") % 77).alias("lang"),
        F.lit(None).cast("string").alias("source"), F.lit(4).cast("long").alias("n_chars")))


def test_equal_rows_are_dealt_out(spark):
    """A third of all rows are one row; no partition of the order gets them all, and all proofs hold."""
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).cast("long").alias("doc_id"),
        F.lit("Same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    check(hot)


def test_same_result_in_other_partitions(docs):
    assert Counter(map(tuple, merkle.report(docs.repartition(7)).collect())) == Counter(map(tuple, merkle.report(docs).collect()))


def test_extra_columns_stay_out(edge, clashing):
    more = clashing.withColumns({n: F.lit(1) for n in ("tree", "digest", "item", "path", "lo", "hi", "n", "kids", "root", "leaf", "shown")})
    assert Counter(map(tuple, merkle.report(more).collect())) == Counter(map(tuple, merkle.report(edge).collect()))


def test_one_changed_byte_breaks_only_its_own_proof(docs):
    """Proofs are made once; a row whose field changes later folds to another root."""
    rows = merkle.manifest(docs, also={"other": merkle.leaf([
        F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + F.when(F.col("doc_id") == 7, 1).otherwise(0), F.col("text")])})
    bad = rows.where(merkle.folded(F.col("other"), F.col("path")) != F.col("root")).select("doc_id").collect()
    assert [r[0] for r in bad] == [7]


def test_no_python_and_no_cross_join(docs):
    plan = merkle.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if w in plan]
