from collections import Counter

import corpus_pipeline
from caseload.llm import toxicity
from caseload.llm.common import stored
from test_decontam import brute as contamination
from test_mixing import brute_targets, size
from test_simhash import brute_components


def test_stages_against_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]

    def after(name, df):
        out, _ = stored(steps[name](spark, df, small_dir), "test")
        return out

    one = after("toxicity", docs)
    assert one.columns == columns
    assert Counter(r["doc_id"] for r in one.collect()) == Counter(r["doc_id"] for r in docs.collect() if model.score(r["text"]) < 0.3)

    two = after("simhash_near_dedup", one)
    kept = {c for _, _, c, _ in brute_components([(r["doc_id"], r["text"]) for r in one.collect()])}
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(kept) and two.columns == columns

    items = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()]
    three = after("benchmark_decontamination", two)
    windows = contamination([(r["doc_id"], r["text"]) for r in two.limit(25).collect()], items)
    bad = {w[0] for w in windows if w[-1]}
    ids = {r["doc_id"] for r in three.collect()}
    assert all((w[0] in ids) != (w[0] in bad) for w in windows) and three.columns == columns

    four = after("mixing", three)
    sizes, words = Counter(), Counter()
    for r in three.collect():
        sizes[r["source"]] += size(r["text"])
    for r in four.collect():
        words[r["source"]] += size(r["text"])
    for s, t in brute_targets(dict(sizes)).items():
        assert abs(words[s] - t) <= 0.5 + 1e-6
    assert four.columns == columns

    five = after("sharding", four).collect()
    counts = Counter(r["shard"] for r in five)
    assert len(five) == four.count() and max(counts.values()) - min(counts.values()) <= 1
    assert set(counts) == set(range(40))
    assert Counter((r["doc_id"], r["text"]) for r in five) == Counter((r["doc_id"], r["text"]) for r in four.collect())


def test_run_is_the_stages_one_after_the_other(spark, small_dir):
    out = corpus_pipeline.run(spark, small_dir)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and out.count() > 100


def test_stages_take_edge_rows_and_empty_tables(spark, edge, nothing, small_dir):
    for start in (edge, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs, _ = stored(stage(spark, docs, small_dir), "test")
        assert docs.columns[:5] == start.columns
