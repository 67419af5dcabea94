import random
import zlib

import numpy as np
import pytest

from caseload.llm import toxicity


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(more, labels):
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.report(more, labels).collect()
    assert len(rows) == more.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) >= 0.93


def test_buckets_do_not_depend_on_pieces(monkeypatch):
    from caseload.llm import ngrams

    text = "some longer text, with words and more words " * 20
    whole = toxicity.buckets(text)
    monkeypatch.setattr(ngrams, "PIECE", 37)
    assert toxicity.buckets(text).tolist() == whole.tolist()


def test_edge_rows(edge, clashing, nothing, labels, spark):
    marks = spark.createDataFrame(
        [(1, 1), (2, 0), (3, 1), (4, 0), (9, 0), (10, 0), (11, 1), (11, 0), (None, 1), (5, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.report(edge, marks).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    left = toxicity.clean(clashing, marks)
    assert left.columns == clashing.columns and left.schema == clashing.schema
    assert left.count() == sum(r["score"] < 0.3 for r in got)
    assert toxicity.report(nothing, marks).count() == 0
    alone = toxicity.report(edge, marks.where("toxic = 0")).collect()
    assert len({r["score"] for r in alone}) == 1 and toxicity.report(edge, marks.limit(0)).count() == edge.count()


def test_labels_are_no_input_of_a_score(more, labels, spark):
    """Labels of the held-out fold change nothing."""
    model = toxicity.fit(more, labels)
    flipped = labels.selectExpr(
        "doc_id", "quality", "CASE WHEN crc32(encode(cast(doc_id as string), 'utf-8')) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    other = toxicity.fit(more, flipped)
    assert np.allclose(model.weight, other.weight) and model.bias == pytest.approx(other.bias)


def test_rare_toxic_words_are_scored(spark):
    """Frequent toxic words alone fill 2048 features; the held-out texts hold only the rare ones."""
    rng = random.Random(3)
    # Equal ends: only the letters between tell words apart.
    plain, often, seldom = (
        [f"mnop{''.join(rng.choices('abcdefghijklmnopqrstuvwxyz', k=8))}rstu" for _ in range(n)] for n in (120, 75, 15))
    rows, held, n = [], [], {False: 0, True: 0}
    for i in range(6_000):
        out = zlib.crc32(str(i).encode()) % 4 == 2
        w = rng.choices(plain, k=12)
        if i % 3 == 0:
            k, n[out] = n[out], n[out] + 1
            w[rng.randrange(1, 11)] = seldom[k // 12 % 15] if out or k % 12 == 0 else often[k % 75]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
        if out:
            held.append(rows[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    caught = [model.score(t) >= toxicity.REJECT for _, t, toxic in held if toxic]
    wrong = [model.score(t) >= toxicity.REJECT for _, t, toxic in held if not toxic]
    assert np.mean(caught) > 0.95 and np.mean(wrong) < 0.05
