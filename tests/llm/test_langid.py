import zlib

import numpy as np

from caseload.llm import langid


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.report(docs).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = np.array([r["lang_pred"] == truth[r["doc_id"]] for r in held])
    score = np.array([r["score"] for r in held])
    assert right.mean() >= 0.97 and ((score >= 0) & (score <= 1)).all()
    assert abs(score.mean() - right.mean()) < 0.05
    sure = np.array([not r["rejected"] for r in held])
    assert sure.mean() > 0.9 and right[sure].mean() >= right.mean()


def test_edge_rows(edge, clashing, nothing, spark):
    got = {(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in langid.report(edge).collect()}
    langs = {"en", "de", "fr", "es"}
    for d, lang, score, rejected in got:
        assert lang in langs | {"und"} and 0 <= score <= 1
        if lang == "und":
            assert score == 0 and rejected and d in (4, 5, 6, 7, 8, None)
    assert {d for d, lang, _, _ in got if lang == "und"} >= {4, 5, 6, 7, 8}
    assert langid.report(clashing).count() == clashing.count()
    assert langid.report(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None, "a", 9)], edge.schema)
    assert [tuple(r) for r in langid.report(unlabelled).collect()] == [(1, False, "und", 0.0, True)]


def test_pieces_give_the_same_average(monkeypatch):
    """Only n-grams in the small overlaps may count twice."""
    from caseload.llm import ngrams

    text = "ein längerer Text mit vielen Wörtern " * 400
    whole = langid.shares(text)
    monkeypatch.setattr(ngrams, "PIECE", 4000)
    assert np.abs(langid.shares(text) - whole).sum() < 0.01


def test_unsure_rows_are_rejected():
    rng = np.random.default_rng(0)
    x = np.zeros((400, 1 << langid.BITS))
    y = np.arange(400) % 2
    x[np.arange(400), y] = 1
    x[300:] = 0
    x[300:, 7] = 1  # says nothing about the language
    model = langid.train(x, y, ["a", "b"], rng.random(400) < 0.5)
    z = x @ model.table + model.bias
    p = np.exp(z - z.max(1, keepdims=True))
    top = p.max(1) / p.sum(1)
    assert (top[:300] >= model.border).all() and (top[300:] < model.border).all()


def test_a_language_with_one_row_is_trained(spark, monkeypatch):
    """Whatever the hash of its only row."""
    taken = []
    monkeypatch.setattr(langid, "train", lambda x, y, langs, held: taken.append((y, langs, held)))
    rows = [(i, f"some text number {chr(97 + i % 26)} {chr(97 + i // 26)}", f"l{i}") for i in range(60)]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    y, langs, held = taken[0]
    assert len(langs) > 30 and set(y[~held]) == set(range(len(langs)))
