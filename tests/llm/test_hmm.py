import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from caseload.llm import hmm


def tokens(text):
    return [*(text or "").encode().translate(hmm.LOWERED).split(), None]


def brute_base(rows):
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(t for (_, x), h in zip(rows, held) if not h for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(d, h, len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n,
             sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))) for (d, x), h in zip(rows, held)]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 4))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)


def test_base_score_and_better_model(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in hmm.report(docs).collect()]
    same([r[:6] for r in got], brute_base(rows))
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_edge_rows(edge, clashing, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = [tuple(r) for r in hmm.report(edge).collect()]
    same([r[:6] for r in got], brute_base(rows))
    assert all(math.isfinite(r[6]) and r[6] <= 0 for r in got)
    assert hmm.report(clashing).count() == clashing.count()
    assert hmm.report(nothing).count() == 0


def test_without_training_rows(spark, edge):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = hmm.report(spark.createDataFrame([(held, "a b", None, None, 3)], edge.schema)).first()
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0
    assert math.isfinite(row["score"])


def test_common_words_and_joined_words_give_the_same(docs, monkeypatch):
    """How many words are broadcast is no matter of the result."""
    few = docs.limit(40)
    want = sorted(map(tuple, hmm.score(few, rounds=0).collect()))
    monkeypatch.setattr(hmm, "COMMON_SHARE", hmm.OWN_SHARE)
    got = sorted(map(tuple, hmm.score(few, rounds=0).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want])


@pytest.fixture
def small():
    rng = np.random.default_rng(1)
    part = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    emit = rng.random((5, 3))
    return hmm.Model(part(3), part(3, 3), emit / emit.sum(axis=0))


def enumerate_paths(seq, m):
    for path in itertools.product(range(3), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        yield path, p


def test_recursions_against_enumeration(small):
    seqs = [np.array(s) for s in ([0, 1, 2, 4, 0], [3], [1, 1], [2, 0, 0, 4, 3, 1])]
    logs = hmm.forward(seqs, small)[0]
    start, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for k, seq in enumerate(seqs):
        paths = list(enumerate_paths(seq, small))
        total = sum(p for _, p in paths)
        assert logs[k] == pytest.approx(math.log10(total))
        for path, p in paths:
            start[path[0]] += p / total
            for t, s in enumerate(path):
                emits[seq[t], s] += p / total
                if t:
                    moves[path[t - 1], s] += p / total
    got = hmm.expected_counts(seqs, small)
    assert np.allclose(got[0], start) and np.allclose(got[1], moves) and np.allclose(got[2], emits)


def test_training_raises_the_likelihood(docs):
    totals = [sum(r["score"] for r in hmm.score(docs, rounds=k).collect() if not r["held_out"]) for k in (0, 2, 4)]
    assert totals[0] < totals[1] < totals[2]
