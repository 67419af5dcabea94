import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from caseload.llm import mixing


def size(text):
    return len(re.findall(mixing.WORD, text or ""))


def brute_targets(sizes):
    """Reshare the excess by weight until no source is above three times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        rest = [s for s in order if s not in full]
        share = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if share * weight[s] > 3 * sizes[s]]
        if not over:
            return {**full, **{s: share * weight[s] for s in rest}}
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def check(df):
    rows = df.collect()
    got = mixing.report(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2])
    assert sorted(((r["doc_id"], r["source"], size(r["text"])) for r in rows), key=key) == sorted(
        ((r["doc_id"], r["source"], r["size"]) for r in got), key=key)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    target, taken = brute_targets(dict(sizes)), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    again = mixing.report(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_targets_and_taken(docs, edge):
    check(docs)
    check(edge)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    x = np.arange(n)
    y = mixing.permute(x, n, 5)
    assert sorted(y.tolist()) == x.tolist()
    assert mixing.unpermute(y, n, 5).tolist() == x.tolist()


@pytest.mark.parametrize("total", [1, 7, 8, 9, 23, 24, 100])
def test_slots_give_exactly_the_words_due(total):
    block, blocks = 8, -(-total // 8)
    for due in range(3 * total + 1):
        n, last = mixing.slots_due("=s", total, due, block, 1)
        words = 0
        for slot in range(n):
            at = int(mixing.permute(np.array([slot % blocks]), blocks, mixing.pass_key("=s", slot // blocks, 1))[0])
            have = min(block, total - at * block)
            words += min(have, last) if slot == n - 1 else have
        assert words == due


def test_mixed_documents(docs, clashing, nothing):
    for df in (docs, clashing):
        light, sources, taken = mixing.mix(df)
        out = mixing.mixed_documents(df)
        assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        rows = out.collect()
        words = Counter()
        for r in rows:
            words[r["source"]] += size(r["text"])
            assert r["n_chars"] == len(r["text"])
        for r in sources.collect():
            assert abs(words[r["source"]] - r["target"]) <= 0.5 + 1e-6
        per_doc = Counter()
        for r in rows:
            per_doc[r["doc_id"]] += size(r["text"])
        want = Counter()
        for r in mixing.report(df).collect():
            want[r["doc_id"]] += r["taken"]
        assert +per_doc == +want
    assert mixing.mixed_documents(nothing).count() == 0 and mixing.report(nothing).count() == 0


def test_runs_of_words():
    text = " a  b c\nd e "
    assert mixing.spoken(text, [(0, 2), (2, 5)], 5) == text
    assert mixing.spoken(text, [(0, 2), (3, 5)], 5) == "a  b\nd e"


def test_hot_source_is_drawn_over_many_shards(docs):
    _, _, taken = mixing.mix(docs, block=16, shard_blocks=8)
    assert taken.select("shard").distinct().count() > 100
