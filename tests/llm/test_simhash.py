import random

import numpy as np
import xxhash

from caseload.llm import simhash
from caseload.llm.links import components


def brute_print(text):
    words = (text or "").encode().translate(simhash.LOWERED).split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{f:016x}", least.get(find(i)), find(i)) for i, ((d, _), f) in enumerate(zip(rows, fps))]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


def test_same_as_brute_force(spark, docs, edge):
    for df in (docs, edge):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert order([tuple(r) for r in simhash.report(df).collect()]) == order(r[:3] for r in brute_components(rows))


def test_fingerprint_of_pieces_is_that_of_the_whole(monkeypatch):
    text = " ".join(random.Random(1).choices("ab cd efg hij klmn o p".split(), k=900))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "word_runs", lambda data: __import__("caseload.llm.common", fromlist=["x"]).word_runs(data, 64))
    assert simhash.fingerprint(text.encode()) == whole
    assert whole & (2**64 - 1) == brute_print(text)


def test_links_lose_nothing_in_a_hot_group(spark, monkeypatch):
    """A dense cloud of fingerprints, over several blocks of a bucket, and single far ones."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(400):
        f = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, 6)):
            f ^= 1 << b
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    arr = np.array(sorted(fps), dtype=np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4
    label = np.arange(len(arr))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(arr))])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long")
    links = simhash.near_links(df, 4)
    assert all((int(r["a"]) ^ int(r["b"])) & (2**64 - 1) for r in links.collect())
    got = {r["node"]: r["root"] for r in components(links).collect()}
    groups = {}
    for f, lab in zip(arr.view(np.int64).tolist(), label.tolist()):
        groups.setdefault(lab, set()).add(f)
    mine = {}
    for f in arr.view(np.int64).tolist():
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(300)}}


def test_one_of_each_keeps_all_columns(edge, clashing, nothing):
    left = simhash.one_of_each(clashing)
    assert left.columns == clashing.columns
    ids = sorted((r["doc_id"] for r in left.collect()), key=lambda x: (x is None, x))
    expected = brute_components([(r["doc_id"], r["text"]) for r in edge.collect()])
    named = dict((root, c) for _, _, c, root in expected)
    assert ids == sorted(named.values(), key=lambda x: (x is None, x))
    assert simhash.one_of_each(nothing).count() == 0
    assert simhash.report(nothing).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.report(nothing).count() == 0
