import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from caseload.llm import fingerprint


def jaccard(a, b):
    x, y = (Counter((t or "").translate({c: c + 32 for c in range(65, 91)}).split()) for t in (a, b))
    low, high = sum((x & y).values()), sum((x | y).values())
    return low / high if high else 1.0


def check(df):
    """Edited texts by plain slicing over the different rows in order; copies share the result of one."""
    rows = sorted({(r["doc_id"], r["text"] or "") for r in df.collect()}, key=lambda r: (r[0] is not None, r[0] or 0))
    got = df.sparkSession.createDataFrame(fingerprint.report(df).toPandas()).collect()
    assert len(got) == df.count()
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, []).append(t)
    ids = list(by_id)
    for r in got:
        d = None if r["doc_id"] is None or r["doc_id"] != r["doc_id"] else int(r["doc_id"])
        after = by_id[ids[(ids.index(d) + 1) % len(ids)]] + by_id[d]
        options = {
            (len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + n[:len(t) // 2]).encode()).hexdigest()) for t in by_id[d] for n in after}
        assert (r["n_chars"], r["edited_sha256"]) in options
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == fingerprint.SAMPLES * fingerprint.DIGITS
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    return got


def test_edge_rows(edge, clashing, nothing):
    got = check(edge)
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1 and texts[1] == texts[2]
    empty = [r for r in got if r["doc_id"] in (4, 5, 6, 7)]
    assert {r["fingerprint"] for r in empty} == {fingerprint.EMPTY * fingerprint.SAMPLES}
    assert fingerprint.report(clashing).count() == clashing.count()
    assert fingerprint.report(nothing).count() == 0


def test_edited_texts_and_neighbours(docs):
    got = {r["doc_id"]: r for r in check(docs)}
    texts = dict(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    ids = list(texts)
    true, near = [], []
    for i, d in enumerate(ids):
        n, t = texts[ids[(i + 1) % len(ids)]], texts[d]
        edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        true += [jaccard(t, edited), jaccard(t, n)]
        near += [got[d]["near_edited"], got[d]["near_next"]]
    assert abs(np.mean(near) - np.mean(true)) < 0.02
    assert np.corrcoef(near, true)[0, 1] > 0.8
    by_text = {}
    for d in ids:
        by_text.setdefault(texts[d], set()).add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_collisions_follow_the_generalised_jaccard_similarity(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows, true = [], []
    for i in range(400):
        a = rng.choices(words, k=120, weights=[1 / (k + 1) for k in range(60)])
        b = [w if rng.random() < 0.6 else rng.choice(words) for w in a]
        rows += [(i, 0, " ".join(f"{i}{w}" for w in a)), (i, 1, " ".join(f"{i}{w}" for w in b))]
        true.append(jaccard(rows[-2][2], rows[-1][2]))
    signed = fingerprint.signatures(spark.createDataFrame(rows, "i long, side int, text string"), ["i", "side"])
    pairs = signed.where("side = 0").join(signed.where("side = 1").select("i", F.col("fingerprint").alias("other")), "i")
    near = [r["x"] for r in pairs.select(fingerprint.likeness(F.col("fingerprint"), F.col("other")).alias("x")).collect()]
    assert len(near) == 400 and abs(np.mean(near) - np.mean(true)) < 0.015


def test_single_pairs_are_read_closely(spark):
    """Pairs of different similarity; 16 samples miss a third of them by more than 0.1."""
    rng = random.Random(8)
    rows, true = [], []
    for i in range(400):
        a = [f"{i}a{k}" for k in range(100)]
        b = a[:round(100 * rng.uniform(0.6, 0.95))]
        b += [f"{i}b{k}" for k in range(100 - len(b))]
        rows += [(i, 0, " ".join(a)), (i, 1, " ".join(b))]
        true.append(jaccard(rows[-2][2], rows[-1][2]))
    signed = fingerprint.signatures(spark.createDataFrame(rows, "i long, side int, text string"), ["i", "side"])
    pairs = signed.where("side = 0").join(signed.where("side = 1").select("i", F.col("fingerprint").alias("other")), "i")
    near = {r["i"]: r["x"] for r in pairs.select("i", fingerprint.likeness(F.col("fingerprint"), F.col("other")).alias("x")).collect()}
    error = np.abs([near[i] - t for i, t in enumerate(true)])
    assert np.sqrt(np.mean(error ** 2)) < 0.07 and np.mean(error > 0.15) < 0.03 and error.max() < 0.3


def test_signatures_by_brute_force(spark, docs):
    """Every sample of some texts and their second texts, written out without Spark."""
    import math

    import xxhash

    def h(x, seed=42):
        data = x if isinstance(x, bytes) else (x & (2**64 - 1)).to_bytes(8, "little")
        return xxhash.xxh64_intdigest(data, seed)

    def signature(text):
        counts = Counter(text.translate({c: c + 32 for c in range(65, 91)}).encode().split())
        terms = [(h(w), n) for w, n in counts.items()]
        out = ""
        for i in range(fingerprint.SAMPLES):
            best = None
            for term, n in terms:
                one = h(i, h(term))
                two = h(one)
                r = -math.log(((one >> 32) + 0.5) * ((one & 0xFFFFFFFF) + 0.5) * 2.0 ** -64)
                c = -math.log(((two & 0x1FFFFF) + 0.5) * ((two >> 21 & 0x1FFFFF) + 0.5) * 2.0 ** -42)
                b = ((two >> 42) + 0.5) * 2.0 ** -22
                t = math.floor(math.log(n) / r + b)
                a = math.log(c) - r * (t + 1.0 - b)
                value = (term ^ t * fingerprint.VALUE_STEP) & ((1 << fingerprint.VALUE_BITS) - 1)
                best = min(best or (a, value), (a, value))
            out += f"{best[1]:06x}"
        return out

    rows = docs.where("doc_id < 60 and octet_length(text) < 1500").selectExpr("doc_id", "text", "concat(left(text, 200), ' Other other words') AS second")
    got = fingerprint.signatures(rows, ["doc_id"], texts={"text": "x", "second": "y"}).collect()
    texts = {r["doc_id"]: r for r in rows.collect()}
    assert len(got) == len(texts) > 10
    for r in got:
        assert r["x"] == signature(texts[r["doc_id"]]["text"]) and r["y"] == signature(texts[r["doc_id"]]["second"])


def test_samples_without_python(docs):
    plan = fingerprint.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if w in plan]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_terms_left_out_change_no_sample(spark):
    """Fingerprints that are sure are those of all terms, at any bound, also for texts without words."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Ä", "ÄB", "x\x00y"]
    text = lambda: rng.choice([" ", "\t", "\n \x0b", "\r\x0c"]).join(rng.choices(words, k=rng.choice([0, 1, 2, 40, 400])))
    rows = spark.createDataFrame([(i, text(), None if i % 11 == 0 else text()) for i in range(120)], "i int, text string, second string")
    names = {"text": "a", "second": "b"}
    full = {r["i"]: (r["a"], r["b"]) for r in fingerprint.signatures(rows, ["i"], texts=names).collect()}
    unsure = {}
    for bound in (3.0, 12.0):
        got = {r["i"]: r for r in fingerprint.signatures(rows, ["i"], texts=names, bound=bound).collect()}
        assert got.keys() == full.keys()
        assert all((r["a"], r["b"]) == full[i] for i, r in got.items() if r["sure"])
        unsure[bound] = sum(not r["sure"] for r in got.values())
    assert 0 < unsure[3.0] and unsure[12.0] <= 3 and unsure[12.0] < unsure[3.0]


def test_unsure_texts_are_drawn_in_full(edge, monkeypatch):
    wanted = _rows(fingerprint.report(edge))
    ring, _ = fingerprint.stored(fingerprint._ring(edge), "ring")
    columns = ["no_id", "id", "mark", "fingerprint", "edited_fingerprint", "edited_sha256"]
    most = _rows(fingerprint._signed(edge, ring).select(*columns))
    assert _rows(fingerprint._signed(edge, ring, bound=0.5).select(*columns)) == most
    original = fingerprint._signed
    monkeypatch.setattr(fingerprint, "_signed", lambda docs, ring: original(docs, ring, bound=2.0))
    assert _rows(fingerprint.report(edge)) == wanted
