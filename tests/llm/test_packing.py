import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseload.llm import packing, tokens


def ids_of(text, made={}):
    if not made:
        made["t"] = Tokenizer.from_file(tokens.vocabulary_path(packing.VOCABULARY))
    return [*made["t"].encode(text or "", add_special_tokens=False).ids, 0]


def check(df, got, size=2048, documents=2048, attention=None):
    """Pieces by brute force; every sequence gapless and within all capacities."""
    want = Counter()
    for r in df.collect():
        ids = ids_of(r["text"])
        for i in range(0, len(ids), size):
            part = np.array(ids[i:i + size], "<u4").tobytes()
            want[r["doc_id"], i // size, i, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= size and len(rows) <= documents
        assert sum(n * n for _, n in rows) <= (attention or size * size)
    return by


def test_pieces_and_sequences(docs, edge, nothing):
    got = packing.report(docs).collect()
    by = check(docs, got)
    part = sum(r["length"] for r in got if r["length"] < 2048)
    alone = sum(r["length"] == 2048 for r in got)
    assert len(by) <= alone + -(-part // 2048) + 1  # next to the bound that no packing can pass
    check(edge, packing.report(edge).collect())
    assert packing.report(nothing).collect() == []
    assert packing.report(docs).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_binds(spark, docs, rule):
    by = check(docs, packing.pack(docs, 256, documents=2, rule=rule, cell=200).collect(), 256, 2)
    assert max(map(len, by.values())) == 2
    short = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    by = check(short, packing.pack(short, 64, documents=3, rule=rule).collect(), 64, 3)
    assert len(by) == 100
    assert len(check(short, packing.pack(short, 64, rule=rule).collect(), 64)) == 19  # 16 of 4 tokens fit one
    with pytest.raises(ValueError):
        packing.pack(docs, 256, attention=100)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_against_a_plain_search(rule):
    """The same bins as a search over all open bins with the scores written out."""
    rng = np.random.default_rng(5)
    lengths, cap, weights = rng.integers(1, 100, 300), (100, 4, 6000 + 4000), (1.0, 0.2, 0.4)
    bins, offsets = packing.best_fit(lengths, cap, weights, rule)
    room, want, at = [], {}, {}
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        need = (lengths[i], 1, lengths[i] ** 2)
        fits = [(b, r) for b, r in enumerate(room) if all(x >= y for x, y in zip(r, need))]
        if rule == "norm":
            score = {b: sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, r, need, cap)) for b, r in fits}
        else:
            score = {b: -sum(w * x * y / c / c for w, x, y, c in zip(weights, r, need, cap)) for b, r in fits}
        if not score:
            room.append(list(cap))
        best = min(score, key=lambda b: (round(score[b], 12), b)) if score else len(room) - 1
        want[i], at[i] = best, cap[0] - room[best][0]
        room[best] = [x - y for x, y in zip(room[best], need)]
    assert [want[i] for i in range(300)] == bins.tolist() and [at[i] for i in range(300)] == offsets.tolist()


def test_copies_are_dealt_out(spark):
    """Equal rows of one document lie in all cells and are packed each."""
    hot = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same words again").alias("text"))
    got = packing.pack(hot, 64, cell=300).collect()
    by = check(hot, got, 64)
    assert len(got) == 4000 and len(by) <= -(-sum(r["length"] for r in got) // 64) * 1.05


def test_sequences_hold_the_ids(docs):
    """Round trip: the pieces read from the sequences are the documents' ids."""
    seqs = {r["sequence_id"]: r for r in packing.sequences(docs, size=512).collect()}
    parts = defaultdict(list)
    for r in seqs.values():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == sum(r["lengths"]) <= 512
        at = 0
        for doc, n in zip(r["doc_ids"], r["lengths"]):
            parts[doc].append(ids[at:at + n])
            at += n
    for r in docs.collect():
        ids = ids_of(r["text"])
        assert sorted(parts[r["doc_id"]]) == sorted(ids[i:i + 512] for i in range(0, len(ids), 512))


def test_words_are_encoded_as_in_the_whole_text(spark):
    strange = ["it's <|endoftext|> x<|endoftext|>y", "á ́e  é가 İİ", "x y z\u0085q\x1cw", "\x00 ﻿ \U0001F600‍",
               "ΑΣ ΑΣ. Σ", " 'S 'LL don't ", "1234 ½ ٣٤", "\r\n\t x\x0b\x0cy"]
    df = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    check(df, packing.report(df).collect())


def test_extra_columns(edge, clashing):
    more = clashing.withColumns({n: F.lit(1) for n in ("row", "piece", "length", "cell", "sequence_id", "offset", "ids")})
    key = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packing.report(df).collect())
    assert key(more) == key(edge)


def test_short_texts_are_looked_up_together(monkeypatch):
    """The pieces of every text are those that it has by itself, with one look-up for many short texts."""
    from caseload.llm import tokens

    known = tokens.words(tokens.vocabulary_path(packing.VOCABULARY))
    found = [b"", b"Some words, of ONE text", b" \t", b"<|endoftext|> Apart <|", b"one " * 2047, b"one " * 2048, b"long " * 9000, b"last"]
    alone = [list(packing._cut(t, known, 2048)) for t in found]
    calls, of = [], known.of
    monkeypatch.setattr(known, "of", lambda words: calls.append(len(words)) or of(words), raising=False)
    assert [list(p) for p in packing._cut_all(found, known, 2048)] == alone
    assert len(calls) < len(found) - 1 and [len(p) for p in alone] == [1, 1, 1, 1, 1, 2, 5, 1]
