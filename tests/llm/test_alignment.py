import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseload.llm import alignment as al
from caseload.llm import tokens

A_PATH, B_PATH = tokens.vocabulary_path(al.BYTE_LEVEL), tokens.vocabulary_path(al.PIECES)


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in seen]
    letters = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(rest)}
    return a, b, {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items()}


def whole(tools, text):
    """Tokens of the whole text at once as (id, start, end), or none."""
    a, b, a_bytes = tools
    data = b" " + (text or "").encode()
    if not text:
        return [], []
    sides = []
    for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, a_bytes.__getitem__),
                    (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(of(i))))
            at = side[-1][2]
        if b"".join(of(i) for i in ids) != data:
            return [], []
        sides.append(side)
    return sides


def links_of(left, right):
    """All overlapping pairs, looked for one by one."""
    out, j = [], 0
    for i, s, e in left:
        while right[j][2] <= s:
            j += 1
        k = j
        while k < len(right) and right[k][1] < e:
            out.append((i, right[k][0]))
            k += 1
    return out


def expected(tools, rows):
    made, counts = [], Counter()
    for r in rows:
        left, right = whole(tools, r["text"])
        links = links_of(left, right)
        ends = sorted({e for *_, e in left} & {e for *_, e in right})
        shown, rest = [], [iter(left), iter(right)]
        for e in ends:
            group = ["", ""]
            for k, side in enumerate(rest):
                for i, _, end in side:
                    group[k] += f",{i}"
                    if end == e:
                        break
            shown.append("|".join(g[1:] for g in group))
        counts.update(links)
        made.append((r["doc_id"], len(left), len(right), len(ends), links, ";".join(shown)))
    high = defaultdict(int)
    for (_, b), n in counts.items():
        high[b] = max(high[b], n)
    return Counter(
        (d, a, b, g, len(links), sum(counts[x] == high[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(s.encode()).hexdigest() if a else "") for d, a, b, g, links, s in made)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df, **options):
    return Counter(tuple(r) for r in al.align(df, **options).select(*COLUMNS).collect())


STRANGE = [
    "<|endoftext|> <s> x</s> <unk> <0x41>", "a ▁ b", "  two  blanks \n\n and\ttabs ", "größer Straße été naïve", "日本語のテキスト 漢字 한국어",
    "\U0001F600\U0001F468‍\U0001F469 emoji", "x\x00y \x1c z w v", "it's don't we'll 'S", "a" * 700 + " " + "é" * 300,
    "no-blanks-" * 60, "…“quotes”— 1234567 3.14 ½", "é ́ combining", "ﬁ ﬀ Å ﾊ full　width", "﻿   x", "trailing "]


@pytest.fixture(scope="module")
def strange(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(STRANGE)], "doc_id long, text string")


def test_brute_force(tools, docs, edge, nothing, strange):
    small = docs.where("octet_length(text) < 20000 or doc_id % 7 = 0")
    assert got(small) == expected(tools, small.collect())
    short = edge.where("doc_id is null or doc_id <> 9")
    assert got(short) == expected(tools, short.collect())
    assert got(strange) == expected(tools, strange.collect())
    assert got(nothing) == Counter()


@pytest.mark.parametrize("chunk, fan", [(7, 2), (64, 3), (1000, 8)])
def test_ranges_of_any_size_give_the_same(spark, tools, strange, chunk, fan):
    """Documents of many ranges, cut inside tokens and characters, reduced over several levels; split pair counts."""
    words = "the quick größer naïve 12345 unbelievable-ness don't ☃ 漢字".split()
    rng = random.Random(chunk)
    rows = [(100 + i, "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "-"]) for _ in range(40 * i))) for i in range(1, 5)]
    df = spark.createDataFrame(rows + [(None, rows[0][1]), (101, rows[0][1])], "doc_id long, text string").union(strange)
    assert got(df, chunk=chunk, fan=fan, share=50) == expected(tools, df.collect())


def test_very_long_text(spark, tools, edge):
    """A megabyte in more than forty ranges over two levels."""
    df = edge.where("doc_id = 9").select("doc_id", "text")
    assert got(df) == expected(tools, df.collect())


def test_composition_is_associative():
    p = al.pair(A_PATH, B_PATH)
    data = (" " + "größer naïve unbelievable 漢字-日本 " * 6).encode()
    a, b = p.tokens(data, 0)
    cuts = [0, 5, 9, 10, 31, 32, 33, 60, 100, len(data)]
    parts = []
    for lo, hi in zip(cuts, cuts[1:]):
        sides = [s[slice(*np.searchsorted(s["end"], [lo, hi], "right"))] for s in (a, b)]
        parts.append(al.fragment(p, *sides, lo == 0)[0])

    def shape(f):
        return f.shut, f.groups, f.links, f.seams, [s.tolist() for s in (*f.prefix, *f.suffix)]

    def fold(order):
        now = list(parts)
        for i in order:
            i %= len(now) - 1
            now[i:i + 2] = [al.compose(p, now[i], now[i + 1])]
        return shape(now[0])

    rng = random.Random(3)
    first = fold([0] * (len(parts) - 1))
    assert all(fold([rng.randrange(99) for _ in parts[1:]]) == first for _ in range(40))
    assert any(len(f.prefix[0]) or len(f.prefix[1]) for f in parts[1:]) and any(len(f.suffix[0]) for f in parts)


def test_a_stretch_without_borders_is_cut_once():
    data = b" ab " + b"x" * 5000 + b" cd ef"
    ranges = list(al.windows(data, 100))
    assert sum(end - at for _, _, at, end in ranges) < len(data) + 300
    assert [r[0] for r in ranges] == [0, *[r[1] for r in ranges[:-1]]] and ranges[-1][1] == len(data)
    for text in STRANGE:
        raw = (" " + text).encode()
        for lo, hi, at, end in al.windows(raw, 9):
            assert at <= lo < hi <= end and raw[at:at + 1] == b" "


def test_extra_columns(edge, clashing, docs):
    short = "doc_id is null or doc_id <> 9"
    more = clashing.where(short).withColumns({n: F.lit(1) for n in ("row", "no", "last", "links", "pair", "c", "best", "digest", "window")})
    assert got(more) == got(edge.where(short))
