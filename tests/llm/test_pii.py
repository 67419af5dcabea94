import hashlib
import random
import re
import time

import numpy as np
import pytest

from caseload.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits(m[0])[::-1]
        if 12 <= len(d) <= 19 and sum(d[::2] + [x for y in d[1::2] for x in divmod(2 * y, 10)]) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_patterns_on_random_texts():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choices("aZ0159@@..-_+ ()%٥ü", k=rng.randint(1, 40)))
        assert sorted(pii.base_spans(text)) == sorted(brute(text)), text


@pytest.mark.parametrize("text", ["1" * 400_000, "a" * 400_000 + "@", "a@" * 200_000, "1." * 200_000, "+1(" * 130_000, "1 " * 200_000, "a.b@" * 100_000])
def test_long_runs_take_linear_time(text):
    start = time.time()
    pii.base_spans(text)
    assert time.time() - start < 5


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 200)


def test_other_forms_are_added_and_plain_numbers_are_not(field):
    def added(text):
        return [(k, text[s:e]) for k, s, e in pii.find(text, field)[1]]

    assert added("please call 1 (407) 555-7710 soon") == [("phone", "1 (407) 555-7710")]
    assert added("the host 10[.]20[.]30[.]40 is down") == [("ip", "10[.]20[.]30[.]40")]
    for text in ("in 1999 and 2.0 of 12 items", "Apache License, Version 2.0.", "no numbers at all", "", None):
        assert pii.find(text, field) == ([], [])


def test_written_out_addresses_without_digits_are_added(field):
    """Recall on planted addresses, and no find in texts that only say at."""
    names = ["bob", "anna.lee", "sales", "j.smith", "kim"]
    hosts = ["host.com", "mail.example.org", "desk.support.example.net"]
    forms = [
        lambda u, h: f"{u}(at){h}", lambda u, h: f"{u} [at] {h}", lambda u, h: f"{u} [at] {h.replace('.', ' [dot] ')}",
        lambda u, h: f"{u} at {h.replace('.', ' dot ')}", lambda u, h: f"{u.replace('.', ' dot ')} at {h.replace('.', ' dot ')}"]
    found = []
    for form in forms:
        for u in names:
            for h in hosts:
                mail = form(u, h)
                text = f"please write to {mail} for more about it"
                found.append(("email", mail) in [(k, text[s:e]) for k, s, e in pii.find(text, field)[1]])
    assert np.mean(found) >= 0.9, [np.mean(found[i:i + 15]) for i in range(0, 75, 15)]
    mail = "a dot b at mail dot example dot com"
    assert [(k, mail[s:e]) for k, s, e in pii.find(mail, field)[1]] == [("email", mail)]
    for text in ("we met at the office at noon", "look at the dot on the map", "the cat sat (at home) and ate"):
        assert pii.find(text, field) == ([], [])


def test_sums_over_all_segmentations():
    """Forward, backward and best path against enumeration."""
    text = "a 1 @ b2"
    tokens = [m.span() for m in pii.TOKEN.finditer(text)]
    rng = np.random.default_rng(2)
    field = pii.Field(rng.normal(0, 0.3, (5, 1 << pii.BITS)), rng.normal(0, 0.5, (5, 5)))
    s = field.scores(pii.lattice(text, tokens))
    paths = []

    def walk(i, last, total, path):
        if i == len(tokens):
            paths.append((total, path))
        for size in range(1, min(pii.LONGEST, len(tokens) - i) + 1):
            for y in range(5):
                x = s[i + size - 1, size - 1, y]
                if x > pii.NEVER / 2:
                    walk(i + size, y, total + x + (field.follow[last, y] if last is not None else 0), [*path, (i, i + size, y)])

    walk(0, None, 0.0, [])
    totals = np.array([t for t, _ in paths])
    assert field.sums(s)[-1] == pytest.approx(np.logaddexp.reduce(totals))
    assert field.best(s) == max(paths)[1]
    chance = field.chances(s)
    p = np.exp(totals - np.logaddexp.reduce(totals))
    for i, j, y in {seg for _, path in paths for seg in path}:
        assert chance[j - 1, j - i - 1, y] == pytest.approx(sum(q for q, (_, path) in zip(p, paths) if (i, j, y) in path), abs=1e-9)


def test_report(spark, edge, clashing, nothing, docs):
    more = spark.createDataFrame([
        (50, "mail \U0001F600 bob@mail.example.com, +1 (407) 555-7710; 10.0.0.1 4111 1111 1111 1111 x", "en", "a", 1),
        (51, "١٢ ١٢٣ a@b.c_x@d.e", "en", "a", 1)], edge.schema)
    df = edge.union(more).union(docs.select(edge.columns))
    rows = pii.report(df).collect()
    texts = {}
    for r in df.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert len(rows) == df.count()
    for r in rows:
        fits = []
        for t in texts[r["doc_id"]]:
            base = sorted(brute(t), key=lambda x: (x[1], pii.KINDS.index(x[0])))
            text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
            counts = tuple(sum(k == kind for k, _, _ in base) for kind in pii.KINDS)
            fits.append(counts == (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"])
                        and hashlib.sha256(text.encode()).hexdigest() == r["base_sha256"]
                        and {*text.split(",")} <= {*r["spans"].split(",")} | {""}
                        and len(r["spans"].split(",")) == (len(base) + r["n_added"] or 1))
        assert any(fits), r
    assert pii.report(nothing).count() == 0 and pii.report(clashing).count() == clashing.count()
