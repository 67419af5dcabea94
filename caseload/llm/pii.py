"""Personal data by exact patterns and a semi-Markov conditional random field (operator 6).

The patterns find well-formed e-mail addresses, IP addresses, card and phone numbers. The field looks at
the tokens around digits, ``@``, written-out dots and an ``at`` in brackets: every run of up to ``LONGEST`` tokens is a candidate
segment scored by features of the whole span (shape, digits, checks, neighbours); a token outside any
entity is a segment of its own. Dynamic programming over the bounded segments chooses borders and types
jointly. It is trained by gradient ascent in numpy on a bounded sample of such places: what the patterns
find is the truth there, and written-out variants of it teach the forms that the patterns miss. A segment
that touches no pattern's span and whose probability is at least ``SURE`` is added.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.llm.common import column

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
LONGEST = 11  # tokens of 'a dot b at mail dot example dot com' and one label more
BITS = 13
AROUND = 40  # characters of context on either side of a trigger
SAMPLE = 500  # documents with a trigger that train the model
EPOCHS = 3
RATE = 0.3
SURE = 0.9
NEVER = -1e30

# The patterns. Repetitions that cannot give back are possessive, so no text takes more than linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TRIGGER = re.compile(r"[0-9@]|\b[Dd][Oo][Tt]\b|[\[({<]\s?[Aa][Tt]\s?[\])}>]")
SIGN = re.compile(r"[0-9@]|\b(?:[Dd][Oo][Tt]|[Aa][Tt])\b")
DOT = r"(?:\.|\s*[\[({<]\s?dot\s?[\])}>]\s*|\s+dot\s+)"
MAIL = re.compile(
    rf"[a-z0-9_%+-]++(?:{DOT}[a-z0-9_%+-]++)*+(?:@|\s*[\[({{<]\s?(?:at|@)\s?[\])}}>]\s*|\s+at\s+)[a-z0-9-]++(?:{DOT}[a-z0-9-]++)++")
LONGEST_MAIL = 320  # code points of a span that is compared to MAIL
TOKEN = re.compile(r"\S+")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and domain; each @ is looked at once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        free = m.end() if m else max(free, start)
        at = text.find("@", at + 1)
    return out


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """What the patterns find, kind by kind, as code point offsets."""
    out = _emails(text)
    if any_digit(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def any_digit(text: str) -> bool:
    return re.search("[0-9]", text) is not None


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


# The field.

def regions(text: str) -> list[list[tuple[int, int]]]:
    """Tokens near triggers, as lists of offsets; overlapping surroundings are one region."""
    ranges: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if ranges and lo <= ranges[-1][1]:
            ranges[-1][1] = hi
        else:
            ranges.append([lo, hi])
    out = []
    for lo, hi in ranges:
        tokens = [m.span() for m in TOKEN.finditer(text, lo, hi)]
        if tokens:
            out.append(tokens)
    return out


def bare(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation around it; a leading + or bracket stays."""
    while end > start and not text[end - 1].isalnum():
        end -= 1
    while start < end and not (text[start].isalnum() or text[start] in "+(" and end - start > 1):
        start += 1
    return start, end


def _shape(s: str) -> str:
    s = re.sub("[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", s)
    return re.sub(r"[^\W\d_]+", "a", s)[:40]


def _is_dot(token: str) -> bool:
    return token.lower().strip("[](){}<>") == "dot"


def features(text: str, start: int, end: int, before: str, after: str) -> list[int]:
    """Hashed features of a whole span and its neighbours; always as many."""
    s = text[start:end]
    d = _digits(s)
    low = s.lower()
    parts = re.split(r"[^0-9]+", s)
    octets = [p for p in parts if p]
    dotted = re.search(r"\S\s*[\[(]?\s*(?:@|\bat\b)\s*[\])]?\s*\S", low) is not None
    names = (
        f"shape {_shape(s)}", f"digits {len(d)}", f"letters {sum(c.isalpha() for c in s) > 0} {'@' in s}",
        f"luhn {12 <= len(d) <= 19 and luhn(d)} {len(d) == sum(c not in ' -.' for c in s)}",
        f"octets {len(octets) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in octets)} {len(d) == len(s) - s.count('.')}",
        f"mail {dotted} {len(re.findall(r'(?:[.]|[^a-z]dot[^a-z])[a-z]{2,}', low)) > 0} {s.count(' ')}",
        f"first {s[:1] if s[:1] in '+(@' else ''} {len(octets)}", f"marks {''.join(sorted(set(re.sub(r'[\w\s]', '', s))))[:8]}",
        f"edges {s[:1].isalnum()} {s[-1:].isalnum()} {s[:1].isdigit()} {s[-1:].isdigit()}",
        f"before {before.lower().strip('.,:;')[:12] if any(c.isalpha() for c in before) else _shape(before)[:6]}",
        f"after {any(c.isdigit() for c in after)} {before[-1:].isdigit()}",
        f"form {len(s) <= LONGEST_MAIL and MAIL.fullmatch(low) is not None} {_is_dot(before)} {_is_dot(after)}", "bias")
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for n in names]


N_FEATURES = 13


def lattice(text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
    """Features of the segment of length L + 1 that ends at token j, -1 where there is none."""
    n = len(tokens)
    out = np.full((n, LONGEST, N_FEATURES), -1, dtype=np.int64)
    words = [text[a:b] for a, b in tokens]
    signs = np.array([SIGN.search(w) is not None for w in words])
    marked = np.concatenate(([0], np.cumsum(signs)))
    for j in range(n):
        for size in range(min(LONGEST, j + 1)):
            i = j - size
            if size and marked[j + 1] == marked[i]:
                continue  # an entity holds at least one trigger
            a, b = bare(text, tokens[i][0], tokens[j][1])
            if a < b or not size:
                out[j, size] = features(text, a, b, words[i - 1] if i else "", words[j + 1] if j + 1 < n else "")
    return out


@dataclass
class Field:
    weight: np.ndarray  # label by feature
    follow: np.ndarray  # label by label

    def scores(self, feats: np.ndarray) -> np.ndarray:
        """Score of each segment for each label: token, length, label."""
        s = self.weight[:, np.maximum(feats, 0)].sum(axis=-1)
        s = np.moveaxis(np.where(feats[None, :, :, 0] < 0, NEVER, s), 0, -1)
        s[:, 1:, OUTSIDE] = NEVER
        return s

    def sums(self, s: np.ndarray):
        """Forward and backward sums over all segmentations: before a segment, after it, and the total."""
        n = len(s)
        ahead, start = np.full((n + 1, OUTSIDE + 1), NEVER), np.full((n + 1, OUTSIDE + 1), NEVER)
        start[0] = 0.0
        for j in range(n):
            size = min(LONGEST, j + 1)
            x = s[j, :size] + start[j - size + 1:j + 1][::-1]
            ahead[j + 1] = _logsum(x, 0)
            start[j + 1] = _logsum(ahead[j + 1][:, None] + self.follow, 0)
        behind, enter = np.zeros((n + 1, OUTSIDE + 1)), np.full((n + 1, OUTSIDE + 1), NEVER)
        for i in range(n - 1, -1, -1):
            size = min(LONGEST, n - i)
            k = np.arange(size)
            enter[i] = _logsum(s[i + k, k] + behind[i + 1 + k], 0)
            behind[i] = _logsum(self.follow + enter[i][None, :], 1)
        return ahead, start, behind, enter, float(_logsum(ahead[n], 0))

    def chances(self, s: np.ndarray) -> np.ndarray:
        """Probability of every segment and label."""
        _, start, behind, _, total = self.sums(s)
        n = len(s)
        out = np.zeros_like(s)
        for size in range(min(LONGEST, n)):
            out[size:, size] = np.exp(np.minimum(start[:n - size] + s[size:, size] + behind[size + 1:] - total, 0))
        return out

    def best(self, s: np.ndarray) -> list[tuple[int, int, int]]:
        """The best segmentation: first token, end, label."""
        n = len(s)
        top, back = np.full((n + 1, OUTSIDE + 1), NEVER), {}
        start = np.full((n + 1, OUTSIDE + 1), NEVER)
        start[0], prev = 0.0, np.zeros((n + 1, OUTSIDE + 1), dtype=int)
        for j in range(n):
            size = min(LONGEST, j + 1)
            x = s[j, :size] + start[j - size + 1:j + 1][::-1]
            pick = x.argmax(axis=0)
            top[j + 1] = x.max(axis=0)
            for y in range(OUTSIDE + 1):
                back[j + 1, y] = int(pick[y])
            step = top[j + 1][:, None] + self.follow
            start[j + 1], prev[j + 1] = step.max(axis=0), step.argmax(axis=0)
        out, j = [], n
        y = int(top[n].argmax())
        while j > 0:
            i = j - 1 - back[j, y]
            out.append((i, j, y))
            y = int(prev[i][y]) if i else y
            j = i
        return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def gold(text: str, tokens: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int, int]] | None:
    """The spans as segments of tokens; None if one doesn't fit the tokens or the lengths."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        inside = [k for k, (a, b) in enumerate(tokens) if a < e and b > s]
        if not inside:
            continue
        i, j = inside[0], inside[-1] + 1
        if i < at or j - i > LONGEST or bare(text, tokens[i][0], tokens[j - 1][1]) != bare(text, s, e):
            return None
        out += [(k, k + 1, OUTSIDE) for k in range(at, i)] + [(i, j, KINDS.index(kind))]
        at = j
    return out + [(k, k + 1, OUTSIDE) for k in range(at, len(tokens))]


def variants(kind: str, s: str) -> list[str]:
    """Other ways to write what a pattern has found."""
    if kind == "email":
        user, host = s.split("@", 1)
        # Each form is taught by one of these addresses: most people's have no digits, and hosts have two labels or more.
        letters = str.maketrans("0123456789", "abcdefghij")
        plain, name, labels = user.translate(letters), re.sub("[^A-Za-z]+", "", user) or "a", host.translate(letters).split(".")
        kinds = [(user, host), (plain, ".".join(labels)), (name, ".".join(labels[-2:])), (name, ".".join(["a", *labels])), (plain, ".".join(labels[-2:]))]
        out = []
        for form in range(6):
            u, h = kinds[zlib.crc32(f"{form} {s}".encode()) % len(kinds)]
            dots = h.replace(".", " dot ")
            out.append((
                f"{u} at {dots}", f"{u.replace('.', ' dot ')} at {dots}", f"{u} [at] {h.replace('.', ' [dot] ')}", f"{u}(at){h}",
                f"{u} [at] {h}", f"{u}[at]{h}")[form])
        return out
    if kind == "ip":
        return [s.replace(".", "[.]"), s.replace(".", " . ")]
    d = _digits(s)
    if kind == "card":
        return ["-".join(d[i:i + 4] for i in range(0, len(d), 4)), ".".join(d[i:i + 4] for i in range(0, len(d), 4))]
    return [s.lstrip("+"), f"00{s[1:]}", f"({d[:-7]}) {d[-7:-4]} {d[-4:]}"]


def examples(text: str) -> list[tuple[str, list[Span]]]:
    """The places of a text as training examples: as they are, and each finding in its other forms."""
    out = []
    spans = base_spans(text)
    for tokens in regions(text):
        lo, hi = tokens[0][0], tokens[-1][1]
        here = [(k, s - lo, e - lo) for k, s, e in spans if lo <= s and e <= hi]
        piece = text[lo:hi]
        if len(tokens) > 80:
            continue  # long tables of numbers teach little
        out.append((piece, here))
        if len(here) == 1:
            k, s, e = here[0]
            out += [(piece[:s] + v + piece[e:], [(k, s, s + len(v))]) for v in variants(k, piece[s:e])]
    return out


def learn(cases: list[tuple[str, list[Span]]], seed: int = 6) -> Field:
    """Maximum conditional likelihood by stochastic gradient ascent with per-weight rates."""
    field = Field(np.zeros((OUTSIDE + 1, 1 << BITS)), np.zeros((OUTSIDE + 1, OUTSIDE + 1)))
    ready = []
    for piece, spans in cases:
        tokens = [m.span() for m in TOKEN.finditer(piece)]
        path = gold(piece, tokens, spans) if tokens else None
        if path:
            ready.append((lattice(piece, tokens), path))
    rng = np.random.default_rng(seed)
    square, square_follow = np.full_like(field.weight, 1e-2), np.full_like(field.follow, 1e-2)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(ready)):
            feats, path = ready[k]
            s = field.scores(feats)
            ahead, start, behind, enter, total = field.sums(s)
            gap = -field.chances(s)
            change = np.zeros_like(field.follow)
            for i in range(1, len(s)):
                change -= np.exp(np.minimum(ahead[i][:, None] + field.follow + enter[i][None, :] - total, 0))
            for a, (i, j, y) in enumerate(path):
                gap[j - 1, j - i - 1, y] += 1
                if a:
                    change[path[a - 1][2], y] += 1
            at = np.argwhere((np.abs(gap) > 1e-6) & (feats[:, :, 0] >= 0)[:, :, None])
            rows = np.repeat(at[:, 2], N_FEATURES)
            cols = feats[at[:, 0], at[:, 1]].ravel()
            g = np.zeros_like(field.weight)
            np.add.at(g, (rows, cols), np.repeat(gap[tuple(at.T)], N_FEATURES))
            used = np.unique(cols)
            square[:, used] += g[:, used] ** 2
            field.weight[:, used] += RATE * g[:, used] / np.sqrt(square[:, used])
            square_follow += change ** 2
            field.follow += RATE * change / np.sqrt(square_follow)
    return field


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Train on about ``sample`` of the texts with a trigger, chosen by a hash of the text; equal texts count once."""
    held = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    marked = held.select("text", F.xxhash64("text").alias("mark"))
    n = marked.agg(F.approx_count_distinct("mark", 0.02)).first()[0]
    share = min(1.0, sample / max(1, n))
    drawn = marked.where(F.pmod("mark", F.lit(1 << 20)) < share * (1 << 20)).groupBy("mark").agg(F.min_by("text", F.length("text")).alias("text"))

    def run(batches):
        for batch in batches:
            marks, pieces, labels = [], [], []
            for mark, text in zip(column(batch, "mark").to_pylist(), column(batch, "text")):
                for piece, spans in examples(text.as_py()):
                    marks.append(mark), pieces.append(piece), labels.append(joined(spans))
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(pieces, pa.string()), pa.array(labels, pa.string())], ["mark", "piece", "spans"])

    # A text gives as many places as it has; a hash keeps a number that grows no further with the sample.
    rows = drawn.mapInArrow(run, "mark long, piece string, spans string").orderBy(F.xxhash64("mark", "piece")).limit(3 * sample).collect()
    cases = [
        (r["piece"], [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)])
        for r in sorted(rows, key=lambda r: (r["mark"], r["piece"], r["spans"]))]
    return learn(cases)


def find(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """What the patterns find, and what the field adds."""
    text = text or ""
    if not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added: list[Span] = []
    for tokens in regions(text):
        # An entity holds a sign; where the patterns have them all, nothing can be added.
        if all(any(s < b and e > a for s, e in taken) for a, b in tokens if SIGN.search(text, a, b)):
            continue
        s = field.scores(lattice(text, tokens))
        path = [seg for seg in field.best(s) if seg[2] != OUTSIDE]
        if not path:
            continue
        chances = field.chances(s)
        for i, j, y in path:
            a, b = bare(text, tokens[i][0], tokens[j - 1][1])
            if chances[j - 1, j - i - 1, y] >= SURE and a < b and not any(lo < b and hi > a for lo, hi in taken):
                added.append((KINDS[y], a, b))
    return base, added


def spans_of(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, base, added`` of every row: arrays of kind, start and end (code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = [find(t.as_py(), shared.value) for t in column(batch, "text")]
            rows = [[[dict(zip(("kind", "start", "end"), s)) for s in f[k]] for f in found] for k in (0, 1)]
            digest = [hashlib.sha256(joined(f[0]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(rows[0], kind), pa.array(rows[1], kind), pa.array(digest), pa.array([joined(f[0] + f[1]) for f in found])],
                ["doc_id", "base", "added", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long>>, "
             "base_sha256 string, spans string")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns; the counts are those of the base spans, n_added counts what the field adds.

    A null text is an empty one. Repeated rows are answered each; an empty table gives an empty table.
    """
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans_of(docs, fit(docs)).select(
        "doc_id", *map(count, KINDS), "base_sha256", "spans", F.size("added").cast("long").alias("n_added"))
