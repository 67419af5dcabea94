"""Language-model scoring by a hidden Markov model (operator 8).

Symbols. Words that make up at least one in ``OWN_SHARE`` of the training tokens are symbols of their own
(so there are at most that many); every other word is one of ``CLASSES`` classes by its last two bytes,
times the word's share in its class, (c + 1) / (N_class + V_class + 1), where one unknown word counts.
The end of a text is a symbol too. So the model gives every text a proper probability.

Training. The rows are turned into symbol numbers once and stored. Each round of Baum-Welch runs scaled
forward and backward recursions over all training texts in their partitions; every partition gives one row
for each expected count, these are summed by number, and only the model's own size reaches the driver.

Counts. Words come as partial counts per batch. Words of at least one in ``COMMON_SHARE`` training tokens
(again at most that many, of at most ``COMMON_BYTES``) are broadcast; the other words of a text are joined
with their counts by key, after the frequent ones, which would be the hot keys, are gone.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.llm.common import LOWERED, column, fold, stored, texts, word_runs

HELD_OUT, FOLDS = 2, 7
STATES = 6
ROUNDS = 3
ROWS = 512  # rows whose words are held at a time
CLASSES = 64
OWN_SHARE = 8_000
COMMON_SHARE = 400_000
COMMON_BYTES = 64
END, FIRST_CLASS = 0, 1
CHUNK = 300_000  # tokens whose recursions are held at a time
SMOOTH = 0.01


def klass(word: bytes) -> int:
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % CLASSES


def words_of(text: bytes | None):
    for run in word_runs((text or b"").translate(LOWERED)):
        yield run


@dataclass
class Vocabulary:
    """``common``: symbol and count of the frequent words; the totals are of the training tokens."""

    common: dict[bytes, tuple[int, int]]
    symbols: int
    tokens: int
    distinct: int
    ends: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def base_norm(self) -> float:
        return float(np.log10(self.tokens + self.distinct + 1)) if self.tokens + self.distinct else 0.0

    @property
    def class_norm(self) -> np.ndarray:
        return np.log10(self.class_tokens + self.class_words + 1)


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c`` over the training rows of ``docs``; words are counted per batch before the shuffle."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in texts(batch):
                for words in words_of(text):
                    counts.update(words)
                if len(counts) > 300_000:
                    yield flush()
        yield flush()

    parts = _docs(docs).where(~F.col("held_out")).select("text").mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("c"))


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The frequent words with the totals, and the stored ``word, c`` of all the others."""
    counts, _ = stored(count_words(docs), "words")
    ends = _docs(docs).where(~F.col("held_out")).count()
    got = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = (got["n"] or 0) + ends, got["v"] + (ends > 0)
    is_common = (F.col("c") * COMMON_SHARE >= tokens) & (F.octet_length("word") <= COMMON_BYTES)
    rows = sorted(counts.where(is_common).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    common, own = {}, FIRST_CLASS + CLASSES
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    code = F.lpad(F.hex(F.substring("word", -2, 2)), 4, "0")  # the last two bytes; 00 for a missing one
    low = F.conv(F.substring(code, 3, 2), 16, 10).cast("int")
    high = F.conv(F.substring(code, 1, 2), 16, 10).cast("int")
    of_class = counts.groupBy(((low * 31 + high) % CLASSES).alias("k")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    for r in of_class:
        class_tokens[r["k"]], class_words[r["k"]] = r["n"], r["v"]
    for r in rows:
        w = bytes(r["word"])
        if r["c"] * OWN_SHARE >= tokens:
            common[w] = (own, r["c"])
            own += 1
            class_tokens[klass(w)] -= r["c"]
            class_words[klass(w)] -= 1
        else:
            common[w] = (FIRST_CLASS + klass(w), r["c"])
    return Vocabulary(common, own, tokens, distinct, ends, class_tokens, class_words), counts.where(~is_common)


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """One row per document: its symbols, what its frequent words add to the scores, its other words.

    ``known`` counts the end and the frequent words; ``base`` and ``inside`` are sums of log10(c + 1) over
    all known tokens and over those of classes, as far as the counts are at hand; ``norm`` is the sum of the
    class totals' logarithms that ``inside`` is to be divided by.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        voc = shared.value
        common, own = voc.common, FIRST_CLASS + CLASSES
        norms = voc.class_norm
        end_log = float(np.log10(voc.ends + 1))
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            cols: dict[str, list] = {k: [] for k in ("seq", "n", "known", "base", "inside", "norm", "rest", "times")}
            for text in texts(batch):
                seq, known, base, inside, norm, total = [], int(voc.ends > 0), end_log, 0.0, 0.0, 1
                rest: Counter[bytes] = Counter()
                for words in words_of(text):
                    total += len(words)
                    at = [common.get(w) for w in words]
                    part = np.fromiter(
                        (a[0] if a else FIRST_CLASS + klass(w) for a, w in zip(at, words)), np.int16, len(words))
                    log = np.log10(np.fromiter((a[1] if a else 0 for a in at), np.float64, len(words)) + 1)
                    classed = part < own
                    known += int(np.count_nonzero(log))
                    base += float(log.sum())
                    inside += float(log[classed].sum())
                    norm += float(norms[part[classed] - FIRST_CLASS].sum())
                    seq.append(part)
                    rest.update(w for a, w in zip(at, words) if a is None)
                seq.append(np.array([END], np.int16))
                for k, v in zip(cols, (np.concatenate(seq).tobytes(), total, known, base, inside, norm, list(rest), list(rest.values()))):
                    cols[k].append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), *(pa.array(v, t) for v, t in zip(cols.values(), kinds))],
                ["doc_id", "held_out", *cols])

    return _docs(docs).mapInArrow(
        run, "doc_id long, held_out boolean, seq binary, n long, known long, base double, inside double, norm double, "
             "rest array<binary>, times array<long>")


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol by state


def first_model(unigram: np.ndarray, states: int = STATES, seed: int = 8) -> Model:
    """States that stay, each with the symbols' shares disturbed at random."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.gamma(1.0, 1.0, (len(unigram), states))
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _layout(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling length, as one row per place: symbols, where each place begins, the order of the texts."""
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    alive = np.bincount(size, minlength=size.max() + 1)[::-1].cumsum()[::-1][1:]  # texts longer than each place
    begin = np.concatenate(([0], np.cumsum(alive)))
    flat = np.concatenate([seqs[i] for i in order])
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size[order]) - size[order], size[order])
    which = np.repeat(np.arange(len(seqs)), size[order])
    out = np.empty(len(flat), dtype=np.int64)
    out[begin[place] + which] = flat
    return out, begin, order


def forward(seqs: list[np.ndarray], model: Model):
    """Scaled forward recursion over all texts side by side: log10 likelihoods, and what backward needs."""
    sym, begin, order = _layout(seqs)
    seen = model.emit[sym]
    alpha, scale = np.empty_like(seen), np.empty(len(sym))
    for t in range(len(begin) - 1):
        lo, hi = begin[t], begin[t + 1]
        a = model.start if t == 0 else alpha[begin[t - 1]:begin[t - 1] + hi - lo] @ model.move
        a = a * seen[lo:hi]
        c = a.sum(axis=1)
        scale[lo:hi] = c
        np.divide(a, c[:, None], out=alpha[lo:hi])
    text = np.arange(len(sym)) - np.repeat(begin[:-1], np.diff(begin))
    logs = np.empty(len(seqs))
    logs[order] = np.bincount(text, np.log10(scale), minlength=len(seqs))
    return logs, sym, begin, seen, alpha, scale


def expected_counts(seqs: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, moves and emissions expected under the model, by scaled forward and backward recursions."""
    _, sym, begin, seen, alpha, scale = forward(seqs, model)
    k = len(model.start)
    moves = np.zeros((k, k))
    after = None
    gamma = alpha  # overwritten from the end
    for t in range(len(begin) - 2, -1, -1):
        lo, hi = begin[t], begin[t + 1]
        beta = np.ones((hi - lo, k))
        if after is not None:
            n = len(after)
            moves += alpha[lo:lo + n].T @ after
            beta[:n] = after @ model.move.T
        after = seen[lo:hi] * beta / scale[lo:hi, None]
        gamma[lo:hi] = alpha[lo:hi] * beta
    emits = np.stack([np.bincount(sym, gamma[:, j], minlength=len(model.emit)) for j in range(k)], axis=1)
    return gamma[:begin[1]].sum(axis=0), moves * model.move, emits


def _chunks(batches):
    """Symbols of the texts of whole batches, about ``CHUNK`` tokens at a time, with their row numbers.

    Texts of like length go together, so that few recursions are as long as the longest text.
    """
    for batch in batches:
        data = column(batch, "seq")
        size = np.array([len(s.as_buffer()) // 2 for s in data], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(np.cumsum(size[order]) // CHUNK)) + 1):
            if len(rows):
                yield batch, rows, [np.frombuffer(data[int(i)].as_buffer(), dtype=np.int16).astype(np.int64) for i in rows]


def train(coded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, states: int = STATES) -> Model:
    """Baum-Welch over all training rows of ``coded``, ``rounds`` times."""
    spark = coded.sparkSession
    unigram = np.zeros(vocab.symbols)
    unigram[END] = vocab.ends + SMOOTH
    unigram[FIRST_CLASS:FIRST_CLASS + CLASSES] = vocab.class_tokens + 1
    for symbol, c in vocab.common.values():
        if symbol >= FIRST_CLASS + CLASSES:
            unigram[symbol] = c
    model = first_model(unigram / unigram.sum(), states)
    used = coded.where(~F.col("held_out")).select("seq")
    size = states + states * states + vocab.symbols * states
    for _ in range(rounds if vocab.ends else 0):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            total, any_row = np.zeros(size), False
            for _, _, seqs in _chunks(batches):
                any_row = True
                s, m, e = expected_counts(seqs, shared.value)
                total += np.concatenate([s, m.ravel(), e.ravel()])
            if any_row:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "x"])

        sums = used.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(size)
        for r in sums:
            flat[r["at"]] = r["x"]
        start, moves, emits = np.split(flat, [states, states + states * states])
        moves = moves.reshape(states, states) + SMOOTH
        emits = emits.reshape(vocab.symbols, states) + SMOOTH * unigram[:, None] / unigram.sum() * states + 1e-9
        start = start + SMOOTH
        model = Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    return model


def score(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    A null text is an empty one: its only token is the end. Repeated rows are scored each; a null doc_id
    counts as the empty text in the choice of the fold. Without training rows every count is 0 and the
    scores are those of an untrained model. An empty table gives an empty table.
    """
    vocab, others = vocabulary(docs)
    coded, _ = stored(encode(docs, vocab).withColumn("id", F.monotonically_increasing_id()), "coded")
    model = train(coded, vocab, rounds, states)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, rows, seqs in _chunks(batches):
            logs, *_ = forward(seqs, shared.value)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id").take(pa.array(rows, pa.int64())), pa.array(logs)], ["id", "chain"])

    chain = coded.select("id", "seq").mapInArrow(run, "id long, chain double")
    rest = (
        coded.select("id", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("id", F.col("r.rest").alias("word"), F.col("r.times").alias("n"))
        .join(others, "word").groupBy("id")
        .agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs")))
    more, logs = F.coalesce("more", F.lit(0).cast("long")), F.coalesce("logs", F.lit(0.0))
    return (
        coded.drop("seq", "rest", "times").join(chain, "id").join(rest, "id", "left")
        .select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + more).alias("n_known"),
                F.lit(vocab.tokens).cast("long").alias("train_tokens"),
                (F.col("base") + logs - F.col("n") * F.lit(vocab.base_norm)).alias("base_score"),
                (F.col("chain") + F.col("inside") + logs - F.col("norm")).alias("score")))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return score(docs)
