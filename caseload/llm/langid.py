"""Language identification by averaged hashed subword embeddings (operator 5).

A text is the average of the embeddings of its hashed character n-grams (of letters, with blanks at word
borders); a linear softmax on the average gives the language. Embeddings and softmax are trained by
stochastic gradient descent in numpy on a bounded sample, up to ``PER_LANG`` rows of each language. One
part of the sample is kept for calibration: a temperature makes the scores probabilities, and the smallest
score whose accepted rows are right often enough becomes the border below which an answer is ``rejected``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.llm.common import column, fold, stored
from caseload.llm.ngrams import hashed

SIZES = (1, 2, 3, 4)
BITS = 12
WIDTH = 16
PER_LANG = 1_000
HELD_OUT, FOLDS = 2, 4
UNKNOWN = "und"
EPOCHS, BATCH, RATE = 30, 64, 0.5
WRONG = 0.01  # share of wrong answers that may be accepted
LETTERS = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> str:
    """Runs of letters in lower case, a blank around each; empty if there is no letter."""
    found = LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {found} " if any(c.isalpha() for c in found) else ""


def shares(text: str | None) -> np.ndarray | None:
    """The share of each bucket among the n-grams of a text; None if it has no letter."""
    plain = normal(text)
    if not plain:
        return None
    counts = np.zeros(1 << BITS)
    for h in hashed(plain, SIZES, BITS):
        counts += np.bincount(h, minlength=1 << BITS)
    return counts / counts.sum()


@dataclass
class Model:
    """``table``: the logits of every bucket (embedding times softmax weights), divided by the temperature."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    border: float

    def predict(self, text: str | None) -> tuple[str, float]:
        x = shares(text)
        if x is None or not self.langs:
            return UNKNOWN, 0.0
        z = x @ self.table + self.bias
        p = np.exp(z - z.max())
        return self.langs[int(z.argmax())], float(p.max() / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], part: np.ndarray, seed: int = 5) -> Model:
    """Fit on the rows where ``part`` is false and calibrate on the others (on all, if these are few)."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    scale = 1 / np.linalg.norm(x, axis=1).mean()  # brings the average embedding to size 1
    emb = rng.normal(0, 1 / np.sqrt(WIDTH), (x.shape[1], WIDTH))
    out, bias = np.zeros((WIDTH, k)), np.zeros(k)
    own = np.flatnonzero(~part) if (~part).any() else np.arange(len(y))
    total, step = EPOCHS * -(-len(own) // BATCH), 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(own), -(-len(own) // BATCH)):
            rate = RATE * (1 - step / total)
            step += 1
            xb = x[at] * scale
            mean = xb @ emb
            gap = (_softmax(mean @ out + bias) - np.eye(k)[y[at]]) / len(at)
            d_out, d_emb = mean.T @ gap, xb.T @ (gap @ out.T)
            out -= rate * d_out
            emb -= rate * d_emb
            bias -= rate * gap.sum(axis=0)
    table = scale * emb @ out
    check = np.flatnonzero(part) if part.sum() >= 2 * k else np.arange(len(y))
    z, want = x[check] @ table + bias, y[check]

    def loss(t: float) -> float:
        p = _softmax(z / t)[np.arange(len(want)), want]
        return -float(np.log(np.maximum(p, 1e-12)).mean())

    heat = min(np.geomspace(0.05, 20, 61).tolist(), key=loss)
    p = _softmax(z / heat)
    top, right = p.max(axis=1), p.argmax(axis=1) == want
    order = np.argsort(-top)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    last = np.append(np.diff(top[order]) < 0, True)  # equal scores are accepted together
    good = np.flatnonzero((wrong <= WRONG) & last)
    border = float(top[order][good[-1]]) if len(good) else 1.0
    return Model(langs, table / heat, bias / heat, border)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from the rows of ``docs`` with a language outside the held-out fold.

    Each language gives about ``per_lang`` rows, chosen by a hash of id and text; their bucket shares come to
    the driver. Without such rows nothing is learned and every answer is ``und``.
    """
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    found = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    mark = F.xxhash64("doc_id", "text", F.lit(5))
    limits = F.create_map(*[F.lit(v) for k, n in sorted(found.items()) for v in (k, min(1.0, per_lang / n))])
    drawn = usable.select("lang", "text", mark.alias("mark")).where(
        F.pmod("mark", F.lit(1 << 20)) < limits[F.col("lang")] * (1 << 20))
    # Equal rows share a hash; one of each is enough, and keeps the sample bounded.
    drawn = drawn.groupBy("lang", "mark").agg(F.min_by("text", F.length("text")).alias("text"))

    def run(batches):
        for batch in batches:
            rows = [shares(t.as_py()) for t in column(batch, "text")]
            keep = pa.array([r is not None for r in rows])
            data = [r.astype(np.float32).tobytes() for r in rows if r is not None]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "lang").filter(keep), column(batch, "mark").filter(keep), pa.array(data, pa.binary())], ["lang", "mark", "x"])

    made, _ = stored(drawn.mapInArrow(run, "lang string, mark long, x binary"), "langid")
    rows = made.toPandas().sort_values(["lang", "mark"])
    if rows.empty:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    langs = sorted(set(rows["lang"]))
    x = np.frombuffer(b"".join(map(bytes, rows["x"])), dtype=np.float32).reshape(len(rows), -1)
    y = rows["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy()
    # By rank of the hash, so that every language keeps training rows; its first four are such.
    return train(x, y, langs, rows.groupby("lang").cumcount().to_numpy() % 5 == 4)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row, from the whole text alone.

    ``und`` with score 0 for a null text and a text without letters, and if the model knows no language;
    these are rejected. Other texts get the likeliest language, rejected if its score is below the border.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[0] == UNKNOWN or g[1] < shared.value.border for g in got], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns and ``rejected``. Repeated rows are answered each; an empty table gives an empty one."""
    return identify(docs, fit(docs)).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
