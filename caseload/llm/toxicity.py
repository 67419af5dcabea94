"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes ratios (operator 10).

Features are the different hashed character n-grams of a whole text. On a bounded sample of labelled rows
the documents of either class that hold a bucket are counted; the log-count ratio of a bucket scales its
feature, the buckets whose ratios are the most certain are kept, and a logistic regression is trained on
them. Each class is sampled up to ``PER_CLASS`` rows; the classes weigh as they do among all labels, so a
score is a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.llm.common import column, fold, stored
from caseload.llm.ngrams import hashed

SIZES = (3, 4, 5, 6)
BITS = 20
PER_CLASS = 6_000
FEATURES = 4_096
HELD_OUT, FOLDS = 2, 4
REJECT = 0.3
STEPS = 150
ALPHA = 1.0
PENALTY = 1e-4


def normal(text: str | None) -> str:
    return f" {' '.join((text or '').lower().split())} "


def buckets(text: str | None) -> np.ndarray:
    """The different buckets of a text, ascending."""
    seen = np.zeros(1 << BITS, dtype=bool)
    for h in hashed(normal(text), SIZES, BITS):
        seen[h] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """``place``: feature of each bucket, ``len(weight) - 1`` for none, whose weight is 0."""

    place: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        seen = np.zeros(len(self.weight), dtype=bool)
        for h in hashed(normal(text), SIZES, BITS):
            seen[self.place[h]] = True
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[seen].sum(), -30, 30))))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """``toxic, text`` of about ``per_class`` labelled rows of each class, chosen by a hash of the id, and the
    number of labels of each class.

    Only ids outside the held-out fold count, and labels 0 and 1. An id with several labels has the highest;
    an id with several texts gives the one with the smallest hash. The chosen ids are at most a little more
    than twice ``per_class``, so they are broadcast.
    """
    votes = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic")))
    votes, _ = stored(votes, "toxic-labels")
    found = {r["toxic"]: r["n"] for r in votes.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for kind, n in found.items():
        share = F.when(F.col("toxic") == kind, F.lit(min(1.0, per_class / n))).otherwise(share)
    drawn = votes.where(F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 20)) < share * (1 << 20))
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
        .join(F.broadcast(drawn), "id").groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    sample, _ = stored(texts.select("toxic", "text"), "toxic-sample")
    return sample, found


def _chosen(sample: DataFrame, texts: dict[int, int], features: int) -> list:
    """The buckets ``b`` with the most certain log-count ratios (``ratio``), at most ``features`` of them."""

    def run(batches):
        counts = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            for kind, text in zip(column(batch, "toxic").to_pylist(), column(batch, "text")):
                counts[kind, buckets(text.as_py())] += 1
        at = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(at), 65_536):
            a = at[i:i + 65_536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(counts[0, a], pa.int64()), pa.array(counts[1, a], pa.int64())], ["b", "n0", "n1"])

    p, q = F.col("n1") + ALPHA, F.col("n0") + ALPHA
    ratio = F.ln(p / (texts[1] + 2 * ALPHA)) - F.ln(q / (texts[0] + 2 * ALPHA))
    return (
        sample.mapInArrow(run, "b long, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where("n0 + n1 >= 2").select("b", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / p + 1 / q)).alias("sure"))
        .where("sure > 0").orderBy(F.col("sure").desc(), "b").limit(features).collect())


def _rows(sample: DataFrame, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, features and row borders of the sampled texts."""
    shared = sample.sparkSession.sparkContext.broadcast(place)
    none = int(place.max())

    def run(batches):
        for batch in batches:
            found = []
            for text in column(batch, "text"):
                f = np.unique(shared.value[buckets(text.as_py())])
                found.append(f[f < none].astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "toxic"), pa.array(found, pa.binary())], ["toxic", "f"])

    got = sorted((r["toxic"], bytes(r["f"])) for r in sample.mapInArrow(run, "toxic int, f binary").collect())
    parts = [np.frombuffer(f, dtype=np.int16) for _, f in got]
    ends = np.cumsum([0, *map(len, parts)])
    return np.array([k for k, _ in got], dtype=np.float64), np.concatenate([np.empty(0, np.int16), *parts]), ends


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES, steps: int = STEPS) -> Model:
    """Train on the labelled rows of ``docs`` outside the held-out fold.

    Without rows of both classes nothing can be learned: every score is then the (smoothed) share of toxic
    labels.
    """
    sample, found = labelled_sample(docs, labels, per_class)
    prior = (found.get(1, 0) + 0.5) / (sum(found.values()) + 1.0)
    texts = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    chosen = sorted(_chosen(sample, texts, features), key=lambda r: r["b"])
    kept, ratio = np.array([r["b"] for r in chosen], dtype=np.int64), np.array([r["ratio"] for r in chosen])
    place = np.full(1 << BITS, len(kept), dtype=np.int16)
    place[kept] = np.arange(len(kept))
    bias = float(np.log(prior / (1 - prior)))
    weight = np.zeros(len(kept) + 1)
    if len(found) == 2 and len(kept):
        y, f, ends = _rows(sample, place)
        r = ratio
        share = np.where(y == 1, prior / max(1, texts[1]), (1 - prior) / max(1, texts[0]))
        row = np.repeat(np.arange(len(y)), np.diff(ends))
        w, b = np.zeros(len(kept)), bias
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, steps + 1):
            z = b + np.bincount(row, (w * r)[f], minlength=len(y))
            e = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            g, gb = r * np.bincount(f, e[row], minlength=len(w)) + PENALTY * w, e.sum()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w = w - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
            b -= 0.05 * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-8)
        weight[:-1], bias = w * r, float(b)
    return Model(place, weight, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` packed as ``row`` with ``score``, the probability of label 1. A null text is an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"), F.lit(0.0).alias("score"))

    def run(batches):
        for batch in batches:
            got = pa.array([shared.value.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), got], ["row", "text", "score"])

    return packed.mapInArrow(run, packed.schema).drop("text")


def clean(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose score is below ``reject``, all columns kept."""
    return score(docs, fit(docs, labels)).where(F.col("score") < reject).select("row.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns. Repeated rows are scored each; an empty table gives an empty table."""
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(light, fit(docs, labels))
    return scored.select(
        "row.doc_id", (fold(F.col("row.doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"))
