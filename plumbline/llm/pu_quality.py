"""Text quality by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import held_out, slices

POSITIVES = 6000  # trusted positives the classifier is fitted on, about
UNLABELLED = 12000  # unlabelled texts it is fitted on, about
HIDDEN = 24
STEPS = 1500
BATCH = 512
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str) -> list[float]:
    """Length, word shape, repetition and character statistics of a whole text; zeros for an empty one."""
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    n, m = max(len(text), 1), max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen: dict[str, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256) / n
    marks = [float(raw[ord(c)]) for c in MARKS]
    top = max(seen.values(), default=0) / m
    lowered = [w for w in words if w.islower()]
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), lengths.max() ** 0.5,
        float((lengths <= 3).mean()), float((lengths >= 12).mean()), len(seen) / m, len(seen) / m ** 0.8, top,
        1 - len(set(lines)) / max(len(lines), 1), np.log1p(m / max(len(lines), 1)), len(lowered) / m,
        float(raw[65:91].sum()), float(raw[97:123].sum()), float(raw[48:58].sum()), float(raw[128:].sum()), float(raw[:32].sum()), float(raw[32]),
        sum(marks), *np.sqrt(marks),
    ]


class Scorer:
    """A small network on standardised features; ``score`` is the probability of quality."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: list[np.ndarray]) -> None:
        self.mean, self.spread, self.weights = mean, spread, weights

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights[0] + self.weights[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.hidden(x) @ self.weights[2] + self.weights[3], -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 3) -> Scorer:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss (Kiryo et al., 2017).

    While the estimate of the negative risk is below zero, a step goes back up that part alone, which
    keeps the network from fitting unlabelled positives as negatives.
    """
    rng = np.random.default_rng(seed)
    every = np.vstack([positive, unlabelled])
    mean, spread = every.mean(axis=0), every.std(axis=0) + 1e-6
    d = every.shape[1]
    model = Scorer(mean, spread, [rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)])
    first, second = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
    for step in range(1, STEPS + 1):
        xp, xu = positive[rng.integers(len(positive), size=BATCH)], unlabelled[rng.integers(len(unlabelled), size=BATCH)]
        sp, su = model.score(xp), model.score(xu)
        below = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean() < 0
        # slopes of the loss by the output: label +1 gives s - 1, label -1 gives s
        gp = (prior * sp if below else prior * (sp - 1) - prior * sp) / BATCH
        gu = (-su if below else su) / BATCH
        x, g = np.vstack([xp, xu]), np.concatenate([gp, gu])
        h = model.hidden(x)
        inner = np.outer(g, model.weights[2]) * (1 - h * h)
        z = np.clip((x - mean) / spread, -6, 6)
        slopes = [z.T @ inner + 1e-4 * model.weights[0], inner.sum(axis=0), h.T @ g + 1e-4 * model.weights[2], np.array([g.sum()])]
        for i, slope in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope * slope
            model.weights[i] -= 0.01 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Scorer | None:
    """Fit on about ``positives`` labelled good texts and ``unlabelled`` texts whose labels are not looked at.

    Only rows that are not held out take part.  The class prior is the share of good ones among all
    their labels.  Samples are drawn by a hash of the id, so the driver holds a bounded table of
    features.  None when there is no positive label.
    """
    known = labels.select("doc_id", "quality").where(~held_out() & F.col("quality").isNotNull())
    good, all_ = known.agg(F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0)), F.count("*")).first()
    open_docs = docs.select("doc_id", "text").where(~held_out())
    count = open_docs.count()
    if not good or not count:
        return None

    def draw(salt: str, most: int, n: int):
        return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1_000_000)) < min(1_000_000, most * 1_000_000 // n + 1)

    trusted = known.where((F.col("quality") == 1) & draw("positive", positives, good)).select("doc_id").distinct().withColumn("trusted", F.lit(True))
    sample = open_docs.join(F.broadcast(trusted), "doc_id", "left").where(  # at most about ``positives`` ids
        F.col("trusted") | draw("unlabelled", unlabelled, count)).select(
        "text", F.coalesce("trusted", F.lit(False)).alias("trusted"), draw("unlabelled", unlabelled, count).alias("free"))

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("trusted"), batch.column("free")],
                                             names=["x", "trusted", "free"])

    drawn = sample.mapInArrow(table, "x array<double>, trusted boolean, free boolean").toArrow()
    x = np.array(drawn["x"].to_pylist(), dtype=np.float64).reshape(drawn.num_rows, -1)
    p, u = drawn["trusted"].to_numpy(), drawn["free"].to_numpy()
    return fit_nnpu(x[p], x[u], good / all_) if p.any() and u.any() else None


def scored(docs: DataFrame, model: Scorer | None) -> DataFrame:
    """doc_id and score of every row, judged by its whole text alone; 0.5 when nothing was learned."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t or "") for t in batch.column("text").to_pylist()], dtype=np.float64)
            score = np.full(len(x), 0.5) if model is None or not len(x) else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(judge, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")
