"""Toxicity by a linear classifier on character n-grams scaled with naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mektup.llm.common import bounded_sample, small_first, texts
from mektup.llm.ngrams import codes, hashed


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 19
    #: N-grams in fewer labelled texts are not features.
    min_texts: int = 5
    #: At most about so many labelled rows of each class fit the weights; the counts take all.
    fit_rows: int = 1500
    l1: float = 1e-3
    rounds: int = 6
    steps: int = 30
    smoothing: float = 1.0


@dataclass(frozen=True)
class Model:
    """Weight of each hashed n-gram, the log-count ratio multiplied in, and the constant."""

    settings: Settings
    weights: np.ndarray
    constant: float

    def score(self, text: str) -> float:
        points = hashed(codes(text), self.settings.sizes, self.settings.bits)
        found = np.unique(points[self.weights[points] != 0])
        total = self.constant + float(self.weights[found].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-total))) if total > -700 else 0.0


def _present(text: str, s: Settings, flags: np.ndarray) -> np.ndarray:
    """Rising numbers of the n-grams a text holds."""
    flags[hashed(codes(text), s.sizes, s.bits)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found.astype(np.int32)


def ratios(positive: np.ndarray, negative: np.ndarray, s: Settings) -> np.ndarray:
    """Log of the ratio of an n-gram's smoothed shares in class 1 and class 0; 0 for n-grams of too few texts."""
    often = positive + negative >= s.min_texts
    p, q = (positive + s.smoothing) * often, (negative + s.smoothing) * often
    r = np.zeros(len(p))
    r[often] = np.log(p[often] / p.sum()) - np.log(q[often] / q.sum())
    return r


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, r: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty on the scaled indicators, both classes with equal weight in all.

    Proximal steps with momentum run on the n-grams that are in use or whose gradient exceeds the
    penalty; after each round the gradient of all n-grams is looked at again.
    """
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    sign = np.where(labels == 1, 1.0, -1.0)
    grams = np.unique(np.concatenate(rows)) if rows else np.zeros(0, dtype=np.int32)
    grams = grams[r[grams] != 0]
    place = np.full(len(r), -1, dtype=np.int32)
    place[grams] = np.arange(len(grams))
    column = place[np.concatenate(rows)] if rows else place[:0]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in rows])
    column, row = column[column >= 0], row[column >= 0]
    scale = r[grams]
    w, b = np.zeros(len(grams)), 0.0

    def loss(m: np.ndarray) -> float:
        return float((share * np.logaddexp(0, -sign * m)).sum())

    def slope(m: np.ndarray) -> np.ndarray:
        return share * (1 / (1 + np.exp(-m)) - labels)

    margin = np.zeros(len(labels))
    for _ in range(s.rounds):
        gradient = np.bincount(column, weights=slope(margin)[row], minlength=len(grams)) * scale
        active = np.flatnonzero((w != 0) | (np.abs(gradient) > s.l1))
        number = np.full(len(grams), -1, dtype=np.int32)
        number[active] = np.arange(len(active))
        used = number[column]
        ac, ar = used[used >= 0], row[used >= 0]
        values = scale[active][ac]

        def margins(v: np.ndarray, b: float) -> np.ndarray:
            return np.bincount(ar, weights=v[ac] * values, minlength=len(labels)) + b

        squares = np.bincount(ar, weights=values**2, minlength=len(labels)) + 1
        bound = max(0.25 * float((share * squares).sum()) / 16, 1e-9)
        v = w[active]
        z, zb, t = v, b, 1.0
        for _ in range(s.steps):
            m = margins(z, zb)
            value, g = loss(m), slope(m)
            gv, gb = np.bincount(ac, weights=g[ar] * values, minlength=len(active)), float(g.sum())
            while True:
                moved = z - gv / bound
                new = np.sign(moved) * np.maximum(0, np.abs(moved) - s.l1 / bound)
                new_b = zb - gb / bound
                margin = margins(new, new_b)
                step, step_b = new - z, new_b - zb
                if loss(margin) <= value + gv @ step + gb * step_b + bound / 2 * (step @ step + step_b**2) + 1e-12:
                    break
                bound *= 2
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, zb = new + (t - 1) / nt * (new - v), new_b + (t - 1) / nt * (new_b - b)
            v, b, t = new, new_b, nt
        w[active] = v
    weights = np.zeros(len(r))
    weights[grams] = w
    return weights, b


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from the documents that ``labels`` (doc_id, label) names with 0 or 1.

    N-gram counts of both classes come from all labelled documents, summed per partition and then
    by n-gram; only the weights are fitted on a bounded sample of rows. Null labels and ids are
    left out; a class without rows gives a model that scores 0.5 throughout. A document with
    several labels takes part with each.
    """
    width = 1 << s.bits
    known = labels.where(F.col("label").isin(0, 1)).select(F.col("doc_id").alias("doc_id"), F.col("label").cast("int").alias("label"))
    plain = texts(docs, id_col, text_col)
    rows = small_first(plain, known, "doc_id", "inner").select("label", "text")
    # Few rows by its setting, so the sample of labels is broadcast and texts stay where they are.
    sampled = plain.join(F.broadcast(bounded_sample(known, "doc_id", s.fit_rows, "label")), "doc_id").select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, sums = np.zeros(width, dtype=bool), np.zeros((2, width), dtype=np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[label, _present(text, s, flags)] += 1
        seen = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(sums[1, seen]), pa.array(sums[0, seen])], ["gram", "positive", "negative"]
        )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(width, dtype=bool)
        for batch in batches:
            found = [_present(x, s, flags).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["label", "grams"])

    counted = (
        rows.mapInArrow(count, "gram int, positive long, negative long")
        .groupBy("gram")
        .agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
        .where(F.col("positive") + F.col("negative") >= s.min_texts)
        .toPandas()
    )
    positive, negative = np.zeros(width), np.zeros(width)
    positive[counted["gram"]], negative[counted["gram"]] = counted["positive"], counted["negative"]
    r = ratios(positive, negative, s)
    held = docs.sparkSession.sparkContext.broadcast(r)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        sample.sort()
        y = np.array([label for label, _ in sample], dtype=float)
        if len(y) and y.min() < y.max():
            w, b = fit_weights([np.frombuffer(x, dtype=np.int32) for _, x in sample], y, held.value, s)
            found = (w * held.value).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary()), pa.array([b], pa.float64())], ["weights", "constant"])

    # The bounded sample meets in one task, where there is more room than in the driver.
    sample = sampled.mapInArrow(features, "label int, grams binary")
    fitted = sample.repartition(1).mapInArrow(weigh, "weights binary, constant double").collect()
    if not fitted:
        return Model(s, np.zeros(width, dtype=np.float32), 0.0)
    return Model(s, np.frombuffer(fitted[0]["weights"], dtype=np.float32), fitted[0]["constant"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its whole text alone; null texts count as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
