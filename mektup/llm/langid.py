"""Language of a text by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mektup.llm.common import bounded_sample, texts
from mektup.llm.ngrams import codes, hashed

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (1, 2, 3)
    bits: int = 13
    centroids: int = 4
    #: At most about so many texts of each language are clustered; document frequencies take all.
    fit_rows: int = 500
    steps: int = 12
    #: A text is rejected when it is further from its centroid than this share of the language's own texts.
    rejected_share: float = 0.002
    #: How sharply the score tells languages apart by their cosines.
    sharpness: float = 20.0


@dataclass(frozen=True)
class Model:
    settings: Settings
    idf: np.ndarray
    languages: list[str]
    #: Row k belongs to languages[owner[k]]; rows have unit length.
    centroids: np.ndarray
    owner: np.ndarray
    #: Least cosine at which a language is accepted.
    least: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text is near enough to it."""
        if text is None or not len(self.languages) or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        cosines = self.centroids @ vector(text, self.idf, self.settings)
        best = np.full(len(self.languages), -1.0)
        np.maximum.at(best, self.owner, cosines)
        top = int(best.argmax())
        share = 1 / np.exp(self.settings.sharpness * (best - best[top])).sum()
        return self.languages[top], float(share), bool(best[top] >= self.least[top])


_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def letters(points: np.ndarray) -> np.ndarray:
    """The code points with each run of others than letters as one blank; those beyond the basic plane stay."""
    letter = _LETTER[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    plain = np.where(letter, points, np.uint32(32))
    return plain[letter | np.concatenate([[True], letter[:-1]])]


def counts(text: str, s: Settings) -> np.ndarray:
    return np.bincount(hashed(letters(codes(text)), s.sizes, s.bits), minlength=1 << s.bits)


def vector(text: str, idf: np.ndarray, s: Settings) -> np.ndarray:
    """TF-IDF vector of unit length."""
    v = (np.log1p(counts(text, s)) * idf).astype(np.float32)
    norm = float(np.linalg.norm(v))
    return v / norm if norm else v


def cluster(vectors: np.ndarray, k: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first starts: unit centroids, and each row's cosine to its own."""
    chosen = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int((vectors @ vectors[chosen].T).max(axis=1).argmin()))
    centres = vectors[chosen].copy()
    for _ in range(steps):
        nearest = (vectors @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (nearest == j).any():
                mean = vectors[nearest == j].sum(axis=0)
                centres[j] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return centres, (vectors @ centres.T).max(axis=1)


def fit(docs: DataFrame, s: Settings = Settings(), text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Model:
    """Learn from all rows with a language and at least one letter.

    Document frequencies are summed per partition and then by n-gram over all of them; a bounded
    sample of each language is clustered in a task of its own. No rows give a model that always
    answers ``und``.
    """
    width = 1 << s.bits
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(key_col).alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width + 1, dtype=np.int64)  # the last counts texts
        for batch in batches:
            for text in batch.column(0).to_pylist():
                sums[:width] += counts(text, s) > 0
                sums[width] += 1
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(sums[seen])], ["gram", "n"])

    found = rows.select("text").mapInArrow(frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(width + 1)
    df[found["gram"]] = found["n"]
    idf = (np.log((1 + df[width]) / (1 + df[:width])) + 1).astype(np.float32)

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "text"])
        vectors = np.stack([vector(x, idf, s) for x in group["text"]])
        rows_, own = cluster(vectors, s.centroids, s.steps)
        return pd.DataFrame(
            {"lang": group["lang"].iloc[0], "centre": [x.tobytes() for x in rows_], "least": float(np.quantile(own, s.rejected_share))}
        )

    fitted = (
        bounded_sample(rows, "key", s.fit_rows, "lang")
        .groupBy("lang")
        .applyInPandas(centres, "lang string, centre binary, least double")
        .collect()
    )
    fitted.sort(key=lambda x: (x["lang"], bytes(x["centre"])))
    languages = sorted({x["lang"] for x in fitted})
    least = {x["lang"]: x["least"] for x in fitted}
    return Model(
        s,
        idf,
        languages,
        np.array([np.frombuffer(x["centre"], dtype=np.float32) for x in fitted]).reshape(-1, width),
        np.array([languages.index(x["lang"]) for x in fitted], dtype=int),
        np.array([least[x] for x in languages]),
    )


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and accepted of every row, from its whole text alone.

    A null text and one without a letter get ``und`` and score 0. ``accepted`` is false where the
    text is further from the nearest centroid than nearly all texts of that language were.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.predict(x) for x in batch.column(1).to_pylist()]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
