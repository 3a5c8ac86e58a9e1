"""Text quality by a sparse rule ensemble: tree paths as rules, lasso weights, Spark column expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mektup.llm.common import KEY, keyed_texts, rows_without
from mektup.session import written

STATISTICS = (
    "chars", "words", "lines", "word_length", "letters", "capitals", "digits", "marks", "symbols", "symbol_runs",
    "distinct_words", "top_word", "doubled_words", "repeated_lines", "line_words", "long_words", "sentence_words",
)

#: A condition of a rule: statistic, whether it must be above, and the threshold.
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class Settings:
    trees: int = 24
    depth: int = 3
    penalty: float = 0.002
    seed: int = 11
    iterations: int = 60


@dataclass(frozen=True)
class Model:
    """Rules with the weights that the lasso left, and the constant."""

    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    constant: float

    def score(self) -> Column:
        """Probability of class 1, as one expression over the statistics' columns."""
        total = F.lit(self.constant)
        for conditions, weight in self.rules:
            total = total + F.when(_all(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _all(conditions: tuple[Condition, ...]) -> Column:
    result = F.lit(True)
    for name, above, threshold in conditions:
        result = result & (F.col(name) > F.lit(threshold) if above else F.col(name) <= F.lit(threshold))
    return result


_SPACE, _LETTER, _CAPITAL, _DIGIT, _MARK, _SYMBOL = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    """Bits of each code point of the basic plane; higher ones count as letters."""
    table = np.zeros(0x10000, dtype=np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c.isspace():
            table[i] = _SPACE
        elif c.isalpha():
            table[i] = _LETTER | (_CAPITAL if c.isupper() else 0)
        elif c.isdigit():
            table[i] = _DIGIT
        elif c in ".,;:!?'\"()-":
            table[i] = _MARK
        else:
            table[i] = _SYMBOL
    return table


_TABLE: list[np.ndarray] = []


def measure(text: str) -> tuple[float, ...]:
    """The statistics of one text, in the order of STATISTICS; an empty text has zeros."""
    if not _TABLE:
        _TABLE.append(_classes())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = _TABLE[0][np.minimum(points, 0xFFFF)] if len(points) else np.zeros(0, dtype=np.uint8)
    kinds = np.where(points > 0xFFFF, np.uint8(_LETTER), kinds)
    n = max(1, len(points))
    seen = max(1, int((kinds != _SPACE).sum()))
    symbol = (kinds & _SYMBOL) > 0
    words = text.split()
    counted = Counter(words)
    lines = text.split("\n")
    total = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    sentences = sum(map(text.count, ".!?"))
    return (
        float(len(points)),
        float(len(words)),
        float(len(lines)) if text else 0.0,
        float(lengths.mean()) if words else 0.0,
        float(((kinds & _LETTER) > 0).sum()) / seen,
        float(((kinds & _CAPITAL) > 0).sum()) / seen,
        float(((kinds & _DIGIT) > 0).sum()) / seen,
        float(((kinds & _MARK) > 0).sum()) / seen,
        float(symbol.sum()) / seen,
        float((symbol[1:] & (points[1:] == points[:-1])).sum()) / n,
        len(counted) / total,
        max(counted.values(), default=0) / total,
        sum(map(str.__eq__, words, words[1:])) / total,
        1 - len(set(lines)) / len(lines),
        len(words) / max(1, len(lines)),
        float((lengths > 12).sum()) / total,
        len(words) / (sentences + 1),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (`row_key`) and the statistics of every row's whole text.

    A null text counts as empty; rows that repeat count each; very long texts are measured whole;
    an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(x) for x in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(rows[:, k]) for k in range(len(STATISTICS)))], ["doc_id", "key", *STATISTICS]
            )

    schema = f"doc_id long, key {KEY}, " + ", ".join(f"{x} double" for x in STATISTICS)
    return keyed_texts(docs, id_col, text_col).mapInArrow(run, schema)


def tree_rules(debug: str) -> list[tuple[Condition, ...]]:
    """Every path from a root to an inner node or leaf of a forest's description, as a conjunction.

    The description indents a root by four blanks and each level below by one more.
    Conditions on one statistic and side are merged into the tightest; equal rules appear once.
    """
    found: dict[tuple[Condition, ...], None] = {}
    path: list[Condition] = []
    for line in debug.splitlines():
        match = re.match(r"( +)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if line.lstrip().startswith("Tree"):
            path = []
        elif match:
            path = path[: len(match[1]) - 4] + [(STATISTICS[int(match[3])], match[4] == ">", float(match[5]))]
            tightest: dict[tuple[str, bool], float] = {}
            for name, above, threshold in path:
                old = tightest.get((name, above))
                tightest[name, above] = threshold if old is None else (max if above else min)(old, threshold)
            found[tuple((name, above, t) for (name, above), t in sorted(tightest.items()))] = None
    return list(found)


def fit(measured: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from the measured documents that ``labels`` (doc_id, label) names with 0 or 1.

    A random forest of shallow trees finds the rules and a lasso logistic regression weighs them,
    both by Spark on all labelled rows with classes weighted alike; the driver sees trees and
    weights only. Null labels and ids are left out. With one class or none the score is constant:
    the share of class 1 among labels, or 0.5.
    """
    known = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("double").alias("label"))
    rows = measured.join(known, "doc_id").select("label", *STATISTICS)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        share = sizes.get(1.0, 0) / sum(sizes.values()) if sizes else 0.5
        return Model((), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    weight = F.when(F.col("label") == 1, 0.5 / sizes[1.0]).otherwise(0.5 / sizes[0.0]) * sum(sizes.values())
    train = written(
        VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows.withColumn("weight", weight)),
        "quality-rows",
    )
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=s.trees, maxDepth=s.depth, seed=s.seed,
        subsamplingRate=0.7, minInstancesPerNode=5,
    ).fit(train)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return Model((), float(np.log(sizes[1.0] / sizes[0.0])))
    held = [_all(r).cast("double").alias(f"rule{k}") for k, r in enumerate(rules)]
    fired = VectorAssembler(inputCols=[f"rule{k}" for k in range(len(rules))], outputCol="rules").transform(
        train.select("label", "weight", *held)
    )
    lasso = LogisticRegression(
        featuresCol="rules", labelCol="label", weightCol="weight", elasticNetParam=1.0, regParam=s.penalty,
        maxIter=s.iterations, standardization=False,
    ).fit(fired.select("label", "weight", "rules"))
    weights = lasso.coefficients.toArray()
    # Back from equal classes to half way to the shares met, so that clean documents are not lost to a strict cut.
    shift = 0.5 * float(np.log(sizes[1.0] / sizes[0.0]))
    chosen = tuple((r, float(w)) for r, w in zip(rules, weights) if w)
    return Model(chosen, float(lasso.intercept) + shift)


def score(measured: DataFrame, model: Model) -> DataFrame:
    """doc_id, key and score (0 to 1) of every measured row; rows that repeat get the same score each."""
    return measured.select("doc_id", "key", model.score().alias("score"))


def drop_low(docs: DataFrame, scores: DataFrame, cut: float) -> DataFrame:
    """The rows of ``docs``, all columns, that ``scores`` (key, score) does not place below ``cut``.

    Rows are judged by id and text together, those without an id by their text.
    """
    low = written(scores.where(F.col("score") < cut).select("key").distinct(), "rejected")
    return rows_without(docs, low)
