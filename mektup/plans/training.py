"""Training: features once, then every candidate on the same exact split."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mektup.config import Config
from mektup.functions.grambatch import Weights
from mektup.functions.text import METRIC_NAMES
from mektup.operators import evaluate, prepare
from mektup.operators.split import split_with_folds
from mektup.operators.tfidf import entries_of
from mektup.plans.boosting import BoostedTreesModel, Boosting, fit_boosted
from mektup.plans.calibration import fit_sigmoids
from mektup.plans.margin import Entries, Problems, decisions, fit_machines, gradient_norms
from mektup.plans.scoring import MailModel, with_prediction
from mektup.plans.stages import (
    CalibratedLinearModel,
    DualTfidf,
    DualTfidfModel,
    PopulationScaler,
    TextCleaner,
    TextMetrics,
)
from mektup.session import fresh_path, scratch_scope, written


@dataclass
class TrainingSet:
    """Written feature table (mail_id, category, label, split, fold, tfidf, metrics) and its makers."""

    table: DataFrame
    labels: list[str]
    feature_stages: list[Transformer]
    config: Config
    counts: dict[tuple[int, int], int] = field(default_factory=dict)
    #: What ``table`` is made of when read: its rows with a number each, and occurrences in place of ``tfidf``.
    stored: DataFrame | None = None

    @property
    def train(self) -> DataFrame:
        """Training rows, in as many partitions as the written table has."""
        return self.table.filter(F.col("split") == "train").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.table.filter(F.col("split") == "test").drop("split")

    @property
    def tfidf(self) -> DualTfidfModel:
        return next(s for s in self.feature_stages if isinstance(s, DualTfidfModel))

    def label_counts(self, without_fold: int | None = None) -> list[int]:
        """Training rows per label, optionally without one fold."""
        out = [0] * len(self.labels)
        for (label, fold), n in self.counts.items():
            if fold != without_fold:
                out[label] += n
        return out


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=["tfidf", "metrics"], outputCol="features")


def build_training_set(mails: DataFrame, config: Config = Config()) -> TrainingSet:
    """Clean, split and vectorise ``mails`` (mail_id, category, subject, body).

    The cleaned and measured rows and the feature table are each written once; vocabulary, scaling
    and every model fit then read those tables, and only the feature table stays. It holds
    occurrences, a sixth of what vectors take; they are weighed when read. Vocabulary and scaling see
    training rows only.
    """
    spark = mails.sparkSession
    path = fresh_path(spark, "features")
    with scratch_scope(spark):
        clean = prepare.with_metrics(prepare.clean_mails(mails, config))
        split = split_with_folds(
            written(clean.select("mail_id", "category", "text_clean", *METRIC_NAMES), "clean"),
            config.test_share, config.calibration_folds, config.seed,
        )
        train = split.filter(F.col("split") == "train")
        sizes = train.groupBy("category", "fold").agg(F.count("*").alias("n")).collect()
        labels = sorted({r["category"] for r in sizes})
        tfidf = DualTfidf(config).fit(train)
        scaler = PopulationScaler().fit(train)
        stages = [TextCleaner(config), TextMetrics(), tfidf, scaler]
        counted = scaler.transform(tfidf.fitted.occurrences(split.select("*", label_number(labels)))).select(
            F.monotonically_increasing_id().alias("row"), "mail_id", "category", "label", "split", "fold", "occurrences", "metrics"
        )
        counted.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(counted.schema).parquet(path)
    table = tfidf.fitted.from_occurrences(stored).select(
        "mail_id", "category", "label", "split", "fold", "tfidf", "metrics"
    )
    counts = {(labels.index(r["category"]), r["fold"]): r["n"] for r in sizes}
    return TrainingSet(table, labels, stages, config, counts, stored)


def label_number(labels: list[str]):
    """Position of ``category`` in ``labels``, null for others, marked as nominal for the learners."""
    position = F.array_position(F.array(*[F.lit(label) for label in labels]), F.col("category"))
    number = (F.nullif(position, F.lit(0)) - 1).cast("double")
    return number.alias("label", metadata={"ml_attr": {"type": "nominal", "vals": labels, "name": "label"}})


def balanced(counts: Sequence[int]) -> list[float]:
    """Class weights rows / (classes × rows of the class)."""
    present = [c for c in counts if c]
    return [sum(counts) / (len(present) * c) if c else 0.0 for c in counts]


def _weight_column(weights: Sequence[float]):
    return F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("label").cast("int"))


def fit_bayes(data: TrainingSet) -> list[Transformer]:
    """Multinomial naive Bayes on the TF-IDF block (it takes no negative values)."""
    bayes = NaiveBayes(
        featuresCol="tfidf", labelCol="label", modelType="multinomial", smoothing=data.config.nb_alpha
    )
    return [bayes.fit(data.train)]


def fit_logistic(data: TrainingSet) -> list[Transformer]:
    """Multinomial logistic regression, L2 penalty with C = 1, balanced classes."""
    counts = data.label_counts()
    logistic = LogisticRegression(
        labelCol="label",
        weightCol="weight",
        family="multinomial",
        maxIter=data.config.lr_iterations,
        tol=data.config.tolerance,
        regParam=1.0 / sum(counts),
        elasticNetParam=0.0,
        standardization=False,
    )
    rows = assembler().transform(data.train).withColumn("weight", _weight_column(balanced(counts)))
    return [assembler(), logistic.fit(rows.select("label", "weight", "features"))]


def machine_problems(data: TrainingSet) -> tuple[list[tuple[int, int]], Problems]:
    """Every (fold, class) with the weight of its positive rows and the share of its rarer side."""
    jobs = [(f, k) for f in range(data.config.calibration_folds) for k in range(len(data.labels))]
    counts = [data.label_counts(without_fold=f) for f, _ in jobs]
    return jobs, Problems(
        fold=np.array([f for f, _ in jobs]),
        label=np.array([k for _, k in jobs]),
        weight=np.array([balanced(c)[k] for c, (_, k) in zip(counts, jobs)]),
        smaller_side=np.array(
            [max(min(c[k], sum(c) - c[k]), 1) / sum(c) for c, (_, k) in zip(counts, jobs)]
        ),
    )


def machine_certificate(data: TrainingSet, model: CalibratedLinearModel) -> DataFrame:
    """(fold, category, rows, positives, norm, start, optimal) of every linear machine, recomputed from the long table.

    A machine is optimal when the gradient at its weights is no longer than what the fit had to reach.
    """
    spark = data.table.sparkSession
    jobs, problems = machine_problems(data)
    rows = assembler().transform(data.train).select(
        F.col("mail_id").alias("row"), F.col("label").cast("int").alias("label"), "fold", F.unwrap_udt("features").alias("v")
    )
    index = F.coalesce("v.indices", F.sequence(F.lit(0), F.size("v.values") - 1))
    long = rows.select("row", "label", "fold", F.inline(F.arrays_zip(index.alias("index"), F.col("v.values").alias("value"))))
    weights = spark.createDataFrame(
        [(p["fold"], p["label"], i, float(w)) for p in model.parts for i, w in [*enumerate(p["coefficients"]), (-1, p["intercept"])]],
        "fold int, label int, index int, w double",
    )
    asked = spark.createDataFrame(
        [(f, k, float(w), float(s), data.labels[k]) for (f, k), w, s in zip(jobs, problems.weight, problems.smaller_side)],
        "fold int, label int, weight double, side double, category string",
    )
    norms = gradient_norms(long, weights, asked)
    goal = F.col("start") * F.col("side") * data.config.tolerance
    return norms.join(F.broadcast(asked), ["fold", "label"]).select(
        "fold", "category", "rows", "positives", "norm", "start", (F.col("norm") <= goal * 1.001 + 1e-9).alias("optimal")
    )


def assembled_entries(weights: Weights) -> Entries:
    """Entries of stored rows as the assembler gives them: the features, then the measures."""
    measures = weights.size + np.arange(len(METRIC_NAMES))

    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths, index, value = entries_of(batch.column("occurrences"), weights)
        after = np.repeat(np.cumsum(lengths), len(measures))
        own = batch.column("metrics").flatten().to_numpy(zero_copy_only=False)
        return lengths + len(measures), np.insert(index, after, np.tile(measures, len(lengths))), np.insert(value, after, own)

    return entries


def fit_svm(data: TrainingSet) -> list[Transformer]:
    """Linear one-vs-rest machines per fold, each calibrated on the rows it has not seen.

    Positive rows carry the balanced weight of their class, the rest weigh one.
    """
    config, classes = data.config, len(data.labels)
    rows = data.stored.filter(F.col("split") == "train").select(
        "row", F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"),
        "occurrences", vector_to_array("metrics").alias("metrics"),
    )
    entries = assembled_entries(data.tfidf.fitted.weights())
    jobs, problems = machine_problems(data)
    width = data.tfidf.fitted.size + len(METRIC_NAMES)
    weights, progress = fit_machines(rows, problems, width, config.svm_iterations, config.tolerance, entries)
    if not progress.done.all():
        open_ = [f"fold {f}, {data.labels[k]}" for (f, k), done in zip(jobs, progress.done) if not done]
        warnings.warn(f"linear machines that did not converge: {'; '.join(open_)}", stacklevel=2)
    sigmoids = fit_sigmoids(written(decisions(rows, classes, weights, entries), "decisions"))
    parts = [
        {
            "fold": f,
            "label": k,
            "coefficients": w[:-1].tolist(),
            "intercept": float(w[-1]),
            "slope": sigmoids[f, k][0],
            "offset": sigmoids[f, k][1],
        }
        for (f, k), w in zip(jobs, weights)
    ]
    return [assembler(), CalibratedLinearModel(parts)]


def fit_trees(data: TrainingSet) -> list[Transformer]:
    """Boosted trees with softmax loss on all features, all classes of a round together."""
    config, width = data.config, data.tfidf.fitted.size + len(METRIC_NAMES)
    settings = Boosting(rounds=config.gbt_rounds, depth=config.gbt_depth, bins=config.gbt_bins)
    rows = assembler().transform(data.train).select("label", "features")
    trees, classes = fit_boosted(rows, len(data.labels), width, settings)
    return [assembler(), BoostedTreesModel(trees, classes, width)]


# Candidates in training order; the first wins ties.
CANDIDATES: dict[str, Callable[[TrainingSet], list[Transformer]]] = {
    "Naive Bayes": fit_bayes,
    "Logistic Regression": fit_logistic,
    "Linear SVM": fit_svm,
    "Boosted Trees": fit_trees,
}


@dataclass
class Trained:
    """A fitted candidate with its test predictions and training time."""

    model: MailModel
    predictions: DataFrame
    pairs: DataFrame
    seconds: float


def score_candidates(data: TrainingSet, fitted: dict[str, list[Transformer]]) -> DataFrame:
    """Predictions of all candidates on the test side, one row per mail and candidate.

    The candidates stand side by side in one plan, so the test rows are read once.
    """
    path = fresh_path(data.table.sparkSession, "predictions")
    with scratch_scope(data.table.sparkSession):
        return _scored(data, fitted, path)


def _scored(data: TrainingSet, fitted: dict[str, list[Transformer]], path: str) -> DataFrame:
    # weighed once and written: a candidate's own step in the same task would take a second Python worker
    rows = written(data.test, "test-rows")
    kept = rows.columns
    for i, stages in enumerate(fitted.values()):
        scored = with_prediction(PipelineModel(stages).transform(rows), data.labels)
        rows = scored.select(*kept, F.struct("prediction", "confidence", "probabilities", "top").alias(f"_model_{i}"))
        kept = rows.columns
    each = [
        F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("model"),
            *[F.col(f"_model_{i}.{c}").alias(c) for c in ("prediction", "confidence", "probabilities", "top")],
        )
        for i, name in enumerate(fitted)
    ]
    found = rows.select("mail_id", "category", F.inline(F.array(*each)))
    found.write.parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)


def train_candidates(data: TrainingSet, names: Sequence[str]) -> tuple[dict[str, Trained], DataFrame]:
    """Fit candidates and score them together; also all (ord, model, truth, prediction) counts."""
    fitted, seconds = {}, {}
    for name in names:
        start = time.time()
        fitted[name] = CANDIDATES[name](data)
        seconds[name] = time.time() - start
    predictions = score_candidates(data, fitted)
    pairs = written(evaluate.model_pairs(predictions), "pairs")
    trained = {}
    for name, stages in fitted.items():
        model = MailModel(name, data.labels, PipelineModel(data.feature_stages + stages), data.config)
        own = F.col("model") == name
        trained[name] = Trained(
            model, predictions.filter(own).drop("ord", "model"), pairs.filter(own).drop("ord", "model"), seconds[name]
        )
    return trained, pairs


def train_candidate(data: TrainingSet, name: str) -> Trained:
    """Fit one candidate and score the test side."""
    return train_candidates(data, [name])[0][name]


@dataclass
class Comparison:
    """All candidates, their summary (best first) and the winner."""

    trained: dict[str, Trained]
    summary: DataFrame
    best: Trained

    def reports(self) -> dict[str, DataFrame]:
        out = {
            "model_comparison_metrics": self.summary,
            "best_model_metrics": evaluate.best_model(self.summary).withColumn(
                "created_at", F.current_timestamp()
            ),
            "classification_report": evaluate.classification_report(self.best.pairs),
            "confusion_matrix_raw": evaluate.confusion_pivot(self.best.pairs),
            "confusion_matrix_shares": evaluate.confusion_long(self.best.pairs),
            "confused_pairs": evaluate.confused_pairs(self.best.pairs),
        }
        importance = feature_importance(self.best.model)
        if importance is not None:
            out["feature_importance"] = importance
        return out


def compare_models(
    mails: DataFrame, config: Config = Config(), names: Sequence[str] = tuple(CANDIDATES)
) -> Comparison:
    """Train every candidate on the same split and pick the best macro F1."""
    data = build_training_set(mails, config)
    trained, pairs = train_candidates(data, names)
    summary = evaluate.model_summary(pairs)
    best = evaluate.best_model(summary).first()["model"]
    return Comparison(trained, summary, trained[best])


def feature_importance(model: MailModel, n: int = 20) -> DataFrame | None:
    """The ``n`` TF-IDF features that matter most: mean gains in trees or mean absolute coefficients.

    None for a model that has neither. The vocabulary is capped, so the values fit the driver.
    """
    stages = model.pipeline.stages
    names = next(s for s in stages if isinstance(s, DualTfidfModel)).feature_names
    last = stages[-1]
    if isinstance(last, CalibratedLinearModel):
        values = last.mean_abs_coefficients()
    elif hasattr(last, "coefficientMatrix"):
        values = np.abs(last.coefficientMatrix.toArray()).mean(axis=0)
    elif isinstance(last, BoostedTreesModel):
        values = last.importance()
    else:
        return None
    spark = model.spark
    rows = [(f, float(v)) for f, v in zip(names, values)]
    return (
        spark.createDataFrame(rows, "feature string, importance double")
        .orderBy(F.desc("importance"), "feature")
        .limit(n)
    )
