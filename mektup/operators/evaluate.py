"""Classification quality as tables.

Everything starts from the counts of (truth, prediction) pairs, one aggregation over the scored
rows; all later steps work on that table, which has at most one row per pair of labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMMARY_ROWS = ("accuracy", "macro avg", "weighted avg")


def pair_counts(scored: DataFrame, truth: str = "category", prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def model_pairs(scored: DataFrame, truth: str = "category") -> DataFrame:
    """(ord, model, truth, prediction, n) of rows that hold the predictions of several models.

    ``scored`` has ord, model and prediction, one row per model and mail; all models are counted
    in the same aggregation.
    """
    return scored.groupBy("ord", "model", F.col(truth).alias("truth"), "prediction").agg(F.count("*").alias("n"))


def class_scores(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label seen as truth or as prediction, for each value of ``by``."""
    sides = pairs.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("truth").alias("label"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("truth") == F.col("prediction"), F.col("n"))
                    .otherwise(0)
                    .alias("hits"),
                ),
                F.struct(
                    F.col("prediction").alias("label"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("hits"),
                ),
            )
        ),
    )
    totals = sides.groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    return totals.select(
        *by,
        "label",
        _rate(F.col("hits"), F.col("predicted")).alias("precision"),
        _rate(F.col("hits"), F.col("support")).alias("recall"),
        _rate(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )


def _averages(weight: Column | None) -> list[Column]:
    if weight is None:
        return [F.avg(m) for m in ("precision", "recall", "f1")]
    return [F.sum(F.col(m) * weight) / F.sum(weight) for m in ("precision", "recall", "f1")]


def macro_scores(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro precision, recall and F1; one row, or one for each value of ``by``."""
    precision, recall, f1 = _averages(None)
    return class_scores(pairs, by).groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        f1.alias("f1_macro"),
        precision.alias("precision_macro"),
        recall.alias("recall_macro"),
    )


def classification_report(pairs: DataFrame) -> DataFrame:
    """Per-class rows in label order, then accuracy, macro average and weighted average.

    The accuracy row holds the accuracy in all four columns.
    """
    def row(label: Column, values: Sequence[Column], support: Column) -> Column:
        names = ("precision", "recall", "f1", "support")
        return F.struct(
            label.alias("label"), *[v.cast("double").alias(n) for n, v in zip(names, [*values, support])]
        )

    one = row(F.col("label"), [F.col("precision"), F.col("recall"), F.col("f1")], F.col("support"))
    accuracy = F.sum("hits") / F.sum("support")
    # One entry per label is gathered here.
    report = class_scores(pairs).agg(
        F.array_sort(F.collect_list(one)).alias("classes"),
        F.array(
            row(F.lit("accuracy"), [accuracy] * 3, accuracy),
            row(F.lit("macro avg"), _averages(None), F.sum("support")),
            row(F.lit("weighted avg"), _averages(F.col("support")), F.sum("support")),
        ).alias("summary"),
    )
    return report.select(F.posexplode(F.concat("classes", "summary")).alias("ord", "_r")).select(
        "ord", "_r.*"
    )


def class_f1_rank(pairs: DataFrame) -> DataFrame:
    """Per-class F1, best first, without the summary rows."""
    return class_scores(pairs).select("label", "f1").orderBy(F.desc("f1"), "label")


def confusion_long(pairs: DataFrame) -> DataFrame:
    """(truth, prediction, n, share) for every pair of labels, zeros included.

    ``share`` is the part of the true class; it is zero for a label without true rows.
    """
    # One row that holds the label list is unfolded twice; labels and counts are then summed.
    seen = pairs.select(F.explode(F.array("truth", "prediction")).alias("label")).agg(
        F.array_sort(F.collect_set("label")).alias("labels")
    )
    grid = seen.select("labels", F.explode("labels").alias("truth")).select(
        "truth", F.explode("labels").alias("prediction"), F.lit(0).cast("long").alias("n")
    )
    dense = grid.unionByName(pairs).groupBy("truth", "prediction").agg(F.sum("n").alias("n"))
    of_truth = F.sum("n").over(Window.partitionBy("truth"))
    return dense.withColumn("share", _rate(F.col("n"), of_truth))


def confusion_pivot(pairs: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Confusion matrix: one row per true label, one column per predicted label, both sorted."""
    dense = confusion_long(pairs)
    if labels is None:
        labels = sorted(r[0] for r in dense.select("truth").distinct().collect())
    return dense.groupBy("truth").pivot("prediction", list(labels)).agg(F.sum("n")).orderBy("truth")


def confused_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent wrong (truth, prediction) pairs with their share of the true class."""
    of_truth = F.sum("n").over(Window.partitionBy("truth"))
    return (
        pairs.withColumn("rate", F.col("n") / of_truth)
        .filter((F.col("truth") != F.col("prediction")) & (F.col("n") > 0))
        .orderBy(F.desc("n"), "truth", "prediction")
        .limit(n)
    )


def model_summary(pairs: DataFrame) -> DataFrame:
    """One row per model (name, position, four scores), best macro F1 first, from `model_pairs`."""
    return macro_scores(pairs, ["ord", "model"]).orderBy(F.desc("f1_macro"), "ord")


def best_model(summary: DataFrame) -> DataFrame:
    """Row with the highest macro F1; the earliest on ties."""
    return summary.orderBy(F.desc("f1_macro"), "ord").limit(1)


def expectation_check(scored: DataFrame, expected: str = "expected", k: int = 3) -> DataFrame:
    """Per curated example: hit or miss, confidence and the runner-up classes."""
    return scored.select(
        "*",
        (F.col("prediction") == F.col(expected)).alias("hit"),
        F.slice("top", 2, k - 1).alias("runners_up"),
    )


def write_reports(path: str, report: "dict[str, DataFrame]") -> None:
    """Write every evaluation table as CSV and as JSON below ``path``.

    These tables have a bounded number of rows (labels, label pairs, models, top features).
    """
    for name, table in report.items():
        small = table.coalesce(1)
        small.write.mode("overwrite").csv(f"{path}/{name}.csv", header=True)
        small.write.mode("overwrite").json(f"{path}/{name}.json")
