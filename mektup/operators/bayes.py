"""Multinomial naive Bayes over the long TF-IDF table, as plain aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_bayes(weights: DataFrame, truth: DataFrame, n_features: int, alpha: float = 0.1) -> tuple[DataFrame, dict]:
    """Per feature the log weight of every class, and per class its offset terms.

    ``weights`` is (mail_id, category, feature_index, weight), ``truth`` is (mail_id, category).
    The feature table has at most one row per vocabulary term, one column per class.
    """
    counts = {r[0]: r[1] for r in truth.groupBy("category").count().orderBy("category").collect()}
    classes, n = list(counts), sum(counts.values())
    wide = weights.groupBy("feature_index").pivot("category", classes).agg(F.sum("weight"))
    sums = wide.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in classes]).first()
    offsets = {
        c: (math.log(counts[c] / n), math.log((sums[c] or 0.0) + alpha * n_features)) for c in classes
    }
    table = wide.select(
        "feature_index",
        F.array(*[F.log(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) + alpha) for c in classes]).alias("logs"),
    )
    return table, offsets


def score_bayes(weights: DataFrame, mails: DataFrame, table: DataFrame, offsets: dict) -> DataFrame:
    """(mail_id, scores): joint log likelihood of every class, in label order.

    Mails without a known term get the class priors. The feature table is capped by the
    vocabulary, so it is broadcast; a mail's terms lie next to each other, so the partial sums
    leave about one row per mail to shuffle.
    """
    bare = mails.select("mail_id", F.lit(-1).alias("feature_index"), F.lit(0.0).alias("weight"))
    every = weights.select("mail_id", "feature_index", "weight").unionByName(bare)
    joined = every.join(F.broadcast(table), "feature_index", "left")
    parts = joined.groupBy("mail_id").agg(
        F.sum("weight").alias("_total"),
        *[
            F.sum(F.col("weight") * F.coalesce(F.get("logs", F.lit(i)), F.lit(0.0))).alias(f"_s{i}")
            for i in range(len(offsets))
        ],
    )
    return parts.select(
        "mail_id",
        F.array(
            *[
                F.col(f"_s{i}") - F.col("_total") * F.lit(denominator) + F.lit(prior)
                for i, (prior, denominator) in enumerate(offsets.values())
            ]
        ).alias("scores"),
    )
