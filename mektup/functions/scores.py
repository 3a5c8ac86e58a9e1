"""Column expressions over per-class scores and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mektup.functions.text import bind


def softmax(scores: Column) -> Column:
    """Array of probabilities from an array of decision scores."""

    def normalise(exps: Column) -> Column:
        return bind(
            F.aggregate(exps, F.lit(0.0), lambda a, e: a + e),
            lambda total: F.transform(exps, lambda e: e / total),
        )

    def shifted(s: Column) -> Column:
        return bind(F.array_max(s), lambda top: F.transform(s, lambda v: F.exp(v - top)))

    return bind(bind(scores, shifted), normalise)


def argmax_label(probabilities: Column, labels: Column) -> Column:
    """Label of the largest probability; the first one on ties."""
    return F.element_at(
        labels, F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    )


def probability_map(probabilities: Column, labels: Column) -> Column:
    return F.map_from_arrays(labels, probabilities)


def top_classes(probabilities: Column, labels: Column, k: int = 3) -> Column:
    """The ``k`` best classes as array<struct<label, probability>>, label order on ties."""
    ranked = F.array_sort(
        F.transform(
            probabilities,
            lambda p, i: F.struct((-p).alias("key"), i.alias("pos"), p.alias("probability")),
        )
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda r: F.struct(F.get(labels, r["pos"]).alias("label"), r["probability"].alias("probability")),
    )


def top_shares(top: Column) -> Column:
    """Probabilities of ``top`` divided by their sum; zero when the sum is zero."""

    def share(items: Column) -> Column:
        return bind(
            F.aggregate(items, F.lit(0.0), lambda a, i: a + i["probability"]),
            lambda total: F.transform(
                items, lambda i: F.when(total > 0, i["probability"] / total).otherwise(F.lit(0.0))
            ),
        )

    return bind(top, share)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence < 0.5, "low").when(confidence < 0.7, "medium").otherwise("high")


def with_fallback(
    label: Column, confidence: Column, min_confidence: float | None, fallback: str
) -> Column:
    """Replace a label whose confidence is below the threshold."""
    if min_confidence is None:
        return label
    return F.when(confidence < float(min_confidence), F.lit(fallback)).otherwise(label)
