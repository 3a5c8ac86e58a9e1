"""Keeping a labelled data set in order: repeats, quotas, confusable categories, keywords."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mektup.config import CATEGORIES, CATEGORY_HINTS, CONFUSABLE_PAIRS, Config
from mektup.functions.text import METRIC_NAMES, lower_text
from mektup.operators.prepare import keeps
from mektup.session import lookup_join, written

KEYS = ("subject", "body")


#: Groups with several rows whose narrow records may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 500_000


def _digests(keys: Sequence[str]) -> tuple[Column, Column]:
    """Two independent hashes of the key columns; nulls equal each other and nothing else."""
    parts = [x for k in keys for x in (F.coalesce(F.length(k), F.lit(-1)), F.coalesce(F.col(k), F.lit("")))]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *reversed(parts))


def _first_in_full(df: DataFrame, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The same by comparing whole keys; copies collapse on the map side."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return grouped.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def dedupe_keep_first(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row per ``keys``: the first by ``order``. Nulls equal each other; of wholly equal rows one stays.

    Only hashes of keys and rows and the order travel: rows of a group meet as (hash, order), copies
    collapse on the map side, so a text that makes up a third of all rows costs one record per
    map task. Groups with several rows are few and narrow; they go back to the rows in a join,
    where the others pass. Groups whose keys agree in the first hash and not in the second, and
    rows that tie in their order, are compared in full.
    """
    first, second = _digests(keys)
    place = F.struct(*order, F.xxhash64(*df.columns).alias("_row"))
    marked = df.select("*", first.alias("_h"), place.alias("_place"))
    records = df.select(first.alias("_h"), second.alias("_second"), place.alias("_place"))
    # a record that counts twice stands for rows that tie
    counted = records.groupBy("_h", "_second", "_place").agg(F.count(F.lit(1)).alias("n"))
    groups = counted.groupBy("_h").agg(
        F.sum("n").alias("n"),
        F.min("_place").alias("_least"),
        F.min_by("n", "_place").alias("ties"),
        (F.min("_second") != F.max("_second")).alias("clash"),
    )
    several = written(
        groups.where("n > 1").select(F.col("_h").alias("_g"), "_least", (F.col("clash") | (F.col("ties") > 1)).alias("_full")),
        "repeated-keys",
    )
    small = F.broadcast(several) if several.count() <= BROADCAST_GROUPS else several
    joined = marked.join(small, F.col("_h") == F.col("_g"), "left")
    alone = F.col("_g").isNull() | (~F.col("_full") & (F.col("_place") == F.col("_least")))
    out = joined.where(alone).select(*df.columns)
    if several.where("_full").isEmpty():
        return out
    full = marked.join(several.where("_full"), F.col("_h") == F.col("_g"), "left_semi").select(*df.columns)
    return out.unionByName(_first_in_full(full, order, keys))


def append_mails(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Existing rows plus new ones, without repeats on subject and body; stored rows win.

    ``order`` names a column that orders rows within each side, so that a rerun keeps the same rows.
    A side that lacks the column, as a new store does, has no order.
    """

    def tagged(df: DataFrame, is_new: bool) -> DataFrame:
        position = F.col(order) if order in df.columns else F.lit(None)
        return df.withColumns({"_is_new": F.lit(is_new), "_position": position})

    both = tagged(existing, False).unionByName(tagged(new, True), allowMissingColumns=True)
    return dedupe_keep_first(both, ["_is_new", "_position"]).drop("_is_new", "_position")


def category_counts(mails: DataFrame) -> DataFrame:
    """Rows per category, most frequent first."""
    return mails.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def dataset_summary(mails: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: rows read, rows left after cleaning, categories left, number of measures."""
    per_category = mails.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(keeps(config)).alias("kept")
    )
    return per_category.agg(
        F.sum("n").alias("rows_in"),
        F.sum("kept").alias("rows_clean"),
        F.count_if(F.col("kept") > 0).alias("categories"),
        F.lit(len(METRIC_NAMES)).alias("metrics"),
    )


def category_dim(spark: SparkSession, categories: Iterable[str] = CATEGORIES) -> DataFrame:
    return spark.createDataFrame(
        [(c, i) for i, c in enumerate(categories)], "category string, ord int"
    )


def pair_dim(
    spark: SparkSession, pairs: Iterable[tuple[str, str]] = CONFUSABLE_PAIRS
) -> DataFrame:
    return spark.createDataFrame(list(pairs), "category string, other string")


def hint_dim(
    spark: SparkSession, hints: dict[str, dict[str, Sequence[str]]] = CATEGORY_HINTS
) -> DataFrame:
    rows = [(c, kind, p) for c, kinds in hints.items() for kind, ps in kinds.items() for p in ps]
    return spark.createDataFrame(rows, "category string, kind string, phrase string")


def listed_counts(mails: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, ord, n) for every listed category, zero where there are no mails.

    The list rides along as zero rows of the same aggregation, which spares the join.
    """
    zeros = categories.select("category", "ord", F.lit(0).alias("n"))
    ones = mails.select("category", F.lit(None).cast("int").alias("ord"), F.lit(1).alias("n"))
    return (
        zeros.unionByName(ones)
        .groupBy("category")
        .agg(F.max("ord").alias("ord"), F.sum("n").alias("n"))
        .filter(F.col("ord").isNotNull())
    )


def quota_gaps(
    counts: DataFrame, quota_min: int = 2000, quota_max: int = 2000, batch: int = 100
) -> DataFrame:
    """Categories that need mails, how many, and how many to produce in the next batch.

    Categories below the minimum come first; only when there are none, those below the maximum
    are listed. ``counts`` has one row per listed category.
    """
    everything = Window.partitionBy(F.lit(0))
    below_min, below_max = F.col("n") < quota_min, F.col("n") < quota_max
    any_below = F.max(below_min).over(everything)
    flagged = counts.withColumn("_any", any_below)
    gap = F.when(F.col("_any"), F.lit(quota_min) - F.col("n")).otherwise(
        F.least(F.lit(batch), F.lit(quota_max) - F.col("n"))
    )
    return (
        flagged.filter(F.when(F.col("_any"), below_min).otherwise(below_max))
        .withColumn("gap", gap)
        .withColumn("to_produce", F.least(F.lit(batch), "gap"))
        .drop("_any")
    )


def confusable_neighbours(pairs: DataFrame) -> DataFrame:
    """(category, other) in both directions; repeats in the pair list stay."""
    return pairs.select("category", "other").unionByName(
        pairs.select(F.col("other").alias("category"), F.col("category").alias("other"))
    )


def focus_confusable(needy: DataFrame, pairs: DataFrame) -> DataFrame:
    """Needy categories that occur in a confusable pair, or all of them when none does."""
    named = confusable_neighbours(pairs).select("category").distinct().withColumn("_hit", F.lit(True))
    everything = Window.partitionBy(F.lit(0))
    flagged = lookup_join(needy, named, "category").withColumn(
        "_any", F.max(F.coalesce("_hit", F.lit(False))).over(everything)
    )
    return flagged.filter(F.coalesce("_hit", F.lit(False)) | ~F.col("_any")).drop("_hit", "_any")


def keyword_audit(mails: DataFrame, hints: DataFrame, at_least: int = 2, turkish: bool = True) -> DataFrame:
    """Per mail: distinct wanted and unwanted phrases of its category found in the text.

    Case is folded on both sides. A mail of a category without phrases has no rule and passes.
    The phrases travel as two arrays per category, so a mail stays one row and meets its
    category's phrases in a lookup join.
    """
    def phrases(kind: str):
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, lower_text(F.col("phrase"), turkish))))

    per_category = hints.groupBy("category").agg(
        phrases("include").alias("_include"), phrases("avoid").alias("_avoid")
    )
    text = lower_text(F.concat_ws(" ", "subject", "body"), turkish)
    joined = lookup_join(
        mails.withColumn("_text", text), per_category, "category", "left", salt_from=F.xxhash64("mail_id")
    )

    def hits(column: str):
        return F.coalesce(F.size(F.filter(column, lambda p: F.col("_text").contains(p))), F.lit(0))

    enough = F.col("_include").isNull() | (F.col("include_hits") >= at_least)
    return (
        joined.select(
            "mail_id", "category", "_include", hits("_include").alias("include_hits"), hits("_avoid").alias("avoid_hits")
        )
        .withColumn("passes", enough & (F.col("avoid_hits") == 0))
        .drop("_include")
    )
