"""Exact duplicates by a distributed content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mektup.llm.common import partitions
from mektup.session import written

#: Leading characters that order the ranges; the rest of a text orders by its hash, then in full.
LEAD = 32
#: A text is split over several sort groups when it has more copies than 1 / (SHARE x partitions) of all rows.
SHARE = 4


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space replaced by one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _frequent(docs: DataFrame, text_col: str) -> DataFrame:
    """Hashes of texts with very many copies, and into how many pieces each is split.

    At most SHARE rows per shuffle partition can pass the threshold, which bounds the result.
    """
    spark = docs.sparkSession
    most = F.lit(1 + docs.count() // (SHARE * partitions(spark)))
    counts = docs.select(F.xxhash64(normalised(F.col(text_col))).alias("h")).groupBy("h").count()
    return written(
        counts.where(F.col("count") > most).select("h", F.ceil(F.col("count") / most).cast("int").alias("pieces")),
        "frequent-texts",
    )


def _runs(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], frequent: DataFrame) -> DataFrame:
    """Every row after the sort: whether it starts a run of equal texts, and the run's first id.

    Sampled splitters cut the order (first characters, hash, piece) into ranges; inside a range
    the rows are sorted by the whole normalised text and the id, spilling to disk when needed,
    and each text is compared in full with the one before it.
    """
    own, text = F.col(id_col), F.col(text_col)
    columns = [own.alias("id"), *([text.alias("raw"), F.struct(*carry).alias("row")] if carry else [])]
    keyed = (
        docs.select(*columns, normalised(text).alias("norm"))
        .withColumn("h", F.xxhash64("norm"))
        .withColumn("lead", F.substring("norm", 1, LEAD))
        .join(F.broadcast(frequent), "h", "left")
        .withColumn("split", F.col("pieces").isNotNull())
        .withColumn("piece", F.coalesce(F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"), F.lit(0)))
        .drop("pieces", *(["norm"] if carry else []))
    )
    ranged = keyed.repartitionByRange("lead", "h", "piece")
    if carry:  # the text travels once, as it is
        ranged = ranged.withColumn("norm", normalised(F.col("raw")))
    order = Window.partitionBy("lead", "h", "piece").orderBy("norm", F.col("id").asc_nulls_last())
    before = F.lag("norm").over(order)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn("starts", before.isNull() | (before != F.col("norm"))).withColumn(
        "first", F.last(F.when(F.col("starts"), F.struct("id")), ignorenulls=True).over(so_far)["id"]
    )


def _least(runs: DataFrame) -> DataFrame:
    """For each split text the number of its copies, the piece and the id of the row that stays."""
    least = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("first"), F.col("piece").alias("piece")))
    return runs.where(F.col("starts") & F.col("split")).groupBy("h", "sha").agg(
        F.sum("size").alias("all_size"), least.alias("least")
    )


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal when they agree after white-space normalisation. Of equal texts the smallest
    id stays; null ids come last, and of rows that repeat id and text one stays. Null and empty
    texts are equal. Other columns are not read. An empty table gives an empty result.

    Copies of one text that make up a large part of all rows are sorted in several pieces; their
    runs, a bounded number, are merged afterwards.
    """
    run = Window.partitionBy("lead", "h", "piece", "norm")
    runs = written(
        _runs(docs, id_col, text_col, (), _frequent(docs, text_col))
        .withColumn("size", F.count(F.lit(1)).over(run))
        .withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
        .select("h", "piece", "split", "id", "starts", "first", "size", "sha"),
        "text-runs",
    )
    return runs.join(F.broadcast(_least(runs)), ["h", "sha"], "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least.first")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("starts") & (F.col("piece") == F.coalesce(F.col("least.piece"), F.col("piece")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows that stay; the rules are those of `mark_copies`."""
    others = tuple(c for c in docs.columns if c != text_col)
    frequent = _frequent(docs, text_col)
    stay = _runs(docs, id_col, text_col, others, frequent).where(F.col("starts"))
    if not frequent.isEmpty():
        stay = written(
            stay.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256)).withColumn("size", F.lit(0)).drop("norm"),
            "text-starts",
        )
        stay = stay.join(F.broadcast(_least(stay)), ["h", "sha"], "left").where(
            F.col("piece") == F.coalesce(F.col("least.piece"), F.col("piece"))
        )
    return stay.select(*[F.col("raw").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
