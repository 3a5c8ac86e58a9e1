"""What the operators of this folder share: narrowed inputs, partition counts, label folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`texts` with the `row_key` of each row as ``key``."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        row_key(id_col, text_col).alias("key"),
    )


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``; a null text counts as empty.

    Operators start from this, so further columns of an input can neither clash with their own
    names nor travel through their shuffles.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids fall to 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(modulus)), F.lit(0))


def bounded_sample(rows: DataFrame, key: str, limit: int, strata: str) -> DataFrame:
    """At most about ``limit`` rows of each stratum, chosen by a hash of ``key``.

    Used for fitting only. The share is found from one count, so nothing is sorted or gathered;
    a stratum with fewer rows is taken whole. Rows without a stratum are left out.
    """
    sizes = rows.where(F.col(strata).isNotNull()).groupBy(strata).count().collect()
    share = F.lit(0.0)
    for size in sizes:
        share = F.when(F.col(strata) == F.lit(size[0]), F.lit(min(1.0, limit / size[1]))).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(F.col(strata).isNotNull() & (place < share))


#: Ids that a join may broadcast at most; a table beyond this is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def small_first(rows: DataFrame, ids: DataFrame, condition: Column | str, how: str) -> DataFrame:
    """Join to a written table of narrow rows, which is broadcast only after its rows were counted."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, condition, how)


KEY = "struct<none: boolean, id: bigint, hash: bigint, other: bigint>"


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells a row from others: its id, null or not, and two hashes of its text (null counts as empty).

    Keys order by id, null ids last, so the least key of a group belongs to its least id.
    """
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return F.struct(
        own.isNull().alias("none"),
        F.coalesce(own, F.lit(0).cast("long")).alias("id"),
        F.xxhash64(text).alias("hash"),
        F.xxhash64(F.lit("other"), text).alias("other"),
    )


def rows_without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose `row_key` is not in the written table ``gone`` (key)."""
    marked = docs.select(F.struct(*docs.columns).alias("row"), row_key(id_col, text_col).alias("own"))
    return small_first(marked, gone.select("key"), F.col("own") == F.col("key"), "left_anti").select("row.*")
