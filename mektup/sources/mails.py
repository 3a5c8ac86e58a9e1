"""Reading, checking and writing labelled mail tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mektup.config import CSV_COLUMNS, NA_TOKENS

REQUIRED = ("category", "subject", "body")

MAIL_SCHEMA = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def require_columns(df: DataFrame, required: Iterable[str] = REQUIRED) -> DataFrame:
    """Return ``df`` unchanged, or name the required columns it lacks."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; required are {list(required)}")
    return df


def read_mail_csv(
    spark: SparkSession,
    path: str,
    encoding: str = "UTF-8",
    columns: dict[str, str] = CSV_COLUMNS,
    na_tokens: Iterable[str] = NA_TOKENS,
) -> DataFrame:
    """Read labelled mails from CSV with a header and quoted multi-line text.

    All columns are read as strings (no inference pass), renamed by ``columns``, and fields that
    hold a missing-value token become null. Extra columns are kept. Quoted line breaks make one
    CSV file one task, so keep large inputs in many files, or convert them to parquet once.
    """
    raw = spark.read.csv(
        path, header=True, multiLine=True, quote='"', escape='"', encoding=encoding
    )
    tokens = list(na_tokens)
    out = raw.select(
        *[
            F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(columns.get(c, c))
            for c in raw.columns
        ]
    )
    require_columns(out)
    if "created_at" in out.columns:
        out = out.withColumn("created_at", F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd HH:mm:ss")))
    return out


def read_or_create_mails(spark: SparkSession, path: str) -> DataFrame:
    """Open the stored parquet mail table, creating an empty one when there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.createDataFrame([], MAIL_SCHEMA).write.parquet(path)
    return spark.read.schema(MAIL_SCHEMA).parquet(path)


#: Rows of one CSV file: quoted line breaks make a file one task when it is read.
CSV_FILE_ROWS = 5_000


def write_mails(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a mail table as parquet, or as CSV files of bounded size with the quoting the reader expects."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("maxRecordsPerFile", CSV_FILE_ROWS).csv(path, header=True, quote='"', escape='"')
    else:
        writer.format(fmt).save(path)


def mails_from_documents(documents: DataFrame) -> DataFrame:
    """View a document table as mails: first line is the subject, the rest the body."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return documents.select(
        F.col("doc_id").alias("mail_id"),
        F.col("lang").alias("category"),
        first.alias("subject"),
        F.nullif(F.substr("text", F.length(first) + 2), F.lit("")).alias("body"),
    )
