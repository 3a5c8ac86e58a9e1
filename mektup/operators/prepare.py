"""From a raw mail table to cleaned, measured rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mektup.config import Config
from mektup.functions.text import METRIC_NAMES, clean_text, text_metrics
from mektup.session import spread
from mektup.sources.mails import REQUIRED, read_mail_csv, require_columns


def raw_text() -> Column:
    return F.concat_ws(" ", F.col("subject"), F.col("body"))


def cleaned(text: Column, config: Config) -> Column:
    return clean_text(
        text,
        remove_stopwords=config.remove_stopwords,
        min_length=config.min_word_length,
        turkish_lowercase=config.turkish_lowercase,
        stopwords=config.stopwords,
    )


def clean_mails(mails: DataFrame, config: Config = Config()) -> DataFrame:
    """Drop incomplete rows, add ``text_raw`` and ``text_clean``, drop texts that are too short."""
    require_columns(mails)
    rows = mails.dropna(subset=list(REQUIRED)).withColumn("text_raw", raw_text())
    clean = cleaned(F.col("text_raw"), config)
    if config.keep_empty:
        return rows.withColumn("text_clean", clean)
    # Not a filter: the optimiser would push it below the projection and clean every text again,
    # once per mention. Unfolding an array of no or one text cleans and filters in one go.
    return rows.withColumn(
        "text_clean", F.explode(F.filter(F.array(clean), lambda c: has_words(c, config.min_words)))
    )


def has_words(clean: Column, min_words: int = 3) -> Column:
    """True when a clean text is not blank and has at least ``min_words`` words."""
    words = F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit(""))) + 1
    return (clean != "") & (words >= min_words)


def keeps(config: Config = Config()) -> Column:
    """Whether :func:`clean_mails` keeps a row, as a condition on the raw columns."""
    complete = F.col("category").isNotNull() & F.col("subject").isNotNull() & F.col("body").isNotNull()
    if config.keep_empty:
        return complete
    clean = F.array(cleaned(raw_text(), config))
    return complete & F.exists(clean, lambda c: has_words(c, config.min_words))


def with_metrics(rows: DataFrame, text: str = "text_raw") -> DataFrame:
    """Add the seven text measures as columns."""
    measures = text_metrics(F.col(text))
    return rows.withColumns({name: measures[name] for name in METRIC_NAMES})


def load_mails(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """Read a labelled mail CSV and return cleaned, measured rows."""
    return with_metrics(clean_mails(spread(read_mail_csv(spark, path)), config))


def labels(rows: DataFrame, column: str = "category") -> DataFrame:
    """Distinct labels in code-point order."""
    return rows.select(column).distinct().orderBy(column)


def metric_stats(rows: DataFrame) -> DataFrame:
    """One row with mean and population standard deviation per measure."""
    return rows.agg(
        *[F.avg(m).alias(f"{m}_mean") for m in METRIC_NAMES],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in METRIC_NAMES],
    )


def scale_metrics(rows: DataFrame, stats: dict[str, float]) -> DataFrame:
    """Centre and scale every measure with the given statistics; a constant measure becomes 0."""
    return rows.withColumns({m: scaled(F.col(m), stats[f"{m}_mean"], stats[f"{m}_std"]) for m in METRIC_NAMES})


def scaled(value: Column, mean: float, std: float) -> Column:
    return (value - F.lit(float(mean))) / F.lit(float(std) if std else 1.0)
