"""Score arriving messages exactly once and append the results to a log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mektup.operators.messages import decode_messages, fill_defaults
from mektup.plans.scoring import MailModel, score
from mektup.sources.envelopes import stream_envelopes, with_id

BODY_KEPT = 500
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Keeps keys on disk, so that their number is not bounded by an executor's memory.
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_seen(stream: DataFrame, key: str, event_time: str | None = None, within: str | None = None) -> DataFrame:
    """Each key once, also across restarts from the same checkpoint.

    The state keeps every key for good unless ``within`` bounds it: then repeats are recognised
    only inside that delay of ``event_time`` and older keys are dropped.
    """
    if within is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark([key])


def result_records(
    envelopes: DataFrame, model: MailModel, min_confidence: float | None = None
) -> DataFrame:
    """Decode, fill in, classify; one record per message that has any text."""
    filled = fill_defaults(decode_messages(envelopes))
    scored = score(filled, model, min_confidence, model.config.fallback_label)
    return scored.filter(F.col("prediction").isNotNull()).select(
        F.current_timestamp().alias("processed_at"),
        "mail_id",
        "subject",
        F.substring("body", 1, BODY_KEPT).alias("body"),
        "prediction",
        "probabilities",
        "top",
    )


def write_once(log: str, fmt: str = "json") -> Callable[[DataFrame, int], None]:
    """A sink for micro-batches with a folder for each batch id, which a repeated batch replaces.

    A batch that ran and was not yet committed when the job died runs again under its id with the
    same input, so whatever reads the log finds every record once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{log}/batch_id={batch_id}")

    return write


def watch(
    spark: SparkSession,
    landing: str,
    log: str,
    checkpoint: str,
    model: MailModel,
    interval: str | None = "2 seconds",
    min_confidence: float | None = None,
    within: str | None = None,
    fmt: str = "json",
) -> StreamingQuery:
    """Start scoring new envelope files in ``landing`` and appending records to ``log``.

    The model is loaded once by the caller. ``interval=None`` works off what is there and stops.
    A message counts as seen as soon as it was read, whether or not it could be classified. The
    ids seen are kept in a state store on disk, and the log is written once for each batch, also
    when the job is killed and started again from its checkpoint.
    """
    fresh = first_seen(with_id(stream_envelopes(spark, landing)), "ID", "Created", within)
    records = result_records(fresh, model, min_confidence)
    writer = records.writeStream.foreachBatch(write_once(log, fmt)).option("checkpointLocation", checkpoint)
    timing = {"availableNow": True} if interval is None else {"processingTime": interval}
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ON_DISK)  # a query keeps the settings it was started with
    try:
        return writer.trigger(**timing).start()
    finally:
        spark.conf.set(STATE_STORE, before)
