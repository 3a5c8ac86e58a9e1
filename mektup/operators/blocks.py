"""Extract (subject, body) records from free-text responses, one row in, its records out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from mektup.config import BODY_MARK, CATEGORY_MARK, SUBJECT_MARK

RECORDS = ArrayType(StructType([StructField("subject", StringType()), StructField("body", StringType())]))
_NUMBERED = re.compile(r"\d+\.")


def _value(line: str) -> str | None:
    """Text after the first colon without blanks and surrounding quotes; None when empty."""
    return line[line.index(":") + 1 :].strip().strip('"').strip("'") or None


def records(text: str) -> Iterator[tuple[str, str]]:
    """The (subject, body) records of one response, in one walk over its lines."""
    subject: str | None = None
    body: list[str] = []
    open_ = False  # whether further lines belong to the body
    for line in map(str.strip, text.split("\n")):
        plain = line.replace("**", "")
        field = ":" in plain
        if not line:
            open_ = False
        elif field and SUBJECT_MARK in plain:
            if subject is not None and body:
                yield subject, " ".join(body)
                subject, body = None, []
            value = _value(plain)
            if value is not None:
                subject, open_ = value, False
        elif field and BODY_MARK in plain:
            value = _value(plain)
            body = [value] if value is not None else body
            open_ = True
        elif _NUMBERED.match(line) or CATEGORY_MARK in line:
            if subject is not None and body and open_:
                yield subject, " ".join(body)
                subject, body = None, []
            open_ = False
        elif open_ and body:
            body.append(line)
    if subject is not None and body:
        yield subject, " ".join(body)


@F.arrow_udf(returnType=RECORDS)
def parse_blocks(texts: pa.Array) -> pa.Array:
    """Array of (subject, body) records of each response; null for a null one.

    A subject line starts a record, a body line sets its body, further lines extend the body by
    one blank and themselves until an empty line, a numbered line or a category line. Records
    that lack either field are not returned. The time is linear in the length of the text.
    """
    kind = pa.list_(pa.struct([("subject", pa.string()), ("body", pa.string())]))
    found = [None if t is None else [{"subject": s, "body": b} for s, b in records(t)] for t in texts.to_pylist()]
    return pa.array(found, kind)


def block_records(responses: DataFrame) -> DataFrame:
    """(response_id, category, text) → (response_id, record, category, subject, body).

    The whole walk happens inside the row, so nothing is shuffled.
    """
    return responses.select(
        "response_id", "category", F.posexplode(parse_blocks(F.col("text"))).alias("record", "_r")
    ).select(
        "response_id",
        (F.col("record") + 1).alias("record"),
        "category",
        F.col("_r.subject").alias("subject"),
        F.col("_r.body").alias("body"),
    )
