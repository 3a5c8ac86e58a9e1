"""Text cleaning and text measures as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mektup.config import STOPWORDS

# Whitespace as Python's str.split sees it, written for a Java character class.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
# Letters and non-decimal numbers survive cleaning; every other run turns into one blank.
WORD_BREAK = r"[^\p{L}\p{Nl}\p{No}]+"
# One flat class; an alternation per character would overflow the Java regex stack.
URL = r"https?://[a-zA-Z!$-_]+"
# A whitespace-bounded run with an '@' that is neither its first nor its last character.
# Possessive, so that a long run without a match is walked once.
EMAIL = rf"(?<![^{SPACE}])[^{SPACE}][^{SPACE}@]*+@[^{SPACE}]+"
# Texts made only of these characters are in NFKC already; others may change. Matched from the
# start and possessively: searching for an outsider instead is about ten times slower in Java.
ALREADY_NFKC = (
    "\\A[\\x00-\\x9f\\xa1-\\xa7\\xa9\\xab-\\xae\\xb0\\xb1\\xb6\\xb7\\xbb\\xbf-\\u0131"
    "\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e\\u2012-\\u2016\\u2018-\\u2022]*+\\z"
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and let ``body`` refer to it any number of times."""
    return F.element_at(F.transform(F.array(value), body), 1)


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()],
        pa.string(),
    )


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Only texts that can change travel to Python, the rest send a null."""
    return F.coalesce(_nfkc(F.when(~text.rlike(ALREADY_NFKC), text)), text)


def lower_text(text: Column, turkish: bool = True) -> Column:
    if not turkish:
        return F.lower(text)
    # two plain replacements; translate walks a text character by character, at three times the price
    dotted = F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı"))
    return F.replace(F.lower(dotted), F.lit("i̇"), F.lit("i"))


def clean_text(
    text: Column,
    remove_stopwords: bool = True,
    min_length: int = 3,
    turkish_lowercase: bool = True,
    stopwords: Sequence[str] = STOPWORDS,
    normalize: bool = True,
) -> Column:
    """Normalise, lower-case and strip a text down to its words, joined by single blanks.

    Digits, punctuation, underscores and blanks all end up as one blank, so a single split does
    the work of those steps. ``min_length`` applies only when stopwords are removed.
    """
    value = F.coalesce(text, F.lit(""))
    if normalize:
        value = nfkc(value)
    value = F.regexp_replace(lower_text(value, turkish_lowercase), URL, " ")
    value = bind(
        value, lambda v: F.when(v.contains("@"), F.regexp_replace(v, EMAIL, " ")).otherwise(v)
    )
    if not remove_stopwords:
        return F.trim(F.regexp_replace(value, WORD_BREAK, " "))
    shortest = max(min_length, 1)
    dropped = [w for w in stopwords if len(w) >= shortest]

    def keep(word: Column) -> Column:
        long_enough = F.length(word) >= shortest
        return long_enough & ~word.isin(dropped) if dropped else long_enough

    return F.array_join(F.filter(F.split(value, WORD_BREAK), keep), " ")


def word_total(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


METRIC_NAMES = ("words", "chars", "sentences", "uppercase", "exclamations", "questions", "mean_word_length")


def text_metrics(text: Column) -> dict[str, Column]:
    """The seven measures of a raw text, by name, in feature order."""
    words = word_total(text)
    chars = F.length(text)
    letters = chars - F.regexp_count(text, F.lit(f"[{SPACE}]"))
    return {
        "words": words,
        "chars": chars,
        "sentences": F.regexp_count(text, F.lit("[.!?]+")) + 1,
        "uppercase": F.regexp_count(text, F.lit(r"\p{IsUppercase}")),
        "exclamations": chars - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "questions": chars - F.length(F.replace(text, F.lit("?"), F.lit(""))),
        "mean_word_length": F.coalesce(letters / F.nullif(words, F.lit(0)), F.lit(0.0)),
    }


def strip_html(body: Column) -> Column:
    """Drop tags and collapse blanks when the text looks like HTML, else leave it alone."""
    stripped = F.trim(
        F.regexp_replace(F.regexp_replace(body, "<[^<]+?>", ""), f"[{SPACE}]+", " ")
    )
    return F.when(body.rlike("(?i)<(html|body|div)"), stripped).otherwise(body)
