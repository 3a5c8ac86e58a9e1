"""Word and character n-grams of cleaned text as array expressions.

Both use overlapping look-ahead matches, which the regex engine emits in one walk over the text;
nested array lambdas over every position were about three times slower.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(clean: Column) -> Column:
    """Words of at least two characters."""
    return F.filter(F.split(clean, " "), lambda w: F.length(w) >= 2)


def word_ngrams(clean: Column, low: int = 1, high: int = 3) -> Column:
    """Runs of ``low`` to ``high`` consecutive words, joined by blanks."""
    words = F.array_join(word_tokens(clean), " ")
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(word_tokens(clean))
        else:
            run = "[^ ]+" + " [^ ]+" * (n - 1)
            parts.append(F.regexp_extract_all(words, F.lit(f"(?<![^ ])(?=({run}))"), F.lit(1)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _window(n: int, low: int) -> str:
    # A window of n characters inside one word that carries a blank on either side; the word
    # as a whole also counts once at its own length, or at the lowest order if it is shorter.
    whole = f" [^ ]{{1,{n - 2}}} " if n == low else f" [^ ]{{{n - 2}}} "
    return f"(?=([^ ]{{{n}}}| [^ ]{{{n - 1}}}|[^ ]{{{n - 1}}} |{whole}))"


def char_ngrams(clean: Column, low: int = 3, high: int = 5, start: int | None = None) -> Column:
    """Character windows of ``low`` to ``high`` inside word bounds, or only those of ``start`` and more."""
    if low < 3:
        raise ValueError("character n-grams inside word bounds start at 3")
    tight = F.trim(F.regexp_replace(clean, " +", " "))
    padded = F.concat(F.lit(" "), F.replace(tight, F.lit(" "), F.lit("  ")), F.lit(" "))
    parts = [
        F.regexp_extract_all(padded, F.lit(_window(n, low)), F.lit(1)) for n in range(start or low, high + 1)
    ]
    return parts[0] if len(parts) == 1 else F.concat(*parts)
