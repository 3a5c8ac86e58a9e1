import random
import re
import unicodedata

from pyspark.sql import functions as F

from mektup.config import STOPWORDS
from mektup.functions import ngrams, text


def evaluate(spark, values, build):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(4)
    return [r[1] for r in sorted(df.select("i", build(F.col("t"))).collect())]


def expected_clean(value, stop=True, shortest=3, turkish=True):
    """The cleaning rules, one after the other, in plain Python."""
    if value is None:
        return ""
    value = unicodedata.normalize("NFKC", value)
    if turkish:
        for a, b in (("İ", "i"), ("I", "ı")):
            value = value.replace(a, b)
    value = value.lower()
    if turkish:
        value = value.replace("i̇", "i")
    for rule in (r"https?://[a-zA-Z!$-_]+", r"\S+@\S+", r"\d+", r"[^\w\s]", "_"):
        value = re.sub(rule, " ", value)
    words = value.split()
    if stop:
        words = [w for w in words if len(w) >= shortest and w not in STOPWORDS]
    return " ".join(words)


CASES = {
    "INSTAGRAM İstanbul Iğdır": "ınstagram istanbul ığdır",
    "bak https://a.com/b?c=1&d=~e#f son": "bak son",
    "x http://ınfo.com y": "http ınfo com",
    "yaz a@b.c hemen": "yaz hemen",
    "kod 12345 ve_için güzel": "kod güzel",
    "ＡＢＣ test": "abc test",
    "https://a.com/" + "b" * 20_000: "",
    "": "",
}


def test_cleaner_cases(spark):
    assert evaluate(spark, [None, *CASES], text.clean_text) == ["", *CASES.values()]


ALPHABET = [
    "a", "b", "İ", "I", "ı", "ş", "Ğ", "é", "i̇", "@", ".", "_", " ", "  ", "\t", "\n", "\x1f",
    "\x85", "\xa0", "½", "²", "٣", "7", "漢", "😀", "!", "?", "~", "#", "http://", "https://", "x@y", "ﬁ",
    "için", " ve ", "　", "​", "’", "A",
]


def random_texts(n=600):
    pick = random.Random(7)
    return ["".join(pick.choices(ALPHABET, k=pick.randint(0, 40))) for _ in range(n)]


def test_cleaner_equals_rules(spark):
    values = random_texts()
    for options in ({}, {"remove_stopwords": False}, {"turkish_lowercase": False, "min_length": 1}):
        got = evaluate(spark, values, lambda c: text.clean_text(c, **options))
        want = [
            expected_clean(
                v,
                options.get("remove_stopwords", True),
                options.get("min_length", 3),
                options.get("turkish_lowercase", True),
            )
            for v in values
        ]
        assert got == want


def test_metric_cases(spark):
    cases = {
        "!A. B?? c.": (3, 10, 5, 2, 1, 2, 8 / 3),
        "": (0, 0, 1, 0, 0, 0, 0.0),
        "a😀ç": (1, 3, 1, 0, 0, 0, 3.0),
    }
    got = evaluate(spark, list(cases), lambda c: F.struct(*[v.alias(k) for k, v in text.text_metrics(c).items()]))
    assert [tuple(r) for r in got] == list(cases.values())


def test_metrics_equal_rules(spark):
    values = random_texts()
    got = evaluate(spark, values, lambda c: F.struct(*[v.alias(k) for k, v in text.text_metrics(c).items()]))
    for value, row in zip(values, got):
        words = value.split()
        want = (
            len(words), len(value), len(re.split("[.!?]+", value)), sum(c.isupper() for c in value),
            value.count("!"), value.count("?"), sum(map(len, words)) / len(words) if words else 0.0,
        )
        assert tuple(row)[:6] == want[:6]
        assert abs(row[6] - want[6]) < 1e-9


def expected_char_ngrams(clean, low, high):
    out = []
    for word in clean.split():
        padded = f" {word} "
        for n in range(low, high + 1):
            if n >= len(padded):
                out.append(padded)
                break
            out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return sorted(out)


def test_ngrams_equal_brute_force(spark):
    values = ["a", "ab", "abc abcd", "x yz uvw", "", "güzel bir gün 漢字😀", "aa aa aa"]
    for low, high in ((3, 5), (4, 6), (3, 3)):
        got = evaluate(spark, values, lambda c: F.sort_array(ngrams.char_ngrams(c, low, high)))
        assert got == [expected_char_ngrams(v, low, high) for v in values]
    got = evaluate(spark, values, lambda c: F.sort_array(ngrams.word_ngrams(c, 1, 3)))
    for value, grams in zip(values, got):
        words = [w for w in value.split() if len(w) >= 2]
        want = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        assert grams == sorted(want)


def test_strip_html(spark):
    got = evaluate(spark, ["<DIV>a <b>c</b>\n d</DIV>", "a < b > c"], text.strip_html)
    assert got == ["a c d", "a < b > c"]
