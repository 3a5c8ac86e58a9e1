from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mektup.config import Config
from mektup.functions import grambatch, ngrams
from mektup.operators import tfidf

TEXTS = [
    None, "", " ", "a", "ab a  abc ab", " aaaa aaaa aa aaaa", "x\ny z\u0000 \u0000\u0000 ş😀 😀😀 ığü", "abc abd abc abd abc abd",
    "ab ab ab ab ab", "wörter und wörter und dinge", "".join(chr(0x4E00 + i) for i in range(900)), "ab", "the end of the end of the end",
]


def columns(spark, orders, texts=TEXTS):
    """The n-grams of every text by the column expressions, as lists.

    Java also finds some that begin in the middle of a character beyond the basic plane; these show as "?".
    """
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    made = {"w": lambda o: ngrams.word_ngrams(F.coalesce("t", F.lit("")), *o), "c": lambda o: ngrams.char_ngrams(F.coalesce("t", F.lit("")), *o)}
    return {k: [[g for g in r[0] if "?" not in g] for r in rows.orderBy("i").select(made[k](o)).collect()] for k, o in orders.items()}


@pytest.mark.parametrize("entries", [3, 2_000_000])
@pytest.mark.parametrize("orders", [{"w": (1, 3), "c": (3, 5)}, {"w": (2, 4), "c": (5, 9)}])
def test_counts_equal_the_column_expressions(spark, monkeypatch, entries, orders):
    monkeypatch.setattr(grambatch, "ENTRIES", entries)
    monkeypatch.setattr(grambatch, "EMITTED", 7)
    want = {}
    for kind, lists in columns(spark, orders).items():
        cf, df = Counter(), Counter()
        for grams in lists:
            cf.update(grams)
            df.update(set(grams))
        want |= {(kind, t): (cf[t], df[t]) for t in cf}
    low = {k: o[0] for k, o in orders.items()}
    got = Counter()
    for batch in grambatch.counts(pa.array(TEXTS), orders, low):
        for r in batch.to_pylist():
            got[r["kind"], r["term"], "cf"] += r["cf"]
            got[r["kind"], r["term"], "df"] += r["df"]
    assert got == Counter({(*key, name): n for key, both in want.items() for name, n in zip(("cf", "df"), both)})


@pytest.mark.parametrize("orders", [{"w": (1, 3), "c": (3, 5)}, {"w": (2, 3), "c": (4, 6)}])
def test_only_longer_ones_that_begin_and_end_in_a_part(orders):
    low = {k: o[0] for k, o in orders.items()}
    longer = {k: (o[0] + 1, o[1]) for k, o in orders.items()}
    parts = {"w": ["ab", "end", "und", "the end", "und wörter", "ab ab"], "c": [" ab", "ab ", " th", "he ", " the", "the ", "aaaa"]}

    def sides(kind, term):
        run = term.split(" ") if kind == "w" else list(term)
        join = " ".join if kind == "w" else "".join
        return join(run[: low[kind]]), join(run[-low[kind] :])

    def total(batches):
        out = Counter()
        for b in batches:
            for r in b.to_pylist():
                out[r["kind"], r["term"]] += r["cf"] * 1000 + r["df"]
        return out

    every = total(grambatch.counts(pa.array(TEXTS), longer, low))
    some = total(grambatch.counts(pa.array(TEXTS), longer, low, {k: pa.array(v) for k, v in parts.items()}))
    assert some == {(k, t): n for (k, t), n in every.items() if set(sides(k, t)) <= set(parts[k])} and some


@pytest.mark.parametrize("entries", [3, 2_000_000])
@pytest.mark.parametrize("orders", [{"w": (1, 3), "c": (3, 5)}, {"w": (2, 3), "c": (5, 6)}, {"c": (3, 4)}, {"w": (1, 2)}])
def test_weights_equal_plain_ones(spark, monkeypatch, entries, orders):
    monkeypatch.setattr(grambatch, "ENTRIES", entries)
    lists = columns(spark, orders)
    terms = {k: sorted({t for grams in lists[k] for t in grams})[::2] for k in orders}
    idf = {k: 1.0 + np.arange(len(t)) / 10 for k, t in terms.items()}
    lengths, features, weights = grambatch.Weigher(terms, idf, True).weigh(pa.array(TEXTS))
    ends = np.cumsum(lengths)
    for i, (begin, end) in enumerate(zip(ends - lengths, ends)):
        want, start = {}, 0
        for k, names in terms.items():
            n = Counter(lists[k][i])
            of_kind = {start + j: (1 + np.log(n[t])) * idf[k][j] for j, t in enumerate(names) if n[t]}
            size = np.sqrt(sum(w * w for w in of_kind.values()))
            want |= {f: w / size for f, w in of_kind.items()}
            start += len(names)
        assert features[begin:end].tolist() == sorted(want)
        assert weights[begin:end] == pytest.approx([want[f] for f in sorted(want)])


def test_texts_are_counted_and_weighed_without_unfolding_their_ngrams(spark, capsys):
    """One row per n-gram of every text made fitting and applying outlast their limits at 1 GB."""
    rows = spark.createDataFrame([(1, "one two three two"), (2, "two three four")], "mail_id int, text_clean string")
    fitted = tfidf.fit_tfidf(rows, Config(min_df=1, max_df=1.0))
    for df in (tfidf.term_stats(rows), fitted.vectors(rows)):
        df.explain()
        plan = capsys.readouterr().out
        assert "Generate" not in plan and "regexp" not in plan
