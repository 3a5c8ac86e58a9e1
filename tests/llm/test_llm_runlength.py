"""Repeated byte strings against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mektup.llm import runlength
from mektup.llm.runlength import Repeats, RunIndex

SMALL = Repeats(length=10, anchors=(3, 6, 10), group=4, index_bytes=200, cut_bytes=150, batch_bytes=600)


def plain(docs, length):
    """docs in order; counts, digest and runs of each."""
    seen, found = set(), []
    for text in docs:
        held = (text or "").encode()
        gone = np.zeros(len(held) + 1, dtype=bool)
        for k in range(len(held) - length + 1):
            if held[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(held[k : k + length])
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        runs = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        kept = bytes(b for b, g in zip(held, gone) if not g)
        found.append((len(held), int(gone.sum()), len(runs), hashlib.sha256(kept).hexdigest(), ",".join(f"{a}:{b}" for a, b in runs)))
    return found


def found(spark, docs, r):
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted([tuple(x) for x in runlength.remove_repeats(rows, r).collect()], key=str)


def some_texts(seed, count):
    chance = random.Random(seed)
    texts = []
    for _ in range(count):
        text = "".join(chance.choices("abcdefgh ", k=chance.choice([0, 5, 30, 200])))
        if texts and chance.random() < 0.5:
            other = chance.choice(texts)
            cut = chance.randrange(len(other) + 1)
            text = text[:20] + other[cut : cut + chance.randrange(60)] + text[20:]
        texts.append(text)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_index_against_all_pairs(seed):
    chance = random.Random(seed)
    for _ in range(30):
        strings = [bytes(chance.choices(b"ab" if seed else b"abcd", k=chance.randrange(1, 40))) for _ in range(chance.randrange(1, 10))]
        strings += strings[:1]
        index = RunIndex(strings)
        assert index.runs <= index.size
        suffixes = {int(b) + k: s[k:] for s, b in zip(strings, index.begins) for k in range(len(s))}

        def shared(a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        best = [max((shared(a, b) for q, b in suffixes.items() if q != p), default=0) for p, a in suffixes.items()]
        assert index.statistics(np.array(list(suffixes))).tolist() == best
        for length in (1, 3, 6):
            seen, again = set(), []
            for p, s in suffixes.items():
                if len(s) >= length:
                    if s[:length] in seen:
                        again.append(p)
                    seen.add(s[:length])
            assert index.repeats(length).tolist() == again


def test_runs_stay_few_on_repetitive_strings():
    text = bytes(random.Random(1).choices(b"abcdefghij", k=400))
    one, many = RunIndex([text]), RunIndex([text] * 50)
    assert many.runs < 3 * one.runs + 2 * 50


@pytest.mark.parametrize("r", [SMALL, Repeats(length=10, anchors=(4, 10), group=10_000)])
def test_like_the_plain_version(spark, r):
    texts = some_texts(3, 80)
    # copies, periods, one line in very many documents, and long texts
    texts += [texts[5]] * 30 + ["ab" * 200, "a" * 333, "Zweiundvierzig Äpfel 日本語のテキスト"] * 3
    texts += [f"{k * 7919 % 9973:05d} the common line {k * 104729 % 99991:05d}" for k in range(60)]
    texts += ["".join(random.Random(9).choices("xyz", k=700)) * 3]
    docs = list(enumerate(texts))
    expected = [(i, *row) for (i, _), row in zip(docs, plain(texts, 10))]
    random.Random(4).shuffle(docs)
    assert found(spark, docs, r) == sorted(expected, key=str)


def test_whole_length_over_many_bytes(spark):
    chance = random.Random(8)
    base = "".join(chance.choices("abcdefghijklmnop \n", k=2_500_000))
    texts = [base, "x" + base[1_000_000:1_000_120] + "y", base[10:109], base[5:105], None, ""]
    expected = [(i, *row) for i, row in enumerate(plain(texts, 100))]
    assert found(spark, list(enumerate(texts)), Repeats()) == sorted(expected, key=str)


def test_null_and_repeated_ids_and_rows(spark):
    a, b = "first text that is long enough", "other text that is long enough"
    docs = [(None, a), (3, a), (3, a), (3, a), (7, b), (7, None), (None, "short")]
    texts = [a, a, a, b, None, a, "short"]  # null ids come last
    expected = [(i, *row) for i, row in zip([3, 3, 3, 7, 7, None, None], plain(texts, 10))]
    assert found(spark, docs, SMALL) == sorted(expected, key=str)


def test_empty_table_and_further_columns(spark):
    rows = spark.createDataFrame([(1, "abc" * 20), (2, "abc" * 20)], "doc_id long, text string")
    assert runlength.remove_repeats(rows.limit(0)).count() == 0
    odd = rows.withColumns({c: F.lit(1) for c in ("id", "place", "key", "spans", "copies")})
    by_name = {r["doc_id"]: r["n_removed"] for r in runlength.remove_repeats(odd, SMALL).collect()}
    assert by_name == {i + 1: row[1] for i, row in enumerate(plain(["abc" * 20] * 2, 10))}
