"""Ranked lexical search against a plain version."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mektup.llm import lexical

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    rows = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = 0
            for t in words(text):
                df = sum(t in other for _, other in counted)
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, math.inf if i is None else i, i))
        rows += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:top], start=1)]
    return sorted(rows, key=str)


def found(spark, docs, items, s=lexical.Signatures()):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r) for r in lexical.search(d, i, s).collect()], key=str)


def test_like_the_plain_version(spark):
    chance = random.Random(3)
    pool = [f"w{k}" for k in range(60)] + ["Été", "été", "ÇA", "x1", "日本", "a_b", "co-op"]
    docs = [(k, " ".join(chance.choices(pool, k=chance.choice([0, 1, 3, 20, 150])))) for k in range(150)]
    docs += [(7, "again W1 w2"), (None, "w1 w2 w3"), (None, None), (200, ""), (201, " .,!"), (202, docs[20][1])]
    docs += [(300, "w1 " * 3000 + "w2 " * 9)]
    items = [(k, " ".join(chance.choices(pool, k=8))) for k in range(12)] + [(3, "w1 w1 w2"), (50, None), (51, "nowhere"), (None, "w5")]
    for s in (lexical.Signatures(), lexical.Signatures(rows=16, item_chars=60), lexical.Signatures(slices_per_term=1, hashes=1)):
        assert found(spark, docs, items, s) == plain(docs, items)


def test_ties_rank_by_id(spark):
    docs = [(k, "same words here") for k in (9, 4, 30, 1)] + [(k, "other") for k in range(40, 60)]
    assert found(spark, docs, [(1, "words")], lexical.Signatures(top=3)) == plain(docs, [(1, "words")], top=3)


def test_bounds_hold_every_document(spark):
    chance = random.Random(5)
    counted = [Counter(f"t{chance.randrange(40)}".encode() for _ in range(chance.randrange(1, 90))) for _ in range(70)]
    s = lexical.Signatures(slices_per_term=1)
    block = lexical.Block(counted, s)
    names = [f"t{k}".encode() for k in range(45)]
    import zlib

    import numpy as np

    for least, table in zip(s.counts, block.present(np.array([zlib.crc32(t) for t in names], dtype=np.uint64))):
        for k, t in enumerate(names):
            for row, c in enumerate(counted):
                assert table[k, row] or c[t] < least


@pytest.mark.parametrize("side", ["docs", "items"])
def test_empty_tables(spark, side):
    docs, items = [(1, "a b")], [(1, "a")]
    assert found(spark, [] if side == "docs" else docs, [] if side == "items" else items) == []


def test_further_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, "c", 6)], "doc_id long, text string, item int")
    docs = docs.withColumn("rank", F.lit(1)).withColumn("score", F.lit(2)).withColumn("part", F.lit(3))
    items = docs.select(F.col("doc_id").alias("item_id"), "text", "rank")
    assert {(r["item_id"], r["doc_id"]) for r in lexical.search(docs, items).collect()} == {(1, 1), (2, 2)}
