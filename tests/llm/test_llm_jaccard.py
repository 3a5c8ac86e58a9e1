"""The similarity join against all pairs compared one by one."""

import random
import re

import numpy as np

from mektup.llm import jaccard
from mektup.llm.groups import components


def brute(rows, similarity=0.8):
    """(doc_id, class_id, n_links) by comparing every pair of rows."""
    sets = []
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if both and sets[a] and sets[b] and len(sets[a] & sets[b]) / both >= similarity - 1e-12:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return sorted((rows[k][0], least[root(k)], links[k]) for k in range(n))


def varied(chance, words, changes):
    words = list(words)
    for _ in range(changes):
        words[chance.randrange(len(words))] = "w%d" % chance.randrange(10**6)
    return words


def made(count=260):
    chance = random.Random(9)
    rows, originals = [], [["w%d" % chance.randrange(3000) for _ in range(chance.randint(5, 220))] for _ in range(30)]
    for k in range(count):
        base = originals[min(29, int(chance.expovariate(0.15)))]
        rows.append((k * 3, " ".join(varied(chance, base, chance.randint(0, 4)))))
    rows += [(2000, None), (2001, ""), (2002, "!!"), (2003, "one two"), (2004, "One, two."), (2005, "two one")]
    rows += [rows[0], rows[1]]
    return rows


def got(table, settings=jaccard.Settings()):
    return sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.classes(table, settings).collect())


def test_against_all_pairs(spark):
    rows = made()
    table = spark.createDataFrame([(a, b, b"x", 1) for a, b in rows], "doc_id long, text string, set binary, root int")
    want = brute(rows)
    assert got(table) == want
    assert got(table, jaccard.Settings(block_rows=7, cells=500)) == want
    kept = jaccard.keep_one(table)
    assert kept.columns == table.columns
    classes = dict((a, b) for a, b, _ in want)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({a for a, _ in rows if classes[a] == a})


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(docs) == brute(rows)


def test_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    found = {(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.classes(docs).collect()}
    assert found == {(None, 4, 1), (4, 4, 1), (None, None, 0)}
    assert jaccard.classes(docs.where("false")).collect() == []
    assert jaccard.keep_one(docs.where("false")).count() == 0


def test_rows_are_told_apart_by_id_and_text(spark):
    base = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [
        (9, base + " a"), (9, other), (3, base + " b"),  # a near copy under an id that a unique text shares
        (None, "n " * 3 + base.replace("w1 ", "q ")), (None, "alone and unlike all the others"), (None, other + " x"),
        (5, "the same row twice or more"), (5, "the same row twice or more"), (6, None), (6, ""), (None, None),
    ]
    docs = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "doc_id long, text string, key int, row int, _gone int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(9, other), (3, base + " b"), (None, "alone and unlike all the others"), (5, "the same row twice or more"), (6, None), (6, ""), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_longest_prefixes_meet_first():
    labels = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 2], [1, 3, 0], [2, 0, 0], [2, 0, 1]])
    same = np.ones((6, 4))
    assert list(jaccard.trie_links(labels, same, 1, 4)) == [(1, 0), (2, 0), (5, 4), (3, 0)]
    assert {tuple(sorted(x)) for x in jaccard.trie_links(labels, same, 3, 4)} == {(0, 1)}
    apart = same.copy()
    apart[2] = 0
    assert (2, 0) not in list(jaccard.trie_links(labels, apart, 1, 4))


def measured_recall(pairs=400, words=150):
    """The share of pairs near the least similarity whose labels share the shortest prefix in some tree."""
    chance, s = np.random.default_rng(12), jaccard.Settings()
    hashes, met, near = jaccard._functions(s), 0, 0
    for _ in range(pairs):
        common = chance.integers(0, 2**63, words, dtype=np.uint64)
        sides = [np.concatenate([common, chance.integers(0, 2**63, words // 8, dtype=np.uint64)]) for _ in range(2)]
        a, b = (jaccard.signature(x, hashes).reshape(s.trees, s.depth)[:, : s.prefix()] for x in sides)
        near += 1
        met += bool((a == b).all(axis=1).any())
    return met / near


def test_measured_recall_at_the_least_similarity():
    assert measured_recall() >= 0.99


def test_very_long_texts(spark):
    chance = random.Random(1)
    long = ["w%d" % chance.randrange(10**6) for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join(varied(chance, long, 500))), (3, "short text")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_prefix_reaches_the_recall():
    s = jaccard.Settings()
    assert 1 - (1 - s.similarity ** s.prefix()) ** s.trees >= s.recall
    assert jaccard.Settings(recall=0.9).prefix() == s.depth


def test_signatures_estimate_the_similarity():
    s = jaccard.Settings(trees=64)
    a, b = np.arange(300, dtype=np.uint64) * np.uint64(77777), np.arange(60, 360, dtype=np.uint64) * np.uint64(77777)
    mixed = [jaccard.signature(jaccard._mix(x), jaccard._functions(s)) for x in (a, b)]
    assert abs((mixed[0] == mixed[1]).mean() - 240 / 360) < 0.1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 102), (102, 101)], "a int, b int")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(edges.where("false")).collect() == []
