"""Decontamination against a plain comparison of all positions."""

import random

from mektup.llm import decontaminate as d


def brute(docs, items, seeds=d.Seeds()):
    """Pairs with a window of `span` words (or the whole shorter item) whose equal share suffices."""
    found = set()
    for doc, text in docs:
        a = d.words(text or "")
        for item, passage in items:
            b = d.words(passage or "")
            need = min(seeds.span, len(b))
            if len(b) < seeds.least:
                continue
            for i in range(len(a) - need + 1):
                for j in range(len(b) - need + 1):
                    if sum(x == y for x, y in zip(a[i : i + need], b[j : j + need])) >= seeds.share * need:
                        found.add((doc, item))
    return found


def made(chance, count):
    return [chance.choice("abcdefghijklmnopqrstuvwxyz") + chance.choice("aeiou") + chance.choice("rstln") for _ in range(count)]


def test_against_brute_force(spark):
    chance = random.Random(5)
    items = [(i, " ".join(made(chance, n))) for i, n in enumerate([14, 20, 7, 5, 3, 30])]
    docs = []
    for doc in range(60):
        words = made(chance, chance.randint(0, 40))
        passage = items[doc % 6][1].split()
        at = chance.randint(0, max(0, len(passage) - 12))
        passage = passage[at : at + chance.randint(10, 30)]
        for _ in range(chance.randint(0, 3)):
            passage[chance.randrange(len(passage))] = "zzz"
        docs.append((doc, " ".join(words + (passage if doc % 3 else []) + made(chance, 5))))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, items[1][1].upper().replace(" ", ",\n")), (102, items[0][1])]
    table = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items + [(9, None), (10, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.overlaps(table, bench).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 20
    blocks = d.overlaps(table, bench, d.Seeds(block_chars=100))
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == want
    kept = d.drop_leaks(table, bench)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(a for a, _ in docs if a not in {x for x, _ in want})


def test_nulls_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "so one two three four five six seven ends"), (2, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in d.overlaps(docs, bench).collect()] == [None]
    assert [r["doc_id"] for r in d.drop_leaks(docs, bench).collect()] == [2]
    assert d.overlaps(docs.where("false"), bench).collect() == []
    assert d.overlaps(docs, bench.where("false")).collect() == []
    assert d.drop_leaks(docs, bench.where("false")).count() == 2


def test_every_pair_of_substitutions_is_ignored_by_a_mask():
    seeds = d.Seeds()
    for a in range(seeds.span):
        for b in range(seeds.span):
            assert any(a not in m and b not in m for m in seeds.masks())


def test_tail_of_a_long_item_after_empty_and_short_documents():
    chance = random.Random(11)
    words = [f"w{k}" for k in range(56)]
    index = d.Index([(7, " ".join(words))], d.Seeds())
    for before in (["x " * 30, ""], ["", "", ""], ["x y", "", "z"], ["x " * 5] * 6, [" ".join(words[:20]), ""], []):
        for first in (0, 1, 12, 30, 44):
            docs = before + [" ".join(words[first:] + made(chance, 8)), "", "end"]
            found = {(r[0], r[1]): r[2:] for r in index.search(list(range(len(docs))), docs)}
            assert found.pop((len(before), 7)) == (56 - first, 56 - first, 0, first)
            assert {k for k, _ in found} == {k for k, text in enumerate(before) if len(d.words(text)) == 20}


def test_substituted_ends_of_a_fragment_at_the_edge_of_a_document():
    words = [f"w{k}" for k in range(40)]
    index = d.Index([(7, " ".join(words))], d.Seeds())
    for at in range(12):
        part = words[28:]
        part[at] = "other"
        assert [r[:3] for r in index.search([1, 2, 3], ["", " ".join(part), ""])] == [(2, 7, 11)]


def test_repeated_words_against_brute_force(spark):
    chance = random.Random(21)
    few = ["x", "y", "z"]
    items = [(0, "x " * 30), (1, "x y " * 20), (2, " ".join(chance.choices(few, k=40))), (3, "x " * 12 + "y " * 3), (4, "one two three four"), (5, "hi")]
    docs = [(k, " ".join(chance.choices(few[: chance.randint(1, 3)], k=chance.randint(0, 80)))) for k in range(40)]
    docs += [(90, "so one two three four ends"), (91, "hi"), (92, "hi there")]
    for seeds in (d.Seeds(), d.Seeds(pairs=3, batch_words=40)):
        table = spark.createDataFrame(docs, "doc_id long, text string")
        rows = d.overlaps(table, spark.createDataFrame(items, "item_id long, text string"), seeds).collect()
        want = brute(docs, items, seeds) | {(91, 5)}
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(want) > 40


def test_very_many_equal_words_take_seconds():
    import time

    index = d.Index([(1, "x " * 2000)], d.Seeds())
    start = time.perf_counter()
    assert list(index.search([5], ["x " * 200_000])) == [(5, 1, 2000, 2000, 0, 0)]
    assert time.perf_counter() - start < 20


def test_differences_by_correlation():
    import numpy as np

    chance = np.random.default_rng(3)
    for _ in range(30):
        a, b = (np.unique(chance.integers(0, 500, chance.integers(1, 200))) for _ in range(2))
        assert d.differences(a, b, 0).tolist() == np.unique(np.subtract.outer(a, b)).tolist()


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "what is four plus"), (2, "東京は日本の首都です。"), (3, "hi there")]
    docs = [(1, "What is four, plus!"), (2, "ここで東京は日本の首都です、と言う"), (3, "hi there"), (4, "oh hi there you"), (5, "what is plus four"), (6, "東京")]
    found = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_leaks_are_told_apart_by_id_and_text(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, item), (1, "a clean text under the same id"), (None, item + " more"), (None, "a clean text without an id"), (2, None), (2, None)]
    docs = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "doc_id long, text string, _leak int, key int, row int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = d.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["text"] or "") for r in kept.collect()) == ["", "", "a clean text under the same id", "a clean text without an id"]
