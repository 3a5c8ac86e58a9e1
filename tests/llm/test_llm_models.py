"""Quality, language, toxicity, sharding and the pipeline: held-out accuracy, brute force and odd rows."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from mektup.llm import langid, ngrams, quality, sharding, toxicity
from mektup.llm.common import row_key
from mektup.llm.queries import language, rule_quality, shard, toxic

BIG = "/root/testdata/sf0.1"


def outcome(spark, query, column):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", column)
    rows = query(spark, BIG).where("held_out").join(labels, "doc_id").groupBy("predicted", column).count().collect()
    return {(r["predicted"], r[column]): r["count"] for r in rows}


def test_quality_on_held_out_documents(spark):
    seen = outcome(spark, rule_quality, "quality")
    assert seen.get((0, 1), 0) <= 0.005 * sum(n for (_, y), n in seen.items() if y == 1)
    assert seen.get((1, 0), 0) <= 0.05 * sum(n for (_, y), n in seen.items() if y == 0)


def test_toxicity_on_held_out_documents(spark):
    seen = outcome(spark, toxic, "toxic")
    assert seen.get((1, 0), 0) <= 0.01 * sum(n for (_, y), n in seen.items() if y == 0)
    assert seen.get((1, 1), 0) >= 0.6 * sum(n for (_, y), n in seen.items() if y == 1)  # 305 toxic rows to learn from


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang")
    rows = language(spark, BIG).where("held_out").join(docs, "doc_id").selectExpr("avg(int(lang = lang_pred)) AS share").first()
    assert rows["share"] > 0.98


def test_tree_paths_become_rules():
    tree = """RandomForestClassificationModel: uid=x
  Tree 0 (weight 1.0):
    If (feature 0 <= 5.0)
     If (feature 1 <= 0.5)
      Predict: 0.0
     Else (feature 1 > 0.5)
      If (feature 0 <= 2.0)
       Predict: 1.0
      Else (feature 0 > 2.0)
       Predict: 0.0
    Else (feature 0 > 5.0)
     Predict: 1.0
"""
    a, b = quality.STATISTICS[:2]
    assert set(quality.tree_rules(tree)) == {
        ((a, False, 5.0),), ((a, True, 5.0),), ((a, False, 5.0), (b, False, 0.5)), ((a, False, 5.0), (b, True, 0.5)),
        ((a, False, 2.0), (b, True, 0.5)), ((a, False, 5.0), (a, True, 2.0), (b, True, 0.5)),
    }


def test_compiled_rules_equal_their_sum(spark):
    model = quality.Model(((((("chars", True, 3.0), ("words", False, 2.0))), 1.5), ((("chars", False, 3.0),), -2.0)), 0.25)
    docs = spark.createDataFrame([(1, "ab"), (2, "abcdef"), (3, "a b c d"), (None, None), (5, "")], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in quality.score(quality.statistics(docs), model).collect()}
    for doc, total in ((1, 0.25 - 2), (2, 0.25 + 1.5), (3, 0.25), (None, 0.25 - 2), (5, 0.25 - 2)):
        assert found[doc] == pytest.approx(1 / (1 + np.exp(-total)))


def odd(spark):
    rows = [(None, "some words here", "en"), (2, None, None), (2, "", "en"), (4, "!? 12", None), (5, "wort " * 40_000, "de")]
    return spark.createDataFrame([(*r, 1.0, "s") for r in rows], "doc_id long, text string, lang string, score double, label string")


def test_odd_rows_and_no_labels(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, label int")
    measured = quality.statistics(docs)
    assert {r["score"] for r in quality.score(measured, quality.fit(measured, none)).collect()} == {0.5}
    one = spark.createDataFrame([(5, 1), (2, None), (None, 0)], "doc_id long, label int")
    assert all(0.5 < r["score"] <= 1 for r in quality.score(measured, quality.fit(measured, one)).collect())
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {0.5}
    found = langid.predict(docs, langid.fit(docs)).collect()
    by_text = [(r["doc_id"], r["lang_pred"]) for r in found]
    assert sorted(by_text, key=str) == sorted([(None, "en"), (2, "und"), (2, "und"), (4, "und"), (5, "de")], key=str)
    empty = docs.where("false")
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(empty, nothing).collect() == []
    assert toxicity.score(empty, toxicity.fit(empty, none)).collect() == []
    assert quality.statistics(empty).collect() == []


def test_ratios_against_their_formula():
    s = toxicity.Settings(min_texts=2)
    p, q = np.array([4.0, 0, 1, 0]), np.array([1.0, 5, 0, 1])
    r = toxicity.ratios(p, q, s)
    assert r[2] == r[3] == 0
    assert r[0] == pytest.approx(np.log((5 / 6) / (2 / 8))) and r[1] == pytest.approx(np.log((1 / 6) / (6 / 8)))


def test_lasso_meets_its_conditions():
    chance = np.random.default_rng(1)
    rows = [np.unique(chance.integers(0, 40, 12)).astype(np.int32) for _ in range(200)]
    labels = np.array([float(3 in x or 7 in x) for x in rows])
    r = chance.normal(size=64)
    s = toxicity.Settings(l1=0.005, rounds=20, steps=200)
    w, b = toxicity.fit_weights(rows, labels, r, s)
    x = np.zeros((200, 64))
    for k, v in enumerate(rows):
        x[k, v] = r[v]
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    g = x.T @ (share * (1 / (1 + np.exp(-(x @ w + b))) - labels))
    assert np.abs(g[w == 0]).max() <= s.l1 * 1.02
    assert np.abs(g[w != 0] + s.l1 * np.sign(w[w != 0])).max() < s.l1 * 0.1


def test_hashes_of_ngrams_repeat_with_the_ngram():
    points = ngrams.codes("abc  ABC\nxabc")
    one = ngrams.hashed(points, (3,), 16)
    assert len(one) == len(points) - 2 and one[1] == one[5]
    assert len(ngrams.hashed(ngrams.codes(""), (3,), 16)) == 0


def test_differencing_small_cases():
    assert sharding.difference([], 3) == []
    placed = sharding.difference([[8.0], [7.0], [6.0], [5.0], [4.0]], 2)
    sums = [sum(v for v, p in zip((8, 7, 6, 5, 4), placed) if p[0] == k) for k in range(2)]
    assert sorted(sums) == [14, 16]  # the textbook outcome of differencing
    chance = random.Random(2)
    loads = [[float(chance.randint(1, 1000)) for _ in range(chance.randint(1, 4))] for _ in range(300)]
    placed = sharding.difference(loads, 4)
    assert all(len(set(p)) == len(p) for p in placed)  # parts of one partial partition stay apart
    sums = [sum(v for x, p in zip(loads, placed) for v, s in zip(x, p) if s == k) for k in range(4)]
    assert max(sums) - min(sums) <= 10


def test_shards_of_documents(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = shard(spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    where, slots, sizes = {}, {}, [0] * 24
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
        assert where.setdefault(data, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = {}
    for r in rows:
        groups[texts[r["doc_id"]]] = groups.get(texts[r["doc_id"]], 0) + r["size"]
    assert max(sizes) - min(sizes) <= max(groups.values())


def test_groups_are_differenced_in_chunks():
    import pandas as pd

    groups = pd.DataFrame({"key": [bytes([k % 256, k // 256]) for k in range(900)], "bytes": [1 + (k * 7919) % 500 for k in range(900)]})

    class Here:
        partitionId = staticmethod(lambda: 3)

    real, sharding.TaskContext = sharding.TaskContext, type("T", (), {"get": staticmethod(lambda: Here)})
    try:
        found = list(sharding._differ_locally(4, 100)(iter([groups[:350], groups[350:]])))
    finally:
        sharding.TaskContext = real
    assert [len(f) for f in found][:3] == [100, 100, 100] and max(map(len, found)) <= 199
    assert sorted(k for f in found for k in f["key"]) == sorted(groups["key"]) and len({f["part"].iloc[0] for f in found}) == len(found)
    for f in found:
        sums = f.groupby("subset")["bytes"].sum()
        assert sums.max() - sums.min() <= f["bytes"].max()


def test_shards_of_odd_rows(spark):
    docs = odd(spark)
    found = sharding.assign(docs, 3).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in found), key=str) == sorted([(None, 23), (2, 8), (2, 8), (4, 13), (5, 200_008)], key=str)
    assert len({r["shard"] for r in found if r["size"] == 8}) == 1
    assert sharding.assign(docs.where("false"), 3).collect() == []


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert 0.7 * docs.count() <= len(rows) <= docs.count()
        docs = spark.createDataFrame(rows, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}
    assert sorted(tuple(r) for r in pieces if r["start"] == 0) != []


def test_pipeline_stages_on_odd_rows(spark, folder):
    """Null ids, one id with two texts, repeated rows and clashing columns, against plain rules; then an empty table."""
    from test_llm_decontaminate import brute as leaks
    from test_llm_jaccard import brute as near

    source = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"]) for r in source[:60]] + [(None, r["text"]) for r in source[40:90]]
    rows += [(r["doc_id"], source[(k * 7) % 100]["text"]) for k, r in enumerate(source[:30])] + [rows[3], rows[70], (7, None), (None, ""), (7, "")]
    names = "doc_id long, text string, _leak int, _low int, _gone int, key int, row int, score double"
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 0.0) for r in rows], names)
    stages = dict(corpus_pipeline.STAGES)

    def told(df):
        assert df.columns == docs.columns
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    low = {}
    for r in corpus_pipeline.quality_scores(spark, folder, docs).collect():
        low[r["key"]["none"], r["key"]["id"], r["key"]["hash"]] = r["score"] < corpus_pipeline.QUALITY_CUT
    kept = told(stages["quality classifier"](spark, docs, folder))
    assert len(kept) == sum(not low[r["k"]["none"], r["k"]["id"], r["k"]["hash"]] for r in docs.select(row_key().alias("k")).collect())

    def plain_exact(rows):
        groups = {}
        for own, text in rows:
            groups.setdefault(" ".join(re.split(r"[\x20\x09-\x0D]+", text or "")) if text else "", []).append((own is None, own or 0))
        return {(t, min(ids)) for t, ids in groups.items()}

    exact = told(stages["exact dedup"](spark, docs, folder))
    assert {(" ".join(re.split(r"[\x20\x09-\x0D]+", t or "")) if t else "", (i is None, i or 0)) for i, t in exact} == plain_exact(rows)
    assert len(exact) == len(plain_exact(rows))

    # the plain version knows rows by number
    classes = {k: c for k, c, _ in near([(k, t) for k, (_, t) in enumerate(rows)])}
    members = {}
    for k, (own, text) in enumerate(rows):
        if re.search(r"\w", text or ""):
            members.setdefault(classes[k], []).append((own is None, own or 0))
    found = told(stages["n-gram Jaccard join"](spark, docs, folder))
    worded = [(i is None, i or 0) for i, t in found if re.search(r"\w", t or "")]
    assert sorted(worded) == sorted(min(ids) for ids in members.values())
    assert len(found) - len(worded) == sum(not re.search(r"\w", t or "") for _, t in rows)

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {k for k, _ in leaks([(k, t) for k, (_, t) in enumerate(rows)], bench)}
    assert told(stages["benchmark decontamination"](spark, docs, folder)) == sorted((r for k, r in enumerate(rows) if k not in bad), key=str)

    pieces = stages["packing"](spark, docs, folder).collect()
    assert sum(r["start"] == 0 for r in pieces) == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0, name
