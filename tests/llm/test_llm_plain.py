"""Classifiers against plain versions: dictionaries, sums and trees walked node by node."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors

from mektup.llm import langid, quality, toxicity

WORDS = {
    "aa": ["kala", "vene", "talo", "sininen", "järvi", "metsä"],
    "bb": ["stone", "river", "house", "green", "water", "night"],
    "cc": ["pierre", "rivière", "maison", "verte", "l'eau", "nuit"],
}


def grams(text, sizes, bits, letters_only=False):
    """Hashed character n-grams, one at a time."""
    plain = " " + " ".join(text.lower().split()) + " "
    if letters_only:
        plain = re.sub(r"[^\W\d_]|(.)", lambda m: " " if m[1] else m[0], plain, flags=re.S)
        plain = re.sub(" +", " ", plain)
    found = []
    for n in sizes:
        for k in range(len(plain) - n + 1):
            h = 17
            for c in plain[k : k + n]:
                h = ((h ^ ord(c)) * 0x9E3779B1) % 2**32
                h ^= h >> 15
            found.append(((h * 0x85EBCA6B) % 2**32) >> (32 - bits))
    return found


def made(seed, count):
    chance = random.Random(seed)
    rows = []
    for k in range(count):
        lang = chance.choice(list(WORDS))
        rows.append((k, " ".join(chance.choices(WORDS[lang], k=chance.randint(2, 12))) + chance.choice([".", "!", " 12", ""]), lang))
    return rows


def test_language_by_plain_tfidf_and_cosine(spark):
    s = langid.Settings(centroids=1, bits=11)
    rows = made(1, 60)
    asked = made(2, 30) + [(100, "stone talo", None), (101, "12 !?", None), (102, None, None), (103, "", None)]
    schema = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame(rows, schema), s)
    counted = {i: {} for i, _, _ in rows}
    df = {}
    for i, text, _ in rows:
        for g in grams(text, s.sizes, s.bits, True):
            counted[i][g] = counted[i].get(g, 0) + 1
        for g in counted[i]:
            df[g] = df.get(g, 0) + 1

    def unit(counts):
        v = {g: math.log1p(n) * (math.log((1 + len(rows)) / (1 + df.get(g, 0))) + 1) for g, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    centres = {}
    for i, _, lang in rows:
        for g, x in unit(counted[i]).items():
            centres.setdefault(lang, {})[g] = centres.setdefault(lang, {}).get(g, 0.0) + x
    for lang, c in centres.items():
        norm = math.sqrt(sum(x * x for x in c.values()))
        centres[lang] = {g: x / norm for g, x in c.items()}
    found = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(asked, schema), model).collect()}
    for i, text, _ in asked:
        if not text or not any(map(str.isalpha, text)):
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
            continue
        counts = {}
        for g in grams(text, s.sizes, s.bits, True):
            counts[g] = counts.get(g, 0) + 1
        v = unit(counts)
        cosine = {lang: sum(x * c.get(g, 0.0) for g, x in v.items()) for lang, c in centres.items()}
        best = max(sorted(cosine), key=cosine.get)
        share = 1 / sum(math.exp(s.sharpness * (x - cosine[best])) for x in cosine.values())
        assert found[i]["lang_pred"] == best and found[i]["score"] == pytest.approx(share, abs=1e-3)


def test_toxicity_by_dictionary_counts(spark):
    s = toxicity.Settings(min_texts=3, bits=14)
    chance = random.Random(4)
    rows, labels = [], []
    for k in range(120):
        bad = k % 3 == 0
        words = chance.choices(WORDS["bb"] + ["you", "are"], k=8) + (["idiot"] if bad and chance.random() < 0.9 else [])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    rows += [(500, "not labelled idiot"), (501, None), (502, ""), (500, "the same id again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, label int"), s)
    counts = {}
    for k, label in labels:
        for g in set(grams(rows[k][1], s.sizes, s.bits)):
            counts.setdefault(g, [0, 0])[label] += 1
    kept = {g: n for g, n in counts.items() if sum(n) >= s.min_texts}
    ones, zeros = (sum(n[c] + s.smoothing for n in kept.values()) for c in (1, 0))
    ratio = {g: math.log((n[1] + s.smoothing) / ones) - math.log((n[0] + s.smoothing) / zeros) for g, n in kept.items()}
    used = np.flatnonzero(model.weights).tolist()
    assert used and set(used) <= {g for g, r in ratio.items() if r}
    # the gradient of the fit, n-gram by n-gram: no unused one exceeds the penalty
    margins = {k: model.constant + sum(float(model.weights[g]) for g in set(grams(rows[k][1], s.sizes, s.bits))) for k, _ in labels}
    of = [sum(y == c for _, y in labels) for c in (0, 1)]
    slope = {k: 0.5 / of[y] * (1 / (1 + math.exp(-margins[k])) - y) for k, y in labels}
    held = {k: set(grams(rows[k][1], s.sizes, s.bits)) for k, _ in labels}
    for g, r in ratio.items():
        if not model.weights[g]:
            assert abs(r * sum(slope[k] for k in held if g in held[k])) <= s.l1 * 1.1
    scored = [(r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()]
    want = []
    for k, text in rows:
        total = model.constant + sum(float(model.weights[g]) for g in set(grams(text or "", s.sizes, s.bits)))
        want.append((k, 1 / (1 + math.exp(-total))))
    assert sorted(k for k, _ in scored) == sorted(k for k, _ in want)
    assert np.allclose(sorted(x for _, x in scored), sorted(x for _, x in want), atol=1e-5)


def tree_nodes(lines, depth=0):
    """(condition or None, nodes below) of the branches at one level of a printed tree."""
    found = []
    while lines:
        line = lines[0]
        indent = len(line) - len(line.lstrip())
        if indent < depth or line.lstrip().startswith("Tree"):
            break
        lines.pop(0)
        match = re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if match:
            test = (int(match[1]), match[2], float(match[3]))
            found.append((test, tree_nodes(lines, indent + 1)))
    return found


def test_rules_are_the_nodes_that_a_row_passes(spark):
    pick = np.random.default_rng(3)
    x = pick.normal(size=(150, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    rows = spark.createDataFrame([(float(l), Vectors.dense(r)) for l, r in zip(y, x)], ["label", "features"])
    debug = RandomForestClassifier(numTrees=4, maxDepth=3, seed=1).fit(rows).toDebugString
    rules = quality.tree_rules(debug)
    lines = debug.splitlines()[1:]
    trees = []
    while lines:
        lines.pop(0)  # the tree's own line
        trees.append(tree_nodes(lines))
    assert len(trees) == 4

    def passed(branches, row, path):
        for (feature, side, threshold), below in branches:
            if (row[feature] <= threshold) == (side == "<="):
                path = [*path, (quality.STATISTICS[feature], side == ">", threshold)]
                yield path
                yield from passed(below, row, path)

    def merged(path):
        tight = {}
        for name, above, t in path:
            old = tight.get((name, above), t)
            tight[name, above] = max(old, t) if above else min(old, t)
        return tuple((n, a, t) for (n, a), t in sorted(tight.items()))

    for row in x[:40]:
        walked = {merged(p) for tree in trees for p in passed(tree, row, [])}
        named = dict(zip(quality.STATISTICS, row))
        held = {r for r in rules if all((named[n] > t) == above for n, above, t in r)}
        assert held == walked


def test_quality_score_by_plain_sums(spark):
    chance = random.Random(8)
    rows, labels = [], []
    for k in range(160):
        good = k % 2
        text = " ".join(chance.choices(WORDS["bb"], k=30)) + "." if good else "#$%& " * chance.randint(3, 30) + "x1 " * chance.randint(0, 9)
        rows.append((k, text))
        labels.append((k, good))
    rows += [(500, None), (501, ""), (None, "river stone. " * 20)]
    measured = quality.statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    model = quality.fit(measured, spark.createDataFrame(labels, "doc_id long, label int"))
    assert model.rules
    found = {r["doc_id"]: r["score"] for r in quality.score(measured, model).collect()}
    for own, text in rows:
        values = dict(zip(quality.STATISTICS, quality.measure(text or "")))
        total = model.constant + sum(w for rule, w in model.rules if all((values[n] > t) == above for n, above, t in rule))
        assert found[own] == pytest.approx(1 / (1 + math.exp(-total)))
    assert np.mean([(found[k] >= 0.5) == bool(y) for k, y in labels]) > 0.95
