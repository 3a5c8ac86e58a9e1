"""Queries whose time or largest task grew faster than it had to."""

import glob

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mektup.functions.text import SPACE, lower_text, text_metrics
from mektup.plans import boosting
from mektup.plans.boosting import Boosting, fit_boosted
from mektup.queries import QUERIES
from mektup.sources import mails


@pytest.mark.parametrize("name", ["scaled_metrics", "confusion_pivot", "confusion_long", "classification_report"])
def test_texts_are_cleaned_once(spark, folder, name, capsys):
    result = QUERIES[name](spark, folder)
    result.explain()
    plan = capsys.readouterr().out.lower()
    assert "regexp" not in plan and "rlike" not in plan and "documents.parquet" not in plan
    assert result.count() > 0


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mails, "CSV_FILE_ROWS", 10)
    rows = spark.createDataFrame([(i, "c", "s", f'line\n"{i}", x') for i in range(45)], "mail_id int, category string, subject string, body string")
    mails.write_mails(rows.coalesce(1), f"{tmp_path}/csv", "csv")
    files = glob.glob(f"{tmp_path}/csv/*.csv")
    assert len(files) == 5
    back = mails.read_mail_csv(spark, f"{tmp_path}/csv").collect()
    assert sorted((int(r["mail_id"]), r["body"]) for r in back) == [(i, f'line\n"{i}", x') for i in range(45)]


def test_dense_and_touched_cells_grow_the_same_trees(spark, monkeypatch):
    pick = np.random.default_rng(7)
    x = np.round(pick.normal(size=(200, 5)), 1) * (pick.random((200, 5)) < 0.7)
    rows = spark.createDataFrame(
        [(float((r[0] > 0) + (r[1] > 0.5)), Vectors.sparse(5, [(i, v) for i, v in enumerate(r) if v])) for r in x], ["label", "features"]
    ).repartition(3)
    grown = []
    for cells in (boosting.DENSE_CELLS, 0):
        monkeypatch.setattr(boosting, "DENSE_CELLS", cells)
        grown.append(fit_boosted(rows, 3, 5, Boosting(rounds=2, depth=3, bins=4))[0])
    assert (grown[0].feature == grown[1].feature).all() and np.allclose(grown[0].weight, grown[1].weight, atol=1e-5)


def test_letters_and_lower_case(spark):
    texts = ["İI Iİi ı", "İSTANBUL", "a b c  d\n\x1c", "", None, "😀 😀", " " * 3]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    old_lower = F.replace(F.lower(F.translate("t", "İI", "iı")), F.lit("i̇"), F.lit("i"))
    words = F.regexp_count("t", F.lit(f"[^{SPACE}]+"))
    old_mean = F.coalesce(F.length(F.regexp_replace("t", f"[{SPACE}]+", "")) / F.nullif(words, F.lit(0)), F.lit(0.0))
    for r in rows.select(old_lower.alias("a"), lower_text(F.col("t")).alias("b"), old_mean.alias("c"), text_metrics(F.col("t"))["mean_word_length"].alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"]
