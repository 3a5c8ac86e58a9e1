import json

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mektup.config import Config
from mektup.operators import evaluate
from mektup.plans import calibration, margin, scoring, training
from mektup.queries import mails
from mektup.streaming.watch import watch

SMALL = Config(
    word_features=400, char_features=300, lr_iterations=30, svm_iterations=60, gbt_rounds=3, gbt_depth=2
)


@pytest.fixture(scope="module")
def compared(spark, folder):
    return training.compare_models(mails(spark, folder), SMALL)


def test_all_candidates(compared):
    summary = compared.summary.collect()
    assert {r["model"] for r in summary} == set(training.CANDIDATES)
    assert [r["f1_macro"] for r in summary] == sorted((r["f1_macro"] for r in summary), reverse=True)
    assert all(r["accuracy"] > 0.8 for r in summary)
    assert compared.best.model.name == summary[0]["model"]
    for t in compared.trained.values():
        for row in t.predictions.select("prediction", "probabilities", "top").collect():
            assert sum(row["probabilities"].values()) == pytest.approx(1.0)
            assert row["prediction"] == max(row["probabilities"], key=row["probabilities"].get)
            assert row["top"][0]["label"] == row["prediction"] and len(row["top"]) == 3


def test_reports_and_importance(compared, spark, tmp_path):
    for name, t in compared.trained.items():
        importance = training.feature_importance(t.model)
        if name == "Naive Bayes":
            assert importance is None
        else:
            values = [r["importance"] for r in importance.collect()]
            assert len(values) == 20 and values == sorted(values, reverse=True) and values[0] > 0
    evaluate.write_reports(str(tmp_path), compared.reports())
    assert spark.read.csv(f"{tmp_path}/model_comparison_metrics.csv", header=True).count() == 4


@pytest.mark.parametrize("name", list(training.CANDIDATES))
def test_artifact_round_trip(compared, spark, folder, tmp_path, name):
    model = compared.trained[name].model
    scoring.save_artifact(model, f"{tmp_path}/m")
    loaded = scoring.load_artifact(spark, f"{tmp_path}/m")
    assert loaded.labels == model.labels and loaded.name == name and loaded.config.word_ngrams == (1, 3)
    rows = mails(spark, folder).filter("mail_id < 40")
    before = {r["mail_id"]: r for r in scoring.score(rows, model).collect()}
    after = {r["mail_id"]: r for r in scoring.score(rows, loaded).collect()}
    assert len(before) == rows.count() and before.keys() == after.keys()
    for i, row in before.items():
        assert row["prediction"] == after[i]["prediction"]
        assert row["confidence"] == pytest.approx(after[i]["confidence"])


def test_missing_artifact_raises(spark, tmp_path):
    with pytest.raises(Exception):
        scoring.load_artifact(spark, f"{tmp_path}/none")


def test_score_one_and_fallback(compared, spark):
    model = compared.trained["Naive Bayes"].model
    label, probabilities = scoring.score_one(spark, "the and", "of the that with for", model)
    assert label in model.labels and sum(probabilities.values()) == pytest.approx(1.0)
    label, _ = scoring.score_one(spark, "the", "and of", model, min_confidence=1.1)
    assert label == "Diğer"


def machine_problem(spark):
    pick = np.random.default_rng(3)
    x = pick.normal(size=(60, 5)) * (pick.random((60, 5)) < 0.6)
    label = (x[:, 0] + 0.3 * pick.normal(size=60) > 0).astype(int)
    fold = np.arange(60) % 2
    data = [(int(l), int(f), Vectors.sparse(5, [(i, v) for i, v in enumerate(r) if v])) for r, l, f in zip(x, label, fold)]
    rows = spark.createDataFrame(data, ["label", "fold", "features"]).repartition(3)
    return x, label, fold, rows


def test_machines_reach_the_minimum(spark):
    x, label, fold, rows = machine_problem(spark)
    problems = margin.Problems(
        fold=np.array([0, 0, 1, 1]), label=np.array([0, 1, 0, 1]), weight=np.array([1.3, 0.8, 1.0, 2.0]), smaller_side=np.full(4, 0.5)
    )
    weights, progress = margin.fit_machines(rows, problems, 5, 200, 1e-8)
    assert progress.done.all()
    few, short = margin.fit_machines(rows, problems, 5, 1, 1e-8)
    assert not short.done.any() and not np.allclose(few, weights)
    xb = np.column_stack([x, np.ones(60)])
    for m in range(4):
        w = np.zeros(6)
        keep, side = fold != problems.fold[m], np.where(label == problems.label[m], 1.0, -1.0)
        c = np.where(side > 0, problems.weight[m], 1.0) * keep
        for _ in range(100):  # Newton on the squared hinge
            active = (side * (xb @ w) < 1) * c
            g = w + 2 * xb.T @ (active * (xb @ w - side))
            w = w - np.linalg.solve(np.eye(6) + 2 * xb.T @ (active[:, None] * xb), g)
        assert weights[m] == pytest.approx(w, abs=1e-5)


def test_sigmoids_reach_the_minimum(spark):
    pick = np.random.default_rng(5)
    label = pick.integers(0, 2, 400)
    score = pick.normal(size=400) + 1.5 * label
    rows = spark.createDataFrame(
        [(int(i % 2), int(l), [float(-s), float(s)]) for i, (l, s) in enumerate(zip(label, score))],
        "fold int, label int, scores array<double>",
    )
    fitted = calibration.fit_sigmoids(rows)
    for fold in (0, 1):
        s, y = score[fold::2], label[fold::2]
        p, n = y.sum(), (1 - y).sum()
        t = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
        a, b = fitted[fold, 1]
        q = 1 / (1 + np.exp(a * s + b))
        assert abs(np.sum((t - q) * s)) < 1e-4 and abs(np.sum(t - q)) < 1e-4 and a < 0


def land(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


def message(i, subject, body):
    return {"ID": i, "Content": {"Headers": {"Subject": [subject]}, "Body": body}}


def test_stream_scores_each_message_once(compared, spark, tmp_path):
    model = compared.trained["Naive Bayes"].model
    landing, log = tmp_path / "in", f"{tmp_path}/log"

    def run():
        watch(spark, str(landing), log, f"{tmp_path}/checkpoint", model, None).awaitTermination()
        return spark.read.json(log)

    land(landing, "1.json", [message("a", "the", "of and " * 300), message("a", "the", "again"), message("b", "der", "und die")])
    assert run().count() == 2
    land(landing, "2.json", [message("a", "repeat", "after restart"), message("c", "los", "que las"), {"Content": {}}])
    records = run()
    assert sorted(r["mail_id"] for r in records.collect()) == ["a", "b", "c"]
    assert records.agg(F.max(F.length("body"))).first()[0] == 500
    assert set(records.columns) >= {"processed_at", "mail_id", "subject", "body", "prediction", "probabilities"}


def test_log_holds_each_message_once_after_a_kill(compared, spark, tmp_path):
    """A batch whose commit is lost runs again: the state and the log take it once."""
    model = compared.trained["Naive Bayes"].model
    landing, log, checkpoint = tmp_path / "in", f"{tmp_path}/log", tmp_path / "checkpoint"

    def run():
        watch(spark, str(landing), log, str(checkpoint), model, None).awaitTermination()
        return sorted(r["mail_id"] for r in spark.read.json(log).collect())

    land(landing, "1.json", [message("a", "the", "of and"), message("b", "der", "und die")])
    assert run() == ["a", "b"]
    land(landing, "2.json", [message("b", "again", "und die"), message("c", "los", "que las")])
    assert run() == ["a", "b", "c"]
    for commit in (checkpoint / "commits").iterdir():  # killed after the last batch was written
        if commit.name.strip(".").startswith("1"):
            commit.unlink()
    assert run() == ["a", "b", "c"]
    land(landing, "3.json", [message("a", "late", "of and"), message("d", "le", "les")])
    assert run() == ["a", "b", "c", "d"]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert list((checkpoint / "state").rglob("*.zip"))  # as the store on disk keeps it


def test_scope_leaves_nothing_behind(spark, folder):
    import os

    from mektup.queries import QUERIES
    from mektup.session import shared_dir

    base = shared_dir(spark)
    before = set(os.listdir(base))
    assert QUERIES["evaluation_tables"](spark, folder).count() > 0
    assert set(os.listdir(base)) == before
