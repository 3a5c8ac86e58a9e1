import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mektup import session
from mektup.config import Config
from mektup.functions import grambatch
from mektup.operators import tfidf
from mektup.plans import margin, training
from mektup.queries import mails


@pytest.fixture()
def machines(spark):
    pick = np.random.default_rng(5)
    x = pick.normal(size=(400, 6)) * (pick.random((400, 6)) < 0.7)
    label = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * pick.normal(size=400) > 0).astype(int)
    data = [(int(l), i % 2, Vectors.sparse(6, [(j, v) for j, v in enumerate(r) if v])) for i, (r, l) in enumerate(zip(x, label))]
    rows = spark.createDataFrame(data, ["label", "fold", "features"]).repartition(3)
    two = np.array([0, 1])
    return rows, margin.Problems(two, two, np.array([1.2, 0.9]), np.full(2, 0.5))


def passes(monkeypatch):
    seen, plain = [], margin.loss_and_gradient
    monkeypatch.setattr(margin, "loss_and_gradient", lambda *a, **k: seen.append(1) or plain(*a, **k))
    return seen


def test_machines_take_few_passes_over_all_rows(machines, monkeypatch):
    monkeypatch.setattr(margin, "JOINING", 40)
    seen = passes(monkeypatch)
    weights, progress = margin.fit_machines(*machines, 6, 500, 1e-8)
    assert progress.done.all() and len(seen) <= 8
    # rows that do not fit a task: passes alone, to the same minimum
    monkeypatch.setattr(margin, "SOLVED_ROWS", 0)
    alone, progress = margin.fit_machines(*machines, 6, 500, 1e-8)
    assert progress.done.all() and len(seen) > 20
    assert weights == pytest.approx(alone, abs=1e-5)


def test_machines_that_outgrow_a_task_go_on_with_passes(machines, monkeypatch):
    monkeypatch.setattr(margin, "JOINING", 10)
    monkeypatch.setattr(margin, "SOLVED_ROWS", 25)
    outgrown, progress = margin.fit_machines(*machines, 6, 500, 1e-8)
    assert progress.done.all()
    monkeypatch.undo()
    assert outgrown == pytest.approx(margin.fit_machines(*machines, 6, 500, 1e-8)[0], abs=1e-5)


def test_occurrences_give_the_same_vectors(spark):
    texts = ["elma armut " * 300 + "kiraz", "", None, "armut kiraz elma", "kiraz", "vişne"] * 3
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "mail_id long, text_clean string")
    model = tfidf.fit_tfidf(rows, Config(max_df=1.0))
    wide = tfidf.TfidfModel(model.config, {"w": [f"a{i}" for i in range(400)] + ["kiraz"], **{"c": model.terms["c"]}}, {"w": np.ones(401), "c": model.idf["c"]})
    for one in (model, wide):
        want = one.vectors(rows).orderBy("mail_id").select("tfidf").collect()
        assert one.from_occurrences(one.occurrences(rows)).orderBy("mail_id").select("tfidf").collect() == want


def test_the_feature_table_alone_stays_and_is_small(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    data = training.build_training_set(mails(spark, folder))
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["features"]
    entries = data.table.agg(F.sum(F.size(F.unwrap_udt("tfidf")["values"]))).first()[0]
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 4 * entries  # a weight alone takes 8


def test_texts_are_taken_in_pieces_of_bounded_size():
    texts = pa.array(["a" * 10, None, "b" * 30, "", "c" * 5, "d" * 5])
    assert [len(p) for p in grambatch.pieces(texts, 12)] == [2, 1, 3]
    assert pa.concat_arrays(list(grambatch.pieces(texts, 12))).equals(texts)


def test_vectors_leave_a_batch_in_pieces(spark, monkeypatch):
    seen = []
    weigher = grambatch.Weigher({"w": ["elma"]}, {"w": np.ones(1)}, True)
    monkeypatch.setattr(grambatch, "WEIGHED", 40)
    for texts in grambatch.pieces(pa.array(["elma armut"] * 20), grambatch.WEIGHED):
        seen.append(len(weigher.weigh(texts)[0]))
    assert max(seen) == 4 and sum(seen) == 20
