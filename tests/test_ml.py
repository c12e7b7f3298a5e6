"""Classifiers: training, scoring, saving."""

import random
import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from flowspark.operators import metrics, ml
from flowspark.operators.profile import FEATURES


@pytest.fixture(scope="module")
def dataset(spark):
    rng = random.Random(0)
    rows = []
    for i in range(120):
        attack = i % 2
        values = [rng.gauss(3 * attack, 1) if f.endswith("ratio") else rng.random() for f in FEATURES]
        rows.append((f"log_{i}", attack, *values))
    return spark.createDataFrame(rows, "log_name string, label int, " + ", ".join(f"{f} double" for f in FEATURES))


@pytest.mark.parametrize("model", ml.MODELS)
def test_learns_and_survives_saving(spark, dataset, model, tmp_path):
    fitted = ml.train(dataset, model)
    ml.save(fitted, str(tmp_path / model))
    got = {r.log_name: r.prediction for r in ml.predict(ml.load(str(tmp_path / model)), dataset).collect()}
    right = sum(got[r.log_name] == r.label for r in dataset.select("log_name", "label").collect())
    assert right >= 110


def test_comparison_has_one_row_per_model(dataset):
    rows = ml.compare(dataset, models=("svm",), train_on_all=True).collect()
    assert [(r.model, r.total) for r in rows] == [("svm", 120)] and rows[0].auc > 0.95
    training, test = ml.held_out(dataset)
    assert training.count() + test.count() == 120 and test.count() > 5


def test_gaussian_features_part_a_ring(spark, tmp_path):
    draw = np.random.default_rng(4)
    points = draw.normal(size=(900, 2))
    far = (points**2).sum(axis=1) > 1.3
    rows = [(f"p{i}", int(f), float(x), float(y)) for i, ((x, y), f) in enumerate(zip(points, far))]
    ring = spark.createDataFrame(rows, "log_name string, label int, x double, y double")
    training, test = ml.held_out(ring)
    right = {}
    for model in ("svm", "svm_rbf"):
        fitted = ml.train(training, model, ["x", "y"])
        ml.save(fitted, str(tmp_path / model))
        got = {r.log_name: r.prediction for r in ml.predict(ml.load(str(tmp_path / model)), test).collect()}
        assert got == {r.log_name: r.prediction for r in ml.predict(fitted, test).collect()}
        right[model] = np.mean([got[r.log_name] == r.label for r in test.collect()])
    assert right["svm_rbf"] > 0.95 and right["svm_rbf"] > right["svm"] + 0.15


def test_gaussian_features_approximate_the_kernel():
    draw = np.random.default_rng(5)
    points = draw.normal(size=(60, 30))
    for gamma in (0.0, 0.02, 0.3):
        distances = ((points[:, None] - points[None]) ** 2).sum(axis=2)
        exact = np.exp(-(gamma or 1 / 30) * distances)
        errors = []
        for cosines in (128, 8192):
            mapped = ml.fourier_features(points, gamma, cosines, 42)
            errors.append(np.abs(mapped @ mapped.T - exact).mean())
        assert errors[1] < 0.02 and errors[1] < errors[0] / 4


def test_forest_keeps_each_rows_nodes_and_its_trees(dataset):
    kept = ml.train(dataset, "random_forest").stages[-1]
    assert kept.getCacheNodeIds()
    plain = Pipeline(stages=[*ml._preparation(FEATURES), ml.classifier("random_forest").setCacheNodeIds(False)]).fit(dataset).stages[-1]
    assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees] == [t.toDebugString.split("\n", 1)[1] for t in plain.trees]


def test_a_models_rows_are_predicted_once(spark, dataset):
    predicted = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def said(score):
        predicted.add(1)
        return int(score > 0.5)

    rows = dataset.select("label", said("s0_ratio").alias("prediction"), F.col("s0_ratio").alias("score"), F.lit("m").alias("model"))
    found = metrics.evaluate(rows, ["model"]).collect()
    assert (found[0].model, found[0].total) == ("m", 120) and predicted.value == 120


def test_models_are_fitted_side_by_side(dataset, monkeypatch):
    dataset, whole = dataset.coalesce(1), ml.classifier
    monkeypatch.setattr(ml, "classifier", lambda m: whole(m).setMaxIter(3))
    wanted = {m: {tuple(r) for r in ml.train_and_score(dataset, m).collect()} for m in ("svm", "mlp")}
    train, both = ml.train, threading.Barrier(2, timeout=60)

    def waits(*args):
        both.wait()
        return train(*args)

    monkeypatch.setattr(ml, "train", waits)
    rows = []
    monkeypatch.setattr(metrics, "evaluate", lambda scored, keys: rows.extend(scored.collect()))
    ml.compare(dataset, ("svm", "mlp"))
    for model, own in wanted.items():
        assert {(r.log_name, r.label, r.prediction, r.score) for r in rows if r.model == model} == own
