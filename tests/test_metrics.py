import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from impactrec.functions import slot
from impactrec.operators import auc, class_metrics, classification_metrics, confusion, mean_auc, roc, unlabelled_rows

SPARK_NAMES = {
    "accuracy": "accuracy", "weighted_precision": "weightedPrecision",
    "weighted_recall": "weightedRecall", "f1": "f1",
}


def test_one_pass_agrees_with_the_evaluator(scores):
    ours = classification_metrics(scores).first()
    for name, metric in SPARK_NAMES.items():
        judge = MulticlassClassificationEvaluator(labelCol="EI", metricName=metric)
        assert ours[name] == pytest.approx(judge.evaluate(scores))
    assert ours.test_error == pytest.approx(1 - ours.accuracy)


def test_a_class_never_predicted_has_no_precision(scores):
    row = class_metrics(scores).where("label = 3").first()
    assert (row.predicted, row.precision, row.recall, row.f1) == (0, 0.0, 0.0, 0.0) and row.support > 0


def test_confusion_is_complete(scores):
    assert confusion(scores).agg(F.sum("n")).first()[0] == 2000


def test_auc_agrees_with_the_evaluator(scores):
    ours = {r.label: r.auc for r in auc(scores).collect()}
    for k in range(1, 6):
        judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="hit", numBins=0)
        one = scores.select(slot(scores, "probability", k).alias("score"), (F.col("EI") == k).cast("double").alias("hit"))
        assert ours[k] == pytest.approx(judge.evaluate(one))
    assert mean_auc(auc(scores)).first().mean_auc == pytest.approx(np.mean(list(ours.values())))


def test_vectors_and_arrays_give_the_same(scores):
    vectors = scores.withColumn("probability", array_to_vector("probability"))
    assert sorted(map(tuple, auc(vectors).collect())) == sorted(map(tuple, auc(scores).collect()))


def test_curve_is_monotone_and_its_area_is_the_auc(scores):
    for hard in (False, True):
        areas = {r.label: r.auc for r in auc(scores, hard=hard).collect()}
        points = roc(scores, hard=hard).collect()
        for k, area in areas.items():
            curve = sorted(((p.threshold, p.fpr, p.tpr) for p in points if p.label == k), reverse=True)
            fpr, tpr = [p[1] for p in curve], [p[2] for p in curve]
            assert curve[0] == (float("inf"), 0.0, 0.0) and curve[-1][1:] == (1.0, 1.0)
            assert fpr == sorted(fpr) and tpr == sorted(tpr)
            assert np.trapezoid(tpr, fpr) == pytest.approx(area)


def test_a_class_the_model_does_not_know(spark):
    rows = [(1, [0.0, 0.9], 1.0), (1, [0.0, 0.4], 1.0), (7, [0.0, 0.2], 1.0)]
    table = spark.createDataFrame(rows, "EI int, probability array<double>, prediction double")
    areas = {r.label: r.auc for r in auc(table).collect()}
    assert areas == {1: 1.0, 7: None}
    assert tuple(mean_auc(auc(table)).first()) == (1.0, 1)
    only = {r.label: r.auc for r in auc(table.where("EI = 1")).collect()}
    assert only == {1: None}


def test_a_third_of_the_rows_share_a_score(spark):
    draw = np.random.default_rng(5)
    score = np.where(draw.random(900) < 0.34, 0.5, draw.random(900))
    label = (draw.random(900) < 0.3 + 0.4 * score).astype(int)
    rows = [(int(y), [float(1 - s), float(s)]) for y, s in zip(label, score)]
    table = spark.createDataFrame(rows, "EI int, probability array<double>").repartition(11)
    pos, neg = score[label == 1], score[label == 0]
    expected = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert auc(table, classes=[1]).first().auc == pytest.approx(expected)


def test_rows_without_a_label_are_left_out(spark):
    rows = [(1, 1.0), (2, 2.0), (None, 1.0), (None, 2.0)]
    table = spark.createDataFrame(rows, "EI int, prediction double")
    assert classification_metrics(table).first().accuracy == 1.0
    assert unlabelled_rows(table).first().n_unlabelled == 2


def test_corners_keep_the_area(spark):
    """Points on straight lines go, the first and last stay, and the curve between them is the same."""
    scores = [0.9, 0.9, 0.8, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]
    labels = [1, 0, 1, 0, 1, 1, 0, 0, 0, 1, 0]
    rows = [(y, [1 - s, s]) for s, y in zip(scores, labels)]
    table = spark.createDataFrame(rows, "EI int, probability array<double>")
    curve = sorted((-r.threshold, r.fpr, r.tpr) for r in roc(table, classes=[1]).collect())
    cut = sorted((-r.threshold, r.fpr, r.tpr) for r in roc(table, classes=[1], corners=True).collect())
    kept = [-t for t, _, _ in cut[1:]]
    assert kept == [0.9, 0.8, 0.6, 0.3, 0.2, 0.1] and set(cut) <= set(curve)

    def area(points):
        return sum((b[1] - a[1]) * (a[2] + b[2]) / 2 for a, b in zip(points, points[1:]))

    assert area(cut) == pytest.approx(area(curve))
