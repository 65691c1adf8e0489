"""Classification metrics, ROC curves and areas, each from one pass over the scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from impactrec.functions.expressions import scores_array
from impactrec.functions.ordering import following_rows, running_totals
from impactrec.sources.schema import LABEL


def confusion(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)``; every metric below needs only this small table.

    Rows without a label are left out, as in training and in areas; ``unlabelled_rows`` counts them.
    """
    return df.where(F.col(label).isNotNull()).groupBy(
        F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def unlabelled_rows(df: DataFrame, label: str = LABEL) -> DataFrame:
    """``(n_rows, n_unlabelled)``: how many scored rows no metric covers."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label).isNull()).alias("n_unlabelled"))


def _ratio(a: Column, b: Column) -> Column:
    """``a / b``, and 0 where ``b`` is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def class_metrics(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Per class: ``tp``, ``predicted``, ``support``, ``n_rows``, ``precision``, ``recall``, ``f1``."""
    n, hit = F.col("n"), F.col("label") == F.col("prediction")
    roles = F.array(
        F.struct(F.col("label").alias("class"), n.alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(hit, n).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 n.alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )
    counts = (
        confusion(df, label, prediction)
        .select(F.inline(roles))
        .groupBy("class")
        .agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))
    )
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("support"))
    rated = counts.select(
        F.col("class").alias("label"), "tp", "predicted", "support",
        precision.alias("precision"), recall.alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", _ratio(2 * p * r, p + r))


def classification_metrics(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """One row: ``accuracy``, ``weighted_precision``, ``weighted_recall``, ``f1``, ``test_error``."""
    rows, support = F.sum("support"), F.col("support")
    accuracy = _ratio(F.sum("tp"), rows)
    return class_metrics(df, label, prediction).agg(
        accuracy.alias("accuracy"),
        _ratio(F.sum(F.col("precision") * support), rows).alias("weighted_precision"),
        _ratio(F.sum(F.col("recall") * support), rows).alias("weighted_recall"),
        _ratio(F.sum(F.col("f1") * support), rows).alias("f1"),
        (1 - accuracy).alias("test_error"),
    )


def _score_counts(df: DataFrame, scores: str, label: str, classes: Sequence[int] | None) -> DataFrame:
    """``(label, score, p, n)``: positives and negatives at every distinct score of every class.

    Slot ``k`` of the scores belongs to class ``k``; a row whose own class has no slot counts
    as a positive without a score. Rows are combined on the map side, so a score that many
    rows share travels as one row. One pass: the classes need not be known beforehand.
    """
    values, own = scores_array(df, scores), F.col(label).cast("int")
    unscored = (own < 0) | (own >= F.size(values))
    padded = F.when(unscored, F.concat(values, F.array(F.lit(None).cast("double")))).otherwise(values)
    slots = df.where(own.isNotNull()).select(
        own.alias("_own"), F.size(values).alias("_slots"), F.posexplode(padded).alias("_k", "score")
    )
    cells = slots.select(
        F.when(F.col("_k") == F.col("_slots"), F.col("_own")).otherwise(F.col("_k")).alias("label"), "_own", "score"
    )
    if classes is not None:
        cells = cells.where(F.col("label").isin([int(c) for c in classes]))
    hit = F.col("_own") == F.col("label")
    return cells.groupBy("label", "score").agg(F.count_if(hit).alias("p"), F.count_if(~hit).alias("n"))


def roc(
    df: DataFrame,
    scores: str = "probability",
    label: str = LABEL,
    classes: Sequence[int] | None = None,
    hard: bool = False,
    prediction: str = "prediction",
    corners: bool = False,
) -> DataFrame:
    """One-against-rest curve ``(label, threshold, fpr, tpr)`` at every distinct score of every class.

    The classes are those that occur, unless given. Slot ``k`` of the scores belongs to class
    ``k``. ``hard=True`` scores a row 1 for its predicted class and 0 otherwise, which the
    confusion table alone answers. A rate without rows behind it is NULL, and a class the
    model does not know has the one threshold NULL. The start of each curve, (0, 0), has an
    infinite threshold.

    ``corners=True`` leaves out the points between two steps of equal size, which lie on a straight
    line; the first and the last point stay. The area is the same.
    """
    if hard:
        return _hard_roc(df, label, prediction, classes)
    counts, order = _score_counts(df, scores, label, classes), [F.col("score").desc()]
    if corners:
        counts = following_rows(counts, ["label"], order, ["p", "n"])
    ranked = running_totals(counts, ["label"], order, ["p", "n"])
    if classes is None:
        ranked = ranked.where("total_p > 0")
    point = _point(
        F.col("score"),
        F.col("cum_n") / F.nullif(F.col("total_n"), F.lit(0)),
        F.col("cum_p") / F.nullif(F.col("total_p"), F.lit(0)),
    )
    is_first = (F.col("cum_p") == F.col("p")) & (F.col("cum_n") == F.col("n"))
    points = F.when(is_first, F.array(_origin(), point)).otherwise(F.array(point))
    if corners:
        straight = (F.col("next_p") == F.col("p")) & (F.col("next_n") == F.col("n"))
        ranked = ranked.where(is_first | ~F.coalesce(straight, F.lit(False)))
    return ranked.select("label", F.inline(points))


def _point(threshold: Column, fpr: Column, tpr: Column) -> Column:
    return F.struct(threshold.alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))


def _origin() -> Column:
    return _point(F.lit(float("inf")), F.lit(0.0), F.lit(0.0))


def _hard_rates(df: DataFrame, label: str, prediction: str, classes: Sequence[int] | None) -> DataFrame:
    """``(label, predicted, n_rows, fpr, tpr)`` where a row scores 1 for its predicted class, else 0."""
    whole = Window.partitionBy(F.lit(0))  # one row per class
    counted = class_metrics(df, label, prediction).select(
        F.col("label").cast("int").alias("label"), "tp", "predicted", "support",
        F.sum("support").over(whole).alias("n_rows"),
    )
    wanted = F.col("support") > 0 if classes is None else F.col("label").isin([int(c) for c in classes])
    return counted.where(wanted).select(
        "label", "predicted", "n_rows",
        ((F.col("predicted") - F.col("tp")) / F.nullif(F.col("n_rows") - F.col("support"), F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("support"), F.lit(0))).alias("tpr"),
    )


def _hard_roc(df: DataFrame, label: str, prediction: str, classes: Sequence[int] | None) -> DataFrame:
    rates = _hard_rates(df, label, prediction, classes)
    end = [F.when(F.col(c).isNotNull(), F.lit(1.0)) for c in ("fpr", "tpr")]
    points = F.array_compact(F.array(
        _origin(),
        F.when(F.col("predicted") > 0, _point(F.lit(1.0), F.col("fpr"), F.col("tpr"))),
        F.when(F.col("predicted") < F.col("n_rows"), _point(F.lit(0.0), *end)),
    ))
    return rates.select("label", F.inline(points))


def auc(
    df: DataFrame,
    scores: str = "probability",
    label: str = LABEL,
    classes: Sequence[int] | None = None,
    hard: bool = False,
    prediction: str = "prediction",
) -> DataFrame:
    """Area under the one-against-rest curve of each class that occurs, ties counted half.

    NULL for a class without positives, without negatives, or without scores. With
    ``hard=True`` the area follows from the confusion table alone.
    """
    if hard:
        area = (1 + F.col("tpr") - F.col("fpr")) / 2
        return _hard_rates(df, label, prediction, classes).select("label", area.alias("auc"))
    known = _score_counts(df, scores, label, classes).withColumn("known", F.col("score").isNotNull())
    ranked = running_totals(known, ["label"], [F.col("score").desc()], ["n"], keep=["p", "known"])
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    lower = F.col("total_n") - F.col("cum_n")
    pairs = F.nullif(F.sum(p) * F.sum(n), F.lit(0.0))
    areas = ranked.groupBy("label").agg(
        F.when(F.max("known"), F.sum(p * (lower + 0.5 * n)) / pairs).alias("auc"), F.sum("p").alias("positives")
    )
    return (areas if classes is not None else areas.where("positives > 0")).select("label", "auc")


def mean_auc(areas: DataFrame) -> DataFrame:
    """Plain mean over the classes that have an area, and how many those are."""
    return areas.agg(F.avg("auc").alias("mean_auc"), F.count("auc").alias("n_classes"))
