"""Feature selection and principal components."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    PCA,
    ElementwiseProduct,
    OneHotEncoder,
    QuantileDiscretizer,
    StandardScaler,
    UnivariateFeatureSelector,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window, functions as F

from impactrec.operators.encode import MAX_CATEGORIES, string_indexer
from impactrec.operators.stats import chi_square_test
from impactrec.sources.schema import KEY, LABEL, categorical_columns, numeric_columns, slot_names


def feature_pipeline(
    df: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    label: str = LABEL,
    handle_invalid: str = "keep",
    encode: bool = True,
    k: int | None = 15,
    bins: int | None = None,
) -> Pipeline:
    """Index, optionally one-hot encode, assemble, and keep the ``k`` features best by chi-square.

    The categories are those of ``df``. The test takes every distinct number as a category, and
    Spark's own test, the stage that ``k`` adds, refuses a column of more than 10,000; ``bins``
    first cuts the numeric columns into that many quantile bins. ``select_features`` has no limit.
    """
    stages, inputs, categories = [], list(numeric), []
    if categorical:
        categories = [f"{c}_index" for c in categorical]
        stages += string_indexer(df, categorical, handle_invalid).stages
        if encode:
            encoded = [f"{c}_encoded" for c in categorical]
            stages.append(OneHotEncoder(inputCols=categories, outputCols=encoded))
            categories = encoded
    if bins and numeric:
        inputs = [f"{c}_binned" for c in numeric]
        stages.append(
            QuantileDiscretizer(inputCols=list(numeric), outputCols=inputs, numBucketsArray=[bins] * len(inputs))
        )
    stages.append(VectorAssembler(inputCols=categories + inputs, outputCol="features"))
    if k:
        selector = UnivariateFeatureSelector(
            featuresCol="features", labelCol=label, outputCol="selectedFeatures", selectionMode="numTopFeatures"
        )
        stages.append(
            selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(k)
        )
    return Pipeline(stages=stages)


class Selection(NamedTuple):
    model: PipelineModel
    table: DataFrame
    names: list[str]


def select_features(
    df: DataFrame,
    categorical: Sequence[str] | None = None,
    numeric: Sequence[str] | None = None,
    label: str = LABEL,
    k: int = 15,
    key: str = KEY,
    bins: int | None = None,
) -> Selection:
    """Keep the ``k`` slots with the least p-value, one-hot slots included; ``names`` are these.

    Every distinct value is a category, whatever their number, unless ``bins`` cuts the numbers.
    Ties go to the greater statistic, then to the earlier slot. Rows without a label are not tested.
    """
    categorical = categorical_columns(df) if categorical is None else categorical
    numeric = numeric_columns(df, (key, label)) if numeric is None else numeric
    model = feature_pipeline(df, categorical, numeric, label, k=None, bins=bins).fit(df)
    slots = slot_names(model.transform(df), "features")
    values = vector_to_array(F.col("features"))
    columns = [f"s{i}" for i in range(len(slots))]
    labelled = model.transform(df).where(F.col(label).isNotNull())
    cells = labelled.select(F.col(label).alias("_label"), *[values[i].alias(c) for i, c in enumerate(columns)])
    tested = {r.feature: (r.p_value, -r.statistic) for r in chi_square_test(cells, columns, "_label").collect()}
    best = sorted(range(len(slots)), key=lambda i: (*tested.get(columns[i], (1.0, 0.0)), i))
    chosen = sorted(best[:k])
    slicer = VectorSlicer(inputCol="features", outputCol="selectedFeatures", indices=chosen)
    model = PipelineModel([*model.stages, slicer])
    return Selection(model, model.transform(df), [slots[i] for i in chosen])


class Components(NamedTuple):
    scores: DataFrame
    variance: DataFrame
    loadings: DataFrame


def pca_inputs(df: DataFrame, exclude: Sequence[str] = (KEY, LABEL)) -> tuple[DataFrame, list[str]]:
    """Index the string columns; return the table and its columns to analyse, indices first."""
    strings, numbers = categorical_columns(df, exclude), numeric_columns(df, exclude)
    if strings:
        df = string_indexer(df, strings, "keep", max_categories=MAX_CATEGORIES).transform(df)
    return df, [f"{c}_index" for c in strings] + numbers


def pca(df: DataFrame, cols: Sequence[str], k: int | None = None) -> Components:
    """Principal components of the scaled columns; all of them unless ``k`` is given.

    Only the columns-by-columns covariance reaches the driver.
    ``variance`` is ``(component, ratio, cumulative)``; ``loadings`` is
    ``(component, feature, loading)`` with components counted from 1.
    """
    names = list(cols)
    stages = [
        VectorAssembler(inputCols=names, outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled_features", withStd=True, withMean=False),
        PCA(k=k or len(names), inputCol="scaled_features", outputCol="_pca_unturned"),
    ]
    model = Pipeline(stages=stages).fit(df)
    fitted = model.stages[-1]
    spark = df.sparkSession
    ratios = [(i + 1, float(v)) for i, v in enumerate(fitted.explainedVariance)]
    weights = fitted.pc.toArray()
    # A component is as good with its sign changed: the largest loading is positive, in the scores as well.
    signs = np.sign(weights[np.abs(weights).argmax(axis=0), np.arange(weights.shape[1])])
    weights = weights * signs
    turn = ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol="_pca_unturned", outputCol="pca_features")
    loadings = [
        (component + 1, name, float(weights[row, component]))
        for component in range(weights.shape[1])
        for row, name in enumerate(names)
    ]
    return Components(
        turn.transform(model.transform(df)).drop("_pca_unturned"),
        cumulative_variance(spark.createDataFrame(ratios, "component int, ratio double")),
        spark.createDataFrame(loadings, "component int, feature string, loading double"),
    )


def cumulative_variance(variance: DataFrame) -> DataFrame:
    """Add the running total of ``ratio``; the table has one row per component."""
    upto = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return variance.select("component", "ratio", F.sum("ratio").over(upto).alias("cumulative"))


def components_for(variance: DataFrame, threshold: float = 0.95) -> DataFrame:
    """The first component at which the cumulative ratio reaches the threshold, else NULL."""
    reached = F.when(F.col("cumulative") >= threshold, F.col("component"))
    return variance.agg(F.min(reached).alias("k"))
