"""Tree classifiers: training, scoring and inspection."""

from __future__ import annotations

import re
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from impactrec.operators.encode import MAX_CATEGORIES, string_indexer
from impactrec.sources.schema import KEY, LABEL, model_columns
from impactrec.staging import checkpoint_root

# The published model settings.
DEFAULT_PARAMS: dict[str, dict[str, Any]] = {
    "dt": dict(maxDepth=20, minInstancesPerNode=1, minInfoGain=0.01, impurity="entropy"),
    "rf": dict(
        numTrees=50, maxDepth=15, maxBins=30, featureSubsetStrategy="all", subsamplingRate=0.8,
        minInstancesPerNode=2, minInfoGain=0.01,
    ),
    "ovr_gbt": dict(
        maxDepth=20, maxIter=15, maxBins=30, subsamplingRate=0.8, stepSize=0.2,
        minInstancesPerNode=1, minInfoGain=0.01, featureSubsetStrategy="all",
    ),
}

_CLASSIFIERS = {"dt": DecisionTreeClassifier, "rf": RandomForestClassifier, "ovr_gbt": GBTClassifier}
_WHOLE_NUMBERS = {"numTrees", "maxDepth", "maxBins", "minInstancesPerNode", "maxIter"}
_SPARK_MAX_BINS = 32
_MODELS_AT_ONCE = 8


def feature_model(
    df: DataFrame,
    label: str = LABEL,
    key: str = KEY,
    feature_mode: str = "all_numeric",
    handle_invalid: str = "skip",
    max_categories: int | None = MAX_CATEGORIES,
) -> PipelineModel:
    """Fitted stages from a product table to its ``features`` vector.

    The model holds the categories on the driver; more than ``max_categories`` in a column are an error.
    """
    strings, numbers = model_columns(df, feature_mode, (key, label))
    stages = []
    if strings:
        stages += string_indexer(df, strings, handle_invalid, "Index", max_categories).stages
    inputs = [f"{c}Index" for c in strings] + numbers
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return PipelineModel(stages)


def bins_needed(features: PipelineModel) -> int:
    """The number of values of the largest nominal feature, which ``maxBins`` must reach."""
    sizes = [0]
    for stage in features.stages:
        if isinstance(stage, StringIndexerModel):
            sizes.append(len(stage.labels) + (stage.getHandleInvalid() == "keep"))
    return max(sizes)


def class_values(df: DataFrame, label: str = LABEL) -> list[int]:
    """The classes present, in order. A model keeps them all, so they are few by nature."""
    known = df.select(label).where(F.col(label).isNotNull()).distinct()
    return sorted(int(r[0]) for r in known.collect())


def _with_classes(df: DataFrame, column: str, count: int) -> DataFrame:
    """Declare the number of classes, so that no fit has to scan for it."""
    attribute = {"ml_attr": {"type": "nominal", "num_vals": count}}
    return df.withColumn(column, F.col(column).cast("double")).withMetadata(column, attribute)


def classifier(algo: str, params: dict[str, Any] | None, seed: int, label: str, min_bins: int = 0):
    """An unfitted classifier with the default settings, ``params`` on top, and enough bins.

    Settings that count something are cut to whole numbers, as a sampler may draw floats.
    """
    if algo not in _CLASSIFIERS:
        raise ValueError(f"algo must be one of {sorted(_CLASSIFIERS)}")
    settings = {**DEFAULT_PARAMS[algo], **(params or {})}
    settings = {k: int(v) if k in _WHOLE_NUMBERS else v for k, v in settings.items()}
    settings["maxBins"] = max(settings.get("maxBins", _SPARK_MAX_BINS), min_bins)
    return _CLASSIFIERS[algo](featuresCol="features", labelCol=label, seed=seed, **settings)


def fit_classifier(
    prepared: DataFrame, algo: str, params: dict[str, Any] | None, seed: int, label: str, min_bins: int,
    parallelism: int | None = None, classes: list[int] | None = None,
) -> list:
    """Fit on a table with ``features`` and the label; returns the stages that score.

    ``classes`` are looked up unless given.
    """
    rows = prepared.select("features", label).where(F.col(label).isNotNull())
    classes = classes or class_values(rows, label)
    if algo != "ovr_gbt":
        fitted = classifier(algo, params, seed, label, min_bins).fit(
            _with_classes(rows, label, classes[-1] + 1)
        )
        return [fitted]

    # One binary model per class that occurs: classes are numbered from 0 for training, and
    # the predicted number is turned back into its class by the last stage.
    checkpoint_root(prepared.sparkSession)
    values = "array(" + ",".join(str(c) for c in classes) + ")"
    numbered = rows.select("features", F.expr(f"array_position({values}, int({label})) - 1").alias("_class"))
    one_vs_rest = OneVsRest(
        classifier=classifier(algo, params, seed, "_class", min_bins),
        featuresCol="features",
        labelCol="_class",
        predictionCol="_class_found",
        parallelism=parallelism or min(len(classes), _MODELS_AT_ONCE),
    )
    back = SQLTransformer(
        statement=f"SELECT * EXCEPT (_class_found), "
        f"CAST(element_at({values}, int(_class_found) + 1) AS DOUBLE) AS prediction FROM __THIS__"
    )
    return [one_vs_rest.fit(_with_classes(numbered, "_class", len(classes))), back]


def train(
    df: DataFrame,
    algo: str = "rf",
    params: dict[str, Any] | None = None,
    seed: int = 42,
    label: str = LABEL,
    key: str = KEY,
    feature_mode: str = "all_numeric",
    handle_invalid: str = "skip",
    parallelism: int | None = None,
) -> PipelineModel:
    """Fit index, assemble and classifier stages: ``dt``, ``rf`` or ``ovr_gbt``.

    The input is read several times; pass a staged table, not an expensive plan.
    """
    features = feature_model(df, label, key, feature_mode, handle_invalid)
    prepared = features.transform(df)
    fitted = fit_classifier(prepared, algo, params, seed, label, bins_needed(features), parallelism)
    return PipelineModel([*features.stages, *fitted])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def skipped_rows(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``(n_rows, n_skipped)``: how many rows scoring leaves out for a NULL or unseen value."""
    unknown = F.lit(False)
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel) and stage.getHandleInvalid() == "skip":
            column = F.col(stage.getInputCol())
            unknown = unknown | column.isNull() | ~column.isin(*stage.labels)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(unknown).alias("n_skipped"))


def aligned_scores(scored: DataFrame, classes: list[int], raw: str = "rawPrediction") -> DataFrame:
    """Add ``class_scores``, an array whose slot is the class, from one-vs-rest raw scores."""
    values = vector_to_array(F.col(raw))
    slots = [
        F.get(values, F.lit(classes.index(c))) if c in classes else F.lit(None).cast("double")
        for c in range(max(classes) + 1)
    ]
    return scored.withColumn("class_scores", F.array(*slots))


def model_classes(model: PipelineModel) -> list[int]:
    """The classes a one-vs-rest model was trained on, in the order of its raw scores."""
    back = next(s for s in model.stages if isinstance(s, SQLTransformer))
    return [int(c) for c in re.search(r"array\(([^)]*)\)", back.getStatement())[1].split(",")]


def model_stages(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``(position, stage, input_column)`` of every stage of a fitted pipeline."""
    rows = []
    for i, stage in enumerate(model.stages):
        if stage.hasParam("inputCols") and stage.isDefined("inputCols"):
            inputs = stage.getInputCols()
        elif stage.hasParam("inputCol") and stage.isDefined("inputCol"):
            inputs = [stage.getInputCol()]
        elif stage.hasParam("featuresCol"):
            inputs = [stage.getFeaturesCol()]
        else:
            inputs = [None]
        rows += [(i, type(stage).__name__, c) for c in inputs]
    return df.sparkSession.createDataFrame(rows, "position int, stage string, input_column string")


def importances(model: PipelineModel, df: DataFrame, top: int | None = None) -> DataFrame:
    """``(feature, importance)``, the most important first."""
    tree = next((s for s in model.stages if hasattr(s, "featureImportances")), None)
    if tree is None:
        raise ValueError("the model has no feature importances")
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    rows = [(n, float(v)) for n, v in zip(assembler.getInputCols(), tree.featureImportances.toArray())]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    ordered = table.orderBy(F.col("importance").desc(), "feature")
    return ordered if top is None else ordered.limit(top)
