"""Fitted trees as tables: their nodes, the path to every leaf, and votes of the first trees of a forest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from impactrec.sources.schema import KEY
from impactrec.staging import stage_path


def _trees_of(model: PipelineModel):
    kinds = (DecisionTreeClassificationModel, RandomForestClassificationModel)
    found = next((s for s in model.stages if isinstance(s, kinds)), None)
    if found is None:
        raise ValueError("the model holds no decision tree or random forest")
    return found


def _stored_nodes(trees, spark: SparkSession) -> DataFrame:
    """The nodes as the model stores them, one row for each node of each tree."""
    path = stage_path(spark)
    trees.save(path)
    stored = spark.read.parquet(f"{path}/data")
    if "nodeData" in stored.columns:
        return stored.select(F.col("treeID").alias("tree"), "nodeData.*")
    return stored.select(F.lit(0).alias("tree"), "*")


def _features(model: PipelineModel) -> tuple[list[str], dict[str, list[str]]]:
    """The names of the features, and of those that were strings their values by index."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    indexed = {s.getOutputCol(): s for s in model.stages if isinstance(s, StringIndexerModel)}
    names, values = [], {}
    for c in assembler.getInputCols():
        source = indexed.get(c)
        names.append(source.getInputCol() if source else c)
        if source:
            values[names[-1]] = list(source.labels)
    return names, values


def tree_nodes(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """The nodes of a fitted tree or forest.

    ``tree, node, parent, side, leaf, feature, threshold, categories, gain, impurity, rows, prediction``: rows with a
    number up to ``threshold``, or with one of the ``categories``, go to the left. A root has no parent, an inner
    node no ``leaf`` (their number from left to right), and a leaf no feature. ``rows`` counts training rows.
    """
    names, values = _features(model)
    stored = _stored_nodes(_trees_of(model), spark)
    links = stored.where("leftChild >= 0").select("tree", F.col("id").alias("parent"), F.explode(F.array(
        F.struct(F.col("leftChild").alias("id"), F.lit("left").alias("side")),
        F.struct(F.col("rightChild").alias("id"), F.lit("right").alias("side")),
    )).alias("child")).select("tree", "parent", "child.id", "child.side")
    inner = F.col("leftChild") >= 0
    feature = F.get(F.array(*[F.lit(n) for n in names]), F.col("split.featureIndex"))
    numeric = F.col("split.numCategories") == -1
    known = F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.array(*map(F.lit, v)))]) if values else None
    labels = known[F.col("feature")] if values else F.lit(None).cast("array<string>")
    # An index past the values stands for unknown ones.
    shown = F.transform("codes", lambda c: F.coalesce(F.get(labels, c.cast("int")), F.lit("(unknown)")))
    in_tree = Window.partitionBy("tree").orderBy("id")
    number = F.when(~inner, F.count_if(~inner).over(in_tree) - 1).cast("int")
    nodes = stored.withColumn("leaf", number).withColumn("feature", F.when(inner, feature)).select(
        "tree", "id", "leaf", "feature", F.when(inner & numeric, F.get("split.leftCategoriesOrThreshold", 0)).alias("threshold"),
        F.when(inner & ~numeric, F.col("split.leftCategoriesOrThreshold")).alias("codes"), F.when(inner, F.col("gain")).alias("gain"),
        "impurity", F.col("rawCount").alias("rows"), "prediction",
    )
    return nodes.join(links, ["tree", "id"], "left").select(
        "tree", F.col("id").alias("node"), "parent", "side", "leaf", "feature", "threshold",
        F.when(F.col("codes").isNotNull(), shown).alias("categories"), "gain", "impurity", "rows", "prediction",
    )


def leaf_paths(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """``tree, leaf, depth, path, prediction, rows`` of every leaf; ``path`` holds the conditions from the root on.

    As long as the model, which the driver holds anyway.
    """
    rows = tree_nodes(model, spark).collect()
    nodes = {(r.tree, r.node): r for r in rows}
    out = []
    for r in rows:
        if r.leaf is None:
            continue
        steps, at = [], r
        while at.parent is not None:
            above = nodes[at.tree, at.parent]
            left = at.side == "left"
            if above.threshold is not None:
                steps.append(f"{above.feature} {'<=' if left else '>'} {above.threshold:.12g}")
            else:
                steps.append(f"{above.feature} {'in' if left else 'not in'} ({', '.join(above.categories)})")
            at = above
        out.append((r.tree, r.leaf, len(steps), " AND ".join(reversed(steps)), r.prediction, r.rows))
    return spark.createDataFrame(out, "tree int, leaf int, depth int, path string, prediction double, rows long")


def _with_leaves(model: PipelineModel, df: DataFrame, column: str) -> DataFrame:
    trees = _trees_of(model)
    marked = trees.copy()
    marked.setLeafCol(column)
    return PipelineModel([marked if s is trees else s for s in model.stages]).transform(df)


def decision_paths(model: PipelineModel, df: DataFrame, key: str = KEY) -> DataFrame:
    """For every row that the model scores, and every tree, the path it takes: ``key, tree, leaf, path, prediction``."""
    found = _with_leaves(model, df, "_leaf")
    leaves = F.col("_leaf") if dict(found.dtypes)["_leaf"] == "double" else vector_to_array("_leaf")
    each = F.posexplode(F.array(leaves) if dict(found.dtypes)["_leaf"] == "double" else leaves).alias("tree", "leaf")
    taken = found.select(key, each).withColumn("leaf", F.col("leaf").cast("int"))
    paths = leaf_paths(model, df.sparkSession).select("tree", "leaf", "path", "prediction")
    return taken.join(paths, ["tree", "leaf"]).select(key, "tree", "leaf", "path", "prediction")


def _leaf_votes(forest, spark: SparkSession) -> list[np.ndarray]:
    """Per tree the class shares of each leaf, a row per leaf."""
    rows = _stored_nodes(forest, spark).where("leftChild < 0").orderBy("tree", "id").select("tree", "impurityStats").collect()
    votes: list[list] = [[] for _ in range(forest.getNumTrees)]
    for r in rows:
        votes[r.tree].append(r.impurityStats)
    tables = [np.array(v, np.float64) for v in votes]
    return [t / np.maximum(t.sum(1, keepdims=True), 1e-300) for t in tables]


def _prefix_classes(leaves: np.ndarray, tables: Sequence[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """A row per row of ``leaves`` with the class of most votes after each of the ``wanted`` trees, counted from 0.

    One running sum per class is held, not the sums after every tree.
    """
    best = np.empty((len(leaves), len(wanted)))
    votes = np.zeros((len(leaves), tables[0].shape[1]))
    for i, shares in enumerate(tables[: wanted.max(initial=-1) + 1]):
        votes += shares[leaves[:, i]]
        if (ended := wanted == i).any():
            best[:, ended] = votes.argmax(1)[:, None]
    return best


def prefix_predictions(model: PipelineModel, df: DataFrame, sizes: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``predictions``: for each of ``sizes`` the class that the first so many trees of a forest vote for.

    A row passes each tree once; running sums of the votes give all sizes together.
    """
    forest = _trees_of(model)
    if not isinstance(forest, RandomForestClassificationModel):
        raise ValueError("only a random forest has prefixes")
    keep, wanted = list(keep), np.array(sizes) - 1
    if (wanted < 0).any() or (wanted >= forest.getNumTrees).any():
        raise ValueError(f"sizes must lie between 1 and {forest.getNumTrees}")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(_leaf_votes(forest, spark))
    rows = _with_leaves(model, df, "_leaf").select(*keep, vector_to_array("_leaf").alias("_leaf"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            leaves = batch.column("_leaf").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, len(tables))
            best = _prefix_classes(leaves, tables, wanted)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(wanted), pa.int32()), pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, "predictions"])

    return rows.mapInArrow(vote, rows.select(*keep).schema.add("predictions", T.ArrayType(T.DoubleType())))
