"""Headline queries, timed; prints one JSON line.

``BENCH_SF_DIR`` is the data, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the runs per query
(the median counts). ``step_by_step`` times the same work done with one job per number, as
notebooks usually do it: a correlation call per pair, an evaluator call per metric, and an
area per class.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pyspark
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from impactrec.functions import slot
from impactrec.operators import auc, classification_metrics, corr_matrix, encode_rules
from impactrec.plans.queries import all_queries, line_scores
from impactrec.session import local_session
from impactrec.sources import load_table, numeric_columns, product_table, score_table
from impactrec.staging import release, stage

HEADLINE = [
    "preview", "filter_type", "duplicate_rows", "describe_long", "summary_long", "profile_columns",
    "profile_one_scan", "profile_sketches", "column_histogram", "frequency_table", "corr_matrix",
    "corr_matrix_pairwise", "chi_square_lines", "dummy_encode", "one_hot", "standard_scale",
    "selected_feature_names", "pca_explained_variance", "keyed_split", "classification_metrics",
    "roc_curve_lines", "auc_lines", "auc_per_class", "decision_tree_predictions",
    "random_forest_predictions", "one_vs_rest_gbt_predictions", "model_evaluation",
    "recommend_by_probability", "recommend_top_n_per_type", "recommend_all_per_type",
    "recommend_from_tree", "recommend_from_forest",
]
ONCE = ["tune_random_search"]


def run(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def consume(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def compared(spark, folder) -> dict[str, dict[str, float]]:
    """The same numbers at once and step by step, over stored tables."""
    encoded = stage(encode_rules(product_table(spark, folder)))
    scores = stage(score_table(product_table(spark, folder)))
    lines = stage(line_scores(spark, folder))
    columns = numeric_columns(encoded)

    def pair_by_pair():
        for a in columns:
            for b in columns:
                if a != b:
                    encoded.stat.corr(a, b)

    def metric_by_metric():
        for name in ("accuracy", "weightedPrecision", "weightedRecall", "f1"):
            MulticlassClassificationEvaluator(labelCol="EI", metricName=name).evaluate(scores)

    def class_by_class():
        judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="hit", numBins=0)
        for k in range(1, 4):
            hit = (F.col("EI") == k).cast("double").alias("hit")
            judge.evaluate(lines.select(slot(lines, "probability", k).alias("score"), hit))

    consume(auc(scores))
    work = {
        "correlation": (lambda: consume(corr_matrix(encoded, columns)), pair_by_pair),
        "metrics": (lambda: consume(classification_metrics(scores)), metric_by_metric),
        "areas": (lambda: consume(auc(lines)), class_by_class),
    }
    return {
        name: {"at_once": round(run(ours), 3), "step_by_step": round(run(steps), 3)}
        for name, (ours, steps) in work.items()
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores)
    queries = all_queries()

    consume(load_table(spark, folder, "lineitem"))
    times: dict[str, float] = {}
    for name in HEADLINE + ONCE:
        repeats = 1 if name in ONCE else runs
        times[name] = round(
            statistics.median(run(lambda: consume(queries[name](spark, folder))) for _ in range(repeats)), 3
        )
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
        "compared": compared(spark, folder),
        "lineitem_rows": load_table(spark, folder, "lineitem").count(),
        "cores": cores,
        "runs": runs,
        "spark": pyspark.__version__,
    }
    release(spark)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
