"""The registered queries: every operator over the whole of the tables it is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from impactrec import operators as ops
from impactrec.functions import indicator, slot
from impactrec.plans import workflows
from impactrec.sources import (
    CATEGORICAL,
    load_table,
    noisy_products,
    numeric_columns,
    product_table,
    read_checked,
    read_products,
    schema_table,
    score_table,
)
from impactrec.staging import stage, stage_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

QUARTILES = (0.25, 0.5, 0.75)
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PROFILED_TYPE = "promo"
CLASSES = [1, 2, 3, 4, 5]


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def _lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "lineitem")


def _stored_products(spark: SparkSession, folder: str) -> DataFrame:
    """Products written once, for steps that read them to fit and again to transform."""
    return stage(product_table(spark, folder))


def _encoded(spark: SparkSession, folder: str) -> DataFrame:
    return ops.encode_rules(product_table(spark, folder))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_table(product_table(spark, folder))


def line_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A class per line item, from its return flag, and a continuous score for each class."""
    flags = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    return _lineitem(spark, folder).select(
        F.array_position(flags, F.col("l_returnflag")).cast("int").alias("EI"),
        F.array(
            F.lit(0.0), F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_discount"), F.col("l_quantity")
        ).alias("probability"),
    )


def _gappy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with values missing by rule."""
    return _lineitem(spark, folder).select(
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_linestatus") == "O", F.col("l_discount")).alias("discount"),
        F.col("l_tax").alias("tax"),
        F.lit(7.0).alias("constant"),
    )


# Scans, projections, filters


@query
def preview(spark, folder):
    return ops.preview(product_table(spark, folder), 20, "ID")


@query
def schema_columns(spark, folder):
    return schema_table(_encoded(spark, folder))


@query
def project_columns(spark, folder):
    scores = _scores(spark, folder)
    return scores.select("ID", "Type", slot(scores, "probability", 1).alias("p1"), "EI")


@query
def drop_columns(spark, folder):
    return product_table(spark, folder).drop("Alpaca", "Jute", "Use_location", "Drying_instruction")


@query
def csv_round_trip(spark, folder):
    """Texts with quotes and line breaks, written as CSV and read back with the product reader."""
    docs = load_table(spark, folder, "documents").select("doc_id", "text")
    path = f"{stage_path(spark)}.csv"
    docs.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = read_products(spark, path, docs.schema)
    return back.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("hash"))


@query
def csv_rejected_rows(spark, folder):
    """Orders written as CSV, some with a price that is no number or with a field too many: what is kept, and what is not."""
    orders = load_table(spark, folder, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    price = F.when(key % 97 == 7, "n/a").when(key % 101 == 3, F.concat(price, F.lit(",more"))).otherwise(price)
    path = f"{stage_path(spark)}.csv"
    lines = orders.select(F.concat_ws(",", key.cast("string"), price, "o_orderpriority").alias("value"))
    lines.write.text(path)
    found = read_checked(spark, path, orders.select("o_orderkey", "o_totalprice", "o_orderpriority").schema, multi_line=False, header=False)
    first = F.split("record", ",")[0].cast("long")
    return found.rows.select(F.lit("kept").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("shown")).unionByName(
        found.rejected.select(F.lit("rejected").alias("kind"), first.alias("key"), F.split("record", ",")[1].alias("shown"))
    )


@query
def filter_type(spark, folder):
    return product_table(spark, folder).where(F.col("Type") == PROFILED_TYPE)


@query
def filter_membership(spark, folder):
    best = _scores(spark, folder).where(F.col("prediction").isin(1, 2))
    return best.select("ID", "Type", "prediction", "EI")


@query
def missing_location_count(spark, folder):
    return ops.count_missing(product_table(spark, folder), "Manufacturing_location")


# Aggregates and profiles


@query
def duplicate_rows(spark, folder):
    return ops.duplicate_rows(_lineitem(spark, folder), ["l_orderkey", "l_linenumber"])


@query
def duplicate_rows_by_hash(spark, folder):
    cols = ["l_orderkey", "l_linenumber", "l_linestatus"]
    return ops.duplicate_rows(_lineitem(spark, folder), cols, by_hash=True)


@query
def duplicate_products(spark, folder):
    traits = product_table(spark, folder).select(
        "Type", "Manufacturing_location", "Drying_instruction", "Washing_instruction", "EI"
    )
    return ops.duplicate_rows(traits)


@query
def describe_long(spark, folder):
    lines = _lineitem(spark, folder)
    cols = ["l_orderkey", *LINE_NUMBERS, "l_returnflag", "l_linestatus"]
    return _rounded(ops.describe_long(lines, cols), "value")


@query
def summary_long(spark, folder):
    cols = [*LINE_NUMBERS, "l_returnflag"]
    return _rounded(ops.describe_long(_lineitem(spark, folder), cols, QUARTILES), "value")


@query
def profile_columns(spark, folder):
    table = ops.profile(product_table(spark, folder), exact=True)
    return _rounded(table, "min", "max", "mean", "stddev", "p25", "p50", "p75", places=8)


@query
def profile_one_scan(spark, folder):
    """The exact columns of the sketched profile."""
    table = ops.profile(_lineitem(spark, folder), [*LINE_NUMBERS, "l_returnflag"])
    exact = table.drop("n_distinct", "p25", "p50", "p75")
    return _rounded(exact, "mean", "stddev")


@query
def profile_sketches(spark, folder):
    table = ops.profile(_lineitem(spark, folder), [*LINE_NUMBERS, "l_returnflag"])
    return table.select("column_name", "n_distinct", "p25", "p50", "p75")


def _large_values(spark, folder):
    """Columns far from zero: seconds since an epoch, large keys, and a spread below the value's own digits."""
    return _lineitem(spark, folder).select(
        F.unix_timestamp(F.col("l_shipdate")).alias("seconds"),
        (F.lit(1_700_000_000_000_000) + F.col("l_orderkey")).alias("large_key"),
        (F.lit(1e9) + F.col("l_linenumber") * 1e-3).alias("tight"),
    )


def _moments_shown(table: DataFrame) -> DataFrame:
    return table.select(
        "column_name", "n_rows", F.format_string("%.9e", "mean").alias("mean"), F.format_string("%.2e", "stddev").alias("stddev")
    )


@query
def profile_large_values(spark, folder):
    return _moments_shown(ops.profile(_large_values(spark, folder)))


@query
def profile_large_values_exact(spark, folder):
    return _moments_shown(ops.profile(_large_values(spark, folder), exact=True))


@query
def column_histogram(spark, folder):
    return _rounded(ops.column_histogram(_lineitem(spark, folder), "l_extendedprice", 20), "lower", "upper")


@query
def profile_top_values(spark, folder):
    """Every value that at least one row in a hundred holds, of all columns of the line items."""
    return _rounded(ops.top_values(_lineitem(spark, folder)), "share")


@query
def profile_histograms(spark, folder):
    return _rounded(ops.histograms(_lineitem(spark, folder), bins=12), "lower", "upper")


@query
def distinct_values(spark, folder):
    return ops.distinct_values(product_table(spark, folder), "Washing_instruction")


@query
def frequency_table(spark, folder):
    return ops.value_counts(product_table(spark, folder), "Manufacturing_location")


@query
def frequency_of_dummy(spark, folder):
    return ops.value_counts(_encoded(spark, folder), "Manufacturing_location_Unknown")


# Correlation and independence


@query
def corr_pair_zero(spark, folder):
    return _rounded(ops.corr_pair(_gappy_lines(spark, folder), "quantity", "price", "zero"), "corr")


@query
def corr_pair_pairwise(spark, folder):
    return _rounded(ops.corr_pair(_gappy_lines(spark, folder), "quantity", "price", "pairwise"), "corr")


@query
def corr_matrix(spark, folder):
    encoded = _encoded(spark, folder)
    return _rounded(ops.corr_matrix(encoded, numeric_columns(encoded)), "corr")


@query
def corr_matrix_pairwise(spark, folder):
    lines = _gappy_lines(spark, folder)
    return _rounded(ops.corr_matrix(lines, lines.columns, "pairwise"), "corr")


@query
def chi_square_table(spark, folder):
    return _rounded(ops.chi_square(product_table(spark, folder), [*CATEGORICAL, "Material_label"], "EI"), "statistic")


@query
def chi_square_lines(spark, folder):
    lines = _lineitem(spark, folder)
    return _rounded(ops.chi_square(lines, ["l_linenumber", "l_discount", "l_tax"], "l_returnflag"), "statistic")


@query
def corr_matrix_small_spread(spark, folder):
    lines = _lineitem(spark, folder).select(
        F.col("l_linenumber").alias("line"), (F.lit(1e9) + F.col("l_linenumber") * 1e-5).alias("tight"),
        (F.lit(1_700_000_000_000_000) + F.col("l_linenumber") * 1000).alias("large"),
    )
    return _rounded(ops.corr_matrix(lines, lines.columns), "corr", places=2)


@query
def chi_square_p_values(spark, folder):
    """Three labels, so the degrees of freedom are even and the tail is a finite sum."""
    tested = ops.chi_square_test(_lineitem(spark, folder), ["l_linenumber", "l_discount", "l_tax"], "l_returnflag")
    return _rounded(tested.select("feature", "degrees_of_freedom", "p_value"), "p_value")


@query
def select_continuous(spark, folder):
    """Selection among columns whose values are nearly all different."""
    lines = _lineitem(spark, folder).select("l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
    found = ops.select_features(lines, [], lines.columns[:3], "l_returnflag", k=1)
    return spark.createDataFrame([(n,) for n in found.names], "feature string")


# Encoding


@query
def dummy_encode(spark, folder):
    return _encoded(spark, folder)


@query
def reduced_feature_set(spark, folder):
    return ops.use_feature_set(_encoded(spark, folder), "no_drying")


@query
def string_index_keep(spark, folder):
    cols = ["Manufacturing_location", "Drying_instruction"]
    return ops.index_strings(_stored_products(spark, folder).select("ID", *cols), cols, "keep")


@query
def index_many_values(spark, folder):
    return ops.index_strings(load_table(spark, folder, "part").select("p_partkey", "p_name"), ["p_name"], "keep")


@query
def one_hot_many_values(spark, folder):
    """Sparse vectors over all part names, brands and sizes: the slots that each part sets, by name."""
    part = load_table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    found = ops.sparse_features(part, ["p_name", "p_brand"], ["p_size"])
    cells = F.explode(F.arrays_zip("features.indices", "features.values")).alias("cell")
    cells = found.cells.select("p_partkey", F.col("features.size").alias("n_slots"), cells)
    return cells.join(found.slots, F.col("cell.indices") == F.col("position")).select(
        "p_partkey", "n_slots", F.col("cell.indices").cast("bigint").alias("slot"), "feature", "value", F.col("cell.values").alias("weight")
    )


@query
def string_index_skip(spark, folder):
    cols = ["Manufacturing_location", "Drying_instruction"]
    return ops.index_strings(_stored_products(spark, folder).select("ID", *cols), cols, "skip")


@query
def one_hot(spark, folder):
    encoded = ops.one_hot(
        _stored_products(spark, folder).select("ID", "Type", "Drying_instruction"), ["Type", "Drying_instruction"]
    )
    return ops.expand_slots(ops.expand_slots(encoded, "Type_encoded"), "Drying_instruction_encoded")


@query
def assemble_array(spark, folder):
    cols = ["Cotton", "Polyester", "Elastane", "Material_label"]
    assembled = ops.assemble(product_table(spark, folder), cols)
    values = vector_to_array(F.col("features"))
    return assembled.select("ID", *[values[i].alias(f"slot_{i}") for i in range(len(cols))])


@query
def standard_scale(spark, folder):
    cols = ["Cotton", "Polyester", "Transporation_distance", "no_spread"]
    scaled = ops.scale(_stored_products(spark, folder).withColumn("no_spread", F.lit(3.0)), cols)
    values = vector_to_array(F.col("scaled_features"))
    return scaled.select("ID", *[F.round(values[i], 6).alias(c) for i, c in enumerate(cols)])


# Selection and principal components


def _binary_selection(spark, folder):
    """Slots of 0 and 1 only share their degrees of freedom, so the p-value ranks as the statistic."""
    return ops.select_features(_stored_products(spark, folder), CATEGORICAL, ["Material_label"])


@query
def selected_feature_names(spark, folder):
    names = _binary_selection(spark, folder).names
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query
def chi_square_select(spark, folder):
    """How often each selected slot is set."""
    selection = _binary_selection(spark, folder)
    slots = F.posexplode(vector_to_array(F.col("selectedFeatures"))).alias("position", "value")
    name = F.get(F.array(*[F.lit(n) for n in selection.names]), F.col("position"))
    return (
        selection.table.select(slots)
        .groupBy(name.alias("feature"))
        .agg(F.sum("value").cast("bigint").alias("n_set"))
    )


@query
def select_with_numbers(spark, folder):
    """The selection over encoded strings and all numbers, each number a category."""
    names = ops.select_features(_stored_products(spark, folder)).names
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "position int, feature string")


@query
def pca_explained_variance(spark, folder):
    return ops.pca(*ops.pca_inputs(workflows.prepare(product_table(spark, folder)))).variance


@query
def pca_loadings(spark, folder):
    return ops.pca(*ops.pca_inputs(workflows.prepare(product_table(spark, folder)))).loadings


@query
def pca_first_loadings(spark, folder):
    """The loadings of the first five components."""
    parts = ops.pca(*ops.pca_inputs(workflows.prepare(product_table(spark, folder))))
    return parts.loadings.where("component <= 5")


@query
def pca_reconstruction(spark, folder):
    """All components put together again give the correlation of every pair of features."""
    encoded = workflows.prepare(product_table(spark, folder))
    cols = numeric_columns(encoded, ("ID", "EI"))
    parts = ops.pca(encoded, cols)
    weighted = parts.loadings.join(parts.variance, "component")
    left = weighted.select("component", F.col("feature").alias("var_x"), F.col("loading").alias("x"), "ratio")
    right = parts.loadings.select("component", F.col("feature").alias("var_y"), F.col("loading").alias("y"))
    share = F.sum(F.col("x") * F.col("y") * F.col("ratio")).alias("share")
    shares = left.join(right, "component").groupBy("var_x", "var_y").agg(share)
    # A scaled column has variance 1, or 0 if it is constant: its share of the total tells which.
    own = shares.where("var_x = var_y AND share > 1e-9")
    own_x = own.select("var_x", F.col("share").alias("share_x"))
    own_y = own.select("var_y", F.col("share").alias("share_y"))
    corr = F.col("share") / F.sqrt(F.col("share_x") * F.col("share_y"))
    return (
        shares.join(own_x, "var_x", "left")
        .join(own_y, "var_y", "left")
        .select("var_x", "var_y", F.round(corr, 6).alias("corr"))
    )


@query
def pca_index_scores(spark, folder):
    """Scores over the five indexed strings. All components together turn a row, so they keep its length."""
    cols = ["Type", "Manufacturing_location", "Use_location", "Washing_instruction", "Drying_instruction"]
    table, inputs = ops.pca_inputs(_stored_products(spark, folder).select("ID", *cols))
    scores = vector_to_array(F.col("pca_features"))
    length = F.sqrt(F.aggregate(scores, F.lit(0.0), lambda total, x: total + x * x))
    return ops.pca(table, inputs).scores.select("ID", F.round(length, 6).alias("length"))


@query
def wide_cumulative_variance(spark, folder):
    """The components of three line-item columns, found without their covariance."""
    lines = ops.assemble(_lineitem(spark, folder), ["l_quantity", "l_extendedprice", "l_discount"]).select("features")
    return _rounded(ops.pca_wide(lines, "features", 3).variance, "ratio", "cumulative")


@query
def wide_sparse_components(spark, folder):
    """The first components of a slot for each part name, brand and type: the parts' scores."""
    part = load_table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    found = ops.sparse_features(part, ["p_name", "p_brand", "p_type"], ["p_size"])
    scores = ops.pca_wide(found.table.select("p_partkey", "features"), "features", 3).scores
    return scores.select("p_partkey", *[F.round(F.get("pca_features", F.lit(i)), 6).alias(f"score_{i + 1}") for i in range(3)])


def _line_variance(spark, folder):
    return ops.pca(_lineitem(spark, folder), ["l_quantity", "l_extendedprice", "l_discount"]).variance


@query
def cumulative_variance(spark, folder):
    return _rounded(_line_variance(spark, folder), "ratio", "cumulative")


@query
def components_needed(spark, folder):
    return ops.components_for(_line_variance(spark, folder), 0.95)


# Splits


@query
def keyed_split(spark, folder):
    return product_table(spark, folder).select("ID", ops.split_part("ID", (0.8, 0.2), 42).alias("part"))


@query
def split_per_mille(spark, folder):
    orders = load_table(spark, folder, "orders")
    return orders.select("o_orderkey", ops.split_part("o_orderkey", (0.996, 0.004), 42).alias("part"))


@query
def random_split_sizes(spark, folder):
    parts = ops.split_random(product_table(spark, folder).select("ID"), (0.8, 0.2), 42)
    sizes = [p.agg(F.count("ID").alias("n")).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return sizes[0].unionByName(sizes[1])


@query
def random_split_whole(spark, folder):
    """The parts of a random split together hold every product once."""
    train, test = ops.split_random(_stored_products(spark, folder).select("ID"), (0.8, 0.2), 42)
    return train.union(test).agg(F.count("ID").alias("n_rows"), F.count_distinct("ID").alias("n_products"))


# Metrics


@query
def confusion_matrix(spark, folder):
    return ops.confusion(_scores(spark, folder))


@query
def hit_indicator(spark, folder):
    """1.0 where the prediction, or the first class, is the label."""
    hit = indicator(F.col("prediction"), F.col("EI")).alias("hit")
    return _scores(spark, folder).select("ID", hit, indicator(F.col("EI"), F.lit(1.0)).alias("is_first"))


@query
def class_metrics(spark, folder):
    return _rounded(ops.class_metrics(_scores(spark, folder)), "precision", "recall", "f1")


@query
def metrics_with_missing_labels(spark, folder):
    scores = _scores(spark, folder).withColumn("EI", F.when(F.col("ID") % 10 != 0, F.col("EI")))
    table = ops.classification_metrics(scores).crossJoin(F.broadcast(ops.unlabelled_rows(scores)))
    return _rounded(table, "accuracy", "weighted_precision", "weighted_recall", "f1", "test_error")


@query
def classification_metrics(spark, folder):
    table = ops.classification_metrics(_scores(spark, folder))
    return _rounded(table, *table.columns)


def _finite_start(curve: DataFrame) -> DataFrame:
    """Show the infinite threshold at the start of a curve as NULL."""
    threshold = F.when(F.col("threshold") != float("inf"), F.col("threshold"))
    return _rounded(curve.withColumn("threshold", threshold), "threshold", "fpr", "tpr")


@query
def roc_curve(spark, folder):
    return _finite_start(ops.roc(_scores(spark, folder)))


@query
def roc_hard_label(spark, folder):
    return _finite_start(ops.roc(_scores(spark, folder), hard=True))


@query
def roc_curve_lines(spark, folder):
    return _finite_start(ops.roc(line_scores(spark, folder), classes=[1, 2, 3]))


@query
def roc_curve_corners(spark, folder):
    """The curve without the points that lie on straight lines."""
    return _finite_start(ops.roc(line_scores(spark, folder), classes=[1, 2, 3], corners=True))


@query
def roc_product_corners(spark, folder):
    return _finite_start(ops.roc(_scores(spark, folder), corners=True))


@query
def auc_per_class(spark, folder):
    return _rounded(ops.auc(_scores(spark, folder)), "auc")


@query
def auc_lines(spark, folder):
    return _rounded(ops.auc(line_scores(spark, folder), classes=[1, 2, 3]), "auc")


@query
def auc_mean(spark, folder):
    return _rounded(ops.mean_auc(ops.auc(_scores(spark, folder))), "mean_auc")


@query
def auc_hard_label(spark, folder):
    return _rounded(ops.auc(_scores(spark, folder), hard=True), "auc")


# Models. A separable label must be found exactly; a noisy one cannot be.


def _separable(spark, folder, algo):
    prepared = workflows.prepare(product_table(spark, folder))
    return workflows.train_on(prepared, algo, {"maxBins": 64})


def _noisy(spark, folder, algo):
    prepared = workflows.prepare(noisy_products(product_table(spark, folder)))
    return workflows.train_on(prepared, algo)


@query
def decision_tree_separable(spark, folder):
    return _separable(spark, folder, "dt").held_out.select("ID", "prediction")


@query
def random_forest_separable(spark, folder):
    return _separable(spark, folder, "rf").held_out.select("ID", "prediction")


@query
def one_vs_rest_separable(spark, folder):
    return _separable(spark, folder, "ovr_gbt").held_out.select("ID", "prediction")


@query
def decision_tree_predictions(spark, folder):
    return _noisy(spark, folder, "dt").held_out.select("ID", "EI", "prediction")


@query
def random_forest_predictions(spark, folder):
    return _noisy(spark, folder, "rf").held_out.select("ID", "EI", "prediction")


@query
def one_vs_rest_gbt_predictions(spark, folder):
    return _noisy(spark, folder, "ovr_gbt").held_out.select("ID", "EI", "prediction")


@query
def decision_tree_double_features(spark, folder):
    """Training on floating-point columns and strings alone, and on the set without drying columns."""
    prepared = workflows.prepare(noisy_products(product_table(spark, folder)), "no_drying")
    trained = workflows.train_on(prepared, "dt", feature_mode="double_only")
    return ops.model_stages(trained.model, prepared)


@query
def skipped_rows(spark, folder):
    """Rows a model with string inputs leaves out of its scores."""
    products = _stored_products(spark, folder).select("ID", "Cotton", "Drying_instruction", "Manufacturing_location", "EI")
    return ops.skipped_rows(ops.train(products, "dt"), products)


@query
def model_evaluation(spark, folder):
    return workflows.evaluate(_noisy(spark, folder, "rf").held_out).summary


@query
def model_mean_auc(spark, folder):
    return workflows.evaluate(_noisy(spark, folder, "rf").held_out).mean_area


@query
def feature_importances(spark, folder):
    trained = _noisy(spark, folder, "dt")
    return ops.importances(trained.model, trained.products)


@query
def top_importances(spark, folder):
    trained = _noisy(spark, folder, "rf")
    return ops.importances(trained.model, trained.products, 20)


@query
def importances_separable(spark, folder):
    """Only the column that decides the label matters to the tree."""
    trained = _separable(spark, folder, "dt")
    return _rounded(ops.importances(trained.model, trained.products), "importance")


@query
def top_importances_separable(spark, folder):
    trained = _separable(spark, folder, "rf")
    return ops.importances(trained.model, trained.products, 1).select("feature")


@query
def evaluation_separable(spark, folder):
    """All metrics and the mean area of a model that makes no mistake."""
    result = workflows.evaluate(_separable(spark, folder, "dt").held_out)
    areas = result.areas.agg(F.min("auc").alias("least_auc"), F.count("auc").alias("n_classes"))
    names = result.summary.columns
    metrics = result.summary.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.round(c, 6).alias("value")) for c in names
    ])).alias("m")).select("m.*")
    shown = areas.select(F.explode(F.array(
        F.struct(F.lit("least_auc").alias("metric"), F.round("least_auc", 6).alias("value")),
        F.struct(F.lit("n_classes").alias("metric"), F.col("n_classes").cast("double").alias("value")),
    )).alias("m")).select("m.*")
    return metrics.unionByName(shown)


@query
def tree_nodes(spark, folder):
    """The tree of the separable label: its splits are the borders between classes."""
    trained = _separable(spark, folder, "dt")
    return ops.tree_nodes(trained.model, spark).where("feature IS NOT NULL").select("feature", F.round("threshold", 6).alias("threshold"))


@query
def tree_leaves(spark, folder):
    """Of every product the class of the leaf that its path leads to."""
    trained = _separable(spark, folder, "dt")
    return ops.decision_paths(trained.model, trained.held_out.drop("features", "rawPrediction", "probability", "prediction", "TypeIndex", "Use_locationIndex")).select("ID", "prediction")


@query
def forest_nodes(spark, folder):
    """The nodes of a forest on the noisy label."""
    return ops.tree_nodes(_noisy(spark, folder, "rf").model, spark)


# Recommendations


def _shown_slots(table: DataFrame) -> DataFrame:
    slots = [F.get("probability", F.lit(c)).alias(f"p{c}") for c in CLASSES]
    return table.select(*[c for c in table.columns if c != "probability"], *slots)


@query
def recommend_by_probability(spark, folder):
    return _shown_slots(ops.recommend(_scores(spark, folder), n=None))


@query
def recommend_by_class(spark, folder):
    return ops.recommend(_scores(spark, folder), by="prediction", n=20)


@query
def recommend_for_type(spark, folder):
    return _shown_slots(ops.recommend(_scores(spark, folder), type=PROFILED_TYPE, n=20))


@query
def recommend_top_n_per_type(spark, folder):
    return _shown_slots(ops.recommend(_scores(spark, folder), n=10, per_type=True))


@query
def top_2000_per_type(spark, folder):
    return _shown_slots(ops.recommend(_scores(spark, folder), n=2000, per_type=True))


@query
def recommend_all_per_type(spark, folder):
    return _shown_slots(ops.recommend(_scores(spark, folder), n=None, per_type=True))


@query
def recommend_from_tree(spark, folder):
    """Train on the separable label, score everything, and rank one type."""
    trained = _separable(spark, folder, "dt")
    return _shown_slots(workflows.recommend_from(trained, type=PROFILED_TYPE, n=20))


@query
def recommend_from_forest(spark, folder):
    return _shown_slots(workflows.recommend_from(_noisy(spark, folder, "rf"), n=10, per_type=True))


@query
def recommend_by_class_scores(spark, folder):
    """Boosted models ranked by raw score; which products they are follows from their predictions."""
    found = workflows.recommend_from(_separable(spark, folder, "ovr_gbt"), by="class_scores")
    return found.select("ID", "Type", "EI")


@query
def recommend_from_boosting(spark, folder):
    return workflows.recommend_from(_separable(spark, folder, "ovr_gbt"), n=20)


# Hyper-parameter search


def _tuned(spark, folder):
    return workflows.tune(workflows.prepare(noisy_products(product_table(spark, folder))))


@query
def tune_random_search(spark, folder):
    return _tuned(spark, folder).search.trials


#: Trees deep enough for the separable label, which a fold leaves out a part of.
SEPARABLE_SPACE = {"maxDepth": (6, 8), "maxBins": (64, 64), "minInfoGain": (0.0, 0.01)}


@query
def tune_folds(spark, folder):
    """Folds, their sizes, and the accuracy of the best setting in each, on the separable label."""
    prepared = workflows.prepare(product_table(spark, folder))
    found = ops.tune_folds(prepared, SEPARABLE_SPACE, n=2, folds=4, algo="dt")
    best = found.search.trials.orderBy(F.desc("accuracy"), "trial").limit(1).select("trial")
    accuracy = F.round(F.col("n_hits") / F.col("n_rows"), 6).alias("accuracy")
    return found.folds.join(best, "trial").select("fold", "n_rows", accuracy)


#: Most of these settings miss classes of the separable label.
UNEVEN_SPACE = {"maxDepth": (1, 8), "maxBins": (64, 64), "minInfoGain": (0.0, 0.5), "impurity": ["gini", "entropy"]}


@query
def tune_adaptive(spark, folder):
    """The best of a few proposed trees on the separable label, with the rows it was rated on."""
    prepared = workflows.prepare(product_table(spark, folder))
    train, valid = ops.split_by_key(prepared)
    found = ops.tune_adaptive(train, valid, UNEVEN_SPACE, n=20, batch=5, startup=10, algo="dt")
    best = found.trials.agg(F.count("trial").alias("n_trials"), F.round(F.max("accuracy"), 6).alias("best_accuracy"))
    return best.withColumn("n_rated", F.lit(valid.count()).cast("bigint"))


@query
def best_model_metrics(spark, folder):
    return workflows.evaluate(_tuned(spark, folder).held_out).summary
