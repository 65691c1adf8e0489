from impactrec.operators.adaptive import propose, tune_adaptive
from impactrec.operators.encode import (
    DEFAULT_RULES,
    Rule,
    assemble,
    encode_rules,
    expand_slots,
    index_strings,
    one_hot,
    scale,
    string_indexer,
    use_feature_set,
)
from impactrec.operators.metrics import auc, class_metrics, classification_metrics, confusion, mean_auc, roc, unlabelled_rows
from impactrec.operators.models import (
    DEFAULT_PARAMS,
    aligned_scores,
    importances,
    model_stages,
    score,
    skipped_rows,
    train,
)
from impactrec.operators.profile import (
    column_histogram,
    count_missing,
    count_where,
    describe_long,
    distinct_values,
    duplicate_rows,
    histograms,
    preview,
    profile,
    quantiles,
    top_values,
    value_counts,
)
from impactrec.operators.recommend import recommend
from impactrec.operators.reduce import (
    components_for,
    cumulative_variance,
    feature_pipeline,
    pca,
    pca_inputs,
    select_features,
)
from impactrec.operators.sparse import Sparse, sparse_features, value_slots, vector_cells
from impactrec.operators.split import split_by_key, split_part, split_random
from impactrec.operators.stats import chi_square, chi_square_test, corr_matrix, corr_pair
from impactrec.operators.trees import decision_paths, leaf_paths, prefix_predictions, tree_nodes
from impactrec.operators.tune import DEFAULT_SPACE, refit, refit_found, sample_space, tune_folds, tune_random
from impactrec.operators.wide import pca_wide

__all__ = [name for name in dir() if not name.startswith("_")]
