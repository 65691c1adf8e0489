from impactrec.sources.products import Checked, read_checked, read_products
from impactrec.sources.schema import (
    CATEGORICAL,
    FEATURE_SETS,
    KEY,
    LABEL,
    PRODUCT_SCHEMA,
    UNUSED_MATERIALS,
    categorical_columns,
    check_schema,
    model_columns,
    numeric_columns,
    schema_table,
    slot_names,
)
from impactrec.sources.star import load_table, noisy_products, product_table, score_table

__all__ = [
    "CATEGORICAL", "Checked", "FEATURE_SETS", "KEY", "LABEL", "PRODUCT_SCHEMA", "UNUSED_MATERIALS",
    "categorical_columns", "check_schema", "load_table", "model_columns", "noisy_products",
    "numeric_columns", "product_table", "read_checked", "read_products", "schema_table", "score_table",
    "slot_names",
]
