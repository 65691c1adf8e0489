"""The product schema, column roles, and schema introspection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

KEY = "ID"
LABEL = "EI"

# Column names of the product file, spelled as in the file.
CATEGORICAL = ["Type", "Manufacturing_location", "Use_location", "Washing_instruction", "Drying_instruction"]
MATERIALS = [
    "Cotton", "Organic_cotton", "Linen", "Hemp", "Silk", "Wool", "Leather", "Cashmere", "Feathers",
    "Polyester", "Nylon", "Acrylic", "Spandex", "Elastane", "Polyamide", "Other_synthetic", "Lyocell",
    "Viscose", "Acetate", "Modal", "Rayon", "Other",
]
UNUSED_MATERIALS = ["Alpaca", "Other_animal", "Camel", "Other_regenerated", "Other_plant", "Jute"]
RECYCLING = ["Recycled_content", "Reused_content"]
LABEL_CODES = ["Material_label", "Chemicals_label", "Production_label", "Reusability_label", "Recylability_label"]
DISTANCE = "Transporation_distance"

# Columns each named feature set leaves out, after encoding.
FEATURE_SETS = {
    "full": UNUSED_MATERIALS,
    "core_materials": UNUSED_MATERIALS + [
        "Linen", "Hemp", "Silk", "Wool", "Leather", "Cashmere", "Feathers", "Nylon", "Acrylic", "Spandex",
        "Polyamide", "Other_synthetic", "Viscose", "Acetate", "Modal", "Rayon", "Other", "Recycled_content",
    ],
    "no_drying": UNUSED_MATERIALS + [
        "Drying_instruction_Linedry", "Drying_instruction_Dryclean", "Drying_instruction_Tumble",
    ],
}

PRODUCT_SCHEMA = T.StructType(
    [T.StructField(KEY, T.LongType()), T.StructField("Type", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in MATERIALS + UNUSED_MATERIALS + RECYCLING]
    + [T.StructField(c, T.IntegerType()) for c in LABEL_CODES]
    + [T.StructField(DISTANCE, T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in CATEGORICAL if c != "Type"]
    + [T.StructField(LABEL, T.IntegerType())]
)

FEATURE_MODES = ("all_numeric", "double_only")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = (KEY,)) -> list[str]:
    """Columns of a numeric type, in schema order, without those excluded."""
    left_out = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in left_out]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """String columns, in schema order, without those excluded."""
    left_out = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in left_out]


def model_columns(
    df: DataFrame, feature_mode: str = "all_numeric", exclude: Iterable[str] = (KEY, LABEL)
) -> tuple[list[str], list[str]]:
    """Model inputs by type: ``(strings to index, numbers to assemble)``.

    ``double_only`` leaves integer columns, the 0/1 dummies among them, out of the model.
    """
    if feature_mode not in FEATURE_MODES:
        raise ValueError(f"feature_mode must be one of {FEATURE_MODES}")
    numbers = numeric_columns(df, exclude)
    if feature_mode == "double_only":
        numbers = [c for c in numbers if isinstance(df.schema[c].dataType, T.DoubleType)]
    return categorical_columns(df, exclude), numbers


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fail unless every declared column is present with its declared type."""
    found = {f.name: f.dataType for f in df.schema}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, found "
        + (found[f.name].simpleString() if f.name in found else "nothing")
        for f in schema
        if found.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError("schema mismatch; " + "; ".join(wrong))
    return df


def schema_table(df: DataFrame, key: str = KEY, label: str = LABEL) -> DataFrame:
    """Names, types and roles of the columns, with how many rows carry a value.

    One pass over the data: the counts of all columns come from a single aggregate.
    """
    strings, numbers = model_columns(df, exclude=(key, label))
    doubles = model_columns(df, "double_only", exclude=(key, label))[1]

    def role(name: str) -> str:
        if name in (key, label):
            return "key" if name == key else "label"
        if name in strings:
            return "categorical"
        if name in numbers:
            return "numeric"
        return "other"

    counts = df.agg(
        F.array(*[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(role(f.name)).alias("role"),
                F.lit(f.name in doubles).alias("in_double_only"),
                F.count(F.col(f"`{f.name}`")).alias("n_present"),
                F.count(F.lit(1)).alias("n_rows"),
            )
            for i, f in enumerate(df.schema)
        ]).alias("columns")
    )
    return counts.select(F.inline("columns"))


def slot_names(df: DataFrame, vector_col: str) -> list[str]:
    """Names of the slots of a vector column, read from all its attribute groups."""
    groups = df.schema[vector_col].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a for attrs in groups.values() for a in attrs), key=lambda a: a["idx"])
    return [a.get("name", f"{vector_col}_{a['idx']}") for a in slots]
