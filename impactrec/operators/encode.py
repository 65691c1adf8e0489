"""Rule-based and learned encodings of categorical columns, vectors and scaling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from impactrec.functions.expressions import flag, is_missing
from impactrec.functions.ordering import running_totals
from impactrec.sources.schema import FEATURE_SETS, slot_names
from impactrec.staging import stage

#: Values of a column that a model on the driver takes; beyond them it refuses instead of filling the driver.
MAX_CATEGORIES = 100_000


@dataclass(frozen=True)
class Rule:
    """``output`` is 1 where ``source`` is one of ``values``, or missing if ``missing`` is set."""

    output: str
    source: str
    values: tuple[str, ...] = ()
    missing: bool = False

    def expression(self) -> Column:
        found = is_missing(self.source) if self.missing else F.lit(False)
        if self.values:
            found = found | F.col(self.source).isin(*self.values)
        return flag(found).alias(self.output)


# The dummy columns, and the texts that set them, spelled as in the product file.
DEFAULT_RULES = (
    Rule("Manufacturing_location_Africa", "Manufacturing_location", ("Africa",)),
    Rule("Manufacturing_location_America", "Manufacturing_location", ("America",)),
    Rule("Manufacturing_location_Asia", "Manufacturing_location", ("Asia",)),
    Rule("Manufacturing_location_Europe", "Manufacturing_location", ("Europe",)),
    Rule("Manufacturing_location_Unknown", "Manufacturing_location", missing=True),
    Rule("Drying_instruction_Linedry", "Drying_instruction", ("Line dry",)),
    Rule("Drying_instruction_Dryclean", "Drying_instruction", ("Dry clean",)),
    Rule("Drying_instruction_Tumble", "Drying_instruction", ("Tumble dry_ low",)),
    Rule("Washing_instruction_Machinehot", "Washing_instruction", ("Machine wash_ warm", "Machine wash_ hot")),
    Rule("Washing_instruction_Machinecold", "Washing_instruction", ("Machine wash_ cold",)),
    Rule("Washing_instruction_Handwash", "Washing_instruction", ("Hand wash",)),
    Rule("Washing_instruction_Dryclean", "Washing_instruction", ("Dry clean",)),
)


def encode_rules(df: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, drop_source: bool = True) -> DataFrame:
    """Add one 0/1 column per rule, in a single projection, and drop the source columns."""
    rules = tuple(rules)
    sources = {r.source for r in rules} if drop_source else set()
    kept = [c for c in df.columns if c not in sources]
    return df.select(*kept, *[r.expression() for r in rules])


def use_feature_set(df: DataFrame, name: str = "full") -> DataFrame:
    """Leave out the columns a named feature set does not use."""
    return df.drop(*FEATURE_SETS[name])


def _category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(name, value, n)``: every known value of every column with its count."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols])
    return (
        df.select(F.explode(cells).alias("cell"))
        .where("cell.value IS NOT NULL")
        .groupBy("cell.name", "cell.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def string_indexer(
    df: DataFrame, cols: Sequence[str], handle_invalid: str = "skip", suffix: str = "_index",
    max_categories: int | None = None,
) -> PipelineModel:
    """Fitted indices, one stage per column: by descending frequency, ties in value order.

    ``skip`` drops rows with a NULL or unseen value, ``keep`` gives them an index of their own.
    All columns are counted in one shuffle, so that no task holds every value. The model keeps
    them on the driver; with ``max_categories``, a column of more values is an error instead of a
    full driver. ``index_strings`` needs no model and has no such limit.
    """
    names = list(cols)
    counts = _category_counts(df, names)
    if max_categories is not None:
        counts = counts.limit(max_categories * len(names) + 1)
    labels: dict[str, list[tuple[int, str]]] = {c: [] for c in names}
    for name, value, n in counts.collect():
        labels[name].append((-n, value))
    crowded = [c for c, found in labels.items() if max_categories is not None and len(found) > max_categories]
    if crowded:
        hint = "raise max_categories, or build the vectors with sparse_features, which has no limit"
        raise ValueError(f"more than {max_categories} categories: {', '.join(crowded)}; {hint}")
    return PipelineModel([
        StringIndexerModel.from_labels(
            [value for _, value in sorted(labels[c])], inputCol=c, outputCol=c + suffix, handleInvalid=handle_invalid
        )
        for c in names
    ])


def index_strings(
    df: DataFrame, cols: Sequence[str], handle_invalid: str = "skip", suffix: str = "_index"
) -> DataFrame:
    """Add the index of every value, as ``string_indexer`` numbers them, for columns of any number of values.

    Values are ranked along ranges and joined back, so that no machine holds them all. ``skip``
    drops rows with a NULL, ``keep`` gives them the number after the last index.
    """
    counts = stage(_category_counts(df, cols).withColumn("one", F.lit(1).cast("bigint")))
    order = [F.desc("n"), F.col("value")]
    ranks = stage(running_totals(counts, ["name"], order, ["one"], keep=["value"]).select("name", "value", "cum_one"))
    sizes = {r["name"]: r["n"] for r in ranks.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in cols:
        index = (F.col("cum_one") - 1).cast("double").alias(c + suffix)
        known = ranks.where(F.col("name") == c).select(F.col("value").alias("_value"), index)
        same = F.col(c).cast("string") == F.col("_value")
        df = df.join(known, same, "inner" if handle_invalid == "skip" else "left").drop("_value")
        if handle_invalid == "keep":
            df = df.withColumn(c + suffix, F.coalesce(c + suffix, F.lit(float(sizes.get(c, 0)))))
    return df


def one_hot(df: DataFrame, cols: Sequence[str], max_categories: int | None = MAX_CATEGORIES) -> DataFrame:
    """Index with ``keep``, then encode: one slot per known value, all zeros for an unknown one.

    A column of more than ``max_categories`` values is an error: ``sparse_features`` has no such limit.
    """
    encoder = OneHotEncoder(
        inputCols=[f"{c}_index" for c in cols], outputCols=[f"{c}_encoded" for c in cols]
    )
    stages = [string_indexer(df, cols, "keep", max_categories=max_categories), encoder]
    return Pipeline(stages=stages).fit(df).transform(df).drop(*[f"{c}_index" for c in cols])


def expand_slots(df: DataFrame, vector_col: str) -> DataFrame:
    """Replace a vector column by one column per slot, named from its metadata."""
    values = vector_to_array(F.col(vector_col))
    slots = [values[i].alias(f"{vector_col}_{name}") for i, name in enumerate(slot_names(df, vector_col))]
    return df.select(*[c for c in df.columns if c != vector_col], *slots)


def assemble(
    df: DataFrame, cols: Sequence[str], output: str = "features", handle_invalid: str = "error"
) -> DataFrame:
    """Put columns into one vector; by default a NULL or NaN among them is an error."""
    return VectorAssembler(inputCols=list(cols), outputCol=output, handleInvalid=handle_invalid).transform(df)


def scale(df: DataFrame, cols: Sequence[str], output: str = "scaled_features") -> DataFrame:
    """Divide by the sample standard deviation, without centring; a constant column becomes 0."""
    assembled = assemble(df, cols, "_unscaled")
    scaler = StandardScaler(inputCol="_unscaled", outputCol=output, withStd=True, withMean=False)
    return scaler.fit(assembled).transform(assembled).drop("_unscaled")
