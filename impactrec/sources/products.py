"""Product files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from impactrec.sources.schema import PRODUCT_SCHEMA, check_schema
from impactrec.staging import stage


def read_products(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = PRODUCT_SCHEMA,
    file_format: str = "csv",
    multi_line: bool = True,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Read a product table with a declared schema; nothing is inferred, so nothing is read twice.

    CSV files have a header, which is checked against ``schema``; a quoted field may span
    lines, and a quote inside one is doubled. A file with multi-line fields cannot be split,
    so large CSV inputs should come as many files, or with ``multi_line=False`` where no
    field holds a line break. Parquet and ORC are splittable and pruned by column.
    A value that does not fit its type fails the read; ``mode="PERMISSIVE"`` makes it NULL.
    """
    if file_format == "csv":
        return (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            .option("multiLine", multi_line)
            .option("escape", '"')
            .option("mode", mode)
            .csv(path)
        )
    paths = [path] if isinstance(path, str) else path
    table = spark.read.format(file_format).load(paths)
    return check_schema(table, schema).select(*schema.names)


class Checked(NamedTuple):
    """Rows that fit the schema, and the others as they stand in the file: ``file, record``."""

    rows: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        """``file, n_rejected`` of the files with rejected records."""
        return self.rejected.groupBy("file").agg(F.count(F.lit(1)).alias("n_rejected"))


def read_checked(
    spark: SparkSession, path: str | list[str], schema: T.StructType = PRODUCT_SCHEMA, multi_line: bool = True,
    header: bool = True,
) -> Checked:
    """Read CSV files as ``read_products`` does, and keep records that do not fit the schema apart.

    A record is rejected if a value does not fit its type, or if it has too few or too many fields; the read
    does not fail, and no value silently becomes NULL. The files are parsed once, whole records, and the
    result is staged: what a record looks like must not depend on the columns that are read of it.
    """
    record = "_rejected_record"
    read = stage(
        spark.read.schema(T.StructType([*schema.fields, T.StructField(record, T.StringType())]))
        .option("header", header)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", record)
        .option("columnPruning", False)
        .csv(path)
        .withColumn("_file", F.input_file_name())
    )
    rejected = read.where(F.col(record).isNotNull()).select(F.col("_file").alias("file"), F.col(record).alias("record"))
    return Checked(read.where(F.col(record).isNull()).select(*schema.names), rejected)
