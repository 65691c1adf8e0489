import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impactrec import staging
from impactrec.operators import encode_rules, use_feature_set
from impactrec.plans.queries import all_queries
from impactrec.sources import (
    PRODUCT_SCHEMA,
    check_schema,
    model_columns,
    noisy_products,
    numeric_columns,
    read_checked,
    read_products,
    schema_table,
)
from impactrec.staging import checkpoint_root, stage

NOTES = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType())])


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note\n1,"two\nlines, one ""word"""\n2,\n3,NaN\n')
    rows = {r.id: r.note for r in read_products(spark, str(path), NOTES).collect()}
    assert rows == {1: 'two\nlines, one "word"', 2: None, 3: "NaN"}


def test_nan_text_is_a_number_only_in_a_number_column(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("id,note\n1,NaN\n2,\n")
    schema = T.StructType([NOTES["id"], T.StructField("note", T.DoubleType())])
    values = {r.id: r.note for r in read_products(spark, str(path), schema).collect()}
    assert values[1] != values[1] and values[2] is None


def test_csv_header_must_match(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("key,note\n1,a\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_products(spark, str(path), NOTES).collect()


def test_csv_bad_value_fails_or_is_null(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("id,note\nx,a\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_products(spark, str(path), NOTES).collect()
    assert read_products(spark, str(path), NOTES, mode="PERMISSIVE").first().id is None


def test_product_file_round_trip(spark, tmp_path):
    values = {f.name: (1 if f.name in ("ID", "EI") else None) for f in PRODUCT_SCHEMA}
    one = spark.createDataFrame([values], PRODUCT_SCHEMA)
    one.write.option("header", True).csv(str(tmp_path / "csv"))
    one.write.parquet(str(tmp_path / "parquet"))
    for kind in ("csv", "parquet"):
        table = read_products(spark, str(tmp_path / kind), file_format=kind)
        assert table.schema == PRODUCT_SCHEMA and table.first().asDict() == values


def test_schema_check(spark):
    table = spark.createDataFrame([(1, "a")], "id int, note string")
    with pytest.raises(ValueError, match="id: expected bigint, found int"):
        check_schema(table, NOTES)


def test_numeric_columns_leave_out_dates_and_booleans(spark):
    table = spark.range(1).select(
        F.col("id").alias("ID"), F.lit(1.0).alias("x"), F.lit(True).alias("flag"), F.current_date().alias("day")
    )
    assert numeric_columns(table) == ["x"]


def test_double_only_mode_loses_the_dummies(products):
    encoded = encode_rules(products)
    strings, numbers = model_columns(encoded)
    _, doubles = model_columns(encoded, "double_only")
    assert strings == ["Type", "Use_location"]
    assert doubles == ["Cotton", "Organic_cotton", "Polyester", "Elastane"]
    assert {"Manufacturing_location_Asia", "Material_label"} <= set(numbers)
    assert not {"ID", "EI"} & set(numbers)
    with pytest.raises(ValueError):
        model_columns(encoded, "all")


def test_a_double_label_stays_out_of_the_inputs(products):
    table = products.withColumn("EI", F.col("EI").cast("double"))
    assert "EI" not in model_columns(table)[1] and "EI" not in model_columns(table, "double_only")[1]


def test_feature_sets(products):
    encoded = encode_rules(products)
    assert "Drying_instruction_Tumble" not in use_feature_set(encoded, "no_drying").columns
    assert "Drying_instruction_Tumble" in use_feature_set(encoded, "core_materials").columns
    with pytest.raises(KeyError):
        use_feature_set(encoded, "other")


def test_feature_sets_of_the_whole_product_table(spark):
    encoded = encode_rules(spark.createDataFrame([], PRODUCT_SCHEMA))
    sizes = {s: len(use_feature_set(encoded, s).columns) for s in ("full", "core_materials", "no_drying")}
    # 43 columns less 6 unused materials and 3 encoded sources, plus 12 dummies.
    assert sizes == {"full": 46, "core_materials": 28, "no_drying": 43}
    assert len(numeric_columns(use_feature_set(encoded, "full"), ("ID", "EI"))) == 42


def test_schema_table_counts_values(products):
    rows = {r.column_name: r for r in schema_table(products).collect()}
    assert rows["Manufacturing_location"].n_present < rows["Manufacturing_location"].n_rows == 2000
    assert (rows["ID"].role, rows["EI"].role, rows["Type"].role) == ("key", "label", "categorical")


def test_noisy_products_move_a_tenth(products):
    moved = noisy_products(products).withColumnRenamed("EI", "new").join(products, "ID").where("new != EI")
    assert moved.count() == products.where("ID % 10 = 0").count()


def test_stage_keeps_rows_and_metadata(spark):
    metadata = {"ml_attr": {"type": "nominal", "num_vals": 3}}
    table = spark.range(5).withMetadata("id", metadata)
    kept = stage(table)
    assert kept.count() == 5 and kept.schema["id"].metadata == metadata


def test_release_deletes_staged_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "checkpoint_root", lambda session: str(tmp_path))
    stage(spark.range(3))
    assert list(tmp_path.rglob("*.parquet"))
    staging.release(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_a_cluster_must_name_a_checkpoint_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


@pytest.mark.parametrize("warehouse, root", [
    ("hdfs://name/warehouse/", "hdfs://name/warehouse/impactrec-checkpoints"),
    ("file:/mnt/shared/warehouse", "file:/mnt/shared/warehouse/impactrec-checkpoints"),
    ("file:/home/driver/spark-warehouse", None),
    ("spark-warehouse", None),
])
def test_a_cluster_may_name_a_warehouse(warehouse, root):
    class Context:
        master = "spark://host:7077"
        named: list[str] = []

        @staticmethod
        def getCheckpointDir():
            return None

        def setCheckpointDir(self, path):
            self.named.append(path)

    class Conf:
        @staticmethod
        def get(name, default):
            return warehouse if name == "spark.sql.warehouse.dir" else default

    class Session:
        sparkContext, conf = Context(), Conf()

    if root is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_root(Session())
    else:
        assert checkpoint_root(Session()) == root
        assert Session.sparkContext.named[-1] == root


def test_a_result_outlives_its_scope(spark):
    with staging.staged(spark):
        with staging.staged(spark):
            inner = stage(spark.range(3))
            result = stage(inner, result=True)
        assert result.count() == 3
        with pytest.raises(Exception):
            inner.count()
    with pytest.raises(Exception):
        result.count()


def test_the_contract_imports_without_the_training_data_operators(tmp_path):
    """From a copy without both folders and the pipeline, all other queries are there."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "impactrec", tmp_path / "impactrec", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(all_queries())), "False", "False", "True"]


def test_records_that_do_not_fit_are_kept_apart(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text('id,note\n1,"a ""quoted""\nnote"\n2,\n')
    bad.write_text("id,note\nx,not a number\n3,fine\n4,too,many\n5\n6,last\n")
    found = read_checked(spark, [str(good), str(bad)], NOTES)
    assert sorted((r.id, r.note) for r in found.rows.where("note IS NOT NULL").collect()) == [(1, 'a "quoted"\nnote'), (3, "fine"), (6, "last")]
    assert found.rows.where("note IS NULL").select("id").collect() == [(2,)]
    records = sorted(r.record for r in found.rejected.collect())
    assert records == ["4,too,many", "5", "x,not a number"]
    [counted] = found.counts().collect()
    assert counted.file.endswith("bad.csv") and counted.n_rejected == 3
    assert found.rows.count() == 4 and found.rejected.count() == 3
