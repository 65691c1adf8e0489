"""Tables written once to shared storage, to cut lineage between stages of a job.

A staged table is plain parquet under the checkpoint directory the cluster names, so
it survives the loss of any executor, and every later pass reads only the columns it
needs instead of recomputing the plan behind them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "impactrec-stage"


class _Scope(list):
    """The paths that a scope deletes; ``outer`` takes those of its results."""

    def __init__(self, outer: list[str] | None):
        self.outer = [] if outer is None else outer


_scope: ContextVar[_Scope | None] = ContextVar("impactrec_stage_scope", default=None)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for staged tables and ML checkpoints.

    Taken from ``spark.checkpoint.dir`` or the context's checkpoint directory, else a folder in the
    session's warehouse. On a cluster Spark's default warehouse, a folder of the driver's machine, is
    refused.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        warehouse = (spark.conf.get("spark.sql.warehouse.dir", None) or "").rstrip("/")
        of_driver = not warehouse or (
            warehouse.split("/")[-1] == "spark-warehouse" and (warehouse.startswith("file:") or ":" not in warehouse)
        )
        if of_driver and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{warehouse or 'spark-warehouse'}/impactrec-checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def _stage_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    return f"{checkpoint_root(spark).rstrip('/')}/{_FOLDER}/{app}"


def stage_path(spark: SparkSession, result: bool = False) -> str:
    """A new path in the shared folder. The scope that is open, if any, deletes it; a ``result`` is
    left to the scope around that one."""
    path = f"{_stage_folder(spark)}/{uuid.uuid4().hex}"
    if (made := _scope.get()) is not None:
        (made.outer if result else made).append(path)
    return path


def stage(df: DataFrame, result: bool = False) -> DataFrame:
    """Write ``df`` once and return it read back. Column ML metadata is kept.

    A ``result`` outlives the scope that is open.
    """
    path = stage_path(df.sparkSession, result)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside, once their results have been written or collected.

    Tables that other code staged before or elsewhere stay. Scopes may be nested; a result that
    still reads a table of its scope must be used up inside it, or be staged as a ``result``.
    """
    made = _Scope(_scope.get())
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every table this application staged; call when no result needs them."""
    _delete(spark, _stage_folder(spark))
