"""A session with the settings the library is tested with."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(
    cores: int | str = 8, partitions: int | None = None, memory: str = "16g", checkpoints: str | None = None
) -> SparkSession:
    """A local session for tests and measurements; on a cluster, use the session you are given.

    Staged tables go to ``checkpoints``, by default a folder for temporary files: all tasks run here.
    """
    checkpoints = checkpoints or f"{tempfile.gettempdir()}/impactrec-checkpoints"
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("impactrec")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.checkpoint.dir", checkpoints)
        .config("spark.sql.adaptive.enabled", "true")
        # Keeps code generation for summaries of wide tables.
        .config("spark.sql.codegen.maxFields", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
