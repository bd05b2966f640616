"""A local session for tests and tools; on a cluster the caller brings a session of their own."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8, shared: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillon")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, spark.checkpoint.dir; where that is unset a temporary one, but only
    if all tasks run in this process."""
    known = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quillon_dir", None)
    if not known:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = spark._quillon_dir = tempfile.mkdtemp(prefix="quillon-")
    return known
