"""Session settings and shared-folder checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans count on. Set only when the cluster left them unset.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# For queries whose windows keep a partition's rows in a task's memory: many small shuffle partitions, which adaptive
# execution joins up to this size, so that a task's memory does not grow with the tables.
WINDOW_DEFAULTS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}


def tune(spark: SparkSession, more: dict[str, str] | None = None) -> SparkSession:
    """Apply the runtime defaults, and ``more``, that the session does not already set."""
    for key, value in (RUNTIME_DEFAULTS | (more or {})).items():
        if spark.conf.get(key, None) in (None, "false") and key.endswith("forceOptimizeSkewedJoin"):
            spark.conf.set(key, value)
        elif spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", name: str = "tickloom") -> SparkSession:
    """A local session for tests and the benchmark."""
    shuffle = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may leave it unset: its executors share the machine, so a temporary folder will do.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="tickloom-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder; see :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
