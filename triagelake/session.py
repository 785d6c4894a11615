"""Session helpers: configuration and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "triagelake", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # Checkpoints go when nothing refers to them; a cluster should set the same.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only on local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="triagelake-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the plan restarts from files that survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows whose processing costs far more than their bytes suggest.

    Adaptive execution sizes partitions by bytes and would give such rows to few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def at_once(steps: Iterable[Callable]) -> list:
    """The results of independent steps whose small jobs run side by side, in order; the first error in order is raised."""
    targets = [inheritable_thread_target(step) for step in steps]
    with ThreadPoolExecutor(8) as pool:
        return [job.result() for job in [pool.submit(target) for target in targets]]
