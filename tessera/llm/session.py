"""Session helpers of the training-data operators: tables, checkpoints, parallelism."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it was not installed on their path."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the session names in spark.checkpoint.dir. Where that setting is missing, a
    folder of our own serves if driver and executors are one process; on a cluster it is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-ck-"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that arrives in fewer partitions than there are cores over all cores; larger inputs,
    which the scan splits already, are left alone and not shuffled, and so are those that come out of a shuffle (to count
    the partitions of an adaptive plan would run it)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tidy(run: Callable) -> Callable:
    """A task's function over batches that gives its memory back when the task ends: the worker lives on, beside others."""

    def tidied(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def trim() -> None:
    """Give memory that is free back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
