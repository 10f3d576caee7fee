"""Stored sketches: distinct counts and quantiles by file, kept and united without reading rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import batches

LG_BUCKETS = 12  # of the distinct count: 4096 registers, some 1.6 per cent of standard error
KLL = 200  # size of the quantile sketch: a rank error of some 1.3 per cent


def sketched(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """(file, by..., n, keys, quantiles): a row for each file and group, sketches of its keys and values (nulls left out)."""
    named = rows.select(F.col("_metadata.file_path").alias("file"), *by, F.col(key).alias("__k"), F.col(value).cast("double").alias("__v"))
    return named.groupBy("file", *by).agg(F.count("*").alias("n"), F.hll_sketch_agg("__k", F.lit(LG_BUCKETS)).alias("keys"), F.kll_sketch_agg_double("__v", F.lit(KLL)).alias("quantiles"))


def refresh(rows: DataFrame, path: str, by: list[str], key: str, value: str) -> int:
    """Sketches the files of `rows` (a scan of files) that the store at `path` has not seen, as one committed batch; gives how many
    files those were. Files are told by name, and a file's rows are read once."""
    spark = rows.sparkSession
    seen = stored(rows, path, by).select("file").distinct()
    new = rows.select(F.col("_metadata.file_path").alias("file")).distinct().join(seen, "file", "left_anti")
    fresh = new.count()
    if fresh:
        chosen = rows.join(F.broadcast(new) if fresh <= 100_000 else new, F.col("_metadata.file_path") == new["file"], "left_semi")
        number = batches.next_batch(spark, path)
        batches.commit(spark, path, number, batches.write_batch(sketched(chosen, by, key, value), path, number))
    return fresh


def stored(rows: DataFrame, path: str, by: list[str]) -> DataFrame:
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return batches.committed(rows.sparkSession, path, f"file string, {kinds}{', ' if by else ''}n long, keys binary, quantiles binary")


def rolled_up(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches united by fewer columns; what comes out may be united again."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def distinct(name: str = "keys") -> Column:
    return F.hll_sketch_estimate(name)


def quantile(q: float, name: str = "quantiles") -> Column:
    """The estimated q-quantile; null where no value was sketched."""
    return F.when(F.kll_sketch_get_n_double(name) > 0, F.kll_sketch_get_quantile_double(name, F.lit(q)))
