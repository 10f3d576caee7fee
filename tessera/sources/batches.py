"""Batches of generated rows with a commit record each: what was cut off leaves nothing that a reader sees.

A batch is written to a folder of its own attempt; then a record that names the folder is moved into place, which no
file system does twice for one name. Readers take only folders that a record names, and a run goes on with the first
batch that has none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.documents import listed


class Taken(RuntimeError):
    """Another run has committed the batch."""


def _put(spark: SparkSession, path: str, body: str) -> None:
    """A file with a body, all at once, or Taken if it is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).makeQualified(target).toUri(), conf)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    files = target.getFileSystem(conf)
    out = files.create(draft)
    out.write(bytearray(body, "utf-8"))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        store.rename(draft, target, options)
    except Exception as refused:
        files.delete(draft, False)
        if files.exists(target):
            raise Taken(path) from None
        raise refused


def records(spark: SparkSession, path: str) -> list[str]:
    """Paths of the commit records, one a batch."""
    return [f for f in listed(spark, f"{path}/commits") if f.endswith(".json")]


def next_batch(spark: SparkSession, path: str) -> int:
    """The first batch without a record."""
    done = {int(f.rpartition("/")[2].split(".")[0]) for f in records(spark, path)}
    return next(k for k in range(len(done) + 1) if k not in done)


def write_batch(rows: DataFrame, path: str, batch: int) -> str:
    """Writes rows where no reader looks; gives the folder for `commit`."""
    folder = f"data/{batch}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    return folder


def commit(spark: SparkSession, path: str, batch: int, folder: str) -> None:
    """Makes a written batch visible; Taken if the batch has a record already."""
    _put(spark, f"{path}/commits/{batch}.json", json.dumps({"batch": batch, "folder": folder}))


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of committed batches with their `batch`; none gives an empty table of the schema. Records are read by Spark, so the
    driver holds one folder's name a batch and nothing else."""
    found = records(spark, path)
    if not found:
        return spark.createDataFrame([], f"{schema}, batch int")
    known = spark.read.schema("batch int, folder string").json(found)
    folders = [r.folder for r in known.collect()]
    rows = spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]).select("*", F.regexp_extract(F.col("_metadata.file_path"), "/(data/[^/]+)/[^/]+$", 1).alias("folder"))
    return rows.join(F.broadcast(known), "folder").drop("folder")  # one row a batch


def resumed(spark: SparkSession, path: str, batches: int, make: Callable[[int], DataFrame]) -> list[int]:
    """Makes, writes and commits the batches that have no record; gives their numbers. `make` is called for those alone."""
    made = []
    while (k := next_batch(spark, path)) < batches:
        commit(spark, path, k, write_batch(make(k), path, k))
        made.append(k)
    return made
