"""Readers and writers of result documents, test files, chunk and run folders, traces and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPT = "code string, cumulative_logprob double, num_tokens bigint, orm_score double, passing boolean, output string, passing_public boolean, output_public string, orm_label int, orm_0_score double, orm_1_score double"
ITEM = f"unique_name string, prompt string, starter_code string, difficulty string, results array<struct<{re.sub(r'(\w+) (\w+)', r'\1: \2', ATTEMPT)}>>"
HEADER = "model string, max_tokens bigint, top_p double, temperature double, completion_limit bigint, dataset_name string, evolver_e bigint, rm string, orm_model string, strip_comments boolean, prefix_starter boolean"
DOCUMENT = f"{HEADER}, items array<struct<unique_name: string, prompt: string, starter_code: string, difficulty: string, results: array<struct<{re.sub(r'(\w+) (\w+)', r'\1: \2', ATTEMPT)}>>>>"


def read_documents(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Result documents (plain or gzip JSON, one a file or, with `lines`, one a line) with an explicit schema: an absent
    key is null. Files that are not JSON come as a row with null items, as do empty ones. Paths may be globs."""
    return spark.read.schema(DOCUMENT).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())


def items_of(documents: DataFrame) -> DataFrame:
    return documents.select("file", F.posexplode("items").alias("row_idx", "i")).select("file", "row_idx", "i.*")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items that stand one a line."""
    return spark.read.schema(ITEM).json(path).withColumn("file", F.input_file_name()).withColumn("row_idx", F.lit(None).cast("int"))


def attempts_of(items: DataFrame) -> DataFrame:
    """One row an attempt, idx from 1."""
    a = items.select("file", F.col("unique_name").alias("item"), "row_idx", "difficulty", F.posexplode("results").alias("p", "r"))
    return a.select("file", "item", "row_idx", "difficulty", (F.col("p") + 1).alias("idx"), "r.*")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any Hadoop file system has the path, which may be a glob."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_attempts(spark: SparkSession, path: str) -> DataFrame | None:
    """Attempts from a JSON document (by suffix) or from a Parquet folder of items; None where there is nothing. A folder
    without results is an error."""
    if not exists(spark, path):
        return None
    if re.search(r"\.json(\.gz)?/?$|\.json", path):
        return attempts_of(items_of(read_documents(spark, path)))
    items = spark.read.parquet(path)
    if "results" not in items.columns:
        raise ValueError(f"{path} holds no results")
    for name, kind in (("file", "string"), ("difficulty", "string"), ("row_idx", "int")):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    return attempts_of(items)


def read_split(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Splits of a data set as one table, with the part's number."""
    out = None
    for k, p in enumerate(paths):
        t = spark.read.parquet(p).withColumn("split", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def resolve(spark: SparkSession, path: str, root: str) -> str:
    """The path itself if it is there, else the one under `root`. Any Hadoop file system will do."""
    return path if exists(spark, path) else f"{root.rstrip('/')}/{path}"


def read_test_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(problem, test, input, output) of the test files below a folder, read whole, line ends as they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return test_pairs(files.select("path", F.decode("content", "UTF-8").alias("body")))


def test_pairs(files: DataFrame) -> DataFrame:
    """(problem, test, input, output) from files (path, body) in folders named by problem: a file belongs to test i if its name starts with 'i.'
    or ends with '.i'; of the two, the one with an 'o' in its lower-cased name is the output. A test without
    exactly one of each is an error."""
    named = files.select(F.element_at(F.split("path", "/"), -2).alias("problem"), F.lower(F.element_at(F.split("path", "/"), -1)).alias("name"), "body")
    test = F.coalesce(F.nullif(F.regexp_extract("name", r"^(\d+)\.", 1), F.lit("")), F.nullif(F.regexp_extract("name", r"\.(\d+)$", 1), F.lit("")))
    kind = F.when(F.col("name").contains("o"), "output").when(F.col("name").contains("i"), "input")
    found = named.withColumn("test", test.cast("int")).where("test is not null").withColumn("kind", kind)
    both = found.groupBy("problem", "test").agg(F.max(F.when(F.col("kind") == "input", F.col("body"))).alias("input"), F.max(F.when(F.col("kind") == "output", F.col("body"))).alias("output"), F.count("*").alias("n"))
    wrong = (F.col("n") != 2) | F.col("input").isNull() | F.col("output").isNull()
    return both.select("problem", "test", F.when(wrong, F.raise_error(F.concat(F.lit("not two files for test "), F.col("test").cast("string")))).otherwise(F.col("input")).alias("input"), "output")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All chunk folders below a folder as one table."""
    return spark.read.option("mergeSchema", True).parquet(f"{folder.rstrip('/')}/*")


def run_columns(path: str | Column = "file") -> dict[str, Column]:
    """What a file's name tells: checkpoint and run numbers, temperature, generator and reward model."""
    p = F.col(path) if isinstance(path, str) else path
    stem = F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.json(\.gz)?$", "")
    parts = F.split(stem, "_")
    number = lambda pattern: F.regexp_extract(p, pattern, 1).try_cast("int")
    return {"checkpoint": number(r"checkpoint-(\d+)_?"), "run": number(r"run_(\d+)"), "temperature": F.element_at(parts, -1).try_cast("double"), "generator": F.try_element_at(parts, F.lit(3)), "reward_model": F.element_at(parts, -1)}


def read_runs(spark: SparkSession, folder: str, pattern: str = "*.json*") -> DataFrame:
    """Documents of all files below a folder that match, with the columns that their names tell."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder).withColumn("file", F.input_file_name())
    return docs.withColumns(run_columns())


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Integers of a text file, parted by blanks."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("v")).select(F.col("v").try_cast("int").alias("token")).where("token is not null")


def to_items(attempts: DataFrame, fields: list[str]) -> DataFrame:
    """Attempts back to one row an item, results in order of idx."""
    row = F.struct("idx", *fields)
    listed = F.array_sort(F.collect_list(row))
    return attempts.groupBy("item").agg(F.transform(listed, lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias("results")).withColumnRenamed("item", "unique_name")


def write_items(items: DataFrame, path: str, fmt: str = "gzjson") -> None:
    """Items as gzip JSON lines or as Parquet, in place of what is there; other formats are an error."""
    if fmt == "gzjson":
        items.select(F.to_json(F.struct(*items.columns)).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
    elif fmt in ("datasets", "parquet"):
        items.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def documents(items: DataFrame, header: dict) -> DataFrame:
    """Items as documents of one item each, every one with the whole header, so no list grows with the table."""
    return items.select("*", *[F.lit(v).alias(k) for k, v in header.items()], F.array(F.struct(*items.columns)).alias("items"))


def write_documents(items: DataFrame, header: dict, path: str, by: str = "difficulty") -> None:
    """A folder for each value of a key, its items as documents, one a gzip JSON line, the header in each."""
    docs = documents(items, header).select(F.col(by).alias("part"), F.to_json(F.struct(*header, "items")).alias("value"))
    docs.write.mode("overwrite").option("compression", "gzip").partitionBy("part").text(path)


def to_columnar(spark: SparkSession, source: str, target: str, lines: bool = False) -> None:
    """Result documents as Parquet rows, one an item, header columns on each."""
    docs = read_documents(spark, source, lines)
    docs.select("file", *[c for c in docs.columns if c not in ("file", "items")], F.posexplode("items").alias("row_idx", "i")).select("*", "i.*").drop("i").write.mode("overwrite").parquet(target)


def write_splits(splits: dict[str, DataFrame], path: str) -> None:
    """Named splits of a data set under one path."""
    for name, rows in splits.items():
        rows.write.mode("overwrite").parquet(f"{path}/split={name}")


def read_splits(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """All splits, with the column `split`, or one of them without it."""
    whole = spark.read.option("mergeSchema", True).parquet(path)
    return whole if name is None else whole.where(F.col("split") == name).drop("split")


def write_document(items: DataFrame, header: dict, path: str) -> None:
    """A single document with its header, for readers that want one; its items meet in one task."""
    head = [F.lit(v).alias(k) for k, v in header.items()]
    doc = items.agg(F.collect_list(F.struct(*items.columns)).alias("items")).select(*head, "items")
    doc.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").option("compression", "gzip").text(path)


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """A batch of generated rows beside those before it; writing a batch again replaces it."""
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def write_by_key(rows: DataFrame, path: str, key: str = "difficulty") -> None:
    """A folder for each value of the key."""
    rows.write.mode("overwrite").partitionBy(key).parquet(path)


def relaid_by_checkpoint(rows: DataFrame, path: str) -> None:
    """Runs of checkpoints as checkpoints of runs."""
    rows.withColumns({k: v for k, v in run_columns().items() if k in ("run", "checkpoint")}).write.mode("overwrite").partitionBy("checkpoint", "run").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small table as CSV with a header; null shows as N/A."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "N/A").csv(path)
