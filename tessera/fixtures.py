"""The driver's tables seen as attempts, problems, solution lists and the like, and the same views for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a user, so items differ in size."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("idx", F.row_number().over(w))
    return e.select(
        F.col("user_id").alias("item"), "idx", (F.col("event_type") == "purchase").cast("int").alias("passing"),
        F.col("event_type").isin("purchase", "click").cast("int").alias("passing_public"), F.col("value").alias("score"),
        (F.col("value") >= 50).cast("int").alias("label"), F.col("event_type").alias("output"),
        F.expr("cast(regexp_extract(props, r'([0-9]+)', 1) as bigint)").alias("num_tokens"), (F.col("value") / -100).alias("cumulative_logprob"),
        F.concat(F.lit("code "), F.expr("cast(event_id % 7 as string)")).alias("code"), "event_id",
    )


ATTEMPTS_SQL = """attempts as (select user_id as item, cast(idx as integer) as idx, cast(event_type = 'purchase' as integer) as passing,
  cast(event_type in ('purchase', 'click') as integer) as passing_public, value as score, cast(value >= 50 as integer) as label, event_type as output,
  cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as num_tokens, value / -100 as cumulative_logprob, 'code ' || (event_id % 7) as code, event_id
  from (select *, row_number() over (partition by user_id order by event_id) as idx from events))"""


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.col("lang").alias("difficulty"), "source")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts: quality as what was predicted, not toxic as what is right."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("predicted"), (1 - F.col("toxic")).alias("passing"))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category")), "doc_id")


JUDGED_SQL = "judged as (select l.doc_id, quality as predicted, 1 - toxic as passing, lang as category from labels l join documents d using (doc_id))"


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item"), F.col("turn").alias("idx"), F.col("text").alias("code"), "role")


def result_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts as items of result documents: one row a user, with the list of their attempts."""
    a = attempts(spark, sf_dir)
    fields = {"code": F.col("code"), "cumulative_logprob": F.col("cumulative_logprob"), "num_tokens": F.col("num_tokens"), "orm_score": F.col("score"), "passing": F.col("passing") == 1, "output": F.col("output"), "passing_public": F.col("passing_public") == 1, "orm_label": F.col("label")}
    listed = F.array_sort(F.collect_list(F.struct("idx", *[c.alias(n) for n, c in fields.items()])))
    by_item = a.groupBy("item").agg(F.transform(listed, lambda r: F.struct(*[r[n].alias(n) for n in fields])).alias("results"))
    name = F.concat(F.lit("u"), F.col("item").cast("string"))
    difficulty = F.when(F.col("item") % 3 == 0, "EASY").when(F.col("item") % 3 == 1, "HARD").otherwise("MEDIUM")
    return by_item.select(name.alias("unique_name"), F.concat(F.lit("question "), F.col("item").cast("string")).alias("prompt"), F.lit("").alias("starter_code"), difficulty.alias("difficulty"), "results")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small program for each benchmark item, with a comment and a tab; those of every third item do not parse."""
    n = F.col("item_id").cast("string")
    code = F.concat(F.lit("x = "), n, F.lit("  # first\nif x > 3 and x < 90:\n\tprint(x + 1)\nelse:\n\tprint(x"), F.when(F.col("item_id") % 3 == 0, "").otherwise(")"), F.lit("\n"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.lit(1).alias("idx"), code.alias("code"), F.lit("").alias("starter_code"))


PROGRAMS_SQL = """programs as (select item_id as item, 1 as idx,
  'x = ' || item_id || '  # first' || chr(10) || 'if x > 3 and x < 90:' || chr(10) || chr(9) || 'print(x + 1)' || chr(10) || 'else:' || chr(10) || chr(9) || 'print(x' || case when item_id % 3 = 0 then '' else ')' end || chr(10) as code from benchmark)"""
