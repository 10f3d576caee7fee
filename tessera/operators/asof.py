"""As-of alignment: for each row the last row of a log at or before its step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import checkpoint


def last_at_or_before(rows: DataFrame, log: DataFrame, series: str, step: str, values: list[str], partitions: int | None = None) -> DataFrame:
    """`rows` with the `values` and the `log_step` of the last row of `log` in its series at or before its step; of several at
    that step the one with the greatest values in their order. Null where there is none, or where series or step is null.

    Both tables go to ranges of (series, step), so a series of any length is spread; a running last value fills each
    range, and what a range of the same series before it ended with, one row a range, is carried in by a broadcast."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = F.struct(*[F.col(c) for c in rows.columns])
    value = F.struct(F.col(step).alias("log_step"), *values)
    told = log.where(F.col(series).isNotNull() & F.col(step).isNotNull()).select(F.col(series).alias("s"), F.col(step).alias("t"), F.lit(0).alias("kind"), value.alias("v"), F.lit(None).cast(rows.select(held.alias("r")).schema["r"].dataType).alias("r"))
    asked = rows.select(F.col(series).alias("s"), F.col(step).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(told.schema["v"].dataType).alias("v"), held.alias("r"))
    both = told.unionByName(asked).repartitionByRange(n, "s", "t", "kind", F.xxhash64("r", "v"))  # rows at one step may be many: they are spread too
    placed = checkpoint(both.withColumn("part", F.spark_partition_id()))
    ends = placed.where("kind = 0").groupBy("s", "part").agg(F.max("v").alias("v"))
    first = placed.where("kind = 1 and s is not null").groupBy("part").agg(F.min("s").alias("s"))  # only a range's first series can have begun before it
    edge = ends.join(F.broadcast(first.select("s").distinct()), "s")
    line = first.select("s", "part", F.lit(True).alias("asks")).join(edge, ["s", "part"], "full_outer")  # two rows a range at most
    before = Window.partitionBy("s").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    carried = line.withColumn("c", F.max("v").over(before)).where("asks").select("s", "part", "c")
    inside = Window.partitionBy("part", "s").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = placed.withColumn("f", F.max("v").over(inside)).where("kind = 1")
    out = filled.join(F.broadcast(carried), ["s", "part"], "left").withColumn("f", F.when(F.col("t").isNotNull(), F.greatest("f", "c")))
    return out.select("r.*", F.col("f.log_step").alias("log_step"), *[F.col(f"f.{v}").alias(v) for v in values])
