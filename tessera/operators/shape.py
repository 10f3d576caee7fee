"""What JSON columns hold, and lattices smoothed by a kernel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import checkpoint

_KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer"}  # others are numbers


def json_inventory(rows: DataFrame, column: str) -> DataFrame:
    """(path, type, n): every path that the JSON texts of a column hold, `$` for the whole, `.key` for a member, `[*]` for any element,
    with each type met there (object, array, string, integer, number, boolean, null) and how often; a text that is no JSON
    counts as `broken` at `$`, a null one not at all.

    Texts become variants; a level of nesting is one generator over the one before it, without a shuffle, and all levels
    meet in one aggregation."""
    value = F.try_parse_json(column)
    named = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    kind = F.lit("number")
    for spark_name, name in _KINDS.items():
        kind = F.when(named == spark_name, name).otherwise(kind)
    level = rows.where(F.col(column).isNotNull()).select(F.lit("$").alias("path"), value.alias("v"))
    counted = level.groupBy("path", F.when(F.col("v").isNull(), "broken").otherwise(kind).alias("type")).agg(F.count("*").alias("n"))
    parts = [counted]
    while True:
        inner = level.where(named.isin("OBJECT", "ARRAY")).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
        member = F.when(F.col("key").isNull(), "[*]").otherwise(F.concat(F.lit("."), F.col("key")))
        level = inner.select(F.concat("path", member).alias("path"), F.col("value").alias("v"))
        here = checkpoint(level.groupBy("path", kind.alias("type")).agg(F.count("*").alias("n")))
        parts.append(here)
        if here.where("type in ('object', 'array')").isEmpty():
            break
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("path", "type").agg(F.sum("n").alias("n"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of offsets -r..r, r = the rounded truncate * sigma; they add up to 1."""
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


def smoothed(cells: DataFrame, x: str, y: str, value: str, width: int, height: int, sigma: float = 1.0, truncate: float = 4.0) -> DataFrame:
    """(x, y, value) of a lattice x in 0..width-1, y in 0..height-1 after a Gaussian kernel along x, then along y. Beyond an edge the
    lattice is reflected, the edge cell itself repeated. A cell whose kernel meets one that is missing or null is null.

    Each pass looks up its 2r+1 neighbours by an equi-join on the other coordinate and the reflected place."""
    spark = cells.sparkSession
    grid = spark.range(width * height).select(F.expr(f"cast(id % {width} as int)").alias(x), F.expr(f"cast(id div {width} as int)").alias(y))
    known = cells.select(F.col(x).cast("int").alias(x), F.col(y).cast("int").alias(y), F.col(value).cast("double").alias("v"))
    weights = gaussian_weights(sigma, truncate)
    r = len(weights) // 2
    kernel = F.array(*[F.struct(F.lit(k - r).alias("off"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    for along, across, size in ((x, y, width), (y, x, height)):
        turn = F.pmod(F.col(along) + F.col("k.off"), F.lit(2 * size))
        near = grid.select(x, y, F.explode(kernel).alias("k")).select(x, y, F.when(turn < size, turn).otherwise(2 * size - 1 - turn).alias("at"), F.col("k.w").alias("w"))
        met = near.join(known.select(F.col(across), F.col(along).alias("at"), "v"), [across, "at"], "left")
        known = met.groupBy(x, y).agg(F.when(F.bool_and(F.col("v").isNotNull()), F.sum(F.col("v") * F.col("w"))).alias("v"))
    return known.select(x, y, F.col("v").alias(value))
