"""Ordered selection, de-duplication, sampling and set operations. Order is always an explicit column.

Random picks order rows by the md5 of seed and key, so they are the same on every run and layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEW_ROWS = 100_000  # rows that a sorted limit may bring to one task


def since(rows: DataFrame, column: str, cutoff: str) -> DataFrame:
    """Rows from a point in time on; the cutoff takes the column's type, so the scan can skip what is older."""
    return rows.where(F.col(column) >= F.lit(cutoff).cast(rows.schema[column].dataType))


def of_category(rows: DataFrame, column: str, *values: str) -> DataFrame:
    return rows.where(F.col(column).isin(*values))


def holding(rows: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose text holds a part, as it is written."""
    return rows.where(F.col(column).contains(part))


def hash_order(seed: int | str, *keys: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, nulls in the order first; of several at the same place the least by a hash of their other columns.
    Partial minima come before the shuffle, so a key that is everywhere sends a row a task."""
    others = [c for c in rows.columns if c not in (key, order)]
    ties = [F.xxhash64(*others)] if others else []
    kept = rows.groupBy(key).agg(F.min_by(F.struct(order, *others), F.struct(order, *ties)).alias("__r"))
    return kept.select(*[F.col(c) if c == key else F.col(f"__r.`{c}`") for c in rows.columns])


def last_wins(rows: DataFrame, key: str, order: str, position: str = "position") -> DataFrame:
    """The last row of each key, with the place where the key was first seen."""
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("__r"), F.min(order).alias(position))
    return kept.select(key, "__r.*", position)


def best_and_worst(attempts: DataFrame, score: str = "score", code: str = "code") -> DataFrame:
    """Highest and lowest score per item, the last on ties; scores under -1 are never chosen, over 1 never rejected;
    items whose two sides are the same attempt are left out."""
    s = F.col(score)
    a = attempts.groupBy("item").agg(
        F.max(F.when(s >= -1, F.struct(s.alias("s"), F.col("idx").alias("i"), F.col(code).alias("c")))).alias("b"),
        F.min(F.when(s <= 1, F.struct(s.alias("s"), (-F.col("idx")).alias("i"), F.col(code).alias("c")))).alias("w"),
    )
    return a.where(F.col("b").isNotNull() & F.col("w").isNotNull() & (F.col("b.i") != -F.col("w.i"))).select("item", F.col("b.c").alias("chosen"), F.col("w.c").alias("rejected"), F.col("b.s").alias("chosen_info"), F.col("w.s").alias("rejected_info"))


def last_pass_and_fail(attempts: DataFrame, code: str = "code", output: str = "output") -> DataFrame:
    """The last passing and the last failing attempt per item; either may be null."""
    ok = F.coalesce(F.col("passing").cast("int"), F.lit(0)) == 1
    row = F.struct("idx", F.col(code).alias("c"), F.col(output).alias("o"))
    a = attempts.groupBy("item").agg(F.max(F.when(ok, row)).alias("p"), F.max(F.when(~ok, row)).alias("f"))
    return a.select("item", F.col("p.c").alias("chosen"), F.col("f.c").alias("rejected"), F.col("p.o").alias("chosen_info"), F.col("f.o").alias("rejected_info"))


def two_distinct(attempts: DataFrame, seed: int = 42, code: str = "code") -> DataFrame:
    """Two attempts of different code per item, the first two in hashed order; items with one code are left out."""
    kinds = attempts.groupBy("item", code).agg(F.min(hash_order(seed, "item", "idx")).alias("h"))
    w = Window.partitionBy("item").orderBy("h")
    kept = kinds.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("item").agg(F.max(F.when(F.col("r") == 1, F.col(code))).alias("chosen"), F.max(F.when(F.col("r") == 2, F.col(code))).alias("rejected"))
    return kept.where("rejected is not null")


def best_and_other(attempts: DataFrame, seed: int = 42, score: str = "score", code: str = "code") -> DataFrame:
    """The best-scored code (last on ties) and, of the others, one in hashed order; blank bests are left out."""
    best = attempts.groupBy("item").agg(F.max(F.struct(F.col(score).alias("s"), F.col("idx").alias("i"), F.col(code).alias("c"))).alias("b")).where(F.trim("b.c") != "")
    others = attempts.join(best, "item").where(F.col(code) != F.col("b.c"))
    picked = others.groupBy("item", "b").agg(F.min_by(F.struct(F.col(code).alias("c"), F.col(score).alias("s")), hash_order(seed, "item", "idx")).alias("o"))
    return picked.select("item", F.col("b.c").alias("chosen"), F.col("o.c").alias("rejected"), F.col("b.s").alias("chosen_info"), F.col("o.s").alias("rejected_info"))


def prefix_per_item(attempts: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy("idx")
    return attempts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def first_successes(attempts: DataFrame, most: int, tries: int) -> DataFrame:
    """Passing attempts per item until `most` are found, among the first `tries`; null attempts use up a try."""
    ok = F.coalesce(F.col("passing").cast("int"), F.lit(0))
    w = Window.partitionBy("item").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return attempts.where(F.col("idx") <= tries).withColumn("__c", F.sum(ok).over(w)).where((F.col("__c") <= most) & (ok == 1)).drop("__c")


def without_shortest_quarter(rows: DataFrame, size: str, item: str = "item", idx: str = "idx") -> DataFrame:
    """Per item, all but the floor(n / 4) smallest, ties by idx."""
    w = Window.partitionBy(item).orderBy(size, idx)
    both = rows.withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(item)))
    return both.where(F.expr("__r > floor(__n / 4)")).drop("__r", "__n")


def one_per_item(rows: DataFrame, seed: int = 42, item: str = "item", idx: str = "idx") -> DataFrame:
    picked = rows.groupBy(item).agg(F.min_by(F.struct(*[c for c in rows.columns if c != item]), hash_order(seed, item, idx)).alias("__r"))
    return picked.select(item, "__r.*")


def row_slice(rows: DataFrame, order: str, start: int | None, size: int | None) -> DataFrame:
    """Rows of index start .. start + size - 1; all of them unless both are given."""
    return rows if start is None or size is None else rows.where((F.col(order) >= start) & (F.col(order) < start + size))


def head(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)


def first_rows(rows: DataFrame, order: Column, key: str, n: int) -> DataFrame:
    """The first n rows by an order, ties by key: by a limit if n is small, and else by row numbers over ranges of the
    order, as a sorted limit would bring all n rows to one task."""
    if n <= FEW_ROWS:
        return rows.orderBy(order, key).limit(n)
    return numbered(rows.withColumn("__o", order), F.lit(0).cast("long"), "__o", "__n", ties=[key]).where(F.col("__n") < n).drop("__o", "__n")


def hash_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement: the first in hashed order."""
    return first_rows(rows, hash_order(seed, key), key, n)


def hash_shuffled(rows: DataFrame, seed: int, key: str, position: str = "position") -> DataFrame:
    """The hashed order as a column: the hash itself; sorting by it and the key shuffles the rows."""
    return rows.withColumn(position, hash_order(seed, key))


def chunks(rows: DataFrame, order: str, size: int, name: str = "chunk") -> DataFrame:
    return rows.withColumn(name, F.expr(f"`{order}` div {size}"))


def shard_ranges(spark, total: int, shards: int) -> DataFrame:
    """Equal ranges (shard, start, length); the last takes the rest."""
    each = total // shards
    return spark.range(shards).select(F.col("id").alias("shard"), (F.col("id") * each).alias("start"), F.when(F.col("id") == shards - 1, total - each * (shards - 1)).otherwise(each).cast("long").alias("length"))


def balanced_by_item(attempts: DataFrame, cap: int) -> DataFrame:
    """As many passing as failing attempts per item, the first of each: min(passing, failing, cap), but at least one of
    a class that has more than one."""
    ok = F.coalesce(F.col("passing").cast("int"), F.lit(0))
    rows = attempts.withColumn("__ok", ok)
    item, kind = Window.partitionBy("item"), Window.partitionBy("item", "__ok")
    counted = rows.withColumn("__p", F.sum("__ok").over(item)).withColumn("__n", F.count("*").over(item)).withColumn("__k", F.count("*").over(kind)).withColumn("__r", F.row_number().over(kind.orderBy("idx")))
    least = F.least(F.col("__p"), F.col("__n") - F.col("__p"), F.lit(cap))
    return counted.where(F.col("__r") <= F.greatest(least, F.when(F.col("__k") > 1, 1).otherwise(0))).drop("__ok", "__p", "__n", "__k", "__r")


def balanced(rows: DataFrame, label: str, key: str, seed: int | None = None) -> DataFrame:
    """As many rows of label 1 as of label 0: the first in hashed order, or by key if no seed is given. No class meets
    in one task."""
    order = hash_order(seed, key) if seed is not None else F.col(key)
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    least = min(counts.get(0, 0), counts.get(1, 0))
    parts = [first_rows(rows.where(F.col(label) == k), order, key, least) for k in (1, 0)]
    return parts[0].unionByName(parts[1])


def insertion_places(known: int, unknowns: int) -> tuple[Column, Column]:
    """Final places of known row __r and of unknown row __r, if unknown row i goes in at i * ((known + i) // unknowns).

    While that is 0 (known + i < unknowns) rows go to the front, so they end in reverse; from then on each goes in
    behind all before it and stays there. So known row r has before it the unknown rows j with place(j) - j <= r:
    j * (q - 1) <= r for the first ones, whose quotient is q = known // unknowns, and j * q <= r for the rest."""
    r = F.col("__r").cast("long")
    if not unknowns:
        return r, r
    q, first = known // unknowns, unknowns - known % unknowns  # from row `first` on the quotient is q + 1

    def upto(step: int) -> Column:
        return F.least(F.expr(f"cast(__r as bigint) div {step} + 1"), F.lit(unknowns)) if step > 0 else F.lit(unknowns)

    before = F.least(upto(q - 1), F.lit(first)) + F.greatest(upto(q) - first, F.lit(0))
    loose = F.when(r + known < unknowns, F.lit(unknowns - known - 1) - r).otherwise(r * F.when(r < first, q).otherwise(q + 1))
    return r + before, loose


def numbered(rows: DataFrame, group: Column, idx: str, name: str = "__r", parts: int = 64, ties: list[str] | None = None) -> DataFrame:
    """Row numbers from 0 by group, idx and `ties` over the whole table, the columns kept.

    Ranges of idx, cut at a hashed sample of its values, are numbered apart and start where the ranges before them
    end, so no task takes all rows; what the driver holds is the cuts and the counts of the ranges."""
    values = rows.select(idx).where(F.col(idx).isNotNull()).distinct()
    sample = values.orderBy(hash_order(42, idx)).limit(32 * parts).orderBy(idx).collect()
    cuts = [r[0] for r in sample[:: max(1, len(sample) // parts)]][:parts]
    above = F.lit(0) + sum((F.coalesce((F.col(idx) >= F.lit(c)).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    apart = rows.withColumn("__g", group).withColumn("__b", above)
    counts = sorted(apart.groupBy("__g", "__b").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for g, b, n in counts:
        starts.append((g, b, total))
        total += n
    within = F.row_number().over(Window.partitionBy("__g", "__b").orderBy(idx, *(ties or []))) - 1
    offsets = rows.sparkSession.createDataFrame(starts, "__g long, __b int, __s long")
    out = apart.withColumn("__w", within).join(F.broadcast(offsets), ["__g", "__b"])
    return out.withColumn(name, F.col("__s") + F.col("__w")).select(*rows.columns, name)


def curriculum(rows: DataFrame, group: str, order: list[str], unknown: str, idx: str, name: str = "position") -> DataFrame:
    """Groups in the given order (others dropped), each by idx; then unknown row i is inserted at
    i * ((known + i) // unknowns), one after the other. `name` sorts the result.

    The places come from row numbers in closed form (`insertion_places`); no task and no list holds all rows."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(group))
    known, loose = rows.where(place > 0), rows.where(F.col(group) == unknown)
    places = insertion_places(known.count(), loose.count())
    out = [numbered(t, g, idx).withColumn(name, p).drop("__r") for t, g, p in ((known, place, places[0]), (loose, F.lit(0).cast("long"), places[1]))]
    return out[0].unionByName(out[1])


def interleaved(rows: DataFrame, group: str, order: list[str], unknown: str, seed: int, idx: str, name: str = "position") -> DataFrame:
    """The same order with the unknown rows spread evenly, by sort keys alone: a known row's key is its group's share
    of the known rows, an unknown row's a hashed fraction. Sorting by `name` and idx gives the curriculum."""
    known = rows.where(F.col(group).isin(order))
    counts = {r[group]: r["n"] for r in known.groupBy(group).agg(F.count("*").alias("n")).collect()}
    total, before, keys = max(1, sum(counts.values())), 0, []
    for g in order:
        keys += [F.lit(g), F.struct(F.lit(before / total).alias("a"), F.lit(counts.get(g, 0) / total).alias("w"))]
        before += counts.get(g, 0)
    fraction = F.conv(F.substring(hash_order(seed, idx), 1, 12), 16, 10).cast("double") / float(1 << 48)
    span = F.create_map(*keys)[F.col(group)]
    return rows.where(F.col(group).isin([*order, unknown])).withColumn(name, F.when(F.col(group) == unknown, fraction).otherwise(span["a"] + span["w"] * fraction))


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def ratio_sample(rows: DataFrame, base: DataFrame, share: float, seed: int, key: str) -> DataFrame:
    """floor(rows of `base` * share) rows in hashed order."""
    return hash_sample(rows, int(base.count() * share), seed, key)
