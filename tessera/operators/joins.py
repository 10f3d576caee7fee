"""Joins between problem sets, attempts and training rows. All are equi-joins (or bounded by one), planned by Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import checkpoint


FEW = 1000


def skewed_join(rows: DataFrame, side: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows joined with `side`, which has one row a key and, in column `size`, how many rows the key has. Keys that hold
    a thousandth of the `total` rows or more, a thousand at most, are broadcast, so their rows stay where they are."""
    heavy = F.broadcast(side.where(F.col(size) * FEW >= total))
    rest = rows.join(heavy.select(*on), on, "left_anti").join(side.where(F.col(size) * FEW < total), on)
    return rows.join(heavy, on).unionByName(rest)


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that both have."""
    return a.select(column).intersect(b.select(column))


def rows_seen_in(b: DataFrame, a: DataFrame, key: str) -> DataFrame:
    """Rows of b whose key is in a; repeated rows of b stay."""
    return b.join(a.select(key).distinct(), key, "left_semi")


def rows_not_in(b: DataFrame, a: DataFrame, key: str) -> DataFrame:
    return b.join(a.select(key).distinct(), key, "left_anti")


def contains_any(docs: DataFrame, items: DataFrame, text: str, phrase: str) -> DataFrame:
    """Documents that hold one of the phrases as a substring, each row once.

    A phrase's inner words (all but its first and last) stand as whole words in any text that holds it. They are counted in the
    texts, a phrase is keyed by its rarest inner word, and only a text's hash travels with its words; texts are fetched for what
    is left, the candidates. A phrase without an inner word is keyed by the words of the texts that its first or last word may be a
    part of. Texts are told apart by 128 bits of hash."""
    key = ["__a", "__b"]
    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(1), F.reverse(text)).alias("__b"), F.col(text).alias("__t"))
    said = texts.select(*key, F.explode(F.array_distinct(F.split("__t", r"\s+"))).alias("__w"))
    phrases = items.select(F.col(phrase).alias("__p")).where("__p is not null").distinct()
    parts = F.split("__p", r"\s+")
    every = checkpoint(phrases.select("__p", parts.alias("__parts"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))).alias("__inner")))
    inner = every.select("__p", F.explode("__inner").alias("__w"))
    short = every.where(F.size("__inner") == 0)
    if not short.isEmpty():
        blank = texts.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("__t", F.lit(r"(\s+)"), F.lit(1)))).alias("__w"))
        said = said.unionByName(blank)  # for phrases of nothing but blanks
        inner = inner.unionByName(_parts_of_words(said, short))
    counts = checkpoint(said.join(inner.select("__w").distinct(), "__w", "left_semi").groupBy("__w").agg(F.count("*").alias("__n")))
    long = every.where(F.size("__inner") > 0).select("__p")
    ranked = inner.join(counts, "__w", "left")
    rarest = ranked.join(long, "__p", "left_semi").groupBy("__p").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__w").alias("w"))).alias("r"))
    keyed = rarest.where("r.n > 0").select("__p", F.col("r.w").alias("__w"), F.col("r.n").alias("__n"))  # a word that no text has rules its phrase out
    keyed = keyed.unionByName(ranked.where("__n is not null").join(short, "__p", "left_semi").select("__p", "__w", "__n"))
    side = keyed.groupBy("__w").agg(F.collect_set("__p").alias("__ps"), F.max("__n").alias("__n"))
    pairs = skewed_join(said, side, ["__w"], "__n", said.count()).select(*key, F.explode("__ps").alias("__p")).distinct()
    held = texts.join(pairs, key).where(F.col("__t").contains(F.col("__p"))).select(*key).distinct()
    if not every.where("__p = ''").isEmpty():
        held = texts.select(*key).distinct()  # every text holds the empty phrase
    named = docs.withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(1), F.reverse(text))}).where(F.col(text).isNotNull())
    return named.join(held, key, "left_semi").drop(*key)


def _parts_of_words(said: DataFrame, short: DataFrame) -> DataFrame:
    """(phrase, word) for phrases of one or two words: of two, the words that end with the first, or begin with the second if the first is
    empty; else those that hold the one. Distinct words offer their parts of the lengths that are asked for, so this is an equi-join."""
    first, last = F.get("__parts", F.lit(0)), F.get("__parts", F.size("__parts") - 1)
    kind = F.when((first == "") & (last == ""), "inside").when(F.size("__parts") == 1, "inside").when(first != "", "tail").otherwise("head")
    asked = short.select("__p", kind.alias("__kind"), F.when((first == "") & (last == ""), F.col("__p")).when(first != "", first).otherwise(last).alias("__x")).where("__p <> ''")
    asked = asked.withColumn("__l", F.length("__x"))
    lengths = asked.groupBy("__kind").agg(F.collect_set("__l").alias("__ls"))  # three rows
    listed = [F.struct(F.lit(r["__kind"]).alias("k"), F.lit(sorted(r["__ls"])).alias("ls")) for r in lengths.collect()]
    cut = said.select("__w").distinct().select("__w", F.explode(F.array(*listed)).alias("__k")).select("__w", F.col("__k.k").alias("__kind"), F.col("__k.ls").alias("__ls")).select("__w", "__kind", F.explode("__ls").alias("__l")).where(F.length("__w") >= F.col("__l"))
    tails = F.array(F.expr("right(__w, __l)"))
    heads = F.array(F.expr("left(__w, __l)"))
    inside = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("__w") - F.col("__l") + 1), lambda i: F.substring("__w", i, F.col("__l"))))
    offered = cut.select("__w", "__kind", F.explode(F.when(F.col("__kind") == "tail", tails).when(F.col("__kind") == "head", heads).otherwise(inside)).alias("__x"))
    return offered.join(asked, ["__kind", "__x"]).select("__p", "__w").distinct()


def merge_solutions(synthetic: DataFrame, natural: DataFrame, key: str, solutions: str, order: str) -> DataFrame:
    """Rows of either side, synthetic rows first, solutions of both in that order. Keys must be unique on a side."""
    s = synthetic.select(key, F.col(solutions).alias("__s"), F.col(order).alias("__so"))
    n = natural.select(key, F.col(solutions).alias("__n"), F.col(order).alias("__no"))
    empty = F.array().cast(synthetic.schema[solutions].dataType)
    both = s.join(n, key, "full_outer")
    return both.select(key, F.concat(F.coalesce("__s", empty), F.coalesce("__n", empty)).alias(solutions), F.col("__so").isNull().cast("int").alias("natural_only"), F.coalesce("__so", "__no").alias(order))


def with_fallback(pairs: DataFrame, natural: DataFrame, key: str, chosen: str, solution: str, order: str) -> DataFrame:
    """Pairs whose chosen side is null get the natural solution of their key (the last of several rows, none if it is null)."""
    last = natural.where(F.col(solution).isNotNull()).groupBy(key).agg(F.max_by(solution, order).alias("__n"))
    out = pairs.join(last, key, "left")
    return out.withColumn("used_natural", (F.col(chosen).isNull() & F.col("__n").isNotNull()).cast("int")).withColumn(chosen, F.coalesce(chosen, "__n")).drop("__n")


def merge_back(attempts: DataFrame, redone: DataFrame, values: list[str], code: str = "code") -> DataFrame:
    """New values for attempts of the same item and code; of several, the last redone; all copies of a code get them."""
    new = redone.groupBy("item", code).agg(F.max_by(F.struct(*values), "idx").alias("__v"))
    out = attempts.join(new, ["item", code], "left")
    for v in values:
        out = out.withColumn(v, F.when(F.col("__v").isNotNull(), F.col(f"__v.{v}")).otherwise(F.col(v)))
    return out.drop("__v")


def redo_selection(attempts: DataFrame, mode: str, kind: Column) -> DataFrame:
    """Attempts to run again: all that do not pass, or those whose error is of that kind."""
    kinds = {"failed": "Failed", "timeout": "Timeout", "error": "Error"}
    if mode != "all" and mode not in kinds:
        raise ValueError(f"unknown mode {mode!r}")
    rows = attempts.where(F.coalesce(F.col("passing").cast("int"), F.lit(0)) == 0)
    return rows if mode == "all" else rows.where(kind == kinds[mode])


def by_position(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """Rows of both with the same index."""
    return a.join(b, index)


def zipped(rows: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Two parallel arrays as one of structs; lists of different length are an error."""
    same = F.size(first) == F.size(second)
    return rows.withColumn(name, F.when(same, F.arrays_zip(first, second)).otherwise(F.raise_error(F.lit("lists of different length"))))


def merged_structs(rows: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Two parallel arrays of structs as one of structs with the fields of both. The second may be empty (nothing was
    run yet): its fields are null then; any other difference in length is an error."""
    fields = lambda c: rows.schema[c].dataType.elementType.names
    both = F.zip_with(first, second, lambda a, b: F.struct(*[a[f].alias(f) for f in fields(first)], *[b[f].alias(f) for f in fields(second)]))
    fit = (F.size(first) == F.size(second)) | (F.size(second) == 0)
    return rows.withColumn(name, F.when(fit, both).otherwise(F.raise_error(F.lit("lists of different length"))))


def fallback_counts(pairs: DataFrame, chosen: str = "chosen") -> DataFrame:
    """How many pairs are there, have a chosen side, took it from the natural solutions, or have none."""
    return pairs.agg(F.count("*").alias("pairs"), F.count(chosen).alias("chosen"), F.count_if(F.col("used_natural") == 1).alias("natural"), F.count_if(F.col(chosen).isNull()).alias("lost"))


CHUNK = 64  # rows of a list in one chunk


def chunk_pairs(rows: DataFrame, item: str, idx: str, chunk: int = CHUNK) -> DataFrame:
    """Each row in every block (item, __i, __j), __i <= __j, of two chunks of its item that its own chunk, `__half`, is one
    of. Lists longer than `chunk` are cut, so no block holds more than about two chunks, however long a list is. All pairs of a list
    meet in a block, those within a chunk in the block of that chunk alone."""
    sizes = rows.groupBy(item).agg(F.count("*").alias("__m"))
    many = F.ceil(F.col("__m") / chunk)
    placed = skewed_join(rows, sizes, [item], "__m", rows.count()).withColumn("__half", F.pmod(F.xxhash64(idx), many))
    others = F.explode(F.sequence(F.lit(0).cast("long"), many - 1))
    met = placed.select("*", others.alias("__o"))
    return met.select(*rows.columns, F.least("__half", "__o").alias("__i"), F.greatest("__half", "__o").alias("__j"), "__half")


def pairs_within(rows: DataFrame, item: str, idx: str, value: str) -> DataFrame:
    """All pairs i < j of an item's list, made block by block (see `chunk_pairs`). Their number grows with the square of a
    list: that is what is asked for."""
    blocks = chunk_pairs(rows.select(item, idx, value), item, idx, CHUNK)
    a = blocks.select(item, "__i", "__j", F.col("__half").alias("__a"), F.col(idx).alias("i"), F.col(value).alias("a"))
    b = blocks.select(item, "__i", "__j", F.col("__half").alias("__b"), F.col(idx).alias("j"), F.col(value).alias("b"))
    return a.join(b, [item, "__i", "__j"]).where("i < j and (__i = __j or __a <> __b)").select(item, "i", "a", "j", "b")


def mean_pairwise(rows: DataFrame, item: str, idx: str, value: str, scored: Callable[[Column], Column], name: str = "mean") -> DataFrame:
    """The mean over all pairs i < j of each item's list of a score of two texts; null for fewer than two. `scored` takes a block's rows,
    an array of (across, half, idx, value), and gives (total, pairs) of the pairs that the block is for. Null texts take no part."""
    full = rows.where(F.col(value).isNotNull()).select(item, idx, value)
    blocks = chunk_pairs(full, item, idx, CHUNK).groupBy(item, "__i", "__j").agg(F.collect_list(F.struct((F.col("__i") != F.col("__j")).alias("across"), F.col("__half").alias("half"), F.col(idx).alias("idx"), F.col(value).alias("value"))).alias("rows"))
    sums = blocks.select(item, scored(F.col("rows")).alias("s")).groupBy(item).agg((F.sum("s.total") / F.nullif(F.sum("s.pairs"), F.lit(0))).alias(name))
    return rows.select(item).distinct().join(sums, item, "left")


def adjacent_pairs(rows: DataFrame, item: str, idx: str, value: str) -> DataFrame:
    """(before, after) for each row and the one ahead of it in its item."""
    w = Window.partitionBy(item).orderBy(idx)
    return rows.select(item, idx, F.lag(value).over(w).alias("before"), F.col(value).alias("after")).where("before is not null")


def adjacent_losses(rows: DataFrame, item: str) -> DataFrame:
    """How many items give pairs, and how many have too few rows."""
    n = rows.groupBy(item).agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") >= 2).alias("kept"), F.count_if(F.col("n") < 2).alias("lost"))


def fan_out(rows: DataFrame, **values: list) -> DataFrame:
    """Each row once for every combination of a few parameter lists."""
    out = rows
    for name, listed in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, listed))))
    return out


def completions_for(prompts: DataFrame, limit: int) -> DataFrame:
    """Each prompt `limit` times, numbered from 1."""
    return prompts.withColumn("idx", F.explode(F.sequence(F.lit(1), F.lit(limit))))


def wide(rows: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Long to wide, columns in the given order."""
    return rows.groupBy(row).pivot(column, columns).agg(F.first(value))


def to_list(rows: DataFrame, item: str, idx: str, value: str, name: str) -> DataFrame:
    """An item's values as a list in order of idx."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v"))))
    return rows.groupBy(item).agg(F.transform(listed, lambda x: x["v"]).alias(name))


def to_rows(rows: DataFrame, value: str, idx: str = "idx", name: str = "value") -> DataFrame:
    kept = [c for c in rows.columns if c != value]
    return rows.select(*kept, F.posexplode(value).alias("__i", name)).withColumn(idx, F.col("__i") + 1).drop("__i")
