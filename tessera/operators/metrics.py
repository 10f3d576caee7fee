"""Metrics over attempts(item, idx, passing, passing_public, ...): one row an attempt, idx from 1 within the item.

Every metric is one or two hash aggregations keyed by item (partial sums first), so items spread over the
cluster; windows are partitioned by item only. `passing` is 0/1 or boolean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import draw_weight, error_kind, log_binomial, pass_at_k

DRAWN = 4096  # attempts of an item in a list, from which draws are made


def _hit(name: str = "passing") -> Column:
    return F.coalesce(F.col(name).cast("int"), F.lit(0))


def _known(*columns: str) -> Column:
    """Whether every row of a group has its verdicts and scores; a figure over rows that lack one is null, not wrong."""
    there = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        there &= F.col(c).isNotNull()
    return F.bool_and(there)


def item_counts(attempts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n attempts and c passing ones per item, and whether all have a verdict (`known`)."""
    return attempts.groupBy(*(by or []), "item").agg(F.count("*").alias("n"), F.sum(_hit()).alias("c"), _known("passing").alias("known"))


def pass_at_k_by_item(attempts: DataFrame, k: int) -> DataFrame:
    return item_counts(attempts).withColumn("pass_at_k", pass_at_k("n", "c", k))


def pass_at_k_mean(attempts: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Mean pass@k in per cent, null if an attempt has no verdict. Items collapse to a histogram of (n, c) first."""
    kinds = item_counts(attempts, by).groupBy(*(by or []), "n", "c", "known").agg(F.count("*").alias("items"))
    value = pass_at_k("n", "c", k)
    out = kinds.groupBy(*(by or [])) if by else kinds
    return out.agg(F.when(F.bool_and("known"), F.sum(value * F.col("items")) / F.sum("items") * 100).alias("pass_at_k"), F.sum("items").alias("items"))


def pass_at_k_curve(attempts: DataFrame, most: int) -> DataFrame:
    """Mean pass@k for k = 1..most, from the histogram of (n, c): its size does not depend on the items. Null if an attempt
    has no verdict."""
    kinds = item_counts(attempts).groupBy("n", "c", "known").agg(F.count("*").alias("items"))
    value = F.sum(pass_at_k("n", "c", "k") * F.col("items")) / F.sum("items") * 100
    return kinds.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).groupBy("k").agg(F.when(F.bool_and("known"), value).alias("pass_at_k"))


def pass_one_stderr(attempts: DataFrame) -> DataFrame:
    """Mean and standard error, in per cent, of the pass rates of the attempt indexes; null if an attempt has no verdict."""
    means = attempts.groupBy("idx").agg(F.avg(_hit()).alias("m"), _known("passing").alias("known"))
    all_known = F.bool_and("known")
    return means.agg(F.when(all_known, F.avg("m") * 100).alias("pass_one"), F.when(all_known, F.stddev_pop("m") / F.sqrt(F.count("*")) * 100).alias("stderr"))


def pass_one_by_item(attempts: DataFrame) -> DataFrame:
    """Mean pass rate of the items, which may differ in size, and its standard error over the attempt indexes, in per cent.

    An index adds the sum of (passing - c / n) / n over the items that have it, divided by the items; the error is the
    root of the sum of their squares. If all items have n attempts, that is the deviation of the n indexes' pass rates
    divided by the root of n. Null if an attempt has no verdict."""
    counts = item_counts(attempts)
    off = (_hit() - F.col("c") / F.col("n")) / F.col("n")
    by_index = attempts.select("item", "idx", "passing").join(counts, "item").groupBy("idx").agg(F.sum(off).alias("d"))
    spread = by_index.agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("e")).withColumn("__one", F.lit(1))
    mean = counts.agg(F.avg(F.col("c") / F.col("n")).alias("m"), F.count("*").alias("items"), F.bool_and("known").alias("known")).withColumn("__one", F.lit(1))
    return mean.join(spread, "__one").select(F.when(F.col("known"), F.col("m") * 100).alias("pass_one"), F.when(F.col("known"), F.col("e") / F.col("items") * 100).alias("stderr"))


def _scored(attempts: DataFrame, score: str | Column) -> DataFrame:
    return attempts.withColumn("__s", F.col(score) if isinstance(score, str) else score)


def ranked(attempts: DataFrame, score: str | Column = "score", name: str = "rk") -> DataFrame:
    """Rank from 1 by score, high first, ties to the smaller idx, nulls last."""
    order = Window.partitionBy("item").orderBy((F.col(score) if isinstance(score, str) else score).desc_nulls_last(), "idx")
    return attempts.withColumn(name, F.row_number().over(order))


def reranked_accuracy(attempts: DataFrame, k: int = 1, score: str | Column = "score", public_only: bool = False) -> DataFrame:
    """Share of items with a passing attempt among the k best by score. `public_only` ranks the attempts that pass
    the public tests; an item without any counts as failed. Null if an attempt lacks a verdict, its score or, where
    they count, its public verdict."""
    pool = attempts.withColumn("__s", F.col(score) if isinstance(score, str) else score)
    shown = _hit("passing_public") if public_only else F.lit(1)
    order = Window.partitionBy("item").orderBy(shown.desc(), F.col("__s").desc_nulls_last(), "idx")
    known = _known("passing", "__s", *(["passing_public"] if public_only else []))
    top = pool.withColumn("__shown", shown).withColumn("__rk", F.row_number().over(order))
    by_item = top.groupBy("item").agg(F.max(F.when((F.col("__rk") <= k) & (F.col("__shown") == 1), _hit()).otherwise(0)).alias("hit"), known.alias("known"))
    return by_item.agg(F.when(F.bool_and("known"), F.avg("hit") * 100).alias("accuracy"))


def reranked_curve(attempts: DataFrame, most: int, score: str | Column = "score") -> DataFrame:
    """Accuracy for k = 1..most: an item is right from the rank of its best passing attempt on. Null if an attempt lacks its
    verdict or score."""
    first = ranked(_scored(attempts, score), "__s").groupBy("item").agg(F.min(F.when(_hit() == 1, F.col("rk"))).alias("first"), _known("passing", "__s").alias("known"))
    kinds = first.groupBy("first", "known").agg(F.count("*").alias("items"))
    right = F.sum(F.when(F.col("first") <= F.col("k"), F.col("items")).otherwise(0)) / F.sum("items") * 100
    return kinds.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).groupBy("k").agg(F.when(F.bool_and("known"), right).alias("accuracy"))


def expected_best_of_n(attempts: DataFrame, sizes: list[int], score: str | Column = "score") -> DataFrame:
    """Expected accuracy of the best of n attempts drawn without replacement, exactly, for each n, and its deviation
    from one drawing of all items to the next. Null for an n if an attempt of an item that it draws from lacks its verdict or score."""
    drawn = F.explode(F.array(*map(F.lit, sizes)))
    whole = ranked(_scored(attempts, score), "__s").withColumn("size", F.count("*").over(Window.partitionBy("item")))
    passing = whole.where(_hit() == 1).withColumn("n", drawn).where("n <= size")
    items = _scored(attempts, score).groupBy("item").agg(F.count("*").alias("size"), _known("passing", "__s").alias("known")).withColumn("n", drawn).where("n <= size")
    chances = passing.groupBy("item", "n").agg(F.sum(draw_weight("rk", "size", "n")).alias("p"))
    every = items.join(chances, ["item", "n"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    spread = F.sqrt(F.sum(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(0.0)))) / F.count("*") * 100
    return every.groupBy("n").agg(F.when(F.bool_and("known"), F.avg("p") * 100).alias("accuracy"), F.when(F.bool_and("known"), spread).alias("std"))


def expected_grid(attempts: DataFrame, ks: list[int], sizes: list[int], score: str | Column = "score") -> DataFrame:
    """Expected share of items with a passing attempt among the k best of n drawn, for every k <= n <= attempts.

    1 - sum over failing attempts r of C(f, k-1) * C(N-r, n-k) / C(N, n), with f failing attempts ranked above r. The sum is
    linear, so failing attempts collapse to a histogram of (r, f, N) before they meet the cells. Null for a cell if an attempt of an
    item that it draws from lacks its verdict or score."""
    above = Window.partitionBy("item").orderBy("rk").rowsBetween(Window.unboundedPreceding, -1)
    scored = _scored(attempts, score)
    whole = ranked(scored, "__s").withColumn("size", F.count("*").over(Window.partitionBy("item")))
    failing = whole.withColumn("f", F.coalesce(F.sum(1 - _hit()).over(above), F.lit(0))).where(_hit() == 0)
    kinds = failing.groupBy("rk", "f", "size").agg(F.count("*").alias("m"))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k in ks for n in sizes if k <= n]))
    crossed = kinds.select("*", cells.alias("cell")).select("rk", "f", "size", "m", "cell.*").where("n <= size")
    lost = F.exp(log_binomial(F.col("f"), F.col("k") - 1) + log_binomial(F.col("size") - F.col("rk"), F.col("n") - F.col("k")) - log_binomial(F.col("size"), F.col("n")))
    missed = crossed.groupBy("k", "n").agg(F.sum(F.coalesce(lost, F.lit(0.0)) * F.col("m")).alias("missed"))
    items = scored.groupBy("item").agg(F.count("*").alias("size"), _known("passing", "__s").alias("known")).groupBy("size", "known").agg(F.count("*").alias("m"))
    there = items.select("*", cells.alias("cell")).select("size", "known", "m", "cell.*").where("n <= size").groupBy("k", "n").agg(F.sum("m").alias("items"), F.bool_and("known").alias("known"))
    return there.join(missed, ["k", "n"], "left").select("k", "n", F.when(F.col("known"), (1 - F.coalesce("missed", F.lit(0.0)) / F.col("items")) * 100).alias("accuracy"))


def sampled_best_of_n(attempts: DataFrame, n: int, k: int = 1, draws: int = 25, seed: int = 42, score: str = "score") -> DataFrame:
    """Monte-Carlo form: mean and population deviation over draws of n attempts by a hashed order. Null if an attempt lacks
    its verdict or score.

    The attempts of an item stand in lists of some DRAWN at most, and each draw is made inside a list, so no row is copied for a
    draw. Of an item with more attempts each list gives its first n of a draw, and the first of those are ranked."""
    known = attempts.agg(_known("passing", score).alias("known"))  # one row
    size = F.count("*").over(Window.partitionBy("item"))
    name = F.concat_ws(":", F.col("item").cast("string"), F.col("idx").cast("string"))
    rows = attempts.select("item", "idx", name.alias("name"), F.col(score).alias("score"), _hit().alias("hit"), size.alias("size"))
    part = F.when(F.col("size") > DRAWN, F.pmod(F.xxhash64("idx"), F.ceil(F.col("size") / DRAWN))).otherwise(0)
    lists = rows.groupBy("item", part.alias("part")).agg(F.first("size").alias("size"), F.collect_list(F.struct("name", "idx", "score", "hit")).alias("list"))
    numbers = F.sequence(F.lit(1), F.lit(draws))

    def first(draw: Column) -> Column:
        by = lambda x: F.md5(F.concat(F.lit(f"{seed}:"), draw.cast("string"), F.lit(":"), x["name"]).cast("binary"))
        return F.slice(F.array_sort(F.transform("list", lambda x: F.struct(by(x).alias("by"), x["idx"].alias("idx"), x["score"].alias("score"), x["hit"].alias("hit")))), 1, n)

    def hit(drawn: Column) -> Column:
        ranked = F.reverse(F.array_sort(F.transform(drawn, lambda x, o: F.struct(x["score"].alias("score"), (-o).alias("o"), x["hit"].alias("hit")))))
        return F.array_max(F.transform(F.slice(ranked, 1, k), lambda x: x["hit"]))

    few = lists.where(F.col("size") <= DRAWN).select(F.posexplode(F.transform(numbers, lambda d: hit(first(d)))).alias("draw", "hit")).select((F.col("draw") + 1).alias("draw"), "hit")
    drawn = lists.where(F.col("size") > DRAWN).select("item", "list", F.explode(numbers).alias("draw")).select("item", "draw", F.explode(first(F.col("draw"))).alias("x")).select("item", "draw", "x.*")
    kept = drawn.withColumn("o", F.row_number().over(Window.partitionBy("draw", "item").orderBy("by", "idx"))).where(F.col("o") <= n)
    best = Window.partitionBy("draw", "item").orderBy(F.col("score").desc_nulls_last(), "o")
    many = kept.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k).groupBy("draw", "item").agg(F.max("hit").alias("hit")).select("draw", "hit")
    means = few.unionByName(many).groupBy("draw").agg(F.avg("hit").alias("m")).agg((F.avg("m") * 100).alias("accuracy"), (F.stddev_pop("m") * 100).alias("std"))
    both = means.withColumn("__one", F.lit(1)).join(known.withColumn("__one", F.lit(1)), "__one")
    return both.select(*[F.when(F.col("known"), F.col(c)).alias(c) for c in ("accuracy", "std")])


def public_accuracy(attempts: DataFrame, n: int, k: int = 1) -> DataFrame:
    """Of the first n attempts those that pass the public tests come first, in order; share of items with a passing
    one among the first k. Items weigh as many attempts as they have among the first n. Null if one of those lacks a
    verdict, public or not."""
    order = Window.partitionBy("item").orderBy(_hit("passing_public").desc(), "idx")
    best = attempts.where(F.col("idx") <= n).withColumn("rk", F.row_number().over(order))
    by_item = best.groupBy("item").agg(F.max(F.when(F.col("rk") <= k, _hit()).otherwise(0)).alias("hit"), F.count("*").alias("weight"), _known("passing", "passing_public").alias("known"))
    return by_item.agg(F.when(F.bool_and("known"), F.sum(F.col("hit") * F.col("weight")) / F.sum("weight") * 100).alias("accuracy"))


def report(attempts: DataFrame, k: int, n: int, by: list[str] | None = None, score: str | Column = "score") -> DataFrame:
    """All headline figures, one row, or one for each value of `by` (files, say). A figure is null if an attempt lacks
    what it takes: a verdict, a score, a log-probability, a public verdict.

    One pass ranks the attempts of each item four times within one partitioning and aggregates them by item; a second
    takes the means by attempt index."""
    by = by or []
    item = Window.partitionBy(*by, "item")
    last = F.col("idx") > n
    orders = {
        "rm": [F.col("__s").desc_nulls_last()],
        "rm_public": [_hit("passing_public").desc(), F.col("__s").desc_nulls_last()],
        "ml": [F.col("cumulative_logprob").desc_nulls_last()],
        "public": [last.cast("int"), _hit("passing_public").desc()],
    }
    pool = attempts.withColumn("__s", F.col(score) if isinstance(score, str) else score)
    placed = pool.withColumns({f"__{name}": F.row_number().over(item.orderBy(*order, "idx")) for name, order in orders.items()})
    best = lambda name, also=F.lit(True): F.max(F.when((F.col(f"__{name}") <= k) & also, _hit()).otherwise(0)).alias(name)
    shown = _hit("passing_public") == 1
    items = placed.groupBy(*by, "item").agg(
        F.count("*").alias("n"), F.sum(_hit()).alias("c"), best("rm"), best("rm_public", shown), best("ml"), best("public", ~last), F.count_if(~last).alias("w"),
        _known("passing").alias("has_verdict"), _known("__s").alias("has_score"), _known("cumulative_logprob").alias("has_logprob"), _known("passing_public").alias("has_public"),
    )
    ok = lambda *names: F.expr(" and ".join(f"bool_and({x})" for x in ("has_verdict", *names)))
    figures = items.groupBy(*by).agg(
        F.when(ok(), F.avg(pass_at_k("n", "c", k)) * 100).alias("pass_at_k"), F.count("*").alias("items"),
        F.when(ok("has_score"), F.avg("rm") * 100).alias("rm"), F.when(ok("has_score", "has_public"), F.avg("rm_public") * 100).alias("rm_public"),
        F.when(ok("has_logprob"), F.avg("ml") * 100).alias("ml"), F.when(ok("has_public"), F.sum(F.col("public") * F.col("w")) / F.sum("w") * 100).alias("public"),
    )
    means = attempts.groupBy(*by, "idx").agg(F.avg(_hit()).alias("m"), _known("passing").alias("known")).groupBy(*by).agg(
        F.when(F.bool_and("known"), F.avg("m") * 100).alias("pass_one"), F.when(F.bool_and("known"), F.stddev_pop("m") / F.sqrt(F.count("*")) * 100).alias("stderr"))
    if by:
        return figures.join(means, by)
    return figures.withColumn("__one", F.lit(1)).join(means.withColumn("__one", F.lit(1)), "__one").drop("__one")  # one row each


def file_report(documents: DataFrame, k: int, n: int, score: str = "orm_score") -> DataFrame:
    """The report of each file of result documents (file, items; a file may have several documents): one without readable
    items has a row that says so in `error` and no figures."""
    items = documents.select("file", F.posexplode_outer("items").alias("row_idx", "i"))
    rows = items.where("i is not null").select("file", F.col("i.unique_name").alias("item"), F.posexplode("i.results").alias("p", "r")).select("file", "item", (F.col("p") + 1).alias("idx"), "r.*")
    figures = report(rows, k, n, ["file"], score)
    found = documents.groupBy("file").agg(F.sum(F.coalesce(F.size("items"), F.lit(0))).alias("n"))
    broken = F.when(F.col("n") <= 0, "no items").alias("error")
    return found.select("file", broken).join(figures.withColumnRenamed("items", "size"), "file", "left")


def confusion(judged: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Of rows (label, passing, positive_score, negative_score): the four cells in per cent, mean scores, shares of
    unsure true and over-sure false positives, accuracy, precision, recall, F1. What would divide by 0 is null."""
    cell = lambda c: F.sum(F.when(c, 1).otherwise(0))
    yes, ok = F.col("label") == 1, _hit() == 1
    sure = F.col("positive_score") >= threshold
    a = judged.agg(
        F.count("*").alias("size"), cell(yes & ok).alias("tp"), cell(yes & ~ok).alias("fp"), cell(~yes & ~ok).alias("tn"), cell(~yes & ok).alias("fn"),
        cell(yes & ok & ~sure).alias("unsure"), cell(yes & ~ok & sure).alias("oversure"),
        F.avg(F.when(yes & ok, F.col("positive_score"))).alias("tp_score"), F.avg(F.when(yes & ~ok, F.col("positive_score"))).alias("fp_score"),
        F.avg(F.when(~yes & ~ok, F.col("negative_score"))).alias("tn_score"), F.avg(F.when(~yes & ok, F.col("negative_score"))).alias("fn_score"),
    )
    share = lambda x, y: F.try_divide(F.col(x) * 100.0, y)
    b = a.select(
        *[share(x, F.col("size")).alias(x) for x in ("tp", "fp", "tn", "fn")], "tp_score", "fp_score", "tn_score", "fn_score",
        share("unsure", F.col("tp")).alias("tp_unsure"), share("oversure", F.col("fp")).alias("fp_oversure"),
        F.try_divide((F.col("tp") + F.col("tn")) * 100.0, F.col("size")).alias("accuracy"),
        share("tp", F.col("tp") + F.col("fp")).alias("precision"), share("tp", F.col("tp") + F.col("fn")).alias("recall"),
    )
    return b.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy_by_category(judged: DataFrame, category: str) -> DataFrame:
    """Of rows (category, predicted, passing): accuracy and true-negative rate by category and, with a null
    category, overall."""
    p, t = F.col("predicted").cast("int"), _hit()
    return judged.rollup(category).agg(F.count("*").alias("n"), F.avg((p == t).cast("int")).alias("accuracy"), F.avg(F.when(t == 0, 1 - p)).alias("tn_rate"))


def verdict_counts(attempts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many attempts passed, failed, or have no verdict."""
    p = F.col("passing").cast("int")
    return attempts.groupBy(*(by or [])).agg(F.count_if(p == 1).alias("passed"), F.count_if(p == 0).alias("failed"), F.count_if(p.isNull()).alias("unknown"))


def error_histogram(attempts: DataFrame, output: str = "output") -> DataFrame:
    return attempts.where(_hit() == 0).groupBy(error_kind(output).alias("kind")).agg(F.count("*").alias("n"))


def items_with_pass(attempts: DataFrame) -> DataFrame:
    return item_counts(attempts).agg(F.sum((F.col("c") > 0).cast("int")).alias("with_pass"), F.count("*").alias("items"))


def agreement(judged: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows where two verdicts agree (a null verdict agrees with nothing), and of the disagreements, how
    many passed and failed."""
    same = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return judged.agg(F.avg(same.cast("int")).alias("agree"), F.sum((both & ~same & (_hit() == 1)).cast("int")).alias("differ_pass"), F.sum((both & ~same & (_hit() == 0)).cast("int")).alias("differ_fail"))


def best_or_first(attempts: DataFrame) -> DataFrame:
    """Per item the best-scored attempt labelled 1 (ties to the smaller idx), or the first attempt: its idx, whether
    it was a guess, whether it passes."""
    a = attempts.groupBy("item").agg(F.max(F.when(F.col("label") == 1, F.struct("score", (-F.col("idx")).alias("o"), "idx", _hit().alias("p")))).alias("b"), F.min(F.struct("idx", _hit().alias("p"))).alias("f"))
    return a.select("item", F.coalesce("b.idx", "f.idx").alias("idx"), F.col("b").isNull().cast("int").alias("guess"), F.coalesce("b.p", "f.p").alias("passing"))


def run_spread(runs: DataFrame, value: str = "value") -> DataFrame:
    """Of rows (series, step, value): mean and population deviation by step, and the step's share of the series' last
    in per cent."""
    by = runs.groupBy("series", "step").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return by.withColumn("percent", F.col("step") * 100.0 / F.max("step").over(Window.partitionBy("series")))


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    v = F.col(value)
    out = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most")]
    return rows.groupBy(*(by or [])).agg(*out)


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins from `low` to `high`, empty bins too; values outside are left out, `high` is in the last."""
    v = F.col(value)
    at = F.least(F.floor((v - low) / ((high - low) / bins)).cast("int"), F.lit(bins - 1))
    counts = rows.where((v >= low) & (v <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return dense(counts, "bin", bins)


def frequency(rows: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """How often each value, or combination of values, occurs; null is one of them."""
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def combined_lengths(rows: DataFrame, heads: DataFrame, key: str, own: Column, head: Column, width: int) -> DataFrame:
    """(bucket, n): rows by their own length plus that of their key's head, in buckets of `width`; rows without a head are left out."""
    lengths = heads.select(key, head.alias("__h"))
    total = rows.select(key, own.alias("__o")).join(lengths, key).select((F.col("__o") + F.col("__h")).cast("long").alias("__l"))
    return frequency(total.select(F.expr(f"__l div {width}").alias("bucket")), "bucket")


def dense(counts: DataFrame, key: str, size: int) -> DataFrame:
    """Every key of 0..size-1 with its count, 0 where it has none."""
    domain = counts.sparkSession.range(size).select(F.col("id").cast("int").alias(key))
    return domain.join(counts.withColumn(key, F.col(key).cast("int")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
