"""Data sets built from problems, attempts and solutions: compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import pyudfs, text
from tessera.operators import joins, selection

TESTS = "inputs array<string>, outputs array<string>, fn_name string"
ORDER = ["EASY", "MEDIUM", "MEDIUM_HARD", "HARD", "VERY_HARD"]  # fixed: difficulties of the curriculum
Length = Callable[[Column], Column]  # a tokenizer's length, or a stand-in


def test_count(tests: str = "input_output") -> Column:
    return F.coalesce(F.size(F.from_json(tests, "struct<inputs array<string>>".replace("inputs ", "inputs: "))["inputs"]), F.lit(0))


def clean_problems(problems: DataFrame, min_tests: int = 10, max_tokens: int = 2048, min_lines: int = 5, min_solutions: int = 1, length: Length = text.word_tokens) -> tuple[DataFrame, DataFrame]:
    """(kept, left over) of problems(row_idx, question, solutions array, input_output). Native filters come before the
    parser: enough tests, short question; then solutions that are long and short enough and parse; tests patched.
    The left over have fewer than `min_solutions`."""
    good = problems.where((test_count() >= min_tests) & (length(F.col("question")) <= max_tokens))
    rows = joins.to_rows(good.select("row_idx", "solutions"), "solutions", name="code").withColumn("code", text.py_strip("code"))
    rows = rows.where((length(F.col("code")) <= max_tokens) & (text.line_count("code") >= min_lines)).where(pyudfs.parses_udf("code"))
    listed = joins.to_list(rows, "row_idx", "idx", "code", "solutions")
    out = good.drop("solutions").join(listed, "row_idx", "left").withColumn("solutions", F.coalesce("solutions", F.array().cast("array<string>"))).withColumn("input_output", pyudfs.patched_tests_udf("input_output"))
    enough = F.size("solutions") >= min_solutions
    return out.where(enough), out.where(~enough)


def passing_solutions(items: DataFrame) -> DataFrame:
    """Result items (unique_name, prompt, starter_code, difficulty, results) as problems with the list of their passing
    programs; items without one drop out."""
    codes = F.transform(F.filter("results", lambda r: F.coalesce(r["passing"], F.lit(False))), lambda r: r["code"])
    rows = items.select(F.col("prompt").alias("question"), "difficulty", "unique_name", "starter_code", codes.alias("solutions"))
    return rows.where(F.size("solutions") > 0)


def step_counts(rows: DataFrame, steps: str = "reasoning_steps") -> DataFrame:
    """Over all rows' lists: steps that are there, steps that are null, and rows with none that is there."""
    there = F.size(F.filter(steps, lambda x: x.isNotNull()))
    n = F.greatest(F.coalesce(F.size(steps), F.lit(0)), F.lit(0))
    got = F.when(n > 0, there).otherwise(0)
    return rows.agg(F.sum(got).cast("long").alias("passed"), F.sum(n - got).cast("long").alias("failed"), F.count_if(got == 0).alias("without"))


def without_empty_lists(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose JSON list holds something."""
    return rows.where(F.coalesce(F.json_array_length(column), F.lit(0)) > 0)


def with_key(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose JSON object has the key, whatever its value."""
    return rows.where(F.coalesce(F.array_contains(F.json_object_keys(column), key), F.lit(False)))


def token_rows(prompts: DataFrame, length: Length, most: int) -> DataFrame:
    """Prompts that a tokenizer counts as at most `most` tokens, with the count as `lengths`."""
    return prompts.withColumn("lengths", length(F.col("prompt"))).where(F.col("lengths") <= most)


def word_vocabulary(texts: DataFrame, column: str, most: int, pattern: str = r"\w+|[^\w\s]") -> DataFrame:
    """(word, id, n): the `most` most frequent words of a text column, ids from 1 by falling count, then by word. Bounded by `most`."""
    words = texts.select(F.explode(F.regexp_extract_all(column, F.lit(f"({pattern})"), F.lit(1))).alias("word"))
    kept = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return kept.select("word", F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("id"), "n")


def encoded_rows(prompts: DataFrame, vocabulary: DataFrame, key: list[str], most: int, column: str = "prompt", pattern: str = r"\w+|[^\w\s]") -> DataFrame:
    """Trainer's rows: `input_ids`, the ids of a prompt's words in order (0 for a word that the vocabulary lacks), and their number as
    `lengths`; prompts of more than `most` are left out, rows repeated under one key count once. A null prompt has none.

    Words are looked up once for each row that has them; the words that are everywhere meet a broadcast part of the vocabulary."""
    words = F.coalesce(F.regexp_extract_all(column, F.lit(f"({pattern})"), F.lit(1)), F.array().cast("array<string>"))
    rows = prompts.dropDuplicates(key).select(*key, words.alias("__ws")).where(F.size("__ws") <= most)
    said = rows.select(*key, F.posexplode("__ws").alias("__at", "word"))
    known = joins.skewed_join(said, vocabulary, ["word"], "n", said.count())
    ids = known.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("__at", "id"))).alias("__ids"))
    placed = F.transform("__ws", lambda w, i: F.coalesce(F.col("__ids")[i], F.lit(0)))
    empty = F.array().cast("array<int>")
    return rows.join(ids, key, "left").select(*key, F.when(F.size("__ws") > 0, F.coalesce(placed, empty)).otherwise(empty).alias("input_ids"), F.size("__ws").alias("lengths"))


def executing_solutions(solutions: DataFrame, run: Callable[[DataFrame], DataFrame], most: int, tries: int) -> DataFrame:
    """Solutions(item, idx, code) that pass, up to `most` of the first `tries`; items with none are left out."""
    return selection.first_successes(run(solutions.where(F.col("idx") <= tries)), most, tries)


def clean_steps(rows: DataFrame, low: float = 0.01, high: float = 0.8) -> DataFrame:
    """Commented code(item, idx, code, starter_code): nulls go, comments move above their lines, the share of comment
    runs must be in range, tabs become spaces."""
    moved = rows.where(F.col("code").isNotNull()).withColumn("code", pyudfs.leading_comments_udf("code"))
    return moved.where(text.comment_ratio("code").between(low, high)).withColumn("code", pyudfs.spaces_for_tabs_udf("code", F.coalesce("starter_code", F.lit(""))))


def steps_on_top(rows: DataFrame, column: str = "code", after_docstring: bool = False) -> DataFrame:
    return rows.withColumn(column, (pyudfs.bullets_after_docstring_udf if after_docstring else pyudfs.bullets_on_top_udf)(column))


def training_rows(problems: DataFrame, mode: str = "all", clip: int = 500, seed: int = 42, split_response: bool = False, mark: str | None = None) -> DataFrame:
    """Supervised rows from problems(item, question, starter_code, solutions array): all solutions, the first `clip`, one
    at random, or one at random of all but the shortest quarter by lines."""
    rows = joins.to_rows(problems.select("item", "question", "starter_code", "solutions"), "solutions", name="solution")
    if mode == "clip":
        rows = rows.where(F.col("idx") <= clip)
    elif mode == "random":
        rows = selection.one_per_item(rows, seed)
    elif mode == "high_loc":
        rows = rows.withColumn("__loc", text.line_count("solution"))
        rows = selection.one_per_item(selection.without_shortest_quarter(rows, "__loc"), seed).drop("__loc")
    elif mode != "all":
        raise ValueError(f"unknown mode {mode!r}")
    rows = rows.withColumn("content", text.docstring_prompt("question", F.col("solution")))
    if mark:
        rows = rows.withColumn("content", text.marked("content", mark))
    if not split_response:
        return rows.select("item", "idx", "content", "solution")
    prompt, response = text.prompt_and_response("content")
    return rows.select("item", "idx", prompt.alias("prompt"), response.alias("response"))


def evolution_rows(solutions: DataFrame) -> DataFrame:
    """Adjacent solutions of an item as (before, after) with their prompt; items with fewer than two drop out."""
    pairs = joins.adjacent_pairs(solutions, "item", "idx", "code")
    return pairs.withColumn("content", text.evolution_prompt("before", F.col("after")))


def merged(synthetic: DataFrame, natural: DataFrame) -> DataFrame:
    """Problems(row_idx, question, solutions), first rows of each question, solutions of both sides."""
    return joins.merge_solutions(selection.first_wins(synthetic, "question", "row_idx"), selection.first_wins(natural, "question", "row_idx"), "question", "solutions", "row_idx")


def reward_rows(attempts: DataFrame, cap: int, strip_comments: bool = False, balance: bool = False, seed: int | None = None) -> DataFrame:
    """Attempts(item, idx, question, starter_code, code, passing) to reward-model rows, balanced by item and, if
    asked, over all rows."""
    rows = selection.balanced_by_item(attempts, cap)
    solution = text.strip_comments("code") if strip_comments else F.col("code")
    rows = rows.withColumn("solution", solution).withColumn("content", text.docstring_prompt("question", F.col("solution"))).withColumn("score", F.coalesce(F.col("passing").cast("int"), F.lit(0)))
    return selection.balanced(rows.withColumn("__k", F.concat_ws(":", "item", "idx")), "score", "__k", seed).drop("__k") if balance else rows


def preference_rows(attempts: DataFrame, mode: str, questions: DataFrame, natural: DataFrame | None = None, first: int | None = None, seed: int = 42) -> DataFrame:
    """Attempts to preference rows (prompt, text_chosen, text_rejected, infos), the last of equal prompts.

    `mode`: exec (last passing, last failing), best_worst, best_random or random. `questions`: (item, row_idx,
    question, starter_code); `natural`: (item, solution, row_idx) for items whose chosen side is missing."""
    rows = selection.prefix_per_item(attempts, first) if first else attempts
    makers = {"exec": selection.last_pass_and_fail, "best_worst": selection.best_and_worst, "best_random": lambda a: selection.best_and_other(a, seed), "random": lambda a: selection.two_distinct(a, seed)}
    if mode not in makers:
        raise ValueError(f"unknown mode {mode!r}")
    pairs = makers[mode](rows)
    for name in ("chosen_info", "rejected_info"):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, F.lit(None).cast("string"))
    if natural is not None:
        pairs = joins.with_fallback(pairs, natural, "item", "chosen", "solution", "row_idx")
    whole = pairs.where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull()).join(questions, "item")
    bare = F.coalesce("starter_code", F.lit("")) == ""
    prompt = F.concat(text.docstring_prompt("question", F.col("starter_code")), F.when(bare, "\n").otherwise(""))
    shaped = whole.select("row_idx", prompt.alias("prompt"), F.col("chosen").alias("text_chosen"), F.col("rejected").alias("text_rejected"), "chosen_info", "rejected_info")
    return selection.last_wins(shaped, "prompt", "row_idx").drop("row_idx")


def prompt_rows(problems: DataFrame, max_tokens: int, min_tests: int = 0, curriculum: bool = True, seed: int = 42, length: Length = text.word_tokens) -> DataFrame:
    """Problems to prompts for online training: first of each question, shorter than the limit, enough tests, in
    curriculum or hashed order."""
    rows = selection.first_wins(problems, "question", "row_idx").where(length(F.col("question")) < max_tokens)
    if min_tests > 0:
        rows = rows.where(test_count() >= min_tests)
    rows = selection.curriculum(rows, "difficulty", ORDER, "UNKNOWN_DIFFICULTY", "row_idx") if curriculum else selection.hash_shuffled(rows, seed, "row_idx")
    bare = F.coalesce("starter_code", F.lit("")) == ""
    shown = F.replace(F.col("question"), F.lit("\\"), F.lit("\\\\"))
    prompt = F.concat(text.docstring_prompt(shown, F.col("starter_code")), F.when(bare, "\n").otherwise(""))
    return rows.withColumn("prompt", prompt).select("position", "prompt", "difficulty", "input_output", "solutions", "starter_code")


def mutated_rows(solutions: DataFrame, run: Callable[[DataFrame], DataFrame], tries: int = 10) -> DataFrame:
    """Passing code (score 1) and, where one of `tries` mutations differs and fails and hits one of the code's commented
    steps, that one (score 0) with the step's range of lines."""
    copies = solutions.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries)))).withColumn("mutated", pyudfs.mutate_udf("code", F.col("try")))
    tried = run(copies.where("mutated <> code").select("item", F.col("idx").alias("source"), "try", F.col("code").alias("original"), F.col("mutated").alias("code")).withColumn("idx", F.col("try")))
    failed = tried.where(~F.coalesce("passing", F.lit(False))).groupBy("item", "source").agg(F.min_by(F.struct("original", "code"), "try").alias("m"))
    ranged = failed.select("item", F.col("source").alias("idx"), F.col("m.code").alias("solution"), F.col("m.original").alias("original"), text.reasoning_step_ranges(F.col("m.original")).alias("r"))
    hit = pyudfs.changed_step_udf("original", "solution", F.transform("r", lambda x: x["start"]), F.transform("r", lambda x: x["end"]))
    bad = ranged.withColumn("mutation_step", hit).where("mutation_step.start is not null").select("item", "idx", "solution", F.lit(0).alias("score"), "mutation_step", "original")
    good = solutions.select("item", "idx", F.col("code").alias("solution"), F.lit(1).alias("score"), F.lit(None).cast("struct<start:int,end:int>").alias("mutation_step"), F.lit(None).cast("string").alias("original"))
    return good.unionByName(bad)


def contamination(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values that both tables share, by column."""
    out = None
    for c in columns:
        n = joins.shared_values(a, b, c).agg(F.count("*").alias("shared")).withColumn("column", F.lit(c))
        out = n if out is None else out.unionByName(n)
    return out


def test_bank(tests: DataFrame, column: str = "test") -> DataFrame:
    """Distinct test texts with their md5."""
    return tests.select(F.col(column).alias("test")).where("test is not null").distinct().withColumn("hash", text.md5_hex("test"))


def harnessed_tests(problems: DataFrame, code: str = "code", inputs: str = "inputs") -> DataFrame:
    """Problems with the program as a function and the test text that runs it on each input."""
    return problems.withColumns({"program": text.stdin_harness(code), "test": text.stdin_runs(inputs)})


def raw_benchmark_problems(rows: DataFrame) -> DataFrame:
    """Raw benchmark rows (public tests as a JSON list, private ones as such or as a blob, metadata) to all tests, the
    private ones first, and the public tests, as JSON specs."""
    specs = pyudfs.benchmark_tests_udf("public_test_cases", "private_test_cases", "metadata")
    return rows.withColumn("__s", specs).withColumns({"input_output": F.col("__s.tests"), "public_input_output": F.col("__s.public")}).drop("__s")
