"""Evaluation runs: models and executors as callables over DataFrame partitions, with deterministic stand-ins.

No model is loaded and no program is run here: a generator, a scorer and an executor are passed in. The stand-ins
below make results that depend on their input alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import pyudfs, scoring, text
from tessera.operators import joins, selection
from tessera.plans.lineage import checkpoint

Generator = Callable[[list[str], list[int]], list[str]]  # prompts and attempt numbers to code
Scorer = Callable[[list[str]], list[tuple[float, float]]]  # contents to (negative, positive) scores
Executor = Callable[[str, str], tuple[bool, str]]  # code and tests to (passing, output)


@dataclass(frozen=True)
class Model:
    """A generator with how it wants its prompts (a key of PROMPTS) and whether code continues the starter code."""

    name: str
    generate: Generator
    prefix_starter_code: bool = True
    prompt: str = "docstring"


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def echo_generator(prompts: list[str], attempts: list[int]) -> list[str]:
    return [f"print({_digest(f'{p}:{a}') % 10})" for p, a in zip(prompts, attempts, strict=True)]


def hashed_scorer(contents: list[str]) -> list[tuple[float, float]]:
    return [(1 - p, p) for p in (_digest(c) % 1000 / 1000 for c in contents)]


def text_executor(code: str, tests: str) -> tuple[bool, str]:
    """Stands in for a sandbox: passes if the tests' text names a digit that the code prints."""
    digit = code[6:7] if code.startswith("print(") else ""
    return (True, "") if digit and digit in (tests or "") else (False, "expected something but got another")


SYSTEM = "You write Python programs. Answer with nothing but the program in a fenced block."
#: How each kind words a prompt from a question and its starter code; a chat is sent as a JSON list of turns.
PROMPTS: dict[str, Callable[[Column, Column], Column]] = {
    "docstring": text.docstring_prompt,
    "few-shot": text.few_shot_prompt,
    "few-shot-cot": lambda q, c: text.few_shot_prompt(q, c, cot=True),
    "chat": lambda q, c: F.to_json(text.few_shot_chat(text.INPUT_SHOTS, q, c, SYSTEM, function_shots=text.FUNCTION_SHOTS)),
}


def model_factory(kind: str, name: str, generate: Generator = echo_generator) -> Model:
    """A model by kind. An evolver's first prompt is the plain one; `evolve` words the later ones."""
    kinds = {"base": ("docstring", True), "few-shot": ("few-shot", True), "few-shot-cot": ("few-shot-cot", True), "few-shot-chat": ("chat", False), "api-chat": ("chat", False), "evolver": ("docstring", True)}
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind!r}")
    prompt, prefix = kinds[kind]
    return Model(name, generate, prefix, prompt)


def bind(rows: DataFrame, prompt: str, tests: str | None = None, public: str | None = None, starter: str | None = None, difficulty: str | None = None, name: str | None = None, order: str = "row_idx") -> DataFrame:
    """Problem columns by role; an absent role is null, an absent starter empty. Names must be unique."""
    opt = lambda c: F.col(c) if c else F.lit(None).cast("string")
    return rows.select(F.col(order).alias("row_idx"), text.sanitised_name(opt(name), order).alias("item"), F.col(prompt).alias("prompt"), opt(tests).alias("tests"), opt(public).alias("public_tests"), F.coalesce(opt(starter), F.lit("")).alias("starter_code"), opt(difficulty).alias("difficulty"))


def repeated_names(items: DataFrame) -> DataFrame:
    return items.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")


def generate(items: DataFrame, model: Model, limit: int, start: int | None = None, size: int | None = None) -> DataFrame:
    """Attempts (item, idx, code) for the items of a slice; prompts, worded as the model wants them, are sent by Arrow batch."""
    return _generated(asked(selection.row_slice(items, "row_idx", start, size), model), model, limit)


def asked(items: DataFrame, model: Model) -> DataFrame:
    """Items with the text that the model is sent, `asked`."""
    return items.withColumn("asked", PROMPTS[model.prompt](F.col("prompt"), F.col("starter_code")))


def _generated(worded: DataFrame, model: Model, limit: int) -> DataFrame:
    jobs = joins.completions_for(worded, limit)
    make = model.generate

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["item", "idx"]].assign(code=make(b["asked"].tolist(), b["idx"].tolist()))

    return jobs.select("item", "idx", "asked").mapInPandas(run, "item string, idx int, code string")


def execute(attempts: DataFrame, execute_one: Executor = text_executor, prefix_starter: bool = True, tests: str = "tests", passing: str = "passing", output: str = "output") -> DataFrame:
    """Verdicts for attempts (item, idx, code, starter_code, tests). Equal pairs of program and tests run once; an
    executor that raises gives a failed verdict with its error."""
    program = F.concat("starter_code", "code") if prefix_starter else F.col("code")
    keyed = attempts.withColumn("__p", program).withColumn("__k", F.concat(F.md5("__p"), F.md5(F.coalesce(tests, F.lit("")))))
    jobs = keyed.groupBy("__k").agg(F.any_value("__p").alias("p"), F.any_value(tests).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(code: str, spec: str) -> tuple[bool, str]:
            try:
                return execute_one(code, spec)
            except Exception as error:  # an executor's failure is a verdict
                return False, f"Failed to execute program: {error}"

        for b in batches:
            done = [one(p, t) for p, t in zip(b["p"], b["t"], strict=True)]
            yield pd.DataFrame({"__k": b["__k"], passing: [d[0] for d in done], output: [d[1] for d in done]})

    verdicts = jobs.mapInPandas(run, f"__k string, {passing} boolean, {output} string")
    return keyed.join(verdicts, "__k").drop("__k", "__p")


def runnable(attempts: DataFrame, code: str = "code", tests: str = "tests") -> DataFrame:
    """Attempts with what a sandbox is given, by the form of their tests: `kind`, `program`, `test`, and `expected`
    outputs. A JSON spec with a function's name is asserted case by case; one without runs the program once for each
    input; any other text is a script that follows the program. All print an end mark."""
    spec = F.when(F.trim(tests).startswith("{"), F.col(tests))
    inputs, outputs = (F.from_json(F.get_json_object(spec, f"$.{x}"), "array<string>") for x in ("inputs", "outputs"))
    kind = F.when(F.get_json_object(spec, "$.fn_name").isNotNull(), "named").when(F.get_json_object(spec, "$.inputs").isNotNull(), "stdin").otherwise("script")
    marked = attempts.withColumn("kind", kind).withColumn("expected", F.when(F.col("kind") == "stdin", outputs))
    end = F.lit(f"print('{text.END_MARK}')\n")
    named = pyudfs.named_asserts_udf(F.when(F.col("kind") == "named", F.col(code)), F.when(F.col("kind") == "named", F.col(tests)))
    test = F.when(F.col("kind") == "stdin", text.stdin_runs(inputs)).when(F.col("kind") == "named", F.concat(named, end)).otherwise(F.concat(F.coalesce(tests, F.lit("")), F.lit("\n"), end))
    program = F.when(F.col("kind") == "stdin", text.stdin_harness(code)).otherwise(F.concat(F.lit(text.PRELUDE), code))
    return marked.withColumns({"program": program, "test": test})


def judged(runs: DataFrame, ran: str = "ran", printed: str = "printed", passing: str = "passing", output: str = "output") -> DataFrame:
    """Verdicts for runs (kind, expected, ran, printed): a program that broke off fails with what it printed; outputs are
    compared one by one, the first that differs is named; scripts and assertions must have reached the end mark."""
    got = text.run_outputs(printed)
    pairs = F.zip_with(got, "expected", lambda a, e: F.struct(a.alias("a"), e.alias("e"), text.same_output(a, e).alias("same")))
    wrong = (F.array_position(F.transform(pairs, lambda p: p["same"]), False) - 1).cast("int")
    shown = F.get(pairs, wrong)
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    said = (
        F.when(~F.col(ran), F.concat(F.lit("errored with "), quoted(F.col(printed)), F.lit("\n")))
        .when((F.col("kind") != "stdin") & ~F.col(printed).contains(text.END_MARK), f"missing {text.END_MARK} in output")
        .when((F.col("kind") == "stdin") & (F.size(got) != F.size("expected")), F.concat(F.lit("expected "), F.size("expected").cast("string"), F.lit(" outputs but got "), F.size(got).cast("string"), F.lit("\n")))
        .when((F.col("kind") == "stdin") & (wrong >= 0), F.concat(F.lit("["), wrong.cast("string"), F.lit("] expected "), quoted(shown["e"]), F.lit(" but got "), quoted(shown["a"]), F.lit("\n")))
        .otherwise("")
    )
    return runs.withColumn(output, said).withColumn(passing, F.col(output) == "")


def execute_specs(attempts: DataFrame, sandbox: Executor, code: str = "code", tests: str = "tests") -> DataFrame:
    """Verdicts by a sandbox that takes a program and its test and gives (ran, printed). Equal pairs run once."""
    made = runnable(attempts, code, tests)
    done = execute(made.withColumn("__code", F.col("program")).withColumn("__none", F.lit("")).drop("passing", "output").withColumnsRenamed({code: "__own", "starter_code": "__starter"} if "starter_code" in made.columns else {code: "__own"}).withColumnRenamed("__code", "code"), sandbox, False, "test", "ran", "printed")
    back = done.drop("code", "__none").withColumnsRenamed({"__own": code, "__starter": "starter_code"})
    return judged(back).drop("program", "test", "expected", "ran", "printed")


def evaluate(items: DataFrame, model: Model, limit: int, execute_one: Executor = text_executor, public: bool = False, start: int | None = None, size: int | None = None) -> DataFrame:
    """Generate, then execute on the tests and, if asked, on the public tests."""
    made = generate(items, model, limit, start, size).join(items.select("item", "row_idx", "prompt", "starter_code", "tests", "public_tests", "difficulty"), "item")
    done = execute(made, execute_one, model.prefix_starter_code)
    return execute(done, execute_one, model.prefix_starter_code, "public_tests", "passing_public", "output_public") if public else done


def redo(attempts: DataFrame, mode: str, execute_one: Executor = text_executor) -> DataFrame:
    """Attempts with the selected failures run again and merged back by item and code."""
    chosen = joins.redo_selection(attempts, mode, scoring.error_kind("output"))
    again = execute(chosen.drop("passing", "output"), execute_one)
    return joins.merge_back(attempts, again, ["passing", "output"])


def score(attempts: DataFrame, scorer: Scorer = hashed_scorer, prefix_starter: bool = True, strip_comments: bool = False) -> DataFrame:
    """Reward columns for attempts (prompt, starter_code, code): both scores and the label (a tie counts as 1)."""
    code = F.concat("starter_code", "code") if prefix_starter else F.col("code")
    code = text.strip_comments(code) if strip_comments else code
    content = attempts.withColumn("__content", text.docstring_prompt("prompt", code))

    @F.pandas_udf("struct<negative:double,positive:double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(scorer(b.tolist()), columns=["negative", "positive"])

    out = content.withColumn("__s", scored("__content")).withColumns({"orm_0_score": F.col("__s.negative"), "orm_1_score": F.col("__s.positive")})
    return out.withColumn("orm_label", scoring.label_at_least("orm_0_score", "orm_1_score")).drop("__s", "__content")


def evolve(items: DataFrame, model: Model, scorer: Scorer, rounds: int, strategy: str = "best", seed: int = 42, candidates: int = 1) -> DataFrame:
    """The best of `rounds` times `candidates` programs an item. A round's prompt is the item's own prompt followed by
    the best (or a random) program before it and the mark of an evolution; a program is scored behind the item's own
    prompt. Of equal scores the first counts. A round is a DataFrame stage; its lineage is cut by checkpoint() in the
    session's checkpoint folder."""
    if strategy not in ("best", "random"):
        raise NotImplementedError(strategy)
    base = asked(items.select("item", "row_idx", "prompt", "starter_code"), model).withColumnRenamed("asked", "own").select("item", "own")
    pool = None

    @F.pandas_udf("double")
    def positive(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([p for _, p in scorer(b.tolist())])

    first = F.struct("orm_1_score", -F.col("round"), -F.col("idx"))
    for r in range(1, rounds + 1):
        worded = base.withColumn("asked", F.col("own"))
        if pool is not None:
            order = first if strategy == "best" else F.struct(selection.hash_order(f"{seed}:{r}", "item", "round", "idx"))
            last = pool.groupBy("item").agg(F.max_by("code", order).alias("__b"))
            worded = base.join(last, "item").withColumn("asked", text.evolution_prompt(F.concat("own", "__b"))).drop("__b")
        made = _generated(worded, model, candidates).join(base, "item")
        new = checkpoint(made.select("item", F.lit(r).alias("round"), "idx", "code", positive(F.concat("own", "code")).alias("orm_1_score")))
        pool = new if pool is None else pool.unionByName(new)
    return pool.groupBy("item").agg(F.max_by(F.struct("code", "orm_1_score"), first).alias("b")).select("item", "b.*")


def augment(solutions: DataFrame, generate: Generator, retries: int = 3, turns: Callable[[Column], Column] = text.augment_turns, most: int | None = None) -> DataFrame:
    """Commented code for solutions (item, idx, question, code): reasoning is what the generator answers if its syntax
    tree is the code's own, else null. What failed is asked again `retries` times, and the last answer that matches
    counts. `most`: only the first so many solutions of an item are asked about."""
    rows = solutions if most is None else selection.prefix_per_item(solutions, most)
    worded = checkpoint(rows.withColumn("asked", F.to_json(turns(text.docstring_prompt("question", F.col("code"))))))

    @F.pandas_udf("string")
    def answered(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for prompt, attempt in batches:
            yield pd.Series(generate(prompt.tolist(), attempt.tolist()))

    def tried(jobs: DataFrame) -> DataFrame:
        return jobs.withColumn("out", answered("asked", "try")).withColumn("ok", pyudfs.same_tree_udf("code", "out"))

    once = checkpoint(tried(worded.withColumn("try", F.lit(0))))
    again = once.where("not ok").drop("try", "out", "ok").withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(retries)))) if retries else None
    late = tried(again).where("ok").groupBy("item", "idx").agg(F.max_by("out", "try").alias("late")) if retries else once.select("item", "idx", F.lit(None).cast("string").alias("late")).limit(0)
    return once.join(late, ["item", "idx"], "left").withColumn("reasoning", F.when(F.col("ok"), F.col("out")).otherwise(F.col("late"))).drop("try", "out", "ok", "late", "asked")


def rephrase(problems: DataFrame, generate: Generator, shots: list[tuple[str, str]] | None = None) -> DataFrame:
    """Problems (row_idx, question, solutions) with `rephrased`, one answer a solution to the rephrasing prompt."""
    jobs = problems.select("row_idx", text.rephrase_prompt("question", shots).alias("asked"), F.explode(F.when(F.size("solutions") > 0, F.sequence(F.lit(1), F.size("solutions")))).alias("idx"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["row_idx", "idx"]].assign(code=generate(b["asked"].tolist(), b["idx"].tolist()))

    kind = problems.schema["row_idx"].dataType.simpleString()
    made = jobs.mapInPandas(run, f"row_idx {kind}, idx int, code string")
    listed = joins.to_list(made, "row_idx", "idx", "code", "rephrased")
    return problems.join(listed, "row_idx", "left").withColumn("rephrased", F.coalesce("rephrased", F.array().cast("array<string>")))
