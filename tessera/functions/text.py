"""Text expressions for prompts and code: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NL = "\n"
QUOTES = '"""'


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(c) -> Column:
    """Strips all Unicode white space, unlike trim."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def docstring_prompt(question, code=None) -> Column:
    """The question, its triple quotes escaped, as a docstring; then the code; stripped."""
    shown = F.replace(_c(question), F.lit(QUOTES), F.lit("\\" + QUOTES))
    return py_strip(F.concat(F.lit(QUOTES + NL), shown, F.lit(NL + QUOTES + NL), F.coalesce(_c(code), F.lit("")) if code is not None else F.lit("")))


#: Fixed value: what parts a program from its evolved form in a prompt.
EVOLVED = "# ==== EVOLVED CODE ===="


def evolution_prompt(before, after=None) -> Column:
    tail = _c(after) if after is not None else F.lit("")
    return py_strip(F.concat(_c(before), F.lit(NL + EVOLVED + NL), tail))


#: Fixed value: what starts each program of a few-shot prompt.
NEW_CODE = "# START NEW CODE"
#: Examples (question, program, reasoning) for programs that read input, and for functions that continue starter code.
INPUT_SHOTS = [
    ("Read an integer n and print the sum of 1 to n.", "n = int(input())\nprint(n * (n + 1) // 2)", "# - Read: the only line holds n.\n# - Sum: the closed form needs no loop."),
    ("Read a line and print it backwards.", "print(input()[::-1])", "# - Reverse: a slice with step -1 turns the line around."),
]
FUNCTION_SHOTS = [
    ("Return the larger of two numbers.", "def larger(a, b):\n    return a if a > b else b", "# - Compare: one condition decides."),
    ("Count the vowels of a word.", "def vowels(word):\n    return sum(c in 'aeiou' for c in word)", "# - Count: each letter that is a vowel adds one."),
]


def _bare(starter) -> Column:
    return F.coalesce(_c(starter), F.lit("")) == "" if starter is not None else F.lit(True)


def few_shot_prompt(question, code=None, cot: bool = False, input_shots: list | None = None, function_shots: list | None = None) -> Column:
    """Example programs, each under its question (and, with `cot`, its reasoning), then the question's own docstring
    prompt. The examples read input where there is no starter code, and are functions where there is."""

    def shown(shots: list) -> str:
        return "".join(f"{NEW_CODE}\n{QUOTES}\n{q}\n{QUOTES}\n{why + NL + NL if cot else ''}{program}\n" for q, program, why in shots)

    own = F.concat(F.lit(NEW_CODE + NL), docstring_prompt(question, code))
    return F.concat(F.when(_bare(code), shown(INPUT_SHOTS if input_shots is None else input_shots)).otherwise(shown(FUNCTION_SHOTS if function_shots is None else function_shots)), py_strip(own))


#: Fixed values of the chat prompts.
CHAT_TASK = "Please write a Python program that meets the following requirements:"
CHAT_STARTER = "Your solution should utilize the following starter code:"


def _chat_turns(shots: list, answer_role: str) -> list[tuple[Column, Column]]:
    turns = []
    for asked, answer, *_ in shots:
        turns += [(F.lit("user"), F.lit(f"{CHAT_TASK}\n\n{asked}")), (F.lit(answer_role), F.lit(f"```python\n{answer}\n```"))]
    return turns


def few_shot_chat(shots: list, question, starter=None, system: str | None = None, answer_role: str = "system", function_shots: list | None = None) -> Column:
    """Turns (role, content): optional system text, task and fenced answer of each example, then the question with
    its starter code, if there is any. Answers carry the role `answer_role`; with starter code, the examples are
    `function_shots` if given."""
    asked = F.concat(F.lit(f"{CHAT_TASK}\n\n"), F.replace(_c(question), F.lit(QUOTES), F.lit("\\" + QUOTES)))
    if starter is not None:
        given = F.concat(F.lit(f"\n\n{CHAT_STARTER}\n\n```python\n"), _c(starter), F.lit("\n```"))
        asked = F.concat(asked, F.when(~_bare(starter), given).otherwise(""))

    def turns(examples: list) -> Column:
        listed = ([(F.lit("system"), F.lit(system))] if system is not None else []) + _chat_turns(examples, answer_role) + [(F.lit("user"), asked)]
        return F.array(*[F.struct(r.alias("role"), t.alias("content")) for r, t in listed])

    return turns(shots) if function_shots is None else F.when(_bare(starter), turns(shots)).otherwise(turns(function_shots))


#: Fixed values of the rephrasing prompt's marks.
ORIGINAL, REPHRASED = "# Original:", "# Rephrased:"
REPHRASE_SHOTS = [("Print the largest of n numbers.", "Given n numbers, write out their maximum.")]


def rephrase_prompt(question, shots: list[tuple[str, str]] | None = None, task: str = "Say the following task in other words; keep every technical detail.") -> Column:
    """Task, examples (original, rephrased) parted by empty lines, then the question as an original to be rephrased."""
    head = task + NL + "".join(f"{ORIGINAL}\n{a}\n{REPHRASED}\n{b}\n\n" for a, b in (REPHRASE_SHOTS if shots is None else shots))
    return F.concat(F.lit(head + ORIGINAL + NL), _c(question), F.lit(NL + REPHRASED + NL))


AUGMENT_TASK = "Add a comment line before each important step of this code, saying the step in words. Change no code."
AUGMENT_ANSWER = "Here is the code with comments:"


def augment_turns(code, shots: list[tuple[str, str]] = (), system: str | None = None) -> Column:
    """Turns (role, content) that ask for comments on code, with examples (code, commented code)."""
    turns = [("system", F.lit(system))] if system is not None else []
    for asked, answer in shots:
        turns += [("user", F.lit(f"{AUGMENT_TASK}\n```py\n{asked}\n```")), ("assistant", F.lit(f"{AUGMENT_ANSWER}\n```py\n{answer}\n```"))]
    turns.append(("user", F.concat(F.lit(f"{AUGMENT_TASK}\n```py\n"), _c(code), F.lit("\n```"))))
    return F.array(*[F.struct(F.lit(r).alias("role"), t.alias("content")) for r, t in turns])


def chat_template(turns) -> Column:
    """The turns' contents one after the other; a system turn is an error."""
    shown = F.array_join(F.transform(_c(turns), lambda t: t["content"]), "")
    return F.when(F.exists(_c(turns), lambda t: t["role"] == "system"), F.raise_error(F.lit("system turns are not allowed"))).otherwise(shown)


def code_block(answer) -> Column:
    """Lines inside the first fenced block, each with a line feed; unclosed blocks run to the end; none gives ''."""
    lines = F.split(_c(answer), NL)
    marks = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x).startswith("```"), i)), lambda i: i.isNotNull())
    first, second = F.get(marks, F.lit(0)), F.coalesce(F.get(marks, F.lit(1)), F.size(lines))
    inner = F.transform(F.slice(lines, first + 2, F.greatest(second - first - 1, F.lit(0))), lambda x: F.concat(x, F.lit(NL)))
    return F.when(first.isNull(), "").otherwise(F.array_join(inner, ""))


def strip_comments(code) -> Column:
    return F.regexp_replace(_c(code), r"#[^\n]*", "")


def is_comment(line: Column) -> Column:
    return F.ltrim(line).startswith("#")


def without_comment_lines(code) -> Column:
    return F.array_join(F.filter(F.split(_c(code), NL), lambda x: ~is_comment(x)), NL)


def comment_ratio(code) -> Column:
    """Comment runs per character of code that is neither space nor line feed; 0 without code."""
    solid = F.length(F.regexp_replace(without_comment_lines(code), "[\n ]", ""))
    return F.coalesce(F.try_divide(F.size(reasoning_steps(code)).cast("double"), solid), F.lit(0.0))


def _runs(code) -> Column:
    """Comment runs as structs (text, first line, last line), lines from 1."""
    begin = F.struct(F.lit(0).alias("i"), F.lit(False).alias("open"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("runs"))

    def step(acc: Column, line: Column) -> Column:
        i = acc["i"] + 1
        body = F.trim(F.regexp_replace(line, r"^\s*#\s*", ""))
        last = F.element_at(acc["runs"], -1)
        grown = F.concat(F.slice(acc["runs"], F.lit(1), F.size(acc["runs"]) - 1), F.array(F.struct(F.concat_ws(" ", last["text"], body).alias("text"), last["start"].alias("start"), i.alias("end"))))
        new = F.concat(acc["runs"], F.array(F.struct(body.alias("text"), i.alias("start"), i.alias("end"))))
        return F.struct(i.alias("i"), is_comment(line).alias("open"), F.when(~is_comment(line), acc["runs"]).when(acc["open"], grown).otherwise(new).alias("runs"))

    return F.aggregate(F.split(_c(code), NL), begin, step)["runs"]


def reasoning_steps(code) -> Column:
    """Consecutive comment lines joined by spaces, one text a run."""
    return F.transform(_runs(code), lambda r: r["text"])


def reasoning_step_ranges(code) -> Column:
    """Comment runs with the range of code lines (from 0, both ends in) up to the next run; a last run without code
    has the number of lines as its range."""
    runs = _runs(code)
    total = F.size(F.split(_c(code), NL))
    ends = F.transform(runs, lambda r, i: F.coalesce(F.get(F.transform(runs, lambda q: q["start"]), i + 1) - 2, total - 1))
    return F.transform(runs, lambda r, i: F.struct(r["text"].alias("text"), r["end"].alias("start"), F.greatest(F.get(ends, i), r["end"]).alias("end")))


def line_count(text) -> Column:
    t = _c(text)
    return F.length(t) - F.length(F.replace(t, F.lit(NL), F.lit(""))) + 1


def word_tokens(text) -> Column:
    """A tokenizer-free stand-in for a token length: runs of word characters and single other marks."""
    return F.regexp_count(_c(text), F.lit(r"\w+|[^\w\s]"))


def sanitised_name(name, index) -> Column:
    """Line feeds, tabs, slashes and spaces as underscores; the row index where there is no name."""
    return F.coalesce(F.regexp_replace(_c(name).cast("string"), r"[\n\r\t/ ]", "_"), _c(index).cast("string"))


def escaped_question(question, starter) -> Column:
    """Backslashes doubled; a line feed at the end where there is no starter code."""
    shown = F.replace(_c(question), F.lit("\\"), F.lit("\\\\"))
    return F.when(F.coalesce(_c(starter), F.lit("")) == "", F.concat(shown, F.lit(NL))).otherwise(shown)


def prompt_and_response(content) -> tuple[Column, Column]:
    """Split after the second triple quote."""
    c = _c(content)
    prompt = F.concat(F.substring_index(c, QUOTES, 2), F.lit(QUOTES))
    return prompt, F.substring(c, F.length(prompt) + 1, F.length(c))


def first_docstring(code) -> Column:
    """The first docstring's text, indented by four less; null without one."""
    found = F.regexp_extract(_c(code), r'(?s)"""(.*?)"""', 1)
    return F.when(_c(code).rlike(r'(?s)""".*?"""'), py_strip(F.regexp_replace(found, r"(?m)^    ", "")))


def function_docstring(code, entry) -> Column:
    """The docstring that follows `def <entry>`."""
    after = F.split_part(_c(code), F.concat(F.lit("def "), _c(entry)), F.lit(2))
    return first_docstring(after)


def header_before_last_def(code) -> Column:
    """Everything before the last function definition."""
    parts = F.split(_c(code), "def ")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "def ")).otherwise("")


def verdict(answer) -> tuple[Column, Column]:
    """(yes or no as a boolean, explanation) from an answer's first and other lines that aren't blank."""
    lines = F.filter(F.split(_c(answer), NL), lambda x: F.trim(x) != "")
    first = F.lower(F.trim(F.get(lines, F.lit(0))))
    enough = F.size(lines) >= 2
    return F.when(enough, F.when(first.startswith("yes"), True).when(first.startswith("no"), False)), F.when(enough, F.array_join(F.slice(lines, F.lit(2), F.size(lines)), NL))


STAR_IMPORT = r"(?m)^[ \t]*from[ \t]+[\w.]+[ \t]+import[ \t]*\*"
END_MARK = "___SENTINEL___"  # fixed: parts the outputs of a program's runs
PRELUDE = "import io\nimport sys\n"


def rewritten_exit(code) -> Column:
    """Calls that would end the interpreter return from the enclosing function instead."""
    return F.regexp_replace(_c(code), r"\b(?:sys\.)?(?:exit|quit)\([^\n]*\)", "return")


def stdin_harness(code, name: str = "__run_prog__") -> Column:
    """The program as a function, so that it can run once per input; star imports, which no function may hold, go first."""
    stars = F.array_join(F.transform(F.regexp_extract_all(_c(code), F.lit(f"({STAR_IMPORT})")), lambda x: F.concat(F.trim(x), F.lit(NL))), "")
    body = rewritten_exit(F.regexp_replace(_c(code), STAR_IMPORT, ""))
    return F.concat(F.lit(PRELUDE), stars, F.lit(f"def {name}():{NL}"), F.array_join(F.transform(F.split(body, NL), lambda x: F.concat(F.lit("    "), x)), NL))


def stdin_runs(inputs, name: str = "__run_prog__") -> Column:
    """Test code that runs the harnessed program once for each text of an array, an end mark after each output."""
    loop = f"for __text__ in __inputs__:\n    sys.stdin = io.TextIOWrapper(io.BytesIO(__text__.encode()), encoding='utf8')\n    {name}()\n    print('{END_MARK}')\n"
    return F.concat(F.lit("__inputs__ = "), F.to_json(_c(inputs)), F.lit(NL + loop))


def run_outputs(output) -> Column:
    """What each run printed: the parts before the end marks."""
    parts = F.split(_c(output), END_MARK + "\n?")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def md5_hex(text) -> Column:
    return F.md5(_c(text).cast("binary"))


def marked(text, mark: str = "<|mask|>") -> Column:
    return F.concat(F.lit(mark), _c(text))


def unmarked(text, mark: str = "<|mask|>") -> Column:
    return F.when(_c(text).startswith(mark), F.substring(_c(text), F.lit(len(mark) + 1), F.length(_c(text)))).otherwise(_c(text))


def same_output(actual, expected) -> Column:
    """Program output against expected output: equal; equal when stripped or in any case; or line by line (blank
    lines dropped only if the counts differ) equal, equal in any case, or numbers within 1e-4."""
    a, e = _c(actual), _c(expected)
    split = lambda x: F.transform(F.split(py_strip(x), r"\r\n|[\n\r]"), py_strip)
    la, le = split(a), split(e)
    solid = lambda x: F.filter(x, lambda v: v != "")
    differ = F.size(la) != F.size(le)
    la, le = F.when(differ, solid(la)).otherwise(la), F.when(differ, solid(le)).otherwise(le)

    def alike(x: Column, y: Column) -> Column:
        number = lambda v: F.when(~v.rlike(r"[0-9.][dDfF]$"), v).try_cast("double")  # noqa: E731  a type's letter is no part of a number
        gap = F.abs(number(x) - number(y))
        return F.coalesce((F.lower(x) == F.lower(y)) | (~F.isnan(gap) & (gap < 1e-4)), F.lit(False))

    by_line = (F.size(la) == F.size(le)) & F.forall(F.zip_with(la, le, alike), lambda x: x)
    return F.coalesce((a == e) | (F.lower(py_strip(a)) == F.lower(py_strip(e))) | by_line, F.lit(False))
