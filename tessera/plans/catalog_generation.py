"""Registered queries of prompts, generation, execution, scoring and the data sets built from them. Generators, scorers
and executors are stand-ins that SQL can follow."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera import fixtures as X
from tessera.fixtures import PROGRAMS_SQL
from tessera.functions import pyudfs, scoring, text
from tessera.operators import joins as J
from tessera.operators import metrics as M
from tessera.operators import selection as S
from tessera.plans import evaluate as E
from tessera.plans import pipelines as P
from tessera.plans.catalog import A, _rounded, query

_Q = "'\"\"\"'"
_STRIP = "' ' || chr(10) || chr(9) || chr(13)"


def _sql(value: str) -> str:
    """A Python text as a SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def _doc(question: str, code: str = "''") -> str:
    return f"trim({_Q} || chr(10) || replace({question}, {_Q}, '\\' || {_Q}) || chr(10) || {_Q} || chr(10) || {code}, {_STRIP})"


def _digit(prompt: str) -> str:
    return f"(('0x' || substr(md5({prompt} || ':' || idx), 1, 8))::ubigint % 10)"


def _reward(content: str) -> str:
    return f"(('0x' || substr(md5({content}), 1, 8))::ubigint % 1000 / 1000e0)"


# prompts


def _shots_sql(shots: list, cot: bool) -> str:
    return _sql("".join(f'{text.NEW_CODE}\n"""\n{q}\n"""\n{why + chr(10) * 2 if cot else ""}{program}\n' for q, program, why in shots))


_STARTER = "case when item_id % 2 = 0 then '' else 'def f' || item_id || '():' end"


def _few(cot: bool) -> str:
    own = f"trim({_sql(text.NEW_CODE)} || chr(10) || {_doc('text', _STARTER)}, {_STRIP})"
    return f"case when item_id % 2 = 0 then {_shots_sql(text.INPUT_SHOTS, cot)} else {_shots_sql(text.FUNCTION_SHOTS, cot)} end || {own}"


def _questions(spark, d):
    starter = F.when(F.col("item_id") % 2 == 0, "").otherwise(F.concat(F.lit("def f"), F.col("item_id").cast("string"), F.lit("():")))
    return X.table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"), starter.alias("starter_code"))


@query(f"select item_id, kind, md5(case kind when 'base' then {_doc('text', _STARTER)} when 'evolver' then {_doc('text', _STARTER)} when 'few-shot' then {_few(False)} else {_few(True)} end) as asked from benchmark, (select unnest(['base', 'evolver', 'few-shot', 'few-shot-cot']) as kind)")
def prompt_kinds(spark, d):
    out = [E.asked(_questions(spark, d), E.model_factory(k, k)).select("item_id", F.lit(k).alias("kind"), text.md5_hex("asked").alias("asked")) for k in ("base", "evolver", "few-shot", "few-shot-cot")]
    return S.union_all(*out)


def _turn(role: str, content: str) -> str:
    return f"'{{\"role\":\"{role}\",\"content\":' || to_json({content}) || '}}'"


def _chat_sql(shots: list) -> str:
    parts = [_turn("system", _sql(E.SYSTEM))]
    for asked, answer, *_ in shots:
        parts += [_turn("user", _sql(f"{text.CHAT_TASK}\n\n{asked}")), _turn("system", _sql(f"```python\n{answer}\n```"))]
    starter = f"case when item_id % 2 = 0 then '' else {_sql(chr(10) * 2 + text.CHAT_STARTER + chr(10) * 2 + '```python' + chr(10))} || {_STARTER} || chr(10) || '```' end"
    parts.append(_turn("user", f"{_sql(text.CHAT_TASK + chr(10) * 2)} || replace(text, {_Q}, '\\' || {_Q}) || {starter}"))
    return "'[' || " + " || ',' || ".join(parts) + " || ']'"


@query(f"select item_id, md5(case when item_id % 2 = 0 then {_chat_sql(text.INPUT_SHOTS)} else {_chat_sql(text.FUNCTION_SHOTS)} end) as asked from benchmark")
def chat_prompts(spark, d):
    return E.asked(_questions(spark, d), E.model_factory("few-shot-chat", "c")).select("item_id", text.md5_hex("asked").alias("asked"))


@query("select conv_id, md5(string_agg(text, '' order by turn)) as shown from conversations group by conv_id")
def chat_templates(spark, d):
    c = X.table(spark, d, "conversations")
    turn = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    listed = c.groupBy("conv_id").agg(turn.alias("t"))
    roles = F.transform("t", lambda t: F.struct(F.when(t["role"] == "system", "user").otherwise(t["role"]).alias("role"), t["content"].alias("content")))
    return listed.select("conv_id", text.md5_hex(text.chat_template(roles)).alias("shown"))


_REPHRASE = _sql("Say the following task in other words; keep every technical detail.\n" + "".join(f"{text.ORIGINAL}\n{a}\n{text.REPHRASED}\n{b}\n\n" for a, b in text.REPHRASE_SHOTS) + text.ORIGINAL + "\n")


@query(f"select item_id as row_idx, 'print(' || {_digit(f'{_REPHRASE} || text || chr(10) || {_sql(text.REPHRASED)} || chr(10)')} || ')' as rephrased, cast(idx as integer) as idx from benchmark, (select unnest([1, 2, 3]) as idx) where idx <= item_id % 4")
def rephrased_questions(spark, d):
    n = F.when(F.col("item_id") % 4 > 0, F.sequence(F.lit(1), (F.col("item_id") % 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    p = X.table(spark, d, "benchmark").select(F.col("item_id").alias("row_idx"), F.col("text").alias("question"), n.alias("solutions"))
    return J.to_rows(E.rephrase(p, E.echo_generator).select("row_idx", "rephrased"), "rephrased", name="rephrased").select("row_idx", "idx", "rephrased")


@query(f"with c as (select *, {_doc('text', "case when turn % 2 = 0 then '' else 'x = 1' end")} as c from conversations), p as (select *, array_to_string(string_split(c, {_Q})[1:2], {_Q}) || {_Q} as p from c) select conv_id, turn, md5(c) as prompt, substr(c, length(p) + 1) as response from p")
def prompt_response_split(spark, d):
    """A text's own triple quotes are escaped and still end the prompt: what follows them is the response."""
    c = X.table(spark, d, "conversations")
    content = text.docstring_prompt("text", F.when(F.col("turn") % 2 == 0, "").otherwise(F.lit("x = 1")))
    prompt, response = text.prompt_and_response("content")
    return c.withColumn("content", content).select("conv_id", "turn", text.md5_hex(F.concat(prompt, response)).alias("prompt"), response.alias("response"))


@query("select item_id, item_id || ' a' as first, 'b' as after, 'def f():' || chr(10) || '    \"\"\"' || item_id || ' a\"\"\"' || chr(10) as header from benchmark")
def docstring_parts(spark, d):
    n = F.col("item_id").cast("string")
    code = F.concat(F.lit('def f():\n    """'), n, F.lit(' a"""\ndef g():\n    """b"""\n'))
    return X.table(spark, d, "benchmark").select("item_id", text.first_docstring(code).alias("first"), text.function_docstring(code, F.lit("g")).alias("after"), text.header_before_last_def(code).alias("header"))


@query("select conv_id, turn, md5('<|mask|>' || text) as marked, md5(text) as back, md5(replace(text, '\\', '\\\\') || case when turn % 2 = 0 then chr(10) else '' end) as escaped from conversations")
def loss_marks(spark, d):
    c = X.table(spark, d, "conversations")
    marked, starter = text.marked("text"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.lit("s"))
    return c.select("conv_id", "turn", text.md5_hex(marked).alias("marked"), text.md5_hex(text.unmarked(marked)).alias("back"), text.md5_hex(text.escaped_question("text", starter)).alias("escaped"))


@query("""with a as (select *, case turn % 3 when 0 then 'Yes.' || chr(10) || chr(10) || text when 1 then chr(10) || 'no way' || chr(10) || text else 'yes' end as a from conversations),
l as (select *, list_filter(string_split(a, chr(10)), lambda x: trim(x, ' ') <> '') as l from a)
select conv_id, turn, case when len(l) < 2 then null when starts_with(lower(trim(l[1], ' ')), 'yes') then true when starts_with(lower(trim(l[1], ' ')), 'no') then false end as verdict, case when len(l) > 1 then md5(array_to_string(l[2:], chr(10))) end as why from l""")
def verdict_answers(spark, d):
    c = X.table(spark, d, "conversations")
    shown = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Yes.\n\n"), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("\nno way\n"), "text")).otherwise(F.lit("yes"))
    verdict, why = text.verdict(shown)
    return c.select("conv_id", "turn", verdict.alias("verdict"), text.md5_hex(why).alias("why"))


# code


@query(f"with {PROGRAMS_SQL} select item, '# first' || chr(10) || replace(code, '  # first', '') as code from programs")
def comments_moved(spark, d):
    return X.programs(spark, d).select("item", pyudfs.leading_comments_udf("code").alias("code"))


@query(f"with {PROGRAMS_SQL} select item, case when item % 3 = 0 then code else replace(code, chr(9), '    ') end as code from programs")
def tabs_widened(spark, d):
    return X.programs(spark, d).select("item", pyudfs.spaces_for_tabs_udf("code", "starter_code").alias("code"))


@query(f"""select item_id, '# - a, b' || chr(10) || '#     - in ' || item_id || chr(10) || 'if x:' || chr(10) || '    y' as cot, {_Q} || chr(10) || '# q' || chr(10) || {_Q} || chr(10) || '# - top' || chr(10) || chr(10) || 'x' as below from benchmark""")
def comments_to_bullets(spark, d):
    n = F.col("item_id").cast("string")
    code = F.concat(F.lit("# a.\n# b!\nif x:\n    # in "), n, F.lit("\n    y"))
    content = F.lit('"""\n# q\n"""\n# top\nx')
    return X.table(spark, d, "benchmark").select("item_id", pyudfs.bullets_on_top_udf(code).alias("cot"), pyudfs.bullets_after_docstring_udf(content).alias("below"))


_HARNESS = "'import io' || chr(10) || 'import sys' || chr(10) || 'from math import *' || chr(10) || 'def __run_prog__():' || chr(10) || '    ' || chr(10) || '    n = int(input())' || chr(10) || '    if n > ' || item_id || ':' || chr(10) || '        return' || chr(10) || '    print(n)'"
_RUNS = "'__inputs__ = [' || to_json(text) || ',\"' || item_id || '\"]' || chr(10) || 'for __text__ in __inputs__:' || chr(10) || '    sys.stdin = io.TextIOWrapper(io.BytesIO(__text__.encode()), encoding=''utf8'')' || chr(10) || '    __run_prog__()' || chr(10) || '    print(''___SENTINEL___'')' || chr(10)"


@query(f"select md5({_RUNS}) as hash, item_id, {_HARNESS} as program, '1' || chr(10) || '|' || item_id || chr(10) as outputs from benchmark")
def input_harness(spark, d):
    n = F.col("item_id").cast("string")
    code = F.concat(F.lit("from math import *\nn = int(input())\nif n > "), n, F.lit(":\n    sys.exit(0)\nprint(n)"))
    made = P.harnessed_tests(X.table(spark, d, "benchmark").withColumn("code", code).withColumn("inputs", F.array("text", n)))
    hashes = P.test_bank(made).select(F.col("test").alias("t"), "hash")
    printed = text.run_outputs(F.concat(F.lit("1\n___SENTINEL___\n"), n, F.lit("\n___SENTINEL___\n")))
    return made.join(hashes, F.col("test") == F.col("t")).select("hash", "item_id", "program", F.array_join(printed, "|").alias("outputs"))


@query("select item_id, item_id % 2 = 0 as same, case when item_id % 2 = 0 then 1 else 2 end as start from benchmark")
def json_and_steps(spark, d):
    b = X.table(spark, d, "benchmark")
    n, even = F.col("item_id").cast("string"), F.col("item_id") % 2 == 0
    left = F.concat(F.lit('{"a": [1, '), n, F.lit(".00001]}"))
    right = F.concat(F.lit('{"a": [1.0, '), F.when(even, n).otherwise(F.lit('"x"')), F.lit("]}"))
    before, after = F.lit("# one\na = 1\n# two\nb = 2"), F.when(even, F.lit("# one\na = 3\n# two\nb = 2")).otherwise(F.lit("# one\na = 1\n# two\nb = 5"))
    step = pyudfs.changed_step_udf("before", "after", F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)))
    return b.select("item_id", pyudfs.equal_json_udf(left, right).alias("same"), before.alias("before"), after.alias("after")).select("item_id", "same", step["start"].alias("start"))


@query("select item_id as item, item_id % 3 <> 0 as parses, item_id % 3 <> 0 as differs, true as keeps from benchmark")
def mutation_properties(spark, d):
    """What holds of any mutation: it parses and differs where the program parses, and what is beside the change stays."""
    m = X.programs(spark, d).withColumn("mutated", pyudfs.mutate_udf("code", F.col("item").cast("int")))
    return m.select("item", pyudfs.parses_udf("mutated").alias("parses"), (F.col("mutated") != F.col("code")).alias("differs"), F.col("mutated").contains("# first").alias("keeps"))


@query("select item_id as item, score, case when score = 0 then 1 end as start, case when score = 0 then 1 end as end from benchmark, (select unnest([0, 1]) as score) where score = 1 or item_id % 2 = 0")
def mutated_dataset(spark, d):
    n = F.col("item_id").cast("string")
    code = F.concat(F.when(F.col("item_id") % 2 == 0, "# add\n").otherwise(""), F.lit("x = y + "), n)
    rows = X.table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.lit(1).alias("idx"), code.alias("code"))
    out = P.mutated_rows(rows, lambda jobs: jobs.withColumn("passing", F.lit(False)))
    return out.select("item", "score", "mutation_step.start", "mutation_step.end")


# scores


@query("select event_id, round(1 / (1 + exp(1 - value / 50)), 9) as share, cast(value / 50 >= 1 as integer) as at_least, value / 50 > 1 as above, round((value + value / 2) / 2 * -1, 9) as logprob from events")
def label_rules(spark, d):
    e = X.table(spark, d, "events").withColumns({"neg": F.lit(1.0), "pos": F.col("value") / 50})
    means = scoring.mean_logprob(F.array(-F.col("value"), -F.col("value") / 2))
    return e.select("event_id", F.round(scoring.positive_share("neg", "pos"), 9).alias("share"), scoring.label_at_least("neg", "pos").alias("at_least"), scoring.label_above("neg", "pos").alias("above"), F.round(means, 9).alias("logprob"))


@query(f"{A}, s as (select item, count(*) as size from attempts group by item) select item, size, n, cast(greatest(25, least(100, cast(floor(100 * (1 - n * 1e0 / size) + 1) as bigint))) as bigint) as draws from s, (select unnest([1, 10, 50, 75, 99]) as n) where n <= size")
def draw_budget(spark, d):
    """How many draws each item's estimate takes, for each size of draw that it allows."""
    sizes = J.fan_out(M.frequency(X.attempts(spark, d), "item", name="size"), n=[1, 10, 50, 75, 99]).where("n <= size")
    return sizes.withColumn("draws", scoring.draws("n", "size"))


@query(f"{A}, v as (select item, case when output = 'signup' then null else passing end as passing from attempts) select cast(item % 3 as bigint) as file, count(*) filter (where passing = 1) as passed, count(*) filter (where passing = 0) as failed, count(*) filter (where passing is null) as unknown from v group by 1")
def verdict_counters(spark, d):
    a = X.attempts(spark, d).select((F.col("item") % 3).alias("file"), F.when(F.col("output") != "signup", F.col("passing")).alias("passing"))
    return M.verdict_counts(a, ["file"])


@query(f"{A}, m as (select item, max(code) filter (where passing = 1 and idx <= 1) as chosen from attempts group by item), n as (select distinct o_custkey as item from orders), j as (select m.chosen, n.item as n from m left join n using (item)) select count(*) as pairs, cast(sum(cast(chosen is not null or n is not null as integer)) as bigint) as chosen, cast(sum(cast(chosen is null and n is not null as integer)) as bigint) as natural, cast(sum(cast(chosen is null and n is null as integer)) as bigint) as lost from j")
def fallback_counters(spark, d):
    m = X.attempts(spark, d).groupBy("item").agg(F.max(F.when((F.col("passing") == 1) & (F.col("idx") <= 1), F.col("code"))).alias("chosen"))
    n = X.table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").cast("string").alias("solution"), F.col("o_orderkey").alias("row_idx"))
    return J.fallback_counts(J.with_fallback(m, n, "item", "chosen", "solution", "row_idx"))


@query("with n as (select o_custkey, count(*) as n from orders group by 1) select count(*) filter (where n >= 2) as kept, count(*) filter (where n < 2) as lost from n")
def adjacent_losses(spark, d):
    return J.adjacent_losses(X.table(spark, d, "orders"), "o_custkey")


@query(f"{A} select item, cast(idx as integer) as idx, code, num_tokens, case when item % 3 <> 0 then passing = 1 end as passing, case when item % 3 <> 0 then output end as output from attempts")
def merged_results(spark, d):
    a = X.attempts(spark, d).withColumn("ran", F.col("passing") == 1)
    listed = a.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("idx", "code", "num_tokens", "ran", "output"))).alias("x"))
    made = F.transform("x", lambda r: F.struct(r["code"].alias("code"), r["num_tokens"].alias("num_tokens")))
    run = F.transform("x", lambda r: F.struct(r["ran"].alias("passing"), r["output"].alias("output")))
    lists = listed.select("item", made.alias("completions"), F.when(F.col("item") % 3 == 0, F.slice(run, 1, 0)).otherwise(run).alias("verdicts"))
    rows = J.to_rows(J.merged_structs(lists, "completions", "verdicts", "results").select("item", "results"), "results", name="r")
    return rows.select("item", "idx", "r.*")


# runs


def _items(spark, d):
    return E.bind(X.table(spark, d, "benchmark").withColumn("t", F.col("item_id").cast("string")), "text", "t", "t", order="item_id")


_MADE = f"made as (select cast(item_id as varchar) as item, cast(idx as integer) as idx, text, cast(item_id as varchar) as t, 'print(' || {_digit(_doc('text'))} || ')' as code from benchmark, (select unnest([1, 2, 3, 4]) as idx))"
_DONE = f"{_MADE}, done as (select *, contains(t, substr(code, 7, 1)) as passing from made)"


@query(f"with {_DONE} select item, idx, code, passing, passing as passing_public, cast({_reward(_doc('text', 'code'))} >= 0.5 as integer) as orm_label, {_reward(_doc('text', 'code'))} as orm_1_score from done")
def evaluated(spark, d):
    done = E.score(E.evaluate(_items(spark, d), E.model_factory("base", "echo"), 4, public=True))
    return done.select("item", "idx", "code", "passing", "passing_public", "orm_label", "orm_1_score")


@query(f"with {_DONE} select item, idx, code, passing or code like 'print(7)%' as passing from done")
def redone(spark, d):
    done = E.evaluate(_items(spark, d), E.model_factory("base", "echo"), 4)
    again = E.redo(done, "failed", lambda code, tests: (code.startswith("print(7)") or E.text_executor(code, tests)[0], "again"))
    return again.select("item", "idx", "code", "passing")


def tracing(program: str, test: str) -> tuple[bool, str]:
    """Stands in for a sandbox: takes the digit that the program prints, runs nothing."""
    digit = program.rsplit("print(", 1)[1][:1]
    if digit == "9":
        return False, "boom"
    if test.startswith("__inputs__"):
        return True, f"{digit}\n{text.END_MARK}\n" * len(json.loads(test.split("\n", 1)[0].split(" = ", 1)[1]))
    return True, text.END_MARK if digit > "4" else ""


_SPECS = f"""{_MADE}, k as (select *, case cast(item as bigint) % 3 when 0 then 'stdin' when 1 then 'named' else 'script' end as kind, substr(code, 7, 1) as g from made),
o as (select *, case when g = '9' then 'errored with ' || chr(39) || 'boom' || chr(39) || chr(10) when kind <> 'stdin' then case when g > '4' then '' else 'missing ___SENTINEL___ in output' end
  when cast(item as bigint) % 2 = 0 then 'expected 1 outputs but got 2' || chr(10) when g <> '3' then '[0] expected ' || chr(39) || '3' || chr(39) || ' but got ' || chr(39) || g || chr(10) || chr(39) || chr(10) else '[1] expected ' || chr(39) || 'x' || chr(39) || ' but got ' || chr(39) || '3' || chr(10) || chr(39) || chr(10) end as output from k)"""


@query(f"with {_SPECS} select item, idx, kind, output = '' as passing, output from o")
def executed_specs(spark, d):
    n = F.col("item_id") % 3
    spec = F.when(n == 0, F.when(F.col("item_id") % 2 == 0, '{"inputs": ["a", "b"], "outputs": ["3"]}').otherwise('{"inputs": ["a", "b"], "outputs": ["3", "x"]}')).when(n == 1, '{"inputs": [[1, [2]]], "outputs": [true], "fn_name": "f"}').otherwise("assert True")
    items = E.bind(X.table(spark, d, "benchmark").withColumn("t", spec), "text", "t", order="item_id")
    made = E.generate(items, E.model_factory("base", "echo"), 4).join(items.select("item", "starter_code", "tests"), "item")
    return E.execute_specs(made, tracing).select("item", "idx", "kind", "passing", "output")


_OWN = _doc("text")


@query(
    f"""with a as (select cast(item_id as varchar) as item, {_OWN} as own, idx from benchmark, (select unnest([1, 2]) as idx)),
r1 as (select item, own, 1 as round, idx, 'print(' || {_digit('own')} || ')' as code from a), s1 as (select *, {_reward('own || code')} as s from r1),
b1 as (select item, max(row(s, -round, -idx, code)) as b from s1 group by item),
r2 as (select a.item, own, 2 as round, idx, 'print(' || {_digit("trim(own || b.b[4] || chr(10) || '# ==== EVOLVED CODE ====' || chr(10), " + _STRIP + ")")} || ')' as code from a join b1 b using (item)), s2 as (select *, {_reward('own || code')} as s from r2),
pool as (select * from s1 union all select * from s2), b as (select item, max(row(s, -round, -idx, code)) as b from pool group by item) select item, b[4] as code, b[1] as orm_1_score from b"""
)
def evolved(spark, d):
    return E.evolve(_items(spark, d), E.model_factory("evolver", "e"), E.hashed_scorer, 2, candidates=2)


def commenting(prompts: list[str], attempts: list[int]) -> list[str]:
    """Stands in for a model that comments code: right on some tries, and code that does not parse on the others."""
    out = []
    for prompt, attempt in zip(prompts, attempts, strict=True):
        code = json.loads(prompt)[-1]["content"].split("```py\n", 1)[1].rsplit("\n```", 1)[0].split('"""\n')[-1]
        out.append(f"# step\n{code}" if (len(code) + attempt) % 3 == 0 else code + "\n(")
    return out


_AUGMENTED = f"{PROGRAMS_SQL}, q as (select item, trim(code, {_STRIP}) as c, code from programs), augmented as (select item, code, case when item % 3 <> 0 and (length(c) % 3 = 0 or (length(c) + 1) % 3 = 0) then '# step' || chr(10) || c end as reasoning from q)"


def _augmented(spark, d):
    return E.augment(X.programs(spark, d).withColumn("question", F.lit("q")), commenting, retries=1)


@query(f"with {_AUGMENTED} select item, code, reasoning from augmented")
def augmented_steps(spark, d):
    return _augmented(spark, d).select("item", "code", "reasoning")


@query(f"with {_AUGMENTED}, l as (select item % 20 as g, count(reasoning) as p, count(*) - count(reasoning) as f from augmented group by 1) select cast(sum(p) as bigint) as passed, cast(sum(f) as bigint) as failed, count(*) filter (where p = 0) as without from l")
def step_counters(spark, d):
    lists = _augmented(spark, d).groupBy((F.col("item") % 20).alias("g")).agg(F.array_agg(F.struct("item", "reasoning")).alias("x"))
    return P.step_counts(lists.select(F.transform("x", lambda v: v["reasoning"]).alias("reasoning_steps")))


# data sets


def _raw_problems(spark, d):
    p = X.programs(spark, d)
    tests = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), (F.col("item") % 14 + 1).cast("int")), lambda i: F.array(i.cast("string"), F.lit("z"))).alias("inputs"), F.array(F.lit("o")).alias("outputs")))
    return p.select(F.col("item").alias("row_idx"), F.concat(F.lit("question "), F.col("item").cast("string")).alias("question"), F.array("code", F.lit("short = 1"), F.concat(F.lit("a = 1\nb = 2\nc = 3\nd = 4\n# "), F.col("item").cast("string"))).alias("solutions"), tests.alias("input_output"), F.col("starter_code"))


@query("select item_id as row_idx, case when item_id % 3 = 0 then 1 else 2 end as solutions, item_id % 3 <> 0 as kept, cast(length(item_id || '') * 0 + (item_id % 14 + 1) as bigint) as tests, '1' || chr(10) || 'z' as first_input from benchmark where item_id % 14 + 1 >= 10")
def cleaned_problems(spark, d):
    kept, left = P.clean_problems(_raw_problems(spark, d), min_solutions=2)
    rows = kept.withColumn("kept", F.lit(True)).unionByName(left.withColumn("kept", F.lit(False)))
    return rows.select("row_idx", F.size("solutions").alias("solutions"), "kept", P.test_count().cast("long").alias("tests"), F.get_json_object("input_output", "$.inputs[0]").alias("first_input"))


@query(f"with {_DONE}, r as (select *, sum(cast(passing as integer)) over (partition by item order by idx) as c from done where idx <= 3) select item, idx, code from r where passing and c <= 1")
def executing_solutions(spark, d):
    made = E.generate(_items(spark, d), E.model_factory("base", "echo"), 4).join(_items(spark, d), "item")
    return P.executing_solutions(made, lambda s: E.execute(s), 1, 3).select("item", "idx", "code")


@query(f"{A} select 'question ' || item as question, 'u' || item as unique_name, cast(sum(passing) as integer) as n, md5(string_agg(code, '|' order by idx) filter (where passing = 1)) as codes from attempts group by item having sum(passing) > 0")
def passing_problems(spark, d):
    rows = P.passing_solutions(X.result_items(spark, d))
    return rows.select("question", "unique_name", F.size("solutions").alias("n"), text.md5_hex(F.array_join("solutions", "|")).alias("codes"))


def _lists(spark, d):
    s = X.solutions(spark, d)
    lists = J.to_list(s.where("idx > 0"), "item", "idx", "code", "solutions")
    return s.where("idx = 0").select("item", F.col("code").alias("question"), F.lit("").alias("starter_code")).join(lists, "item")


_LISTED = "s as (select conv_id as item, row_number() over (partition by conv_id order by turn) as idx, text as code, length(text) - length(replace(text, chr(10), '')) + 1 as loc from conversations where turn > 0), q as (select conv_id as item, text as question from conversations where turn = 0)"


@query(f"with {_LISTED}, h as (select *, row_number() over (partition by item order by loc, idx) as r, count(*) over (partition by item) as n from s), p as (select item, idx, row_number() over (partition by item order by md5('42:' || item || ':' || idx)) as o from h where r > n // 4) select item, cast(idx as integer) as idx from p join q using (item) where o = 1")
def sft_high_loc(spark, d):
    return P.training_rows(_lists(spark, d), "high_loc").select("item", "idx")


@query(f"with {_LISTED}, p as (select *, row_number() over (partition by item order by md5('42:' || item || ':' || idx)) as o from s) select item, cast(idx as integer) as idx, md5('<|mask|>' || {_doc('question', 'code')}) as content from p join q using (item) where o = 1")
def sft_random_marked(spark, d):
    rows = P.training_rows(_lists(spark, d), "random", mark="<|mask|>")
    return rows.select("item", "idx", text.md5_hex("content").alias("content"))


@query(f"with {_LISTED} select item, cast(idx as integer) as idx, md5({_doc('question', 'code')}) as both from s join q using (item)")
def sft_all_split(spark, d):
    p = _lists(spark, d)
    return P.training_rows(p, "all", split_response=True).select("item", "idx", text.md5_hex(F.concat("prompt", "response")).alias("both"))


def _orm(spark, d):
    return X.attempts(spark, d).withColumn("question", F.concat(F.lit("question "), F.col("item").cast("string"))).withColumn("starter_code", F.lit(""))


_ORM = f"{A}, w as (select *, sum(passing) over (partition by item) as p, count(*) over (partition by item) as n, count(*) over (partition by item, passing) as k, row_number() over (partition by item, passing order by idx) as r from attempts), o as (select * from w where r <= greatest(least(p, n - p, 4), case when k > 1 then 1 else 0 end))"


@query(f"{_ORM}, b as (select *, row_number() over (partition by passing order by item || ':' || idx) as o2, least((select sum(passing) from o), (select sum(1 - passing) from o)) as m from o) select item, idx, passing as score from b where o2 <= m")
def orm_dataset_balanced(spark, d):
    return P.reward_rows(_orm(spark, d), 4, balance=True).select("item", "idx", "score")


def _preferences(spark, d, mode):
    a = X.attempts(spark, d)
    questions = a.select("item").distinct().select("item", F.col("item").alias("row_idx"), F.expr("concat('question ', cast(item as string))").alias("question"), F.lit("").alias("starter_code"))
    return P.preference_rows(a, mode, questions).select("prompt", "text_chosen", "text_rejected")


_PROMPT = f"{_Q} || chr(10) || 'question ' || item || chr(10) || {_Q} || chr(10)"


@query(f"{A}, x as (select item, max(row(score, idx)) as b, min(row(score, -idx)) filter (where score <= 1) as w from attempts group by item) select {_PROMPT.replace('item', 'x.item')} as prompt, c.code as text_chosen, r.code as text_rejected from x join attempts c on c.item = x.item and c.idx = x.b[2] join attempts r on r.item = x.item and r.idx = -x.w[2] where x.b[2] <> -x.w[2]")
def dpo_best_worst(spark, d):
    return _preferences(spark, d, "best_worst")


_HASH = "md5('42:' || item || ':' || idx)"


@query(f"{A}, k as (select item, code, min({_HASH}) as h from attempts group by 1, 2), r as (select *, row_number() over (partition by item order by h) as r from k), p as (select item, max(code) filter (where r = 1) as c, max(code) filter (where r = 2) as j from r group by item) select {_PROMPT} as prompt, c as text_chosen, j as text_rejected from p where j is not null")
def dpo_random(spark, d):
    return _preferences(spark, d, "random")


@query("with p as (select doc_id, text, md5('42:' || doc_id) as position, row_number() over (partition by text order by doc_id) as r from documents where text is not null) select doc_id, position, md5(" + _doc("replace(text, '\\', '\\\\')") + " || chr(10)) as prompt from p where r = 1 and len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) < 300")
def rl_prompts(spark, d):
    out = P.prompt_rows(_problems(spark, d, F.col("lang")), 300, curriculum=False)
    return out.select(F.col("solutions").alias("doc_id"), "position", text.md5_hex("prompt").alias("prompt"))


def _problems(spark, d, difficulty):
    p = X.table(spark, d, "documents").where("text is not null")
    return p.select(F.col("doc_id").alias("row_idx"), F.col("text").alias("question"), F.lit("").alias("starter_code"), difficulty.alias("difficulty"), F.lit("{}").alias("input_output"), F.col("doc_id").alias("solutions"))


@query(
    """with recursive p as (select doc_id, text, ['EASY', 'MEDIUM', 'MEDIUM_HARD', 'HARD', 'VERY_HARD', 'UNKNOWN_DIFFICULTY', 'OTHER'][doc_id % 7 + 1] as difficulty, row_number() over (partition by text order by doc_id) as r from documents where text is not null),
e as (select * from p where r = 1 and len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) < 300),
k as (select doc_id, row_number() over (order by list_position(['EASY', 'MEDIUM', 'MEDIUM_HARD', 'HARD', 'VERY_HARD'], difficulty), doc_id) as r from e where difficulty not in ('UNKNOWN_DIFFICULTY', 'OTHER')),
u as (select doc_id, row_number() over (order by doc_id) - 1 as i from e where difficulty = 'UNKNOWN_DIFFICULTY'),
n as (select (select count(*) from k) as known, (select count(*) from u) as unknown),
grown as (select cast(0 as bigint) as i, coalesce((select list(doc_id order by r) from k), []) as rows
  union all select g.i + 1, rows[1:g.i * ((known + g.i) // unknown)] || [u.doc_id] || rows[g.i * ((known + g.i) // unknown) + 1:] from grown g join u on u.i = g.i, n),
last as (select arg_max(rows, i) as rows from grown)
select doc_id, difficulty, cast(list_position(rows, doc_id) - 1 as bigint) as position from e, last where difficulty <> 'OTHER'"""
)
def rl_prompts_curriculum(spark, d):
    kinds = F.array(*map(F.lit, [*P.ORDER, "UNKNOWN_DIFFICULTY", "OTHER"]))
    out = P.prompt_rows(_problems(spark, d, F.get(kinds, (F.col("doc_id") % 7).cast("int"))), 300)
    return out.select(F.col("solutions").alias("doc_id"), "difficulty", F.col("position").cast("long").alias("position"))


@query("select conv_id, turn, len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) as lengths from conversations where len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) <= 20")
def token_filtered(spark, d):
    c = X.table(spark, d, "conversations").withColumn("prompt", F.col("text"))
    return P.token_rows(c, text.word_tokens, 20).select("conv_id", "turn", F.col("lengths").cast("long").alias("lengths"))
