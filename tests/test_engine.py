"""Micro-fixtures of the metric, curation and text operators, and every query against DuckDB."""

from __future__ import annotations

import itertools
import json
import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera import fixtures
from tessera.functions import pyudfs, scoring, text
from tessera.operators import joins, metrics, selection
from tessera.plans import catalog, evaluate, pipelines
from tessera.sources import results
from tessera.streaming import events, running

SF = "/root/testdata/sf0.01"


def attempts(spark, items):
    """items: {item: [(score, passing, public, label)]}"""
    rows = [(i, k + 1, float(s), int(p), int(u), int(x), f"c{k}", "out", -float(s), 2) for i, xs in items.items() for k, (s, p, u, x) in enumerate(xs)]
    return spark.createDataFrame(rows, "item string, idx int, score double, passing int, passing_public int, label int, code string, output string, cumulative_logprob double, num_tokens int")


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("v")).first()["v"]


# metrics


@pytest.mark.parametrize(("n", "c", "k", "want"), [(4, 0, 2, 0.0), (4, 1, 2, 0.5), (4, 1, 3, 0.75), (4, 2, 3, 1.0), (5, 2, 1, 0.4)])
def test_pass_at_k(spark, n, c, k, want):
    assert math.isclose(one(spark, scoring.pass_at_k("n", "c", k), n=n, c=c), want)
    assert math.isclose(want, 1 - math.comb(n - c, k) / math.comb(n, k))


@pytest.mark.parametrize(("n", "k"), [(0, 0), (1, 1), (5, 2), (40, 20), (1000, 3), (100_000, 50_000)])
def test_log_binomial(spark, n, k):
    want = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    assert math.isclose(one(spark, scoring.log_binomial("n", "k"), n=n, k=k), want, rel_tol=1e-10, abs_tol=1e-9)
    assert one(spark, scoring.log_binomial("n", "k"), n=n, k=n + 1) is None
    assert math.isclose(one(spark, scoring.pass_at_k("n", "c", 1), n=10**12, c=10**11), 0.1)


def test_pass_at_k_grows_with_k(spark):
    rows = spark.range(1, 13).withColumnRenamed("id", "k").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn("v", scoring.pass_at_k(F.lit(12), "c", "k")).collect()
    for c in range(13):
        by_k = [r.v for r in sorted((r for r in rows if r.c == c), key=lambda r: r.k)]
        assert by_k == sorted(by_k) and (by_k[-1] == 1.0) == (c > 0)


def test_stderr(spark):
    a = attempts(spark, {"a": [(1, 1, 1, 1), (1, 0, 1, 1)], "b": [(1, 1, 1, 1), (1, 1, 1, 1)]})
    r = metrics.pass_one_stderr(a).first()
    assert math.isclose(r.pass_one, 75.0) and math.isclose(r.stderr, 0.25 / math.sqrt(2) * 100)


def test_permutations():
    assert [scoring.permutations_for(n, 100) for n in (None, 75, 1)] == [25, 26, 100]


def test_reranking(spark):
    a = attempts(spark, {"a": [(0.9, 0, 0, 1), (0.8, 1, 0, 1)]})
    assert [metrics.reranked_accuracy(a, k).first()[0] for k in (1, 2)] == [0.0, 100.0]
    assert metrics.reranked_accuracy(a, 2, public_only=True).first()[0] == 0.0
    b = attempts(spark, {"a": [(0.1, 1, 0, 1), (0.2, 0, 1, 1)]})
    assert metrics.public_accuracy(b, 2, 1).first()[0] == 0.0


def test_expected_reranking_against_all_draws(spark):
    draw, items = random.Random(1), {}
    for i in range(8):
        items[str(i)] = [(draw.random(), draw.random() < 0.4, 0, 0) for _ in range(6)]
    a = attempts(spark, items)
    got = {(r.k, r.n): r.accuracy for r in metrics.expected_grid(a, [1, 2, 3], [2, 4, 6]).collect()}
    best = {r.n: r.accuracy for r in metrics.expected_best_of_n(a, [2, 4, 6]).collect()}
    for (k, n), value in got.items():
        hits = [any(p for _, p, *_ in sorted(s, reverse=True)[:k]) for xs in items.values() for s in itertools.combinations(xs, n)]
        assert math.isclose(value, 100 * sum(hits) / len(hits), abs_tol=1e-9)
        assert k > 1 or math.isclose(value, best[n], abs_tol=1e-9)
    assert math.isclose(one(spark, scoring.draw_weight("r", F.lit(3), F.lit(2)), r=2), 1 / 3)


def test_confusion(spark):
    rows = [(1, 1, 0.95, 0.05), (1, 0, 0.92, 0.08), (0, 0, 0.2, 0.8), (0, 1, 0.3, 0.7)]
    frame = spark.createDataFrame(rows, "label int, passing int, positive_score double, negative_score double")
    r = metrics.confusion(frame).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.accuracy, r.precision, r.recall, r.f1) == (25, 25, 25, 25, 50, 50, 50, 50) and (r.tp_unsure, r.fp_oversure) == (0, 100)
    assert metrics.confusion(frame.where("not (label = 1 and passing = 0)")).first().fp_oversure is None


def test_label_ties(spark):
    assert one(spark, scoring.label_at_least("a", "b"), a=0.5, b=0.5) == 1 and one(spark, scoring.label_above("a", "b"), a=0.5, b=0.5) is False


def test_best_or_first(spark):
    a = attempts(spark, {"a": [(0.1, 1, 0, 0), (0.9, 0, 0, 0)], "b": [(0.1, 1, 0, 1), (0.5, 0, 0, 1), (0.5, 1, 0, 1)]})
    assert {r.item: (r.idx, r.guess, r.passing) for r in metrics.best_or_first(a).collect()} == {"a": (1, 1, 1), "b": (2, 0, 0)}


# selection and joins


def test_pairs(spark):
    a = attempts(spark, {"x": [(0.5, 0, 0, 0), (0.9, 1, 0, 0), (0.9, 1, 0, 0), (0.5, 0, 0, 0)], "one": [(0.5, 1, 0, 0)]})
    assert [tuple(r)[:3] for r in selection.best_and_worst(a).collect()] == [("x", "c2", "c3")]
    assert {r.item: (r.chosen, r.rejected) for r in selection.last_pass_and_fail(a).collect()} == {"x": ("c2", "c3"), "one": ("c0", None)}
    two = selection.two_distinct(a).collect()
    assert len(two) == 1 and two[0].chosen != two[0].rejected
    other = selection.best_and_other(a).collect()
    assert len(other) == 1 and other[0].chosen == "c2" != other[0].rejected


def test_dedup(spark):
    q = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "i int, q string")
    assert sorted(r.i for r in selection.first_wins(q, "q", "i").collect()) == [0, 1]
    assert {(r.q, r.i, r.position) for r in selection.last_wins(q.withColumn("j", F.col("i")), "q", "i").collect()} == {("x", 2, 0), ("y", 1, 1)}


def test_merge(spark):
    s = spark.createDataFrame([(0, "x", ["s1"])], "row_idx int, question string, solutions array<string>")
    n = spark.createDataFrame([(0, "x", ["n1"]), (1, "y", ["n2"])], "row_idx int, question string, solutions array<string>")
    assert {r.question: (r.solutions, r.natural_only) for r in pipelines.merged(s, n).collect()} == {"x": (["s1", "n1"], 0), "y": (["n2"], 1)}


@pytest.mark.parametrize(("passes", "fails", "want"), [(1, 0, (0, 0)), (2, 0, (1, 0)), (3, 1, (1, 1)), (5, 4, (3, 3))])
def test_balance(spark, passes, fails, want):
    a = attempts(spark, {"a": [(0, 1, 0, 0)] * passes + [(0, 0, 0, 0)] * fails})
    got = Counter(r.passing for r in selection.balanced_by_item(a, 3).collect())
    assert (got[1], got[0]) == want


def test_first_successes(spark):
    a = attempts(spark, {"a": [(0, p, 0, 0) for p in (1, 0, 1, 1)]})
    assert [[r.idx for r in selection.first_successes(a, 2, t).orderBy("idx").collect()] for t in (100, 2)] == [[1, 3], [1]]


def test_shortest_quarter_and_shards_and_slices(spark):
    rows = spark.createDataFrame([("a", i, i) for i in range(1, 6)], "item string, idx int, size int")
    assert sorted(r.size for r in selection.without_shortest_quarter(rows, "size").collect()) == [2, 3, 4, 5]
    assert [tuple(r) for r in selection.shard_ranges(spark, 10, 4).orderBy("shard").collect()] == [(0, 0, 2), (1, 2, 2), (2, 4, 2), (3, 6, 4)]
    assert selection.row_slice(rows, "idx", 2, None).count() == 5 and selection.row_slice(rows, "idx", 2, 2).count() == 2


def test_curriculum(spark):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(["HARD", "EASY", "U", "HARD", "EASY", "U", "OTHER"])], "i int, d string")
    got = [r.d + str(r.i) for r in selection.curriculum(rows, "d", ["EASY", "HARD"], "U", "i").orderBy("position").collect()]
    assert got == ["U2", "EASY1", "U5", "EASY4", "HARD0", "HARD3"]
    even = selection.interleaved(rows, "d", ["EASY", "HARD"], "U", 1, "i").orderBy("position").collect()
    assert [r.d for r in even if r.d != "U"] == ["EASY", "EASY", "HARD", "HARD"] and len(even) == 6


@pytest.mark.parametrize("n", [0, 1, 17, 99, 200])
def test_large_samples_are_those_of_the_limit(spark, monkeypatch, n):
    rows = spark.createDataFrame([(i // 2, i % 2) for i in range(100)], "k long, label int")
    want = sorted(tuple(r) for r in rows.orderBy(selection.hash_order(7, "k"), "k").limit(n - n % 2).collect())
    monkeypatch.setattr(selection, "FEW_ROWS", -1)
    assert sorted(tuple(r) for r in selection.hash_sample(rows, n - n % 2, 7, "k").collect()) == want
    distinct = rows.groupBy("k").agg(F.expr("cast(k % 3 = 0 as int)").alias("label")) if n else rows.limit(0)
    even = selection.balanced(distinct, "label", "k", 3)
    assert even.where("label = 1").count() == even.where("label = 0").count() == (17 if n else 0)


def test_merge_back_and_redo(spark):
    a = attempts(spark, {"a": [(0, 0, 0, 0), (0, 0, 0, 0)]}).withColumn("code", F.lit("same"))
    new = a.withColumn("passing", (F.col("idx") == 2).cast("int"))
    assert [r.passing for r in joins.merge_back(a, new, ["passing"]).collect()] == [1, 1]
    with pytest.raises(ValueError):
        joins.redo_selection(a, "other", F.lit(""))


def test_attempts_are_all_events(spark, tmp_path):
    import duckdb

    rows = [(i, 7 if i % 3 == 0 else i % 5, "purchase" if i % 4 == 0 else "view", float(i % 100), '{"k": 1}') for i in range(300)]  # item 7: a third of all
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    want = Counter(r[1] for r in rows)
    assert {r.item: r["count"] for r in fixtures.attempts(spark, str(tmp_path)).groupBy("item").count().collect()} == want
    for name, sf in (("events", f"{tmp_path}/events.parquet/*.parquet"), ("whole", f"{SF}/events.parquet")):
        con = duckdb.connect()
        con.execute(f"create view events as select * from '{sf}'")
        assert con.execute(f"with {fixtures.ATTEMPTS_SQL} select count(*) from attempts").fetchone() == con.execute("select count(*) from events").fetchone(), name
    assert fixtures.attempts(spark, SF).count() == 10_000


def test_pass_one_of_unequal_items(spark):
    def brute(items):
        rates = [sum(x) / len(x) for x in items]
        off = [sum((x[j] - p) / len(x) for x, p in zip(items, rates, strict=True) if j < len(x)) / len(items) for j in range(max(map(len, items)))]
        return sum(rates) / len(items) * 100, math.sqrt(sum(d * d for d in off)) * 100

    draw = random.Random(5)
    for sizes in ([4, 4, 4], [1, 9, 3, 40], [2, 60]):
        items = [[draw.randrange(2) for _ in range(n)] for n in sizes]
        got = metrics.pass_one_by_item(attempts(spark, {str(i): [(0, p, 0, 0) for p in x] for i, x in enumerate(items)})).first()
        assert got[:] == pytest.approx(brute(items))
        assert got.pass_one == pytest.approx(metrics.pass_at_k_mean(attempts(spark, {str(i): [(0, p, 0, 0) for p in x] for i, x in enumerate(items)}), 1).first().pass_at_k)
        if len(set(sizes)) == 1:
            means = [sum(c) / len(items) for c in zip(*items, strict=True)]
            m = sum(means) / len(means)
            assert got.stderr == pytest.approx(math.sqrt(sum((x - m) ** 2 for x in means)) / len(means) * 100)


@pytest.mark.parametrize(("known", "unknowns"), [(0, 5), (5, 0), (3, 8), (8, 3), (7, 7), (40, 11), (11, 40), (100, 1), (1, 30), (60, 20)])
def test_curriculum_against_insertion(spark, known, unknowns):
    draw = random.Random(known)
    kinds = [draw.choice(["B", "A"]) for _ in range(known)] + ["U"] * unknowns + ["OTHER"] * 3
    draw.shuffle(kinds)
    rows = list(enumerate(kinds))
    want = [r for g in "AB" for r in rows if r[1] == g]
    loose = [r for r in rows if r[1] == "U"]
    for i, r in enumerate(loose):
        want.insert(i * (len(want) // len(loose)), r)
    got = selection.curriculum(spark.createDataFrame(rows, "i int, d string"), "d", ["A", "B"], "U", "i").orderBy("position").collect()
    assert [(r.i, r.d) for r in got] == want and [r.position for r in got] == list(range(known + unknowns))


def test_curriculum_takes_all_orders(spark):
    assert entry.queries()["curriculum_rows"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_dedup_then_filter_takes_all_orders(spark):
    orders = Counter(r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").collect())
    first = {}
    for c in sorted(orders):
        first.setdefault(f"q {c % 40}", c)
    want = {(c, q, orders[c]) for q, c in first.items() if orders[c] >= 2}
    assert {tuple(r) for r in entry.queries()["dedup_then_filter"](spark, SF).collect()} == want


def test_no_rows_left_out(spark):
    q = entry.queries()
    talks = {(r.conv_id, r.turn) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    assert {(r.conv_id, r.turn) for r in q["sanitised_names"](spark, SF).collect()} == talks
    orders = {r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    assert Counter(r.o_orderkey for r in q["union_parts"](spark, SF).collect()) == Counter({o: 2 if o % 6 == 0 else 1 for o in orders})
    cells, at = {}, Counter()
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: r.event_id):
        at[r.user_id] += 1
        cells.setdefault((at[r.user_id] % 4, at[r.user_id] // 10 % 4), []).append(r.value)
    got = {(r["k"], int(c[1:])): r[c] for r in q["pivot_grid"](spark, SF).collect() for c in r.__fields__ if c != "k" and r[c] is not None}
    assert got == pytest.approx({c: sum(v) / len(v) for c, v in cells.items()}, abs=2e-5)


# text


def test_time_limits_and_error_kinds(spark):
    for limit, want in ((None, 30), ("2.0 seconds", 6), ("1 - 3 seconds", 8), ("1.5 s", 4), ("odd", 30)):
        assert one(spark, scoring.time_limit(F.lit(limit).cast("string"))) == want
    for output, want in (("Timeout", "Timeout"), ("[0] expected 'a' but got 'b'", "Failed"), ("AssertionError", "Failed"), ("Failed to execute program: x", "Error"), ("boom", "Exception")):
        assert one(spark, scoring.error_kind(F.lit(output))) == want


@pytest.mark.parametrize(("a", "b", "want"), [("1.00001", "1.0", True), ("YES\n", "yes", True), ("a\n\nb", "a\nb", True), ("1", "2", False), ("x", "y", False), ("nan", "1", False), (" 1 \n2", "1\r\n2", True), ("", "", True), ("a\nb", "a", False)])
def test_same_output(spark, a, b, want):
    assert one(spark, text.same_output("a", "b"), a=a, b=b) is want


def test_code_text(spark):
    steps = "# a\n# b\nx\n# c\ny"
    assert one(spark, text.reasoning_steps("c"), c=steps) == ["a b", "c"]
    assert [tuple(r) for r in one(spark, text.reasoning_step_ranges("c"), c=steps)] == [("a b", 2, 2), ("c", 4, 4)]
    assert [tuple(r) for r in one(spark, text.reasoning_step_ranges("c"), c="x\n# z")] == [("z", 2, 2)]
    assert pyudfs.leading_comments('x = "#" # c') == '# c\nx = "#"'
    assert [one(spark, text.code_block("a"), a=a) for a in ("t\n```py\na\n```\nz", "```\na", "none")] == ["a\n", "a\n", ""]
    assert one(spark, text.docstring_prompt("q", F.lit("")), q='a"""b') == '"""\na\\"""b\n"""'
    assert one(spark, text.sanitised_name("n", F.lit(3)), n="a b/c") == "a_b_c"
    assert one(spark, text.line_count("t"), t="a\nb\n") == 3
    assert one(spark, text.strip_comments("t"), t="a # b\nc") == "a \nc"
    prompt, response = text.prompt_and_response("t")
    assert (one(spark, prompt, t='"""q"""\ncode'), one(spark, response, t='"""q"""\ncode')) == ('"""q"""', "\ncode")
    yes, why = text.verdict("t")
    assert (one(spark, yes, t="Yes.\n\nbecause"), one(spark, why, t="Yes.\n\nbecause"), one(spark, yes, t="Yes")) == (True, "because", None)
    assert one(spark, text.rewritten_exit("t"), t="sys.exit(0)\nquit()") == "return\nreturn"
    assert one(spark, text.stdin_harness("t"), t="from os import *\nprint(1)") == "import io\nimport sys\nfrom os import *\ndef __run_prog__():\n    \n    print(1)"
    assert one(spark, text.chat_template("t"), t=[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]) in ("ab",)
    with pytest.raises(Exception, match="system"):
        one(spark, text.chat_template(F.array(F.struct(F.lit("system").alias("role"), F.lit("x").alias("content")))))
    shots = one(spark, text.few_shot_chat([("q1", "a1")], "q", F.lit("def f():"), system="s"), q="q2")
    assert [t["role"] for t in shots] == ["system", "user", "system", "user"] and shots[-1]["content"].endswith("```python\ndef f():\n```")


def test_python_functions():
    assert pyudfs.bullets_on_top("# one.\n# two\ndef f():\n    # three\n    return 1") == "# - one, two\n#     - three\ndef f():\n    return 1"
    assert pyudfs.bullets_after_docstring('"""q"""\n# s\nx') == '"""q"""\n# - s\n\nx'
    assert pyudfs.spaces_for_tabs("if x:\n\ty") == "if x:\n    y" and pyudfs.spaces_for_tabs("if:\t", "") == "if:\t"
    assert pyudfs.equal_values([1, {"a": 2.00001}], [1, {"a": 2}]) and not pyudfs.equal_values(float("nan"), float("nan")) and not pyudfs.equal_values([1], [1, 2])
    assert json.loads(pyudfs.patched_tests('{"fn_name": "f", "inputs": [1, [2]], "outputs": [[3], [4]]}')) == {"fn_name": "f", "inputs": [[1], [2]], "outputs": [3, 4]}
    assert json.loads(pyudfs.patched_tests('{"inputs": [["a", 1], "b"], "outputs": []}'))["inputs"] == ["a\n1", "b"]
    assert pyudfs.same_tree("x=1 # c", "x = 1") and not pyudfs.same_tree("x=1", "x=2") and not pyudfs.same_tree("x=", "x=")
    assert pyudfs.changed_step("a\nb\nc", "a\nX\nc", [(0, 0), (2, 2)]) == (0, 0)
    code = "def f(x):\n    if x > 1 and x < 9:\n        return x + 1\n    return [y for y in x if y]\n"
    seen = {pyudfs.mutate(code, s) for s in range(80)}
    assert len(seen) > 8 and code not in seen and all(map(pyudfs.parses, seen)) and pyudfs.mutate("x =") == "x ="
    import base64
    import zlib

    assert pyudfs.decoded_blob(base64.b64encode(zlib.compress(b'{"a": 1}')).decode()) == '{"a": 1}' and pyudfs.decoded_blob("!!") is None
    assert pyudfs.mean_pairwise_bleu(["a b c d e", "a b c d e"]) == pytest.approx(1.0) and pyudfs.mean_pairwise_bleu(["a"]) is None


# sources, data sets, evaluation, streaming


def test_documents_round_trip(spark, tmp_path):
    item = {"unique_name": "a", "prompt": "p", "starter_code": "", "difficulty": "EASY", "results": [{"code": "x", "cumulative_logprob": -1.0, "num_tokens": 2, "passing": True, "output": ""}, {"code": "y", "cumulative_logprob": -2.0, "num_tokens": 3, "passing": False, "output": "boom", "orm_label": 1}]}
    items = spark.read.schema(results.ITEM).json(spark.sparkContext.parallelize([json.dumps(item)]))
    results.write_document(items, {"model": "m", "temperature": 0.8}, str(tmp_path / "run_2" / "checkpoint-30_x.json"))
    got = results.read_attempts(spark, str(tmp_path / "run_2" / "checkpoint-30_x.json"))
    assert sorted((r.item, r.idx, r.code, r.passing, r.orm_label, r.passing_public) for r in got.collect()) == [("a", 1, "x", True, None, None), ("a", 2, "y", False, 1, None)]
    back = results.to_items(got, ["code", "passing"]).first()
    assert [(r.code, r.passing) for r in back.results] == [("x", True), ("y", False)]
    results.write_items(items, str(tmp_path / "p"), "datasets")
    assert results.read_attempts(spark, str(tmp_path / "p")).count() == 2
    results.write_items(items, str(tmp_path / "j"))
    assert len(list(Path(tmp_path / "j").glob("*.gz"))) >= 1
    with pytest.raises(ValueError):
        results.write_items(items, str(tmp_path / "q"), "other")
    results.write_by_key(got.select("item", "code", "difficulty"), str(tmp_path / "k"))
    assert (tmp_path / "k" / "difficulty=EASY").is_dir()
    for b in (0, 1, 1):
        results.append_batch(got.select("item", "idx"), str(tmp_path / "b"), b)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 4
    runs = results.read_runs(spark, str(tmp_path / "run_2"), "*.gz")
    assert runs.select("checkpoint", "run").first()[:] == (30, 2)
    assert results.resolve(spark, "nowhere", str(tmp_path)) == f"{tmp_path}/nowhere"
    assert results.read_attempts(spark, str(tmp_path / "no.json.gz")) is None
    chunked = results.read_chunks(spark, str(tmp_path / "b"))
    assert chunked.count() == 4
    results.write_report(metrics.item_counts(got), str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 1


def test_test_files_and_traces(spark, tmp_path):
    folder = tmp_path / "problem"
    folder.mkdir()
    for name, body in (("1.in", "a\n"), ("1.out", "b\n"), ("I.2", "c"), ("O.2", "d")):
        (folder / name).write_text(body)
    assert sorted(tuple(r) for r in results.read_test_pairs(spark, str(tmp_path)).collect()) == [("problem", 1, "a\n", "b\n"), ("problem", 2, "c", "d")]
    (folder / "3.in").write_text("x")
    with pytest.raises(Exception, match="not two files"):
        results.read_test_pairs(spark, str(tmp_path)).collect()
    (tmp_path / "trace.txt").write_text("1 2  3\n2\n")
    assert sorted(r.token for r in results.read_trace(spark, str(tmp_path / "trace.txt")).collect()) == [1, 2, 2, 3]


def test_data_sets(spark):
    tests = json.dumps({"inputs": ["1"] * 10, "outputs": ["2"] * 10})
    rows = [(0, "q", ["a\nb\nc\nd\ne", "x =\n\n\n\n"], tests, "EASY", ""), (1, "q", ["a"], tests, "HARD", ""), (2, "r", ["a"], "{}", "EASY", "s")]
    problems = spark.createDataFrame(rows, "row_idx int, question string, solutions array<string>, input_output string, difficulty string, starter_code string")
    kept, left = pipelines.clean_problems(problems)
    assert [(r.row_idx, r.solutions) for r in kept.collect()] == [(0, ["a\nb\nc\nd\ne"])] and [r.row_idx for r in left.collect()] == [1]
    prompts = pipelines.prompt_rows(problems, 100, 10).collect()
    assert [(r.prompt, r.difficulty) for r in prompts] == [('"""\nq\n"""\n', "EASY")]
    train = problems.withColumn("item", F.col("row_idx"))
    assert pipelines.training_rows(train, "all").count() == 4 and pipelines.training_rows(train, "random").count() == 3 and pipelines.training_rows(train, "high_loc").count() == 3
    assert pipelines.training_rows(train, "clip", 1, split_response=True).columns == ["item", "idx", "prompt", "response"]
    raw = spark.createDataFrame([('[{"input": "1\\n2", "output": "3"}]', None, '{"func_name": "f"}'), ('[{"input": "1", "output": "3"}]', '[{"input": "0", "output": "9"}]', None)], "public_test_cases string, private_test_cases string, metadata string")
    specs = [(json.loads(r.input_output), json.loads(r.public_input_output)) for r in pipelines.raw_benchmark_problems(raw).collect()]
    assert specs[0] == ({"inputs": [[1, 2]], "outputs": [3], "fn_name": "f"},) * 2
    assert specs[1] == ({"inputs": ["0", "1"], "outputs": ["9", "3"]}, {"inputs": ["1"], "outputs": ["3"]})
    code = spark.createDataFrame([("i", 1, "# add\nx = 1 + 2"), ("j", 1, "x = 1 + 2")], "item string, idx int, code string")
    out = pipelines.mutated_rows(code, lambda jobs: jobs.withColumn("passing", F.lit(False))).collect()
    assert sorted((r.item, r.score) for r in out) == [("i", 0), ("i", 1), ("j", 1)]  # no step of j is hit
    assert [tuple(r.mutation_step) for r in out if r.score == 0] == [(1, 1)]
    short = spark.createDataFrame([(1, "pot"), (2, "a b"), (3, "x hello y"), (4, "hello"), (5, None)], "id int, t string")
    listed = spark.createDataFrame([("o",), ("b",), ("x hell",), ("x hello y",), (None,)], "p string")
    docs = spark.createDataFrame([(1, "zxx hello yy"), (2, "pot"), (2, "pot"), (3, "qqq"), (4, None), (5, "")], "id int, t string")
    assert sorted(r.id for r in joins.contains_any(docs, listed, "t", "p").collect()) == [1, 2, 2]
    assert joins.contains_any(docs, listed.limit(0), "t", "p").count() == 0 and short.count() == 5


def test_evaluation(spark):
    rows = spark.createDataFrame([(i, f"task {i}", "0123456789" if i % 2 else "", None) for i in range(6)], "row_idx int, q string, t string, s string")
    items = evaluate.bind(rows, "q", "t", "t", "s")
    assert evaluate.repeated_names(items).count() == 0
    done = evaluate.evaluate(items, evaluate.model_factory("base", "m"), 3, public=True).cache()
    assert done.count() == 18 and {(r.row_idx % 2, r.passing, r.passing_public) for r in done.collect()} == {(1, True, True), (0, False, False)}
    assert evaluate.evaluate(items, evaluate.model_factory("base", "m"), 3, start=2, size=2).count() == 6
    again = evaluate.redo(done.select("item", "idx", "code", "starter_code", "tests", "passing", "output"), "failed", lambda c, t: (True, "now"))
    assert again.where("passing").count() == 18
    assert set(evaluate.score(done).columns) >= {"orm_0_score", "orm_1_score", "orm_label"}
    best = evaluate.evolve(items, evaluate.model_factory("evolver", "e"), evaluate.hashed_scorer, 3)
    assert best.count() == 6
    for strategy, kind in (("other", NotImplementedError),):
        with pytest.raises(kind):
            evaluate.evolve(items, evaluate.model_factory("evolver", "e"), evaluate.hashed_scorer, 1, strategy)
    kinds = {k: evaluate.asked(items, evaluate.model_factory(k, "m")).first().asked for k in ("base", "few-shot", "few-shot-cot", "few-shot-chat", "api-chat", "evolver")}
    assert len(set(kinds.values())) == 4 and kinds["base"] == kinds["evolver"] and kinds["few-shot-chat"] == kinds["api-chat"]
    broken = evaluate.execute(done.select("item", "idx", "code", "starter_code", "tests"), lambda c, t: 1 / 0).first()
    assert broken.passing is False and broken.output.startswith("Failed to execute program:")
    with pytest.raises(ValueError):
        evaluate.model_factory("other", "m")


def test_streams(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.event_stream(spark, f"{tmp_path}/in")

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    windows = run(events.tumbling(stream, "1 day", late="400 days"), "complete", "w")
    assert windows.agg(F.sum("n")).first()[0] == 10_000
    assert run(events.distinct_events(stream, late="400 days"), "append", "u").count() == 10_000
    rates = run(running.pass_rates(stream.select("user_id", "ts", (F.col("event_type") == "purchase").cast("int").alias("passing"))), "update", "r")
    last = rates.groupBy("item").agg(F.max("n").alias("n"), F.max("c").alias("c")).agg(F.sum("n"), F.sum("c")).first()
    assert last[0] == 10_000 and last[1] == spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'purchase'").count()


# every query against its SQL


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    import duckdb

    frame = entry.queries()[name](spark, SF)
    order = sorted(frame.columns)
    got = Counter(tuple(norm(r[c]) for c in order) for r in frame.collect())
    if name not in catalog.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in "region customer orders events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    assert got == Counter(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_missing_verdicts_and_scores_give_no_figure(spark):
    rows = spark.createDataFrame([("f", "a", 1, True, 0.5, -1.0, True), ("f", "a", 2, False, 0.9, -2.0, False), ("g", "a", 1, None, 0.1, -1.0, None), ("g", "b", 1, True, None, -1.0, True), ("h", "a", 1, True, None, -1.0, True)], "file string, item string, idx int, passing boolean, score double, cumulative_logprob double, passing_public boolean")
    got = {r.file: r for r in metrics.report(rows, 1, 5, ["file"]).collect()}
    assert (got["f"].pass_at_k, got["f"].rm, got["f"].rm_public, got["f"].ml, got["f"].public) == (50, 0, 100, 100, 100)
    assert (got["g"].pass_at_k, got["g"].rm, got["g"].ml, got["g"].public, got["g"].pass_one) == (None,) * 5
    assert (got["h"].pass_at_k, got["h"].rm, got["h"].ml, got["h"].public) == (100, None, 100, 100)
    assert metrics.reranked_accuracy(rows.where("file = 'h'")).first()[0] is None and metrics.pass_at_k_mean(rows, 1).first()[0] is None
    one = metrics.report(rows.where("file = 'f'"), 1, 5).first()
    assert (one.rm, one.rm_public, one.items) == (0, 100, 1)


def test_token_length_is_the_library_s(spark):
    import public_tokenizers

    length = pyudfs.token_length(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["a plain text", "", None, "é 中文 <|endoftext|>"]
    coder = pyudfs._coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", length("t").alias("n")).collect()
    assert [r.n for r in sorted(got)] == [None if t is None else len(coder.encode_ordinary(t)) for t in texts]


def test_runnable_tests_by_form(spark):
    rows = [(1, "print(input())", '{"inputs": ["a\\n"], "outputs": ["a"]}'), (2, "class Solution:\n    def f(self, x): return x", '{"inputs": [[[1, "q"]]], "outputs": [[1, "q"]], "fn_name": "f"}'), (3, "x = 1", "assert x == 1")]
    made = {r.i: r for r in evaluate.runnable(spark.createDataFrame(rows, "i int, code string, tests string")).collect()}
    for i, outputs in ((1, ["a\n"]), (2, []), (3, [])):  # the texts of these three rows are ours and harmless
        import contextlib
        import io
        import sys

        out, own = io.StringIO(), sys.stdin
        try:
            with contextlib.redirect_stdout(out):
                exec(made[i].program + "\n" + made[i].test, {})
        finally:
            sys.stdin = own
        assert text.END_MARK in out.getvalue() and out.getvalue().split(text.END_MARK)[:-1] == (outputs or [""])
    assert [made[i].kind for i in (1, 2, 3)] == ["stdin", "named", "script"] and made[1].expected == ["a"]
    runs = spark.createDataFrame([("stdin", ["a"], True, "a\n___SENTINEL___\n"), ("stdin", ["a"], True, "b\n___SENTINEL___\n"), ("stdin", ["a", "b"], True, "a\n___SENTINEL___\n"), ("stdin", ["a"], False, "x"), ("script", None, True, "___SENTINEL___"), ("named", None, True, "")], "kind string, expected array<string>, ran boolean, printed string")
    assert [r.passing for r in evaluate.judged(runs).collect()] == [True, False, False, False, True, False]


@pytest.mark.parametrize("size", [4096, 4])
def test_sampled_draws_inside_lists(spark, monkeypatch, size):
    import hashlib

    monkeypatch.setattr(metrics, "DRAWN", size, raising=False)
    rng = random.Random(5)
    items = {f"i{i}": [(rng.randint(0, 3), rng.random() < 0.3, True, True) for _ in range(rng.randint(1, 30))] for i in range(12)}
    frame = metrics.sampled_best_of_n(attempts(spark, items), 5, 2, draws=6, seed=7)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate(keys=[item" in plan  # attempts meet in lists before draws are made
    means = []
    for draw in range(1, 7):
        hits = []
        for item, rows in items.items():
            drawn = sorted(range(len(rows)), key=lambda i: (hashlib.md5(f"7:{draw}:{item}:{i + 1}".encode()).hexdigest(), i))[:5]
            hits.append(max(rows[i][1] for i in sorted(drawn, key=lambda i: -rows[i][0])[:2]))
        means.append(sum(hits) / len(hits) * 100)
    got = frame.first()
    mean = sum(means) / 6
    assert math.isclose(got.accuracy, mean) and math.isclose(got.std, math.sqrt(sum((m - mean) ** 2 for m in means) / 6), abs_tol=1e-9)


def test_distinct_estimate_keeps_no_sketch_a_pair(spark):
    plan = entry.queries()["ext_distinct_estimate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    sketching = [line for line in plan.splitlines() if "approx_count_distinct" in line]
    assert sketching and not [line for line in sketching if "user_id" in line.split("keys=[")[1].split("]")[0]]


def test_blobs_hold_no_code():
    import base64
    import pickle
    import zlib

    packed = lambda v: base64.b64encode(zlib.compress(pickle.dumps(v))).decode()
    assert pyudfs.decoded_blob(packed("[1]")) == "[1]" and pyudfs.decoded_blob(pyudfs.encoded_blob("x")) == "x"
    assert pyudfs.decoded_blob(packed(Path("x"))) is None and pyudfs.decoded_blob(packed(3)) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())
