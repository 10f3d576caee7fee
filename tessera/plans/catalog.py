"""Registered queries of the metric, curation and text operators over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixtures as X
from tessera.fixtures import ATTEMPTS_SQL, JUDGED_SQL
from tessera.functions import pyudfs, scoring, text
from tessera.operators import joins as J
from tessera.operators import metrics as M
from tessera.operators import selection as S
from tessera.plans import pipelines as P
from tessera.plans.lineage import scratch
from tessera.sources import results as R
from tessera.streaming import events as V
from tessera.streaming import running as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return register


A = f"with {ATTEMPTS_SQL}"
_PASS = "case when c = 0 then 0e0 when n - c < k then 1e0 else 1e0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1e0 - k * 1e0 / i)) end"
_ITEMS = "it as (select item, count(*) as n, cast(sum(passing) as bigint) as c from attempts group by item)"


def _pass_sql(k: int) -> str:
    return f"{A}, {_ITEMS}, v as (select *, {k} as k from it) select round(avg({_PASS}) * 100, 6) as pass_at_k, count(*) as items from v"


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(_pass_sql(1))
def pass_at_1(spark, d):
    return _rounded(M.pass_at_k_mean(X.attempts(spark, d), 1), "pass_at_k")


@query(_pass_sql(5))
def pass_at_5(spark, d):
    return _rounded(M.pass_at_k_mean(X.attempts(spark, d), 5), "pass_at_k")


@query(f"{A}, {_ITEMS}, v as (select it.*, k from it, (select unnest(range(1, 41)) as k)) select cast(k as integer) as k, round(avg({_PASS}) * 100, 6) as pass_at_k from v group by k")
def pass_at_k_curve(spark, d):
    return _rounded(M.pass_at_k_curve(X.attempts(spark, d), 40), "pass_at_k")


@query(f"{A}, m as (select idx, avg(passing) as m from attempts group by idx) select round(avg(m) * 100, 6) as pass_one, round(stddev_pop(m) / sqrt(count(*)) * 100, 6) as stderr from m")
def pass_one_stderr(spark, d):
    return _rounded(M.pass_one_stderr(X.attempts(spark, d)), "pass_one", "stderr")


_RANKED = f"{A}, r as (select *, row_number() over (partition by item order by score desc nulls last, idx) as rk, count(*) over (partition by item) as size from attempts)"


@query(f"{_RANKED}, h as (select item, max(case when rk <= 1 then passing else 0 end) as hit from r group by item) select round(avg(hit) * 100, 6) as accuracy from h")
def rm_top1_full(spark, d):
    return _rounded(M.reranked_accuracy(X.attempts(spark, d)), "accuracy")


@query(f"{_RANKED}, h as (select item, k, max(case when rk <= k then passing else 0 end) as hit from r, (select unnest(range(1, 41)) as k) group by item, k) select cast(k as integer) as k, round(avg(hit) * 100, 6) as accuracy from h group by k")
def rm_topk_full(spark, d):
    return _rounded(M.reranked_curve(X.attempts(spark, d), 40), "accuracy")


_LCHOOSE = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


def _lchoose(n: str, k: str) -> str:
    return _LCHOOSE.format(n=n, k=k)


@query(f"{_RANKED}, p as (select item, n, sum(case when passing = 1 and size - rk >= n - 1 then exp({_lchoose('(size - rk)', '(n - 1)')} - {_lchoose('size', 'n')}) else 0 end) as p from r, (select unnest(range(1, 41)) as n) group by item, n) select cast(n as integer) as n, round(avg(p) * 100, 5) as accuracy, round(sqrt(sum(greatest(p * (1 - p), 0))) / count(*) * 100, 5) as std from p group by n")
def rm_at_n_expected(spark, d):
    return _rounded(M.expected_best_of_n(X.attempts(spark, d), list(range(1, 41))), "accuracy", "std", digits=5)


@query(
    f"""{_RANKED}, f as (select *, coalesce(sum(1 - passing) over (partition by item order by rk rows between unbounded preceding and 1 preceding), 0) as f from r),
cells as (select k, n from (select unnest([1, 2, 5]) as k), (select unnest([5, 10, 20, 40]) as n) where k <= n),
m as (select item, k, n, sum(case when passing = 0 and f >= k - 1 and size - rk >= n - k then exp({_lchoose('f', '(k - 1)')} + {_lchoose('(size - rk)', '(n - k)')} - {_lchoose('size', 'n')}) else 0 end) as missed from f, cells group by item, k, n)
select k, n, round(avg(1 - missed) * 100, 5) as accuracy from m group by k, n"""
)
def rm_kn_grid(spark, d):
    return _rounded(M.expected_grid(X.attempts(spark, d), [1, 2, 5], [5, 10, 20, 40]), "accuracy", digits=5)


@query(
    f"""{A}, r as (select item, score, passing, draw, row_number() over (partition by item, draw order by md5('42:' || draw || ':' || item || ':' || idx), idx) as o from attempts, (select unnest(range(1, 77)) as draw)),
h as (select draw, item, max(row(case when score is null then 0 else 1 end, score, -o, passing))[4] as hit from r where o <= 10 group by draw, item), m as (select draw, avg(hit) as m from h group by draw)
select round(avg(m) * 100, 6) as accuracy, round(stddev_pop(m) * 100, 6) as std from m"""
)
def rm_sampled(spark, d):
    return _rounded(M.sampled_best_of_n(X.attempts(spark, d), 10, 1, scoring.permutations_for(10, 40)), "accuracy", "std")


@query(f"{A}, r as (select item, passing, row_number() over (partition by item order by score desc nulls last, idx) as rk from attempts where passing_public = 1), i as (select distinct item from attempts), h as (select i.item, coalesce(max(case when rk <= 1 then passing else 0 end), 0) as hit from i left join r using (item) group by 1) select round(avg(hit) * 100, 6) as accuracy from h")
def rm_plus_public(spark, d):
    return _rounded(M.reranked_accuracy(X.attempts(spark, d), public_only=True), "accuracy")


@query(f"{A}, r as (select item, passing, row_number() over (partition by item order by passing_public desc, idx) as rk from attempts where idx <= 10), h as (select item, max(case when rk <= 2 then passing else 0 end) as hit, count(*) as w from r group by item) select round(sum(hit * w) / sum(w) * 100, 6) as accuracy from h")
def public_at_n(spark, d):
    return _rounded(M.public_accuracy(X.attempts(spark, d), 10, 2), "accuracy")


@query(f"{A}, r as (select item, passing, row_number() over (partition by item order by cumulative_logprob desc nulls last, idx) as rk from attempts), h as (select item, max(case when rk <= 1 then passing else 0 end) as hit from r group by item) select round(avg(hit) * 100, 6) as accuracy from h")
def ml_acc(spark, d):
    return _rounded(M.reranked_accuracy(X.attempts(spark, d), 1, "cumulative_logprob"), "accuracy")


@query(f"{A}, s as (select *, score * exp(case when num_tokens = 0 then null else cumulative_logprob / num_tokens end) as s1, score * exp(cumulative_logprob) as s2 from attempts), h as (select item, max(s1) as s1, max(s2) as s2 from s group by item) select round(avg(s1), 6) as normalized, round(avg(s2), 6) as unnormalized from h")
def shaped_scores(spark, d):
    a = X.attempts(spark, d)
    s1, s2 = (scoring.shaped_score("score", "cumulative_logprob", "num_tokens", x) for x in ("normalized", "unnormalized"))
    best = a.groupBy("item").agg(F.max(s1).alias("a"), F.max(s2).alias("b"))
    return _rounded(best.agg(F.avg("a").alias("normalized"), F.avg("b").alias("unnormalized")), "normalized", "unnormalized")


def _acc(score: str, where: str = "true", k: int = 1) -> str:
    return f"(select round(avg(coalesce(hit, 0)) * 100, 6) from (select distinct item from attempts) i left join (select item, max(passing) as hit from (select item, passing, row_number() over (partition by item order by {score} desc nulls last, idx) as rk from attempts where {where}) where rk <= {k} group by item) h using (item))"


@query(
    f"""{A}, {_ITEMS}, m as (select idx, avg(passing) as m from attempts group by idx), v as (select *, 1 as k from it),
pub as (select item, max(case when rk <= 1 then passing else 0 end) as hit, count(*) as w from (select item, passing, row_number() over (partition by item order by passing_public desc, idx) as rk from attempts where idx <= 20) group by item)
select (select round(avg({_PASS}) * 100, 6) from v) as pass_at_k, (select count(*) from it) as items, (select round(avg(m) * 100, 6) from m) as pass_one,
  (select round(stddev_pop(m) / sqrt(count(*)) * 100, 6) from m) as stderr, {_acc('score')} as rm, {_acc('score', 'passing_public = 1')} as rm_public, {_acc('cumulative_logprob')} as ml,
  (select round(sum(hit * w) / sum(w) * 100, 6) from pub) as public"""
)
def report_row(spark, d):
    return _rounded(M.report(X.attempts(spark, d), 1, 20), "pass_at_k", "pass_one", "stderr", "rm", "rm_public", "ml", "public")


@query(
    f"""{A}, j as (select label, passing, score / 100 as p, 1 - score / 100 as q from attempts),
c as (select count(*) as size, sum(cast(label = 1 and passing = 1 as integer)) as tp, sum(cast(label = 1 and passing = 0 as integer)) as fp, sum(cast(label = 0 and passing = 0 as integer)) as tn, sum(cast(label = 0 and passing = 1 as integer)) as fn,
  sum(cast(label = 1 and passing = 1 and p < 0.9 as integer)) as unsure, sum(cast(label = 1 and passing = 0 and p >= 0.9 as integer)) as oversure,
  avg(p) filter (where label = 1 and passing = 1) as tp_score, avg(p) filter (where label = 1 and passing = 0) as fp_score, avg(q) filter (where label = 0 and passing = 0) as tn_score, avg(q) filter (where label = 0 and passing = 1) as fn_score from j),
s as (select *, tp * 1e2 / nullif(tp + fp, 0) as pr, tp * 1e2 / nullif(tp + fn, 0) as re from c)
select round(tp * 1e2 / size, 6) as tp, round(fp * 1e2 / size, 6) as fp, round(tn * 1e2 / size, 6) as tn, round(fn * 1e2 / size, 6) as fn, round(tp_score, 6) as tp_score, round(fp_score, 6) as fp_score, round(tn_score, 6) as tn_score, round(fn_score, 6) as fn_score,
  round(unsure * 1e2 / nullif(tp, 0), 6) as tp_unsure, round(oversure * 1e2 / nullif(fp, 0), 6) as fp_oversure, round((tp + tn) * 1e2 / size, 6) as accuracy, round(pr, 6) as precision, round(re, 6) as recall, round(2 * pr * re / nullif(pr + re, 0), 6) as f1 from s"""
)
def confusion_stats(spark, d):
    j = X.attempts(spark, d).select("label", "passing", (F.col("score") / 100).alias("positive_score"), (1 - F.col("score") / 100).alias("negative_score"))
    out = M.confusion(j)
    return _rounded(out, *out.columns)


@query(f"with {JUDGED_SQL} select category, count(*) as n, round(avg(cast(predicted = passing as integer)), 6) as accuracy, round(avg(case when passing = 0 then 1 - predicted end), 6) as tn_rate from judged group by rollup (category)")
def per_category_acc(spark, d):
    return _rounded(M.accuracy_by_category(X.judged(spark, d), "category"), "accuracy", "tn_rate")


_KIND = "case when o like '%Timeout%' then 'Timeout' when (o like '%expected%' and o like '%but got%') or o like '%AssertionError%' then 'Failed' when o like '%Failed to execute program:%' then 'Error' else 'Exception' end"
_OUT = "case output when 'click' then 'Timeout after 2 s' when 'view' then 'expected 1 but got 2' when 'signup' then 'Failed to execute program: x' else output end"


def _verdicts(spark, d):
    o = F.col("output")
    shown = F.when(o == "click", "Timeout after 2 s").when(o == "view", "expected 1 but got 2").when(o == "signup", "Failed to execute program: x").otherwise(o)
    return X.attempts(spark, d).withColumn("output", shown)


@query(f"{A}, v as (select {_OUT} as o from attempts where passing = 0) select {_KIND} as kind, count(*) as n from v group by 1")
def err_kind_hist(spark, d):
    return M.error_histogram(_verdicts(spark, d))


@query("with c as (select lang, count(*) as n from documents group by lang) select o.i as rank, o.l as difficulty, coalesce(c.n, 0) as n from (select unnest(range(0, 5)) as i, unnest(['de', 'en', 'es', 'fr', 'xx']) as l) o left join c on c.lang = o.l")
def difficulty_hist_dense(spark, d):
    domain = spark.createDataFrame(list(enumerate(["de", "en", "es", "fr", "xx"])), "rank long, difficulty string")
    counts = X.problems(spark, d).groupBy("difficulty").agg(F.count("*").alias("n"))
    return domain.join(counts, "difficulty", "left").select("rank", "difficulty", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"{A}, {_ITEMS} select cast(sum(cast(c > 0 as integer)) as bigint) as with_pass, count(*) as items from it")
def items_with_pass(spark, d):
    return M.items_with_pass(X.attempts(spark, d))


@query(f"{A} select round(avg(cast(coalesce(label = passing_public, false) as integer)), 6) as agree, cast(sum(cast(label <> passing_public and passing = 1 as integer)) as bigint) as differ_pass, cast(sum(cast(label <> passing_public and passing = 0 as integer)) as bigint) as differ_fail from attempts")
def agreement_rates(spark, d):
    return _rounded(M.agreement(X.attempts(spark, d), "label", "passing_public"), "agree")


@query(f"{A}, b as (select item, max(row(score, -idx)) filter (where label = 1) as b, min(idx) as f from attempts group by item), c as (select item, coalesce(-b[2], f) as idx, cast(b is null as integer) as guess from b) select c.item, cast(c.idx as integer) as idx, guess, a.passing from c join attempts a on a.item = c.item and a.idx = c.idx")
def best_or_first(spark, d):
    return M.best_or_first(X.attempts(spark, d))


@query("with c as (select conv_id, count(*) as n from conversations group by conv_id) select cast(sum(n) as bigint) as solutions, count(*) as items, round(avg(n), 6) as mean, median(n) as median, round(stddev_samp(n), 6) as std, min(n) as least, max(n) as most from c")
def list_length_stats(spark, d):
    c = X.solutions(spark, d).groupBy("item").agg(F.count("*").alias("n"))
    s = M.summary(c, "n").drop("n")
    return _rounded(c.agg(F.sum("n").alias("solutions"), F.count("*").alias("items")).withColumn("o", F.lit(1)).join(s.withColumn("o", F.lit(1)), "o").drop("o"), "mean", "std")


@query("with v as (select lang, length(text) - length(replace(text, chr(10), '')) + 1 as loc from documents) select lang, count(loc) as n, round(avg(loc), 6) as mean, median(loc) as median, round(stddev_samp(loc), 6) as std, min(loc) as least, max(loc) as most from v group by lang")
def loc_stats(spark, d):
    rows = X.table(spark, d, "documents").select("lang", text.line_count("text").cast("long").alias("loc"))
    return _rounded(M.summary(rows, "loc", ["lang"]), "mean", "std")


@query(f"{A}, b as (select least(cast(floor(score / 10) as integer), 9) as bin, count(*) as n from attempts where score >= 0 and score <= 100 group by 1) select cast(i as integer) as bin, coalesce(n, 0) as n from (select unnest(range(10)) as i) left join b on b.bin = i")
def score_histogram(spark, d):
    return M.histogram(X.attempts(spark, d), "score", 0.0, 100.0, 10)


@query("""select k as key, count(*) as n from (select unnest(json_keys(props)) as k from events) group by k""")
def distinct_keys(spark, d):
    return M.frequency(X.table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")), "key")


@query("with c as (select label, count(*) as n from embeddings group by label) select cast(i as integer) as token, coalesce(n, 0) as n from (select unnest(range(16)) as i) left join c on c.label = i")
def token_frequency_dense(spark, d):
    counts = M.frequency(X.table(spark, d, "embeddings").withColumnRenamed("label", "token"), "token")
    return M.dense(counts, "token", 16)


@query("with q as (select conv_id, text from conversations where turn = 0), s as (select c.conv_id, length(q.text) + length(c.text) as len from conversations c join q using (conv_id) where c.turn > 0) select len // 100 as bucket, count(*) as n from s group by 1")
def combined_length_freq(spark, d):
    s = X.solutions(spark, d)
    return M.combined_lengths(s.where("idx > 0"), s.where("idx = 0"), "item", F.length("code"), F.length("code"), 100)


@query(f"{A}, g as (select idx % 5 as k, idx // 10 as step, avg(score) as v from attempts group by 1, 2) select round(quantile_cont(v, 0.25), 5) as low, round(quantile_cont(v, 0.75), 5) as high from g")
def grid_percentiles(spark, d):
    g = X.attempts(spark, d).groupBy(F.expr("idx % 5").alias("k"), F.expr("idx div 10").alias("step")).agg(F.avg("score").alias("v"))
    return _rounded(g.agg(F.percentile("v", F.lit(0.25)).alias("low"), F.percentile("v", F.lit(0.75)).alias("high")), "low", "high", digits=5)


@query(
    """with t as (select conv_id as item, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as w from conversations),
g as (select item, turn, n, array_to_string(w[i:i + n - 1], ' ') as g, count(*) as c from (select *, unnest(range(1, greatest(len(w) - n + 2, 1))) as i from t, (select unnest([1, 2, 3, 4]) as n)) group by all),
p as (select a.item, a.turn as i, b.turn as j, len(a.w) as la, len(b.w) as lb, n from t a join t b on a.item = b.item and a.turn < b.turn, (select unnest([1, 2, 3, 4]) as n)),
h as (select a.item, a.turn as i, b.turn as j, a.n, sum(least(a.c, b.c)) as hit from g a join g b on a.item = b.item and a.turn < b.turn and a.n = b.n and a.g = b.g group by all),
l as (select p.item, p.i, p.j, any_value(la) as la, any_value(lb) as lb, min(coalesce(hit, 0) + cast(n > 1 as integer)) as least,
  sum(case when coalesce(hit, 0) + cast(n > 1 as integer) > 0 then ln((coalesce(hit, 0) + cast(n > 1 as integer)) * 1e0 / (greatest(la - n + 1, 0) + cast(n > 1 as integer))) / 4 else 0 end) as s
  from p left join h using (item, i, j, n) group by all),
b as (select item, avg(case when la = 0 or lb = 0 or least = 0 then 0 else exp(least(0, 1 - lb * 1e0 / la) + s) end) as bleu from l group by item)
select t.item, round(any_value(b.bleu), 9) as bleu from t left join b using (item) group by t.item"""
)
def pairwise_bleu(spark, d):
    return _rounded(J.mean_pairwise(X.solutions(spark, d), "item", "idx", "code", pyudfs.bleu_sums_udf, "bleu"), "bleu", digits=9)


@query(f"{A}, r as (select *, cast(item % 3 as integer) as series, cast(idx // 10 as bigint) as step from attempts), v as (select series, step, item % 8 as run, avg(passing) as value from r group by 1, 2, 3) select series, step, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(step * 1e2 / max(step) over (partition by series), 6) as percent from v group by series, step")
def checkpoint_mean_std(spark, d):
    r = X.attempts(spark, d).select(F.expr("cast(item % 3 as int)").alias("series"), F.expr("idx div 10").alias("step"), F.expr("item % 8").alias("run"), "passing")
    v = r.groupBy("series", "step", "run").agg(F.avg("passing").alias("value"))
    return _rounded(M.run_spread(v), "mean", "std", "percent")


@query(f"{A}, g as (select idx % 4 as k, idx // 10 % 4 as step, round(avg(score), 5) as v from attempts group by 1, 2) select k, max(v) filter (step = 0) as s0, max(v) filter (step = 1) as s1, max(v) filter (step = 2) as s2, max(v) filter (step = 3) as s3 from g group by k")
def pivot_grid(spark, d):
    g = X.attempts(spark, d).groupBy(F.expr("idx % 4").alias("k"), F.expr("idx div 10 % 4").alias("step")).agg(F.round(F.avg("score"), 5).alias("v"))
    return J.wide(g, "k", "step", "v", [0, 1, 2, 3]).withColumnsRenamed({str(s): f"s{s}" for s in range(4)})


# selection


@query(f"{_RANKED} select item, idx, score, cast(rk as integer) as rk from r where rk <= 3")
def rank_top3(spark, d):
    return M.ranked(X.attempts(spark, d)).where("rk <= 3").select("item", "idx", "score", "rk")


@query(f"{A}, b as (select item, max(row(score, idx)) as b, min(row(score, -idx)) as w from attempts where score between -1 and 1e9 group by item), x as (select item, max(row(score, idx)) filter (where score >= -1) as b, min(row(score, -idx)) filter (where score <= 1) as w from attempts group by item) select x.item, c.code as chosen, r.code as rejected, c.score as chosen_info, r.score as rejected_info from x join attempts c on c.item = x.item and c.idx = x.b[2] join attempts r on r.item = x.item and r.idx = -x.w[2] where x.b[2] <> -x.w[2]")
def best_worst_pairs(spark, d):
    return S.best_and_worst(X.attempts(spark, d))


@query(f"{A}, x as (select item, max(idx) filter (where passing = 1) as p, max(idx) filter (where passing = 0) as f from attempts group by item) select x.item, c.code as chosen, r.code as rejected, c.output as chosen_info, r.output as rejected_info from x left join attempts c on c.item = x.item and c.idx = x.p left join attempts r on r.item = x.item and r.idx = x.f")
def exec_pairs(spark, d):
    return S.last_pass_and_fail(X.attempts(spark, d))


_HASH = "md5(concat_ws(':', '42', cast(item as varchar), cast(idx as varchar)))"


@query(f"{A}, k as (select item, code, min({_HASH}) as h from attempts group by 1, 2), r as (select *, row_number() over (partition by item order by h) as r from k) select item, max(code) filter (where r = 1) as chosen, max(code) filter (where r = 2) as rejected from r where r <= 2 group by item having count(*) = 2")
def two_distinct_pairs(spark, d):
    return S.two_distinct(X.attempts(spark, d))


@query(f"{A}, b as (select item, max(row(score, idx)) as b from attempts group by item), c as (select a.item, a.code, a.score from b join attempts a on a.item = b.item and a.idx = b.b[2]), o as (select a.item, a.code, a.score, row_number() over (partition by a.item order by md5(concat_ws(':', '42', cast(a.item as varchar), cast(a.idx as varchar)))) as r from attempts a join c on a.item = c.item and a.code <> c.code) select c.item, c.code as chosen, o.code as rejected, c.score as chosen_info, o.score as rejected_info from c join o on o.item = c.item where r = 1 and trim(c.code) <> ''")
def best_random_pairs(spark, d):
    return S.best_and_other(X.attempts(spark, d))


@query(f"{A} select item, idx, score from attempts where idx <= 5")
def prefix_limit(spark, d):
    return S.prefix_per_item(X.attempts(spark, d), 5).select("item", "idx", "score")


@query(f"{A}, c as (select *, sum(passing) over (partition by item order by idx rows unbounded preceding) as c from attempts where idx <= 30) select item, idx from c where c <= 3 and passing = 1")
def first_n_success(spark, d):
    return S.first_successes(X.attempts(spark, d), 3, 30).select("item", "idx")


@query("with r as (select conv_id, turn, row_number() over (partition by conv_id order by length(text), turn) as r, count(*) over (partition by conv_id) as n from conversations) select conv_id as item, turn as idx from r where r > n // 4")
def high_loc_candidates(spark, d):
    return S.without_shortest_quarter(X.solutions(spark, d).withColumn("size", F.length("code")), "size").select("item", "idx")


@query("with r as (select conv_id, turn, row_number() over (partition by conv_id order by md5(concat_ws(':', '42', cast(conv_id as varchar), cast(turn as varchar)))) as r from conversations) select conv_id as item, turn as idx from r where r = 1")
def random_pick(spark, d):
    return S.one_per_item(X.solutions(spark, d), 42).select("item", "idx")


@query("select o_orderkey from orders where o_orderkey >= 100 and o_orderkey < 350")
def row_range(spark, d):
    return S.row_slice(X.table(spark, d, "orders"), "o_orderkey", 100, 250).select("o_orderkey")


@query("select doc_id, lang from documents order by doc_id limit 25")
def head_sample(spark, d):
    return S.head(X.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 25)


@query("select doc_id, source from documents order by md5(concat_ws(':', '42', cast(doc_id as varchar))), doc_id limit 50")
def hashed_sample(spark, d):
    return S.hash_sample(X.table(spark, d, "documents").select("doc_id", "source"), 50, 42, "doc_id")


@query("select doc_id, source from documents order by md5(concat_ws(':', '7', cast(doc_id as varchar))), doc_id limit (select cast(floor(count(*) * 0.5) as bigint) from labels)")
def ratio_sampled(spark, d):
    return S.ratio_sample(X.table(spark, d, "documents").select("doc_id", "source"), X.table(spark, d, "labels"), 0.5, 7, "doc_id")


@query("select doc_id, md5(concat_ws(':', '42', cast(doc_id as varchar))) as position from documents")
def hashed_shuffle(spark, d):
    return S.hash_shuffled(X.table(spark, d, "documents").select("doc_id"), 42, "doc_id")


@query("select doc_id // 64 as chunk, count(*) as n from documents group by 1")
def chunkify(spark, d):
    return S.chunks(X.table(spark, d, "documents"), "doc_id", 64).groupBy("chunk").agg(F.count("*").alias("n"))


@query("with t as (select count(*) as n from orders) select s as shard, s * (n // 7) as start, case when s = 6 then n - (n // 7) * 6 else n // 7 end as length from t, (select unnest(range(7)) as s)")
def shard_ranges(spark, d):
    return S.shard_ranges(spark, X.table(spark, d, "orders").count(), 7)


@query(f"{A}, w as (select *, sum(passing) over (partition by item) as p, count(*) over (partition by item) as n, count(*) over (partition by item, passing) as k, row_number() over (partition by item, passing order by idx) as r from attempts) select item, idx, passing from w where r <= greatest(least(p, n - p, 5), case when k > 1 then 1 else 0 end)")
def orm_balanced_by_item(spark, d):
    return S.balanced_by_item(X.attempts(spark, d), 5).select("item", "idx", "passing")


@query(f"{A}, r as (select event_id, passing, row_number() over (partition by passing order by event_id) as r, least(sum(passing) over (), sum(1 - passing) over ()) as m from attempts) select event_id, passing from r where r <= m")
def orm_balanced(spark, d):
    return S.balanced(X.attempts(spark, d).select("event_id", "passing"), "passing", "event_id")


@query("with r as (select doc_id, text, row_number() over (partition by text order by doc_id) as r from documents) select doc_id, md5(text) as question from r where r = 1")
def first_wins_dedup(spark, d):
    rows = S.first_wins(X.problems(spark, d), "question", "id")
    return rows.select(F.col("id").alias("doc_id"), text.md5_hex("question").alias("question"))


@query("select md5(text) as question, max(doc_id) as doc_id, min(doc_id) as position from documents group by text")
def last_wins_dedup(spark, d):
    rows = S.last_wins(X.problems(spark, d).withColumn("doc_id", F.col("id")), "question", "id")
    return rows.select(text.md5_hex("question").alias("question"), "doc_id", "position")


@query("select o_orderkey, o_custkey from orders where o_orderkey % 2 = 0 union all select o_orderkey, o_custkey from orders where o_orderkey % 2 = 1 or o_orderkey % 3 = 0")
def union_parts(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return S.union_all(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1 or o_orderkey % 3 = 0"))


@query(
    """with recursive k as (select o_orderkey, o_orderpriority, row_number() over (order by list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'], o_orderpriority), o_orderkey) as r from orders where o_orderpriority <> '5-LOW'),
u as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders where o_orderpriority = '5-LOW'),
n as (select (select count(*) from k) as known, (select count(*) from u) as unknown),
grown as (select cast(0 as bigint) as i, coalesce((select list(o_orderkey order by r) from k), []) as rows
  union all select g.i + 1, rows[1:g.i * ((known + g.i) // unknown)] || [u.o_orderkey] || rows[g.i * ((known + g.i) // unknown) + 1:] from grown g join u on u.i = g.i, n),
last as (select arg_max(rows, i) as rows from grown)
select o_orderkey, o_orderpriority, cast(list_position(rows, o_orderkey) - 1 as bigint) as position from orders, last"""
)
def curriculum_rows(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    out = S.curriculum(o, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], "5-LOW", "o_orderkey")
    return out.select("o_orderkey", "o_orderpriority", F.col("position").cast("long").alias("position"))


# joins


@query("select md5(text) as question from documents where source < 'src5' intersect select md5(text) from documents where source >= 'src5'")
def contamination_exact(spark, d):
    p = X.problems(spark, d)
    return J.shared_values(p.where("source < 'src5'"), p.where("source >= 'src5'"), "question").select(text.md5_hex("question").alias("question"))


@query("select 'question' as \"column\", (select count(*) from (select text from documents where source < 'src5' intersect select text from documents where source >= 'src5')) as shared union all select 'difficulty', (select count(*) from (select lang from documents where source < 'src5' intersect select lang from documents where source >= 'src5'))")
def contamination_table(spark, d):
    p = X.problems(spark, d)
    return P.contamination(p.where("source < 'src5'"), p.where("source >= 'src5'"), ["question", "difficulty"]).select("column", "shared")


@query("select doc_id from documents d where exists (select 1 from benchmark b where contains(d.text, b.text))")
def contamination_contains(spark, d):
    docs = X.table(spark, d, "documents")
    return J.contains_any(docs, X.table(spark, d, "benchmark").select(F.col("text").alias("phrase")), "text", "phrase").select("doc_id")


@query("select doc_id from documents where source >= 'src5' and text in (select text from documents where source < 'src5')")
def semi_seen(spark, d):
    p = X.problems(spark, d)
    return J.rows_seen_in(p.where("source >= 'src5'"), p.where("source < 'src5'"), "question").select(F.col("id").alias("doc_id"))


@query("select doc_id from documents where source >= 'src5' and text not in (select text from documents where source < 'src5')")
def anti_unseen(spark, d):
    p = X.problems(spark, d)
    return J.rows_not_in(p.where("source >= 'src5'"), p.where("source < 'src5'"), "question").select(F.col("id").alias("doc_id"))


_SIDE = "select o_custkey, min(o_orderkey) as row_idx, list(o_orderkey order by o_orderkey) as sols from orders where o_orderkey % 2 = {0} group by o_custkey"


@query(f"with s as ({_SIDE.format(0)}), n as ({_SIDE.format(1)}) select coalesce(s.o_custkey, n.o_custkey) as question, array_to_string(coalesce(s.sols, []) || coalesce(n.sols, []), ',') as solutions, cast(s.row_idx is null as integer) as natural_only, coalesce(s.row_idx, n.row_idx) as row_idx from s full join n on s.o_custkey = n.o_custkey")
def merge_natural_synthetic(spark, d):
    o = X.table(spark, d, "orders")

    def side(k: int) -> DataFrame:
        return o.where(f"o_orderkey % 2 = {k}").groupBy(F.col("o_custkey").alias("question")).agg(F.min("o_orderkey").alias("row_idx"), F.array_sort(F.collect_list("o_orderkey")).alias("solutions"))

    return P.merged(side(0), side(1)).withColumn("solutions", F.array_join(F.transform("solutions", lambda x: x.cast("string")), ","))


@query(f"{A}, m as (select item, max(code) filter (where passing = 1 and idx <= 3) as chosen from attempts group by item), n as (select o_custkey as item, arg_max('order ' || o_orderkey, o_orderkey) as s from orders group by 1) select m.item, coalesce(chosen, s) as chosen, cast(chosen is null and s is not null as integer) as used_natural from m left join n using (item)")
def natural_fallback(spark, d):
    m = X.attempts(spark, d).groupBy("item").agg(F.max(F.when((F.col("passing") == 1) & (F.col("idx") <= 3), F.col("code"))).alias("chosen"))
    n = X.table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("solution"), F.col("o_orderkey").alias("row_idx"))
    return J.with_fallback(m, n, "item", "chosen", "solution", "row_idx").select("item", "chosen", "used_natural")


@query(f"{A}, r as (select item, code, arg_max(passing_public, idx) as p, arg_max('again ' || idx, idx) as o from attempts where passing = 0 and output = 'click' group by item, code) select a.item, a.idx, coalesce(r.p, a.passing) as passing, coalesce(r.o, a.output) as output from attempts a left join r using (item, code)")
def redo_merge_back(spark, d):
    a = X.attempts(spark, d)
    redone = a.where("passing = 0 and output = 'click'").select("item", "idx", "code", F.col("passing_public").alias("passing"), F.concat(F.lit("again "), F.col("idx").cast("string")).alias("output"))
    return J.merge_back(a, redone, ["passing", "output"]).select("item", "idx", "passing", "output")


@query(f"{A}, v as (select item, idx, {_OUT} as o from attempts where passing = 0) select item, idx from v where {_KIND} = 'Timeout'")
def redo_timeouts(spark, d):
    return J.redo_selection(_verdicts(spark, d), "timeout", scoring.error_kind("output")).select("item", "idx")


@query("select p.doc_id, l.quality from documents p join labels l on l.doc_id = p.doc_id")
def positional_join(spark, d):
    a = X.table(spark, d, "documents").select("doc_id")
    return J.by_position(a, X.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("select a.conv_id as item, a.turn as i, b.turn as j, length(a.text) - length(b.text) as gap from conversations a join conversations b on a.conv_id = b.conv_id and a.turn < b.turn")
def pairs_in_list(spark, d):
    return J.pairs_within(X.solutions(spark, d), "item", "idx", "code").select("item", "i", "j", (F.length("a") - F.length("b")).cast("long").alias("gap"))


@query("with p as (select conv_id, turn, lag(text) over (partition by conv_id order by turn) as b, text as a from conversations) select conv_id as item, turn as idx, md5(trim(b, chr(10) || chr(9) || ' ') || chr(10) || '# ==== EVOLVED CODE ====' || chr(10) || trim(a, chr(10) || chr(9) || ' ')) as content from p where b is not null")
def evol_pairs(spark, d):
    s = X.solutions(spark, d).withColumn("code", text.py_strip("code"))
    return P.evolution_rows(s).select("item", "idx", text.md5_hex("content").alias("content"))


@query("with s as (select lang, source, count(*) as size from documents group by all) select lang, source, size, k, n from s, (select unnest([1, 2, 5]) as k), (select unnest([10, 20]) as n) where k <= n and n <= size")
def parameter_grid(spark, d):
    """The jobs of a sweep: each part of the documents with every setting that it is large enough for."""
    sizes = M.frequency(X.table(spark, d, "documents"), "lang", "source", name="size")
    return J.fan_out(sizes, k=[1, 2, 5], n=[10, 20]).where("k <= n and n <= size")


@query("select item_id, cast(i as integer) as idx from benchmark, (select unnest(range(1, 4)) as i)")
def completion_copies(spark, d):
    return J.completions_for(X.table(spark, d, "benchmark").select("item_id"), 3)


@query("select conv_id as item, count(*) as n, md5(string_agg(text, '|' order by turn)) as codes from conversations group by conv_id")
def lists_round_trip(spark, d):
    lists = J.to_list(X.solutions(spark, d), "item", "idx", "code", "codes")
    back = J.to_rows(lists, "codes")
    again = J.to_list(back, "item", "idx", "value", "codes")
    return again.select("item", F.size("codes").cast("long").alias("n"), text.md5_hex(F.array_join("codes", "|")).alias("codes"))


@query(f"{A}, z as (select item, list(passing order by idx) as a, list(score order by idx) as b from attempts group by item) select item, list_sum(list_transform(list_zip(a, b), lambda p: case when p[1] = 1 then p[2] else 0 end)) as total from z")
def zipped_lists(spark, d):
    lists = X.attempts(spark, d).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("idx", "passing", "score"))).alias("x"))
    lists = lists.select("item", F.col("x.passing").alias("a"), F.col("x.score").alias("b"))
    z = J.zipped(lists, "a", "b", "z")
    return z.select("item", F.aggregate("z", F.lit(0.0), lambda t, p: t + F.when(p["a"] == 1, p["b"]).otherwise(0.0)).alias("total"))


@query("select * from (select doc_id, lang from documents where doc_id = (select min(doc_id) from documents)) limit 1")
def point_lookup(spark, d):
    return S.head(X.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 1)


# text


@query("select conv_id, turn, md5(trim('\"\"\"' || chr(10) || replace(text, '\"\"\"', '\\\"\"\"') || chr(10) || '\"\"\"' || chr(10) || 'def f():', ' ' || chr(10))) as prompt from conversations")
def docstring_prompts(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", text.md5_hex(text.docstring_prompt("text", F.lit("def f():"))).alias("prompt"))


_COMMENTED = "case when turn % 2 = 0 then '# ' || replace(text, ' ', chr(10)) else replace(text, ' ', chr(10) || '#') end"


def _commented(spark, d):
    t = F.col("text")
    return X.table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("# "), F.replace(t, F.lit(" "), F.lit("\n")))).otherwise(F.replace(t, F.lit(" "), F.lit("\n#"))).alias("code"))


@query(f"select conv_id, turn, md5(regexp_replace({_COMMENTED}, '#[^\\n]*', '', 'g')) as code from conversations")
def comments_stripped(spark, d):
    return _commented(spark, d).select("conv_id", "turn", text.md5_hex(text.strip_comments("code")).alias("code"))


@query(
    f"""with l as (select conv_id, turn, unnest(string_split({_COMMENTED}, chr(10))) as line, generate_subscripts(string_split({_COMMENTED}, chr(10)), 1) as i from conversations),
c as (select *, cast(ltrim(line) like '#%' as integer) as c, length(replace(line, ' ', '')) as n from l), p as (select *, lag(c, 1, 0) over (partition by conv_id, turn order by i) as p from c)
select conv_id, turn, round(coalesce(sum(cast(c = 1 and p = 0 as integer)) * 1e0 / nullif(sum(case when c = 0 then n else 0 end), 0), 0), 9) as ratio from p group by 1, 2"""
)
def comment_ratios(spark, d):
    return _commented(spark, d).select("conv_id", "turn", F.round(text.comment_ratio("code"), 9).alias("ratio"))


@query("select conv_id, turn, regexp_replace(role || ' ' || text, '[\\n\\r\\t/ ]', '_', 'g') as name from conversations")
def sanitised_names(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", text.sanitised_name(F.concat_ws(" ", "role", "text"), F.col("turn")).alias("name"))


@query("with t as (select distinct text as test from benchmark) select test, md5(test) as hash from t")
def test_bank_md5(spark, d):
    return P.test_bank(X.table(spark, d, "benchmark"), "text")


_LIMIT = "case event_type when 'click' then cast(event_id % 9 as varchar) || '.5 seconds' when 'view' then '1 - ' || (event_id % 7) || ' seconds' when 'signup' then null else (event_id % 5) || ' s' end"


@query(f"with l as (select event_id, {_LIMIT} as l from events) select event_id, cast(case when l is null then 30 when contains(l, '-') then (floor(cast(split_part(trim(split_part(l, '-', 2)), ' ', 1) as double)) + 1) * 2 else (floor(cast(split_part(trim(l), ' ', 1) as double)) + 1) * 2 end as integer) as seconds from l")
def time_limits(spark, d):
    e = X.table(spark, d, "events")
    n = lambda k: F.expr(f"cast(event_id % {k} as string)")
    shown = F.when(F.col("event_type") == "click", F.concat(n(9), F.lit(".5 seconds"))).when(F.col("event_type") == "view", F.concat(F.lit("1 - "), n(7), F.lit(" seconds"))).when(F.col("event_type") == "signup", None).otherwise(F.concat(n(5), F.lit(" s")))
    return e.select("event_id", scoring.time_limit(shown).alias("seconds"))


@query("select event_id, case when event_id % 4 = 0 then true when event_id % 4 = 1 then true when event_id % 4 = 2 then abs(value - (value + 0.00005)) < 1e-4 else value = value + 1 end as same from events")
def compare_outputs(spark, d):
    e = X.table(spark, d, "events")
    v = F.col("value").cast("string")
    k = F.col("event_id") % 4
    actual = F.when(k == 0, F.concat(v, F.lit("\n"))).when(k == 1, F.concat(F.lit("Yes\n\n"), v)).otherwise(v)
    expected = F.when(k == 0, v).when(k == 1, F.concat(F.lit("YES\n"), v)).when(k == 2, (F.col("value") + 0.00005).cast("string")).otherwise((F.col("value") + 1).cast("string"))
    return e.select("event_id", text.same_output(actual, expected).alias("same"))


@query("select conv_id, turn, case when length(text) % 3 = 0 then text || chr(10) else '' end as block from conversations")
def code_blocks(spark, d):
    t = F.col("text")
    flat = X.table(spark, d, "conversations")
    shown = F.when(F.length(t) % 3 == 0, F.concat(F.lit("Here:\n```python\n"), t, F.lit("\n```\nDone"))).otherwise(t)
    return flat.select("conv_id", "turn", text.code_block(shown).alias("block"))


@query("select page_id, cast(page_id % 30 as integer) as checkpoint, cast(page_id % 8 as integer) as run, (page_id % 5) / 10e0 as temperature, case page_id % 2 when 0 then 'small' else 'large' end as generator, cast((page_id % 5) / 10e0 as varchar) as reward_model from pages")
def path_columns(spark, d):
    n = lambda k: F.expr(f"cast(page_id % {k} as string)")
    name = F.concat(F.lit("/runs/run_"), n(8), F.lit("/checkpoint-"), n(30), F.lit("_of_"), F.when(F.col("page_id") % 2 == 0, "small").otherwise("large"), F.lit("_at_"), ((F.col("page_id") % 5) / 10).cast("string"), F.lit(".json.gz"))
    return X.table(spark, d, "pages").select("page_id", *[c.alias(k) for k, c in R.run_columns(name).items()])


@query("select doc_id, cast(length(text) - length(replace(text, chr(10), '')) + 1 as integer) as lines from documents where lang in ('en', 'de') and text like '%the%'")
def text_filters(spark, d):
    t = S.holding(S.of_category(X.table(spark, d, "documents"), "lang", "en", "de"), "text", "the")
    return t.select("doc_id", text.line_count("text").alias("lines"))


@query("select event_id from events where ts >= timestamp '2024-01-05'")
def since_cutoff(spark, d):
    return S.since(X.table(spark, d, "events"), "ts", "2024-01-05").select("event_id")


# data sets


@query(
    f"""{A}, s as (select item, max(code) filter (where passing = 1 and idx <= 20) as x, max(idx) filter (where passing = 1) as p, max(idx) filter (where passing = 0) as f from attempts where idx <= 20 group by item),
q as (select o_custkey as item, arg_max('order ' || o_orderkey, o_orderkey) as sol from orders group by 1),
pairs as (select s.item, coalesce(c.code, q.sol) as chosen, r.code as rejected, c.output as ci, r.output as ri from s left join attempts c on c.item = s.item and c.idx = s.p left join attempts r on r.item = s.item and r.idx = s.f left join q on q.item = s.item),
w as (select item, '\"\"\"' || chr(10) || 'question ' || (item % 50) || chr(10) || '\"\"\"' || chr(10) as prompt, chosen, rejected, ci, ri from pairs where chosen is not null and rejected is not null)
select prompt, arg_max(chosen, item) as text_chosen, arg_max(rejected, item) as text_rejected, arg_max(row(ci), item)[1] as chosen_info, arg_max(row(ri), item)[1] as rejected_info, min(item) as position from w group by prompt"""
)
def dpo_dataset(spark, d):
    a = X.attempts(spark, d)
    questions = a.select("item").distinct().select("item", F.col("item").alias("row_idx"), F.expr("concat('question ', cast(item % 50 as string))").alias("question"), F.lit("").alias("starter_code"))
    natural = X.table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("solution"), F.col("o_orderkey").alias("row_idx"))
    return P.preference_rows(a, "exec", questions, natural, first=20)


@query(f"{A}, w as (select *, sum(passing) over (partition by item) as p, count(*) over (partition by item) as n, count(*) over (partition by item, passing) as k, row_number() over (partition by item, passing order by idx) as r from attempts) select item, idx, '\"\"\"' || chr(10) || 'question ' || item || chr(10) || '\"\"\"' || chr(10) || code as content, passing as score from w where r <= greatest(least(p, n - p, 4), case when k > 1 then 1 else 0 end)")
def orm_dataset(spark, d):
    a = X.attempts(spark, d).withColumn("question", F.concat(F.lit("question "), F.col("item").cast("string"))).withColumn("starter_code", F.lit(""))
    return P.reward_rows(a, 4).select("item", "idx", "content", "score")


@query("with f as (select o_custkey as row_idx, 'q ' || (o_custkey % 40) as question, count(*) as n, arg_min(o_orderpriority, o_orderkey) as p from orders group by 1), r as (select *, row_number() over (partition by question order by row_idx) as r from f) select row_idx, question, n from r where r = 1 and n >= 2")
def dedup_then_filter(spark, d):
    o = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("row_idx")).agg(F.count("*").alias("n"))
    p = o.withColumn("question", F.expr("concat('q ', cast(row_idx % 40 as string))"))
    return S.first_wins(p, "question", "row_idx").where("n >= 2").select("row_idx", "question", "n")


@query("with s as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as idx, text from conversations where turn > 0), q as (select conv_id, text as question from conversations where turn = 0) select s.conv_id as item, cast(idx as integer) as idx, md5(trim('\"\"\"' || chr(10) || question || chr(10) || '\"\"\"' || chr(10) || text, ' ' || chr(10))) as content from s join q using (conv_id) where idx <= 2")
def sft_dataset(spark, d):
    s = X.solutions(spark, d)
    lists = J.to_list(s.where("idx > 0"), "item", "idx", "code", "solutions")
    p = s.where("idx = 0").select("item", F.col("code").alias("question"), F.lit("").alias("starter_code")).join(lists, "item")
    return P.training_rows(p, "clip", clip=2).select("item", "idx", text.md5_hex("content").alias("content"))


@query("select item_id as item, item_id % 3 <> 0 as parses from benchmark")
def parse_check(spark, d):
    return X.programs(spark, d).select("item", pyudfs.parses_udf("code").alias("parses"))


@query("select item_id as item, item_id % 3 <> 0 as same from benchmark")
def tree_match(spark, d):
    p = X.programs(spark, d)
    return p.select("item", pyudfs.same_tree_udf("code", text.strip_comments("code")).alias("same"))


@query()
def mutated_programs(spark, d):
    return X.programs(spark, d).select("item", pyudfs.mutate_udf("code", F.col("item").cast("int")).alias("code"))


_STEPPED = "x = ' || item || chr(10) || 'if x > 3 and x < 90:' || chr(10) || case when item % 3 = 0 then chr(9) else '    ' end || 'print(x + 1)' || chr(10) || 'else:' || chr(10) || case when item % 3 = 0 then chr(9) else '    ' end || 'print(x' || case when item % 3 = 0 then '' else ')' end || chr(10)"


@query(f"with {X.PROGRAMS_SQL}, s as (select item, '# - first' || chr(10) || '{_STEPPED} as code from programs) select item, code from s where 1e0 / (length(replace(replace(replace(code, '# - first' || chr(10), ''), ' ', ''), chr(10), '')) + case when item % 3 = 0 then 0 else 2 end) <= 0.0243")
def steps_cleaned(spark, d):
    return P.steps_on_top(P.clean_steps(X.programs(spark, d), 0.01, 0.0243)).select("item", "code")




# extensions: windows over events


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def ext_tumbling(spark, d):
    e = X.table(spark, d, "events")
    return _rounded(V.tumbling(e, "1 hour", by=["event_type"]), "total", digits=4)


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, s")
def ext_sessions(spark, d):
    return V.sessions(X.table(spark, d, "events"), "30 minutes")


@query(f"{A} select item % 3 as g, passing_public as p, round(avg(passing), 6) as rate, count(*) as n from attempts group by cube (1, 2)")
def ext_cube(spark, d):
    a = X.attempts(spark, d).select((F.col("item") % 3).alias("g"), F.col("passing_public").alias("p"), "passing")
    return _rounded(a.cube("g", "p").agg(F.avg("passing").alias("rate"), F.count("*").alias("n")), "rate")


@query("select start, event_type, count(*) as n, round(sum(value), 4) as total from (select event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) + interval 30 minutes * case when ts >= date_trunc('hour', ts) + interval 30 minutes then 1 else -1 end]) as start from events) group by 1, 2")
def ext_sliding(spark, d):
    return _rounded(V.tumbling(X.table(spark, d, "events"), "1 hour", slide="30 minutes", by=["event_type"]), "total", digits=4)


@query(f"{A} select item % 3 as g, passing_public as p, count(*) as n, grouping(item % 3, passing_public) as level from attempts group by grouping sets ((1), (2), ())")
def ext_grouping_sets(spark, d):
    a = X.attempts(spark, d).select((F.col("item") % 3).alias("g"), F.col("passing_public").alias("p"))
    return a.groupingSets([["g"], ["p"], []], "g", "p").agg(F.count("*").alias("n"), F.grouping_id("g", "p").alias("level"))


@query("select event_type, true as near from events group by event_type")
def ext_distinct_estimate(spark, d):
    pairs = X.table(spark, d, "events").select("event_type", "user_id").distinct()  # beside an exact distinct count each pair would hold a sketch
    e = pairs.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count("user_id").alias("n"))
    return e.select("event_type", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


@query(f"{A}, i as (select cast(item % 4 as integer) as checkpoint, item, count(*) as n, sum(passing) as c from attempts group by all), m as (select cast(item % 4 as integer) as checkpoint, idx, avg(passing) as m from attempts group by all) select checkpoint, items, round(p, 6) as pass_at_k, round(e, 6) as stderr from (select checkpoint, count(*) as items, avg(c / n) * 100 as p from i group by 1) join (select checkpoint, stddev_pop(m) / sqrt(count(*)) * 100 as e from m group by 1) using (checkpoint)")
def checkpoint_sweep(spark, d):
    a = X.attempts(spark, d)
    name = F.concat(F.lit("out/checkpoint-"), F.expr("cast(item % 4 as string)"), F.lit("_m.json.gz"))
    rows = a.withColumn("checkpoint", R.run_columns(name)["checkpoint"])
    return _rounded(M.report(rows, 1, 20, ["checkpoint"]).select("checkpoint", "items", "pass_at_k", "stderr"), "pass_at_k", "stderr")


def _streamed(spark, d, build, mode):
    """What a stream over the event file has given when all of it is read; its batches go to Parquet."""
    path = scratch(spark, "stream")

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={k}")

    table = f"{d}/events.parquet"  # a folder of files, or one file in the folder of the tables
    folder = R.exists(spark, f"{table}/*")
    out = build(V.event_stream(spark, table if folder else d, glob="*.parquet" if folder else "events.parquet", schema=spark.read.parquet(table).schema))
    run = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(path)


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def ext_stream_windows(spark, d):
    out = _streamed(spark, d, lambda e: V.tumbling(e, "1 hour", late="400 days", by=["event_type"]), "complete")
    return _rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), "total", digits=4)


@query("select event_id, user_id from events")
def ext_stream_distinct(spark, d):
    return _streamed(spark, d, lambda e: V.distinct_events(e, late="400 days").select("event_id", "user_id"), "append").select("event_id", "user_id")


@query("select user_id as item, count(*) as n, cast(sum(cast(event_type = 'purchase' as integer)) as bigint) as c from events group by 1")
def ext_running_rate(spark, d):
    rates = _streamed(spark, d, lambda e: W.pass_rates(e.select("user_id", "ts", (F.col("event_type") == "purchase").cast("int").alias("passing"))), "update")
    return rates.groupBy("item").agg(F.max("n").alias("n"), F.max("c").alias("c"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
