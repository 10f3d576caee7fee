"""Registered queries of near-duplicate search, document sources, late and stateful streams, sketches, stores of results,
as-of alignment, schemas and smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixtures as X
from tessera.operators import asof as Z
from tessera.operators import metrics as M
from tessera.operators import near_duplicates as N
from tessera.operators import shape as H
from tessera.operators import sketches as K
from tessera.operators import verdicts as Y
from tessera.plans import pipelines as P
from tessera.plans.catalog import A, _rounded, _streamed, query
from tessera.plans.catalog_sources import _documents
from tessera.plans.lineage import scratch
from tessera.sources import batches as B
from tessera.sources import documents as D
from tessera.sources import results as R
from tessera.streaming import events as V
from tessera.streaming import late as L
from tessera.streaming import running as W

_SETS = r"""w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w
), g as (select doc_id, len(s) as n, unnest(s) as x from s
), pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i from g a join g b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2
), links as (select a, b from pairs where i >= {t} * (na + nb - i)
), edges as (select a, b from links union all select b, a from links
), reach as (select doc_id as a, doc_id as m from s union select e.b, r.m from reach r join edges e on e.a = r.a)"""


def _near_sql(threshold: float) -> str:
    return f"with recursive {_SETS.replace('{t}', f'cast({threshold} as double)')} select s.doc_id, cast(any_value(len(s.s)) as integer) as n_shingles, min(m) as class_id from s join reach on reach.a = s.doc_id group by s.doc_id"


@query(_near_sql(0.5))
def near_duplicates_half(spark, d):
    return N.near_duplicates(X.table(spark, d, "documents"), threshold=0.5)


@query(_near_sql(0.8))
def near_duplicates(spark, d):
    return N.near_duplicates(X.table(spark, d, "documents"))


@query(f"{A} select 'u' || item as item, cast(idx as integer) as idx, code, num_tokens, score, passing = 1 as passing, passing_public = 1 as passing_public, label from attempts")
def document_attempts_streamed(spark, d):
    items = D.read_items_streamed(spark, f"{_documents(spark, d)}/part=*")
    a = R.attempts_of(items.where("unique_name is not null"))
    return a.select("item", "idx", "code", "num_tokens", F.col("orm_score").alias("score"), "passing", "passing_public", F.col("orm_label").alias("label"))


@query(f"{A}, n as (select item, count(*) as n from attempts group by item) select case item % 3 when 0 then 'EASY' else 'HARD' end as part, 'm' as model, count(*) as documents, cast(sum(n) as bigint) as attempts from n where item % 3 <> 2 group by all")
def document_headers(spark, d):
    path = f"{_documents(spark, d)}/part=*"
    rows = D.read_items_streamed(spark, path, F.col("file").contains("part=EASY")).unionByName(D.read_items_streamed(spark, path, F.col("file").contains("part=HARD")))
    part = F.regexp_extract("file", "part=([A-Z]+)", 1).alias("part")
    return rows.groupBy(part).agg(F.max(F.get_json_object("header", "$.model")).alias("model"), F.count("header").alias("documents"), F.sum(F.coalesce(F.size("results"), F.lit(0))).alias("attempts"))


# streams: events arrive by time in three parts; every seventh event is held back and comes last

_MARK = "mark as (select date_trunc('milliseconds', max(ts) filter (event_id % 7 <> 0)) - interval 2 days as m from events), late as (select event_id from events, mark where event_id % 7 = 0 and ts <= m)"


def _fed(spark, d, build):
    """(what came out, rows dropped as late) of a stream that is fed part by part."""
    folder, out, progress = scratch(spark, "fed"), scratch(spark, "out"), scratch(spark, "progress")
    e = X.table(spark, d, "events")
    held = F.col("event_id") % 7 == 0
    days = [F.col("ts") < "2024-01-11", (F.col("ts") >= "2024-01-11") & (F.col("ts") < "2024-01-21"), F.col("ts") >= "2024-01-21"]
    dropped = 0
    for part in [*[~held & day for day in days], held]:
        e.where(part).write.mode("append").parquet(folder)
        dropped += L.drain(build(V.event_stream(spark, folder, 100, schema=e.schema)), out, progress).late
    return spark.read.parquet(out), dropped


@query(f"with {_MARK}, d as (select date_trunc('day', ts) as start, * from events where event_id not in (from late)) select start, event_type, count(*) as n, round(sum(value), 4) as total from d, mark where start + interval 1 day <= m group by start, event_type")
def ext_late_windows(spark, d):
    out, _ = _fed(spark, d, lambda e: L.closed_windows(e, "1 day", "2 days", ["event_type"]))
    return _rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), "total", digits=4)


@query(f"with {_MARK} select event_id, (select count(*) from late) as dropped from late")
def ext_late_rows(spark, d):
    out, dropped = _fed(spark, d, lambda e: L.accepted(e, "2 days").select("event_id"))
    return X.table(spark, d, "events").join(out, "event_id", "left_anti").select("event_id", F.lit(dropped).cast("long").alias("dropped"))


def _passing(events):
    return events.select("user_id", "ts", (F.col("event_type") == "purchase").cast("int").alias("passing"))


@query("select user_id as item, count(*) as n, cast(sum(cast(event_type = 'purchase' as integer)) as bigint) as c from events group by 1")
def ext_running_rate_from_table(spark, d):
    """The first ten days are counted by a batch job, the rest arrives as a stream."""
    e = X.table(spark, d, "events")
    first = _passing(e.where("ts < '2024-01-11'")).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("passing").alias("c"))
    rates = _streamed(spark, d, lambda s: W.pass_rates(_passing(s.where("ts >= timestamp_ntz '2024-01-11'")), first=first), "update")
    known = rates.groupBy("item").agg(F.max("n").alias("n"), F.max("c").alias("c"))
    rest = first.select(F.col("user_id").alias("item"), "n", "c").join(known, "item", "left_anti")  # of whom the stream has nothing
    return known.unionByName(rest)


@query("select user_id as item, count(*) as n, cast(sum(cast(event_type = 'purchase' as integer)) as bigint) as c from events group by 1 having epoch_ms(max(ts)) + 7200000 <= (select epoch_ms(max(ts)) - 1800000 from events)")
def ext_closed_items(spark, d):
    rates = _streamed(spark, d, lambda s: W.pass_rates(_passing(s), gap_ms=7_200_000, late="30 minutes"), "update")
    return rates.where("closed").select("item", "n", "c")


# stores that grow from run to run


@query("select cast(b as integer) as batch, count(*) as n, cast(sum(conv_id) as bigint) as total from conversations, (select unnest([0, 1, 2]) as b) where turn % 3 = b group by b")
def batches_committed(spark, d):
    path, c = scratch(spark, "committed"), X.table(spark, d, "conversations").select("conv_id", "turn")
    B.write_batch(c, path, 0)  # a run that was cut off before its commit leaves rows that nobody sees
    B.commit(spark, path, 0, B.write_batch(c.where("turn % 3 = 0"), path, 0))
    B.write_batch(c, path, 1)
    B.resumed(spark, path, 3, lambda k: c.where(f"turn % 3 = {k}"))
    return B.committed(spark, path, "conv_id long, turn long").groupBy("batch").agg(F.count("*").alias("n"), F.sum("conv_id").alias("total"))


@query(f"{A} select item, idx, 'code ' || (event_id % 7) as code, 'spec ' || (item % 3) as tests, length('code ' || (event_id % 7) || 'spec ' || (item % 3)) % 2 = 0 as passing, 'ran code ' || (event_id % 7) as output, (select count(*) from (select distinct event_id % 7, item % 3 from attempts)) as executed from attempts")
def verdicts_stored(spark, d):
    """Half of the attempts are judged by one run and all by the next; both together execute each pair of program and tests once."""
    path = scratch(spark, "verdicts")
    a = X.attempts(spark, d).select("item", "idx", "code", F.concat(F.lit("spec "), F.expr("cast(item % 3 as string)")).alias("tests"))
    ran = lambda rows: rows.withColumns({"passing": F.expr("length(concat(code, tests)) % 2 = 0"), "output": F.concat(F.lit("ran "), "code")})  # noqa: E731  in place of a sandbox
    Y.with_verdicts(a.where("item % 2 = 0"), path, ran, parts=2)
    out = Y.with_verdicts(a, path, ran, parts=3)
    return out.withColumn("executed", F.lit(B.committed(spark, path, Y.SCHEMA).count()).cast("long"))


_SKETCH_SQL = """with e as (select *, date_trunc('day', ts) as day from events), g as (select event_type, count(*) as n, count(distinct user_id) as u from e group by 1 union all select 'all', count(*), count(distinct user_id) from e)
select event_type, n, u as users, true as users_near, true as ranks_near from g"""


@query(_SKETCH_SQL)
def sketches_rolled_up(spark, d):
    """Sketches of each day's file and type are stored in two runs, then united by type, and those of types into one. Estimates are held against the exact
    figures: distinct users within 4 per cent, the ranks of three estimated quantiles within 3 per cent."""
    folder, path = scratch(spark, "days"), scratch(spark, "sketches")
    e = X.table(spark, d, "events")
    e.where("ts < '2024-01-16'").repartition(4, F.to_date("ts")).write.parquet(folder)
    K.refresh(spark.read.parquet(folder), path, ["event_type"], "user_id", "value")
    e.where("ts >= '2024-01-16'").repartition(4, F.to_date("ts")).write.mode("append").parquet(folder)
    rows = spark.read.parquet(folder)
    K.refresh(rows, path, ["event_type"], "user_id", "value")
    K.refresh(rows, path, ["event_type"], "user_id", "value")  # nothing new
    by_type = K.rolled_up(K.stored(rows, path, ["event_type"]), ["event_type"])
    levels = by_type.unionByName(K.rolled_up(by_type, []).withColumn("event_type", F.lit("all")))
    shares = (0.1, 0.5, 0.9)
    known = levels.select("event_type", "n", K.distinct().alias("u"), F.array(*map(K.quantile, shares)).alias("q"))
    both = F.explode(F.array(F.col("event_type"), F.lit("all"))).alias("event_type")
    exact = rows.select(both, "user_id", "value").join(F.broadcast(known.select("event_type", "q")), "event_type")  # a row a type
    ranks = [F.avg((F.col("value") <= F.col("q")[k]).cast("int")).alias(f"r{k}") for k in range(3)]
    held = exact.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), *ranks)
    near = [F.abs(F.col(f"r{k}") - s) <= 0.03 for k, s in enumerate(shares)]
    return known.join(held, "event_type").select("event_type", "n", "users", (F.abs(F.col("u") - F.col("users")) <= 0.04 * F.col("users")).alias("users_near"), (near[0] & near[1] & near[2]).alias("ranks_near"))


@query("with l as (select event_id % 3 as series, event_id as step, value as loss, event_type as phase from events), c as (select o_orderkey, o_orderkey % 3 as series, o_orderkey * 2 - 5000 as step from orders) select c.o_orderkey, c.series, c.step, l.step as log_step, l.loss, l.phase from c asof left join l on c.series = l.series and c.step >= l.step")
def checkpoints_as_of(spark, d):
    """Checkpoints with the last row of the training log at or before their step."""
    log = X.table(spark, d, "events").select(F.expr("event_id % 3").alias("series"), F.col("event_id").alias("step"), F.col("value").alias("loss"), F.col("event_type").alias("phase"))
    points = X.table(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey % 3").alias("series"), F.expr("o_orderkey * 2 - 5000").alias("step"))
    return Z.last_at_or_before(points, log, "series", "step", ["loss", "phase"])


# shapes of JSON, smoothed lattices

_TREE = """t as (select regexp_replace(fullkey, '\\[[0-9]+\\]', '[*]', 'g') as path, case type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null'
  when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' else 'number' end as type from j, json_tree(j.x)) select path, type, count(*) as n from t group by all"""


@query(f"with j as (select props as x from events), {_TREE}")
def json_paths(spark, d):
    return H.json_inventory(X.table(spark, d, "events"), "props")


_NESTED = """'{"id": ' || event_id || ', "of": {"user": ' || user_id || ', "kind": "' || event_type || '", "props": [' || props || ', ' || case event_id % 4 when 0 then 'null' when 1 then 'true' when 2 then '"x"' else '[1, {"y": 2}]' end || ']}, "mixed": ' || case event_id % 3 when 0 then '1' when 1 then '"1"' else '{}' end || '}'"""


@query(f"with j as (select {_NESTED} as x from events), {_TREE}")
def json_paths_nested(spark, d):
    return H.json_inventory(X.table(spark, d, "events").select(F.expr(_NESTED).alias("x")), "x")


_SMOOTH_SQL = f"""{A}, g as (select idx % 5 as x, idx % 12 as y, avg(score) as v from attempts group by 1, 2), w as (select o, exp(-0.5 * o * o) / sum(exp(-0.5 * o * o)) over () as w from (select unnest(range(-4, 5)) as o)),
a as (select g.x, g.y, sum(w * h.v) as v from g, w, g h where h.y = g.y and h.x = case when ((g.x + o) % 10 + 10) % 10 < 5 then ((g.x + o) % 10 + 10) % 10 else 9 - ((g.x + o) % 10 + 10) % 10 end group by 1, 2),
b as (select a.x, a.y, sum(w * h.v) as v from a, w, a h where h.x = a.x and h.y = case when ((a.y + o) % 24 + 24) % 24 < 12 then ((a.y + o) % 24 + 24) % 24 else 23 - ((a.y + o) % 24 + 24) % 24 end group by 1, 2)"""


def _lattice(spark, d):
    cells = X.attempts(spark, d).groupBy(F.expr("idx % 5").alias("x"), F.expr("idx % 12").alias("y")).agg(F.avg("score").alias("v"))
    return H.smoothed(cells, "x", "y", "v", 5, 12)


@query(f"{_SMOOTH_SQL} select cast(x as integer) as x, cast(y as integer) as y, round(v, 6) as v from b")
def grid_smoothed(spark, d):
    return _rounded(_lattice(spark, d), "v")


@query(f"{_SMOOTH_SQL} select round(quantile_cont(v, 0.15), 6) as low, round(max(v), 6) as high from b")
def grid_smoothed_percentiles(spark, d):
    """The bounds of the contour levels: the 15th percentile and the maximum of the smoothed grid."""
    return _rounded(_lattice(spark, d).agg(F.percentile("v", F.lit(0.15)).alias("low"), F.max("v").alias("high")), "low", "high")


# figures over attempts without a verdict, trainer's rows, runs below a folder


@query("select name, cast(null as double) as lacking, true as whole_is_known from (select unnest(['pass_at_k_curve', 'pass_one_stderr', 'pass_one_by_item', 'reranked_curve', 'expected_best_of_n', 'expected_grid', 'sampled_best_of_n', 'public_accuracy', 'pass_at_k_mean', 'reranked_accuracy']) as name)")
def figures_without_verdicts(spark, d):
    """Each figure over attempts of which those of one item lack their verdict, and over whole ones."""
    whole = X.attempts(spark, d)
    parts = whole.withColumn("passing", F.when(F.col("item") != 3, F.col("passing")))
    figures = {
        "pass_at_k_curve": lambda a: M.pass_at_k_curve(a, 3).agg(F.max("pass_at_k").alias("v")), "pass_one_stderr": lambda a: M.pass_one_stderr(a).select(F.col("stderr").alias("v")),
        "pass_one_by_item": lambda a: M.pass_one_by_item(a).select(F.col("pass_one").alias("v")), "reranked_curve": lambda a: M.reranked_curve(a, 3).agg(F.max("accuracy").alias("v")),
        "expected_best_of_n": lambda a: M.expected_best_of_n(a, [1, 2]).agg(F.max("accuracy").alias("v")), "expected_grid": lambda a: M.expected_grid(a, [1], [2]).select(F.col("accuracy").alias("v")),
        "sampled_best_of_n": lambda a: M.sampled_best_of_n(a, 2, draws=2).select(F.col("accuracy").alias("v")), "public_accuracy": lambda a: M.public_accuracy(a, 20).select(F.col("accuracy").alias("v")),
        "pass_at_k_mean": lambda a: M.pass_at_k_mean(a, 2).select(F.col("pass_at_k").alias("v")), "reranked_accuracy": lambda a: M.reranked_accuracy(a).select(F.col("accuracy").alias("v")),
    }
    out = None
    for name, figure in figures.items():
        both = figure(parts).select(F.lit(name).alias("name"), F.col("v").alias("lacking")).join(figure(whole).select(F.lit(name).alias("name"), F.col("v").isNotNull().alias("whole_is_known")), "name")
        out = both if out is None else out.unionByName(both)
    return out


_WORDS = "w as (select conv_id, turn, regexp_extract_all(text, '\\w+|[^\\w\\s]') as ws from conversations), v as (select word, row_number() over (order by n desc, word) as id from (select unnest(ws) as word, count(*) as n from w group by 1 order by n desc, word limit 300))"


@query(f"with {_WORDS}, i as (select conv_id, turn, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w where len(ws) <= 60), j as (select conv_id, turn, list(coalesce(v.id, 0) order by pos) as ids from i left join v using (word) group by all) select w.conv_id, w.turn, coalesce(array_to_string(ids, ' '), '') as input_ids, cast(len(ws) as integer) as lengths from w left join j using (conv_id, turn) where len(ws) <= 60")
def encoded_prompts(spark, d):
    c = X.table(spark, d, "conversations")
    rows = P.encoded_rows(c, P.word_vocabulary(c, "text", 300), ["conv_id", "turn"], 60, "text")
    return rows.select("conv_id", "turn", F.array_join(F.transform("input_ids", lambda i: i.cast("string")), " ").alias("input_ids"), "lengths")


@query(f"{A}, i as (select item, cast(item % 2 + 1 as integer) as run, cast(100 * (item % 3) as integer) as checkpoint, count(*) as n from attempts group by item) select run, checkpoint, 'm' as model, count(*) as items, cast(sum(n) as bigint) as attempts from i group by all")
def runs_read(spark, d):
    """A document for each run and checkpoint, below folders that are named by them."""
    root, items = scratch(spark, "runs"), X.result_items(spark, d)
    number = F.substring("unique_name", 2, 20).cast("long")
    for run in (1, 2):
        for step in (0, 1, 2):
            R.write_document(items.where((number % 2 + 1 == run) & (number % 3 == step)), {"model": "m"}, f"{root}/run_{run}/checkpoint-{100 * step}_m.json")
    rows = R.read_runs(spark, root, "part-*").select("run", "checkpoint", "model", F.explode("items").alias("i"))
    return rows.groupBy("run", "checkpoint", "model").agg(F.count("*").alias("items"), F.sum(F.size("i.results")).alias("attempts"))
