"""Registered queries of the sources and sinks: tables are written in each form, read back and held against SQL over the
tables. What is written goes below the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixtures as X
from tessera.functions import pyudfs, scoring, text
from tessera.operators import metrics as M
from tessera.plans import pipelines as P
from tessera.plans.catalog import A, _rounded, query
from tessera.plans.lineage import scratch
from tessera.sources import results as R

HEADER = {"model": "m", "temperature": 0.8, "completion_limit": 40}


def _documents(spark, d) -> str:
    path = scratch(spark, "documents")
    R.write_documents(X.result_items(spark, d), HEADER, path)
    return path


@query(f"{A} select 'u' || item as item, cast(idx as integer) as idx, code, num_tokens, score, passing = 1 as passing, passing_public = 1 as passing_public, label from attempts")
def document_attempts(spark, d):
    a = R.attempts_of(R.items_of(R.read_documents(spark, f"{_documents(spark, d)}/part=*", lines=True)))
    return a.select("item", "idx", "code", "num_tokens", F.col("orm_score").alias("score"), "passing", "passing_public", F.col("orm_label").alias("label"))


@query(f"{A}, i as (select case item % 3 when 0 then 'EASY' when 1 then 'HARD' else 'MEDIUM' end as difficulty, item, count(*) as n from attempts group by all) select difficulty, 'm' as model, 0.8e0 as temperature, count(*) as items, cast(sum(n) as bigint) as attempts from i group by difficulty")
def documents_by_difficulty(spark, d):
    docs = R.read_documents(spark, f"{_documents(spark, d)}/part=*", lines=True)
    rows = docs.select("model", "temperature", F.explode("items").alias("i"))
    return rows.groupBy(F.col("i.difficulty").alias("difficulty"), "model", "temperature").agg(F.count("*").alias("items"), F.sum(F.size("i.results")).alias("attempts"))


@query(f"{A} select 'u' || item as item, count(*) as n from attempts where item % 3 = 0 or item % 3 = 1 group by item")
def globbed_documents(spark, d):
    a = R.attempts_of(R.items_of(R.read_documents(spark, f"{_documents(spark, d)}/part={{EASY,HARD}}", lines=True)))
    return a.groupBy("item").agg(F.count("*").alias("n"))


@query(f"{A} select 'u' || item as item, cast(idx as integer) as idx, output, cumulative_logprob from attempts")
def items_folder(spark, d):
    path = scratch(spark, "items")
    R.write_items(X.result_items(spark, d), path, "datasets")
    return R.read_attempts(spark, path).select("item", "idx", "output", "cumulative_logprob")


@query(f"{A} select 'u' || item as item, 'question ' || item as prompt, count(*) as n, cast(sum(passing) as bigint) as c from attempts group by item")
def items_as_lines(spark, d):
    path = scratch(spark, "lines")
    for _ in range(2):  # a second writing replaces the first
        R.write_items(X.result_items(spark, d), path, "gzjson")
    items = R.read_items(spark, path)
    return items.select(F.col("unique_name").alias("item"), "prompt", F.size("results").cast("long").alias("n"), F.size(F.filter("results", lambda r: r["passing"])).cast("long").alias("c"))


@query(f"{A} select 'u' || item as item, 'm' as model, cast(40 as bigint) as completion_limit, count(*) as n from attempts group by item")
def columnar_items(spark, d):
    path = scratch(spark, "columnar")
    R.to_columnar(spark, f"{_documents(spark, d)}/part=*", path, lines=True)
    return spark.read.parquet(path).select(F.col("unique_name").alias("item"), "model", "completion_limit", F.size("results").cast("long").alias("n"))


@query("select r_regionkey, r_name from region")
def resolved_table(spark, d):
    here = R.resolve(spark, f"{d}/region.parquet", "/nowhere")  # there, so taken as it is
    below = R.resolve(spark, "region.parquet", d)  # not there, so looked for below the root
    return spark.read.parquet(here).select("r_regionkey").join(spark.read.parquet(below), "r_regionkey").select("r_regionkey", "r_name")


@query("select case when doc_id % 5 = 0 then 'test' else 'train' end as split, lang, count(*) as n from documents group by all")
def named_splits(spark, d):
    path, docs = scratch(spark, "splits"), X.table(spark, d, "documents").select("doc_id", "lang")
    R.write_splits({"test": docs.where("doc_id % 5 = 0"), "train": docs.where("doc_id % 5 <> 0")}, path)
    return R.read_splits(spark, path).groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("select doc_id, lang, cast(doc_id % 2 as integer) as split from documents")
def numbered_splits(spark, d):
    paths, docs = [scratch(spark, "part") for _ in range(2)], X.table(spark, d, "documents")
    docs.where("doc_id % 2 = 0").select("doc_id", "lang").write.parquet(paths[0])
    docs.where("doc_id % 2 = 1").select("lang", "doc_id").write.parquet(paths[1])
    return R.read_split(spark, paths).select("doc_id", "lang", "split")


@query("select 'p' || (item_id % 7) as problem, cast(item_id // 7 as integer) as test, text as input, 'out ' || item_id as output from benchmark")
def test_file_pairs(spark, d):
    b = X.table(spark, d, "benchmark")
    n = F.expr("cast(item_id div 7 as string)")
    folder = F.concat(F.lit("file:/tests/p"), F.expr("cast(item_id % 7 as string)"), F.lit("/"))
    dotted = F.col("item_id") % 2 == 0  # either 'i.' before the name or '.i' behind it
    given = b.select(F.when(dotted, F.concat(folder, n, F.lit(".in"))).otherwise(F.concat(folder, F.lit("I."), n)).alias("path"), F.col("text").alias("body"))
    asked = b.select(F.when(dotted, F.concat(folder, n, F.lit(".OUT"))).otherwise(F.concat(folder, F.lit("O."), n)).alias("path"), F.concat(F.lit("out "), F.col("item_id").cast("string")).alias("body"))
    return R.test_pairs(given.unionByName(asked).union(b.limit(1).select(F.lit("file:/tests/p0/readme"), F.lit("no test"))))


@query("select lang, count(*) as n, cast(sum(length(text)) as bigint) as characters from documents group by lang")
def chunk_folders(spark, d):
    path, docs = scratch(spark, "chunks"), X.table(spark, d, "documents")
    docs.withColumn("chunk", F.expr("doc_id % 4")).write.partitionBy("chunk").parquet(path)
    return R.read_chunks(spark, path).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


@query("select cast(page_id % 30 as integer) as checkpoint, cast(page_id % 8 as integer) as run, count(*) as n from pages group by all")
def runs_relaid(spark, d):
    n = lambda k: F.expr(f"cast(page_id % {k} as string)")
    rows = X.table(spark, d, "pages").select("page_id", F.concat(F.lit("a/run_"), n(8), F.lit("/checkpoint-"), n(30), F.lit("_x.json.gz")).alias("file"))
    path = scratch(spark, "relaid")
    R.relaid_by_checkpoint(rows, path)
    return spark.read.parquet(path).groupBy("checkpoint", "run").agg(F.count("*").alias("n"))


@query("select label as token, count(*) as n from embeddings group by label")
def trace_tokens(spark, d):
    path = scratch(spark, "trace")
    X.table(spark, d, "embeddings").select(F.concat(F.lit(" "), F.col("label").cast("string"), F.lit("  x")).alias("value")).write.text(path)
    return R.read_trace(spark, path).groupBy("token").agg(F.count("*").alias("n"))


@query("select cast(b as integer) as batch, count(*) as n, cast(sum(conv_id) as bigint) as total from conversations, (select unnest([0, 1, 2]) as b) where turn % 3 = b group by b")
def batches_resumed(spark, d):
    path, c = scratch(spark, "batches"), X.table(spark, d, "conversations").select("conv_id", "turn")
    R.append_batch(c.where("turn % 3 = 2"), path, 1)  # a run that broke off
    for b in (0, 1, 2):
        R.append_batch(c.where(f"turn % 3 = {b}"), path, b)
    return spark.read.parquet(path).groupBy("batch").agg(F.count("*").alias("n"), F.sum("conv_id").alias("total"))


@query("select o_orderstatus as status, count(*) as n, cast(max(o_custkey) as bigint) as most from orders group by 1")
def rows_by_key(spark, d):
    path = scratch(spark, "keyed")
    R.write_by_key(X.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("difficulty")), path)
    return spark.read.parquet(path).groupBy(F.col("difficulty").cast("string").alias("status")).agg(F.count("*").alias("n"), F.max("o_custkey").alias("most"))


def _reports(spark, d):
    """Documents of three files: one whole, one without scores, one without public verdicts, and one that is empty."""
    items = X.result_items(spark, d).select(F.element_at(F.array(*map(F.lit, "abc")), F.pmod(F.substring("unique_name", 2, 20).cast("long"), F.lit(3)).cast("int") + 1).alias("file"), "unique_name", "results")
    kind = "array<struct<code:string,cumulative_logprob:double,num_tokens:bigint,orm_score:double,passing:boolean,passing_public:boolean>>"

    def kept(r):
        score, shown = F.when(F.col("file") != "b", r["orm_score"]), F.when(F.col("file") != "c", r["passing_public"])
        return F.struct(r["code"].alias("code"), r["cumulative_logprob"].alias("cumulative_logprob"), r["num_tokens"].alias("num_tokens"), score.alias("orm_score"), r["passing"].alias("passing"), shown.alias("passing_public"))

    items = items.select("file", "unique_name", F.transform("results", kept).cast(kind).alias("results"))
    whole = items.select("file", F.array(F.struct("unique_name", "results")).alias("items"))
    return whole.unionByName(spark.createDataFrame([("z",)], "file string").withColumn("items", F.lit(None).cast(whole.schema["items"].dataType)))


_REPORT_SQL = f"""{A}, f as (select *, ['a', 'b', 'c'][item % 3 + 1] as file, row_number() over (partition by item order by score desc nulls last, idx) as rm, row_number() over (partition by item order by cumulative_logprob desc nulls last, idx) as ml,
  row_number() over (partition by item order by passing_public desc, score desc nulls last, idx) as rp, row_number() over (partition by item order by cast(idx > 20 as integer), passing_public desc, idx) as pu from attempts),
i as (select file, item, count(*) as n, sum(passing) as c, max(case when rm = 1 then passing else 0 end) as rm, max(case when ml = 1 then passing else 0 end) as ml, max(case when rp = 1 and passing_public = 1 then passing else 0 end) as rp,
  max(case when pu = 1 and idx <= 20 then passing else 0 end) as pu, sum(cast(idx <= 20 as integer)) as w from f group by all),
m as (select file, idx, avg(passing) as m from f group by all), e as (select file, avg(m) * 100 as one, stddev_pop(m) / sqrt(count(*)) * 100 as err from m group by file),
r as (select file, count(*) as size, avg(c / n) * 100 as pass_at_k, case when file <> 'b' then avg(rm) * 100 end as rm, case when file = 'a' then avg(rp) * 100 end as rm_public, avg(ml) * 100 as ml, case when file <> 'c' then sum(pu * w) / sum(w) * 100 end as public from i group by file)"""


@query(f"{_REPORT_SQL} select file, cast(null as varchar) as error, size, round(pass_at_k, 6) as pass_at_k, round(rm, 6) as rm, round(rm_public, 6) as rm_public, round(ml, 6) as ml, round(public, 6) as public, round(one, 6) as pass_one, round(err, 6) as stderr from r join e using (file) union all select 'z', 'no items', null, null, null, null, null, null, null, null")
def file_reports(spark, d):
    out = M.file_report(_reports(spark, d), 1, 20)
    return _rounded(out, "pass_at_k", "rm", "rm_public", "ml", "public", "pass_one", "stderr")


@query(f"{_REPORT_SQL} select file, coalesce(cast(size as varchar), 'N/A') as size, coalesce(cast(cast(round(rm) as integer) as varchar), 'N/A') as rm, coalesce(cast(cast(round(rm_public) as integer) as varchar), 'N/A') as rm_public from r")
def report_csv(spark, d):
    path = scratch(spark, "report")
    out = M.report(_flat(_reports(spark, d)), 1, 20, ["file"], "orm_score")
    R.write_report(out.select("file", F.col("items").alias("size"), F.round("rm").cast("int").alias("rm"), F.round("rm_public").cast("int").alias("rm_public")), path)
    return spark.read.option("header", True).csv(path)


def _flat(documents):
    items = documents.select("file", F.posexplode("items").alias("row_idx", "i"))
    return items.select("file", F.col("i.unique_name").alias("item"), F.posexplode("i.results").alias("p", "r")).select("file", "item", (F.col("p") + 1).alias("idx"), "r.*")


def _raw_benchmark(spark, d):
    """Raw rows with public tests as JSON and private ones as a blob; those of every second item name a function."""
    b = X.table(spark, d, "benchmark")
    even, n = F.col("item_id") % 2 == 0, F.col("item_id").cast("string")
    public = F.when(even, F.concat(F.lit('[{"input": "1\\n['), n, F.lit(']", "output": "'), n, F.lit('"}]'))).otherwise(F.concat(F.lit('[{"input": "'), n, F.lit('\\n2", "output": "yes"}]')))
    private = F.when(even, F.lit('[{"input": "7\\n[]", "output": "true"}]')).otherwise(F.lit('[{"input": "a", "output": "b"}]'))
    rows = b.select("item_id", public.alias("public_test_cases"), private.alias("plain"), F.when(even, '{"func_name": "f"}').otherwise("{}").alias("metadata"))
    return rows.withColumn("private_test_cases", pyudfs.encoded_blob_udf("plain")).drop("plain")


@query(
    """select item_id, case when item_id % 2 = 0 then '{"inputs": [[7, []], [1, [' || item_id || ']]], "outputs": [true, ' || item_id || '], "fn_name": "f"}' else '{"inputs": ["a", "' || item_id || '\\n2"], "outputs": ["b", "yes"]}' end as input_output,
  case when item_id % 2 = 0 then '{"inputs": [[1, [' || item_id || ']]], "outputs": [' || item_id || '], "fn_name": "f"}' else '{"inputs": ["' || item_id || '\\n2"], "outputs": ["yes"]}' end as public_input_output from benchmark"""
)
def raw_benchmark(spark, d):
    return P.raw_benchmark_problems(_raw_benchmark(spark, d)).select("item_id", "input_output", "public_input_output")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where event_id % 3 <> 0")
def json_filters(spark, d):
    e = X.table(spark, d, "events").withColumn("other", F.when(F.col("event_id") % 3 == 0, '{"j": 1, "list": []}').otherwise(F.concat(F.lit('{"k": null, "list": '), F.lit("[1]"), F.lit("}"))))
    kept = P.without_empty_lists(P.with_key(e, "other", "k").withColumn("list", F.get_json_object("other", "$.list")), "list")
    return kept.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select event_id, ts as at from events")
def parsed_times(spark, d):
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return X.table(spark, d, "events").select("event_id", scoring.to_time(shown, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"))


@query("select md5(text) as hash, count(*) as n from conversations group by 1")
def hashed_texts(spark, d):
    return M.frequency(X.table(spark, d, "conversations").withColumn("hash", text.md5_hex("text")), "hash")
