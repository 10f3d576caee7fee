"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, bpe, chat, decontaminate, html_extract, langid, licenses, ngram_join, prefix_trie, substring_dedup, token_counts, topk, toxicity
from tessera.llm.session import table

VOCABULARY = "byte_bpe_50k.tiktoken"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def crc_mod(column: str, n: int):
    return F.expr(f"pmod(crc32(cast(cast({column} as string) as binary)), {n})")


def remains(column: str, n: int, rest: int):
    """Whether a row is held out by its id; a row without an id is not, and is not learnt from either."""
    return F.coalesce(crc_mod(column, n) == rest, F.lit(False))


def language_model(documents: DataFrame) -> langid.Model:
    return langid.train(documents.where(crc_mod("doc_id", 5) != 0))


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(documents, labels.where(crc_mod("doc_id", 4) != 2))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.paired(table(spark, sf_dir, "conversations"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def license_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences in other dress, made from the items' ids, as no table holds any."""
    return licenses.scan(licenses.variants(table(spark, sf_dir, "benchmark")), id_="item_id").select("item_id", "license_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    named = langid.predict(documents, language_model(documents))
    return named.select("doc_id", remains("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity_model(documents, table(spark, sf_dir, "labels")))
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scored.select("doc_id", remains("doc_id", 4, 2).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), shown.alias("span_offsets"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "pmod(vec_id, 50) = 0", k=5)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ALIGNED)
    hashed = lambda c: F.when(F.length(c) > 0, F.sha2(c, 256)).otherwise("")
    return alignment.link_strength(table(spark, sf_dir, "documents"), *paths, groups="groups_sha256", shown=hashed)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


OP8_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w
), kinds as (select list_sort(s) as k, min(doc_id) as rep, any_value(len(s)) as n from s group by 1
), g as (select rep, n, unnest(k) as x from kinds where n > 0
), often as (select x from g group by x having count(*) > 1
), pairs as (select a.rep as a, b.rep as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i
  from g a join often using (x) join g b on a.x = b.x and a.rep < b.rep and 85 * greatest(a.n, b.n) <= 100 * least(a.n, b.n) group by 1, 2
), links as (select a, b from pairs where 100 * i >= 85 * (na + nb - i)
), edges as (select a, b from links union all select b, a from links
), reach as (select rep as a, rep as m from kinds union select e.b, r.m from reach r join edges e on e.a = r.a
), least as (select a, min(m) as m from reach group by 1)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, case when len(s.s) = 0 then s.doc_id else least.m end as component_id
from s join kinds on kinds.k = list_sort(s.s) join least on least.a = kinds.rep
"""


def op10_sql() -> str:
    return """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""


OP12_SQL = r"""
with filled as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), t as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as p from filled
), c as (  -- crc32 by its definition: one shift a bit of the digits
  select conv_id, list_reduce(list_concat([4294967295::ubigint], flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::ubigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384::ubigint)) as crc, conv_id - conv_id % 20 as head, max(p) as n from t group by conv_id
), h as (select conv_id, head, n, xor(crc, 4294967295::ubigint)::bigint % 4 as h from c
), rebuilt as (
  select h.conv_id, t.p, t.role, t.text from h join t on t.conv_id = h.head and t.p <= h.h
  union all select h.conv_id, t.p - h.h + least(h.h, coalesce(o.n, 0)), t.role, t.text from h join t on t.conv_id = h.conv_id and t.p > h.h left join h o on o.conv_id = h.head
), lists as (
  select h.conv_id, coalesce(list(sha256(concat(strlen(r.role), ':', r.role, r.text)) order by r.p) filter (r.p is not null), []) as l from h left join rebuilt r using (conv_id) group by 1
), paths as (
  select conv_id, d, sha256(array_to_string(l[1:d], ',')) as k, case when d > 0 then sha256(array_to_string(l[1:d - 1], ',')) end as up, d = len(l) as ends
  from (select conv_id, l, unnest(range(0, len(l) + 1)) as d from lists)
), nodes as (
  select d, k, any_value(up) as up, min(paths.conv_id) as conv, count(*) as n, any_value(case when d > 0 then len(regexp_extract_all(r.text, '[^\x20\x09-\x0D]+')) else 0 end) as words,
    sha256(coalesce(string_agg(paths.conv_id::varchar, ',' order by paths.conv_id) filter (ends), '')) as ends_sha256
  from paths left join rebuilt r on r.conv_id = paths.conv_id and r.p = d group by d, k
), kids as (select up, d - 1 as d, count(*) as n from nodes group by all
), under as (select distinct a.d, a.k, b.d as bd, b.k as bk from paths a join paths b on a.conv_id = b.conv_id and a.d <= b.d
), sums as (
  select u.d, u.k, sum((b.n - 1) * b.words) as saved, count(*) filter (kids.n is null) as leaves
  from under u join nodes b on b.d = u.bd and b.k = u.bk left join kids on kids.up = b.k and kids.d = b.d group by all
)
select x.conv as conv_id, x.d as depth, p.conv as parent_conv_id, x.n as n_convs, coalesce(kids.n, 0) as n_children, s.leaves as n_leaves, cast(s.saved as bigint) as saved_tokens, x.ends_sha256
from nodes x join sums s on s.d = x.d and s.k = x.k left join nodes p on p.d = x.d - 1 and p.k = x.up left join kids on kids.up = x.k and kids.d = x.d
"""

OP13_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), win as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w)
), least as (select k, min(doc_id) as m from win group by 1
), gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from win join least using (k) where m < doc_id
), per as (select doc_id, list(p) as ps, list_sort(list(p)) as s from gone group by 1
), spans as (select doc_id, len(list_filter(s, lambda x, i: i = 1 or s[i - 1] < x - 1)) as n from per
), kept as (
  select w.doc_id, len(w.w) as n, coalesce(len(per.ps), 0) as g, list_filter(w.w, lambda x, i: per.ps is null or not list_contains(per.s, i)) as k from w left join per using (doc_id)
)
select kept.doc_id, cast(kept.n as bigint) as n_words, cast(g as bigint) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256, cast(coalesce(spans.n, 0) as integer) as n_spans
from kept left join spans using (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_chat_formatting, op3_license_scan, op4_decontamination, op5_language_id, op6_toxicity, op7_html_extraction, op8_ngram_jaccard, op9_token_counts, op10_exact_topk, op11_token_alignment, op12_prefix_trie, op13_substring_dedup, license_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.SQL, "op3_license_scan": licenses.sql(), "op8_ngram_jaccard": OP8_SQL, "op10_exact_topk": op10_sql(), "op12_prefix_trie": OP12_SQL, "op13_substring_dedup": OP13_SQL, "license_variants": licenses.variants_sql()}
