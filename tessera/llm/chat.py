"""Preference formatting of chat conversations, with DataFrame functions alone.

A pair of conversations, one chosen and one rejected, is cut at their longest common prefix of turns. The prefix is
rendered once as the prompt; what follows in either is rendered as a completion, with the spans of its assistant
turns, which alone carry loss, as a mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "<|{role}|>\n{text}<|end|>\n"  # a turn as rendered


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): the turns of each conversation in order, as structs of role and text."""
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    listed = turns.where(F.col(conv).isNotNull()).groupBy(F.col(conv).cast("long").alias("conv")).agg(F.array_sort(F.collect_list(item)).alias("turns"))
    return listed.select("conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _completion(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, _rendered))


def _mask(turns: Column) -> Column:
    """Spans 'start-end' (code points of the completion, end exclusive) of assistant texts and their end marks."""
    sized = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.length(t["role"]).alias("head"), F.length(t["text"]).alias("body")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + t["head"] + 5  # '<|', '|>' and the line feed
        last = first + t["body"] + 7  # '<|end|>'
        span = F.concat_ws("-", first.cast("string"), last.cast("string"))
        return F.struct((last + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.concat_ws(",", F.aggregate(sized, begin, step)["spans"])


def preference_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", key: str = "pair_id") -> DataFrame:
    """(key, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) of pairs of turn arrays.

    n_common turns at the head are equal in role and text. If one conversation is a prefix of the other, its
    completion and mask are empty. Pairs that lack a side are left out. Ties don't arise; repeated pairs come
    through each; other columns are dropped."""
    both = pairs.where(F.col(chosen).isNotNull() & F.col(rejected).isNotNull())
    shorter = F.least(F.size(chosen), F.size(rejected))
    differs = F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | F.coalesce(F.get(F.col(chosen), i) != F.get(F.col(rejected), i), F.lit(True)))
    cut = both.select(F.col(key), F.col(chosen).alias("c"), F.col(rejected).alias("r"), differs[0].alias("n"))
    tails = cut.select(key, "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), F.slice("c", F.col("n") + 1, F.size("c")).alias("c"), F.slice("r", F.col("n") + 1, F.size("r")).alias("r"))
    return tails.select(key, F.col("n").alias("n_common"), _completion(F.col("p")).alias("prompt"), _completion(F.col("c")).alias("chosen"), _completion(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def paired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and the rejected side of pair k, then formatted.

    A conversation without its partner, and turns with a null conversation, are left out. Turns sort by turn,
    a null one first, then role and text; null roles and texts count as empty; repeated turns stay."""
    listed = conversations(turns, conv, turn, role, text)
    side = F.expr("pmod(conv, 2)")
    sides = listed.groupBy(F.expr("conv - pmod(conv, 2)").alias("pair")).agg(F.max(F.when(side == 0, F.col("turns"))).alias("chosen"), F.max(F.when(side == 1, F.col("turns"))).alias("rejected"))
    return preference_pairs(sides.select(F.expr("cast(pair / 2 as bigint)").alias("pair_id"), "chosen", "rejected"))


SQL = """
with item as (
  select conv_id as conv, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null
), sided as (
  select *, (conv - ((conv % 2) + 2) % 2) // 2 as pair_id, ((conv % 2) + 2) % 2 as side, count(*) over (partition by conv) as n from item
), sizes as (
  select pair_id, max(n) filter (where side = 0) as nc, max(n) filter (where side = 1) as nr from sided group by pair_id
  having count(distinct side) = 2
), differs as (
  select a.pair_id, min(a.pos) as pos from sided a join sided b on a.pair_id = b.pair_id and a.pos = b.pos
  where a.side = 0 and b.side = 1 and (a.role <> b.role or a.text <> b.text) group by a.pair_id
), cut as (
  select s.pair_id, cast(coalesce(d.pos - 1, least(nc, nr)) as integer) as n_common from sizes s left join differs d using (pair_id)
), turned as (
  select s.*, c.n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as shown from sided s join cut c using (pair_id)
), placed as (
  select *, cast(coalesce(sum(length(shown)) over (partition by conv, pos > n_common order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as before from turned
)
select pair_id, max(n_common) as n_common,
  coalesce(string_agg(shown, '' order by pos) filter (where side = 0 and pos <= n_common), '') as prompt,
  coalesce(string_agg(shown, '' order by pos) filter (where side = 0 and pos > n_common), '') as chosen,
  coalesce(string_agg(shown, '' order by pos) filter (where side = 1 and pos > n_common), '') as rejected,
  coalesce(string_agg((before + length(role) + 5) || '-' || (before + length(shown) - 1), ',' order by pos) filter (where side = 0 and pos > n_common and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg((before + length(role) + 5) || '-' || (before + length(shown) - 1), ',' order by pos) filter (where side = 1 and pos > n_common and role = 'assistant'), '') as rejected_mask
from placed group by pair_id
"""
