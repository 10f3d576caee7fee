"""A prefix trie of conversations, built level by level.

Conversations alike in all their turns are one class, named by its smallest id, so copies travel once. Per depth the
live classes are grouped by (parent node, next turn); the smallest id names the node. A class that is alone in its node
leaves the loop: all below is a chain, known in closed form from running sums. Leaves and savings are rolled up by
joins from the deepest level of the loop to the root. Turns travel as digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.session import checkpoint, shuffle_partitions

FEW = 1000  # a key is heavy if it holds this share of the rows, one in FEW, or more; so at most FEW keys are heavy
BLOCK = 8192  # ids in one part of a list to be hashed
WORDS = r"[^\x20\x09-\x0D]+"


def _skewed(rows: DataFrame, side: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows joined with `side`, which has one row a key: the at most FEW keys that hold total / FEW rows by their column
    `size` are broadcast, so a heavy key stays where its rows are; the others are shuffled."""
    heavy = F.broadcast(side.where(F.col(size) * FEW >= total))
    rest = rows.join(heavy.select(*on), on, "left_anti").join(side.where(F.col(size) * FEW < total), on)
    return rows.join(heavy, on).unionByName(rest)


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, words, cum) of each turn: its place in the conversation from 1, by `turn` (null first), then
    role and text; a digest of role and text (null is empty); its words; and the words up to and with it. Rows without a
    conversation are left out; repeated rows are turns each.

    The table is range-partitioned and numbered in order of its partitions, so a conversation of any length is spread."""
    spark = conversations.sparkSession
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text")).where("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    lean = dealt.select(F.spark_partition_id().alias("part"), "conv_id", digest.alias("digest"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))
    local = checkpoint(lean.mapInArrow(_counted, "part int, conv_id long, digest binary, words long, pos long, cum long"))
    # only the first conversation of a partition can have begun before it
    first = F.broadcast(local.groupBy("part").agg(F.min("conv_id").alias("conv_id")).select("conv_id").distinct())
    sums = local.join(first, "conv_id").groupBy("conv_id", "part").agg(F.max("pos").alias("p"), F.max("cum").alias("c"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("conv_id", "part", F.sum("p").over(before).alias("p"), F.sum("c").over(before).alias("c"))  # two rows a partition at most
    told = local.join(F.broadcast(ahead), ["conv_id", "part"], "left")
    return told.select("conv_id", (F.col("pos") + F.coalesce("p", F.lit(0))).alias("pos"), "digest", "words", (F.col("cum") + F.coalesce("c", F.lit(0))).alias("cum"))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and running words inside a sorted partition."""
    last, n, total = None, 0, 0
    for batch in batches:
        ids, words = batch.column(1).to_numpy(), batch.column(3).to_numpy()
        if not len(ids):
            continue
        at = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        run = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ids))))
        sums = np.cumsum(words)
        pos = np.arange(len(ids)) - at[run] + 1
        cum = sums - (sums - words)[at][run]
        if ids[0] == last:
            pos[run == 0] += n
            cum[run == 0] += total
        last, n, total = ids[-1], int(pos[-1]), int(cum[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos.astype(np.int64)), pa.array(cum.astype(np.int64))], ["part", "conv_id", "digest", "words", "pos", "cum"])


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The turns of rebuilt conversations, in the columns of `numbered`: conversation c takes the first h turns of
    conversation c - c % every (all if it has fewer, none if it is not there) in place of its own first h, where h is
    the crc32 of c's decimal digits modulo `most`."""
    total = turns.count()
    h = F.expr(f"crc32(cast(cast(conv_id as string) as binary)) % {most}")
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("size"), F.max(F.when(F.col("pos") <= h, F.col("cum"))).alias("skipped"))
    own = checkpoint(own.withColumn("h", h).withColumn("head", F.expr(f"conv_id - conv_id % {every}")))
    opening = turns.where(f"conv_id % {every} = 0 and pos < {most}").select(F.col("conv_id").alias("head"), "pos", "digest", "words", "cum")  # each serves fewer than 2 * every conversations
    begun = checkpoint(own.where("h > 0").join(opening, "head").where("pos <= h").select("conv_id", "pos", "digest", "words", "cum"))
    taken = begun.groupBy("conv_id").agg(F.max("pos").alias("taken"), F.max("cum").alias("gained"))
    shift = own.join(taken, "conv_id", "left").select("conv_id", "size", "h", (F.coalesce("taken", F.lit(0)) - F.col("h")).alias("by"), (F.coalesce("gained", F.lit(0)) - F.coalesce("skipped", F.lit(0))).alias("more"))
    rest = _skewed(turns, checkpoint(shift), ["conv_id"], "size", total).where("pos > h")
    return begun.unionByName(rest.select("conv_id", (F.col("pos") + F.col("by")).alias("pos"), "digest", "words", (F.col("cum") + F.col("more")).alias("cum")))


def _hashed_lists(members: DataFrame) -> DataFrame:
    """(rep, ends): SHA-256 of each class's ids in numeric order, joined by commas. Ids are joined to blocks in parallel;
    only the blocks of a class meet, and are hashed as they stream by."""
    n = shuffle_partitions(members.sparkSession)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, ids = batch.column(0).to_numpy(), batch.column(1)
            cut = np.flatnonzero(np.diff(reps, prepend=reps[0] - 1)) if len(reps) else reps
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(reps)], strict=True):
                for i in range(a, b, BLOCK):
                    part = ids.slice(i, min(BLOCK, b - i)).to_pylist()
                    yield pa.RecordBatch.from_pydict({"rep": [int(reps[a])], "first": [part[0]], "ids": [",".join(map(str, part))]})

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if rep == now:
                    state.update(b",")
                else:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict({"rep": [now], "ends": [state.hexdigest()]})
                    now, state = rep, hashlib.sha256()
                state.update(ids.encode())
        if state is not None:
            yield pa.RecordBatch.from_pydict({"rep": [now], "ends": [state.hexdigest()]})

    parts = members.select("rep", "conv_id").repartitionByRange(n, "rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(blocks, "rep long, first long, ids string")
    return parts.repartition(n, "rep").sortWithinPartitions("rep", "first").mapInArrow(hashes, "rep long, ends string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), all numbers long.

    `turns` as given by `numbered`; `conversations` are all conv_ids, those without turns too, each once. A node is a
    distinct sequence of first turns, from the root without any; conv_id is its smallest member, parent_conv_id its
    parent's (null for the root). saved_tokens sums (n_convs - 1) * words of the last turn over its subtree; ends_sha256
    is the hash of the ids that end there, in order, joined by commas. No conversation gives an empty result.
    """
    spark = turns.sparkSession
    empty = hashlib.sha256(b"").hexdigest()
    n_turns = turns.count()
    part = F.xxhash64("pos", "digest")
    seen = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sum("words").alias("total"), F.bit_xor(part).alias("a"), F.bit_xor(F.xxhash64("digest", "pos", F.lit(1))).alias("b"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n", "total", "a", "b")}
    convs = checkpoint(conversations.join(seen, "conv_id", "left").withColumns(zero))
    n_convs = convs.count()
    classes = checkpoint(convs.groupBy("n", "total", "a", "b").agg(F.min("conv_id").alias("rep"), F.count("*").alias("w")))
    members = _skewed(convs, classes.where("w > 1"), ["n", "total", "a", "b"], "w", n_convs)
    lists = _hashed_lists(members).unionByName(classes.where("w = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ends")))
    ended = checkpoint(classes.select("rep", "n", "w", "total").join(lists, "rep"))  # one row a class
    side = ended.select(F.col("rep").alias("conv_id"), "n", "w", "total")
    steps = checkpoint(_skewed(turns, side, ["conv_id"], "n", n_turns).select(F.col("conv_id").alias("rep"), "pos", "digest", "words", "w", "n", (F.col("total") - F.col("cum") + F.col("words")).alias("rest")))

    root = ended.agg(F.min("rep").alias("conv"), F.sum("w").alias("n_convs"), F.max(F.when(F.col("n") == 0, F.col("rep"))).alias("ender")).where("conv is not null")
    root = checkpoint(root.select("conv", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words"), "ender"))
    top = root.first()
    below, live, ahead, n_live, n_ahead = [], None, steps, None, None
    levels = [root]
    depth = 0
    while True:
        depth += 1
        here = ahead.where(F.col("pos") == depth)
        here = here.join(live, "rep") if live is not None else here.withColumn("node", F.lit(top and top.conv).cast("long"))
        ender = F.max(F.when(F.col("n") == depth, F.col("rep")))
        groups = here.groupBy("node", "digest").agg(F.min("rep").alias("conv"), F.sum("w").alias("n_convs"), F.count("*").alias("reps"), F.max("words").alias("words"), F.max("rest").alias("rest"), ender.alias("ender"))
        groups = checkpoint(groups)
        below.append(groups.where("reps = 1").select("conv", F.col("node").alias("parent"), "n_convs", "rest"))
        many = groups.where("reps > 1")
        count = many.agg(F.sum("reps")).first()[0]
        if not count:
            break
        levels.append(many.select("conv", F.col("node").alias("parent"), "n_convs", "words", "ender"))
        n_live = n_live or here.count()
        live = _skewed(here.select("rep", "node", "digest"), many.select("node", "digest", "conv", "reps"), ["node", "digest"], "reps", n_live)
        live = checkpoint(live.select("rep", F.col("conv").alias("node")))
        n_live = count
        if n_ahead is None or n_live * 2 <= n_ahead:  # turns of what is no longer live are left behind when they are half
            ahead = checkpoint(ahead.where(F.col("pos") > depth).join(live.select("rep"), "rep", "left_semi"))
            n_ahead = n_live

    out = []
    carried = None
    for d in range(depth - 1, -1, -1):
        tops = below[d].select("parent", F.lit(1).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("rest")).alias("saved"))
        children = tops if carried is None else tops.unionByName(carried.select("parent", "leaves", "saved"))
        summed = children.groupBy(F.col("parent").alias("conv")).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        node = levels[d].join(summed, "conv", "left")
        carried = checkpoint(node.select("conv", "parent", "n_convs", "ender", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved")))
        out.append(carried.withColumn("depth", F.lit(d).cast("long")))
    shared = out[0]
    for more in out[1:]:
        shared = shared.unionByName(more)
    shared = shared.join(ended.select(F.col("rep").alias("ender"), "ends"), "ender", "left")
    shared = shared.select("conv", "depth", "parent", "n_convs", "n_children", "leaves", "saved", F.coalesce("ends", F.lit(empty)).alias("ends"))

    tops = below[0].select("conv", "parent", F.lit(1).alias("top"))
    for d, more in enumerate(below[1:], 2):
        tops = tops.unionByName(more.select("conv", "parent", F.lit(d).alias("top")))
    tops = checkpoint(tops.withColumnRenamed("conv", "rep").join(ended.select("rep", "n", "ends"), "rep"))
    chain = _skewed(steps.drop("n"), tops, ["rep"], "n", n_turns).where("pos >= top")
    last = F.col("pos") == F.col("n")
    chain = chain.select(F.col("rep").alias("conv"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("parent")).otherwise(F.col("rep")).alias("parent"), F.col("w").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("leaves"), ((F.col("w") - 1) * F.col("rest")).alias("saved"), F.when(last, F.col("ends")).otherwise(F.lit(empty)).alias("ends"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return shared.unionByName(chain).toDF(*names)


def shared_prefixes(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    turns = checkpoint(numbered(conversations))
    return trie(checkpoint(rebuilt(turns, every, most)), turns.select("conv_id").distinct())
