"""Near duplicates by MinHash: signatures, a banded index and exact verification, all in built-in functions.

Documents with the same shingles are one kind. A kind's signature is the minimum of many hashes over its shingles, one
aggregation over exploded shingles; runs of its minima (bands) are the buckets of the index. In a bucket not all pairs
are made: round after round a pivot is held against those members that are not yet in its class, so a group of m near copies
takes about m comparisons. What still shares a bucket but no class after ROUNDS rounds meets in pairs of chunks, as sizes and
bitmaps, which bound what two sets can share; only pairs that may reach the threshold are shuffled and verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import skewed_join
from tessera.plans.lineage import checkpoint, scratch

HASHES = 96  # minima in a signature; more than a hundred columns would leave generated code
ROUNDS = 4
CHUNK = 4096  # members of a bucket that meet members of another chunk in one task
COPIES = 4096  # pairs that one copy of a pivot's shingles serves
FEW = 2_000_000  # ids of candidates that are broadcast, at most, 64 bits each; their number is counted first
WORDS = 32  # of 64 bits, in the bitmap of a set
SURE = 0.95  # least chance that a pair right at the threshold shares a bucket


def banding(threshold: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, minima in each): the longest bands with which a pair at the threshold meets in one with chance SURE."""
    rows = max((r for r in range(1, hashes + 1) if 1 - (1 - threshold**r) ** (hashes // r) >= SURE), default=1)
    return hashes // rows, rows


def shingle_sets(docs: DataFrame, id_: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(id, set): hashes of the distinct runs of `size` words, lower case of A-Z; a text with fewer words has its whole
    sequence as one, one without words or a null one has none. Rows without an id are left out."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, size)))
    return words.select("id", F.when(F.size("w") > 0, F.array_distinct(hashed)).otherwise(F.array().cast("array<long>")).alias("set"))


def kinds_of(sets: DataFrame) -> DataFrame:
    """(id, n, kind, set): a name of the set, 128 bits of hash over its sorted members, null if it is empty."""
    order = F.array_sort("set")
    name = F.concat(F.hex(F.xxhash64(order)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), F.reverse(order))))
    return sets.select("id", F.size("set").alias("n"), F.when(F.size("set") > 0, name).alias("kind"), "set")


def signatures(sets: DataFrame, hashes: int = HASHES) -> DataFrame:
    """(id, sig): for each of `hashes` seeds the least hash of the set's members; sets without any are left out, repeated ones
    count once."""
    minima = [F.min(F.xxhash64("s", F.lit(i))).alias(f"h{i}") for i in range(hashes)]
    spread = sets.select("id", F.explode("set").alias("s")).groupBy("id").agg(*minima)
    return spread.select("id", F.array(*[f"h{i}" for i in range(hashes)]).alias("sig"))


def buckets(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, id): the index, without buckets of a single member."""
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * rows + r] for r in range(rows)]) for b in range(bands)])
    found = checkpoint(signed.select("id", F.explode(keys).alias("bucket")))
    several = found.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    return checkpoint(skewed_join(found, several, ["bucket"], "m", found.count()))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of candidate pairs (a, b, m) those whose Jaccard similarity reaches the threshold, as (a, b, shared, total); m
    bounds the pairs that an `a` has in its bucket, and its shingles are copied for every COPIES of them. An id's set may be
    there several times."""
    pairs = checkpoint(pairs)
    sets = _of(sets, pairs.select(F.explode(F.array("a", "b")).alias("id"))).groupBy("id").agg(F.any_value("set").alias("set"))
    named = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / COPIES)).alias("copy"))
    held = pairs.groupBy("a").agg(F.max(F.ceil(F.col("m") / COPIES)).alias("copies"))
    left = sets.join(held, sets["id"] == held["a"]).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("set").alias("x"))
    both = named.join(left, ["a", "copy"]).join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("sizes"))
    sure = counted.select("a", "b", "shared", (F.col("sizes") - F.col("shared")).alias("total"))
    return sure.where(F.col("shared") >= F.lit(threshold) * F.col("total"))


def _of(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of some ids, so that no others are shuffled; all sets if those ids are too many for a broadcast. Ids are told by
    a hash of 64 bits: a set too many is dropped by the joins on ids."""
    ids = checkpoint(ids.select(F.xxhash64("id").alias("h")).distinct())
    if ids.count() > FEW:
        return sets
    return sets.join(F.broadcast(ids), F.xxhash64(sets["id"]) == ids["h"], "left_semi")


def bitmaps(sets: DataFrame) -> DataFrame:
    """(id, n, over, bits): a set's size, a bit for each remainder that its members have by the number of bits, and by how much
    the size is over the bits set. Two sets share as many members as bits and the lesser `over`, at most."""
    spread = sets.select("id", F.size("set").alias("n"), F.explode("set").alias("s")).select("id", "n", F.expr(f"cast(pmod(s, {64 * WORDS}) as int)").alias("bit"))
    of_word = [F.bit_or(F.when(F.expr(f"bit div 64 = {k}"), F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)]
    words = spread.groupBy("id").agg(F.max("n").alias("n"), *of_word).select("id", "n", F.array(*[f"w{k}" for k in range(WORDS)]).alias("bits"))
    return words.select("id", "n", (F.col("n") - _ones(F.col("bits"))).alias("over"), "bits")


def _ones(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda so_far, word: so_far + F.bit_count(word))


def _may_reach(threshold: float) -> Column:
    """Of bitmaps and of others' (columns with a v before their names): whether the two sets can be `threshold` alike. What shares
    more is more alike, so no pair is lost that `verified` would keep."""
    most = _ones(F.zip_with("bits", "vbits", lambda x, y: x.bitwiseAND(y))) + F.least("over", "vover")
    least = F.lit(threshold) * (F.col("n") + F.col("vn")) - F.lit(1e-6)  # of (1 + threshold) times what they share, with room for rounding
    return (F.lit(1 + threshold) * F.least("n", "vn") >= least) & (F.lit(1 + threshold) * most >= least)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that is reachable over edges, for each id that has one.

    Large stars and small stars by turns: all larger neighbours of a node go to the least of its neighbours, then all
    smaller ones, until every edge leads to its component's least id. A hub's edges are joined where they are."""
    left = checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = left.union(left.select("v", "u"))
        n = left.count()
        near = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("m")).withColumn("low", F.least("low", "u"))
        large = skewed_join(both, near, ["u"], "m", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = checkpoint(large.where("u <> v").distinct())
        near = large.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("m"))
        small = skewed_join(large, near, ["u"], "m", large.count())
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(near.select("u", "low")).where("u <> v")
        now = checkpoint(small.distinct())
        done = now.count() == n and now.exceptAll(left).isEmpty()
        left = now
        if done:
            return left.select(F.col("u").alias("id"), F.col("v").alias("component")).union(left.select("v", "v").distinct())


def _relabelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (id, class) after links between ids."""
    named = classes.select(F.col("id"), F.col("class"))
    ends = links.select("a", "b").join(named.select(F.col("id").alias("a"), F.col("class").alias("x")), "a").join(named.select(F.col("id").alias("b"), F.col("class").alias("y")), "b")
    moved = components(ends.select("x", "y"), "x", "y").select(F.col("id").alias("class"), "component")
    many = named.join(moved, "class", "left")  # a class of very many kinds is one key here; adaptive joins split it
    return checkpoint(many.select("id", F.coalesce("component", "class").alias("class")))


def linked(index: DataFrame, sets: DataFrame, threshold: float, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(classes (id, class), links (a, b, shared, total)) of an index (bucket, id): the connected components of all pairs
    that share a bucket and reach the threshold, and the links that were verified to find them. Pairs inside a class that is
    known already are not compared, so no class is lost and no group is multiplied by itself."""
    classes = checkpoint(index.select("id").distinct().select("id", F.col("id").alias("class")))
    links, left = [], index.select("bucket", "id")
    for k in range(rounds):
        placed = checkpoint(left.join(classes, "id"))
        per = placed.groupBy("bucket").agg(F.min_by(F.struct("id", "class"), F.xxhash64("id", F.lit(k))).alias("p"), F.count("*").alias("m"), F.min("class").alias("low"), F.max("class").alias("high"))
        open_ = checkpoint(per.where("low <> high").select("bucket", "p", "m"))
        if open_.isEmpty():
            return classes, _united(links, sets)
        told = skewed_join(placed, open_, ["bucket"], "m", placed.count())
        left = told.select("bucket", "id")
        pairs = told.where(F.col("class") != F.col("p.class")).select(F.col("p.id").alias("a"), F.col("id").alias("b"), "m").groupBy("a", "b").agg(F.max("m").alias("m"))
        links.append(checkpoint(verified(pairs, sets, threshold)))
        classes = _relabelled(classes, links[-1])
    placed = checkpoint(left.join(classes, "id"))
    apart = placed.groupBy("bucket").agg(F.count("*").alias("m"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    told = checkpoint(skewed_join(placed, apart.select("bucket", "m"), ["bucket"], "m", placed.count()))
    known = checkpoint(bitmaps(_of(sets, told.select("id"))))
    told = told.join(known, "id").withColumn("chunks", F.ceil(F.col("m") / CHUNK)).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(-1)), F.col("chunks")))
    one = told.select("bucket", "id", "class", "m", *known.columns[1:], F.col("chunk").alias("i"), F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("j"))
    other = told.select("bucket", F.col("id").alias("b"), F.col("class").alias("c"), *[F.col(c).alias(f"v{c}") for c in known.columns[1:]], F.col("chunk").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunk"))).alias("i"))
    rest = one.join(other, ["bucket", "i", "j"]).where(F.expr("class <> c and (i <> j or id < b)") & _may_reach(threshold))
    rest = rest.select(F.col("id").alias("a"), "b", "m").groupBy("a", "b").agg(F.max("m").alias("m"))
    links.append(checkpoint(verified(rest, sets, threshold)))
    return _relabelled(classes, links[-1]), _united(links, sets)


def _united(links: list[DataFrame], sets: DataFrame) -> DataFrame:
    out = sets.sparkSession.createDataFrame([], "a string, b string, shared int, total int")
    for more in links:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, hashes: int = HASHES) -> DataFrame:
    """(id, n_shingles, class_id) of each row with an id: its distinct shingles and the smallest id of its near-duplicate class, the
    component of pairs that share a bucket of the index and whose Jaccard similarity is `threshold` or more.

    A pair below the threshold is never linked; one at or above it shares a bucket with chance SURE or more, and the surer
    the more alike it is. Texts without words are alone; rows of one id count each; extra columns take no part; an empty
    table gives an empty result."""
    kinds, sets, index = indexed(docs, id_, text, size, threshold, hashes)
    classes, _ = linked(index, sets, threshold)
    named = kinds.join(classes.withColumnRenamed("id", "kind"), "kind", "left").select("id", "n", F.coalesce("class", "kind").alias("class"))
    named = checkpoint(named)
    least = named.where("n > 0").groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("m"))
    full = skewed_join(named.where("n > 0"), least, ["class"], "m", named.count())
    every = full.select("id", "n", "class_id").unionByName(named.where("n = 0").select("id", "n", F.col("id").alias("class_id")))
    return every.select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), "class_id")


def indexed(docs: DataFrame, id_: str, text: str, size: int, threshold: float, hashes: int = HASHES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (id, n, kind), sets of the kinds (id, set), banded index (bucket, id)), where the id of a set is its kind's name. Sets
    are written once, row by row, so a kind of several rows has its set several times; no set is shuffled for that."""
    spark = docs.sparkSession
    path = scratch(spark, "shingles")
    kinds_of(shingle_sets(docs, id_, text, size)).write.parquet(path)
    rows = spark.read.parquet(path)
    sets = rows.where("n > 0").select(F.col("kind").alias("id"), "set")
    return rows.drop("set"), sets, buckets(signatures(sets, hashes), *banding(threshold, hashes))
