"""N-gram Jaccard join: exact links between texts whose sets of word shingles are alike, and their groups.

The document by n-gram incidence matrix A is never multiplied whole. Under one order of all shingles (those
found frequent come last, the rest by hash) two sets can only reach the threshold if they share a shingle in
several leading columns (in one, for a set that is nearly all frequent ones, so those are left out as long as they
can be), so a first product over the leading columns alone, one block of columns a task,
accumulates how many a pair shares: a pair is discarded where that count, the sizes and the position of the
last shared column bound the overlap below what the threshold needs. Connected candidates make blocks of rows; in each block
the sparse product A A' is accumulated exactly, row by row, and pairs below the threshold are discarded.
A frequent column emits a chain over its rows in order of size instead of all its pairs, and copies of one
set are one row. In a component of many sets pivots come first: one set a round is held against all others, and those that link to
it are one class, whose sets need not meet again, so a group of near copies takes a pass over it for each pivot. What is
left meets in pairs of bounded chunks of like sizes; chunks too far apart in size, or of one class, never meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.llm.components import connected_components
from tessera.llm.session import checkpoint, ship, shuffle_partitions, spread, tidy

FREQUENT = 64  # a column in more sets than this comes late in the order; a column with more rows is chained
SHARED = 4  # columns that two sets must share among their leading ones (all they need, if that is less); fewer for a set whose last leading ones would be frequent
LATE_COLUMNS = 100_000  # at most this many columns are moved to the end (order only; no pair depends on it)
FEW_IDS = 1_000_000  # ids that are broadcast, at most; their number is counted first
BLOCK = 128  # rows of a chunk; a block of the product is one chunk or a pair
PIVOTS = 6  # rounds in which sets of large components are held against one of them
PIVOT_MOST = 4096  # shingles of a pivot
HEAVY = 1000  # a component with this share of the sets, one in HEAVY, meets its pivot by a broadcast


class Sets:
    """The shingle sets of a batch's texts: distinct hashes of each text in ascending order, one after another."""

    def __init__(self, column: pa.Array, size: int):
        data, offsets = hashing.buffers(column)
        found = []
        for a, b in hashing.runs(offsets):
            body = data[offsets[a] : offsets[b]]
            start, end, by_text = hashing.words(body, offsets[a : b + 1] - offsets[a])
            shingles, at = hashing.shingle_hashes(hashing.word_hashes(body, start, end), by_text, size)
            found += [np.unique(shingles[i:j]) for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]
        self.sets: list[np.ndarray] = found

    def prints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Size and two 64-bit fingerprints of each set."""
        n = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        flat = np.concatenate([*self.sets, np.zeros(1, np.uint64)])
        at = np.concatenate([[0], np.cumsum(n)])
        sums = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashing.mix(flat ^ np.uint64(salt)))])
            sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
        return n, sums[0], sums[1]


def _leading(n: int, percent: int, shared: int = SHARED) -> int:
    """Columns of a set of n that must hold `shared` shared ones, whatever size the partner has."""
    return min(n, n - -(-percent * n // 100) + shared)


def _wanted(n: int, rare: int, percent: int) -> int:
    """How many shared columns are asked of a set of n of which `rare` are not frequent: SHARED, or as many less as keep
    frequent columns out of its leading ones, one at least. Two sets share the lesser number in their leading columns."""
    wanted = SHARED
    while wanted > 1 and _leading(n, percent, wanted) > rare:
        wanted -= 1
    return wanted


def _linkable(n: int, percent: int) -> bool:
    """Whether a set of n can reach the threshold with any other set at all: at best with one that has one more."""
    return n > 0 and 100 * n >= percent * (n + 1)


def _prints(docs: DataFrame, id_: str, text: str, size: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.pieces(batches, 1):
            n, a, b = Sets(batch.column(1), size).prints()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(a), pa.array(b)], ["id", "n", "fa", "fb"])

    return spread(docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("t"))).mapInArrow(tidy(run), "id long, n long, fa long, fb long")


def _low_columns(docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """The lowest hashes of each set, twice as many as lead it: where the frequent columns are looked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in hashing.pieces(batches, 0):
            sets = Sets(batch.column(0), size)
            n, fa, _ = sets.prints()
            new = []
            for s, f in zip(sets.sets, fa.tolist(), strict=True):
                if _linkable(len(s), percent) and f not in seen:
                    seen.add(f)
                    new.append(s[: 2 * _leading(len(s), percent)])
            if len(seen) > 1 << 20:
                seen.clear()
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(new).view(np.int64))], ["h"])

    return spread(docs.select(F.col(text).cast("string").alias("t"))).mapInArrow(tidy(run), "h long")


def _late(low: DataFrame) -> np.ndarray:
    """The most frequent columns, ascending by frequency; a bounded list."""
    counts = low.repartition(shuffle_partitions(low.sparkSession), "h").groupBy("h").count().where(F.col("count") > FREQUENT)
    top = counts.orderBy(F.desc("count"), "h").limit(LATE_COLUMNS).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


def _columns(docs: DataFrame, text: str, size: int, percent: int, late: np.ndarray) -> DataFrame:
    """(h, place, fa): each set's leading columns with the set's size, the number of shared columns asked of it, and the
    column's position: (size * 8 + number) * 2^32 + position."""
    order = np.argsort(late)
    by_hash = late[order]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in hashing.pieces(batches, 0):
            sets = Sets(batch.column(0), size)
            n, fa, _ = sets.prints()
            hs, places, owners = [], [], []
            for s, f in zip(sets.sets, fa.tolist(), strict=True):
                if not _linkable(len(s), percent) or f in seen:
                    continue
                seen.add(f)
                rare = len(s)
                if len(by_hash):
                    at = np.minimum(np.searchsorted(by_hash, s), len(by_hash) - 1)
                    is_late = by_hash[at] == s
                    moved = np.sort(order[at[is_late]])
                    s = np.concatenate([s[~is_late], late[moved]])
                    rare -= len(moved)
                wanted = _wanted(len(s), rare, percent)
                lead = _leading(len(s), percent, wanted)
                hs.append(s[:lead])
                places.append(((len(s) * 8 + wanted) << 32) + np.arange(lead, dtype=np.int64))
                owners.append(np.full(lead, f, np.int64))
            if len(seen) > 1 << 20:
                seen.clear()
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(places)), pa.array(np.concatenate(owners))], ["h", "place", "fa"])

    return spread(docs.select(F.col(text).cast("string").alias("t"))).mapInArrow(tidy(run), "h long, place long, fa long")


def _candidates(columns: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets (a, b) whose connections hold every pair that can reach the threshold."""

    def once(h: np.ndarray, place: np.ndarray, fa: np.ndarray) -> list[np.ndarray]:
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (place[1:] != place[:-1]) | (fa[1:] != fa[:-1])])[: len(h)]
        return [h[new], place[new], fa[new]]

    names = ["a", "b", "c", "sa", "sb", "need", "wanted"]

    def pairs(h: np.ndarray, place: np.ndarray, fa: np.ndarray) -> pa.RecordBatch:
        """Of whole columns, sorted by (h, place, fa), each row once: pairs with the columns they share here, what is
        left of each set behind the last of them, and the overlap that the threshold needs."""
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        rows = np.diff(edge)
        many = np.repeat(rows, rows)
        keep = many > 1
        h, n, k, i, fa, many = h[keep], place[keep] >> 35, place[keep] >> 32 & 7, place[keep] & 0xFFFFFFFF, fa[keep], many[keep]
        same = h[1:] == h[:-1]
        chain = np.flatnonzero(same & (many[1:] > FREQUENT) & (percent * n[1:] <= 100 * n[:-1]))
        whole = np.full(len(chain), 1 << 20, np.int64)  # a chain's edge stands as it is
        out = [np.stack([fa[chain], fa[chain + 1], whole, whole, whole, np.zeros(len(chain), np.int64), np.ones(len(chain), np.int64)])]
        few = np.flatnonzero(many <= FREQUENT)
        h, n, k, i, fa = h[few], n[few], k[few], i[few], fa[few]
        for d in range(1, FREQUENT):
            x = np.flatnonzero(h[d:] == h[:-d])
            if not len(x):
                break
            y = x + d
            need = -(-percent * (n[x] + n[y]) // (100 + percent))
            ok = (np.minimum(n[x] - i[x], n[y] - i[y]) > need - SHARED) & (percent * n[y] <= 100 * n[x]) & (fa[x] != fa[y])
            x, y, need = x[ok], y[ok], need[ok]
            out.append(np.stack([fa[x], fa[y], np.ones(len(x), np.int64), n[x] - 1 - i[x], n[y] - 1 - i[y], need, np.minimum(k[x], k[y])]))
        a, b, c, sa, sb, need, wanted = np.concatenate(out, axis=1)
        turned = a > b
        a, b, sa, sb = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, sb, sa), np.where(turned, sa, sb)
        order = np.lexsort((b, a))
        a, b, c, sa, sb, need, wanted = (v[order] for v in (a, b, c, sa, sb, need, wanted))
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        if len(first):
            c, sa, sb, need, wanted = np.add.reduceat(c, first), np.minimum.reduceat(sa, first), np.minimum.reduceat(sb, first), np.maximum.reduceat(need, first), np.minimum.reduceat(wanted, first)
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), *(pa.array(np.minimum(v, 1 << 20).astype(np.int32)) for v in (c, sa, sb, need, wanted))], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = once(*(np.concatenate([k, np.asarray(c)]) for k, c in zip(held, batch.columns, strict=True)))
            if len(held[0]) < 200_000:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last column may go on
            if cut:
                yield pairs(*(k[:cut] for k in held))
                held = [k[cut:] for k in held]
            else:  # one long column: what is here is chained, its last rows go on
                yield pairs(*held)
                held = [k[-FREQUENT - 2 :] for k in held]
        if len(held[0]):
            yield pairs(*held)

    dealt = columns.repartition(shuffle_partitions(columns.sparkSession), "h").sortWithinPartitions("h", "place", "fa")
    found = dealt.mapInArrow(tidy(run), "a long, b long, c int, sa int, sb int, need int, wanted int")
    shared = found.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("sa").alias("sa"), F.min("sb").alias("sb"), F.max("need").alias("need"), F.min("wanted").alias("wanted"))
    return shared.where((F.col("c") >= F.least("need", "wanted")) & (F.col("c") + F.least("sa", "sb") >= F.col("need"))).select("a", "b")


def product_links(ids: list, chunk: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Links inside a block of rows, as few as connect what is linked. `chunk` has two values where only pairs
    across the two halves are wanted. Overlaps come from a sparse product, one row of A A' at a time, over the
    rows with sizes within the bounds."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order])
    half = chunk[order]
    across = len(np.unique(half)) > 1
    flat = np.concatenate([sets[k] for k in order])
    rows = np.repeat(np.arange(len(order)), sizes)
    by = np.lexsort((rows, flat))
    columns, rows_by = flat[by], rows[by]
    edge = np.flatnonzero(np.concatenate([[True], columns[1:] != columns[:-1], [True]]))
    number = np.empty(len(flat), np.int64)
    number[by] = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    place = np.empty(len(flat), np.int64)
    place[by] = np.arange(len(flat))
    first = np.concatenate([[0], np.cumsum(sizes)])
    parent = list(range(len(order)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for x in range(len(order) - 1):
        own = slice(first[x], first[x + 1])
        most = int(np.searchsorted(percent * sizes, 100 * sizes[x], side="right"))
        if most <= x + 1:
            continue
        begin, end = place[own] + 1, edge[number[own] + 1]  # later (larger) rows of each column
        length = end - begin
        total = int(length.sum())
        if not total:
            continue
        jump = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        overlap = np.bincount(rows_by[jump + np.arange(total)], minlength=len(order))[x + 1 : most]
        y = np.flatnonzero((100 + percent) * overlap >= percent * (sizes[x] + sizes[x + 1 : most])) + x + 1
        if across:
            y = y[half[y] != half[x]]
        for k in y.tolist():
            p, q = root(x), root(k)
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((ids[order[x]], ids[order[k]]))
    return links


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """rows: (component, i, j, id, chunk, shingles) -> links (a, b), from each block (component, i, j)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                links = product_links([r[0] for r in held], np.array([r[1] for r in held]), [r[2] for r in held], percent)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

        for batch in batches:
            c, i, j, ids, chunk = (batch.column(k).to_pylist() for k in range(5))
            data, at = hashing.buffers(batch.column(5))
            for r in range(batch.num_rows):
                if (c[r], i[r], j[r]) != key:
                    yield from done()
                    key, held = (c[r], i[r], j[r]), []
                held.append((ids[r], chunk[r], np.frombuffer(data[at[r] : at[r + 1]].tobytes(), np.uint64)))
        yield from done()

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInArrow(tidy(run), "a long, b long")


def _few(rows: DataFrame) -> DataFrame:
    """Rows to be broadcast if they are counted to be few; else the join shuffles."""
    return F.broadcast(rows) if rows.count() <= FEW_IDS else rows


def _pivoted(large: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of sets (component, id, n, shingles) of components with more than BLOCK of them: (id, cls) of those that link to the pivot
    of some round, and these links (a, b). In a round one set of each component that still has many without a class is
    held against all of them; sets of one class are connected by their pivot and need not meet again."""

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [hashing.buffers(batch.column(k)) for k in (2, 3)]
            linked = []
            for r in range(batch.num_rows):
                x, y = (np.frombuffer(data[at[r] : at[r + 1]].tobytes(), np.uint64) for data, at in sides)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append((100 + percent) * shared >= percent * (len(x) + len(y)))
            kept = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept)) for k in (0, 1)], ["a", "b"])

    spark = large.sparkSession
    classes, links = spark.createDataFrame([], "id long, cls int"), spark.createDataFrame([], "a long, b long")
    left, unnamed = checkpoint(large.select("component", "id", "n")), large  # every round's plan starts from a checkpoint
    for r in range(1, PIVOTS + 1):
        found = left.where(F.col("n") <= PIVOT_MOST).groupBy("component").agg(F.min_by("id", F.xxhash64("id", F.lit(r))).alias("pivot"))
        many = left.groupBy("component").agg(F.count("*").alias("u")).where(F.col("u") > BLOCK)
        chosen = checkpoint(found.join(many, "component"))
        if chosen.isEmpty():
            break
        held = large.join(_few(chosen.select(F.col("pivot").alias("id"))), "id", "left_semi").select(F.col("id").alias("pivot"), F.col("shingles").alias("p"))
        side = chosen.join(held, "pivot")
        total = chosen.agg(F.sum("u")).first()[0]
        heavy = F.broadcast(side.where(F.col("u") * HEAVY >= total))  # at most HEAVY pivots of PIVOT_MOST shingles
        rest = unnamed.join(heavy.select("component"), "component", "left_anti").join(side.where(F.col("u") * HEAVY < total), "component")
        met = unnamed.join(heavy, "component").unionByName(rest).select("pivot", "id", "p", "shingles")
        new = checkpoint(met.mapInArrow(tidy(compared), "a long, b long"))
        links = links.unionByName(new.where("a <> b"))
        named = checkpoint(new.select(F.col("b").alias("id"), F.lit(r).alias("cls")))
        classes = checkpoint(classes.unionByName(named))
        left = checkpoint(left.join(_few(named.select("id")), "id", "left_anti"))
        unnamed = large.join(_few(classes.select("id")), "id", "left_anti")
    return classes, links


def _placed(sets: DataFrame, classes: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Sets with their place: those of a component of more than BLOCK sets are cut into bands by size, so wide that linked sets
    stand in one band or in neighbours, and a band's sets of one class into chunks of about BLOCK; with the groups (band, class, chunks) that
    the set must meet: all of near bands, but for those of its own class, if it has one. The others are one chunk.

    Groups, some BLOCK times fewer rows than large components have, and classes are broadcast up to a checked number."""
    width = float(-np.log(percent / 100)) * (1 + 1e-9) if percent < 100 else 1e-9
    band = F.floor(F.log("n") / F.lit(width)).cast("int") if percent < 100 else F.col("n").cast("int")
    large = sets.join(_few(sizes), "component", "left_semi")
    named = large.join(_few(classes), "id", "left").select("component", "id", "shingles", band.alias("band"), F.coalesce("cls", F.lit(0)).alias("cls"))
    counted = checkpoint(named.groupBy("component", "band", "cls").agg(F.count("*").alias("m")).withColumn("chunks", F.ceil(F.col("m") / BLOCK).cast("int")))
    other = counted.select("component", F.struct(F.col("band").alias("band"), F.col("cls").alias("cls"), F.col("chunks").alias("chunks")).alias("o"))
    near = (F.abs(F.col("o.band") - F.col("band")) <= 1) & ((F.col("o.cls") != F.col("cls")) | (F.col("cls") == 0))
    groups = counted.join(other, "component").where(near).groupBy("component", "band", "cls").agg(F.any_value("chunks").alias("chunks"), F.collect_list("o").alias("others"))
    met = named.join(_few(checkpoint(groups)), ["component", "band", "cls"])  # a group that meets no other one has no place
    chunk = F.expr("cast(pmod(xxhash64(id), chunks) as int)")
    cut = met.select("component", "id", "shingles", _code(F.col("band"), F.col("cls"), chunk).alias("chunk"), "others")
    single = sets.join(_few(sizes), "component", "left_anti").select("component", "id", "shingles", F.lit(0).cast("long").alias("chunk"), F.array(F.struct(F.lit(0).alias("band"), F.lit(0).alias("cls"), F.lit(1).alias("chunks"))).alias("others"))
    return cut.unionByName(single)


def _code(band, cls, chunk):
    return band.cast("long") * F.lit(1 << 36) + cls.cast("long") * F.lit(1 << 32) + chunk


def _blocks(placed: DataFrame) -> DataFrame:
    """(component, i, j, id, chunk, shingles): each set in every block of two chunks that its own chunk is half of."""
    met = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["chunks"] - 1), lambda k: _code(o["band"], o["cls"], k))))
    others = placed.withColumn("o", F.explode(met))
    return others.select("component", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "id", "chunk", "shingles")


def jaccard_components(docs: DataFrame, id_: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of `docs`: its id, n_shingles and component_id, the smallest id reachable by links.

    ASCII letters are lower-cased; words are runs without ASCII white space; a text's set holds its distinct
    shingles of `size` words, or its whole word sequence if it is shorter. Two texts link when
    100 * |intersection| >= percent * |union|. A null or blank text has an empty set, links with nothing and
    is its own component. Rows with a null id come back with a null component. Rows that repeat an id are
    taken as texts of one document: both rows come back, with the component of their joined links. No rows
    give no rows; other columns take no part. Shingles are compared by 64-bit hashes of 64-bit word hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    prints = checkpoint(_prints(docs, id_, text, size))
    late = _late(_low_columns(docs, text, size, percent))
    met = connected_components(_candidates(_columns(docs, text, size, percent, late), percent))
    kinds = prints.where("n > 0 and id is not null").groupBy("fa", "fb", "n").agg(F.min("id").alias("rep"))
    members = checkpoint(kinds.join(met.select(F.col("id").alias("fa"), "component"), "fa"))

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in hashing.pieces(batches, 3):
            sets = Sets(part.column(3), size)
            n, fa, fb = sets.prints()
            right = (fa == np.asarray(part.column(4))) & (fb == np.asarray(part.column(5)))  # of a repeated id, the row that is meant
            sent = pa.array([s.tobytes() if ok else None for s, ok in zip(sets.sets, right.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), sent], ["component", "id", "n", "shingles"])

    texts = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    if members.count() <= FEW_IDS:  # few sets to fetch: the other texts needn't be shuffled
        texts = texts.join(F.broadcast(members.select(F.col("rep").alias("id"))), "id", "left_semi")
    wanted = members.select("component", F.col("rep").alias("id"), F.col("n").cast("long").alias("n"), "fa", "fb")
    sets = wanted.join(texts, "id").select("component", "id", "n", "t", "fa", "fb").mapInArrow(tidy(shingles), "component long, id long, n long, shingles binary")
    sets = checkpoint(sets.where("shingles is not null"))
    sizes = checkpoint(members.groupBy("component").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("component"))
    classes, links = _pivoted(sets.join(_few(sizes), "component", "left_semi"), percent)
    links = links.unionByName(_links(_blocks(_placed(sets, classes, sizes, percent)), percent))
    groups = connected_components(links)
    least = checkpoint(groups.groupBy("component").agg(F.min("id").alias("component_id")))  # of linked sets alone
    linked = groups.join(F.broadcast(least) if least.count() <= FEW_IDS else least, "component").select(F.col("id").alias("rep"), "component_id")
    by_print = kinds.join(linked, "rep", "left").select("fa", "fb", "n", F.coalesce("component_id", "rep").alias("component_id"))
    rows = prints.join(by_print, ["fa", "fb", "n"], "left")
    return rows.select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
