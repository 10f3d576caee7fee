"""Benchmark decontamination: passages of documents that are alike to benchmark items.

Every window of as many words as an item has is compared to the items of that size: its SimHash (64 bits over
weighted word shingles) is looked up by multi-index hashing (the fingerprint is cut into blocks; within a radius
r two fingerprints differ in some block by at most r / blocks bits, and each block's index gives the items that
near, so no fingerprint within the radius is missed), and the exact weighted Jaccard similarity of the shingles
decides. Windows that hold too few of the benchmark's shingles to reach the threshold can't
match; running sums of shingle hits find them for all positions at once, and their fingerprints are not made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.llm.session import ship, spread, tidy

SHINGLE = 5  # words
SIMILARITY = 0.8
RADIUS = 19  # bits; two sets of similarity 0.8 are some 10 bits apart, so this is three deviations out
BLOCKS = 4  # of 16 bits
ITEMS_AT_ONCE = 1 << 16  # items of a broadcast index, and bytes of their texts; a larger benchmark is cut into slices
BYTES_AT_ONCE = 32 << 20
_BAGS = 4096  # items whose shingles a worker holds counted

# letters, digits and bytes beyond ASCII make words; everything else parts them
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def fingerprints(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """SimHash of n weighted multisets: bit k is set if the weights with bit k set outweigh the others."""
    out = np.zeros(n, np.uint64)
    mixed = hashing.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    for k in range(64):
        sign = ((mixed >> np.uint64(k)) & np.uint64(1)).astype(np.float64) * 2 - 1
        out |= (np.bincount(owner, weights=sign * weights, minlength=n) > 0).astype(np.uint64) << np.uint64(k)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    low = sum(min(w, b[k]) for k, w in a.items() if k in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a or b else 0.0


class Near:
    """Multi-index hashing over item fingerprints. A block's index is the items in order of their value there; a query
    tries all values within the block's share of the radius, or all items where those are fewer."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius, self.blocks = prints, radius, blocks
        self.width = 64 // blocks
        values = np.arange(1 << self.width, dtype=np.uint64)
        self.masks = values[np.bitwise_count(values) <= radius // blocks]
        self.parts = [self._part(prints, b) for b in range(blocks)]
        self.orders = [np.argsort(p, kind="stable") for p in self.parts]

    def __reduce__(self):  # workers build the index anew; only the fingerprints travel
        return Near, (self.prints, self.radius, self.blocks)

    def _part(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row of `prints`, item) within the radius, each once."""
        n, found = len(self.prints), [np.zeros(0, np.int64)]
        for a in range(0, len(prints) if n else 0, 512):
            some = prints[a : a + 512]
            for b in range(self.blocks):
                part = self._part(some, b)
                if n <= len(self.masks):
                    row, it = np.nonzero(np.bitwise_count(part[:, None] ^ self.parts[b][None, :]) <= self.radius // self.blocks)
                else:
                    listed = self.parts[b][self.orders[b]]
                    tried = (part[:, None] ^ self.masks[None, :]).ravel()
                    low, high = np.searchsorted(listed, tried, "left"), np.searchsorted(listed, tried, "right")
                    many = high - low
                    row = np.repeat(np.repeat(np.arange(len(some)), len(self.masks)), many)
                    it = self.orders[b][np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
                ok = distance(some[row], self.prints[it]) <= self.radius
                found.append((a + row[ok]) * n + it[ok])
        pair = np.unique(np.concatenate(found))
        return pair // max(1, n), pair % max(1, n)


class Benchmark:
    """Items by size with their shingles and fingerprints; a bounded number of items. With `radius` None every
    window that holds enough benchmark shingles is verified against every item of its size, whatever the fingerprints."""

    def __init__(self, items: list[tuple[int, str]], size: int = SHINGLE, similarity: float = SIMILARITY, radius: int | None = RADIUS):
        self.size, self.similarity, self.exact = size, similarity, radius is None
        column = pa.array([t for _, t in items], pa.string())
        data, offsets = hashing.buffers(column)
        start, end, by = hashing.words(data, offsets, NOT_WORD)
        shingles, at = hashing.shingle_hashes(hashing.word_hashes(data, start, end), by, size)
        words = np.diff(by)
        self.known = np.unique(shingles)
        groups: dict[int, list[int]] = {}
        for k in np.flatnonzero(words):
            groups.setdefault(int(words[k]), []).append(int(k))
        self.groups = []
        for m, ks in sorted(groups.items()):
            owner = np.repeat(np.arange(len(ks)), [at[k + 1] - at[k] for k in ks])
            flat = np.concatenate([shingles[at[k] : at[k + 1]] for k in ks])
            prints = fingerprints(flat, np.ones(len(flat)), owner, len(ks))
            self.groups.append((m, np.array([items[k][0] for k in ks], np.int64), flat.reshape(len(ks), -1), Near(prints, RADIUS if radius is None else radius)))
        self.counted: dict[tuple[int, int], Counter] = {}

    def bag(self, g: int, k: int) -> Counter:
        if (g, k) not in self.counted:
            if len(self.counted) >= _BAGS:
                self.counted.clear()
            self.counted[g, k] = Counter(self.groups[g][2][k].tolist())
        return self.counted[g, k]

    @staticmethod
    def _short(hashes: np.ndarray, by: np.ndarray, m: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of m words within a text that is one of the wanted shingles."""
        span = max(0, len(hashes) - m + 1)
        rolled = np.full(span, m, np.uint64)
        for k in range(m):
            rolled += hashes[k : k + span] * hashing._POSITION[k]
        rolled = hashing.mix(rolled)
        first = np.flatnonzero(np.isin(rolled, wanted))
        text = np.searchsorted(by, first, side="right") - 1
        first = first[first + m <= by[text + 1]]
        return rolled[first], first

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first byte, byte after the last) of each text's best window for each item."""
        if not len(self.known):
            return []
        start, end, by = hashing.words(data, offsets, NOT_WORD)
        hashes = hashing.word_hashes(data, start, end)
        shingles, at = hashing.shingle_hashes(hashes, by, self.size)
        place = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        hits = np.concatenate([[0], np.cumsum(self.known[place] == shingles)])
        n_words = np.diff(by)
        touched = np.flatnonzero(hits[at[1:]] > hits[at[:-1]])
        # the shingles of the touched texts, one text after the other, each with the end of its text's
        many = (at[touched + 1] - at[touched]).astype(np.int64)
        spots = np.repeat(at[touched] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        stops = np.repeat(at[touched + 1], many)
        owners = np.repeat(touched, many)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for g, (m, names, sets, near) in enumerate(self.groups):
            width = max(1, m - self.size + 1)  # shingles of a window
            least = self.similarity * 2 / (1 + self.similarity) * width
            if m < self.size:  # an item of few words is one shingle: so are the text's windows of as many words
                flat, first = self._short(hashes, by, m, sets.ravel())
                text = np.searchsorted(by, first, side="right") - 1
                length = np.ones(len(first), np.int64)
                word = first
            else:
                whole = np.flatnonzero(spots + width <= stops)
                found = whole[hits[spots[whole] + width] - hits[spots[whole]] >= least - 1e-9]
                small = touched[n_words[touched] < m]  # a text shorter than the item is one window
                small = small[hits[at[small + 1]] - hits[at[small]] >= self.similarity * width - 1e-9]
                text, first = np.concatenate([owners[found], small]), np.concatenate([spots[found], at[small]])
                length = np.minimum(width, at[text + 1] - first)
                flat = shingles[np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())] if len(first) else shingles[:0]
                word = by[text] + first - at[text]
            if not len(first):
                continue
            begin = np.concatenate([[0], np.cumsum(length)])
            owner = np.repeat(np.arange(len(first)), length)
            if self.exact:
                row, item = np.repeat(np.arange(len(first)), len(names)), np.tile(np.arange(len(names)), len(first))
            else:
                row, item = near.find(fingerprints(flat, np.ones(len(flat)), owner, len(first)))
            window, last = Counter(), -1
            for r, k in zip(row.tolist(), item.tolist(), strict=True):
                if r != last:
                    window, last = Counter(flat[begin[r] : begin[r + 1]].tolist()), r
                alike = weighted_jaccard(window, self.bag(g, k))
                key = (int(text[r]), int(names[k]))
                if alike >= self.similarity and alike > best.get(key, (0.0,))[0]:
                    w = int(word[r])
                    best[key] = (alike, int(start[w]), int(end[min(w + m, by[text[r] + 1]) - 1]))
        return [(t, name, *found) for (t, name), found in sorted(best.items())]


def _indexes(benchmark: DataFrame, item: str, item_text: str, size: int, similarity: float, radius: int | None) -> list:
    """The benchmark as broadcast indexes of at most about ITEMS_AT_ONCE items and BYTES_AT_ONCE bytes of text each;
    items that share an id stand in one."""
    items = benchmark.select(F.col(item).cast("long").alias("k"), F.col(item_text).cast("string").alias("t")).where("k is not null and t is not null").distinct()
    facts = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    slices = max(-(-facts["n"] // ITEMS_AT_ONCE), -(-facts["b"] // BYTES_AT_ONCE))
    out = []
    for s in range(slices):
        mine = items.where(F.expr(f"pmod(xxhash64(k), {slices}) = {s}")).orderBy("k", "t").collect()
        out.append(benchmark.sparkSession.sparkContext.broadcast(Benchmark([(r["k"], r["t"]) for r in mine], size, similarity, radius)))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, radius: int | None = RADIUS) -> DataFrame:
    """(id, item_id, similarity, first_byte, end_byte): for each document and item the window of the text most
    alike to the item, if the similarity is reached (ties: the first window). Bytes count in the text's UTF-8.

    Words are runs of letters and digits (any character beyond ASCII counts as one), ASCII letters in lower
    case; shingles weigh their number of occurrences. An item of fewer words than a shingle is one shingle; an
    item without words, or with a null id or text, matches nothing; a document shorter than an item is one
    window; items that share an id give one row, of the best of them. Null, empty or null-id documents give no rows;
    documents or items given twice give their rows twice or once (items: once). Extra columns take no part.
    `radius`: bits; None verifies without fingerprints. The benchmark is broadcast in one index up to a checked size;
    beyond it each slice has its own branch of the same job over the documents, which are never shuffled."""
    spark = docs.sparkSession
    ship(spark)
    part = spread(docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("t")).where("id is not null and t is not null"))
    schema = f"`{id_}` long, item_id long, similarity double, first_byte int, end_byte int"
    out = spark.createDataFrame([], schema)
    indexes = _indexes(benchmark, item, item_text, size, similarity, radius)
    for shared in indexes:

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                data, offsets = hashing.buffers(batch.column(1))
                ids = batch.column(0).to_pylist()
                for a, b in hashing.runs(offsets):
                    found = known.matches(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    if found:
                        at = offsets[a : b + 1] - offsets[a]
                        t, k, alike, first, end = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[a + x] for x in t], pa.int64()), pa.array(k, pa.int64()), pa.array(alike, pa.float64()), pa.array([f - int(at[x]) for f, x in zip(first, t, strict=True)], pa.int32()), pa.array([e - int(at[x]) for e, x in zip(end, t, strict=True)], pa.int32())], [id_, "item_id", "similarity", "first_byte", "end_byte"])

        found = part.mapInArrow(tidy(run), schema)
        out = found if len(indexes) == 1 else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, radius: int | None = RADIUS) -> DataFrame:
    """The rows of `docs`, all columns, whose own text holds no window alike to a benchmark item, as `leaks` finds them.

    Each row is judged by its text alone, so null and repeated ids don't matter; a null or empty text stays. One map
    over the scan for each index; a row that one index drops isn't looked at by the next. No join, no shuffle."""
    ship(docs.sparkSession)
    place = docs.columns.index(text)
    out = spread(docs)
    for shared in _indexes(benchmark, item, item_text, size, similarity, radius):

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                data, offsets = hashing.buffers(batch.column(place))
                clean = np.ones(batch.num_rows, bool)
                for a, b in hashing.runs(offsets):
                    clean[[a + t for t, *_ in known.matches(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(tidy(run), docs.schema)
    return out
