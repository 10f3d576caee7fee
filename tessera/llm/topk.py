"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries are dealt into blocks and candidates into chunks of bounded size, and every pair of a block and a chunk is a
cell of one shuffle. In a cell the block's rows are held as postings by dimension, candidates stream by, each
dimension's weighted postings are added into a dense array of scores (one row a query, one column a candidate), the k
best of each query are selected, and the cells' lists are merged by rank. No candidate is skipped and integer scores
are exact. One job does all blocks; nothing comes to the driver. With Q queries and N rows, Q / QUERIES copies of the
rows and N / ROWS copies of the queries are shuffled, against N * Q products.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.session import ship, shuffle_partitions, tidy

QUERIES = 1 << 15  # rows of a block of queries, about
ROWS = 1 << 18  # rows of a chunk of candidates, about; less where the cores would have nothing to do
LEAST_ROWS = 512
SLICE = 1 << 13  # candidates that a cell takes at once
SCORES_AT_ONCE = 1 << 20  # cells of the dense score array
MOST = (1 << 63) - 1
_ABOVE_ALL = b"\xff\xff\xff"


def finite(vector: str = "embedding") -> str:
    """SQL: whether a vector takes part: not null, no null component, none that is infinite or not a number."""
    return f"({vector} is not null and forall({vector}, x -> x is not null and not isnan(x) and abs(cast(x as double)) <= 1.7976931348623157e308d))"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of doubles, padded with zeros or cut to `width` dimensions."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values)
    size = np.diff(offsets)
    if len(column) and (size == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), size)
    place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)
    inside = place < width
    out[row[inside], place[inside]] = values[offsets[0] : offsets[-1]][inside]
    return out


def quantised(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) as integers: 64-bit ones where all fit, Python's own otherwise. A double from 2^53 on is whole."""
    if float(np.abs(x).max(initial=0)) * scale < 2.0**62:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in row] for row in x.tolist()], object).reshape(x.shape)


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of every query with every row, one dimension's postings after the other. Numbers small enough
    for it are added in 32 bits, and those too large for 64 as Python's integers; the sums are exact in any case."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * queries.shape[1]
    kind = np.int32 if most < 2**31 else np.int64 if most <= MOST else object
    scores = np.zeros((len(queries), len(rows)), kind)
    weights, columns = queries.T.astype(kind), np.ascontiguousarray(rows.T.astype(kind))
    part = np.empty_like(scores) if kind is not object else None
    for weight, column in zip(weights, columns, strict=True):
        asked = np.flatnonzero(weight)
        if not len(asked):
            continue
        posted = np.flatnonzero(column)
        if 2 * len(posted) < len(column) or 2 * len(asked) < len(weight) or part is None:
            scores[np.ix_(asked, posted)] += weight[asked, None] * column[posted][None, :]
        else:
            np.multiply(weight[:, None], column[None, :], out=part)
            scores += part
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query, the columns of its k best candidates other than itself."""
    sorted_ids = np.sort(ids)
    own_rows = np.searchsorted(sorted_ids, own, "right") - np.searchsorted(sorted_ids, own, "left")
    for q in range(len(scores)):
        row, most = scores[q], max(k + int(own_rows[q]), 1)  # the query's own rows may be among the highest
        if len(row) > most:
            edge = np.partition(row, len(row) - most)[len(row) - most]
            at = np.flatnonzero(row >= edge)
        else:
            at = np.arange(len(row))
        at = at[ids[at] != own[q]]
        yield q, at[np.lexsort((ids[at], -row[at]))][:k]


def shown(score: int) -> tuple[int, bytes]:
    """A score as a 64-bit number, cut to its range, and bytes that order those that were cut."""
    if -MOST - 1 < score <= MOST:
        return score, b""
    size = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    key = len(size).to_bytes(2, "big") + size
    if score > MOST:
        return MOST, key
    return -MOST - 1, _ABOVE_ALL if score == -MOST - 1 else bytes(255 - b for b in key)


def search(vectors: DataFrame, is_query: str, k: int = 5, id_: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, <id_>, score): for each row that the SQL condition `is_query` marks, the k other rows of
    highest inner product of quantised vectors, ranks from 1, ties to the smaller id; all of them, if fewer.

    Rows with a null id, a null vector, or a null or non-finite component take no part, as queries or as
    candidates. Shorter vectors count as padded with zeros. Repeated rows are candidates each; a query's own id
    is none of its candidates; a query id that repeats is asked once for each distinct vector, and its lists
    are merged. Components and sums of any finite size are exact; a score beyond 64 bits is ranked by its true value
    and shown as the nearest 64-bit number. Empty input gives no rows; extra columns take no part. Equal rows meet
    before the shuffle and are dealt by id and vector, so no chunk holds more than its share."""
    spark = vectors.sparkSession
    ship(spark)
    picked = vectors.select(F.col(id_).cast("long").alias("id"), F.expr(f"coalesce(({is_query}), false)").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    sound = picked.where(F.col("id").isNotNull() & F.expr(finite("v")))
    rows = sound.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))  # more copies than k change nothing
    facts = sound.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks = max(1, -(-facts["q"] // QUERIES))
    chunks = max(1, -(-facts["n"] // ROWS), min(4 * shuffle_partitions(spark), -(-facts["n"] // LEAST_ROWS)))
    place = F.xxhash64("id", "v")
    asked = sound.where("q").select("id", "v").distinct().select(F.pmod(place, F.lit(blocks)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("j"), F.lit(0).alias("times"), "id", "v")
    offered = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), F.pmod(place, F.lit(chunks)).cast("int").alias("j"), "times", "id", "v")
    cells = asked.unionByName(offered).repartition(max(shuffle_partitions(spark), min(blocks * chunks, 20_000)), "i", "j").sortWithinPartitions("i", "j", "times")
    names = ["query_id", id_, "score", "beyond"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, queries, slices, waiting, n_waiting, top = None, None, None, [], [], 0, {}

        def posted(ids: np.ndarray, times: np.ndarray, column: list[pa.Array]) -> None:
            offers = quantised(np.concatenate([matrix(c, queries.shape[1]) for c in column]), scale)
            step = max(1, SCORES_AT_ONCE // len(ids))
            for a in range(0, len(own), step):
                scores = accumulate(queries[a : a + step], offers)
                for q, at in best(scores, ids, own[a : a + step], k):
                    held = top.setdefault(a + q, [])
                    held += [x for s, i, m in zip(scores[q][at].tolist(), ids[at].tolist(), times[at].tolist(), strict=True) for x in [(-s, i)] * m]
                    held.sort()
                    del held[k:]

        def flush() -> None:
            nonlocal own, queries, waiting, n_waiting
            if slices:  # the queries of the cell are complete
                width = max(int(np.diff(np.asarray(c.offsets)).max(initial=0)) for _, c in slices)
                own = np.concatenate([x for x, _ in slices])
                queries = quantised(np.concatenate([matrix(c, width) for _, c in slices]), scale)
                slices.clear()
            if waiting and own is not None:
                posted(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), [w[2] for w in waiting])
            waiting, n_waiting = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            flush()
            flat = [(int(own[q]), i, *shown(-s)) for q, held in top.items() for s, i in held]
            for a in range(0, len(flat), 100_000):
                columns = list(zip(*flat[a : a + 100_000], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names)
            top.clear()

        for batch in batches:
            i, j, times, ids = (np.asarray(batch.column(c)).astype(np.int64) for c in range(4))
            edges = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | ((times[1:] > 0) != (times[:-1] > 0)), [True]])) if len(ids) else []
            for a, b in zip(edges, edges[1:], strict=False):
                a, b = int(a), int(b)
                if (int(i[a]), int(j[a])) != key:
                    if key is not None:
                        yield from done()
                    key, own, queries = (int(i[a]), int(j[a])), None, None
                if not times[a]:
                    slices.append((ids[a:b], batch.column(4).slice(a, b - a)))
                    continue
                for c in range(a, b, SLICE):
                    waiting.append((ids[c : min(b, c + SLICE)], times[c : min(b, c + SLICE)], batch.column(4).slice(c, min(b, c + SLICE) - c)))
                    n_waiting += len(waiting[-1][0])
                    if n_waiting >= SLICE:
                        flush()
        if key is not None:
            yield from done()

    found = cells.select("i", "j", "times", "id", "v").mapInArrow(tidy(run), f"query_id long, `{id_}` long, score long, beyond binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), id_)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_, "score")
