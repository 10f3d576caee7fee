"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.session import checkpoint, ship

FEW_EDGES = 1 << 20  # a graph of at most this many edges is finished in one task; its size is counted first


def _finished(edges: DataFrame) -> DataFrame:
    """(id, component) by union-find in one task, for a graph whose size was checked."""
    ship(edges.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        ids = list(parent)
        for a in range(0, len(ids), 100_000):
            part = ids[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["id", "component"])

    return edges.repartition(1).mapInArrow(run, "id long, component long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """(id, component) of every node of `edges` (long ids); a component's name is one of its ids.

    While more than `few` edges are left, a round maps each node to the neighbour (or itself) that comes first
    in a hashed order and contracts the graph along that map; the hashed order makes a constant share of the
    nodes vanish a round, whatever the ids are. Every round is hash aggregations and equi-joins over what is left,
    its lineage cut by checkpoint(). What is left then is finished in one task, and the rounds' maps are
    composed, the last first. Null ids and loops take no part; an edge given twice counts once; no edges give
    an empty result.
    """
    left = checkpoint(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps = []
    while left.count() > few:
        both = left.union(left.select("b", "a"))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        step = checkpoint(near.select("a", F.least("m", own)["id"].alias("to")))
        maps.append(step)
        to_a = left.join(step, "a").select(F.col("to").alias("x"), "b")
        both_to = to_a.join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = checkpoint(both_to.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    found = checkpoint(_finished(left))
    for step in reversed(maps):
        onward = found.select(F.col("id").alias("to"), "component")
        found = checkpoint(step.join(onward, "to", "left").select(F.col("a").alias("id"), F.coalesce("component", "to").alias("component")))
    return found
