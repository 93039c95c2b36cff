"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmine.session import cut, drop, stored

#: Tasks that the rows at one node are dealt to: a star's centre may be the end of most edges.
SALT = 8
#: Edges that a task joins at a time, and so many that one task joins them all.
CHUNK = 1 << 17


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, node) for all other nodes of each group that edges join."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
    root = np.array(up, np.int64)
    while len(root) and (root[root] != root).any():
        root = root[root]
    rest = np.flatnonzero(root != np.arange(len(root)))
    return nodes[root[rest]], nodes[rest]


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that join what edges (a, b) do. Each task joins CHUNK rows at a time, so that paths within them become stars."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> pa.RecordBatch:
            a, b = _forest(*(np.concatenate([np.zeros(0, np.int64), *(k[i] for k in kept)]) for i in (0, 1)))
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(k[0]) for k in kept) >= CHUNK:
                yield joined()
        yield joined()

    return edges.mapInArrow(stars, "a long, b long")


def _sent(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """rows with ``column`` replaced where moves (from, to) has it. Rows are dealt out by the node and a part of their hash, and moves copied to each part."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALT)).cast("int"))
    copies = moves.select(F.col("from").alias("__from"), F.col("to").alias("__to"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__part"))
    joined = salted.join(copies, (F.col(column) == F.col("__from")) & (F.col("__salt") == F.col("__part")), "left")
    return joined.withColumn(column, F.coalesce("__to", column)).select(rows.columns)


def components(edges: DataFrame, few: int = CHUNK) -> DataFrame:
    """node, component (the smallest node reachable) for edges (a, b) of long ids; nodes without an edge are left out.

    Tasks join the edges that they hold first. Where no more than ``few`` are left, one task joins these as well. Else, each round, every edge's larger end
    goes to the smallest neighbour of the other end, and then a node's smaller neighbours go to the smallest of them, until only stars are left, which nothing moves. A path
    of any order shrinks by a half each round. Rounds are written as tables: what a join knows of its rows' places would grow from round to round in a checkpoint's plan.
    """
    few = min(few, CHUNK)
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    left, before = stored(_stars(ordered(edges)).distinct()), None
    while True:
        now = tuple(left.agg(F.count("*"), mark).first())
        if now == before:
            break
        if now[0] <= few:
            left = cut(_stars(left.repartition(1)))
            break
        both = left.union(left.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("from")).agg(F.least("from", F.min("b")).alias("to"))
        far = stored(ordered(_sent(left, "a", nearest)))
        least = far.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to"))
        near = ordered(_sent(far, "b", least)).union(least.select("to", "from"))
        new = stored(near.distinct())
        drop(left, far)
        left, before = new, now
    return left.select(F.col("b").alias("node"), F.col("a").alias("component")).union(left.select("a", "a").distinct())
