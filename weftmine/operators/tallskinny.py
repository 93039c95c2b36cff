"""Sums and factors of tables of many rows and few columns: each task reduces its rows, and what is left of tasks is merged up a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmine.session import cut

#: Parts that one task merges, and rows of a summed matrix that travel as one.
FAN, ROWS = 16, 1024


def task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def merged(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> dict[int, np.ndarray]:
    """By place, what is left of parts (place, slot, value: doubles) when FAN neighbouring slots at a time are merged. Parts come cut, one for each task and place at most."""
    parts = cut(parts)
    slots = parts.agg(F.max("slot")).first()[0] or 0

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slot")
        value = merge([np.frombuffer(v) for v in frame["value"]])
        return pd.DataFrame({"place": [int(frame["place"].iloc[0])], "slot": [int(frame["slot"].iloc[0]) // FAN], "value": [np.ascontiguousarray(value).tobytes()]})

    while slots:
        parts = parts.groupBy("place", F.floor(F.col("slot") / FAN).alias("__to")).applyInPandas(together, parts.schema)
        slots //= FAN
    return {r.place: np.frombuffer(bytes(r.value)) for r in parts.collect()}


def batch_of(places: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
    data = [np.ascontiguousarray(v).tobytes() for v in values]
    return pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([task()] * len(places), pa.int64()), pa.array(data, pa.binary())], names=["place", "slot", "value"])


PART = "place long, slot long, value binary"


def summed(rows: DataFrame, each: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``each`` (a matrix of this shape, made of a batch) over all batches. A task adds up its own; sums travel in blocks of ROWS rows, those of zeros not at all."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += each(batch)
        blocks = {b: total[b * ROWS : (b + 1) * ROWS] for b in range(-(-shape[0] // ROWS))}
        some = [b for b, m in blocks.items() if m.any()]
        yield batch_of(some, [blocks[b] for b in some])

    out = np.zeros(shape)
    for b, value in merged(rows.mapInArrow(partial, PART), lambda values: np.sum(values, axis=0)).items():
        out[b * ROWS : (b + 1) * ROWS] = value.reshape(-1, shape[1])
    return out


def triangle(rows: DataFrame, each: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """R of the QR of all the rows that ``each`` makes of batches."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, each(batch)]), mode="r")
        yield batch_of([0] if len(r) else [], [r] if len(r) else [])

    stack = lambda values: np.linalg.qr(np.vstack([v.reshape(-1, width) for v in values]), mode="r")
    return merged(rows.mapInArrow(reduced, PART), stack).get(0, np.zeros(0)).reshape(-1, width)


@dataclass
class Leading:
    values: np.ndarray  # falling
    vectors: np.ndarray  # items by k


def leading(rows: DataFrame, product: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], back: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], n_items: int, k: int, *, more: int = 30, passes: int = 8, seed: int = 0, tolerance: float = 1e-10) -> Leading:
    """The k largest singular values of a table of rows by items, and their right vectors.

    product(batch, M): the batch's rows times M (items by anything); back(batch, Y): its rows turned round, times Y. A seeded random matrix of k + ``more`` columns
    (all items, if no more) is sent through the table and back until the values stand still, ``passes`` times at most, and the rows times what is then left of it, orthonormal,
    are factored by tasks and up a tree. The driver holds items by k + more numbers, as many as a model's loadings.
    """
    width = min(n_items, 2 * k + more)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_items, width)))[0]
    before = None
    for _ in range(passes):
        held = basis
        basis = np.linalg.qr(summed(rows, lambda batch: back(batch, product(batch, held)), (n_items, width)))[0]  # noqa: B023
        fixed = basis
        r = triangle(rows, lambda batch: product(batch, fixed), width)  # noqa: B023
        _, values, turn = np.linalg.svd(r if len(r) else np.zeros((1, width)), full_matrices=True)
        values = np.pad(values, (0, width - len(values)))
        if width == n_items or before is not None and np.abs(values[:k] - before[:k]).max(initial=0) <= tolerance * max(values.max(initial=0), 1e-300):
            break
        before = values
    return Leading(values[:k], (basis @ turn.T)[:, :k])
