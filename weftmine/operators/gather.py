"""Entities' items of several views as one row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _changes(values: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls are equal."""
    a, b = values.slice(1), values.slice(0, max(0, len(values) - 1))
    differ = pc.or_(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
    return np.nonzero(differ.to_numpy(zero_copy_only=False))[0] + 1


def gathered(views: dict[str, DataFrame]) -> DataFrame:
    """pid, and by view an array of (item, val) in order, empty where an entity has none, of tables (pid, item, val); entities need one view at least.

    All views' cells are dealt out once, by entity, and sorted by it; where an entity ends is seen in the batches, which put its cells in order.
    """
    kinds = {v: dict(x.dtypes)["item"] for v, x in views.items()}
    slots = {kind: f"__item{i}" for i, kind in enumerate(dict.fromkeys(kinds.values()))}
    cells = None
    for no, (view, x) in enumerate(views.items()):
        items = [(F.col("item") if kind == kinds[view] else F.lit(None).cast(kind)).alias(c) for kind, c in slots.items()]
        own = x.select("pid", F.lit(no).alias("__view"), *items, F.col("val").cast("double").alias("__val"))
        cells = own if cells is None else cells.union(own)
    dealt = cells.repartition("pid").sortWithinPartitions("pid")
    within = [(c, "ascending") for c in ("__entity", "__view", *slots.values(), "__val")]

    def made(part: pa.RecordBatch) -> pa.RecordBatch:
        begins = np.append(0, _changes(part.column("pid")))
        entity = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, part.num_rows)))
        out = [part.column("pid").take(pa.array(begins))]
        part = part.append_column("__entity", pa.array(entity)).drop_columns("pid")
        part = part.take(pc.sort_indices(part, sort_keys=within))
        of = part.column("__view").to_numpy()
        for no, kind in enumerate(kinds.values()):
            own = np.nonzero(of == no)[0]
            ends = np.append(0, np.cumsum(np.bincount(entity[own], minlength=len(begins))))
            mine = part.take(pa.array(own))
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([mine.column(slots[kind]), mine.column("__val")], names=["item", "val"])))
        return pa.RecordBatch.from_arrays(out, names=["pid", *kinds])

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []  # of the last entity, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            left.append(batch)
            if not left[0].column("pid")[0].equals(batch.column("pid")[-1]):
                whole = joined(left)
                last = int(_changes(whole.column("pid"))[-1])
                yield made(whole.slice(0, last))
                left = [whole.slice(last)]
        if left:
            yield made(joined(left))

    return dealt.mapInArrow(lists, f"pid {dict(cells.dtypes)['pid']}, " + ", ".join(f"{v} array<struct<item:{kind},val:double>>" for v, kind in kinds.items()))
