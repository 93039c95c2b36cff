"""Matrices as long tables (row, col, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a matrix that goes to every task: 16 MB as numbers.
CELLS = 2_000_000


def product(a: DataFrame, b: DataFrame, row: str, inner: str, col: str, v: str = "v") -> DataFrame:
    """(row, col, v) of A B, where A is (row, inner, v) and B is (inner, col, v)."""
    left, right = a.select(row, inner, F.col(v).alias("__x")), b.select(inner, col, F.col(v).alias("__y"))
    return left.join(right, inner).groupBy(row, col).agg(F.sum(F.col("__x") * F.col("__y")).alias(v))


def cells_of(lists: pa.ListArray, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of arrays of (key, v): values by row and key, and which there are; other keys are left out."""
    flat = lists.flatten()
    which = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    place = pc.fill_null(pc.index_in(flat.field(0), keys), -1).to_numpy(zero_copy_only=False)
    value = flat.field(1).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    known = place >= 0
    x, has = np.zeros((len(lists), len(keys))), np.zeros((len(lists), len(keys)), np.float32)
    np.add.at(x, (which[known], place[known]), value[known])
    has[which[known], place[known]] = 1
    return x, has


def held(b: DataFrame, row: str, col: str, v: str = "v") -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray] | None:
    """B's rows and columns, its values, and which there are; None if it has more than CELLS."""
    cells = b.select(row, col, v).limit(CELLS + 1).toArrow()
    if cells.num_rows > CELLS:
        return None
    cells = cells.combine_chunks()
    rows, cols = pc.unique(cells.column(0).combine_chunks()), pc.unique(cells.column(1).combine_chunks())
    matrix, there = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)), np.float32)
    at = tuple(pc.index_in(c, u).to_numpy() for c, u in zip(cells.columns[:2], (rows, cols), strict=True))
    np.add.at(matrix, at, cells.column(2).cast(pa.float64()).fill_null(0.0).to_numpy())
    there[at] = 1
    return rows, cols, matrix, there


def product_of_rows(a: DataFrame, b: DataFrame, row: str, inner: str, col: str, v: str = "v", whole: bool = False, keep: bool = False) -> DataFrame:
    """Like product, for a B of ``CELLS`` cells at most, such as a model's loadings: it goes to the tasks, and a batch of A's rows is multiplied at once. A larger B is joined.

    whole: rows stay together, as (row, __cells: array of (col, v)), and such an A may be multiplied again without dealing its rows out once more; rows without a cell have none.
    keep: with ``whole``, the row of A stands beside, as __own.
    """
    found = held(b, inner, col, v)
    if found is None:
        long = a.select(row, F.explode("__cells").alias("__c")).select(row, f"__c.{inner}", f"__c.{v}") if "__cells" in a.columns else a
        out = product(long, b, row, inner, col, v)
        if not whole:
            return out
        out = out.groupBy(row).agg(F.collect_list(F.struct(col, v)).alias("__cells"))
        return out.join(long.groupBy(row).agg(F.collect_list(F.struct(inner, v)).alias("__own")), row) if keep else out
    inners, cols, matrix, there = found
    shape = matrix.shape
    kinds = {**dict(b.dtypes), row: dict(a.dtypes)[row]}

    step = max(1, CELLS // max(1, *shape))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, step):  # so many rows that no table of theirs is above CELLS
                part = batch.slice(begin, step)
                x, has = cells_of(part.column(1), inners)
                i, j = np.nonzero(has @ there > 0)
                out = (x @ matrix)[i, j]
                if whole:
                    some, begins = np.unique(i, return_index=True)
                    ends = pa.array(np.append(begins, len(i)), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([cols.take(pa.array(j)), pa.array(out)], names=[col, v]))
                    own = [part.column(1).take(pa.array(some))] if keep else []
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), lists, *own], names=[row, "__cells", "__own"][: 2 + keep])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), cols.take(pa.array(j)), pa.array(out)], names=[row, col, v])

    packed = a.select(row, "__cells") if "__cells" in a.columns else a.groupBy(row).agg(F.collect_list(F.struct(inner, v)).alias("__cells"))
    if whole:
        own = f", __own {dict(packed.dtypes)['__cells']}" if keep else ""
        return packed.mapInArrow(rows, f"{row} {kinds[row]}, __cells array<struct<{col}:{kinds[col]},{v}:double>>{own}")
    return packed.mapInArrow(rows, f"{row} {kinds[row]}, {col} {kinds[col]}, {v} double")


def gram(a: DataFrame, row: str, col: str, v: str = "v") -> DataFrame:
    """(k, l, v) of A' A for A (row, col, v)."""
    return product(a.select(F.col(row), F.col(col).alias("k"), v), a.select(F.col(row), F.col(col).alias("l"), v), "k", row, "l", v)


def squared_sum(a: DataFrame, v: str = "v") -> DataFrame:
    return a.agg(F.coalesce(F.sum(F.col(v) * F.col(v)), F.lit(0.0)).alias("squared"))


def reconstruction_parts(x: DataFrame, g: DataFrame, h: DataFrame) -> DataFrame:
    """squared, cross, recon, error: the parts of |X - G H'|^2 = |X|^2 - 2 <X, G H'> + <G'G, H'H>, without a table of all entities and items.

    x: pid, item, val; g: pid, k, v; h: item, k, v.
    """
    squared = x.agg(F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0)).alias("squared"))
    xh = product_of_rows(x.select("pid", "item", F.col("val").alias("v")), h, "pid", "item", "k")
    cross = xh.join(g.select("pid", "k", F.col("v").alias("w")), ["pid", "k"]).agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("cross"))
    recon = gram(g, "pid", "k").join(gram(h, "item", "k").withColumnRenamed("v", "w"), ["k", "l"]).agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("recon"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    parts = one(squared).join(one(cross), "__one").join(one(recon), "__one")
    return parts.select("squared", "cross", "recon", F.greatest(F.col("squared") - 2 * F.col("cross") + F.col("recon"), F.lit(0.0)).alias("error"))


def nre(x: DataFrame, g: DataFrame, h: DataFrame) -> DataFrame:
    """nre: |X - G H'| / |X|, 0 for an empty X."""
    ratio = F.when(F.col("squared") > 0, F.sqrt(F.col("error") / F.col("squared"))).otherwise(0.0)
    return reconstruction_parts(x, g, h).select(ratio.alias("nre"))
