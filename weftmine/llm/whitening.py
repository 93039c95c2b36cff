"""Whitening of embeddings by a tall-skinny QR.

Components become whole numbers floor(scale * c), so that sums over all rows are exact in any order. The rows to fit on, each distinct vector once, are centred
with these sums, each task reduces its rows to the triangle R of their QR, and triangles are merged sixteen at a time up a tree. The last one's singular values and
right vectors are those of the whole centred table: they give variances and directions, and no covariance is ever formed.

Defined results: a vector that is null or holds null or non-finite components takes no part; rows with equal ids, or null ones, are rows of their own; vectors of each
length are fitted by themselves, and an empty one has no components and no rows; numbers beyond 64 bits are held at the limit; a direction without
variance (as with one distinct vector) has whitened 0 and explained 0, and identity_error is 1 then, as no scaling makes that variance 1; an empty table
gives no rows; other columns are carried by ``transform`` and not read otherwise. The driver holds a matrix of a vector's length squared for each length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmine.session import cut, drop, stored

#: Factors that one task merges.
FAN = 16
LIMIT = 2**63 - 1


@dataclass
class Axes:
    """What is fitted for one length: n and sums of the distinct vectors, directions (length x k), their variances, all directions' variance, and how far whitened vectors' covariance is from the identity."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    error: float = 0.0

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        scale = np.divide(1.0, np.sqrt(self.variances), out=np.zeros_like(self.variances), where=self.variances > 0)
        return (centred @ self.directions) * scale


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def whole(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each length in a column of lists, the rows that have it and their matrix."""
    offsets = column.offsets.to_numpy()
    sizes, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, flat[offsets[at][:, None] + np.arange(n)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, in whole numbers, as Python's where 64 bits wouldn't do."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if (most + 1) * n + max(map(abs, sums), default=0) <= LIMIT:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(y: np.ndarray) -> np.ndarray:
    """Sums of squares by rows, exact up to the limit of 64 bits."""
    most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    if y.dtype != object and most * most * max(1, y.shape[1]) <= LIMIT:
        return (y * y).sum(1)
    return np.minimum((y.astype(object) ** 2).sum(1), LIMIT).astype(np.int64)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length, how many vectors there are and their sums: each task sends one number a component."""
    form = pa.schema([("length", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for at, x in matrices(batch.column(0)):
                most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * len(at)
                mine = found.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                mine[0] += len(at)
                mine[1] = [a + int(b) for a, b in zip(mine[1], (x if most <= LIMIT else x.astype(object)).sum(0), strict=True)]
        rows = [(length, i, n, Decimal(total)) for length, (n, totals) in found.items() for i, total in enumerate(totals)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(form)], schema=form)

    sums = rows.mapInArrow(partial, "length int, i int, n long, total decimal(38,0)").groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("length", "i").collect():
        out.setdefault(r.length, (r.n, []))[1].append(int(r.total))
    return out


def _merged(parts: DataFrame, merge: Callable[[list[bytes], int], bytes]) -> dict[int, bytes]:
    """By length, the one value left of parts (length, slot, value) when FAN neighbours at a time are merged. Parts are cut: one for each task and length."""
    parts = cut(parts)
    slots = parts.agg(F.max("slot")).first()[0]

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slot")
        length = int(frame["length"].iloc[0])
        return pd.DataFrame({"length": [length], "slot": [int(frame["slot"].iloc[0]) // FAN], "value": [merge(list(frame["value"]), length)]})

    while slots:
        parts = parts.groupBy("length", F.floor(F.col("slot") / FAN).alias("__to")).applyInPandas(together, parts.schema)
        slots //= FAN
    return {r.length: bytes(r.value) for r in parts.collect()}


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def _factor(rows: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length, the triangle of all centred rows."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                if length := x.shape[1]:
                    n, s = sums[length]
                    y = (centred(x, n, s) / n).astype(float)
                    found[length] = triangle([found[length], y] if length in found else [y])
        slot = _partition()
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(found), pa.int32()), "slot": pa.array([slot] * len(found), pa.int64()), "value": pa.array([np.ascontiguousarray(r).tobytes() for r in found.values()], pa.binary())})

    merge = lambda values, length: np.ascontiguousarray(triangle([np.frombuffer(v).reshape(-1, length) for v in values])).tobytes()
    found = _merged(rows.mapInArrow(reduced, "length int, slot long, value binary"), merge)
    return {length: np.frombuffer(r).reshape(-1, length) for length, r in found.items()}


def pooled(a: tuple, b: tuple) -> tuple:
    """Count, means and centred products of two sets together."""
    (n, m, p), (k, q, r) = a, b
    if not n or not k:
        return b if k else a
    d = q - m
    return n + k, m + d * (k / (n + k)), p + r + np.outer(d, d) * (n * k / (n + k))


def _errors(rows: DataFrame, model: dict[int, Axes]) -> dict[int, float]:
    """By length, the largest entry of |covariance of whitened vectors - identity|, measured on the vectors themselves."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            for at, x in matrices(batch.column(0)):
                if length := x.shape[1]:
                    axes = model[length]
                    w = axes.whitened((centred(x, axes.n, axes.sums) / axes.n).astype(float))
                    mean = w.mean(0)
                    one = (len(at), mean, (w - mean).T @ (w - mean))
                    found[length] = pooled(found[length], one) if length in found else one
        slot = _partition()
        values = [np.concatenate([[n], m, p.ravel()]).tobytes() for n, m, p in found.values()]
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(found), pa.int32()), "slot": pa.array([slot] * len(found), pa.int64()), "value": pa.array(values, pa.binary())})

    def split(value: bytes) -> tuple:
        x = np.frombuffer(value)
        k = round((4 * len(x) - 3) ** 0.5 - 1) // 2
        return x[0], x[1 : 1 + k], x[1 + k :].reshape(k, k)

    def merge(values: list[bytes], length: int) -> bytes:
        whole = split(values[0])
        for v in values[1:]:
            whole = pooled(whole, split(v))
        return np.concatenate([[whole[0]], whole[1], whole[2].ravel()]).tobytes()

    found = _merged(rows.mapInArrow(measured, "length int, slot long, value binary"), merge)
    return {length: float(np.abs(p / n - np.eye(len(p))).max()) for length, (n, _, p) in ((length, split(v)) for length, v in found.items())}


def fit(vectors: DataFrame, k: int | None = None, *, vector: str = "embedding", scale: int = 256) -> dict[int, Axes]:
    """By length, the k directions of most variance (all, without k) of the distinct vectors. Of a direction's two signs, the one whose largest entry is positive."""
    rows = stored(vectors.filter(usable(vector)).select(whole(vector, scale).alias("x")).distinct())
    sums = _sums(rows)
    model = {}
    for length, r in (_factor(rows, sums) if sums else {}).items():
        n, s = sums[length]
        _, values, right = np.linalg.svd(r)
        values = np.pad(values, (0, length - len(values)))
        values[values <= values.max() * length * 1e-15] = 0.0
        directions = right[:k].T
        directions = directions * np.where(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])] < 0, -1.0, 1.0)
        model[length] = Axes(n, s, directions, values[:k] ** 2 / n, float((values**2).sum() / n))
    for length, error in (_errors(rows, model) if model else {}).items():
        model[length].error = error
    drop(rows)
    return model


def transform(vectors: DataFrame, model: dict[int, Axes], *, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The rows whose vector takes part, with a column ``whitening``: n, deviation (the sum of (n*x - S)^2), whitened and explained (arrays by component), identity_error."""
    kind = "struct<n:bigint,deviation:bigint,whitened:array<double>,explained:array<double>,identity_error:double>"
    floats = pa.list_(pa.float64())

    @F.arrow_udf(kind)
    def whitening(column: pa.Array) -> pa.Array:
        n, deviation, error = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64), np.zeros(len(column))
        w: list = [[]] * len(column)
        shares: list = [[]] * len(column)
        for at, x in matrices(column):
            if (axes := model.get(x.shape[1])) is None:
                continue
            y = centred(x, axes.n, axes.sums)
            n[at], deviation[at], error[at] = axes.n, squares(y), axes.error
            share = (axes.variances / axes.trace if axes.trace else axes.variances).tolist()
            for i, row in zip(at, axes.whitened((y / axes.n).astype(float)).tolist(), strict=True):
                w[i], shares[i] = row, share
        return pa.StructArray.from_arrays([pa.array(n), pa.array(deviation), pa.array(w, floats), pa.array(shares, floats), pa.array(error)], ["n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.filter(usable(vector)).withColumn("whitening", whitening(whole(vector, scale)))


def components(vectors: DataFrame, k: int = 4, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = transform(vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")), fit(vectors, k, vector=vector, scale=scale), vector="v", scale=scale)
    each = F.posexplode(F.arrays_zip("whitening.whitened", "whitening.explained")).alias("i", "c")
    return rows.select("vec_id", "whitening", each).select("vec_id", (F.col("i") + 1).alias("component"), "whitening.n", "whitening.deviation", "c.whitened", "c.explained", "whitening.identity_error")
