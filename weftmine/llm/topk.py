"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into a few segments, more at each level: all components as one, then sixteen, four and two a segment. With the means m and the lengths d of the deviations from them of
two vectors' segments of s components, the inner product is at most the sum of s * m1 * m2 + d1 * d2 (as the distance is
at least what the same statistics give). What a coarse bound leaves goes on to a finer one, and what the
finest leaves is computed exactly. A level that rules out next to nothing for the first queries of a block is not asked for the others.

Candidates stand by the signs of their segments' means, in blocks. Each query first meets its own block, which gives it a score that
its results reach at least. A block's statistics, the ranges of its means and its largest deviations, then bound all scores of a block of queries with it: only
pairs of blocks that this leaves open are brought together, and within them the bounds of single vectors go before exact scores.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors are only
compared with those of the same number of components; a row is compared with all others, those with the same id or components among them; a null id
takes no part; scores beyond 64 bits are held at the limit; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmine.operators.prefix import prefix_sums
from weftmine.session import cut

#: Bits of the code that vectors stand by; queries that show which levels rule anything out, and from which part on one is kept.
CODE, TRIED, WORTH = 16, 16, 0.02
#: Rows of a block of candidates, how many times fewer queries make one, and queries that a task works on at a time.
BLOCK, FEWER, STEP = 16384, 4, 128


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, scale: int = 1024) -> DataFrame:
    """id, n, x: the vectors that take part, as little-endian 64-bit numbers floor(scale * component); code, the signs of the finest segments' means."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("x", pa.binary()), ("code", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    whole = np.clip(np.floor(scale * x), -(2.0**62), 2.0**62)
                    signs = statistics(whole[None], min(len(x), CODE))[0][0] > 0 if len(x) else []
                    out.append((i, len(x), whole.astype("<i8").tobytes(), sum(1 << k for k, positive in enumerate(signs) if positive)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)

    return vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("v")).mapInArrow(rows, "id long, n int, x binary, code int")


def levels_of(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: all as one, then segments of 16, 4 and 2 components."""
    return sorted({1, *(n for n in (dim // 16, dim // 4, dim // 2) if n > 0)}) if dim else []


def statistics(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row and segment its mean and the length of its deviations; the segments' sizes."""
    edges = np.arange(level + 1) * x.shape[1] // level
    sizes = np.diff(edges)
    means = np.add.reduceat(x, edges[:-1], axis=1) / sizes
    deviations = np.add.reduceat((x - np.repeat(means, sizes, axis=1)) ** 2, edges[:-1], axis=1)
    return means, np.sqrt(deviations), sizes


def search(q_rows: np.ndarray, q: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's row, id, score: of each query's inner products with other rows the k highest (ties to the smaller id), those below its ``least`` perhaps left out."""
    dim = x.shape[1]
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(dim, 1)
    if top >= 2.0**53:  # beyond what doubles hold exactly
        exact = lambda a, at: np.clip((q[a].astype(object)[None] * x[at].astype(object)).sum(1), -(2**63), 2**63 - 1).astype(np.int64)
        levels = []
    else:
        qf, xf = q.astype(np.float64), x.astype(np.float64)
        exact = lambda a, at: (xf[at] @ qf[a]).astype(np.int64)
        levels = [(statistics(qf, n), statistics(xf, n)) for n in levels_of(dim)]
    out: tuple[list, list, list] = ([], [], [])
    came, went = np.zeros(len(levels)), np.zeros(len(levels))  # of the finer levels, for the first queries
    for begin in range(0, len(q), STEP):
        part = slice(begin, begin + STEP)
        bound = None
        if levels:
            (qm, qd, sizes), (xm, xd, _) = levels[0]
            bound = (qm[part] * sizes) @ xm.T + qd[part] @ xd.T
        for a in range(begin, min(begin + STEP, len(q))):
            at = np.flatnonzero(rows != q_rows[a])
            if bound is not None and len(at):
                slack = top * 1e-9 + 1e-6
                coarse, floor = bound[a - begin, at], float(least[a])
                if len(at) > 4 * k:
                    first = at[np.argpartition(-coarse, 4 * k - 1)[: 4 * k]]
                    floor = max(floor, float(np.partition(exact(a, first), -k)[-k]))
                at = at[coarse >= floor - slack]
                for n, ((qm, qd, sizes), (xm, xd, _)) in enumerate(levels[1:], 1):
                    finer = xm[at] @ (qm[a] * sizes) + xd[at] @ qd[a]
                    came[n] += len(at)
                    at = at[finer >= floor - slack]
                    went[n] += np.count_nonzero(finer < floor - slack)
                if a == TRIED:  # a level that rules next to nothing out here isn't asked any more
                    levels = [level for n, level in enumerate(levels) if not n or went[n] >= WORTH * came[n]]
                    came, went = np.zeros(len(levels)), np.zeros(len(levels))
            if not len(at):
                continue
            scores = exact(a, at)
            if len(at) > k:
                kth = np.partition(scores, -k)[-k]
                at, scores = at[scores >= kth], scores[scores >= kth]
            best = np.lexsort((ids[at], -scores))[:k]
            out[0].append(np.full(len(best), q_rows[a]))
            out[1].append(ids[at[best]])
            out[2].append(scores[best])
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in out)


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), n)


_BOX = "low array<double>, high array<double>, deviation array<double>"


def _box(x: np.ndarray) -> tuple[list, list, list]:
    """Of the finest segments of some vectors, the ranges of the means and the largest deviations."""
    if not x.shape[1]:
        return [], [], []
    means, deviations, _ = statistics(x.astype(np.float64), levels_of(x.shape[1])[-1])
    return means.min(0).tolist(), means.max(0).tolist(), deviations.max(0).tolist()


def _may_reach() -> Column:
    """Whether some vector in the box a_* may have a product of ``least`` or more with one in the box b_*."""
    corner = lambda i, p, q: F.get(p, i) * F.get(q, i)
    size = lambda i: F.floor((i + 1) * F.col("n") / F.size("a_low")) - F.floor(i * F.col("n") / F.size("a_low"))
    sides = [("a_low", "b_low"), ("a_low", "b_high"), ("a_high", "b_low"), ("a_high", "b_high")]
    most = lambda i: F.greatest(*(corner(i, p, q) for p, q in sides)) * size(i) + corner(i, "a_deviation", "b_deviation")
    largest = lambda i: F.greatest(*(F.abs(corner(i, p, q)) for p, q in sides)) * size(i) + corner(i, "a_deviation", "b_deviation")
    total = lambda f: F.aggregate(F.sequence(F.lit(0), F.size("a_low") - 1), F.lit(0.0), lambda s, i: s + f(i))
    return (F.size("a_low") == 0) | F.col("least").isNull() | (total(most) + total(largest) * 1e-9 + 1 >= F.col("least"))


def top_k(vectors: DataFrame, queries: Column, k: int = 10, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score, for each row that is a query. queries: which rows (by ``id``) are."""
    rows = cut(whole_numbers(vectors, vec_id, vector, scale).withColumn("row", F.monotonically_increasing_id()))
    blocks = -(-rows.count() // block)
    placed = rows.withColumn("__no", F.lit(0))
    if blocks > 1:
        placed = prefix_sums(rows.withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0)), ["__all"], ["n", "code", "row"], "__one", "__no")
    placed = placed.select("row", "id", "n", "x", queries.alias("query"), F.floor(F.col("__no") / block).alias("block"))
    placed = cut(placed) if blocks > 1 else placed

    # Each block by itself: the box of its vectors (row null), and its queries with their results in it.
    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("x", pa.binary()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64())), *((c, pa.list_(pa.float64())) for c in ("low", "high", "deviation"))])

    def own(table: pa.Table) -> pa.Table:
        out = []
        block = table.column("block")[0].as_py()
        for n in sorted(set(table.column("n").to_pylist())):
            part = table.filter(pc.equal(table.column("n"), n))
            x, ids, numbers = _matrix(part.column("x"), n), part.column("id").to_numpy(), part.column("row").to_numpy()
            out.append((block, n, None, None, None, None, None, *_box(x)))
            asked = np.flatnonzero(part.column("query").to_numpy(zero_copy_only=False))
            its_row, found, score = search(numbers[asked], x[asked], np.full(len(asked), -np.inf), numbers, ids, x, k)
            order = np.argsort(its_row, kind="stable")
            begins, ends = (np.searchsorted(its_row[order], numbers[asked], side=side) for side in ("left", "right"))
            for j, a in enumerate(asked.tolist()):
                mine = order[begins[j] : ends[j]]
                out.append((block, n, int(numbers[a]), int(ids[a]), x[a].tobytes(), found[mine].tolist(), score[mine].tolist(), None, None, None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    looked = cut(placed.groupBy("block").applyInArrow(own, f"block long, n int, row long, id long, x binary, ids array<long>, scores array<long>, {_BOX}"))
    near = looked.filter("row IS NOT NULL").select("row", F.col("id").alias("query_id"), F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("r"))
    near = near.select("row", "query_id", "r.vec_id", "r.score")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if blocks <= 1:
        return ranked(near)
    boxes = looked.filter("row IS NULL").select("n", F.col("block").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("low", "high", "deviation")))
    least = F.when(F.size("scores") >= k, F.element_at("scores", -1))
    asked = looked.filter("row IS NOT NULL").select("block", "n", "row", "id", "x", least.alias("least"), F.lit(1).alias("__one"), F.lit(0).alias("__all"))
    asked = prefix_sums(asked, ["__all"], ["n", "block", "row"], "__one", "__no").withColumn("a", F.floor(F.col("__no") / max(1, block // FEWER)))
    asked = cut(asked.drop("__one", "__all", "__no"))

    def boxed(table: pa.Table) -> pa.Table:
        a, n, floors = table.column("a")[0].as_py(), table.column("n")[0].as_py(), table.column("least")
        floor = None if floors.null_count else pc.min(floors).as_py()
        low, high, deviation = _box(_matrix(table.column("x"), n))
        return pa.table({"a": pa.array([a], pa.int64()), "n": pa.array([n], pa.int32()), "least": pa.array([floor], pa.int64()), **{f"a_{c}": pa.array([v], pa.list_(pa.float64())) for c, v in (("low", low), ("high", high), ("deviation", deviation))}})

    shapes = asked.groupBy("a", "n").applyInArrow(boxed, "a long, n int, least long, a_low array<double>, a_high array<double>, a_deviation array<double>")
    # b is long on both sides of what follows: numbers of other widths are dealt to other tasks, and blocks would miss their queries.
    pairs = shapes.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(boxes, ["n", "b"]).filter(_may_reach())
    pairs = cut(pairs.select("a", "b", "n"))

    def meet(asked: pa.Table, candidates: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)] * 3]
        if asked.num_rows and candidates.num_rows:
            n = asked.column("n")[0].as_py()
            least = asked.column("least").to_numpy(zero_copy_only=False).astype(float)
            found.append(search(asked.column("row").to_numpy(), _matrix(asked.column("x"), n), np.where(np.isnan(least), -np.inf, least), candidates.column("row").to_numpy(), candidates.column("id").to_numpy(), _matrix(candidates.column("x"), n), k))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table(dict(zip(("row", "vec_id", "score"), columns, strict=True)))

    left = asked.join(pairs, ["a", "n"]).filter("block <> b").select("a", "b", "n", "row", "x", "least")
    right = placed.join(pairs.withColumnRenamed("b", "block"), ["block", "n"]).select("a", F.col("block").alias("b"), "n", "row", "id", "x")
    far = left.groupBy("a", "b", "n").cogroup(right.groupBy("a", "b", "n")).applyInArrow(meet, "row long, vec_id long, score long")
    far = far.join(asked.select("row", F.col("id").alias("query_id")), "row").select("row", "query_id", "vec_id", "score")
    return ranked(near.union(far))
