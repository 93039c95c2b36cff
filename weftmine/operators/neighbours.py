"""Exact nearest neighbours by cosine, with cells of vectors whose angles rule most other cells out.

Vectors stand in cells around a few centres, and each cell knows the least and the largest angle between its centre and its vectors. A vector's angle to any other is at least
what its angle to that one's centre lies outside this range, so that its similarity to a whole cell is bounded by one product. The k-th similarity within its own block, which is looked
through first, then leaves open only cells that may hold as near ones. How many those are hangs on the vectors: bundles leave few, directions without any structure nearly all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmine.session import cut, drop, stored

#: Centres, and vectors that they are fitted to, at most; 32 MB of these.
CENTRES, SAMPLE = 256, 16384
#: Of similarities, which are rounded to nine digits.
SLACK = 1e-8
#: Bytes of a block's vectors, and products that a task holds at a time (16 MB).
BLOCK, SLICE = 1 << 23, 1 << 21


@dataclass
class Cells:
    """Centres of length 1, and the range of angles between each and its vectors."""

    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def most(self, x: np.ndarray) -> np.ndarray:
        """By row and cell, what no similarity of the row with a vector of the cell is above. A row of zeros has similarity 0 with all; cells without vectors have none."""
        angle = np.arccos(np.clip(x @ self.centres.T, -1, 1))
        least = np.maximum(np.maximum(angle - self.high, self.low - angle), 0)
        out = np.where(self.low <= self.high, np.cos(least), -np.inf)
        zero = ~x.any(axis=1)
        out[zero] = np.where(self.low <= self.high, 0.0, -np.inf)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def fitted(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k directions of a sample of unit vectors: each the mean of those nearest to it."""
    centres = x[np.random.default_rng(k).permutation(len(x))[:k]]
    for _ in range(rounds if k > 1 else 1):
        mine = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, x)
        centres = np.where(np.bincount(mine, minlength=len(centres))[:, None] > 0, unit(sums), centres)
    return centres


def best(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, sim: of each row of x the k most similar rows of y with another id, ties to the smaller id. others must be in order, each id once. least: what similarities of a row must reach.

    Of a slice of rows at a time only products that may be among the k are rounded and sorted.
    """
    found, step = [], max(1, SLICE // max(1, len(y)))
    for begin in range(0, len(x) if len(y) else 0, step):
        part = slice(begin, begin + step)
        sim = x[part] @ y.T
        if least is not None:
            floor = least[part]
        elif len(y) > k + 1:  # one of them may be the row itself
            floor = np.partition(sim, len(y) - k - 1, axis=1)[:, len(y) - k - 1]
        else:
            floor = np.full(len(sim), -np.inf)
        row, col = np.nonzero(sim >= floor[:, None] - SLACK)
        value, row = np.round(sim[row, col], 9) + 0.0, row + begin
        use = ids[row] != others[col]
        if least is not None:
            use &= value >= least[row]
        row, col, value = row[use], col[use], value[use]
        order = np.lexsort((col, -value, row))
        row, col, value = row[order], col[order], value[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((ids[row[first]], others[col[first]], value[first]))
    if not found:
        return ids[:0], others[:0], np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def block_of(n: int, width: int) -> int:
    """How many vectors a block has, if not told: a 24th of all, so that what moves grows as they do, within 2048 and BLOCK bytes."""
    return max(1, min(max(2048, -(-n // 24)), BLOCK // (8 * width)))


def open_pairs(vectors: DataFrame, k: int, block: int | None) -> tuple[DataFrame, DataFrame, DataFrame, Cells, dict[int, int]]:
    """Of vectors (id, vector): all by cell and block (id, x, cell, block); within blocks, each one's k nearest, k-th similarity and open cells (id, x, cell, block, ids, sims, least, open); the pairs of
    blocks (a_cell, a_block, cell, block) that are still to meet; the cells and how many blocks each has."""
    spark = vectors.sparkSession
    rows = stored(vectors.select("id", F.col("vector").cast("array<double>").alias("x")))
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = shape.n, shape.width or 1
    block = block or block_of(n, width)
    wanted = min(SAMPLE, max(1, (1 << 25) // (8 * width)))
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sample = rows.filter(hashed < int(min(1.0, wanted / max(1, n)) * (1 << 30))).select("x", hashed.alias("h")).limit(2 * wanted).toArrow().sort_by([("h", "ascending")])
    x = unit(matrix(sample.column("x"))) if sample.num_rows else np.zeros((0, width))
    x = x[x.any(axis=1)]
    centres = fitted(x, min(CENTRES, max(1, -(-n // block)), len(x))) if len(x) else np.eye(1, width)

    def placed(batches):
        for batch in batches:
            x = unit(matrix(batch.column("x")))
            cell = (x @ centres.T).argmax(1) if len(x) else np.zeros(0, int)
            angle = np.arccos(np.clip((x * centres[cell]).sum(1), -1, 1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), flat, pa.array(cell, pa.int32()), pa.array(angle)], names=["id", "x", "cell", "angle"])

    kind = dict(rows.dtypes)["id"]
    dealt = stored(rows.mapInArrow(placed, f"id {kind}, x array<double>, cell int, angle double"))
    drop(rows)
    cells, blocks = Cells(centres, np.full(len(centres), np.inf), np.full(len(centres), -np.inf)), {}
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # CENTRES rows at most
        cells.low[r.cell], cells.high[r.cell], blocks[r.cell] = r.low, r.high, -(-r.n // block)
    many = spark.createDataFrame(sorted(blocks.items()), "cell int, blocks int")
    dealt = dealt.drop("angle").join(F.broadcast(many), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")

    form = f"id {kind}, x array<double>, cell int, block int, ids array<{kind}>, sims array<double>, least double, open array<int>"

    def own(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, x, cell = table.column("id").to_numpy(), matrix(table.column("x")), table.column("cell")[0].as_py()
        i, j, sim = best(ids, x, ids, x, k)
        bound, out = cells.most(x), []
        first, last = np.searchsorted(i, ids, side="left"), np.searchsorted(i, ids, side="right")
        for a in range(len(ids)):
            part = slice(first[a], last[a])
            least = float(sim[part][-1]) if last[a] - first[a] >= k else -np.inf
            may = bound[a] >= least - SLACK
            may &= np.isfinite(bound[a])
            if blocks[cell] == 1:
                may[cell] = False
            out.append((ids[a].item(), x[a].tolist(), cell, table.column("block")[0].as_py(), j[part].tolist(), sim[part].tolist(), least, np.flatnonzero(may).tolist()))
        return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    names = [c.split()[0] for c in form.split(", ")]
    number = pa.int64() if kind == "bigint" else pa.int32()
    schema = pa.schema([("id", number), ("x", pa.list_(pa.float64())), ("cell", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(number)), ("sims", pa.list_(pa.float64())), ("least", pa.float64()), ("open", pa.list_(pa.int32()))])
    looked = stored(dealt.groupBy("cell", "block").applyInArrow(own, form))
    pairs = looked.select(F.col("cell").alias("a_cell"), F.col("block").alias("a_block"), F.explode("open").alias("cell")).distinct().join(F.broadcast(many), "cell")
    pairs = pairs.select("a_cell", "a_block", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).filter("NOT (a_cell = cell AND a_block = block)")
    return dealt, looked, cut(pairs), cells, blocks


def meetings(looked: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (a_cell, a_block, cell, block, id, x, least) of the blocks that meet. Two blocks meet once, whichever asks; a row goes there if it asks, or if the other block does. least is infinite for rows that only answer."""
    one, other = F.struct(F.col("a_cell").alias("cell"), F.col("a_block").alias("block")), F.struct("cell", "block")
    met = pairs.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"), (one < other).alias("up"))
    met = met.groupBy("a", "b").agg(F.max("up").alias("up"), F.max(~F.col("up")).alias("down"))
    met = cut(met.select(F.col("a.cell").alias("a_cell"), F.col("a.block").alias("a_block"), F.col("b.cell").alias("cell"), F.col("b.block").alias("block"), "up", "down"))

    def side(own: list[str], far: str, asks: str, answers: str) -> DataFrame:
        rows = looked.select(F.col("cell").alias(own[0]), F.col("block").alias(own[1]), "id", "x", "least", "open").join(met, own)
        asking = F.col(asks) & F.array_contains("open", F.col(far))
        kept = [F.col(c).alias(c) for c in ("a_cell", "a_block", "cell", "block", "id", "x")]  # columns of its own, as both sides are of one table
        return rows.filter(asking | F.col(answers)).select(*kept, F.when(asking, F.col("least")).otherwise(F.lit(float("inf"))).alias("least"))

    return side(["a_cell", "a_block"], "cell", "up", "down"), side(["cell", "block"], "a_cell", "down", "up")


def vector_neighbours(vectors: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """i, j, sim: the k nearest others of each vector (id, vector) by cosine, ties to the smaller id; all, if fewer.

    ids are whole numbers, each once. Vectors of zeros have similarity 0 with all. Blocks hold about ``block`` vectors of one cell (if not given, ``block_of``); a cell of many, copies of one vector among them, has several. A task holds
    the vectors of two blocks, which answer each other in one meeting.
    """
    _, looked, pairs, _, _ = open_pairs(vectors, k, block)
    kind = dict(looked.dtypes)["id"]
    key = ["a_cell", "a_block", "cell", "block"]
    left, right = meetings(looked, pairs)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if a.num_rows and b.num_rows:
            (i, x, at), (j, y, bt) = ((t.column("id").to_numpy(), matrix(t.column("x")), t.column("least").to_numpy()) for t in (a.sort_by("id"), b.sort_by("id")))
            for ids, rows, least, others, far in ((i, x, at, j, y), (j, y, bt, i, x)):
                asks = least < np.inf
                found.append(best(ids[asks], rows[asks], others, far, k, least[asks]))
        return pa.table(dict(zip(("i", "j", "sim"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))

    near = looked.select(F.col("id").alias("i"), F.explode(F.arrays_zip(F.col("ids").alias("j"), F.col("sims").alias("sim"))).alias("r")).select("i", "r.j", "r.sim")
    far = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "i long, j long, sim double")
    order = Window.partitionBy("i").orderBy(F.desc("sim"), "j")
    found = near.union(far.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "sim"))
    return found.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= k).drop("__rn")


def visited_share(vectors: DataFrame, k: int, block: int | None = None) -> float:
    """What part of all pairs of vectors is compared: the blocks' own, and those of vectors with the blocks of cells that their bounds leave open."""
    dealt, looked, _, _, _ = open_pairs(vectors, k, block)
    sizes = dealt.groupBy("cell", "block").agg(F.count("*").alias("n"))
    cells = sizes.groupBy("cell").agg(F.sum("n").alias("n"))
    own = looked.join(sizes, ["cell", "block"]).agg(F.sum("n")).first()[0] or 0
    asked = looked.select(F.col("cell").alias("home"), F.col("block"), F.explode("open").alias("cell"))
    rest = asked.join(cells, "cell").join(sizes.select(F.col("cell").alias("home"), "block", F.col("n").alias("mine")), ["home", "block"])
    rest = rest.agg(F.sum(F.col("n") - F.when(F.col("cell") == F.col("home"), F.col("mine")).otherwise(0))).first()[0] or 0
    n = looked.count()
    return (own + rest) / max(1, n * n)
