"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector's difference from the nearest of a few centres is turned by one random rotation, and the signs of what comes out are its code: one bit a
component. With the difference's length and the product of its direction with the code's, two numbers, a query's products with the directions of all vectors
of a block are estimated from their packed bits: the query's rotated direction is rounded to four bits a component, and each of its four bit planes
meets the codes in one AND and one count of bits. The estimate's error, of the signs and of the rounding together, has a known spread; vectors whose distance may be within the best ones' by ``SPREADS``
of it are compared exactly, on the original components.

Vectors stand in blocks by their centres, a large centre's dealt to as many blocks as it needs by a hash of the row, so that copies spread as well. A query first searches its own
block, which bounds its k-th distance; centres whose vectors' lengths then can't let any come as near are left out, and all other blocks are searched under that bound. Centres are
fitted to a sample of at most ``SAMPLE`` vectors and 32 MB; every vector is coded and searched.

Defined results: vectors that are null, all zeros, or hold null or non-finite components take no part, nor do null ids; vectors are only
compared with those of the same number of components; a row is compared with all others, those with the same id or components among them; equal distances stand by the smaller id; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmine.llm.whitening import matrices, usable
from weftmine.session import cut, drop, stored

#: Vectors of a block, queries that meet a block at a time, centres, and vectors that these are fitted to, at most.
BLOCK, ASKED, CENTRES, SAMPLE = 8192, 2048, 256, 16384
#: Spreads of the estimate's error that count as possible.
SPREADS = 2.5
#: Bits of a query's rounded components.
PLANES = 4


@lru_cache(maxsize=4)
def rotation(length: int) -> np.ndarray:
    """One orthogonal matrix for each length, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(length).normal(size=(length, length)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    data = np.packbits(bits, axis=1)
    return np.pad(data, ((0, 0), (0, -data.shape[1] % 8))).view(np.uint64)


@dataclass
class Codes:
    """Some vectors about one centre: words of signs, the differences' lengths, and the products of their directions with the codes'."""

    words: np.ndarray
    norm: np.ndarray
    dot: np.ndarray


def coded(x: np.ndarray, centre: np.ndarray) -> Codes:
    difference = x - centre
    norm = np.sqrt((difference * difference).sum(1))
    turned = difference @ rotation(x.shape[1])
    total = np.abs(turned).sum(1) / np.sqrt(x.shape[1])
    return Codes(packed(turned > 0), norm, np.divide(total, norm, out=np.ones_like(norm), where=norm > 0))


def nearest_possible(q: np.ndarray, centre: np.ndarray, codes: Codes, spreads: float = SPREADS) -> tuple[np.ndarray, np.ndarray]:
    """Of one query and all vectors of a block, the estimated squared distances, and those that would hold if all errors were ``spreads`` spreads in favour."""
    length = len(q)
    difference = q - centre
    away = float(np.sqrt(difference @ difference))
    if not away:
        return codes.norm**2, codes.norm**2
    turned = difference @ rotation(length) / away
    low = float(turned.min())
    step = (float(turned.max()) - low) / (2**PLANES - 1)
    levels = np.rint((turned - low) / step).astype(np.uint8) if step else np.zeros(length, np.uint8)
    rounded = low + step * levels
    planes = packed((levels[None] >> np.arange(PLANES, dtype=np.uint8)[:, None]) & 1)
    ones = np.bitwise_count(codes.words).sum(1, dtype=np.int64)
    sums = sum((np.bitwise_count(codes.words & plane).sum(1, dtype=np.int64) << j) for j, plane in enumerate(planes))
    product = (2 * (low * ones + step * sums) - rounded.sum()) / np.sqrt(length) / codes.dot
    spread = np.sqrt(np.maximum(1 - codes.dot**2, 0) + ((turned - rounded) ** 2).sum()) / codes.dot / np.sqrt(max(length - 1, 1))
    squared = codes.norm**2 + away**2
    scale = 2 * away * codes.norm
    return squared - scale * product, squared - scale * np.minimum(product + spreads * spread, 1.0)


def search(q_rows: np.ndarray, q: np.ndarray, reach: np.ndarray, centre: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: Codes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's row, id, distance: of each query's other rows in a block the k nearest found, no farther than its ``reach``."""
    out: tuple[list, list, list] = ([], [], [])
    for row, vector, most in zip(q_rows, q, reach, strict=True):
        exact = lambda at: np.sqrt(((x[at] - vector) ** 2).sum(1))  # noqa: E731, B023
        guess, least = nearest_possible(vector, centre, codes)
        other = rows != row
        if other.sum() > 4 * k:
            first = np.flatnonzero(other)
            first = first[np.argpartition(guess[first], 4 * k)[: 4 * k]]
            most = min(most, np.partition(exact(first), k - 1)[k - 1])
        at = np.flatnonzero(other & (least <= most * most * (1 + 1e-9) + 1e-12))
        distance = exact(at)
        at, distance = at[distance <= most], distance[distance <= most]
        best = np.lexsort((ids[at], distance))[:k]
        out[0].append(np.full(len(best), row))
        out[1].append(ids[at[best]])
        out[2].append(distance[best])
    kinds = (np.int64, np.int64, np.float64)
    return tuple(np.concatenate([np.zeros(0, t), *c]) for c, t in zip(out, kinds, strict=True))


def fitted(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centres of a sample."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[np.random.default_rng(k).permutation(len(x))[:k]]
    for _ in range(rounds if len(centres) > 1 else 1):
        mine = _closest(x, centres)
        counts = np.bincount(mine, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def _centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """By length, centres: one for each BLOCK of vectors, CENTRES at most. The sample is the rows with the smallest hashes, in no particular order of theirs."""
    counts = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}
    if not counts:
        return {}
    wanted = min(SAMPLE, max(1, (1 << 25) // (8 * max(counts))))
    share = min(1.0, wanted / sum(counts.values()))
    hashed = F.pmod(F.xxhash64("id", "x"), F.lit(1 << 30))
    sample = rows.filter(hashed < int(share * (1 << 30))).select("length", "x", hashed.alias("h")).limit(2 * wanted).toArrow()
    sample = sample.sort_by([("h", "ascending")]).combine_chunks()
    found = {n: np.zeros((0, n)) for n in counts}
    if sample.num_rows:
        found |= {x.shape[1]: x.astype(float) for _, x in matrices(sample.column("x").combine_chunks())}
    return {n: fitted(x, min(CENTRES, -(-counts[n] // BLOCK))) for n, x in found.items()}


def codes(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows (row, id, x, length, query) with cluster, words, norm, dot."""
    form = pa.schema([("cluster", pa.int32()), ("words", pa.binary()), ("norm", pa.float64()), ("dot", pa.float64())])
    x_at = rows.columns.index("x")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cluster, norm, dot, words = np.zeros(n, np.int32), np.zeros(n), np.ones(n), [b""] * n
            for at, x in matrices(batch.column(x_at)):
                x = x.astype(float)
                mine = _closest(x, centres[x.shape[1]])
                made = coded(x, centres[x.shape[1]][mine])
                cluster[at], norm[at], dot[at] = mine, made.norm, made.dot
                for i, w in zip(at, made.words, strict=True):
                    words[i] = w.tobytes()
            columns = [pa.array(c, f.type) for c, f in zip((cluster, words, norm, dot), form, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *form.names])

    return rows.mapInArrow(code, ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), "cluster int, words binary, norm double, dot double"]))


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Codes]:
    """Rows, ids, vectors and codes of a block's table."""
    (_, x), *_ = matrices(table.column("x").combine_chunks())
    words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64).reshape(table.num_rows, -1)
    return table.column("row").to_numpy(), table.column("id").to_numpy(), x.astype(float), Codes(words, table.column("norm").to_numpy(), table.column("dot").to_numpy())


def neighbours(vectors: DataFrame, queries: Column, k: int = 10, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (the Euclidean distance), for each row that is a query. queries: which rows (by ``id``) are."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("x")).filter(F.col("id").isNotNull() & usable("x") & F.exists("x", lambda c: c != 0))
    rows = stored(raw.select(F.monotonically_increasing_id().alias("row"), "id", "x", F.size("x").alias("length"), F.coalesce(queries, F.lit(False)).alias("query")))
    centres = _centres(rows)
    if not centres:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    made = stored(codes(rows, centres))
    drop(rows)

    # A row for each centre: how many blocks its vectors need, how far from it they are, and where its queries' groups begin.
    place, blocks, reach = [], {}, {n: np.full((2, len(c)), [[np.inf], [-np.inf]]) for n, c in centres.items()}
    begin = groups = room = 0
    for r in made.groupBy("length", "cluster").agg(F.count("*").alias("n"), F.count_if("query").alias("asked"), F.min("norm").alias("low"), F.max("norm").alias("high")).orderBy("length", "cluster").collect():
        blocks[r.length, r.cluster] = -(-r.n // BLOCK)
        reach[r.length][:, r.cluster] = r.low, r.high
        if not groups or r.asked > room:
            begin, groups = begin + groups, max(1, -(-r.asked // ASKED))
            room = groups * ASKED
        room -= r.asked
        place.append((r.length, r.cluster, blocks[r.length, r.cluster], begin, groups))
    at = spark.createDataFrame(place, "length int, cluster int, blocks int, begin int, groups int")  # CENTRES rows for each length at most
    placed = made.join(F.broadcast(at.select("length", "cluster", "blocks")), ["length", "cluster"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")

    kind = dict(made.dtypes)["x"]
    element = pa.float32() if "float" in kind else pa.float64()
    form = pa.schema([("length", pa.int32()), ("cluster", pa.int32()), ("block", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("x", pa.list_(element)), ("reach", pa.float64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())), ("open", pa.list_(pa.int32()))])

    def own(table: pa.Table) -> pa.Table:
        """Each query of a block with its nearest there, and the centres that may have others as near."""
        length, cluster, block = (table.column(c)[0].as_py() for c in ("length", "cluster", "block"))
        numbers, ids, x, code = _block(table)
        asked = np.flatnonzero(table.column("query").to_numpy(zero_copy_only=False))
        row, found, distance = search(numbers[asked], x[asked], np.full(len(asked), np.inf), centres[length][cluster], numbers, ids, x, code, k)
        order = np.argsort(row, kind="stable")
        first, last = (np.searchsorted(row[order], numbers[asked], side=side) for side in ("left", "right"))
        low, high = reach[length]
        out = []
        for j, a in enumerate(asked.tolist()):
            mine = order[first[j] : last[j]]
            most = float(distance[mine[-1]]) if len(mine) == k else np.inf
            away = np.sqrt(((centres[length] - x[a]) ** 2).sum(1))
            may = (np.maximum(away - high, low - away) <= most * (1 + 1e-9) + 1e-9) & (low <= high)
            if blocks[length, cluster] == 1:
                may[cluster] = False
            out.append((length, cluster, block, int(numbers[a]), int(ids[a]), x[a].tolist(), most, found[mine].tolist(), distance[mine].tolist(), np.flatnonzero(may).tolist()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(form), form, strict=True)], schema=form)

    looked = stored(placed.groupBy("length", "cluster", "block").applyInArrow(own, f"length int, cluster int, block int, row long, id long, x {kind}, reach double, ids array<long>, scores array<double>, open array<int>"))
    near = looked.select("row", F.col("id").alias("query_id"), F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("r")).select("row", "query_id", "r.vec_id", "r.score")

    asked = looked.join(F.broadcast(at), ["length", "cluster"]).withColumn("group", F.col("begin") + F.pmod(F.xxhash64("row"), F.col("groups")).cast("int"))
    asked = asked.select("group", "length", F.col("cluster").alias("home"), F.col("block").alias("home_block"), "row", "id", "x", "reach", "open")
    pairs = asked.select("group", "length", F.explode("open").alias("cluster")).distinct().join(F.broadcast(at.select("length", "cluster", "blocks")), ["length", "cluster"])
    pairs = cut(pairs.select("group", "length", "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))

    def meet(asked: pa.Table, block: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if asked.num_rows and block.num_rows:
            length, cluster = asked.column("length")[0].as_py(), asked.column("cluster")[0].as_py()
            (_, q), *_ = matrices(asked.column("x").combine_chunks())
            found = search(asked.column("row").to_numpy(), q.astype(float), asked.column("reach").to_numpy(), centres[length][cluster], *_block(block), k)
        return pa.table(dict(zip(("row", "vec_id", "score"), found, strict=True)))

    key = ["group", "length", "cluster", "block"]
    left = asked.join(pairs, ["group", "length"]).filter(F.array_contains("open", F.col("cluster")) & ~((F.col("home") == F.col("cluster")) & (F.col("home_block") == F.col("block"))))
    left = left.select(*key, "row", "x", "reach")
    right = placed.join(pairs, ["length", "cluster", "block"]).select(*key, "row", "id", "x", "words", "norm", "dot")
    far = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "row long, vec_id long, score double")
    far = far.join(looked.select("row", F.col("id").alias("query_id")), "row").select("row", "query_id", "vec_id", "score")
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    return near.union(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
