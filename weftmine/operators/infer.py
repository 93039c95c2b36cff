"""Topic mixtures of queries, scores of items, and recommendations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftmine.functions.nnls import nnls_rows
from weftmine.operators.linalg import CELLS, cells_of, product_of_rows
from weftmine.sources.files import resolved


def _cells(queries: DataFrame) -> DataFrame:
    """Queries as ``product_of_rows`` takes them; those that are whole rows (pid, __cells: array of (item, v)) stay so."""
    return queries.select("pid", "__cells") if "__cells" in queries.columns else queries.select("pid", "item", F.col("val").alias("v"))


def by_dot(queries: DataFrame, h: DataFrame) -> DataFrame:
    """pid, k, v: q H for queries (pid, item, val) and loadings (item, k, v)."""
    return product_of_rows(queries.select("pid", "item", F.col("val").alias("v")), h, "pid", "item", "k")


def dense(h: DataFrame) -> tuple[list, list, np.ndarray]:
    """Loadings as items, topics and a matrix. They are as many as items times topics, a table for the driver by its model."""
    rows = h.collect()
    items, topics = sorted({r.item for r in rows}), sorted({r.k for r in rows})
    at, kt = {x: i for i, x in enumerate(items)}, {x: i for i, x in enumerate(topics)}
    out = np.zeros((len(items), len(topics)))
    for r in rows:
        out[at[r.item], kt[r.k]] = r.v
    return items, topics, out


def numbered(values: list, table: DataFrame, column: str) -> pa.Array:
    """Values in a table's type, for looking numbers up in batches."""
    return pa.array(values, to_arrow_type(table.schema[column].dataType))


def _every(rows: pa.Array, keys: pa.Array, x: np.ndarray, whole: bool, names: list[str]) -> pa.RecordBatch:
    """A full matrix as long rows (row, key, v), or as rows that stay whole."""
    n, m = x.shape
    again = keys.take(pa.array(np.tile(np.arange(m), n), pa.int64()))
    if not whole:
        return pa.RecordBatch.from_arrays([rows.take(pa.array(np.repeat(np.arange(n), m), pa.int64())), again, pa.array(x.ravel())], names=names)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.StructArray.from_arrays([again, pa.array(x.ravel())], names=names[1:]))
    return pa.RecordBatch.from_arrays([rows, lists], names=[names[0], "__cells"])


def by_least_squares(queries: DataFrame, h: DataFrame, non_negative: bool, whole: bool = False) -> DataFrame:
    """pid, k, v: the mixture that rebuilds each query best. A query's items stay together; H'q and its small system are worked out where they are, a batch at a time. whole: as (pid, __cells), as ``product_of_rows`` gives them."""
    _, topics, m = dense(h)
    gram = m.T @ m
    inverse = np.linalg.pinv(gram)
    keys = numbered(topics, h, "k")
    step = max(1, CELLS // max(1, len(topics)))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                target, _ = cells_of(part.column(1), keys)
                z = nnls_rows(gram, target) if non_negative else target @ inverse
                yield _every(part.column(0), keys, z, whole, ["pid", "k", "v"])

    right = product_of_rows(_cells(queries), h, "pid", "item", "k", whole=True)
    pid, kind = dict(queries.dtypes)["pid"], dict(h.dtypes)["k"]
    return right.mapInArrow(solve, f"pid {pid}, __cells array<struct<k:{kind},v:double>>" if whole else f"pid {pid}, k {kind}, v double")


def from_text(lines: DataFrame, names: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (pid, item, val) from free text (pid, text), and what of it neither a name (item, name) nor an alias (alias, canonical) explains (pid, token).

    Commas, semicolons, full-width marks and line ends part the tokens, so that names may hold spaces.
    """
    tokens = lines.select("pid", F.explode(F.split(F.coalesce("text", F.lit("")), "[,;\uFF0C\uFF1B\u3001\u3002\n]")).alias("token")).withColumn("token", F.trim("token")).filter("token <> ''")
    found = resolved(tokens, names, alias)
    return found.filter("item IS NOT NULL").select("pid", "item", F.lit(1.0).alias("val")).distinct(), found.filter("item IS NULL").select("pid", "token")


def case(lines: DataFrame, names: DataFrame, alias: DataFrame, by: DataFrame, to: DataFrame, most: int = 10, method: str = "nnls") -> DataFrame:
    """pid, item, score, rank: what a model recommends for free text in names of one view (loadings ``by``) from the other (loadings ``to``)."""
    queries, _ = from_text(lines, names, alias)
    return ranked(scores(infer(queries, by, method), to), most)


def infer(queries: DataFrame, h: DataFrame, method: str = "nnls", whole: bool = False) -> DataFrame:
    """pid, k, v by any method. whole: each entity's mixture as one row (pid, __cells: array of (k, v))."""
    if method == "dot":
        return product_of_rows(_cells(queries), h, "pid", "item", "k", whole=whole)
    if method in ("nnls", "ols"):
        return by_least_squares(queries, h, method == "nnls", whole)
    raise ValueError(f"unknown method {method}")


def smoothed(z: DataFrame, topics: DataFrame, alpha: float) -> DataFrame:
    """Dirichlet smoothing: (z + alpha) / sum, over all topics (k). Mixtures that are whole rows (pid, __cells) stay so."""
    names = [r.k for r in topics.select("k").distinct().orderBy("k").collect()]
    if "__cells" in z.columns:
        keys = numbered(names, topics, "k")
        step = max(1, CELLS // max(1, len(names)))

        def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, step):
                    part = batch.slice(begin, step)
                    x = cells_of(part.column(1), keys)[0] + alpha
                    yield _every(part.column(0), keys, x / x.sum(1, keepdims=True), True, ["pid", "k", "v"])

        return z.select("pid", "__cells").mapInArrow(smooth, f"pid {dict(z.dtypes)['pid']}, __cells array<struct<k:{dict(topics.dtypes)['k']},v:double>>")
    full = z.select("pid").distinct().withColumn("k", F.explode(F.array(*map(F.lit, names))))
    rows = full.join(z, ["pid", "k"], "left").select("pid", "k", (F.coalesce("v", F.lit(0.0)) + alpha).alias("v"))
    total = rows.groupBy("pid").agg(F.sum("v").alias("total"))
    return rows.join(total, "pid").select("pid", "k", (F.col("v") / F.col("total")).alias("v"))


def scores(z: DataFrame, target: DataFrame) -> DataFrame:
    """pid, item, score: z H' for mixtures (pid, k, v); an item that shares no topic has no row."""
    rows = product_of_rows(z, target.select("k", "item", "v"), "pid", "k", "item")
    return rows.select("pid", "item", F.round("v", 9).alias("score"))


def ranking(queries: DataFrame, by: DataFrame, to: DataFrame, method: str = "dot") -> DataFrame:
    """pid, found: scores of mixtures, each entity's as one array of (score, item) in ranked order. All products are made where an entity's items are, so that neither mixtures nor scores are dealt out."""
    rows = product_of_rows(infer(queries, by, method, whole=True), to.select("k", "item", "v"), "pid", "k", "item", whole=True)
    return rows.select("pid", F.sort_array(F.transform("__cells", lambda c: F.struct(F.round(c["v"], 9).alias("score"), c["item"].alias("item"))), asc=False).alias("found"))


def rankings(found: DataFrame) -> DataFrame:
    """Scores (pid, item, score) as rankings (pid, found); rankings as they are."""
    return found if "found" in found.columns else found.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("score", "item")), asc=False).alias("found"))


def ranked(found: DataFrame, most: int | None = None) -> DataFrame:
    """Scores, or rankings, with rank from 1 (ties to the larger item), the first ``most``."""
    if "found" in found.columns:
        first = F.col("found") if most is None else F.slice("found", 1, most)
        return found.select("pid", F.posexplode(first).alias("at", "x")).select("pid", "x.item", "x.score", (F.col("at") + 1).alias("rank"))
    order = Window.partitionBy("pid").orderBy(F.desc("score"), F.desc("item"))
    out = found.withColumn("rank", F.row_number().over(order))
    return out if most is None else out.filter(F.col("rank") <= most)


def folded(z: DataFrame, topics: int) -> DataFrame:
    """Mixtures (pid, k, v) of ``topics`` topics for each of several roles, numbered from 0 role by role, summed over roles."""
    return z.groupBy("pid", F.pmod("k", F.lit(topics)).cast(dict(z.dtypes)["k"]).alias("k")).agg(F.sum("v").alias("v"))


def greedy_formula(found: DataFrame, conflict: DataFrame, most: int = 10, weight: float = 0.5, mode: str = "soft") -> DataFrame:
    """pid, step, item, score: the best item again and again (ties to the larger), each choice lowering by ``weight`` (or, hard, ruling out) those in conflict with it, until none is above 0.

    found: scores, or rankings. An entity's scores are one array, and a batch of entities chooses at once. Conflicts of CELLS pairs at most, which are item-sized, go to the tasks; of more, each entity's scores bring their own.
    """
    if mode not in ("soft", "hard"):
        raise ValueError(f"unknown mode {mode}")
    kinds = dict(found.dtypes)
    whole = "found" in found.columns
    item = found.schema["found"].dataType.elementType["item"].dataType.simpleString() if whole else kinds["item"]
    foes = conflict.select(F.col("i").cast(item), F.col("j").cast(item)).distinct()
    pairs = foes.limit(CELLS + 1).toArrow()
    few = pairs.num_rows <= CELLS
    cell = F.struct(F.col("score").cast("double").alias("score"), "item")
    if few:
        cells = F.transform("found", lambda c: F.struct(c["score"].cast("double").alias("score"), c["item"].alias("item"))) if whole else F.collect_list(cell)
        rows = found.select("pid", cells.alias("found")) if whole else found.groupBy("pid").agg(cells.alias("found"))
        rows = rows.withColumn("own", F.array().cast(f"array<struct<i:{item},j:{item}>>"))
    else:
        long = found.select("pid", F.explode("found").alias("c")).select("pid", "c.score", "c.item") if whole else found
        own = foes.groupBy(F.col("i").alias("item")).agg(F.collect_list(F.struct("i", "j")).alias("foes"))
        rows = long.join(own, "item", "left").groupBy("pid").agg(F.collect_list(cell).alias("found"), F.flatten(F.collect_list("foes")).alias("own"))
    first, second = pairs.column(0).combine_chunks(), pairs.column(1).combine_chunks()

    def best(part: pa.RecordBatch) -> pa.RecordBatch:
        lists, own = part.column("found"), part.column("own")
        flat, more = lists.flatten(), own.flatten()
        which = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
        items = pc.unique(flat.field("item"))
        items = items.take(pc.array_sort_indices(items, order="descending"))  # so that the first of equals is the larger
        left = np.full((part.num_rows, len(items)), -np.inf)
        value = flat.field("score").fill_null(-np.inf).to_numpy(zero_copy_only=False)
        np.maximum.at(left, (which, pc.index_in(flat.field("item"), items).to_numpy(zero_copy_only=False)), value)
        i, j = (pc.fill_null(pc.index_in(c, items), -1).to_numpy(zero_copy_only=False) for c in ((first, second) if few else (more.field("i"), more.field("j"))))
        held = np.unique(np.stack([i, j], 1)[(i >= 0) & (j >= 0)], axis=0).reshape(-1, 2)
        begins, ends = (np.searchsorted(held[:, 0], np.arange(len(items)), side=side) for side in ("left", "right"))
        hits, open_, out = np.zeros(left.shape), np.arange(part.num_rows), []
        for step in range(most if len(items) else 0):
            now = left[open_] - weight * hits[open_]
            at = now.argmax(1)
            score = now[np.arange(len(open_)), at]
            open_, at, score = (a[score > 0] for a in (open_, at, score))
            if not len(open_):
                break
            out.append((open_, np.full(len(open_), step + 1), at, score))
            left[open_, at] = -np.inf
            n = ends[at] - begins[at]
            met = held[np.repeat(begins[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), 1]
            who = np.repeat(open_, n)
            if mode == "hard":
                left[who, met] = -np.inf
            else:
                hits[who, met] += 1
        row, step, at, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.RecordBatch.from_arrays([part.column("pid").take(pa.array(row, pa.int64())), pa.array(step, pa.int32()), items.take(pa.array(at, pa.int64())), pa.array(score, pa.float64())], names=["pid", "step", "item", "score"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("found").offsets.to_numpy())
            begin = 0
            while begin < batch.num_rows:  # as many rows as may not have more items by rows than CELLS
                total = np.cumsum(sizes[begin:])
                end = begin + max(1, int(np.searchsorted(total * np.arange(1, len(total) + 1), CELLS, side="right")))
                yield best(batch.slice(begin, end - begin))
                begin = end

    return rows.mapInArrow(chosen, f"pid {kinds['pid']}, step int, item {item}, score double")


def topic_items(h: DataFrame, most: int) -> DataFrame:
    """k, item, v, rank: each topic's heaviest items."""
    order = Window.partitionBy("k").orderBy(F.desc(F.round("v", 9)), F.desc("item"))
    return h.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("k", "item", "v", "rank")


def explained(most: int, **sides: DataFrame) -> DataFrame:
    """side, k, item, rank, v: the heaviest of each topic in each of several tables (item, k, v), such as loadings of the views, of doses, and mixtures with entities as items.

    Items are given as text. Before rows of a topic meet, each task keeps only its ``most`` first ones, so that entities may be any number.
    """
    out = None
    for side, rows in sides.items():
        best = topic_items(rows.select(F.col("item").cast("string").alias("item"), "k", "v"), most)
        named = best.select(F.lit(side).alias("side"), "k", "item", "rank", "v")
        out = named if out is None else out.union(named)
    if out is None:
        raise ValueError("no side is given")
    return out


def topic_usage(z: DataFrame, n: int, most: int) -> DataFrame:
    """k, usage: topics by their mean weight over n entities."""
    usage = z.groupBy("k").agg(F.round(F.sum("v") / n, 6).alias("usage"))
    return usage.orderBy(F.desc("usage"), "k").limit(most)


def active_topics(z: DataFrame, most: int = 3) -> DataFrame:
    order = Window.partitionBy("pid").orderBy(F.desc(F.round("v", 9)), "k")
    return z.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
