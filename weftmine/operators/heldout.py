"""Perplexity of items held out within entities, in one pass over entities as arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmine.functions.nnls import nnls_rows
from weftmine.operators.infer import dense, folded, infer, numbered, scores, smoothed
from weftmine.operators.linalg import cells_of, held
from weftmine.operators.metrics import perplexity
from weftmine.operators.split import draw

#: Cells of rebuilt rows that a task holds at a time: 16 MB.
CELLS = 2_000_000


def heldout_perplexity(x: DataFrame, h: DataFrame, n_items: int, *, target: DataFrame | None = None, ratio: float = 0.2, seeds: Sequence[int] = (42,), method: str = "nnls", alpha: float | None = None, eps: float = 1e-10) -> DataFrame:
    """seed, n, ppl: of each entity with two items or more, the first floor(ratio * items) in an order drawn by hashes (one at least) are held out, the others give its mixture, and the
    mean negative log share of the held ones is what ppl is the exponential of.

    x: pid, item, val; h: item, k, v, the loadings that mixtures are inferred by, and ``target`` those that items are predicted by (h, if not given). With
    ``alpha`` the loadings are made shares within topics and mixtures are cut at 0, raised by alpha and made shares; else scores are cut at 0, raised by ``eps`` and made shares
    of all n_items. Every seed is a mask of its own over the same pass, solved against one Gram matrix. Items without loadings help no mixture and have a share of ``eps``.
    Without entities of two items n is 0 and ppl 0. ratio 0.5 is the split by halves.
    """
    if method not in ("nnls", "ols", "dot"):
        raise ValueError(f"unknown method {method}")
    items, topics, m = dense(h)
    if target is None:
        to = m
    else:
        found = {(r.item, r.k): r.v for r in target.collect()}
        to = np.array([[found.get((i, k), 0.0) for k in topics] for i in items]).reshape(m.shape)
    if alpha is not None:
        to = to / (to.sum(0, keepdims=True) + eps)
    gram = m.T @ m
    inverse = np.linalg.pinv(gram) if method == "ols" else None
    names = numbered(items, x, "item")
    cells = x.groupBy("pid").agg(F.collect_list(F.struct("item", F.col("val").cast("double").alias("val"), *(draw("pid", "item", seed=s).alias(f"d{i}") for i, s in enumerate(seeds)))).alias("cells")).filter(F.size("cells") >= 2).select("cells")
    step = max(1, CELLS // max(1, len(items)))

    def places(row: np.ndarray, drawn: pa.Array, item: pa.Array) -> np.ndarray:
        """Of each cell the place in its row's drawn order, from 0; equal draws by item."""
        order = pc.sort_indices(pa.table({"row": row, "drawn": drawn, "item": item}), sort_keys=[("row", "ascending"), ("drawn", "ascending"), ("item", "ascending")]).to_numpy()
        out = np.empty(len(row), int)
        out[order] = np.arange(len(row)) - np.searchsorted(row, row[order])
        return out

    def mixtures(right: np.ndarray) -> np.ndarray:
        if method == "nnls":
            return nnls_rows(gram, right)
        return right if inverse is None else right @ inverse

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(seeds)), np.zeros(len(seeds), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step).column(0)
                sizes = np.diff(part.offsets.to_numpy())
                row, flat = np.repeat(np.arange(len(part)), sizes), part.flatten()
                no, value = pc.fill_null(pc.index_in(flat.field("item"), names), -1).to_numpy(zero_copy_only=False), flat.field("val").to_numpy(zero_copy_only=False)
                n_held = np.maximum(1, (sizes * ratio + 1e-9).astype(int))
                masks = [places(row, flat.field(f"d{i}"), flat.field("item")) < n_held[row] for i in range(len(seeds))]
                right = np.zeros((len(seeds), len(part), len(topics)))
                for i, held in enumerate(masks):
                    use = ~held & (no >= 0)
                    np.add.at(right[i], row[use], value[use, None] * m[no[use]])
                solved = mixtures(right.reshape(-1, len(topics))).reshape(right.shape)
                for i, (held, z) in enumerate(zip(masks, solved, strict=True)):
                    if alpha is None:
                        share = np.maximum(z @ to.T, 0) + eps
                        share /= share.sum(1, keepdims=True) + eps * max(0, n_items - len(items))
                    else:
                        z = np.maximum(z, 0) + alpha
                        share = np.maximum((z / z.sum(1, keepdims=True)) @ to.T, eps)
                    own = np.where(no[held] >= 0, share[row[held], no[held]] if len(items) else eps, eps)
                    total[i] += np.log(own).sum()
                    count[i] += held.sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(seeds), pa.int64()), pa.array(count), pa.array(total)], names=["seed", "n", "log"])

    sums = cells.mapInArrow(judged, "seed long, n long, log double").groupBy("seed").agg(F.sum("n").alias("n"), F.sum("log").alias("log"))
    return sums.select("seed", "n", F.when(F.col("n") > 0, F.exp(-F.col("log") / F.col("n"))).otherwise(0.0).alias("ppl"))


def predictive_perplexity(source: DataFrame, truth: DataFrame, by: DataFrame, to: DataFrame, n_items: int, *, method: str = "nnls", alpha: float | None = None, topics: int | None = None, eps: float = 1e-10) -> DataFrame:
    """ppl of one view's items (truth: pid, item, val) by mixtures inferred from the other's (source), for entities that have both.

    topics: how many topics ``to`` has, where ``by`` has that many for each of several roles, numbered role by role: mixtures are summed over roles. alpha: as for held-out items.
    """
    model, target = held(by, "item", "k"), held(to, "item", "k")
    if model is None or target is None:
        z = infer(source.join(truth.select("pid").distinct(), "pid", "left_semi"), by, method)
        z = z if topics is None else folded(z, topics)
        if alpha is not None:
            sums = to.groupBy("k").agg((F.sum("v") + eps).alias("__sum"))
            to = to.join(sums, "k").select("item", "k", (F.col("v") / F.col("__sum")).alias("v"))
            z = smoothed(z.withColumn("v", F.greatest("v", F.lit(0.0))), to, alpha)
        return perplexity(scores(z, to), truth, n_items, eps)
    if method not in ("nnls", "ols", "dot"):
        raise ValueError(f"unknown method {method}")
    items, names, m, there = model
    goal, goal_names, h, goal_there = target
    if alpha is not None:
        h = h / (h.sum(0, keepdims=True) + eps)
    of = [k if topics is None else k % topics for k in names.to_pylist()]
    fold = np.array([[float(a == b) for b in goal_names.to_pylist()] for a in of]).reshape(len(names), len(goal_names))
    gram = m.T @ m
    inverse = np.linalg.pinv(gram) if method == "ols" else None
    lists = lambda df, c, name: df.groupBy("pid").agg(F.collect_list(c).alias(name))
    rows = lists(source, F.struct("item", F.col("val").cast("double").alias("v")), "x").join(lists(truth, F.col("item"), "true"), "pid").select("x", "true")
    step = max(1, CELLS // max(1, *m.shape, *h.shape))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = 0.0, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                x, has = cells_of(part.column("x"), items)
                right, seen = x @ m, has @ there > 0
                some = seen.any(1)  # entities without a known item have no mixture
                if method == "nnls":
                    right, seen = nnls_rows(gram, right), np.tile(some[:, None], len(names))
                elif inverse is not None:
                    right, seen = right @ inverse, np.tile(some[:, None], len(names))
                z, seen = right @ fold, seen @ fold > 0
                if alpha is not None:
                    z = np.maximum(z, 0) + alpha
                    z, seen = z / z.sum(1, keepdims=True), np.tile(some[:, None], len(goal_names))
                share = np.maximum(np.round(z @ h.T, 9), 0.0)
                all_ = share.sum(1) + eps * n_items
                some = some & (seen @ goal_there.T > 0).any(1)
                true = part.column("true")
                row = np.repeat(np.arange(part.num_rows), np.diff(true.offsets.to_numpy()))
                place = pc.fill_null(pc.index_in(true.flatten(), goal), -1).to_numpy(zero_copy_only=False)
                own = (np.where(place >= 0, share[row, place], 0.0) if len(goal) else np.zeros(len(row))) + eps
                use = some[row]
                total += np.log(own[use] / all_[row[use]]).sum()
                count += int(use.sum())
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([float(total)])], names=["n", "log"])

    return rows.mapInArrow(judged, "n long, log double").agg(F.coalesce(F.exp(-F.sum("log") / F.nullif(F.sum("n"), F.lit(0))), F.lit(0.0)).alias("ppl"))
