"""Ranking, perplexity, dose, coherence and safety metrics over long tables.

Scores are (pid, item, score), or rankings (pid, found) as ``infer.ranking`` gives them, truth is (pid, item, val) with val > 0. Entities without scores or without truth are left out of means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmine.operators.infer import rankings, topic_items
from weftmine.operators.mining import item_pairs


def _mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def judged(found: DataFrame, truth: DataFrame | None) -> DataFrame:
    """pid, true (array of (item, val)), n_true, ranks: of each entity that has both, its true items' ranks from 1, in the order of ``true``; 0 of those without a score. Entities meet once, as a row each.

    Without truth, rankings have their entities' true items beside them, as ``true``.
    """
    if truth is None:
        both = found.filter(F.size("true") > 0).select("pid", F.col("found")["item"].alias("items"), "true", F.size("true").cast("long").alias("n_true"))
    else:
        true = truth.groupBy("pid").agg(F.collect_list(F.struct("item", "val")).alias("true"), F.count("*").alias("n_true"))
        both = rankings(found).select("pid", F.col("found")["item"].alias("items")).join(true, "pid")
    return both.select("pid", "true", "n_true", F.transform("true", lambda t: F.coalesce(F.array_position("items", t["item"]), F.lit(0)).cast("int")).alias("ranks"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1.0)


def _reached(k: int | Column) -> Column:
    """The ranks of true items among the first k."""
    return F.filter("ranks", lambda r: (r > 0) & (r <= k))


def _precision_recall(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("hits", F.size(_reached(k)).cast("long")).withColumn("p", F.col("hits") / k).withColumn("r", F.col("hits") / F.col("n_true"))


def _average_precision() -> Column:
    reached = F.sort_array(F.filter("ranks", lambda r: r > 0))
    return _total(F.transform(reached, lambda r, i: (i + 1) / r)) / F.col("n_true")


def _ndcg(k: int, gain: str = "value") -> Column:
    worth = (lambda v: v) if gain == "value" else (lambda v: F.lit(1.0))
    got = _total(F.zip_with("true", "ranks", lambda t, r: F.when((r > 0) & (r <= k), worth(t["val"].cast("double")) * _discount(r)).otherwise(0.0)))
    ideal = _total(F.transform(F.slice(F.sort_array(F.col("true")["val"], asc=False), 1, k), lambda v, i: worth(v.cast("double")) * _discount(i + 1)))
    return F.when(ideal > 0, got / ideal).otherwise(0.0)


def at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """pid, hits, p, r: precision (over k) and recall of the first k."""
    return _precision_recall(judged(found, truth), k).select("pid", "hits", "p", "r")


def average_precision(found: DataFrame, truth: DataFrame) -> DataFrame:
    """pid, ap over the full ranking; true items without a score are never reached."""
    return judged(found, truth).select("pid", _average_precision().alias("ap"))


def ndcg(found: DataFrame, truth: DataFrame, k: int, gain: str = "value") -> DataFrame:
    """pid, ndcg of the first k with gains val, or 1 each if gain is 'binary'."""
    return judged(found, truth).select("pid", _ndcg(k, gain).alias("ndcg"))


def recommendation(found: DataFrame, truth: DataFrame | None, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row: map, and p, r, ndcg at each k."""
    rows, means = judged(found, truth), []
    for k in ks:
        rows = _precision_recall(rows, k).withColumn("ndcg", _ndcg(k))
        rows = rows.select("pid", "true", "n_true", "ranks", *(c for c in rows.columns if c[-1].isdigit()), *(F.col(c).alias(f"{c}_{k}") for c in ("p", "r", "ndcg")))
        means += [_mean(F.col(f"{c}_{k}")).alias(f"{c}_{k}") for c in ("p", "r", "ndcg")]
    return rows.agg(_mean(_average_precision()).alias("map"), *means)


def predictive(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int = 10, *, length_ratio: float | None = None, frequency: DataFrame | None = None, tau: float = 0.5, eps: float = 1e-10) -> DataFrame:
    """One row: precision, recall, ndcg (gain 1) at k, or at a length of its own for each entity: the rounded ``length_ratio`` times its query's items, from 1 to k.

    frequency (item, f): scores are made probabilities and divided by (f + eps) ** tau first.
    """
    if frequency is not None:
        above = lambda c: F.greatest(c, F.lit(0.0)) + eps
        rows = rankings(found).withColumn("total", _total(F.transform("found", lambda x: above(x["score"])))).select("pid", "total", F.explode("found").alias("x"))
        rows = rows.select("pid", "x.item", (above(F.col("x.score")) / F.col("total")).alias("share")).join(frequency, "item", "left")
        found = rows.select("pid", "item", F.round(F.col("share") / F.pow(F.coalesce("f", F.lit(0.0)) + eps, F.lit(tau)), 9).alias("score"))
    sizes = queries.groupBy("pid").agg(F.count("*").alias("n_query"))
    own = F.lit(k) if length_ratio is None else F.least(F.greatest(F.bround(length_ratio * F.col("n_query")).cast("int"), F.lit(1)), F.lit(k))
    rows = judged(found, truth).join(sizes, "pid").withColumn("own", own)
    each = rows.select("n_true", "own", F.size(_reached(F.col("own"))).alias("hits"), _total(F.transform(_reached(F.col("own")), _discount)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("own"), F.col("n_true").cast("int"))), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    return each.agg(_mean(F.col("hits") / F.col("own")).alias("precision"), _mean(F.col("hits") / F.col("n_true")).alias("recall"), _mean(F.col("dcg") / F.greatest(ideal, F.lit(1e-10))).alias("ndcg"))


def perplexity(found: DataFrame, truth: DataFrame, n_items: int, eps: float = 1e-10) -> DataFrame:
    """ppl: exp of the mean negative log share of true items. Shares: scores cut at 0, plus eps, over all n_items; items without a score have eps."""
    sums = found.groupBy("pid").agg((F.sum(F.greatest("score", F.lit(0.0))) + eps * n_items).alias("total"))
    rows = truth.join(sums, "pid").join(found, ["pid", "item"], "left")
    share = (F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)) + eps) / F.col("total")
    return rows.agg(F.coalesce(F.exp(-F.sum(F.ln(share)) / F.nullif(F.count("*"), F.lit(0))), F.lit(0.0)).alias("ppl"))


def dose_errors(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """mae, rmse, smape over true doses (pid, item, dose) and predictions (pid, item, score)."""
    d = F.col("dose") - F.coalesce("score", F.lit(0.0))
    size = F.greatest(F.abs("dose") + F.abs(F.coalesce("score", F.lit(0.0))), F.lit(1e-10))
    rows = truth.join(predicted, ["pid", "item"], "left")
    return rows.agg(_mean(F.abs(d)).alias("mae"), F.sqrt(_mean(d * d)).alias("rmse"), _mean(2 * F.abs(d) / size).alias("smape"))


def coherence(h: DataFrame, x: DataFrame, n: int, top: int = 10, eps: float = 1e-10) -> DataFrame:
    """k, coherence: the mean ln((joint + eps) / (product of frequencies + eps)) of pairs of each topic's heaviest items."""
    best = topic_items(h, top).select("k", "item")
    freq = x.groupBy("item").agg((F.count("*") / F.lit(float(n))).alias("f"))
    rows = best.join(freq, "item", "left").select("k", "item", F.coalesce("f", F.lit(0.0)).alias("f"))
    a, b = rows.select("k", F.col("item").alias("i"), F.col("f").alias("fi")), rows.select("k", F.col("item").alias("j"), F.col("f").alias("fj"))
    joint = item_pairs(x).groupBy("i", "j").agg((F.count("*") / F.lit(float(n))).alias("joint"))
    pairs = a.join(b, "k").filter("i < j").join(joint, ["i", "j"], "left")
    value = F.ln((F.coalesce("joint", F.lit(0.0)) + eps) / (F.col("fi") * F.col("fj") + eps))
    return pairs.groupBy("k").agg(F.avg(value).alias("coherence"))


def compactness(h: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """k, tgc: of the pairs of each topic's heaviest items, the part that shares a hyper-edge."""
    best = topic_items(h, top).select("k", "item")
    members = edges.select("edge", F.explode("members").alias("item")).distinct()
    a, b = members.select("edge", F.col("item").alias("i")), members.select("edge", F.col("item").alias("j"))
    joined = a.join(b, "edge").filter("i < j").select("i", "j").distinct().withColumn("shared", F.lit(1))
    pairs = best.select("k", F.col("item").alias("i")).join(best.select("k", F.col("item").alias("j")), "k").filter("i < j")
    return pairs.join(joined, ["i", "j"], "left").groupBy("k").agg(F.avg(F.coalesce("shared", F.lit(0))).alias("tgc"))


def motif_hits(h: DataFrame, motifs: DataFrame, top: int = 10) -> DataFrame:
    """k, rate: of all motifs (members), the part that lies within each topic's heaviest items."""
    best = topic_items(h, top).select("k", "item")
    n = motifs.count()
    parts = motifs.select("members", F.size("members").alias("size"), F.explode("members").alias("item"))
    whole = parts.join(best, "item").groupBy("k", "members", "size").agg(F.count("*").alias("m")).filter("m = size")
    hits = whole.groupBy("k").agg(F.count("*").alias("hits"))
    return best.select("k").distinct().join(hits, "k", "left").select("k", (F.coalesce("hits", F.lit(0)) / max(n, 1)).alias("rate"))


def violations_at_k(found: DataFrame, conflict: DataFrame, k: int = 10) -> DataFrame:
    """pid, rate: conflicting pairs among the first k over k (k - 1) / 2."""
    best = rankings(found).select("pid", F.slice("found", 1, k)["item"].alias("items"))
    pairs = best.select("pid", "items", F.explode("items").alias("i")).select("pid", "i", F.explode("items").alias("j"))
    known = conflict.filter("i < j").select("i", "j", F.lit(1).alias("foe"))
    bad = pairs.join(known, ["i", "j"], "left").groupBy("pid").agg(F.count("foe").alias("bad"))
    return bad.select("pid", (F.col("bad") / max(k * (k - 1) / 2, 1)).alias("rate"))
