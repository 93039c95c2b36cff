"""Hyper-edges (edge, members, weight), their incidence, Laplacian and direct group terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_category(categories: DataFrame, least: int = 2) -> DataFrame:
    """An edge for each category with ``least`` items or more. categories: item, category."""
    edges = categories.groupBy(F.col("category").alias("edge")).agg(F.array_sort(F.collect_set("item")).alias("members"))
    return edges.filter(F.size("members") >= least).withColumn("weight", F.lit(1.0))


def by_entity(x: DataFrame, *, least: int = 2, most: int = 50, rho: float = 0.5) -> DataFrame:
    """An edge for each entity with so many items; weight 1 / size ** rho."""
    edges = x.groupBy(F.col("pid").alias("edge")).agg(F.array_sort(F.collect_set("item")).alias("members"))
    edges = edges.filter(F.size("members").between(least, most))
    return edges.withColumn("weight", 1.0 / F.pow(F.size("members").cast("double"), F.lit(rho)))


def by_attributes(similar: DataFrame, every: DataFrame, least: float, top_k: int, unlike: float = 0.0) -> DataFrame:
    """Edges from a neighbour table (i, j, sim): pairs i < j, and i with two of its neighbours; mean similarity ``least`` or more, the best top_k.

    every: the similarities of all items, neighbours or not, in both directions; those that have no row there have ``unlike``.
    """
    pairs = similar.filter("j > i").select(F.array("i", "j").alias("members"), F.col("sim").alias("score"))
    a, b = similar.select("i", "j", F.col("sim").alias("s1")), similar.select("i", F.col("j").alias("k"), F.col("sim").alias("s2"))
    around = a.join(b, "i").filter("j < k")
    both = around.join(every.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("sim").alias("s3")), ["j", "k"], "left").fillna(unlike, ["s3"])
    triples = both.select(F.array_sort(F.array("i", "j", "k")).alias("members"), ((F.col("s1") + F.col("s2") + F.col("s3")) / 3).alias("score"))
    found = pairs.union(triples).filter(F.col("score") >= least).groupBy("members").agg(F.round(F.max("score"), 9).alias("score"))
    return found.orderBy(F.desc("score"), "members").limit(top_k)


def together(**edges: DataFrame) -> DataFrame:
    """Hyper-edges of several kinds in one table; each edge's name begins with its kind's."""
    if not edges:
        raise ValueError("no kind of hyper-edges is given")
    out = None
    for kind, rows in edges.items():
        named = rows.select(F.concat(F.lit(f"{kind}:"), F.col("edge").cast("string")).alias("edge"), "members", "weight")
        out = named if out is None else out.union(named)
    return out


def bundle(parts: list[tuple[float, DataFrame]]) -> DataFrame:
    """i, j, v: the sum of the Laplacians of hyper-edge tables, each times its weight; parts of weight 0 are off, and with all off no row is left."""
    if not parts:
        raise ValueError("no hyper-edges are given")
    out = None
    for weight, edges in parts:
        scaled = laplacian(edges).select("i", "j", (F.col("v") * weight).alias("v"))
        scaled = scaled if weight else scaled.limit(0)
        out = scaled if out is None else out.union(scaled)
    return out.groupBy("i", "j").agg(F.sum("v").alias("v"))


def incidence(edges: DataFrame) -> DataFrame:
    """edge, item, weight, size."""
    return edges.select("edge", F.explode("members").alias("item"), "weight", F.size("members").alias("size"))


def laplacian(edges: DataFrame) -> DataFrame:
    """i, j, v: I - Dv^-1/2 B W De^-1 B' Dv^-1/2 over the items that edges hold; others' rows are zero and left out."""
    b = incidence(edges)
    degree = b.groupBy("item").agg(F.sum("weight").alias("d"))
    left = b.select("edge", F.col("item").alias("i"), (F.col("weight") / F.greatest(F.col("size"), F.lit(1))).alias("w"))
    shared = left.join(b.select("edge", F.col("item").alias("j")), "edge").groupBy("i", "j").agg(F.sum("w").alias("a"))
    scaled = shared.join(degree.select(F.col("item").alias("i"), F.col("d").alias("di")), "i").join(degree.select(F.col("item").alias("j"), F.col("d").alias("dj")), "j")
    value = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - F.col("a") / F.sqrt(F.col("di") * F.col("dj"))
    return scaled.select("i", "j", value.alias("v"))


def centred(edges: DataFrame, factors: DataFrame) -> DataFrame:
    """edge, item, k, weight, size, d: loadings (item, k, v) of an edge's items minus the edge's mean. An item without a loading counts as 0."""
    rows = incidence(edges).join(factors, "item")
    own = Window.partitionBy("edge", "k")
    return rows.withColumn("mean", F.sum("v").over(own) / F.col("size")).select("edge", "item", "k", "weight", "size", (F.col("v") - F.col("mean")).alias("d"))


def group_loss(edges: DataFrame, factors: DataFrame, normalise: bool = True) -> DataFrame:
    """loss: the sum over edges of weight times squared distances from the edge's mean, by size if normalised. factors must have every (item, k)."""
    term = F.col("weight") * F.col("d") * F.col("d")
    return centred(edges, factors).agg(F.sum(term / F.col("size") if normalise else term).alias("loss"))


def group_gradient(edges: DataFrame, factors: DataFrame, normalise: bool = True) -> DataFrame:
    """item, k, g: the gradient of group_loss."""
    term = 2 * F.col("weight") * F.col("d")
    return centred(edges, factors).groupBy("item", "k").agg(F.sum(term / F.col("size") if normalise else term).alias("g"))
