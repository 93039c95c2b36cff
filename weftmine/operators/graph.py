"""Similarity graphs (i, j, w) of items and their Laplacians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmine.operators.prefix import prefix_sums
from weftmine.session import cut


def swapped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("j").alias("i"), F.col("i").alias("j"), *(c for c in edges.columns if c not in ("i", "j")))


def from_pairs(pairs: DataFrame) -> DataFrame:
    """Both directions of pairs (i, j), no loops; pairs listed twice count twice."""
    both = pairs.select("i", "j").union(pairs.select("j", "i")).filter("i <> j")
    return both.groupBy("i", "j").agg(F.count("*").cast("double").alias("w"))


def by_category(categories: DataFrame) -> DataFrame:
    """Weight 1 between items (item, category) that share a category."""
    a, b = categories.select("category", F.col("item").alias("i")), categories.select("category", F.col("item").alias("j"))
    return a.join(b, "category").filter("i <> j").select("i", "j").distinct().withColumn("w", F.lit(1.0))


def nearest(similar: DataFrame, k: int) -> DataFrame:
    """The k most similar others of each i (ties to the smaller j)."""
    order = Window.partitionBy("i").orderBy(F.desc("sim"), "j")
    return similar.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= k).drop("__rn")


def _unit(attributes: DataFrame) -> DataFrame:
    """item, attr, u: rows of length 1; items of length 0 have none."""
    norms = attributes.groupBy("item").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return attributes.join(norms, "item").filter("n > 0").select("item", "attr", (F.col("v") / F.col("n")).alias("u"))


def cosine(attributes: DataFrame, rescale: bool = True, own: bool = False) -> DataFrame:
    """i, j, sim of all items that share an attribute (item, attr, v); (cos + 1) / 2 if rescaled. Items that share none have cosine 0 and no row. own: each item with itself, too."""
    unit = _unit(attributes)
    a, b = unit.select("attr", F.col("item").alias("i"), F.col("u").alias("x")), unit.select("attr", F.col("item").alias("j"), F.col("u").alias("y"))
    both = a.join(b, "attr")
    dots = (both if own else both.filter("i <> j")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))
    dots = dots.withColumn("sim", F.round("sim", 9))
    return dots.withColumn("sim", (F.col("sim") + 1) / 2) if rescale else dots


def with_zeros(similar: DataFrame, nodes: DataFrame, k: int, zero: float = 0.0) -> DataFrame:
    """similar (i, j, sim) with as many pairs of similarity ``zero`` as each item's k nearest may need, the ones with the smallest j first.

    similar: all pairs whose similarity isn't ``zero``, in both directions; nodes: all items (item). Of an item with p pairs above ``zero``, the first k - p other items that have no
    row are added, which is all that its k nearest can hold. Items are numbered in order; where the t-th of an item's own rows stands at e_t, e_t - t others come before it, so
    that counting its rows by this difference tells where the c-th of the others is. No pair that isn't added is made.
    """
    order = prefix_sums(nodes.select("item").distinct().withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0)), ["__all"], ["item"], "__one", "__at")
    order = cut(order.select("item", F.col("__at").cast("long").alias("__at")))
    place = lambda df, c: df.join(order.select(F.col("item").alias(c), "__at"), c)
    own = similar.filter(F.col("sim") != zero).select("i", "j").union(order.select("item", "item"))
    rows = place(own, "j").withColumn("__t", F.row_number().over(Window.partitionBy("i").orderBy("__at")) - 1)
    before = rows.withColumn("__gap", F.col("__at") - F.col("__t")).filter(F.col("__gap") < k).groupBy("i", "__gap").agg(F.count("*").alias("n"))
    passed = before.groupBy("i").agg(F.collect_list(F.struct("__gap", "n")).alias("__passed"))
    above = similar.filter(F.col("sim") > zero).groupBy("i").agg(F.count("*").alias("__above"))
    missing = order.select(F.col("item").alias("i")).join(above, "i", "left").join(passed, "i", "left").withColumn("__need", k - F.coalesce("__above", F.lit(0))).filter("__need > 0")
    missing = missing.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__need") - 1)))
    skipped = F.aggregate(F.coalesce("__passed", F.array().cast("array<struct<__gap:bigint,n:bigint>>")), F.lit(0).cast("long"), lambda s, x: s + F.when(x["__gap"] <= F.col("c"), x["n"]).otherwise(0))
    added = missing.select("i", (F.col("c") + skipped).alias("__at")).join(order, "__at").select("i", F.col("item").alias("j"), F.lit(zero).alias("sim"))
    return similar.filter(F.col("sim") != zero).select("i", "j", "sim").union(added)


def feature_neighbours(attributes: DataFrame, k: int, nodes: DataFrame | None = None) -> DataFrame:
    """i, j, sim: exactly k others of each item (all, if fewer) by (cosine + 1) / 2, ties to the smaller j; what shares no attribute has 0.5, what is opposed less. nodes: items that may lack attributes.

    Items that look the same are one class, named by its smallest item, and only classes are compared. The k + 1 items nearest to a class, its own among them, lie in the k + 1
    nearest classes (ties to the smaller name), and are among the k + 1 smallest items of each; an item takes those that aren't itself.
    """
    items = (attributes.select("item") if nodes is None else nodes.select("item").union(attributes.select("item"))).distinct()
    looks = _unit(attributes).groupBy("item").agg(F.sort_array(F.collect_list(F.struct("attr", "u"))).alias("look"))
    looks = cut(items.join(looks, "item", "left").select("item", F.coalesce(F.xxhash64("look"), F.lit(0)).alias("key"), F.coalesce("look", F.array().cast(dict(looks.dtypes)["look"])).alias("look")))
    classes = looks.groupBy("key", "look").agg(F.min("item").alias("of"))
    members = cut(looks.join(classes, ["key", "look"]).select("item", "of"))
    names = members.select(F.col("of").alias("item")).distinct()
    similar = cut(cosine(attributes.join(names, "item", "left_semi"), rescale=False, own=True))
    own = names.select(F.col("item").alias("i")).join(similar.filter("i = j").select("i", "sim"), "i", "left").select("i", F.col("i").alias("j"), F.coalesce("sim", F.lit(0.0)).alias("sim"))
    near = nearest(with_zeros(similar.filter("i <> j"), names, k + 1).union(own), k + 1)
    first = members.withColumn("__rn", F.row_number().over(Window.partitionBy("of").orderBy("item"))).filter(F.col("__rn") <= k + 1).select(F.col("of").alias("j"), "item")
    found = nearest(near.join(first, "j").select("i", F.col("item").alias("j"), "sim"), k + 1)
    found = found.groupBy(F.col("i").alias("of")).agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "j"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["j"] != F.col("item")), 1, k)
    return members.join(found, "of").select(F.col("item").alias("i"), F.explode(others).alias("x")).select("i", "x.j", ((1 - F.col("x.far")) / 2).alias("sim"))


def jaccard(members: DataFrame) -> DataFrame:
    """i, j, sim of items (item, attr) that share an attribute."""
    sizes = members.groupBy("item").agg(F.count("*").alias("n"))
    a, b = members.select("attr", F.col("item").alias("i")), members.select("attr", F.col("item").alias("j"))
    shared = a.join(b, "attr").filter("i <> j").groupBy("i", "j").agg(F.count("*").alias("m"))
    shared = shared.join(sizes.select(F.col("item").alias("i"), F.col("n").alias("ni")), "i").join(sizes.select(F.col("item").alias("j"), F.col("n").alias("nj")), "j")
    return shared.select("i", "j", (F.col("m") / (F.col("ni") + F.col("nj") - F.col("m"))).alias("sim"))


def symmetrised(edges: DataFrame) -> DataFrame:
    """(A + A') / 2."""
    return edges.union(swapped(edges).select(edges.columns)).groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))


def weighted_sum(parts: Sequence[tuple[float, DataFrame]]) -> DataFrame:
    """The sum of weighted graphs."""
    out = None
    for weight, edges in parts:
        scaled = edges.select("i", "j", (F.col("w") * weight).alias("w"))
        out = scaled if out is None else out.union(scaled)
    return out.groupBy("i", "j").agg(F.sum("w").alias("w"))


def laplacian(edges: DataFrame, nodes: DataFrame, normalised: str = "symmetric") -> DataFrame:
    """i, j, v over all nodes (item): D - A, or I - D^-1/2 A D^-1/2, where a node without an edge keeps its 1."""
    degree = edges.groupBy(F.col("i").alias("item")).agg(F.sum("w").alias("d"))
    if normalised == "none":
        own = nodes.join(degree, "item", "left").select(F.col("item").alias("i"), F.col("item").alias("j"), F.coalesce("d", F.lit(0.0)).alias("v"))
        return own.union(edges.select("i", "j", (-F.col("w")).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))
    if normalised != "symmetric":
        raise ValueError(f"unknown Laplacian {normalised}")
    scaled = edges.join(degree.select(F.col("item").alias("i"), F.col("d").alias("di")), "i").join(degree.select(F.col("item").alias("j"), F.col("d").alias("dj")), "j")
    own = nodes.select(F.col("item").alias("i"), F.col("item").alias("j"), F.lit(1.0).alias("v"))
    off = scaled.filter("di > 0 AND dj > 0").select("i", "j", (-F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("v"))
    return own.union(off).groupBy("i", "j").agg(F.sum("v").alias("v"))
