"""Frequent items, pairs and triples, their dictionaries, and association scores.

Item pairs of an entity come from its items as one array, which its rows are dealt to once; an entity's items are few. There is no join, so that no table of
entities, however small its files are, is ever broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def item_pairs(x: DataFrame) -> DataFrame:
    """pid, i, j for items i < j of the same entity."""
    held = x.filter("pid IS NOT NULL").groupBy("pid").agg(F.collect_list("item").alias("items"))
    first = held.select("pid", F.explode("items").alias("i"), "items")
    return first.select("pid", "i", F.explode("items").alias("j")).filter("i < j")


def frequent_items(x: DataFrame, support: int) -> DataFrame:
    return x.groupBy("item").agg(F.count("*").alias("support")).filter(F.col("support") >= support)


def frequent_pairs(x: DataFrame, support: int) -> DataFrame:
    """i, j, support. Counts are 64-bit."""
    return item_pairs(x).groupBy("i", "j").agg(F.count("*").alias("support")).filter(F.col("support") >= support)


def frequent_triples(x: DataFrame, support: int) -> DataFrame:
    """i, j, k, support. Only entities' pairs that are frequent are extended, and only to triples whose pairs are all frequent."""
    kept = frequent_pairs(x, support).select("i", "j")
    pairs = item_pairs(x).join(F.broadcast(kept) if _few(kept) else kept, ["i", "j"])
    longer = pairs.join(pairs.select("pid", F.col("i").alias("j"), F.col("j").alias("k")), ["pid", "j"])
    ends = kept.select(F.col("i"), F.col("j").alias("k"))
    return longer.join(ends, ["i", "k"], "left_semi").groupBy("i", "j", "k").agg(F.count("*").alias("support")).filter(F.col("support") >= support)


def _few(rows: DataFrame, most: int = 100_000) -> bool:
    """Whether a table may be broadcast: at most so many rows of it exist."""
    return rows.limit(most + 1).count() <= most


def pair_dictionary(x: DataFrame, support: int) -> DataFrame:
    """i, j, support, pair_id: frequent pairs numbered in order. One task numbers them: their number is bounded by that of item pairs."""
    return frequent_pairs(x, support).withColumn("pair_id", (F.row_number().over(Window.orderBy("i", "j")) - 1).cast("long"))


def pair_view(x: DataFrame, dictionary: DataFrame) -> DataFrame:
    """pid, pair_id: which frequent pairs an entity holds."""
    return item_pairs(x).join(dictionary.select("i", "j", "pair_id"), ["i", "j"]).select("pid", "pair_id")


def pmi(x: DataFrame, n: int, eps: float = 1e-10) -> DataFrame:
    """i, j, support, pmi of all pairs that occur: ln((joint + eps) / max(product of frequencies, eps))."""
    freq = x.groupBy("item").agg((F.count("*") / F.lit(float(n))).alias("f"))
    pairs = frequent_pairs(x, 1)
    both = pairs.join(freq.select(F.col("item").alias("i"), F.col("f").alias("fi")), "i").join(freq.select(F.col("item").alias("j"), F.col("f").alias("fj")), "j")
    value = F.ln((F.col("support") / F.lit(float(n)) + eps) / F.greatest(F.col("fi") * F.col("fj"), F.lit(eps)))
    return both.select("i", "j", "support", value.alias("pmi"))


def motifs(x: DataFrame, n: int, support: int, *, a: float = 1.0, b: float = 1.0, top_k: int = 100) -> DataFrame:
    """Frequent pairs and triples as (members, size, support, pmi, score, weight), the best top_k.

    A set's pmi is the mean of its pairs'. score = a ln(1 + support) + b max(pmi, 0); weight = ln(1 + support) max(pmi, 0), 1e-10 at least.
    """
    scores = pmi(x, n).select("i", "j", "pmi")
    two = frequent_pairs(x, support).join(scores, ["i", "j"]).select(F.array("i", "j").alias("members"), "support", "pmi")
    three = frequent_triples(x, support)
    for p, q in (("i", "j"), ("i", "k"), ("j", "k")):
        three = three.join(scores.select(F.col("i").alias(p), F.col("j").alias(q), F.col("pmi").alias(f"pmi_{p}{q}")), [p, q])
    three = three.select(F.array("i", "j", "k").alias("members"), "support", ((F.col("pmi_ij") + F.col("pmi_ik") + F.col("pmi_jk")) / 3).alias("pmi"))
    strength, gain = F.ln(1.0 + F.col("support")), F.greatest(F.col("pmi"), F.lit(0.0))
    rows = two.union(three).select("members", F.size("members").alias("size"), "support", F.round("pmi", 9).alias("pmi"), F.round(a * strength + b * gain, 9).alias("score"), F.greatest(strength * gain, F.lit(1e-10)).alias("weight"))
    return rows.orderBy(F.desc("score"), "members").limit(top_k)
