"""Item pairs that must not stand together: conflicts (i, j) in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmine.operators.graph import from_pairs


def conflicts(pairs: DataFrame) -> DataFrame:
    """Both directions of pairs, no loops; w counts how often a pair is listed."""
    return from_pairs(pairs)


def violations(sets: DataFrame, conflict: DataFrame) -> DataFrame:
    """set_id, n, violations: items and conflicting pairs of each set (set_id, item)."""
    sizes = sets.groupBy("set_id").agg(F.count("*").alias("n"))
    a, b = sets.select("set_id", F.col("item").alias("i")), sets.select("set_id", F.col("item").alias("j"))
    found = a.join(b, "set_id").filter("i < j").join(conflict.filter("i < j").select("i", "j"), ["i", "j"]).groupBy("set_id").agg(F.count("*").alias("violations"))
    return sizes.join(found, "set_id", "left").select("set_id", "n", F.coalesce("violations", F.lit(0)).alias("violations"))


def compatible_rate(truth: DataFrame, proposed: DataFrame, conflict: DataFrame) -> DataFrame:
    """rate: of true sets of two or more items without a conflict, those whose proposed set has none; 1 if there are none. A true set without a proposed one counts as one with."""
    cases = violations(truth, conflict).filter("n >= 2 AND violations = 0").select("set_id")
    good = violations(proposed, conflict).filter("violations = 0").select("set_id", F.lit(1).alias("good"))
    joined = cases.join(good, "set_id", "left")
    return joined.agg(F.coalesce(F.sum(F.coalesce("good", F.lit(0))) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("rate"))


def penalised(scores: DataFrame, selected: DataFrame, conflict: DataFrame, mode: str = "soft", weight: float = 0.5) -> DataFrame:
    """Scores (qid, item, score) given what a query has selected (qid, item): hard drops conflicting items, soft takes off ``weight`` for each conflict."""
    hits = selected.join(conflict.select(F.col("i").alias("item"), "j"), "item").groupBy("qid", F.col("j").alias("item")).agg(F.count("*").alias("hits"))
    if mode == "hard":
        return scores.join(hits, ["qid", "item"], "left_anti")
    if mode != "soft":
        raise ValueError(f"unknown mode {mode}")
    return scores.join(hits, ["qid", "item"], "left").select("qid", "item", (F.col("score") - weight * F.coalesce("hits", F.lit(0))).alias("score"))


def penalty(factors: DataFrame, conflict: DataFrame) -> DataFrame:
    """penalty: the trace of H' C H for loadings (item, k, v)."""
    a, b = factors.select(F.col("item").alias("i"), "k", F.col("v").alias("x")), factors.select(F.col("item").alias("j"), "k", F.col("v").alias("y"))
    return conflict.join(a, "i").join(b, ["j", "k"]).agg(F.coalesce(F.sum(F.col("w") * F.col("x") * F.col("y")), F.lit(0.0)).alias("penalty"))
