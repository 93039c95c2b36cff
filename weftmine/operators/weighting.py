"""TF-IDF weights of long (pid, item, val) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entities(x: DataFrame) -> int:
    return x.select("pid").distinct().count()


def document_frequency(x: DataFrame) -> DataFrame:
    """item, df: entities that hold the item. x has a row once at most for each entity and item."""
    return x.groupBy("item").agg(F.count("*").alias("df"))


def idf(x: DataFrame, n: int | None = None, smooth: bool = True) -> DataFrame:
    return idf_of(document_frequency(x), entities(x) if n is None else n, smooth)


def idf_of(frequencies: DataFrame, n: int, smooth: bool = True) -> DataFrame:
    """item, idf of items' document frequencies (item, df) among n entities."""
    value = F.ln(F.lit(1.0 + n) / (1.0 + F.col("df"))) if smooth else F.ln(F.lit(float(n)) / F.greatest(F.col("df"), F.lit(1)))
    return frequencies.select("item", (value + 1.0).alias("idf"))


def row_norm(x: DataFrame, norm: str = "l2") -> DataFrame:
    total: Column = F.sqrt(F.sum(F.col("val") * F.col("val"))) if norm == "l2" else F.sum("val")
    return x.groupBy("pid").agg(F.greatest(total, F.lit(1e-12)).alias("norm"))


def tfidf(x: DataFrame, *, fitted_on: DataFrame | None = None, smooth: bool = True, sublinear: bool = False, norm: str = "l2") -> DataFrame:
    """Weighted x. fitted_on: the table whose document frequencies count, x itself if not given."""
    if norm not in ("l1", "l2", "none"):
        raise ValueError(f"unknown norm {norm}")
    weights = idf(x if fitted_on is None else fitted_on, smooth=smooth)
    val = F.log1p("val") if sublinear else F.col("val")
    out = x.join(weights, "item").select("pid", "item", (val * F.col("idf")).alias("val"))
    if norm == "none":
        return out
    return out.join(row_norm(out, norm), "pid").select("pid", "item", (F.col("val") / F.col("norm")).alias("val"))


def without_idf(factors: DataFrame, weights: DataFrame) -> DataFrame:
    """Loadings (item, k, v) divided by their item's idf."""
    return factors.join(weights, "item").select("item", "k", (F.col("v") / F.col("idf")).alias("v"))


def scaled_doses(doses: DataFrame) -> DataFrame:
    """Doses divided by the largest of their item."""
    most = doses.groupBy("item").agg(F.greatest(F.max("dose"), F.lit(1e-10)).alias("scale"))
    return doses.join(most, "item").select("pid", "item", "dose", "scale", (F.col("dose") / F.col("scale")).alias("scaled"))
