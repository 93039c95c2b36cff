"""Entity-item tables from a star schema: orders are entities; brands, supplier nations and part types their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmine.session import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, item: which brands an order holds."""
    return _lines(spark, sf_dir).select(F.col("l_orderkey").alias("pid"), F.col("p_brand").alias("item")).distinct()


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, item: from which nations an order is supplied."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("item"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pid"), "l_suppkey")
    return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("pid", "item").distinct()


def doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, item, dose: the quantity of each brand in an order."""
    return _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("pid"), F.col("p_brand").alias("item")).agg(F.sum("l_quantity").alias("dose"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, category: which kinds of parts, by type and size, a brand has."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("item"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("category")).distinct()


def loadings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Closed-form factors with part types as topics: (item, k, v) of brands and of nations, each topic's summing to 1."""
    lines = _lines(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")

    def normalised(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("item", "k").agg(F.count("*").alias("n"))
        sums = counts.groupBy("k").agg(F.sum("n").alias("total"))
        return counts.join(F.broadcast(sums), "k").select("item", "k", (F.col("n") / F.col("total")).alias("v"))

    h = normalised(lines.select(F.col("p_brand").alias("item"), F.col("p_type").alias("k")))
    s = normalised(lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("item"), F.col("p_type").alias("k")))
    return h, s
