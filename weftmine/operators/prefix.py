"""Exact running sums and maxima over groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmine.session import cut, partitions


def _dealt(df: DataFrame, by: list[str], keys: list[Column]) -> DataFrame:
    """Rows by ranges of (by, order), each with its range. They are cut, since the ranges come from a sample and must not be drawn twice."""
    return cut(df.repartitionByRange(partitions(df.sparkSession), *by, *keys).withColumn("__part", F.spark_partition_id()))


def prefix_sums(df: DataFrame, by: list[str], order: list[str | Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` (integers, not null) over the rows that come before in ``order`` within ``by``.

    Rows are dealt out by ranges of (by, order), so a group of any size spreads over many tasks; the
    totals of a group's ranges, at most one row for each task, give where each range begins. ``by`` columns must
    not hold null. Rows equal in every ``order`` column stand in any order.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = _dealt(df, by, keys)
    totals = dealt.groupBy("__part", *by).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("__part", *by, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__begin"))
    inside = Window.partitionBy("__part", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(begins, ["__part", *by])
        .withColumn(out, F.col("__begin") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__part", "__begin")
    )


def running_maxima(df: DataFrame, by: list[str], order: list[str | Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the largest ``value`` of a row and those that come before in ``order`` within ``by``. Rows are dealt out as for ``prefix_sums``; of each range before, only its largest value counts."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = _dealt(df, by, keys)
    most = dealt.groupBy("__part", *by).agg(F.max(value).alias("__most"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = most.select("__part", *by, F.max("__most").over(before).alias("__begin"))
    inside = Window.partitionBy("__part", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(begins, ["__part", *by]).withColumn(out, F.greatest("__begin", F.max(value).over(inside))).drop("__part", "__begin")


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the rank of ``value`` (rows without one go) from 1 within ``by``, the mean of its places for equal ones. Only one row for each value is dealt by ranges and summed up; a value's rank goes back to its rows by a join."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n")).withColumn("__all", F.lit(0))
    placed = prefix_sums(counts, ["__all", *by], [value], "__n", "__before")
    ranks = placed.select(*by, value, (F.col("__before") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value])
