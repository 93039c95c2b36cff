"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Defined results: null or empty text has size 0; a null source is a source of its own, last in order;
an empty table gives no rows; repeated rows are documents of their own; other columns are kept by
``mixed`` and ignored by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmine.operators.prefix import prefix_sums
from weftmine.session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Expected copies are whole multiples of 2**-UNIT_BITS, so that running sums are exact in any order of adding.
UNIT_BITS = 24


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Of each source (source, source_size): its weight's part of ``share`` of all sizes, ``most`` times its size at most.

    What sources at their limit can't take goes to the others by weight, again and again until none is
    above its limit. A round is one aggregate over the sources; only its three sums reach the driver.
    """
    ranked = prefix_sums(
        totals.withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0)),
        ["__all"], [F.col("source").isNull(), "source"], "__one", "source_no",
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", "source_no", weight.cast("long").alias("weight"), (F.lit(most) * F.col("source_size")).alias("limit")))
    level, wanted = 0.0, None
    while True:
        full = F.col("limit") <= F.col("weight") * F.lit(level)
        size, taken, free = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        wanted = share * (size or 0)
        new = (wanted - (taken or 0)) / free if free else level
        if not free or new <= level:
            break
        level = new
    return ranked.withColumn("target", F.round(F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(level)), 6))


def _offset(seed: int) -> Column:
    """Of each source, one uniform draw of UNIT_BITS bits."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, UNIT_BITS // 4), 16, 10).cast("long")


def mix(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), copies, taken.

    Within a source, documents stand by falling size, so that the words taken miss the target by at most about
    the largest document. Their expected copies are summed up, the source's random offset is added,
    and a document is emitted once for each whole number that its part of the sum crosses.
    """
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, weights, share, most)
    unit = 1 << UNIT_BITS
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * unit)).otherwise(0).cast("long")
    plan = plan.select(F.col("source").alias("__source"), "source_no", "source_size", "target", copies.alias("__expected"), _offset(seed).alias("__offset"))
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    summed = prefix_sums(rows, ["source_no"], [F.desc("size"), F.asc("doc_id")], "__expected", "__before")
    edge = lambda c: F.shiftright(c + F.col("__offset"), UNIT_BITS)
    copies = edge(F.col("__before") + F.col("__expected")) - edge(F.col("__before"))
    return summed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it, with their own columns. Of rows with one doc_id, source and size the ones whose texts have smaller hashes are taken more often, so that reruns agree."""
    twin = lambda order: F.row_number().over(Window.partitionBy("doc_id", "source", "__size").orderBy(order))
    keys = {"doc_id": "__doc", "source": "__source", "__size": "__its_size", "__twin": "__its_twin"}
    plan = mix(docs, **options).withColumnRenamed("size", "__size").withColumn("__twin", twin(F.desc("copies")))
    plan = plan.filter("copies > 0").select(*(F.col(k).alias(v) for k, v in keys.items()), F.col("copies").alias("__copies"))
    rows = docs.withColumn("__size", n_words(F.col("text"))).withColumn("__twin", twin(F.xxhash64("text")))
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in keys.items()]
    return rows.join(plan, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)
