"""Splits of entities and of their items, in an order drawn by hashes, so that they can be drawn again anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from weftmine.session import stored


def draw(*keys: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))


#: Digits of a draw by which entities are counted.
DIGITS = 4


def borders(pids: DataFrame, *, train: float = 0.8, valid: float = 0.1, seed: int = 42) -> list[Row | None]:
    """(draw, pid) of the first entity that isn't train any more, and of the first that is test; None if there is none. pids: one row an entity, cut or stored, since it is read twice.

    Entities are counted by the first digits of their draws; only those that share a border's digits are put in order.
    """
    rows = pids.select(draw("pid", seed=seed).alias("draw"), "pid")
    begin = F.substring("draw", 1, DIGITS)
    counts = sorted(map(tuple, rows.groupBy(begin).count().collect()))
    n = sum(c for _, c in counts)
    wanted, near, before = [int(n * train), int(n * train) + int(n * valid)], {}, 0
    for digits, c in counts:
        near |= {at: (digits, at - before) for at in wanted if before <= at < before + c}
        before += c
    ordered = rows.filter(begin.isin([d for d, _ in near.values()])).orderBy("draw", "pid").collect() if near else []
    return [[r for r in ordered if r.draw.startswith(near[at][0])][near[at][1]] if at in near else None for at in wanted]


def part_of(pids: DataFrame, ends: list[Row | None], seed: int = 42) -> Column:
    """An entity's part, by what ``borders`` gives."""
    kind = pids.schema["pid"].dataType
    own = F.struct(draw("pid", seed=seed).alias("draw"), F.col("pid").alias("pid"))
    before = [F.lit(True) if e is None else own < F.struct(F.lit(e.draw).alias("draw"), F.lit(e.pid).cast(kind).alias("pid")) for e in ends]
    return F.when(before[0], "train").when(before[1], "valid").otherwise("test")


def by_entity(pids: DataFrame, *, train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """pid, split: the first floor(n * train) of the drawn order train, the next floor(n * valid) are valid, the rest test. pids has one row an entity."""
    pids = stored(pids.select("pid"))
    return pids.select("pid", part_of(pids, borders(pids, train=train, valid=valid, seed=seed), seed).alias("split"))


def leave_out(x: DataFrame, splits: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """pid, item, split, hidden: in valid and test entities k drawn items are hidden, of k or fewer all but one."""
    own = Window.partitionBy("pid")
    order = own.orderBy(draw("pid", "item", seed=seed), "item")
    ranked = x.join(splits, "pid").select("pid", "item", "split", F.row_number().over(order).alias("rn"), F.count("*").over(own).alias("n"))
    hide = F.when(F.col("n") > k, F.lit(k)).otherwise(F.col("n") - 1)
    return ranked.select("pid", "item", "split", ((F.col("split") != "train") & (F.col("rn") <= hide)).alias("hidden"))


def subsample(x: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The rows of n entities, those with the smallest hashes of seed and id; all if there are no more."""
    drawn = x.select("pid").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("pid").cast("string"))), "pid").limit(n)
    return x.join(drawn, "pid", "left_semi")


def split(x: DataFrame, method: str, **options) -> DataFrame:
    if method == "entity":
        return by_entity(x.select("pid").distinct(), **options)
    if method == "leave_out":
        k, seed = options.pop("k", 1), options.get("seed", 42)
        return leave_out(x, by_entity(x.select("pid").distinct(), **options), k, seed)
    raise ValueError(f"unknown split method {method}")
