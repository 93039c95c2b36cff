"""All inputs of a configuration, each read once: what is checked is counted while a view is written, and what fails goes to a table beside it.

Every cell, row or pair gets the reason it is refused for, if any. A view is written in one job, parted by whether rows are refused, and the job's own
counts of reasons decide whether loading goes on. Refused rows stay where the error says, so that they can be looked at.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftmine.operators.mining import pair_dictionary, pair_view
from weftmine.sources import files

#: File names; a configuration's ``files`` may name others. Knowledge and aliases may be missing, dosage is only looked for where it is asked for.
NAMES = {
    "presence": "presence.csv",
    "symptoms": "symptoms.csv",
    "dosage": "dosage.csv",
    "categories": "categories.csv",
    "features": "features.csv",
    "symptom_features": "symptom_features.csv",
    "pairs": "pairs.csv",
    "symptom_pairs": "symptom_pairs.csv",
    "conflicts": "conflicts.csv",
    "knowledge": "knowledge.txt",
    "aliases": "aliases.csv",
}
OPTIONAL = ("dosage", "knowledge", "aliases")
#: Columns that attribute files have besides an index and a name.
WIDTHS = {"categories": 30, "features": 21, "symptom_features": 31}


class Refused(ValueError):
    """What of a file was refused: ``reasons`` counts it by reason, ``rows`` is the folder of the refused rows."""

    def __init__(self, file: str, reasons: Mapping[str, int], rows: str):
        super().__init__(f"{file}: " + ", ".join(f"{n} {why}" for why, n in reasons.items()) + f"; see {rows}")
        self.reasons, self.rows = dict(reasons), rows


def reason(checks: Mapping[str, Column]) -> Column:
    """The first of the checks (by reason, whether it fails) that fails, or null. Null counts as passed."""
    out = F.lit(None).cast("string")
    for why, fails in reversed(checks.items()):
        out = F.when(fails, why).otherwise(out)
    return out


def written(df: DataFrame, file: str, folder: str, checks: Mapping[str, Column], facts: Mapping[str, Column] | None = None) -> tuple[DataFrame, dict]:
    """df as a table in the folder, and what ``facts`` (aggregates) are of it; raises Refused if a check fails. One job reads, checks, counts and writes."""
    seen = Observation()
    counts = {f"r{i}": F.count_if(F.col("__reason") == why) for i, why in enumerate(checks)}
    named = {f"f{i}": value for i, value in enumerate((facts or {}).values())}
    rows = df.withColumn("__reason", reason(checks)).observe(seen, *(c.alias(n) for n, c in {**counts, **named}.items()), F.count(F.lit(1)).alias("n"))
    rows.withColumn("__refused", F.col("__reason").isNotNull()).write.mode("overwrite").partitionBy("__refused").parquet(folder)
    got = seen.get
    if failed := {why: got[f"r{i}"] for i, why in enumerate(checks) if got.get(f"r{i}")}:
        raise Refused(file, failed, f"{folder}/__refused=true")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/__refused=false") if got.get("n") else df.sparkSession.createDataFrame([], df.schema)
    return stored, {name: got.get(f"f{i}") for i, name in enumerate(facts or {})}


def header(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return df.toDF(*(c.lstrip("﻿").strip('"') for c in df.columns))


def cells(df: DataFrame, id_col: str) -> DataFrame:
    """pid, name, item, text, val of all cells of a wide table that aren't blank or 0; an entity without any has one row without an item."""
    items = [c for c in df.columns if c != id_col]
    df = df.withColumn("__pid", F.col(f"`{id_col}`")) if id_col in df.columns else files.numbered(df, "__pid")
    cell = lambda i, c: F.struct(F.lit(i).alias("item"), F.lit(c).alias("name"), F.col(f"`{c}`").alias("text"), F.expr(f"try_cast(`{c}` AS double)").alias("val"))
    filled = F.filter(F.array(*(cell(i, c) for i, c in enumerate(items))), lambda x: (F.trim(x["text"]) != "") & (x["val"].isNull() | (x["val"] != 0)))
    return df.select(F.col("__pid").cast("string").alias("__id"), F.expr("try_cast(__pid AS long)").alias("pid"), F.explode_outer(filled).alias("x")).select("__id", "pid", "x.name", "x.item", "x.text", "x.val")


def wide(spark: SparkSession, path: str, folder: str, *, doses: bool = False, id_col: str = "prescription_id") -> tuple[DataFrame, DataFrame, list[str]]:
    """A wide table as (pid, name, item, val), its entities (pid) whether or not they have an item, and its item names in order."""
    df = header(spark, path)
    names = [c for c in df.columns if c != id_col]
    checks = {"ids that aren't whole numbers": F.col("pid").isNull(), "cells that aren't numbers": F.col("item").isNotNull() & F.col("val").isNull()}
    checks |= {"negative doses": F.col("val") < 0} if doses else {"cells that are neither 0 nor 1": F.col("val") != 1}
    rows, _ = written(cells(df, id_col), path, folder, checks)
    return rows.filter("item IS NOT NULL").select("pid", "name", "item", "val"), rows.select("pid").distinct(), names


def attributes(spark: SparkSession, path: str, folder: str, columns: list[str] | None, width: int, *, binary: bool = False) -> tuple[DataFrame, list[str]]:
    """item, name, attr of an attribute file, whose first two columns are an index from 0 and a name, and its names in order. columns: which others count, in order; all, if not given."""
    df = header(spark, path)
    wanted = columns or df.columns[2:]
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"{path}: no columns {missing}")
    if len(wanted) != width:
        raise ValueError(f"{path}: {len(wanted)} columns, not {width}")
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    rows = df.select(F.expr(f"try_cast(`{df.columns[0]}` AS int)").alias("item"), F.col(f"`{df.columns[1]}`").alias("name"), F.array(*map(number, wanted)).alias("attr"))
    checks = {"indices that aren't whole numbers from 0": F.col("item").isNull() | (F.col("item") < 0), "cells that aren't numbers": F.exists("attr", lambda x: x.isNull())}
    if binary:
        checks["cells that are neither 0 nor 1"] = F.exists("attr", lambda x: ~x.isin(0.0, 1.0))
    rows, facts = written(rows, path, folder, checks, {"n": F.count("*"), "last": F.max("item"), "several": F.count("*") - F.approx_count_distinct("item", 0.01)})
    names = [r.name for r in rows.select("item", "name").orderBy("item").collect()]  # items are as many as a model's loadings are long
    if facts["n"] and facts["last"] != facts["n"] - 1:
        raise ValueError(f"{path}: {facts['n']} rows, but indices up to {facts['last']}")
    return rows, names


def index_pairs(spark: SparkSession, path: str, folder: str, below: int, has_header: bool = True) -> DataFrame:
    """i, j of a pair list, both from 0 and below ``below``."""
    df = spark.read.csv(path, header=has_header)
    number = lambda c: F.expr(f"try_cast(`{c}` AS int)")
    rows = df.select(number(df.columns[0]).alias("i"), number(df.columns[1]).alias("j"))
    checks = {"pairs that aren't whole numbers from 0": F.coalesce((F.col("i") < 0) | (F.col("j") < 0), F.lit(True)), f"indices from {below} on": (F.col("i") >= below) | (F.col("j") >= below)}
    return written(rows, path, folder, checks)[0]


def aligned(a: list[str], b: list[str], what: str) -> None:
    """Raise, naming the first place, unless two lists of names are equal in order."""
    if a != b:
        at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        raise ValueError(f"{what}: {len(a)} and {len(b)} names, which first differ at {at}")


def load_all(spark: SparkSession, config: dict, folder: str) -> dict[str, DataFrame]:
    """Every view of a configuration as tables in the folder.

    presence, symptoms, dosage (where the configuration's ``dosage`` is on): pid, name, item, val, of the same entities; categories, features, symptom_features: item, name,
    attr, with names in the order of the views' columns; herb_attributes: categories and features side by side; pairs, symptom_pairs, conflicts: i, j within bounds;
    knowledge: symptom, item; pair_index: i, j, support, pair_id of item pairs that ``pair_support`` entities or more hold, pair_view: pid, item (the pair), val.
    ``columns`` and ``widths`` of the configuration tell which columns attribute files have.
    """
    names = {**NAMES, **config.get("files", {})}
    where = {k: v if "/" in v else f"{files.root(config)}/{v}" for k, v in names.items()}
    dosage = bool(config.get("dosage"))
    files.required(spark, {k: v for k, v in where.items() if k not in OPTIONAL or k == "dosage" and dosage})
    widths, columns, own = {**WIDTHS, **config.get("widths", {})}, config.get("columns", {}), lambda name: f"{folder}/{name}"

    out: dict[str, DataFrame] = {}
    out["presence"], entities, herbs = wide(spark, where["presence"], own("presence"))
    out["symptoms"], others, symptoms = wide(spark, where["symptoms"], own("symptoms"))
    for name, ids in (("symptoms", others), *([("dosage", None)] if dosage else [])):
        if name == "dosage":
            out["dosage"], ids, dosed = wide(spark, where["dosage"], own("dosage"), doses=True)
            aligned(herbs, dosed, "items of presence and dosage")
        if n := files.same_entities(entities, ids):
            raise ValueError(f"{n} entities are only in one of presence and {name}")
    for name, of, binary in (("categories", herbs, True), ("features", herbs, False), ("symptom_features", symptoms, False)):
        out[name], found = attributes(spark, where[name], own(name), columns.get(name), widths[name], binary=binary)
        aligned(of, found, f"items of {'symptoms' if of is symptoms else 'presence'} and {name}")
    out["herb_attributes"] = side_by_side(out["categories"], out["features"])
    for name, of in (("pairs", herbs), ("symptom_pairs", symptoms), ("conflicts", herbs)):
        out[name] = index_pairs(spark, where[name], own(name), len(of), config.get("has_header", True))
    if files.exists(spark, where["knowledge"]):
        numbered = lambda of: spark.createDataFrame(list(enumerate(of)), "item int, name string")
        alias = files.aliases(files.numbered_lines(spark, where["aliases"]), numbered(herbs)) if files.exists(spark, where["aliases"]) else None
        out["knowledge"] = files.knowledge_source(spark, where["knowledge"], numbered(herbs), numbered(symptoms), alias)
    else:
        out["knowledge"] = spark.createDataFrame([], "symptom int, item int")
    held = out["presence"].select("pid", "item")
    out["pair_index"] = pair_dictionary(held, config.get("pair_support", 20))
    out["pair_view"] = pair_view(held, out["pair_index"]).select("pid", F.col("pair_id").alias("item"), F.lit(1.0).alias("val"))
    return out


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """item, name, attr of two attribute tables with one item after the other's columns."""
    return a.join(b.select("item", F.col("attr").alias("__more")), "item").select("item", "name", F.concat("attr", "__more").alias("attr"))
