"""Readers and writers of the file forms of entity-item data: wide presence and dose tables, attribute tables, pair lists, alias and knowledge text, results."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows of a file scan with numbers from 0 in the order in which they are read. Only the partitions' counts, a row for each, come together in one task."""
    at = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = at.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__begin", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return at.join(begins.drop("__n"), "__part").withColumn(name, F.col("__begin") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__begin")


def wide(spark: SparkSession, path: str, id_col: str = "prescription_id") -> DataFrame:
    """pid, name, item, val of every non-zero cell of a wide CSV; items are numbered by column. Without an id column, rows are numbered as read. Cells that aren't numbers raise; blank ones are 0."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*(n.lstrip("\ufeff").strip('"') for n in df.columns))
    items = [n for n in df.columns if n != id_col]
    number = lambda n: F.expr(f"try_cast(`{n}` AS double)")
    wrong = df.agg(*(F.max(F.col(f"`{n}`").isNotNull() & (F.trim(f"`{n}`") != "") & number(n).isNull()).alias(f"c{i}") for i, n in enumerate(items))).first() if items else ()
    if bad := [n for n, w in zip(items, wrong, strict=True) if w]:
        raise ValueError(f"{path}: cells that are not numbers in {bad}")
    df = df.withColumn("__pid", F.col(f"`{id_col}`").cast("long")) if id_col in df.columns else numbered(df, "__pid")
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("item"), F.lit(n).alias("name"), number(n).alias("val")) for i, n in enumerate(items))))
    return df.select(F.col("__pid").alias("pid"), cells.alias("c")).select("pid", "c.name", "c.item", "c.val").filter("val IS NOT NULL AND val <> 0")


def presence(spark: SparkSession, path: str, id_col: str = "prescription_id") -> DataFrame:
    """Wide 0/1 table; other values raise."""
    df = wide(spark, path, id_col)
    if bad := df.filter("val <> 1").limit(1).count():
        raise ValueError(f"{path}: {bad} cells or more are neither 0 nor 1")
    return df


def dosage(spark: SparkSession, path: str, id_col: str = "prescription_id") -> DataFrame:
    """Wide table of doses; negative ones raise."""
    df = wide(spark, path, id_col)
    if not df.filter("val < 0").isEmpty():
        raise ValueError(f"{path}: negative doses")
    return df.withColumnRenamed("val", "dose")


def attributes(spark: SparkSession, path: str, columns: Sequence[str] | None = None, width: int | None = None) -> DataFrame:
    """item, name, attr: the first two columns, and the others (or those named, in order) as an array."""
    df = spark.read.csv(path, header=True)
    wanted = list(columns or df.columns[2:])
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"{path}: no columns {missing}")
    if width is not None and len(wanted) != width:
        raise ValueError(f"{path}: {len(wanted)} columns, not {width}")
    return df.select(F.col(df.columns[0]).cast("int").alias("item"), F.col(df.columns[1]).alias("name"), F.array(*(F.col(f"`{c}`").cast("double") for c in wanted)).alias("attr"))


def pairs(spark: SparkSession, path: str, has_header: bool = True) -> DataFrame:
    """i, j of the first two columns. has_header takes the first line for names, whatever it holds."""
    df = spark.read.csv(path, header=has_header)
    out = df.select(F.col(df.columns[0]).cast("int").alias("i"), F.col(df.columns[1]).cast("int").alias("j"))
    if not out.filter("i IS NULL OR j IS NULL OR i < 0 OR j < 0").isEmpty():
        raise ValueError(f"{path}: indices must be whole numbers from 0")
    return out


def knowledge_pairs(pairs_: DataFrame, n_items: int, n_symptoms: int) -> DataFrame:
    """item, symptom of index pairs in either order of columns: the larger bounds decide, symptom first where both fit."""
    top = pairs_.agg(F.max("i"), F.max("j")).first()
    if top[0] is None or (top[0] < n_symptoms and top[1] < n_items):
        return pairs_.select(F.col("j").alias("item"), F.col("i").alias("symptom")).distinct()
    if top[0] < n_items and top[1] < n_symptoms:
        return pairs_.select(F.col("i").alias("item"), F.col("j").alias("symptom")).distinct()
    raise ValueError("indices beyond both tables")


def aliases(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """alias, canonical from lines (no, value) 'canonical,alias,...'; the canonical name is an alias too, and of repeated aliases the last line's holds. With names (name), lines of other canonical names don't count."""
    tokens = F.filter(F.transform(F.split("value", ","), lambda t: F.trim(t)), lambda t: t != "")
    rows = lines.select("no", tokens.alias("t")).filter(F.size("t") > 0)
    rows = rows.select("no", F.element_at("t", 1).alias("canonical"), F.explode("t").alias("alias"))
    if names is not None:
        rows = rows.join(names.select(F.col("name").alias("canonical")).distinct(), "canonical", "left_semi")
    last = Window.partitionBy("alias").orderBy(F.desc("no"))
    return rows.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").select("alias", "canonical")


def knowledge_tokens(lines: DataFrame) -> DataFrame:
    """symptom, token from lines (no, value) 'symptom<TAB>herb herb ...', where more tabs part herbs too; lines without herbs give nothing."""
    parts = F.split("value", "\t")
    rest = F.trim(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    rows = lines.filter(F.instr("value", "\t") > 0).select("no", F.trim(parts[0]).alias("symptom"), F.explode(F.split(rest, r"\s+")).alias("token"))
    return rows.filter("symptom <> '' AND token <> ''")


def knowledge(tokens: DataFrame, names: DataFrame, alias: DataFrame, symptoms: DataFrame) -> DataFrame:
    """symptom, item: tokens found among names (item, name), directly or by their alias, of known symptoms (symptom)."""
    found = resolved(tokens, names, alias).filter("item IS NOT NULL")
    return found.join(symptoms.select("symptom"), "symptom", "left_semi").select("symptom", "item").distinct()


def resolved(tokens: DataFrame, names: DataFrame, alias: DataFrame) -> DataFrame:
    direct = names.select(F.col("name").alias("token"), F.col("item").alias("direct"))
    by_alias = alias.join(names, alias["canonical"] == names["name"]).select(F.col("alias").alias("token"), F.col("item").alias("indirect"))
    return tokens.join(direct, "token", "left").join(by_alias, "token", "left").withColumn("item", F.coalesce("direct", "indirect")).drop("direct", "indirect")


def unmatched(tokens: DataFrame, names: DataFrame, alias: DataFrame) -> DataFrame:
    """token, n: what neither a name nor an alias explains."""
    return resolved(tokens, names, alias).filter("item IS NULL").groupBy("token").agg(F.count("*").alias("n"))


def unmatched_symptoms(tokens: DataFrame, symptoms: DataFrame) -> DataFrame:
    """symptom, n: lines with herbs whose symptom is not among symptoms (symptom)."""
    lines = tokens.select("no", "symptom").distinct().join(symptoms.select("symptom").distinct(), "symptom", "left_anti")
    return lines.groupBy("symptom").agg(F.count("*").alias("n"))


def covered(knowledge_: DataFrame) -> DataFrame:
    """items, symptoms: how many of each the knowledge (symptom, item) holds."""
    return knowledge_.agg(F.countDistinct("item").alias("items"), F.countDistinct("symptom").alias("symptoms"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """no, value of a small text file, read whole in one task so that lines keep their order."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("no", "value"))


def optional(spark: SparkSession, path: str, schema: str, read) -> DataFrame:
    """What ``read`` gives, or an empty table where there is no such file."""
    return read(spark, path) if exists(spark, path) else spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


#: File names of the inputs; a configuration's ``files`` may name others. The first three must be there.
FILES = {"presence": "presence.csv", "dosage": "dosage.csv", "symptoms": "symptoms.csv", "attributes": "attributes.csv", "conflicts": "conflicts.csv", "knowledge": "knowledge.txt", "aliases": "aliases.csv"}
NEEDED = ("presence", "dosage", "symptoms")


def paths(config: dict | None = None) -> dict[str, str]:
    """Where each input lies: in root(config), by FILES and the configuration's ``files``."""
    names = {**FILES, **(config or {}).get("files", {})}
    return {k: v if "/" in v else f"{root(config)}/{v}" for k, v in names.items()}


def required(spark: SparkSession, wanted: dict[str, str]) -> None:
    if missing := [f"{k}: {path}" for k, path in wanted.items() if not exists(spark, path)]:
        raise FileNotFoundError(", ".join(missing))


def names_of(view: DataFrame) -> DataFrame:
    return view.select("item", "name").distinct()


def knowledge_source(spark: SparkSession, path: str, names: DataFrame, symptoms: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """symptom, item as numbers, from a text file of names (.txt) or a list of index pairs (any other). names: item, name; symptoms: item, name."""
    if path.endswith(".txt"):
        alias = alias if alias is not None else spark.createDataFrame([], "alias string, canonical string")
        found = knowledge(knowledge_tokens(numbered_lines(spark, path)), names, alias, symptoms.select(F.col("name").alias("symptom")))
        return found.join(symptoms.select(F.col("name").alias("symptom"), F.col("item").alias("__s")), "symptom").select(F.col("__s").alias("symptom"), "item")
    return knowledge_pairs(pairs(spark, path), names.count(), symptoms.count()).select("symptom", "item")


def load_views(spark: SparkSession, config: dict | None = None) -> dict[str, DataFrame]:
    """All inputs of a configuration: presence, dosage and symptoms (pid, name, item, val or dose), which must hold the same entities, dosage and presence
    the same items in the same order; attributes, conflicts and knowledge where their files are."""
    where = paths(config)
    required(spark, {k: where[k] for k in NEEDED})
    views = {"presence": presence(spark, where["presence"]), "dosage": dosage(spark, where["dosage"]), "symptoms": presence(spark, where["symptoms"])}
    for name in ("dosage", "symptoms"):
        if n := same_entities(views["presence"], views[name]):
            raise ValueError(f"{n} entities are only in one of presence and {name}")
    herbs, symptoms = names_of(views["presence"]), names_of(views["symptoms"])
    if n := misplaced_names(herbs, names_of(views["dosage"])).count():
        raise ValueError(f"{n} items differ between presence and dosage")
    if exists(spark, where["attributes"]):
        views["attributes"] = attributes(spark, where["attributes"])
    if exists(spark, where["conflicts"]):
        views["conflicts"] = pairs(spark, where["conflicts"])
    if exists(spark, where["knowledge"]):
        alias = aliases(numbered_lines(spark, where["aliases"]), herbs) if exists(spark, where["aliases"]) else None
        views["knowledge"] = knowledge_source(spark, where["knowledge"], herbs, symptoms, alias)
    return views


def root(config: dict | None = None, variable: str = "WEFTMINE_DATA_ROOT") -> str:
    """Folder of the input files: the configuration's, else the environment's, else ``data``."""
    return (config or {}).get("data_root") or os.environ.get(variable) or "data"


def merged(base: dict, override: dict) -> dict:
    """Nested settings with others laid over them."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def same_entities(a: DataFrame, b: DataFrame) -> int:
    """Ids that only one of two tables has."""
    left, right = a.select("pid").distinct().withColumn("l", F.lit(1)), b.select("pid").distinct().withColumn("r", F.lit(1))
    return left.join(right, "pid", "full").filter("l IS NULL OR r IS NULL").count()


def misplaced_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """item, name, other: positions where two name tables (item, name) differ."""
    return a.join(b.withColumnRenamed("name", "other"), "item", "full").filter("NOT (name <=> other)")


def results(spark: SparkSession, path: str) -> DataFrame:
    """A results CSV with typed metrics; blank fields are null. A byte order mark is dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    df = df.toDF(*(c.lstrip("﻿").strip('"') for c in df.columns))
    text = {"variant", "status"}
    return df.select(*(F.col(f"`{c}`") if c in text else F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in df.columns))


def summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Summary JSON files, one object each; ``test_metrics`` is lifted to the top where there is one."""
    df = spark.read.json(pattern, multiLine=True)
    return df.select("test_metrics.*", *(c for c in df.columns if c != "test_metrics")) if "test_metrics" in df.columns else df


def run_tree(spark: SparkSession, folder: str, pattern: str = r"/([^/]+)/seed_(\d+)/K_(\d+)/(summary|metrics)\.json$") -> DataFrame:
    """stage, seed, k, metric, value of a tree of runs <stage>/seed_<n>/K_<n>: of each run what its summary.json says, or, where there is none, its metrics.json.

    Runs are known by their files' paths. Numbers at the top of a document count, those under ``test_metrics`` before them; of a list, such as a history, the last entry does.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    part = lambda i: F.regexp_extract(F.col("path"), pattern, i)
    rows = text.select("value", F.col("_metadata.file_path").alias("path")).filter(F.col("path").rlike(pattern))
    rows = rows.select(part(1).alias("stage"), part(2).cast("long").alias("seed"), part(3).cast("long").alias("k"), (part(4) != "summary").alias("second"), "value")
    best = rows.groupBy("stage", "seed", "k").agg(F.min_by("value", "second").alias("value"))
    entries = F.from_json("value", "array<string>")
    one = F.when(F.trim("value").startswith("["), F.element_at(F.filter(F.coalesce(entries, F.array()), lambda x: x.isNotNull()), -1)).otherwise(F.col("value"))
    best = best.withColumn("one", one)
    top, inner = F.from_json("one", "map<string,string>"), F.from_json(F.get_json_object("one", "$.test_metrics"), "map<string,string>")
    nothing = F.create_map().cast("map<string,string>")
    inner, top = F.coalesce(inner, nothing), F.coalesce(top, nothing)
    whole = F.map_concat(F.map_filter(top, lambda n, _: ~F.array_contains(F.map_keys(inner), n)), inner)
    found = best.select("stage", "seed", "k", F.explode(whole).alias("metric", "text")).select("stage", "seed", "k", "metric", F.expr("try_cast(text AS double)").alias("value"))
    return found.filter("value IS NOT NULL")


def read_config(spark: SparkSession, path: str, base: dict | None = None) -> dict:
    """A configuration file, JSON or YAML by its name, laid over ``base``. It is read on any file system; YAML of nested settings, lists in brackets and scalars needs no other package."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return merged(base or {}, json.loads(text) if path.endswith(".json") else plain_yaml(text))


def plain_yaml(text: str) -> dict:
    """Settings nested by indentation, with scalars and one-line lists for values."""

    def scalar(word: str) -> object:
        word = word.strip()
        if word.startswith("[") and word.endswith("]"):
            return [scalar(x) for x in word[1:-1].split(",") if x.strip()]
        if word[:1] in ("'", '"') and word[-1:] == word[:1]:
            return word[1:-1]
        if (low := word.lower()) in ("true", "false"):
            return low == "true"
        if low in ("", "null", "~"):
            return None
        for kind in (int, float):
            try:
                return kind(word)
            except ValueError:
                continue
        return word

    out: dict = {}
    levels = [(-1, out)]
    for number, line in enumerate(text.splitlines(), 1):
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip() if "#" in line and not re.search(r"""["'].*#.*["']""", line) else line.rstrip()
        if not bare.strip() or bare.strip() == "---":
            continue
        indent, (name, colon, value) = len(bare) - len(bare.lstrip()), bare.strip().partition(":")
        if not colon:
            raise ValueError(f"line {number}: no setting")
        while levels[-1][0] >= indent:
            levels.pop()
        if value.strip():
            levels[-1][1][name.strip()] = scalar(value)
        else:
            levels[-1][1][name.strip()] = inner = {}
            levels.append((indent, inner))
    return out


def write_factors(factors: DataFrame, path: str) -> None:
    factors.write.mode("overwrite").parquet(path)


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """What write_factors wrote."""
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else writer.json)(path)


def moved(spark: SparkSession, path: str, to: str, over: bool = False) -> None:
    """Give a file or folder another name in one step; ``over``: a file that is there goes in the same step."""
    jvm, where = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if over else kind.NONE
    system = where(to).getFileSystem(spark._jsc.hadoopConfiguration())
    target = system.makeQualified(where(to))
    system.mkdirs(target.getParent())
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(system.makeQualified(where(path)), target, options)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small document, on any file system: written beside its place, then moved there in one step, so that readers see the old one or the new one."""
    where = spark._jvm.org.apache.hadoop.fs.Path
    folder, name = os.path.split(path)
    beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    out = where(beside).getFileSystem(spark._jsc.hadoopConfiguration()).create(where(beside), True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    out.close()
    moved(spark, beside, path, over=True)
