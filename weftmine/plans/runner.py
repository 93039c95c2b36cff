"""From configurations to written metrics: runs that any session can carry on where another stopped.

A folder holds, on any file system that Spark reaches:

- ``manifest/<key>.json``, a row for each finished run. A row is written beside its place and moved there in one step, and never changed; a run without one hasn't ended.
- ``runs/<key>``, its files: loadings, mixtures, history, metrics. They are made in a folder of their own and moved to their place in one step, before the row is.
- ``history/<key>``, losses of rounds, a file for every few rounds as they end, so that a run can be looked at while it lasts.

What is left to do are the configurations without a row: an anti-join of both tables. Fits and metrics are Spark jobs; the loop over configurations is the driver's, as is one row for each.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmine.operators import baselines, factorize, graph, hypergraph, infer, metrics, split, weighting
from weftmine.operators.gather import gathered
from weftmine.plans.evaluate import evaluate_all
from weftmine.plans.experiments import checked
from weftmine.plans.experiments import key as canonical
from weftmine.session import cut, drop, dropped_folder, stored
from weftmine.sources.files import exists, merged, moved, write_json

#: What a configuration leaves out.
DEFAULTS = {
    "k": 30,
    "seed": 42,
    "model": "views",
    "roles": 1,
    "weight": {"ph": 1.0, "ps": 1.0},
    "graph": {},
    "laplacian": "none",
    "hyper": 0.0,
    "l1": {},
    "contra": 0.0,
    "knowledge": 0.0,
    "input": {"idf": True, "smooth": True, "sublinear": False, "norm": "l2"},
    "split": {"train": 0.8, "valid": 0.1},
    "training": {"mode": "mur", "start": "random", "iterations": 30, "pretrain": 0, "warm_up": 0, "tolerance": 1e-5, "rate": 1e-3, "average": 0, "select": "last", "metric": "map", "every": 10, "patience": 3, "stop_early": False},
    "inference": {"method": "nnls", "alpha": 0.1, "without_idf": True},
    "evaluate": {"part": "test", "kind": "ranking", "ks": [5, 10]},
    "rounds_a_file": 10,
}
#: Parts of metrics' names of which less is better.
LESS = ("nre", "ppl", "loss", "mae", "rmse", "smape", "violation")


@dataclass
class Inputs:
    """views: pid, item, val by name (ph, ps, and pd or pair); graphs: i, j, w by view; hyper: edge, members, weight of ph; conflicts: i, j, w of ph; knowledge: item of ph, symptom of ps."""

    views: dict[str, DataFrame]
    graphs: dict[str, DataFrame] = field(default_factory=dict)
    hyper: DataFrame | None = None
    conflicts: DataFrame | None = None
    knowledge: DataFrame | None = None
    rows: DataFrame | None = None  # as ``ready`` stores them: pid, and by view an array of (item, val)


@dataclass
class Trained:
    loadings: dict[str, DataFrame]  # item, k, v by view
    mixtures: DataFrame  # pid, g
    history: list[dict[str, float]]
    rows: DataFrame | None = None  # stored, from which mixtures are made when they are read


@dataclass
class Frequencies:
    """Of a view of the training entities: item, df, and how many entities it has."""

    items: DataFrame
    n: int


def run_key(config: dict) -> str:
    """A configuration's name: equal ones have one, whatever the order of their settings."""
    return hashlib.sha256(canonical(config).encode()).hexdigest()[:16]


def active(config: dict) -> list[str]:
    """Terms that are on besides the two views, in a fixed order; a run's name in words is made of them."""
    on = {"graph ph": config["graph"].get("ph"), "graph ps": config["graph"].get("ps"), "hyper": config["hyper"], "l1": any(config["l1"].values()), "conflict": config["contra"], "pair": config["weight"].get("pair"), "dose": config["weight"].get("pd"), "knowledge": config["knowledge"]}
    return [name for name, value in on.items() if value]


def in_words(config: dict) -> str:
    return " + ".join(active(config)) or "views only"


def dated(name: str, at: datetime | None = None) -> str:
    """A folder's name by day and time, such as for a set of runs."""
    return f"{name}-{at or datetime.now(UTC):%Y%m%d-%H%M%S}"


def numbered_items(view: DataFrame) -> dict:
    """Items of a view from 0 in order. They come to the driver, as a model's loadings do."""
    return {r.item: i for i, r in enumerate(view.select("item").distinct().orderBy("item").collect())}


def _dense(cells: Iterable[tuple], shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for i, j, v in cells:
        out[i, j] += v
    return out


def _square(table: DataFrame, at: dict, value: str) -> np.ndarray:
    return _dense(((at[r.i], at[r.j], r[value]) for r in table.collect() if r.i in at and r.j in at), (len(at), len(at)))


def terms(spark: SparkSession, inputs: Inputs, at: dict[str, dict], config: dict) -> factorize.Terms:
    """The loss that a configuration asks for; a term that is on needs its table."""
    laplacians: dict[str, tuple[float, np.ndarray]] = {}
    for view, weight in config["graph"].items():
        if weight:
            nodes = spark.createDataFrame([(x,) for x in at[view]], inputs.views[view].select("item").schema)
            laplacians[view] = (weight, _square(graph.laplacian(inputs.graphs[view], nodes, config["laplacian"]), at[view], "v"))
    if config["hyper"]:
        own = config["hyper"] * _square(hypergraph.laplacian(inputs.hyper), at["ph"], "v")
        weight, lap = laplacians.get("ph", (0.0, 0.0))
        laplacians["ph"] = (1.0, weight * lap + own)
    known = None
    if config["knowledge"]:
        pairs = inputs.knowledge.distinct().collect()
        known = (config["knowledge"], _dense(((at["ph"][r.item], at["ps"][r.symptom], 1.0) for r in pairs if r.item in at["ph"] and r.symptom in at["ps"]), (len(at["ph"]), len(at["ps"]))))
    conflict = (config["contra"], _square(inputs.conflicts, at["ph"], "w")) if config["contra"] else None
    return factorize.Terms({v: w for v, w in config["weight"].items() if w}, laplacian=laplacians, l1={k: v for k, v in config["l1"].items() if v}, conflict=conflict, knowledge=known)


def ready(inputs: Inputs) -> Inputs:
    """inputs with each entity's items of all views as one stored row. All runs read these: splits, weights, rounds and rankings are made where an entity's items are, and views aren't made again."""
    return inputs if inputs.rows is not None else replace(inputs, rows=stored(gathered(inputs.views)))


def parts(inputs: Inputs, config: dict) -> DataFrame:
    """pid, split of the entities that have items in both views, with the items of each view beside them."""
    rows = ready(inputs).rows.filter((F.size("ph") > 0) & (F.size("ps") > 0))
    chosen = {"seed": config["seed"], **config["split"]}
    return rows.withColumn("split", split.part_of(rows, split.borders(rows, **chosen), chosen["seed"]))


def _beside(inputs: Inputs, splits: DataFrame) -> DataFrame:
    """splits with the items of each view beside them."""
    return splits if set(inputs.views) <= set(splits.columns) else splits.join(ready(inputs).rows, "pid")


def _long(rows: DataFrame, view: str) -> DataFrame:
    """pid, item, val of a view of rows."""
    return rows.select("pid", F.explode(view).alias("__c")).select("pid", "__c.*")


def frequencies(spark: SparkSession, inputs: Inputs, splits: DataFrame) -> dict[str, Frequencies]:
    """Of both views, how many training entities hold each item. Items come to the driver, as a model's loadings do."""
    own = _beside(inputs, splits).filter("split = 'train'")
    n = own.agg(*(F.count(F.when(F.size(v) > 0, 1)).alias(v) for v in ("ph", "ps"))).first()
    out = {}
    for view in ("ph", "ps"):
        found = weighting.document_frequency(_long(own, view))
        out[view] = Frequencies(spark.createDataFrame(found.collect(), found.schema), n[view])
    return out


def weighted(inputs: Inputs, splits: DataFrame, config: dict, at: dict[str, dict], known: dict[str, Frequencies]) -> DataFrame:
    """pid with <view>_i and <view>_v, as ``factorize.rows_of`` gives them, of the training entities and the views ``at`` with the weights of ``input``. They are stored."""
    chosen = config["input"]
    norm, sublinear = chosen.get("norm", "l2"), chosen.get("sublinear", False)
    if norm not in ("l1", "l2", "none"):
        raise ValueError(f"unknown norm {norm}")
    plan = []
    for view in at:
        idf = None
        if view in ("ph", "ps") and chosen.get("idf", True):
            weights = {r.item: r.idf for r in weighting.idf_of(known[view].items, known[view].n, chosen.get("smooth", True)).collect()}
            idf = np.array([weights.get(x, 0.0) for x in at[view]])
        plan.append((view, infer.numbered(list(at[view]), inputs.views[view], "item"), idf, norm if view in ("ph", "ps") else "none"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column("pid")]
            for view, names, idf, norm in plan:
                lists = batch.column(view)
                flat, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                no = pc.fill_null(pc.index_in(flat.field("item"), names, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
                there = no >= 0
                row, no, value = row[there], no[there], flat.field("val").to_numpy(zero_copy_only=False)[there]
                if idf is not None:
                    value = (np.log1p(value) if sublinear else value) * idf[no]
                if norm != "none":
                    size = np.bincount(row, value * value if norm == "l2" else value, batch.num_rows)
                    value = value / np.maximum(np.sqrt(size) if norm == "l2" else size, 1e-12)[row]
                ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))), pa.int32())
                out += [pa.ListArray.from_arrays(ends, pa.array(no, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value, pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, names=["pid", *(f"{v}_{c}" for v, *_ in plan for c in ("i", "v"))])

    own = _beside(inputs, splits).filter("split = 'train'").filter(" OR ".join(f"size({v}) > 0" for v in at)).select("pid", *at)
    return stored(own.mapInArrow(placed, f"pid {dict(own.dtypes)['pid']}, " + ", ".join(f"{v}_i array<int>, {v}_v array<double>" for v in at)))


def _table(spark: SparkSession, at: dict, m: np.ndarray, view: DataFrame) -> DataFrame:
    kind = dict(view.dtypes)["item"]
    rows = [(x, k, float(m[i, k])) for x, i in at.items() for k in range(m.shape[1])]
    return spark.createDataFrame(rows, f"item {kind}, k int, v double")


def train(spark: SparkSession, inputs: Inputs, splits: DataFrame, config: dict, on_step: Callable | None = None, known: dict[str, Frequencies] | None = None) -> Trained:
    """A model of the training entities, by the configuration's terms and steps, or one of the baselines. Loadings of several roles are given as their sums. known: the views' ``frequencies``, counted if not given."""
    checked(config)
    inputs = ready(inputs)
    known = known or frequencies(spark, inputs, splits)
    at = {view: numbered_items(_long(inputs.rows, view)) for view in inputs.views if config["weight"].get(view)}
    n = {view: len(items) for view, items in at.items()}
    rows, k, seed, how = weighted(inputs, splits, config, at, known), config["k"], config["seed"], config["training"]
    if config["model"] != "views":
        mixtures, h = baselines.run(config["model"], rows, n, k, iterations=how["iterations"], seed=seed)
        return Trained({v: _table(spark, at[v], m, inputs.views[v]) for v, m in h.items()}, mixtures, [], rows)
    h = factorize.drawn(n, k, seed)
    if how["start"] == "nndsvd":
        h["ph"], g = factorize.nndsvd(rows, "ph", n["ph"], k)
        h["ps"], _ = factorize.nndsvd(rows, "ps", n["ps"], k)
        state = cut(rows.join(g, "pid"))
    elif how["start"] == "random":
        state = factorize.start(rows, k, seed)
    else:
        raise ValueError(f"unknown start {how['start']}")
    if (roles := config["roles"]) > 1:
        state, h = factorize.by_roles(state, h, roles, seed)
    whole = lambda h: {v: m if v != "ph" else factorize.over_roles(m, roles) for v, m in h.items()}
    evaluate = None
    if how["stop_early"] or how["select"] == "best":
        sign = -1.0 if any(x in how["metric"] for x in LESS) else 1.0
        held = {**config, "evaluate": {**config["evaluate"], "part": "valid"}}

        def evaluate(h: factorize.Factors) -> float:
            found = measured(spark, inputs, splits, {v: _table(spark, at[v], m, inputs.views[v]) for v, m in whole(h).items()}, held, known)
            return sign * found[how["metric"]]

    patience = how["patience"] if how["stop_early"] else how["iterations"] + 1
    options = {c: how[c] for c in ("iterations", "warm_up", "pretrain", "tolerance", "rate", "average", "select", "every")}
    found = factorize.fit(state, h, replace(terms(spark, inputs, at, config), roles=roles), how["mode"], evaluate=evaluate, patience=patience, on_step=on_step, **options)
    return Trained({v: _table(spark, at[v], m, inputs.views[v]) for v, m in whole(found.factors).items()}, found.state.select("pid", "g"), found.history, rows)


def measured(spark: SparkSession, inputs: Inputs, splits: DataFrame, loadings: dict[str, DataFrame], config: dict, known: dict[str, Frequencies] | None = None) -> dict[str, float]:
    """Metrics of the entities of a part of the split: ranking in both directions, or all there are. ``map`` is the mean of both directions'."""
    own = _beside(inputs, splits).filter(F.col("split") == config["evaluate"]["part"])
    h, s = loadings["ph"], loadings["ps"]
    how, ks = config["inference"], tuple(config["evaluate"]["ks"])
    if how["without_idf"] and config["input"].get("idf", True):
        known = known or frequencies(spark, inputs, splits)
        h, s = (weighting.without_idf(m, weighting.idf_of(known[v].items, known[v].n)) for v, m in (("ph", h), ("ps", s)))
    h, s = cut(h), cut(s)
    if config["evaluate"]["kind"] == "all":
        herbs, symptoms = (cut(_long(own, v)) for v in ("ph", "ps"))
        out = evaluate_all(herbs, symptoms, h, s, n=weighting.entities(herbs), conflict=inputs.conflicts, edges=inputs.hyper, method=how["method"], alpha=how["alpha"], ks=ks)
    elif config["evaluate"]["kind"] == "ranking":
        out = {}
        for name, source, truth, by, to in (("sym2herb", "ps", "ph", s, h), ("herb2sym", "ph", "ps", h, s)):
            # What is true of an entity stays beside its id, so that it is ranked and judged without being dealt out.
            cells = F.transform(source, lambda c: F.struct(c["item"].alias("item"), c["val"].alias("v")))
            queries = own.select(F.struct("pid", F.col(truth).alias("true")).alias("pid"), cells.alias("__cells"))
            found = infer.ranking(queries, by, to, how["method"]).select("pid.*", "found")
            out |= {f"{name}_{c}": float(v) for c, v in metrics.recommendation(found, None, ks).first().asDict().items()}
    else:
        raise ValueError(f"unknown kind of evaluation {config['evaluate']['kind']}")
    return out | {"map": (out["sym2herb_map"] + out["herb2sym_map"]) / 2}


class History:
    """Losses of rounds, written a few at a time. ``attempt`` tells what an earlier, broken run left."""

    def __init__(self, spark: SparkSession, folder: str, name: str, attempt: str, every: int):
        self.spark, self.path, self.name, self.attempt, self.every, self.rows = spark, f"{folder}/history/{name}", name, attempt, every, []

    def __call__(self, i: int, losses: dict[str, float]) -> None:
        self.rows.append({"key": self.name, "attempt": self.attempt, "round": i, "losses": losses})
        if len(self.rows) >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            write_json(self.spark, self.rows, f"{self.path}/{self.attempt}-{self.rows[0]['round']:06d}.json")
            self.rows = []


def run_one(spark: SparkSession, inputs: Inputs, config: dict, folder: str) -> dict[str, float]:
    """One configuration from its split to a row of the manifest."""
    config = merged(DEFAULTS, config)
    name, attempt = run_key(config), uuid.uuid4().hex[:12]
    history = History(spark, folder, name, attempt, config["rounds_a_file"])
    inputs = ready(inputs)
    splits = parts(inputs, config)
    known = frequencies(spark, inputs, splits)
    found = train(spark, inputs, splits, config, history, known)
    history.flush()
    scores = measured(spark, inputs, splits, found.loadings, config, known)
    staged = f"{folder}/runs/.{name}-{attempt}"
    for view, m in found.loadings.items():
        m.write.parquet(f"{staged}/loadings/{view}")
    found.mixtures.write.parquet(f"{staged}/mixtures")
    drop(found.rows)
    write_json(spark, found.history, f"{staged}/history.json")
    write_json(spark, config, f"{staged}/config.json")
    write_json(spark, scores, f"{staged}/metrics.json")
    if exists(spark, f"{folder}/runs/{name}"):  # of a run that ended before its row was there
        dropped_folder(spark, f"{folder}/runs/{name}")
    moved(spark, staged, f"{folder}/runs/{name}")
    row = {"key": name, "attempt": attempt, "config": canonical(config), "name": in_words(config), "stage": str(config.get("stage", "")), "seed": config["seed"], "k": config["k"], "rounds": len(found.history), "metrics": scores}
    write_json(spark, row, f"{folder}/manifest/{name}.json")
    return scores


ROW = "key string, attempt string, config string, name string, stage string, seed long, k long, rounds long, metrics map<string,double>"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """key, attempt, config, name, stage, seed, k, rounds, metrics of the finished runs."""
    if not exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], ROW)
    return spark.read.schema(ROW).json(f"{folder}/manifest", multiLine=True)


def left(spark: SparkSession, configs: Iterable[dict], folder: str) -> list[dict]:
    """Configurations without a row in the manifest, in order; equal ones once."""
    rows = [(i, run_key(c), canonical(c)) for i, c in enumerate(merged(DEFAULTS, c) for c in configs)]
    wanted = spark.createDataFrame(rows, "no int, key string, config string").dropDuplicates(["key"])
    return [json.loads(r.config) for r in wanted.join(manifest(spark, folder), "key", "left_anti").orderBy("no").collect()]


def run_all(spark: SparkSession, inputs: Inputs, configs: Iterable[dict], folder: str) -> DataFrame:
    """Do what is left of the configurations, and give all results of the folder. A configuration's rows stay, whatever becomes of the next."""
    todo = left(spark, configs, folder)
    inputs = ready(inputs) if todo else inputs
    for config in todo:
        run_one(spark, inputs, config, folder)
    return results(spark, folder)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """stage, seed, k, name, rounds, metric, value of the finished runs."""
    return manifest(spark, folder).select("stage", "seed", "k", "name", "rounds", F.explode("metrics").alias("metric", "value"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    """key, round, term, value: losses of the finished runs' rounds. What broken runs have left of theirs isn't among them."""
    rows = spark.read.schema("key string, attempt string, round long, losses map<string,double>").json(f"{folder}/history/*", multiLine=True)
    return rows.join(manifest(spark, folder).select("key", "attempt"), ["key", "attempt"], "left_semi").select("key", "round", F.explode("losses").alias("term", "value"))
