"""Runs that stop and go on give what unbroken ones do."""

import json

import pytest
from pyspark.sql import functions as F

from weftmine.operators import constraints
from weftmine.plans import experiments, runner
from weftmine.sources import files


@pytest.fixture(scope="module")
def inputs(spark):
    ph = spark.createDataFrame([(p, f"h{(p * 7 + i * i) % 6}", 1.0) for p in range(40) for i in range(3)], "pid long, item string, val double").distinct()
    ps = spark.createDataFrame([(p, (p + i) % 4, 1.0) for p in range(40) for i in range(2)], "pid long, item int, val double")
    edges = spark.createDataFrame([("h0", "h1", 1.0), ("h1", "h0", 1.0)], "i string, j string, w double")
    known = spark.createDataFrame([("h0", 1), ("h5", 2), ("none", 3)], "item string, symptom int")
    return runner.Inputs({"ph": ph, "ps": ps}, {"ph": edges}, conflicts=constraints.conflicts(edges.filter("i < j").select("i", "j")), knowledge=known)


BASE = {"k": 2, "graph": {"ph": 0.5}, "l1": {"g": 0.01}, "knowledge": 0.1, "contra": 0.05, "training": {"iterations": 3}, "inference": {"method": "dot"}, "evaluate": {"ks": [2]}, "rounds_a_file": 2}


def two_stages():
    return [c for c in experiments.ablation(BASE, [1], [2]) if c["stage"] in ("full", "views_only")]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_broken_run_goes_on(spark, inputs, tmp_path, monkeypatch):
    whole = rows(runner.run_all(spark, inputs, two_stages(), f"{tmp_path}/whole"))
    assert {(r[0], r[3]) for r in whole} == {("full", "graph ph + l1 + conflict + knowledge"), ("views_only", "conflict")}
    assert {r[5] for r in whole} >= {"map", "sym2herb_map", "herb2sym_ndcg_2"}

    real, seen = runner.History.__call__, []

    def breaks(self, i, losses):
        real(self, i, losses)
        seen.append(self.name)
        if len(set(seen)) == 2 and i == 1:
            raise KeyboardInterrupt

    folder = f"{tmp_path}/broken"
    monkeypatch.setattr(runner.History, "__call__", breaks)
    with pytest.raises(KeyboardInterrupt):
        runner.run_all(spark, inputs, two_stages(), folder)
    monkeypatch.setattr(runner.History, "__call__", real)
    assert [c["stage"] for c in runner.left(spark, two_stages(), folder)] == ["views_only"]
    # What the broken run has left of its rounds doesn't count.
    assert {r.key for r in runner.history(spark, folder).collect()} == {runner.run_key(runner.merged(runner.DEFAULTS, two_stages()[0]))}
    assert rows(runner.run_all(spark, inputs, two_stages(), folder)) == whole
    assert rows(runner.history(spark, folder)) == rows(runner.history(spark, f"{tmp_path}/whole"))
    assert runner.left(spark, [*two_stages(), *two_stages()], folder) == []

    for row in runner.manifest(spark, folder).collect():
        path = f"{folder}/runs/{row['key']}"
        assert files.exists(spark, f"{path}/config.json") and json.load(open(f"{path}/metrics.json")) == row.metrics
        assert spark.read.parquet(f"{path}/loadings/ph").count() == 12
        assert spark.read.parquet(f"{path}/mixtures").count() == 32
    assert sum(p.name.startswith(".") and not p.name.endswith(".crc") for p in (tmp_path / "broken/runs").iterdir()) == 0


def test_starts_selections_and_baselines(spark, inputs):
    splits = runner.parts(inputs, runner.merged(runner.DEFAULTS, BASE))
    for change in ({"training": {"start": "nndsvd", "stop_early": True, "every": 1, "patience": 1, "select": "best"}}, {"model": "kl"}, {"roles": 2}, {"input": {"idf": False, "norm": "l1"}, "training": {"metric": "map", "average": 2, "select": "average"}}):
        found = runner.train(spark, inputs, splits, runner.merged(runner.merged(runner.DEFAULTS, BASE), change))
        assert {v: m.count() for v, m in found.loadings.items()} == {"ph": 12, "ps": 8}
        assert found.loadings["ph"].filter("v < 0 OR isnan(v)").count() == 0
    for wrong, text in (({"training": {"start": "other"}}, "start"), ({"weight": {"ph": -1.0}}, "negative"), ({"model": "other"}, "variant")):
        with pytest.raises(ValueError, match=text):
            runner.train(spark, inputs, splits, runner.merged(runner.merged(runner.DEFAULTS, BASE), wrong))


def test_documents_are_replaced_in_one_step(spark, tmp_path):
    path = f"{tmp_path}/deep/er/a.json"
    for value in ({"a": 1}, {"a": [2]}):
        files.write_json(spark, value, path)
        assert json.load(open(path)) == value
    assert [p.name for p in (tmp_path / "deep/er").iterdir() if not p.name.endswith(".crc")] == ["a.json"]
    assert spark.read.json(f"{tmp_path}/deep/er", multiLine=True).select(F.size("a")).first()[0] == 1
