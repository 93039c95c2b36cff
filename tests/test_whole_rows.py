"""What is made where an entity's items are gives what long tables do, and views are made once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmine.operators import infer, metrics, split, weighting
from weftmine.operators.gather import gathered
from weftmine.plans import experiments, runner
from weftmine.session import BATCH_ROWS


@pytest.fixture(scope="module")
def views(spark):
    ph = spark.createDataFrame([(p, f"h{(p * 7 + i * i) % 6}", 1.0 + i) for p in range(40) for i in range(3)], "pid long, item string, val double").dropDuplicates(["pid", "item"])
    ps = spark.createDataFrame([(p, (p + i) % 4, 1.0) for p in range(2, 41) for i in range(2)], "pid long, item int, val double")
    return {"ph": ph, "ps": ps}


def test_entities_go_on_across_batches(spark, views):
    views = {**views, "pd": spark.createDataFrame([(7, f"h{i:02}", float(i)) for i in range(30)], "pid long, item string, val double")}
    want = {(v, r.pid, r.item, r.val) for v, x in views.items() for r in x.collect()}
    before = spark.conf.get(BATCH_ROWS)
    for rows in (1, 3, 1000):
        spark.conf.set(BATCH_ROWS, str(rows))
        try:
            found = gathered(views).collect()
        finally:
            spark.conf.set(BATCH_ROWS, before)
        assert [r.pid for r in sorted(found)] == list(range(41))
        assert {(v, r.pid, c.item, c.val) for r in found for v in views for c in r[v]} == want
        assert all([c.item for c in r.ph] == sorted(c.item for c in r.ph) for r in found)


def test_splits_are_those_of_the_drawn_order(spark):
    pids = spark.range(500).select(F.col("id").alias("pid"))
    order = [r.pid for r in pids.orderBy(split.draw("pid", seed=5), "pid").collect()]
    for train, valid in ((0.8, 0.1), (0.333, 0.333), (1.0, 0.0), (0.0, 0.0), (0.0, 1.0)):
        found = split.by_entity(pids, train=train, valid=valid, seed=5)
        a, b = int(500 * train), int(500 * train) + int(500 * valid)
        assert {r.pid: r.split for r in found.collect()} == {p: "train" if i < a else "valid" if i < b else "test" for i, p in enumerate(order)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert split.by_entity(pids.limit(0)).count() == 0


@pytest.mark.parametrize("chosen", [{}, {"norm": "l1", "smooth": False}, {"sublinear": True, "norm": "none"}, {"idf": False}])
def test_weights_are_those_of_long_tables(spark, views, chosen):
    inputs = runner.Inputs(views)
    config = runner.merged(runner.DEFAULTS, {"input": chosen})
    splits = runner.parts(inputs, config)
    own = splits.filter("split = 'train'").select("pid")
    at = {v: runner.numbered_items(x) for v, x in views.items()}
    rows = runner.weighted(inputs, splits, config, at, runner.frequencies(spark, inputs, splits)).collect()
    for view, x in views.items():
        x, c = x.join(own, "pid", "left_semi"), config["input"]
        long = weighting.tfidf(x, smooth=c["smooth"], sublinear=c["sublinear"], norm=c["norm"]) if c["idf"] else x.join(weighting.row_norm(x), "pid").select("pid", "item", (F.col("val") / F.col("norm")).alias("val"))
        want = {(r.pid, at[view][r.item]): r.val for r in long.collect()}
        assert {(r.pid, i): v for r in rows for i, v in zip(r[f"{view}_i"], r[f"{view}_v"], strict=True)} == pytest.approx(want)


def test_rankings_are_judged_where_their_truth_is(spark, views):
    inputs = runner.ready(runner.Inputs(views))
    config = runner.merged(runner.DEFAULTS, {"inference": {"method": "nnls", "without_idf": False}, "evaluate": {"part": "train", "ks": [2]}})
    splits = runner.parts(inputs, config)
    r = np.random.default_rng(1)
    loadings = {v: spark.createDataFrame([(i, k, float(r.random())) for i in runner.numbered_items(x) for k in range(2)], f"item {dict(x.dtypes)['item']}, k int, v double") for v, x in views.items()}
    found = runner.measured(spark, inputs, splits, loadings, config)
    own = splits.filter("split = 'train'").select("pid")
    herbs, symptoms = (views[v].join(own, "pid", "left_semi") for v in ("ph", "ps"))
    for name, source, truth, by, to in (("sym2herb", symptoms, herbs, "ps", "ph"), ("herb2sym", herbs, symptoms, "ph", "ps")):
        want = metrics.recommendation(infer.scores(infer.infer(source, loadings[by], "nnls"), loadings[to]), truth, (2,)).first().asDict()
        assert {c: found[f"{name}_{c}"] for c in want} == pytest.approx(want)


def test_runs_make_their_views_once(spark, views, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    n = sum(x.count() for x in views.values())
    inputs = runner.Inputs({v: x.mapInArrow(counted, x.schema) for v, x in views.items()})
    base = {"k": 2, "training": {"iterations": 2}, "inference": {"method": "dot"}, "evaluate": {"ks": [2]}}
    stages = [c for c in experiments.ablation(base, [1], [2]) if c["stage"] in ("full", "views_only")]
    assert runner.run_all(spark, inputs, stages, str(tmp_path)).count() > 0
    assert seen.value == n
