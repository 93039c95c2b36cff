"""Products of rows, bundles, free text, families of tests, and the baselines by name."""

import random

import pytest

from weftmine.operators import baselines, hypergraph, infer, linalg, metrics, mining, stats


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("cells", [10**6, 0])
def test_products_of_rows_are_those_of_the_join(spark, monkeypatch, cells):
    monkeypatch.setattr(linalg, "CELLS", cells)
    r = random.Random(3)
    a = table(spark, [(i, k, r.random()) for i in range(40) for k in "abcdx" if r.random() < 0.5], "pid long, k string, v double")
    b = table(spark, [(k, f"i{j}", r.random()) for k in "abcdy" for j in range(6) if r.random() < 0.6], "k string, item string, v double")
    plain = {(x.pid, x.item): x.v for x in linalg.product(a, b, "pid", "k", "item").collect()}
    got = {(x.pid, x.item): x.v for x in linalg.product_of_rows(a, b, "pid", "k", "item").collect()}
    assert got == pytest.approx(plain) and len(got) == len(plain) > 50
    none = table(spark, [], "k string, item string, v double")
    assert linalg.product_of_rows(a, none, "pid", "k", "item").collect() == []


def test_bundles(spark):
    one = table(spark, [("e", ["a", "b"], 1.0)], "edge string, members array<string>, weight double")
    two = table(spark, [("f", ["b", "c"], 1.0)], "edge string, members array<string>, weight double")
    got = {(r.i, r.j): r.v for r in hypergraph.bundle([(2.0, one), (0.5, two)]).collect()}
    assert got == pytest.approx({("a", "a"): 1.0, ("a", "b"): -1.0, ("b", "a"): -1.0, ("b", "b"): 1.25, ("b", "c"): -0.25, ("c", "b"): -0.25, ("c", "c"): 0.25})
    assert hypergraph.bundle([(0.0, one), (0.0, two)]).collect() == []
    assert sorted(r.edge for r in hypergraph.together(x=one, y=two).collect()) == ["x:e", "y:f"]


def test_a_triple_whose_neighbours_are_not_neighbours_of_each_other(spark):
    similar = [("a", "b", 0.95), ("a", "c", 0.94), ("b", "a", 0.95), ("c", "a", 0.94)]
    near = table(spark, similar, "i string, j string, sim double")
    every = table(spark, [*similar, ("b", "c", 0.9), ("c", "b", 0.9)], "i string, j string, sim double")
    got = {tuple(r.members): r.score for r in hypergraph.by_attributes(near, every, 0.92, 10).collect()}
    assert got == pytest.approx({("a", "b"): 0.95, ("a", "c"): 0.94, ("a", "b", "c"): 0.93})


def test_a_case_in_words(spark):
    lines = table(spark, [(1, "Cold, chill ; strange\nthirst"), (2, None)], "pid long, text string")
    names = table(spark, [("s0", "Cold"), ("s1", "thirst")], "item string, name string")
    alias = table(spark, [("chill", "Cold")], "alias string, canonical string")
    queries, rest = infer.from_text(lines, names, alias)
    assert sorted((r.pid, r.item) for r in queries.collect()) == [(1, "s0"), (1, "s1")]
    assert list(map(tuple, rest.collect())) == [(1, "strange")]
    by = table(spark, [("s0", 0, 1.0), ("s1", 1, 1.0)], "item string, k int, v double")
    to = table(spark, [("h0", 0, 2.0), ("h1", 1, 3.0), ("h1", 0, 0.5)], "item string, k int, v double")
    assert [(r.item, r.score) for r in infer.case(lines, names, alias, by, to, 5, "dot").orderBy("rank").collect()] == [("h1", 3.5), ("h0", 2.0)]


def test_families(spark):
    r = random.Random(1)
    rows = [(v, s, r.random() + (0.5 if v == "full" else 0.0), r.random() + (11 if v == "full" else 0), None if s == 3 else 1.0) for v in ("full", "less", "none") for s in range(12)]
    results = table(spark, rows, "variant string, seed int, map double, ppl double, b double")
    pairs = [*stats.against("full", ["less", "none"], {"map": (True, 0.01), "b": (True, 0.01)}, "one"), ("two", "less", "full", "ppl", False, 1.0), ("two", "full", "none", "ppl", False, 1.0), ("two", "full", "missing", "ppl", False, 1.0)]
    got = {(x.family, x.a, x.b, x.metric): x for x in stats.family_tests(results, table(spark, pairs, stats.COMPARISON)).collect()}
    assert len(got) == 6
    assert got["one", "full", "less", "map"].verdict == got["one", "full", "none", "map"].verdict == "better" and got["one", "full", "less", "map"].n == 12
    same = got["one", "full", "less", "b"]
    assert same.verdict == "not significant, negligible" and same.n == 11 and same.effect == 0 and same.p == 1 and same.nonzero == 0
    # Less perplexity is better, whichever side has it.
    assert got["two", "less", "full", "ppl"].verdict == "better" and got["two", "full", "none", "ppl"].verdict == "worse" and got["two", "less", "full", "ppl"].median > 10
    # Corrected over the family's four tests, not those of one metric.
    p = sorted(x.p for k, x in got.items() if k[0] == "one")
    assert got["one", "full", "less", "map"].holm in (pytest.approx(4 * p[0]), pytest.approx(max(4 * p[0], 3 * p[1])))
    for nothing in (lambda: stats.families(), lambda: hypergraph.bundle([]), lambda: hypergraph.together()):
        with pytest.raises(ValueError, match="given"):
            nothing()
    both = stats.families(one=results, two=results.drop("b"))
    assert both.count() == 72 and both.filter("family = 'two' AND b IS NULL").count() == 36
    assert {x.variant for x in stats.renamed(results, "variant", {"full": "all"}).collect()} == {"all", "less", "none"}
    summary = table(spark, [("x", 2.0), ("y", 3.0)], "value string, m double")
    assert {x.value: x.percent for x in stats.change(summary, "value", "m", "x").collect()} == {"x": 0.0, "y": 50.0}


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError, match="variant"):
        baselines.run("other", None, {}, 2)


def test_item_pairs_without_a_join(spark):
    """A table of entities whose files are small is not broadcast to meet itself."""
    x = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (2, "a"), (None, "a"), (None, "b"), (3, "b"), (3, None)], "pid long, item string")
    pairs = mining.item_pairs(x)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == [(1, "a", "b"), (1, "a", "c"), (1, "b", "c")]


@pytest.mark.parametrize("cells", [10**6, 0])
def test_rankings_give_what_scores_give_and_are_never_dealt_out(spark, monkeypatch, cells):
    monkeypatch.setattr(linalg, "CELLS", cells)
    r = random.Random(3)
    queries = spark.createDataFrame([(p, i, 1.0) for p in range(40) for i in r.sample(range(8), 3)] + [(90, 77, 1.0)], "pid long, item int, val double")
    by = spark.createDataFrame([(i, f"t{k}", r.randrange(3) / 4) for i in range(8) for k in range(3) if r.random() < 0.7], "item int, k string, v double")
    to = spark.createDataFrame([(f"b{i}", f"t{k}", r.randrange(3) / 4) for i in range(9) for k in range(3) if r.random() < 0.7], "item string, k string, v double")
    truth = spark.createDataFrame([(p, f"b{i}", float(i + 1)) for p in range(5, 60) for i in r.sample(range(12), 4)], "pid long, item string, val double")
    foes = spark.createDataFrame([("b1", "b2", 1.0), ("b2", "b1", 1.0), ("b3", "b7", 1.0)], "i string, j string, w double")
    long, rows = infer.scores(infer.by_dot(queries, by), to), infer.ranking(queries, by, to)
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(infer.ranked(rows, 4)) == plain(infer.ranked(long, 4).select("pid", "item", "score", "rank"))
    for f in (lambda x: metrics.at_k(x, truth, 3), lambda x: metrics.average_precision(x, truth), lambda x: metrics.ndcg(x, truth, 3), lambda x: metrics.violations_at_k(x, foes, 4)):
        for a, b in zip(plain(f(rows)), plain(f(long)), strict=True):
            assert a == pytest.approx(b)
    assert tuple(metrics.recommendation(rows, truth, (2, 4)).first()) == pytest.approx(tuple(metrics.recommendation(long, truth, (2, 4)).first()))
    plan = metrics.recommendation(rows, truth)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and (cells == 0 or plan.count("MapInArrow") == 2)
