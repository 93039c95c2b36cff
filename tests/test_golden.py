"""Hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from weftmine.operators import constraints, graph, hypergraph, infer, metrics, mining, neighbours, split, stats, weighting


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def values(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


SCORES = "pid long, item long, score double"
TRUTH = "pid long, item long, val double"


@pytest.fixture(scope="module")
def ranking(spark):
    found = table(spark, SCORES, *((1, i, s) for i, s in enumerate((0.9, 0.8, 0.7, 0.1))))
    return found, table(spark, TRUTH, (1, 0, 1.0), (1, 2, 1.0), (2, 0, 1.0))


def test_ranking_metrics(ranking):
    found, truth = ranking
    assert metrics.average_precision(found, truth).collect() == [(1, pytest.approx(0.833333, abs=1e-6))]
    assert metrics.at_k(found, truth, 2).collect() == [(1, 1, 0.5, 0.5)]
    assert metrics.ndcg(found, truth, 2).first().ndcg == pytest.approx(0.613147, abs=1e-6)
    row = metrics.recommendation(found, truth, (2,)).first()
    assert (row.p_2, row.r_2) == (0.5, 0.5)


def test_empty_metrics_are_zero(spark):
    none = table(spark, SCORES)
    assert metrics.recommendation(none, table(spark, TRUTH), (5,)).first().map == 0.0
    assert metrics.perplexity(none, table(spark, TRUTH), 3).first().ppl == 0.0
    assert constraints.compatible_rate(table(spark, "set_id long, item long"), table(spark, "set_id long, item long"), table(spark, "i long, j long, w double")).first().rate == 1.0


def test_tfidf(spark):
    x = table(spark, TRUTH, (1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0))
    got = values(weighting.tfidf(x), "pid", "item")
    assert got[1, 1]["val"] == pytest.approx(0.579739, abs=1e-6) and got[1, 2]["val"] == pytest.approx(0.814802, abs=1e-6)
    assert got[2, 1]["val"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        weighting.tfidf(x, norm="l3")


def test_laplacians(spark):
    edges = table(spark, "i long, j long, w double", (0, 1, 1.0), (1, 0, 1.0))
    nodes = table(spark, "item long", (0,), (1,), (2,))
    plain = values(graph.laplacian(edges, nodes, "none"), "i", "j")
    assert {k: r["v"] for k, r in plain.items()} == {(0, 0): 1, (1, 1): 1, (0, 1): -1, (1, 0): -1, (2, 2): 0}
    assert {k: r["v"] for k, r in values(graph.laplacian(edges, nodes), "i", "j").items()} == {(0, 0): 1, (1, 1): 1, (0, 1): -1, (1, 0): -1, (2, 2): 1}
    with pytest.raises(ValueError):
        graph.laplacian(edges, nodes, "other")
    hyper = table(spark, "edge long, members array<long>, weight double", (0, [0, 1], 1.0))
    assert {k: r["v"] for k, r in values(hypergraph.laplacian(hyper), "i", "j").items()} == pytest.approx({(0, 0): 0.5, (1, 1): 0.5, (0, 1): -0.5, (1, 0): -0.5})


def test_similarities(spark):
    sets = table(spark, "item long, attr long", (0, 1), (0, 2), (1, 2), (1, 3))
    assert graph.jaccard(sets).first().sim == pytest.approx(1 / 3)
    vectors = table(spark, "id long, vector array<double>", (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]))
    for block in (1, 2, 100):
        got = values(neighbours.vector_neighbours(vectors, 1, block), "i")
        assert (got[0]["j"], got[1]["j"], got[2]["j"], got[3]["j"]) == (1, 0, 1, 0)


def test_conflicts(spark):
    conflict = constraints.conflicts(table(spark, "i long, j long", (2, 0), (5, 5)))
    scores = table(spark, "qid long, item long, score double", (1, 0, 0.9), (1, 1, 0.8))
    selected = table(spark, "qid long, item long", (1, 2))
    assert values(constraints.penalised(scores, selected, conflict), "item")[0]["score"] == pytest.approx(0.4)
    assert [r.item for r in constraints.penalised(scores, selected, conflict, "hard").collect()] == [1]
    with pytest.raises(ValueError):
        constraints.penalised(scores, selected, conflict, "other")
    found = table(spark, SCORES, (1, 0, 0.9), (1, 1, 0.8), (1, 2, 0.7), (1, 3, 0.1))
    one = constraints.conflicts(table(spark, "i long, j long", (0, 1)))
    assert metrics.violations_at_k(found, one, 3).first().rate == pytest.approx(1 / 3)
    chosen = infer.greedy_formula(found, one, 3, 0.75).orderBy("step").collect()
    assert [(r.item, round(r.score, 6)) for r in chosen] == [(0, 0.9), (2, 0.7), (3, 0.1)]
    assert [r.item for r in infer.greedy_formula(found, one, 9, mode="hard").orderBy("step").collect()] == [0, 2, 3]


def test_dirichlet(spark):
    z = table(spark, "pid long, k long, v double", (1, 0, 1.0))
    topics = table(spark, "k long", (0,), (1,))
    assert {r.k: r.v for r in infer.smoothed(z, topics, 0.5).collect()} == {0: 0.75, 1: 0.25}


def test_group_loss(spark):
    edges = table(spark, "edge long, members array<long>, weight double", (0, [0, 1], 1.0))
    h = table(spark, "item long, k long, v double", (0, 0, 0.0), (1, 0, 2.0))
    assert hypergraph.group_loss(edges, h, False).first().loss == 2 and hypergraph.group_loss(edges, h).first().loss == 1
    assert {r.item: r.g for r in hypergraph.group_gradient(edges, h).collect()} == {0: -1.0, 1: 1.0}


def test_splits(spark):
    pids = spark.range(10).withColumnRenamed("id", "pid")
    counts = {r.split: r["count"] for r in split.by_entity(pids).groupBy("split").count().collect()}
    assert counts == {"train": 8, "valid": 1, "test": 1}
    x = table(spark, "pid long, item long", *((p, i) for p in range(40) for i in range(1 + p % 5)))
    rows = split.split(x, "leave_out", k=3).collect()
    assert len(rows) == x.count()
    for p in range(40):
        own = [r for r in rows if r.pid == p]
        n = len(own)
        assert sum(r.hidden for r in own) == (0 if own[0].split == "train" else 3 if n > 3 else n - 1)
    with pytest.raises(ValueError):
        split.split(x, "other")


def test_pairs_and_triples_against_brute_force(spark):
    import random
    from collections import Counter
    from itertools import combinations

    r = random.Random(5)
    sets = {p: sorted(r.sample(range(9), r.randint(0, 6))) for p in range(200)}
    x = table(spark, "pid long, item long", *((p, i) for p, s in sets.items() for i in s))
    for size, got in ((2, mining.frequent_pairs(x, 25)), (3, mining.frequent_triples(x, 12))):
        want = Counter(c for s in sets.values() for c in combinations(s, size))
        assert {tuple(row)[:-1]: row.support for row in got.collect()} == {c: n for c, n in want.items() if n >= (25 if size == 2 else 12)}
    twice = x.union(x.select((F.col("pid") + 1000).alias("pid"), "item"))
    one, two = (values(mining.pmi(t, n), "i", "j") for t, n in ((x, 200), (twice, 400)))
    assert all(two[k]["support"] == 2 * v["support"] and two[k]["pmi"] == pytest.approx(v["pmi"]) for k, v in one.items())


def test_paired_statistics(spark):
    tests = table(spark, "name string, p double", ("a", 0.01), ("b", 0.04), ("c", 0.03))
    assert {r.name: round(r.holm, 6) for r in stats.holm(tests).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    d = table(spark, "delta double", (1.0,), (-2.0,), (3.0,), (0.0,))
    assert stats.rank_biserial(d).first().effect == pytest.approx(1 / 3)


def test_signed_rank_p():
    from weftmine.functions.ranktests import bootstrap_median, signed_rank_p

    assert signed_rank_p([0, 0, 1]) == (0.0, 1.0)
    assert signed_rank_p([1, 2, 3, 4, 5])[1] == pytest.approx(2 / 32)
    w, p = signed_rank_p([1, -2, 3, 4, 5, 6])
    assert (w, p) == (2.0, pytest.approx(6 / 64))
    assert 0 < signed_rank_p([1.0, 1.0, -1.0, 2.0] * 20)[1] < 0.01
    low, high = bootstrap_median(range(100))
    assert low < 49.5 < high and math.isnan(bootstrap_median([])[0])


def test_streamed_counts(spark, tmp_path):
    from weftmine.streaming import item_counts

    rows = spark.range(50).selectExpr("timestamp_seconds(1700000000 + id * 7200) AS ts", "id AS pid", "id % 3 AS item")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = item_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    run.processAllAvailable()
    run.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 50
