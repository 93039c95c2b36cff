"""Running maxima, ranks, neighbours across zero, tall factors, starts by roles, held-out items, greedy choices: against plain ones."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmine.operators import factorize, graph, heldout, infer, prefix, split, stats, tallskinny
from weftmine.session import cut


def test_running_maxima_and_average_ranks(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, r.randrange(9) / 2) for i in range(200)] + [("c", 1000, 7.0), ("c", 1001, None)]
    df = spark.createDataFrame(rows, "g string, no int, v double")
    most = {x.no: x.m for x in prefix.running_maxima(df.filter("v IS NOT NULL"), ["g"], ["no"], "v", "m").collect()}
    ranks = {x.no: x.r for x in prefix.average_ranks(df, ["g"], "v", "r").collect()}
    for g, no, v in rows:
        own = [(n, w) for h, n, w in rows if h == g and w is not None]
        if v is None:
            assert no not in ranks
            continue
        assert most[no] == max(w for n, w in own if n <= no)
        assert ranks[no] == sum(w < v for _, w in own) + (sum(w == v for _, w in own) + 1) / 2


def test_no_window_without_partitions(spark):
    tests = spark.createDataFrame([(i, (i * 7 % 13) / 13) for i in range(13)], "id int, p double")
    pairs = spark.createDataFrame([(i, (i * 7 % 13) / 13 - 0.5) for i in range(13)], "id int, delta double")
    for df in (stats.holm(tests), stats.signed_ranks(pairs), stats.correlation(tests, "id", "p")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert all("SinglePartition" not in x or "__part" in plan for x in plan.splitlines()) and "windowspecdefinition(p#" not in plan and "windowspecdefinition(size#" not in plan
    got = [x.holm for x in stats.holm(tests).orderBy("p").collect()]
    want = list(itertools.accumulate((min(1.0, k / 13 * (13 - k)) for k in range(13)), max))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_neighbours_across_zero(spark, k):
    r = random.Random(k)
    rows = [(i, f"a{r.randrange(6)}", r.choice([-1.0, 1.0, 2.0])) for i in range(24) for _ in range(2)]
    rows = list({(i, a): (i, a, v) for i, a, v in rows}.values()) + [(30, "own", 1.0), (31, "zero", 0.0)]
    nodes = spark.createDataFrame([(i,) for i in [*range(24), 30, 31, 40]], "item int")
    got = {}
    for x in graph.feature_neighbours(spark.createDataFrame(rows, "item int, attr string, v double"), k, nodes).collect():
        got.setdefault(x.i, []).append((-x.sim, x.j))
    vectors = {i: {a: v for j, a, v in rows if j == i} for i in [*range(24), 30, 31, 40]}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for i, a in vectors.items():
        alike = []
        for j, b in vectors.items():
            if i != j:
                cos = sum(a[x] * b[x] for x in a if x in b) / (norm(a) * norm(b)) if norm(a) and norm(b) else 0.0
                alike.append((-(round(cos, 9) + 1) / 2, j))
        assert sorted(got[i]) == sorted(alike)[:k]


def test_items_that_look_the_same_are_compared_once(spark, monkeypatch):
    """3,000 items of six looks: 36 pairs of looks at most are made, not nine million of items."""
    made, real = [], graph.cosine
    monkeypatch.setattr(graph, "cosine", lambda *a, **options: made.append(real(*a, **options)) or made[-1])
    rows = spark.range(3000).selectExpr("id AS item", "'a' || id % 6 AS attr", "1.0D AS v").union(spark.range(3000).selectExpr("id", "'all'", "id % 3 - 1.0D"))
    got = graph.feature_neighbours(rows, 5)
    assert made[0].count() <= 36
    found = {(x.i, x.j): x.sim for x in got.collect()}
    assert len(found) == 15000 and {j for i, j in found if i == 7} == {1, 13, 19, 25, 31} and all(sim == pytest.approx(1) for sim in found.values())


def test_leading_values_are_those_of_the_whole(spark):
    r = np.random.default_rng(2)
    x = np.maximum(sum(np.outer(r.normal(size=80), r.normal(size=60)) * 3.0**-j for j in range(6)), 0)
    rows = spark.createDataFrame([(p, i, float(x[p, i])) for p in range(80) for i in range(60) if x[p, i]], "pid long, item int, val double")
    state = factorize.rows_of({"ph": rows}, {"ph": 60})
    h, g = factorize.nndsvd(state, "ph", 60, 4)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    for j in range(1, 4):
        plus, minus = (np.linalg.norm(np.maximum(q * u[:, j], 0)) * np.linalg.norm(np.maximum(q * v[j], 0)) for q in (1, -1))
        q = 1 if plus >= minus else -1
        want = np.sqrt(s[j] * max(plus, minus)) * np.maximum(q * v[j], 0) / np.linalg.norm(np.maximum(q * v[j], 0))
        assert np.allclose(h[:, j], np.maximum(want, 1e-10), atol=1e-6)
    assert np.allclose(h[:, 0], np.sqrt(x.mean())) and g.count() == 80

    # Narrower than the table, so that passes count.
    product = lambda batch, m: x[np.array(batch.column(0).to_pylist())] @ m
    back = lambda batch, y: x[np.array(batch.column(0).to_pylist())].T @ y
    found = tallskinny.leading(spark.range(80).repartition(20), product, back, 60, 3, more=10, passes=6)
    assert np.allclose(found.values, s[:3], rtol=1e-4) and np.allclose(np.abs((found.vectors * v[:3].T).sum(0)), 1, atol=1e-3)


def test_a_start_by_roles_is_the_same_on_any_partitions(spark):
    rows = spark.createDataFrame([(p, [0, 1], [1.0, 1.0], [0.1, 0.2, 0.3]) for p in range(400)], "pid long, ph_i array<int>, ph_v array<double>, g array<double>")
    h = factorize.drawn({"ph": 500, "ps": 5}, 3, 1)
    found = [factorize.by_roles(rows.repartition(n), h, 2, seed=9) for n in (1, 7)]
    one, two = ({x.pid: x.g for x in state.collect()} for state, _ in found)
    assert one == two and all(np.array_equal(found[0][1][v], found[1][1][v]) for v in h)
    wide = found[0][1]["ph"]
    assert wide.shape == (500, 6) and found[0][1]["ps"] is h["ps"]
    raised = wide * 2 / np.hstack([h["ph"]] * 2) - 1  # even on [0, 0.01)
    assert 0 <= raised.min() and raised.max() < 0.01 and abs(raised.mean() - 0.005) < 2e-4 and abs(raised.std() - 0.01 / math.sqrt(12)) < 1e-4
    g = np.array(list(one.values())) * 2 / np.array([0.1, 0.2, 0.3] * 2) - 1
    assert 0 <= g.min() and g.max() < 0.01 and abs(g.mean() - 0.005) < 3e-4 and len(np.unique(g.round(12))) > 2000


@pytest.mark.parametrize(("method", "alpha"), [("nnls", None), ("ols", None), ("nnls", 0.1)])
def test_held_out_items(spark, method, alpha):
    r = random.Random(4)
    x = [(p, f"i{i}", 1.0) for p in range(25) for i in r.sample(range(7), r.randint(1, 6))]
    x += [(3, "strange", 1.0)]
    m = np.array([[r.random() for _ in range(2)] for _ in range(7)])
    h = spark.createDataFrame([(f"i{i}", k, float(m[i, k])) for i in range(7) for k in range(2)], "item string, k int, v double")
    df = spark.createDataFrame(x, "pid long, item string, val double")
    got = {g.seed: (g.n, g.ppl) for g in heldout.heldout_perplexity(df, h, 9, ratio=0.4, seeds=(1, 2), method=method, alpha=alpha).collect()}
    order = {(d.pid, d.item): (d.a, d.b) for d in df.select("pid", "item", split.draw("pid", "item", seed=1).alias("a"), split.draw("pid", "item", seed=2).alias("b")).collect()}
    to = m / (m.sum(0) + 1e-10) if alpha else m
    for s in (0, 1):
        logs = []
        for p in range(25):
            own = sorted((i for q, i, _ in x if q == p), key=lambda i: (order[p, i][s], i))  # noqa: B023
            if len(own) < 2:
                continue
            n = max(1, int(len(own) * 0.4 + 1e-9))
            q = np.array([1.0 if f"i{i}" in own[n:] else 0.0 for i in range(7)])
            if method == "ols":
                z = np.linalg.lstsq(m, q, rcond=None)[0]
            else:  # all sets of topics that may be above 0
                tries = []
                for on in itertools.product([0, 1], repeat=2):
                    z = np.zeros(2)
                    at = [k for k in range(2) if on[k]]
                    if at:
                        z[at] = np.linalg.lstsq(m[:, at], q, rcond=None)[0]
                    if (z >= -1e-12).all():
                        tries.append((np.linalg.norm(m @ z - q), tuple(z)))
                z = np.array(min(tries)[1])
            if alpha:
                z = np.maximum(z, 0) + alpha
                share = np.maximum(z / z.sum() @ to.T, 1e-10)
            else:
                share = np.maximum(z @ to.T, 0) + 1e-10
                share = share / (share.sum() + 2e-10)
            logs += [math.log(1e-10 if i == "strange" else share[int(i[1:])]) for i in own[:n]]
        assert got[s + 1][0] == len(logs) and got[s + 1][1] == pytest.approx(math.exp(-np.mean(logs)), rel=1e-6)


@pytest.mark.parametrize("mode", ["soft", "hard"])
def test_greedy_choice(spark, mode):
    r = random.Random(6)
    found = [(p, f"i{i}", r.choice([0.1, 0.2, 0.5, 0.6, -0.1, 0.0])) for p in range(30) for i in r.sample(range(9), r.randint(1, 9))]
    foes = {(i, j) for i in range(9) for j in range(9) if i < j and r.random() < 0.4}
    conflict = spark.createDataFrame([(f"i{a}", f"i{b}", 1.0) for i, j in foes for a, b in ((i, j), (j, i))], "i string, j string, w double")
    got = {}
    for x in infer.greedy_formula(spark.createDataFrame(found, "pid long, item string, score double"), conflict, 4, 0.15, mode).orderBy("pid", "step").collect():
        got.setdefault(x.pid, []).append((x.step, x.item, x.score))
    for p in range(30):
        left, taken = {i: s for q, i, s in found if q == p}, []
        while left and len(taken) < 4:
            hits = {i: sum((min(int(i[1:]), int(t[1:])), max(int(i[1:]), int(t[1:]))) in foes for _, t, _ in taken) for i in left}
            value = {i: s - 0.15 * hits[i] for i, s in left.items() if mode == "soft" or not hits[i]}
            best = max(value, key=lambda i: (value[i], i), default=None)  # noqa: B023
            if best is None or not value[best] > 0:
                break
            taken.append((len(taken) + 1, best, value[best]))
            left.pop(best)
        assert got.get(p, []) == taken
    assert infer.greedy_formula(spark.createDataFrame([], "pid long, item string, score double"), conflict).count() == 0


def test_shares_by_batches_are_those_of_the_join(spark, monkeypatch):
    r = random.Random(5)
    x = spark.createDataFrame([(p, f"i{i}", float(r.randint(1, 3))) for p in range(20) for i in r.sample(range(6), 3)], "pid long, item string, val double")
    theta = spark.createDataFrame([(p, k, 0.2 + r.random()) for p in range(19) for k in "ab"], "pid long, k string, v double")
    p = spark.createDataFrame([(f"i{i}", k, 0.1 + r.random()) for i in range(5) for k in "ab"], "item string, k string, v double")
    one = {(s.item, s.k): s.v for s in factorize.em_fit(x, theta, p, 2, 0.0).collect()}
    monkeypatch.setattr(factorize, "CELLS", 1)
    two = {(s.item, s.k): s.v for s in factorize.em_fit(x, theta, p, 2, 0.0).collect()}
    assert one == pytest.approx(two) and len(one) == 10


def test_topics_keep_their_first_in_each_task(spark):
    rows = spark.range(20000, numPartitions=4).select(F.col("id").alias("item"), (F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 20011).cast("double").alias("v"))
    df = infer.explained(4, entity=rows)
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    got = {(x.k, x.rank): x.item for x in df.collect()}
    for k in range(3):
        best = sorted(((i * 7919 % 20011, str(i)) for i in range(k, 20000, 3)), reverse=True)[:4]
        assert [got[k, n] for n in range(1, 5)] == [i for _, i in best]


@pytest.mark.parametrize("mode", ["soft", "hard"])
def test_formulas_of_rankings_are_chosen_without_another_exchange(spark, mode, monkeypatch):
    """Scores were dealt out by item and by entity before (finding F10). Conflicts that are too many for the tasks give the same."""
    r = random.Random(5)
    rows = [(p, f"i{i}", r.choice([0.1, 0.2, 0.3, 0.4, -0.1])) for p in range(30) for i in r.sample(range(9), r.randint(1, 9))]
    scores = spark.createDataFrame(rows, "pid long, item string, score double")
    conflict = spark.createDataFrame([(f"i{i}", f"i{(i + 1) % 9}") for i in range(9)], "i string, j string")
    ranked = cut(infer.rankings(scores))
    found = infer.greedy_formula(ranked, conflict, 4, 0.15, mode)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, infer.greedy_formula(scores, conflict, 4, 0.15, mode).collect()))
    monkeypatch.setattr(infer, "CELLS", 8)
    for table in (ranked, scores):
        assert got == sorted(map(tuple, infer.greedy_formula(table, conflict, 4, 0.15, mode).collect()))


def test_held_out_items_are_ordered_in_batches(spark):
    """Orders of items were drawn by interpreted functions of arrays, and items numbered by a join, before (finding F15)."""
    x = spark.createDataFrame([(p, f"i{i}", 1.0) for p in range(9) for i in range(4) if (p + i) % 3], "pid long, item string, val double")
    h = spark.createDataFrame([(f"i{i}", k, 1.0 + i * k) for i in range(4) for k in range(2)], "item string, k int, v double")
    found = heldout.heldout_perplexity(x, h, 4, seeds=(1, 2))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "array_sort" not in plan and "array_position" not in plan
    assert found.count() == 2
