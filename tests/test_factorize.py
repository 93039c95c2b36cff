import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmine.functions.nnls import nnls, nnls_rows
from weftmine.operators import baselines, factorize, heldout, infer, linalg
from weftmine.operators.factorize import Terms


def world(spark, p=60, n=8, m=6, k=3, seed=0):
    r = np.random.default_rng(seed)
    g = r.random((p, k)) * (r.random((p, k)) < 0.6)
    x = {"ph": g @ r.random((n, k)).T, "ps": g @ r.random((m, k)).T}
    x = {v: np.where(a > 0.3, a, 0) for v, a in x.items()}
    x["pd"] = np.where(x["ph"] > 0, r.random((p, n)), 0)
    tables = {v: spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "pid long, item int, val double") for v, a in x.items()}
    sizes = {v: a.shape[1] for v, a in x.items()}
    return x, tables, sizes


def all_terms(n, m, roles=1):
    r = np.random.default_rng(3)
    a = r.random((n, n)) < 0.3
    a = np.triu(a, 1) + np.triu(a, 1).T
    lap = np.diag(a.sum(1)) - a.astype(float)
    edges = (r.random((4, n)) < 0.5).astype(float)
    edges[:, 0] = 1
    return Terms({"ph": 1.0, "ps": 0.7, "pd": 0.4}, {"ph": (0.2, lap)}, {"g": 0.02, "ph": 0.03, "ps": 0.01}, (0.1, a.astype(float)), (0.3, np.eye(n, m)), (0.05, edges, np.ones(4), True), roles, 0.05 if roles > 1 else 0.0)


def g_of(state, p):
    out = np.zeros((p, len(state.first().g)))
    for row in state.select("pid", "g").collect():
        out[row.pid] = row.g
    return out


def plain_loss(x, g, h, t):
    """The loss from whole matrices."""
    fold = lambda m: m.reshape(len(m), t.roles, -1).sum(1)
    total = t.weight["ph"] * ((x["ph"] - g @ h["ph"].T) ** 2).sum() + t.weight["ps"] * ((x["ps"] - fold(g) @ h["ps"].T) ** 2).sum()
    total += t.weight["pd"] * (((x["pd"] - fold(g) @ h["pd"].T) * (x["pd"] > 0)) ** 2).sum()
    total += t.laplacian["ph"][0] * np.trace(h["ph"].T @ t.laplacian["ph"][1] @ h["ph"])
    total += t.l1["g"] * g.sum() + t.l1["ph"] * h["ph"].sum() + t.l1["ps"] * h["ps"].sum()
    total += t.conflict[0] * np.trace(h["ph"].T @ t.conflict[1] @ h["ph"]) + t.knowledge[0] * ((t.knowledge[1] - fold(h["ph"]) @ h["ps"].T) ** 2).sum()
    for e, w in zip(t.groups[1], t.groups[2], strict=True):
        own = h["ph"][e > 0]
        total += t.groups[0] * w * ((own - own.mean(0)) ** 2).sum() / len(own)
    blocks = np.split(h["ph"], t.roles, axis=1)
    return total + t.exclusive * sum((a * b).sum() for i, a in enumerate(blocks) for b in blocks[:i])


@pytest.mark.parametrize("roles", [1, 2])
def test_sums_give_the_loss_and_its_gradient(spark, roles):
    x, tables, sizes = world(spark)
    t = all_terms(8, 6, roles)
    state = factorize.start(factorize.rows_of(tables, sizes), 3 * roles)
    p = len(x["ph"])
    h = factorize.drawn(sizes, 3, 1, roles)
    g = g_of(state, p)
    live = np.array([any(x[v][i].any() for v in x) for i in range(p)])
    g[~live] = 0
    s = factorize.sums(state, sizes)
    assert factorize.loss(h, s, t)["total"] == pytest.approx(plain_loss(x, g, h, t))
    for view in h:
        up, down = factorize.pulls(view, h, s, t)
        assert (up >= 0).all() and (down >= 0).all()
        for i, k in ((0, 0), (3, 2), (5, 1)):
            more, less = ({**h, view: h[view] + d * (np.arange(h[view].size).reshape(h[view].shape) == i * h[view].shape[1] + k)} for d in (1e-5, -1e-5))
            assert 2 * (down - up)[i, k] == pytest.approx((plain_loss(x, g, more, t) - plain_loss(x, g, less, t)) / 2e-5, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize(("mode", "roles"), [("mur", 1), ("mur", 2), ("pgd", 1), ("hybrid", 1)])
def test_the_loss_falls(spark, mode, roles):
    _, tables, sizes = world(spark)
    state = factorize.start(factorize.rows_of(tables, sizes), 3 * roles)
    found = factorize.fit(state, factorize.drawn(sizes, 3, 1, roles), all_terms(8, 6, roles), mode, iterations=8, rate=2e-3)
    totals = [x["total"] for x in found.history]
    assert all(b <= a * (1 + 1e-9) for a, b in zip(totals, totals[1:], strict=False)) and totals[-1] < totals[0]
    assert all((m >= 0).all() for m in found.factors.values())


def test_single_steps_agree_with_long_tables(spark):
    x, tables, sizes = world(spark)
    one = {"ph": tables["ph"]}
    state = factorize.start(factorize.rows_of(one, sizes), 3)
    h = {"ph": factorize.drawn({"ph": 8}, 3)["ph"]}
    long_g = state.select("pid", F.posexplode("g").alias("k", "v"))
    long_h = spark.createDataFrame([(i, k, float(h["ph"][i, k])) for i in range(8) for k in range(3)], "item int, k int, v double")
    new, h_new, _, _ = factorize.step(state, h, Terms({"ph": 1.0}))
    g2, h2 = factorize.multiplicative_step(tables["ph"], long_g, long_h)
    assert {(r.item, r.k): pytest.approx(r.v) for r in h2.collect()} == {(i, k): h_new["ph"][i, k] for i in range(8) for k in range(3)}
    got = {(r.pid, k): v for r in new.select("pid", "g").collect() for k, v in enumerate(r.g)}
    assert {(r.pid, r.k): pytest.approx(r.v) for r in g2.collect()} == got
    moved = factorize.moved(state, h, Terms({"ph": 1.0}, l1={"g": 0.1}), "pgd", 0.01)
    g3 = factorize.gradient_step(tables["ph"], long_g, long_h, 0.01, 0.1)
    assert {(r.pid, r.k): pytest.approx(r.v) for r in g3.collect()} == {(r.pid, k): v for r in moved.select("pid", "g").collect() for k, v in enumerate(r.g)}


def test_normalised_columns_leave_the_model(spark):
    _, tables, sizes = world(spark)
    t = Terms({"ph": 1.0, "ps": 1.0, "pd": 0.5}, normalise=True)
    state = factorize.start(factorize.rows_of(tables, sizes), 3)
    found = factorize.fit(state, factorize.drawn(sizes, 3), t, iterations=4)
    assert np.linalg.norm(found.factors["ph"], axis=0) == pytest.approx(1)
    s = factorize.sums(found.state, sizes)
    assert factorize.loss(found.factors, s, t)["total"] == pytest.approx(found.history[-1]["total"])


def test_training_phases(spark):
    _, tables, sizes = world(spark)
    state = factorize.start(factorize.rows_of(tables, sizes), 3)
    seen = []
    found = factorize.fit(state, factorize.drawn(sizes, 3), all_terms(8, 6), iterations=9, pretrain=2, warm_up=2, evaluate=lambda h: seen.append(1) or -len(seen), every=1, patience=3, select="best")
    assert set(found.history[0]) == {"ph", "ps", "pd", "total"} and "conflict" in found.history[2] and len(found.history) == 4
    with pytest.raises(ValueError):
        factorize.fit(state, factorize.drawn(sizes, 3), Terms(), iterations=1, select="other")
    s = factorize.sums(found.state, sizes)
    better = {**found.factors, "ps": factorize.refined("ps", found.factors, s, all_terms(8, 6))}
    assert factorize.loss(better, s, all_terms(8, 6))["total"] <= factorize.loss(found.factors, s, all_terms(8, 6))["total"]


def test_singular_vector_start(spark):
    x, tables, sizes = world(spark)
    rows = factorize.rows_of({"ph": tables["ph"]}, sizes)
    h, g = factorize.nndsvd(rows, "ph", 8, 3)
    kept = x["ph"][x["ph"].any(1)]
    u, s, v = np.linalg.svd(kept, full_matrices=False)
    assert (h >= 0).all() and h[:, 0] == pytest.approx(np.sqrt(kept.mean()))
    for j in (1, 2):
        half = max((a for a in (1, -1)), key=lambda a: np.linalg.norm(np.maximum(a * u[:, j], 0)) * np.linalg.norm(np.maximum(a * v[j], 0)))
        up, vp = np.maximum(half * u[:, j], 0), np.maximum(half * v[j], 0)
        want = np.sqrt(s[j] * np.linalg.norm(up) * np.linalg.norm(vp)) * vp / np.linalg.norm(vp)
        assert h[:, j] == pytest.approx(np.maximum(want, 1e-10), abs=1e-8)
    assert all(sum(r.g) == pytest.approx(1) for r in g.collect())


def test_expectation_maximisation(spark):
    x, tables, sizes = world(spark)
    r = np.random.default_rng(1)
    theta, p = r.dirichlet(np.ones(3), len(x["ph"])), r.dirichlet(np.ones(8), 3).T
    lt = spark.createDataFrame([(i, k, float(theta[i, k])) for i in range(len(theta)) for k in range(3)], "pid long, k int, v double")
    lp = spark.createDataFrame([(i, k, float(p[i, k])) for i in range(8) for k in range(3)], "item int, k int, v double")
    want = p.copy()
    for _ in range(3):
        new = np.zeros_like(want)
        for i, j in zip(*np.nonzero(x["ph"]), strict=True):
            part = theta[i] * want[j]
            new[j] += x["ph"][i, j] * part / part.sum()
        want = new / new.sum(0)
    got = {(row.item, row.k): row.v for row in factorize.em_fit(tables["ph"], lt, lp, 3, 0).collect()}
    assert got == {(i, k): pytest.approx(want[i, k]) for i in range(8) for k in range(3) if want[i, k] > 0}


def test_non_negative_least_squares():
    r = np.random.default_rng(2)
    for n in (1, 3, 8, 20):
        for _ in range(30):
            a, b = r.normal(size=(25, n)), r.normal(size=25)
            if r.random() < 0.3 and n > 1:
                a[:, 1] = a[:, 0]
            z = nnls(a.T @ a, a.T @ b)
            slope = a.T @ (a @ z - b)
            assert (z >= 0).all() and (slope > -1e-6).all() and np.abs(slope[z > 1e-9]).max(initial=0) < 1e-6


def test_inference_methods(spark):
    r = np.random.default_rng(4)
    h, q = r.random((7, 3)), r.random((5, 7))
    lh = spark.createDataFrame([(i, k, float(h[i, k])) for i in range(7) for k in range(3)], "item int, k int, v double")
    lq = spark.createDataFrame([(p, i, float(q[p, i])) for p in range(5) for i in range(7)], "pid long, item int, val double")
    want = {"dot": q @ h, "ols": q @ np.linalg.pinv(h).T, "nnls": np.array([nnls(h.T @ h, h.T @ x) for x in q])}
    for method, z in want.items():
        assert {(x.pid, x.k): pytest.approx(x.v, abs=1e-8) for x in infer.infer(lq, lh, method).collect()} == {(p, k): z[p, k] for p in range(5) for k in range(3)}
    with pytest.raises(ValueError):
        infer.infer(lq, lh, "other")


def test_baselines(spark):
    x, tables, sizes = world(spark)
    two = {v: sizes[v] for v in ("ph", "ps")}
    rows = factorize.rows_of({v: tables[v] for v in two}, two)
    edges = spark.createDataFrame([(i, (i + 1) % 60, 1.0) for i in range(60)] + [((i + 1) % 60, i, 1.0) for i in range(60)], "i long, j long, w double")
    for found in (baselines.joint(rows, two, 3, l1=0.01, iterations=6), baselines.kl(rows, two, 3, iterations=6), baselines.graph_regularised(rows, two, edges, 3, iterations=4), baselines.semi(rows, two, 3, iterations=6)):
        assert found.history[-1]["total"] < found.history[0]["total"]
        assert all((np.array(r.g) >= 0).all() for r in found.state.select("g").collect())
    for kind in ("none", "cosine", "procrustes"):
        mixtures, h = baselines.independent(rows, two, 3, kind=kind, merge="geo" if kind == "none" else "avg", iterations=3)
        assert mixtures.count() == rows.count() and (h["ps"] >= 0).all()


def test_least_squares_of_many_rows_at_once():
    r = np.random.default_rng(8)
    for n, alike in ((1, False), (6, False), (9, True), (20, False)):
        m = np.abs(r.normal(size=(25, n)))
        if alike:
            m[:, 1] = m[:, 0]
        targets = np.vstack([(r.random((200, 25)) < 0.2) @ m, np.zeros((1, n)), -np.ones((1, n))])
        got = nnls_rows(m.T @ m, targets)
        assert np.abs(got - np.array([nnls(m.T @ m, t) for t in targets])).max() < 1e-9


@pytest.mark.parametrize("method", ["nnls", "ols"])
def test_mixtures_are_solved_where_an_entity_s_items_are(spark, method):
    """One exchange by entity: mixtures and scores were dealt out again before (findings F9, F21)."""
    q = spark.createDataFrame([(p, i, 1.0) for p in range(9) for i in range(3) if (p + i) % 3], "pid long, item int, val double")
    h = spark.createDataFrame([(i, k, 1.0 + i * k) for i in range(3) for k in range(2)], "item int, k int, v double")
    found = infer.ranking(q, h, h, method)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    want = {(x.pid, x.item): (x.score, x.rank) for x in infer.ranked(infer.scores(infer.infer(q, h, method), h)).collect()}
    assert {(x.pid, x.item): (x.score, x.rank) for x in infer.ranked(found).collect()} == want and len(want) == 27


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_steps_are_made_where_an_entity_s_items_are(spark, monkeypatch):
    """Mixtures met items and loadings by joins before (findings F12, F17). The joins, for larger loadings, give the same."""
    x, tables, _ = world(spark)
    long_h = spark.createDataFrame([(i, k, 0.1 + i * k % 5) for i in range(8) for k in range(3) if (i + k) % 4], "item int, k int, v double")
    rows = linalg.product_of_rows(tables["ph"].select("pid", "item", F.col("val").alias("v")), long_h, "pid", "item", "k", whole=True, keep=True)
    assert exchanges(factorize.gradient_step(None, rows, long_h, 0.01, 0.1)) == 1
    values = lambda df, key: {(r[key], r.k): r.v for r in df.collect()}
    g = rows.select("pid", F.explode("__cells").alias("c")).select("pid", "c.*")
    found = []
    for cells in (linalg.CELLS, 3):
        monkeypatch.setattr(linalg, "CELLS", cells)
        for args in ((None, rows), (tables["ph"], g)):
            new = factorize.multiplicative_step(*args, long_h)
            found.append((values(factorize.gradient_step(*args, long_h, 0.01, 0.1), "pid"), values(new[0], "pid"), values(new[1], "item")))
    for other in found[1:]:
        for a, b in zip(found[0], other, strict=True):
            assert len(a) > 9 and a == {k: pytest.approx(v) for k, v in b.items()}


def test_shares_by_whole_mixtures(spark):
    """Mixtures stay whole rows from inference to the rounds (finding F11)."""
    x, tables, _ = world(spark)
    h = spark.createDataFrame([(i, k, 0.1 + i * k % 5) for i in range(8) for k in range(3) if (i + k) % 4], "item int, k int, v double")
    whole = infer.smoothed(infer.infer(tables["ph"], h, whole=True), h, 0.1)
    assert exchanges(whole) == 1
    long = infer.smoothed(infer.infer(tables["ph"], h), h, 0.1)
    one, two = ({(r.item, r.k): r.v for r in factorize.em_fit(tables["ph"], theta, h, 3, 0.0).collect()} for theta in (whole, long))
    assert len(one) > 9 and one == {k: pytest.approx(v) for k, v in two.items()}


@pytest.mark.parametrize("alpha", [None, 0.1])
@pytest.mark.parametrize("topics", [None, 2])
def test_predictions_of_another_view_in_one_pass(spark, monkeypatch, alpha, topics):
    """Mixtures and scores were long tables that met the true items by joins before (finding F18)."""
    x, tables, _ = world(spark)
    truth = tables["ps"].union(spark.createDataFrame([(1, 77, 1.0), (999, 1, 1.0)], "pid long, item int, val double"))
    by = spark.createDataFrame([(i, k, 0.1 + i * k % 5) for i in range(7) for k in range(4)], "item int, k int, v double")
    to = spark.createDataFrame([(i, k, 0.2 + i * k % 3) for i in range(5) for k in range(topics or 4)], "item int, k int, v double")
    one = heldout.predictive_perplexity(tables["ph"], truth, by, to, 8, method="dot", alpha=alpha, topics=topics)
    assert exchanges(one) == 2
    one = one.first().ppl
    monkeypatch.setattr(linalg, "CELLS", 3)
    assert one > 1 and one == pytest.approx(heldout.predictive_perplexity(tables["ph"], truth, by, to, 8, method="dot", alpha=alpha, topics=topics).first().ppl, rel=1e-6)


def test_groups_are_graphs_without_pairs(spark):
    """Every two orders of a customer were a row before (finding F7)."""
    x, tables, sizes = world(spark)
    two = {v: sizes[v] for v in ("ph", "ps")}
    rows = factorize.rows_of({v: tables[v] for v in two}, two)
    pids = sorted(r.pid for r in rows.select("pid").collect())
    group = {p: p % 7 if p % 11 else None for p in pids} | {1000 + i: i for i in range(8)}  # entities without a group, without rows, alone
    group[pids[-1]] = 99
    groups = spark.createDataFrame([(p, c, 0.5) for p, c in group.items()], "pid long, group long, w double")
    edges = spark.createDataFrame([(i, j, 0.5) for i in pids for j in pids if i != j and group[i] is not None and group[i] == group[j]], "i long, j long, w double")
    one, many = (baselines.graph_regularised(rows, two, links, 3, weight=0.3, iterations=2) for links in (groups, edges))
    assert all(np.allclose(one.factors[v], many.factors[v], rtol=1e-9, atol=1e-12) for v in two)
    assert {r.pid: pytest.approx(r.g) for r in one.state.collect()} == {r.pid: r.g for r in many.state.collect()}
    hot = spark.createDataFrame([(p, 1, 0.5) for p in pids], "pid long, group long, w double")
    assert baselines.neighbours_in_groups(one.state, hot, 3).count() == len(pids)
