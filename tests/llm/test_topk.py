import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmine.llm import topk

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def plain(rows, every, k):
    """Brute force with Python's integers."""
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in usable]
    out = []
    for at, (q, a) in enumerate(whole):
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for j, (i, b) in enumerate(whole) if j != at and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def rows(n=300, dim=20, seed=1):
    r = np.random.default_rng(seed)
    made = [(i, [float(np.float32(x)) for x in r.normal(size=dim)]) for i in range(n)]
    same = made[5][1]
    made += [(n + i, same) for i in range(25)] + [(7, made[7][1]), (10, made[10][1])]
    made += [(1000, None), (1010, [None] * dim), (1020, [math.nan] * dim), (1030, [math.inf] * dim), (None, same), (1040, same[:7]), (1041, same[:7]), (1050, []), (1060, [0.0] * dim)]
    return made


@pytest.mark.parametrize("block", [40, 16384])
def test_same_as_brute_force(spark, block):
    data = rows()
    vectors = spark.createDataFrame([(i, v, 0, "x") for i, v in data], VECTORS)
    got = topk.top_k(vectors, F.col("id") % 10 == 0, 10, block=block)
    assert sorted(map(tuple, got.collect())) == plain(data, 10, 10)


def test_blocks_meet_in_any_number_of_tasks(spark):
    """Without small tasks joined into one: a query's row in one block and its candidates in another are dealt to the same task."""
    data = rows(200)
    vectors = spark.createDataFrame([(i, v, 0, "x") for i, v in data], VECTORS)
    coalesce, parts = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = {c: spark.conf.get(c) for c in (coalesce, parts)}
    try:
        spark.conf.set(coalesce, "false")
        spark.conf.set(parts, "7")
        got = topk.top_k(vectors, F.col("id") % 10 == 0, 10, block=40)
        assert sorted(map(tuple, got.collect())) == plain(data, 10, 10)
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def test_bounds_hold_and_leave_less_to_compute():
    r = np.random.default_rng(2)
    x = r.integers(-1000, 1000, (50, 64)).astype(float)
    exact = x @ x.T
    before = None
    for level in topk.levels_of(64):
        m, d, sizes = topk.statistics(x, level)
        bound = (m * sizes) @ m.T + d @ d.T
        assert (bound >= exact - 1e-6).all()
        assert before is None or bound.sum() < before
        before = bound.sum()


def test_most_pairs_of_the_table_are_ruled_out():
    """On the table's own vectors, of which no level but the finest rules anything out."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    x = np.floor(1024 * np.array(pq.read_table(path).column("embedding").to_pylist(), float))
    left = total = 0
    finest = topk.levels_of(x.shape[1])[-1]
    m, d, sizes = topk.statistics(x, finest)
    for q in range(0, len(x), 100):
        scores = np.delete(x @ x[q], q)
        bound = np.delete((m * sizes) @ m[q] + d @ d[q], q)
        assert (bound >= scores - 1e-3).all()
        left, total = left + (bound >= np.sort(scores)[-10]).sum(), total + len(scores)
    assert left / total < 0.55


def test_levels_that_rule_nothing_out_go_and_results_stay(monkeypatch):
    r = np.random.default_rng(8)
    x = r.integers(-500, 500, (300, 64))
    ids = np.arange(300)
    asked = []
    real = topk.statistics
    monkeypatch.setattr(topk, "statistics", lambda *a: asked.append(a[1]) or real(*a))
    got = topk.search(ids[:60], x[:60], np.full(60, -np.inf), ids, ids, x, 5)
    want = [(q, i) for q in range(60) for _, i in sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:5]]
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want and set(asked) == {1, 4, 16, 32}


def test_blocks_far_from_all_queries_stay_where_they_are(spark, monkeypatch):
    """Vectors in bundles: a query's results lie in its own bundle, and most pairs of blocks are never brought together."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, 32)) * 3
    data = [(i, [float(np.float32(x)) for x in centres[i % 12] + r.normal(size=32) * 0.05]) for i in range(600)]
    vectors = spark.createDataFrame([(i, v, 0, "x") for i, v in data], VECTORS)
    seen, real = [], topk._may_reach

    def counted():
        seen.append(1)
        return real()

    cuts, real_cut = [], topk.cut
    monkeypatch.setattr(topk, "_may_reach", counted)
    monkeypatch.setattr(topk, "cut", lambda df: cuts.append(real_cut(df)) or cuts[-1])
    got = topk.top_k(vectors, F.col("id") % 5 == 0, 10, block=25)  # queries in blocks of 6
    assert sorted(map(tuple, got.collect())) == plain(data, 5, 10)
    pairs = next(df for df in cuts if df.columns == ["a", "b", "n"])
    assert seen and pairs.count() < 0.5 * 24 * 20


def test_large_components():
    ids = np.arange(40)
    x = np.random.default_rng(3).integers(-(2**29), 2**29, (40, 3))
    got = topk.search(ids[:4], x[:4], np.full(4, -np.inf), ids, ids, x, 5)
    want = [(q, i) for q in range(4) for _, i in sorted((-sum(int(a) * int(b) for a, b in zip(x[q], x[i], strict=True)), i) for i in range(40) if i != q)[:5]]
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("id") % 10 == 0).collect() == []
