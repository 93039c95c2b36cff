"""Exact neighbours by cells: against all pairs, and how many pairs bundles of vectors leave."""

import numpy as np
import pytest

from weftmine.operators import neighbours


def plain(ids, x, k):
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    sim = np.round(u @ u.T, 9) + 0.0
    return {i: sorted((-s, j) for j, s in zip(ids, row, strict=True) if j != i)[:k] for i, row in zip(ids, sim, strict=True)}


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "id long, vector array<double>").repartition(3)


@pytest.mark.parametrize("kind", ["bundles", "no structure"])
def test_same_as_all_pairs(spark, kind):
    r = np.random.default_rng(4)
    x = r.normal(size=(12, 16)).repeat(40, 0) + 0.1 * r.normal(size=(480, 16)) if kind == "bundles" else r.normal(size=(300, 16))
    x = np.vstack([x, np.repeat(x[:1], 60, 0), np.zeros((2, 16))])
    ids = r.permutation(len(x)) - 50
    got = {}
    for n in neighbours.vector_neighbours(table(spark, ids, x), 4, 40).collect():
        got.setdefault(n.i, []).append((-n.sim, n.j))
    want = plain(ids.tolist(), x, 4)
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}


def test_bundles_leave_few_pairs(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(24, 32)).repeat(50, 0) + 0.1 * r.normal(size=(1200, 32))
    assert neighbours.visited_share(table(spark, range(1200), x), 5, 50) < 0.25


def test_few_vectors(spark):
    assert neighbours.vector_neighbours(table(spark, [], np.zeros((0, 3))), 2).collect() == []
    assert neighbours.vector_neighbours(table(spark, [7], np.ones((1, 3))), 2).collect() == []
    assert [tuple(r) for r in neighbours.vector_neighbours(table(spark, [7, 2], np.ones((2, 3))), 2).orderBy("i").collect()] == [(2, 7, 1.0), (7, 2, 1.0)]


def test_bounds_hold():
    r = np.random.default_rng(1)
    x = neighbours.unit(r.normal(size=(200, 5)))
    centres = neighbours.fitted(x, 6)
    cell = (x @ centres.T).argmax(1)
    angle = np.arccos(np.clip((x * centres[cell]).sum(1), -1, 1))
    low, high = (np.array([f(angle[cell == c]) for c in range(6)]) for f in (min, max))
    most = neighbours.Cells(centres, low, high).most(x)
    for c in range(6):
        assert (most[:, c] >= (x @ x[cell == c].T).max(1) - 1e-9).all()


def test_blocks_meet_once(spark):
    """Two blocks met twice, once for each that asked (finding F5)."""
    r = np.random.default_rng(9)
    _, looked, pairs, _, _ = neighbours.open_pairs(table(spark, range(400), r.normal(size=(400, 16))), 3, 40)
    left, right = neighbours.meetings(looked, pairs)
    of = lambda df: {(x.a_cell, x.a_block, x.cell, x.block) for x in df.select("a_cell", "a_block", "cell", "block").distinct().collect()}
    met, wanted = of(left), of(pairs)
    assert met == of(right) and {frozenset((m[:2], m[2:])) for m in met} == {frozenset((m[:2], m[2:])) for m in wanted}
    assert len(met) == len({frozenset((m[:2], m[2:])) for m in met}) < len(wanted)


def test_what_moves_grows_as_vectors_do():
    """Blocks of one size met in pairs that grow with the square (finding F5)."""
    assert [neighbours.block_of(n, 64) for n in (1000, 48_000, 100_000, 10_000_000)] == [2048, 2048, 4167, 16384]
    assert neighbours.block_of(100_000, 4096) == 256


def test_slices_of_best(monkeypatch):
    r = np.random.default_rng(2)
    x = neighbours.unit(np.vstack([r.normal(size=(50, 4)), np.repeat(r.normal(size=(1, 4)), 30, 0)]))
    ids = np.arange(80)
    whole = neighbours.best(ids, x, ids, x, 4)
    monkeypatch.setattr(neighbours, "SLICE", 100)
    assert all(np.array_equal(a, b) for a, b in zip(whole, neighbours.best(ids, x, ids, x, 4), strict=True))
    assert {i: [j for a, j in zip(whole[0], whole[1], strict=True) if a == i] for i in ids.tolist()} == {i: [j for _, j in v] for i, v in plain(ids.tolist(), x, 4).items()}
