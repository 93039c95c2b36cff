"""Whitening against eigenvectors of a covariance formed in full."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmine.llm import whitening

FORM = "vec_id long, embedding array<float>, label int, whitened string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], FORM).repartition(parts)


def plain(rows, k=4):
    """vec_id, component: n, deviation, whitened, explained, from the covariance of the distinct vectors of each length."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for length in {len(v) for _, v in usable} - {0}:
        own = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in usable if len(v) == length]
        fit = np.array(sorted({x for _, x in own}), dtype=object)
        n, s = len(fit), fit.sum(0)
        centred = ((n * fit - s) / n).astype(float)
        e, u = np.linalg.eigh(centred.T @ centred / n)
        order = np.argsort(-e)
        for i, x in own:
            y = n * np.array(x, object) - s
            for c, at in enumerate(order[:k], 1):
                out.append((i, c, n, int((y * y).sum()), float((y / n).astype(float) @ u[:, at]) / math.sqrt(e[at]), float(e[at] / e.sum())))
    return out


def rows(n=400, dim=9, seed=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) * np.arange(1, dim + 1) / 3 @ np.linalg.qr(r.normal(size=(dim, dim)))[0] + 5
    made = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    made += [(1000 + i, made[3][1]) for i in range(150)] + [(3, made[3][1]), (None, made[4][1])]
    made += [(2000, None), (2001, [None] * dim), (2002, [math.nan] * dim), (2003, [math.inf] + [0.0] * (dim - 1)), (2004, [])]
    made += [(3000 + i, [float(c) for c in v]) for i, v in enumerate(r.normal(size=(30, 2)))]
    return made


@pytest.mark.parametrize("parts", [1, 40])
def test_same_as_full_covariance(spark, parts):
    data = rows()
    got = whitening.components(frame(spark, data, parts), 4).collect()
    want = plain(data)
    key = lambda r: (repr(r[0]), r[1], r[3])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    signs: dict = {}
    for g, w in zip(got, want, strict=True):
        assert abs(g[5] - w[5]) <= 1e-9 * w[5]
        sign = signs.setdefault((g[1], g[2]), math.copysign(1, g[4] * w[4]))  # one for all rows of a component
        assert abs(g[4] - sign * w[4]) < 1e-8
    assert max(r[6] for r in got) < 1e-9


def test_far_from_zero_and_large(spark):
    """Where sums of squares of uncentred numbers would lose all digits, and where whole numbers need more than 64 bits."""
    r = np.random.default_rng(1)
    data = [(i, [float(np.float32(2.0**20 + c)) for c in v]) for i, v in enumerate(r.integers(0, 50, (200, 3)))]
    got = whitening.components(frame(spark, data), 3).collect()
    want = {(w[0], w[1]): w for w in plain(data, 3)}
    assert all(abs(abs(g.whitened) - abs(want[g.vec_id, g.component][4])) < 1e-7 and g.deviation == want[g.vec_id, g.component][3] for g in got)
    big = [(i, [float(2.0**52 * (i + 1)), 1.0]) for i in range(4)]
    assert {r.deviation for r in whitening.components(frame(spark, big), 2).collect()} == {whitening.LIMIT}


def test_directions_without_variance(spark):
    one = whitening.components(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])]), 4).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(i, c, 1, 0, 0.0, 0.0, 1.0) for i in (1, 2) for c in (1, 2)]


def test_empty(spark):
    assert whitening.components(frame(spark, [])).count() == 0
    assert whitening.components(frame(spark, [(1, None), (2, [])])).count() == 0


def test_triangles_merge_to_the_whole():
    r = np.random.default_rng(0)
    x = r.normal(size=(100, 5))
    merged = whitening.triangle([whitening.triangle([part]) for part in np.array_split(x, 7)])
    assert np.allclose(np.abs(merged), np.abs(np.linalg.qr(x, mode="r")))


def test_transform_carries_columns(spark):
    df = frame(spark, rows(50))
    out = whitening.transform(df, whitening.fit(df))
    assert out.columns == [*df.columns, "whitening"]
    assert out.filter(F.size("embedding") == 9).agg(F.min(F.size("whitening.whitened"))).first()[0] == 9
