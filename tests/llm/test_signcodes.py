"""One-bit codes: estimates within their spread, distances exact, nearest found against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmine.llm import signcodes

FORM = "vec_id long, embedding array<float>, label int, row string"


def plain(rows, every, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for at, (q, a) in enumerate(usable):
        if q % every == 0:
            found = sorted((float(np.sqrt(((b - a) ** 2).sum())), i) for j, (i, b) in enumerate(usable) if j != at and len(a) == len(b))
            out.setdefault(q, []).append(found[:k])
    return out


def rows(n=900, dim=48, seed=1, spread=1.0):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(6, dim)) * spread
    made = [(i, [float(np.float32(c)) for c in middles[i % 6] + r.normal(size=dim)]) for i in range(n)]
    same = made[7][1]
    made += [(n + i, same) for i in range(300)]
    made += [(5000, None), (5010, [None] * dim), (5020, [math.nan] * dim), (5030, [math.inf] * dim), (None, same), (5040, same[:5]), (5041, same[1:6]), (5050, []), (5060, [0.0] * dim), (5070, [2.0]), (5071, [-1.0])]
    return made


@pytest.mark.parametrize(("block", "asked", "spread"), [(8192, 2048, 1.0), (100, 20, 1.0), (100, 20, 30.0)])
def test_nearest_found(spark, monkeypatch, block, asked, spread):
    monkeypatch.setattr(signcodes, "BLOCK", block)
    monkeypatch.setattr(signcodes, "ASKED", asked)
    data = rows(spread=spread)
    vectors = spark.createDataFrame([(i, v, 0, "x") for i, v in data], FORM).repartition(5)
    got = signcodes.neighbours(vectors, F.col("id") % 10 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in sorted(got.collect()):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id, r["rank"]))
    want = plain(data, 10, 10)
    # Queries with a partner at all, and no others.
    assert set(found) == {q for q, (w,) in want.items() if w}
    hits = total = 0
    for q, (w,) in want.items():
        mine = found.get(q, [])
        assert [r for _, _, r in mine] == list(range(1, len(w) + 1))
        assert [(s, i) for s, i, _ in mine] == sorted((s, i) for s, i, _ in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in w})
        total += len(w)
        near = dict((i, s) for s, i in w)
        assert all(abs(near[i] - s) < 1e-12 for s, i, _ in mine if i in near)
    assert hits / total >= 0.97, hits / total


def test_estimates_stay_within_their_spread():
    r = np.random.default_rng(5)
    x, centre = r.normal(size=(4000, 96)), r.normal(size=96) / 5
    codes = signcodes.coded(x, centre)
    inside = []
    for q in r.normal(size=(20, 96)):
        exact = ((x - q) ** 2).sum(1)
        guess, least = signcodes.nearest_possible(q, centre, codes)
        inside.append((least <= exact + 1e-9).mean())
        assert abs((guess - exact).mean()) < 0.05 * exact.mean()  # no lean to either side
        assert np.corrcoef(guess, exact)[0, 1] > 0.5
    assert np.mean(inside) > 0.985


def test_vectors_at_the_centre_and_short_ones():
    x = np.array([[1.0, 2.0], [1.0, 2.0], [4.0, 6.0]])
    codes = signcodes.coded(x, x[0])
    for q, want in (([1.0, 2.0], [0, 0, 25]), ([4.0, 6.0], [25, 25, 0])):
        _, least = signcodes.nearest_possible(np.array(q), x[0], codes)
        assert (least <= np.array(want) + 1e-9).all() and abs(least[0] - want[0]) < 1e-9


def test_codes_rule_most_out():
    """On directions without any structure, as the table's, under a quarter is compared exactly."""
    r = np.random.default_rng(3)
    x = r.normal(size=(8000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    codes = signcodes.coded(x, x.mean(0))
    left = []
    for q in x[:20]:
        _, least = signcodes.nearest_possible(q, x.mean(0), codes)
        left.append((least <= np.sort(((x - q) ** 2).sum(1))[10]).mean())
    assert np.mean(left) < 0.25


def test_empty(spark):
    assert signcodes.neighbours(spark.createDataFrame([], FORM), F.col("id") % 10 == 0).count() == 0
    none = spark.createDataFrame([(1, [1.0, 2.0], 0, "x"), (2, [1.0, 2.5], 0, "x")], FORM)
    assert signcodes.neighbours(none, F.col("id") % 10 == 0).count() == 0
