"""Connected components against union-find, in one task and in rounds."""

import random

import pytest

from weftmine.operators import components as module


def plain(edges):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize(("few", "chunk"), [(module.CHUNK, module.CHUNK), (0, 5)])
def test_same_as_union_find(spark, monkeypatch, few, chunk):
    r = random.Random(3)
    edges = [(i, r.randrange(i)) for i in range(1, 60)]  # a tree
    edges += [(1000 + i, 1000 + (i + 1)) for i in range(80)] + [(2000, 2000 + i) for i in range(1, 50)]  # a path, a star
    edges += [(5, 5), (9999, 9999), (3, 4), (4, 3), (-7, 3000), (None, 1), (2, None)]
    r.shuffle(edges)
    monkeypatch.setattr(module, "CHUNK", chunk)
    got = module.components(spark.createDataFrame(edges, "a long, b long").repartition(6), few=few).collect()
    assert len(got) == len({x.node for x in got})
    assert {x.node: x.component for x in got} == plain(edges)


def test_without_edges(spark):
    assert module.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
