"""Rounds of a fit write no rows, and are the same however often rows are stored anew."""

import numpy as np
import pytest

from weftmine.operators import factorize
from weftmine.operators.factorize import Terms


@pytest.mark.parametrize("mode", ["hybrid", "pgd"])
def test_rounds_write_nothing_until_rows_are_stored_anew(spark, monkeypatch, mode):
    cells = {v: spark.createDataFrame([(p, (p * 3 + i * i) % 5, 1.0 + i) for p in range(30) for i in range(2)], "pid long, item int, val double").dropDuplicates(["pid", "item"]) for v in ("ph", "ps", "pd")}
    n = dict.fromkeys(cells, 5)
    state = factorize.start(factorize.rows_of(cells, n), 2)
    terms, h, written = Terms({"ph": 1.0, "ps": 0.5, "pd": 0.3}, l1={"g": 0.01}, normalise=True), factorize.drawn(n, 2), []
    for name in ("cut", "stored"):
        monkeypatch.setattr(factorize, name, lambda df, real=getattr(factorize, name): written.append(1) or real(df))
    once = factorize.fit(state, h, terms, mode, iterations=4, tolerance=0.0)
    assert not written
    monkeypatch.setattr(factorize, "AGAIN", 1)
    anew = factorize.fit(state, h, terms, mode, iterations=4, tolerance=0.0)
    assert len(written) == 3
    for v in n:
        assert once.factors[v] == pytest.approx(anew.factors[v])
    assert [x["total"] for x in once.history] == pytest.approx([x["total"] for x in anew.history])
    g = [np.array([r.g for r in f.state.orderBy("pid").collect()]) for f in (once, anew)]
    assert g[0] == pytest.approx(g[1])
