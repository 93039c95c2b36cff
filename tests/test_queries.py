"""Every query with SQL against it, at the smallest size."""

import glob
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry_point

DATA = "/root/testdata/sf0.001"
ORACLES = entry_point.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows, columns):
    """Columns by name, and rows in an order that doesn't hang on the last digits of numbers."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cells, key=lambda r: ([repr(x) for x in r if not isinstance(x, float)], [x for x in r if isinstance(x, float)]))


def same(got, want):
    """Equal but for numbers that are rounded to six digits: a sum in another order may round the other way."""
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1.0, abs(x))), (a, b)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    got = entry_point.queries()[name](spark, DATA)
    want = con.sql(ORACLES[name])
    same(plain([tuple(r) for r in got.collect()], got.columns), plain(want.fetchall(), want.columns))


def test_corr_regr_takes_all_groups(spark, con):
    """Months with the dearest orders among them."""
    groups = "SELECT count(*) AS size, round(avg(o_totalprice), 2) AS metric FROM orders WHERE o_totalprice IS NOT NULL GROUP BY o_orderpriority, year(o_orderdate), month(o_orderdate)"
    ((most, *want),) = con.sql(f"SELECT max(metric), corr(size, metric), regr_slope(metric, size), regr_intercept(metric, size) FROM ({groups})").fetchall()
    assert most >= 160000
    got = entry_point.queries()["corr_regr"](spark, DATA).first()
    assert (got.pearson, got.slope, got.intercept) == pytest.approx(want, rel=1e-4, abs=2e-5)


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", ["recommend_nnls", "recommend_ols", "heldout_ppl", "wilcoxon_p", "family_bounds", "nmf_fit", "pgd_fit", "hybrid_fit", "em_fit", "nndsvd_init"])
def test_others_give_rows(spark, name):
    assert entry_point.queries()[name](spark, DATA).count() > 0


def test_flagship(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: (-r.support, r.i, r.j))


def test_the_rest_stands_without_the_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n == "weftmine.llm" or n.startswith("weftmine.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "weftmine.llm", None)
    names = set(entry_point.queries())
    assert "frequent_pairs" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry_point.oracle_sql()) <= names


def test_a_broken_subpackage_is_not_hidden(monkeypatch):
    package = pytest.importorskip("weftmine.llm")
    monkeypatch.setitem(sys.modules, "weftmine.llm.mixing", None)
    monkeypatch.delattr(package, "mixing", raising=False)
    for name in ("weftmine.llm.queries", "weftmine.llm.oracles"):
        monkeypatch.delitem(sys.modules, name, raising=False)
    with pytest.raises(ImportError):
        entry_point.queries()
