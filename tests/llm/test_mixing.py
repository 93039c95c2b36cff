import re
from collections import Counter

import duckdb
import pytest

from llm.cases import DOCUMENTS, documents, empty, texts
from weftmine.llm import mixing
from weftmine.llm.oracles import OP1


def plain_targets(sizes, weights, share, most):
    """Sources in order with their sizes: water-filling by repeated sharing."""
    wanted, limit = share * sum(sizes), [most * s for s in sizes]
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    got, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = wanted
    while open_:
        total = sum(w[i] for i in open_)
        over = {i for i in open_ if rest * w[i] / total >= limit[i]}
        if not over:
            for i in open_:
                got[i] = rest * w[i] / total
            break
        for i in over:
            got[i] = limit[i]
        rest -= sum(limit[i] for i in over)
        open_ -= over
    return got


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_words_taken(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts())
    assert {r.doc_id: r.size for r in rows} == {i: size(t) for i, t in enumerate(texts())}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, plain_targets([sizes[s] for s in order], (5, 2, 1), 1.5, 2), strict=True))
    for s in order:
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s], abs=1e-5) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in rows)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_and_other_partitions_agree(spark):
    first = sorted(map(tuple, mixing.mix(documents(spark)).collect()), key=str)
    assert first == sorted(map(tuple, mixing.mix(documents(spark).repartition(7)).collect()), key=str)


def test_same_as_sql(spark):
    documents_ = documents(spark, clash=False).toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents_)
    want = sorted(con.sql(OP1).fetchall())
    got = mixing.mix(documents(spark)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == want


def test_the_mix_repeats_rows(spark):
    docs = documents(spark)
    twice = docs.union(docs)
    plan = Counter()
    for r in mixing.mix(twice).collect():
        plan[r.doc_id] += r.copies
    mixed = mixing.mixed(twice)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert Counter(r.doc_id for r in rows) == +plan
    assert all(r.text == texts()[r.doc_id] for r in rows)


def test_empty_tables(spark):
    assert mixing.mix(empty(spark)).collect() == [] == mixing.mixed(empty(spark)).collect()
    none = documents(spark, [None, "", " "])
    assert [(r.size, r.target, r.taken) for r in mixing.mix(none).collect()] == [(0, 0.0, 0)] * 3
    assert mixing.mixed(none).count() == 0


def test_twins_are_taken_alike_in_every_rerun(spark):
    rows = [(1, f"word{i:03d} x", None, "s", 1) for i in range(40)] + [(2, "a b c d e f", None, "t", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    taken = [sorted(r.text for r in mixing.mixed(docs.repartition(n), weights=(3, 1), share=1.4).collect()) for n in (1, 5, 9)]
    assert taken[0] == taken[1] == taken[2] and len(set(taken[0])) < len(taken[0])
