import math
import random
import zlib

import numpy as np
import pytest

from llm.cases import DOCUMENTS, documents, empty, texts
from weftmine.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=700, seed=11):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeñé") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 400))]
        good = r.random() < 0.7
        if not good:
            kind = r.randrange(3)
            words = [w + "***" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [words[0]] * len(words)
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = documents(spark, [t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], LABELS)
    got = {r.doc_id: r for r in quality.score(docs, quality.learn(docs, labels)).collect()}
    assert len(got) == len(rows)
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert {i for i in got if got[i].held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == y for r, y in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_labels_of_held_out_documents_are_not_read(spark):
    rows = corpus(200)
    docs = documents(spark, [t for _, t, _ in rows])
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y
    one = quality.learn(docs, spark.createDataFrame([(i, y, 0) for i, _, y in rows], LABELS))
    two = quality.learn(docs, spark.createDataFrame([(i, flip(i, y), 1) for i, _, y in rows], LABELS))
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))


def bags(seed, n):
    r = np.random.default_rng(seed)
    begins = np.concatenate([[0], np.cumsum(r.integers(1, 6, n))])
    x = r.normal(size=(begins[-1], quality.FEATURES))
    y = np.array([(x[a:b, 3] > 1).any() for a, b in zip(begins[:-1], begins[1:], strict=True)], float)
    return x, begins, y


def plain_score(m, bag):
    """Attention over one document's passages, passage by passage."""
    encodings, raw = [], []
    for row in bag:
        z = [min(8, max(-8, (v - a) / b)) for v, a, b in zip(row, m.mean, m.scale, strict=True)]
        h = [math.tanh(sum(v * w for v, w in zip([*z, 1], column, strict=True))) for column in m.encode.T]
        gated = [math.tanh(np.dot(h, t)) / (1 + math.exp(-np.dot(h, g))) for t, g in zip(m.tanh.T, m.gate.T, strict=True)]
        encodings.append(h)
        raw.append(math.exp(sum(v * w for v, w in zip(gated, m.attend, strict=True))))
    whole = [sum(w * h[i] for w, h in zip(raw, encodings, strict=True)) / sum(raw) for i in range(len(m.out))]
    return 1 / (1 + math.exp(-(sum(v * w for v, w in zip(whole, m.out, strict=True)) + m.bias[0])))


def some_model(seed=1):
    r = np.random.default_rng(seed)
    shapes = [(quality.FEATURES + 1, 5), (5, 4), (5, 4), (4,), (5,), (1,)]
    return quality.Model(r.normal(size=quality.FEATURES), np.abs(r.normal(size=quality.FEATURES)) + 0.5, *(r.normal(size=s) * 0.4 for s in shapes))


def test_scores_are_those_of_the_formula():
    m, (x, begins, _) = some_model(), bags(3, 20)
    got = m.attended(m.encoded(x)[1], begins)[0]
    assert got == pytest.approx([plain_score(m, x[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)])


def test_gradients_are_the_numerical_ones():
    m, (x, begins, y) = some_model(2), bags(4, 12)

    def loss(model):
        s = model.attended(model.encoded(x)[1], begins)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, grad in zip(m._fields[2:], m.gradients(x, begins, y), strict=True):
        weights = getattr(m, name)
        for at in list(np.ndindex(weights.shape))[:: max(1, weights.size // 25)]:
            step = np.zeros_like(weights)
            step[at] = 1e-5
            numeric = (loss(m._replace(**{name: weights + step})) - loss(m._replace(**{name: weights - step}))) / 2e-5
            assert grad[at] == pytest.approx(numeric, abs=1e-6), (name, at)


def test_training_fits_bags():
    x, begins, y = bags(0, 120)
    model = quality.train(x.astype(np.float32), begins, y.astype(np.float32), epochs=150)
    assert np.mean((model.attended(model.encoded(x.astype(np.float32))[1], begins)[0] > 0.5) == y) > 0.95


def test_passages_are_encoded_alike_however_many_at_a_time(monkeypatch):
    data = [t.encode() for t in ["", "word " * 4000, "x", "é, " * 999]]
    data, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    m = some_model(3)
    want = m.score(data, offsets)
    monkeypatch.setattr(quality, "STEP", 7)
    assert m.score(data, offsets) == pytest.approx(want, abs=1e-12)


def auc(scored):
    good, bad = ([s for s, y in scored if y == k] for k in (1, 0))
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_held_out_labels_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id: r.quality for r in labels.filter("quality IS NOT NULL").collect()}
    got = quality.score(docs, quality.learn(docs, labels)).filter("held_out").collect()
    assert auc([(r.score, want[r.doc_id]) for r in got if r.doc_id in want]) > 0.93


def test_repeated_labelled_rows_are_learnt_once(spark):
    rows = corpus(60)
    docs = documents(spark, [t for _, t, _ in rows], clash=False)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], LABELS)
    one, two = quality.learn(docs, labels), quality.learn(docs.union(docs).union(docs), labels.union(labels))
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))


def test_passages_cover_whole_texts():
    rows = ["", "a", "b" * 511, "é" * 5000, "word " * 40000, None or ""]
    data = [t.encode() for t in rows]
    x, begins = quality.passages(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert np.diff(begins).tolist() == [1, 1, 1, 20, 391, 1]
    lengths = np.round(np.expm1(x[:, -2].astype(float)))
    assert [lengths[a:b].sum() for a, b in zip(begins[:-1], begins[1:], strict=True)] == pytest.approx([*map(len, data)], abs=3)


def test_nulls_and_no_labels(spark):
    none = spark.createDataFrame([], LABELS)
    model = quality.learn(documents(spark), none)
    rows = quality.score(documents(spark), model).collect()
    assert len(rows) == len(texts()) and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 0, 0), (3, None, 0)], LABELS)
    assert {r.predicted for r in quality.score(documents(spark), quality.learn(documents(spark), one)).collect()} == {1}
    assert quality.score(empty(spark), model).collect() == []
    docs = spark.createDataFrame([(None, None, None, None, None)], DOCUMENTS)
    assert [r.held_out for r in quality.score(docs, model).collect()] == [False]


def test_the_filter_keeps_what_is_predicted(spark):
    rows = corpus(200)
    docs = documents(spark, [t for _, t, _ in rows])
    model = quality.learn(docs, spark.createDataFrame([(i, y, 0) for i, _, y in rows], LABELS))
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
