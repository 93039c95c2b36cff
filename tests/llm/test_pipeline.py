from collections import defaultdict

import pytest

import corpus_pipeline
from llm.cases import documents, empty, texts
from weftmine.session import shared_dir


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = texts() + [" ".join(["JUNK!!"] * 40), " ".join(["bad***"] * 30)] * 8
    rows = [t if i % 2 else (t or "") for i, t in enumerate(rows)]
    documents(spark, rows, clash=False).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if t and ("!!" in t or "***" in t) else 1, 0) for i, t in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect_and_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        path = f"{shared_dir(spark)}/test-pipeline-{id(folder)}-{i}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
    quality, near, passages, mixed, packed = seen
    assert not any(r.text and ("!!" in r.text or "***" in r.text) for r in quality) and len(quality) > 30
    ids = [{r.doc_id for r in rows} for rows in seen]
    assert not {40, 41, 42} & ids[1] and len(near) == len(ids[1]) < len(quality)
    assert sum(len(r.text or "") for r in passages) < sum(len(r.text or "") for r in near) and ids[2] <= ids[1]
    assert ids[3] <= ids[2] and len(mixed) > len(ids[3])
    sequences = defaultdict(int)
    for r in packed:
        sequences[r.sequence_id] += r.length
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and max(sequences.values()) <= 4096
    assert ids[4] == ids[3]


def test_run_is_the_stages_in_turn(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def stages(spark, docs, folder, names=None):
    """Each stage's rows, every stage on what the one before wrote."""
    out = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{shared_dir(spark)}/test-stage-{id(docs)}-{i}"
        stage(spark, docs, folder).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs
    return out


def test_null_ids_repeated_rows_and_clashing_columns(spark, folder):
    docs = documents(spark, [t for t in texts() if t] + ["some words of a text that has an id " * 9])
    nothing = docs.limit(1).selectExpr("CAST(NULL AS long) AS doc_id", "'words without any id, and quite a few of them ' AS text", *[f"`{c}`" for c in docs.columns[2:]])
    out = stages(spark, docs.union(docs).union(nothing).union(nothing), folder)
    for name, rows in list(out.items())[:-1]:
        assert rows.columns == docs.columns, name
    near = [r.doc_id for r in out["minhash near-dedup"].collect()]
    assert len([i for i in near if i is not None]) == len({i for i in near if i is not None})
    assert near.count(None) == [r.doc_id for r in out["quality classifier"].collect()].count(None)
    packed = out["best-fit packing"].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in out["source mixing"].collect()}


def test_an_empty_table(spark, folder):
    assert all(rows.isEmpty() for rows in stages(spark, empty(spark), folder).values())


def test_without_labels_nothing_is_accepted(spark, tmp_path):
    documents(spark, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality_filter(spark, documents(spark, clash=False), str(tmp_path)).isEmpty()
