"""A training-data pipeline: quality filter, near-dedup, repeated-passage removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents; run() writes each
result as Parquet into the shared folder and reads it back as the next stage's docs. Earlier stages' tables go once the next one's is written.

Defined results: an empty table gives no rows from any stage; without labels every score is 0.5 and the quality filter keeps nothing; rows with a null doc_id
are documents of their own and pass all stages; a null or empty text is scored like any other, has no copies, loses no bytes and is packed as the end
token alone; of rows that share a doc_id near-dedup keeps one; other columns than doc_id, text, source and n_chars are carried along,
whatever their names. n_chars, where there is one, counts anew what passage dedup leaves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftmine.session import dropped_folder, prepare, shared_dir, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled documents of sf_dir that are not held out."""
    from weftmine.llm import quality

    model = quality.learn(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    from weftmine.llm import neardup

    prepare(spark)
    return neardup.keep(docs, k=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that strings of 200 bytes found elsewhere cover."""
    from weftmine.llm import suffixdedup

    prepare(spark)
    return suffixdedup.keep(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it."""
    from weftmine.llm import mixing

    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096."""
    from weftmine.llm import packing
    from weftmine.llm.queries import tokenizer

    prepare(spark)
    return packing.packed(docs, tokenizer())


STAGES = [
    ("quality classifier", quality_filter),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("source mixing", source_mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            dropped_folder(spark, f"{folder}/{i - 1}")
    return docs


#: SQL can't express tokenizing, training or packing.
ORACLE_SQL = None
