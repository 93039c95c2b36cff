"""The queries of this subpackage: for each operator, production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmine.llm import gif, htmltext, licenses, mixing, neardup, packing, quality, signcodes, suffixdedup, topk, turntrie, urlfilter, whitening
from weftmine.session import prepare, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.store(table(spark, sf_dir, "documents")))


def op4_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer())


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(table(spark, sf_dir, "documents"))


def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op9_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.trie(turntrie.spliced(turntrie.sequences(table(spark, sf_dir, "conversations"))))


def op12_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op13_sign_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signcodes.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = [op1_mix_sources, op2_license_scan, op3_gif, op4_min_max_hash, op5_best_two_fit, op6_suffix_dedup, op7_html_blocks, op8_attention_quality, op9_segment_search, op10_url_filter, op11_turn_trie, op12_tsqr_whitening, op13_sign_codes, pipeline]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(f):
        return lambda spark, sf_dir: f(prepare(spark), sf_dir)

    return {f.__name__: ready(f) for f in QUERIES}
