"""The queries of this subpackage, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import _work as W
from tessera.llm import align, audit, decontam, html_text, minhash, ngram_join, packing, quality, secrets, substring, suffix, urls, warc


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(W.pages(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(W.documents(spark, sf_dir)).drop("kept")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = W.documents(spark, sf_dir)
    rules = quality.train(docs, W.labels(spark, sf_dir))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(W.documents(spark, sf_dir), k=2)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(W.documents(spark, sf_dir), keep=False).drop("kept")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(W.pages(spark, sf_dir))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(W.documents(spark, sf_dir, "doc_id", "text")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(W.pages(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(W.documents(spark, sf_dir), W.benchmark(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(W.documents(spark, sf_dir))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_digest(W.documents(spark, sf_dir))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(W.documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(W.documents(spark, sf_dir), W.labels(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_substring_dedup,
        op3_quality_rules,
        op4_minhash_near_dedup,
        op5_suffix_array_dedup,
        op6_html_extraction,
        op7_secret_scans,
        op8_warc,
        op9_benchmark_decontamination,
        op10_best_fit_packing,
        op11_cross_tokenizer_alignment,
        op12_ngram_jaccard_join,
        op13_filter_audit,
    )
}

ORACLES = {"op1_url_filters": urls.ORACLE_SQL, "op8_warc": warc.ORACLE_SQL, "op13_filter_audit": audit.ORACLE_SQL}
