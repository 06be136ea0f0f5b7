"""The queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

import public_tokenizers as tokenizers

from . import bpe, chat, decontaminate, lzprint, oracle, quality, setjoin, sharding, substring, tokencount, urlfilter
from .common import table


def op6_ngram_jaccard_join(spark, sf_dir):
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_substring_dedup(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), within=True)


def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_sharding(spark, sf_dir):
    return sharding.assign(sharding.sized(table(spark, sf_dir, "documents")), 40)


def op3_url_filters(spark, sf_dir):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    return urlfilter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(rules, "host string, path string, action string"))


def op5_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def op7_document_fingerprints(spark, sf_dir):
    return lzprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark, sf_dir):
    return chat.rotate(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op1_substring_dedup": op1_substring_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op8_byte_bpe": op8_byte_bpe,
        "op2_sharding": op2_sharding,
        "op3_url_filters": op3_url_filters,
        "op5_token_counts": op5_token_counts,
        "op7_document_fingerprints": op7_document_fingerprints,
        "op10_chat_formatting": op10_chat_formatting,
    }


def oracle_sql() -> dict:
    return {
        "op3_url_filters": oracle.URL_FILTERS,
        "op6_ngram_jaccard_join": oracle.NGRAM_JACCARD,
        "op9_benchmark_decontamination": oracle.DECONTAMINATION,
        "op10_chat_formatting": chat.ORACLE,
    }
