"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes and gives any columns besides doc_id and text, in their order, and an empty table gives an empty one. Null
and empty texts are scored like any other; they have no shingles, sentences or benchmark words, so the later stages keep
them, and they encode to no tokens. Null ids are ids like others, but rows without one are never dropped as copies of each
other. Rows equal in doc_id and text share their decision; what ties decide is said at each stage. Long texts are processed
whole."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm import bpe, decontaminate, quality, setjoin, substring
from weft.llm.common import checkpoint, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: those whose score is below its threshold. Every row of a labelled
    doc_id is an example, of several labels the greatest counts; with less than two examples of a class nothing goes."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join stays: the one with the smallest doc_id, one row of it where
    several have that id. Documents without words are in no component with others and stay."""
    return setjoin.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated spans go from all places but the first, in other documents and in the same one, where 25 words in
    a row at least are repeated; the first place has the least (doc_id, hash of the text, position), null ids first. n_chars
    follows the text; a document may be left with an empty text, never without its row."""
    return substring.cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go: a whole window of 8 words of an item, or windows of two items. An empty
    benchmark or one of null texts drops nothing."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every document, their number, and digests of them and of
    their decoding."""
    return bpe.encode(docs.select("doc_id", "text"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN).drop("text")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in turn to documents; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
