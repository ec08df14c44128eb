"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, decontaminate, jaccard_join, quality_model, suffix_dedup
from tracemill.llm.common import table, written

#: Stages learn, cluster and cut text; DuckDB has no form of that. tests/llm compares each with brute force.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the quality threshold go.

    Null and wordless texts are scored as empty ones; repeated rows and ties are judged alike, a score at the
    threshold stays; without labels of both kinds all stay; an empty table stays empty; further columns stay,
    also those named like the operator's own.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return quality_model.keep_good(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays.

    Rows of the same id are one document and stay or go together; a null id is the smallest. Null, empty and wordless
    texts are nobody's duplicate. An empty table stays empty; further columns stay.
    """
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under runs of 50 words that also start elsewhere are cut out of the texts, every copy of them.

    The width is the stage's own, in words: a passage of 50 words often has less than the 400 bytes of op4.
    Null stays null, texts of fewer words and empty ones stay as they are; repeated rows are each other's repeats;
    an empty table stays empty; further columns stay.
    """
    return _sized(suffix_dedup.drop_repeats(docs))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts.

    Null stays null; repeated rows are cut alike; an empty benchmark cuts nothing, an empty table stays empty;
    further columns stay, also those named like the operator's own.
    """
    return _sized(decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and digests of the ids and of the bytes they decode to.

    Null encodes as an empty text, to no tokens; a row for each row; an empty table gives none; further columns go.
    """
    return bpe.digests(docs, *bpe.multilingual(), ["doc_id", "lang", "source"])


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
