"""A training corpus from raw documents: language ID, exact dedup, near dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and reread as the next one's docs.
The first four return the columns of documents, whatever these are; the last returns one row of token digests a document.

Cases: null, empty and letterless texts go in the first stage, with texts whose language is ambiguous; where no document
has a language nothing is learned and only texts without a letter go. Of equal texts, and of near ones, the smallest
doc_id stays, a null doc_id being larger than any other; of equal rows one stays. Columns keep their names and values,
whatever the names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm import bpe, decontam, exactdedup, langid, shingles, simhash
from corroborate.session import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose decoding is ambiguous: the language of the rest is told."""
    return langid.keep_known(spark, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exactdedup.keep_first(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays: fingerprints within 3 bits, or a similarity of 5-word shingles of at least 0.8."""
    return simhash.keep_one(spark, docs, similar=(shingles.WIDTH, shingles.SHARE))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, exact."""
    return docs.select("doc_id", "lang", "source", bpe.digests(spark)(F.col("text")).alias("__t")).select("doc_id", "lang", "source", "__t.*")


STAGES = [("language", known_language), ("exact", exact), ("near", near), ("decontaminate", decontaminated), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
