"""From raw documents to packed training sequences, in five stages that are each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return
the columns of `documents`; the last returns pieces of sequences with their token ids.

Defined cases: null, empty and short texts fail the quality rules and go there, so the later stages see none of them, but
would keep them; null doc_id, lang and source are values of their own; repeated rows are near copies of each other and
one stays; a text of any length is treated whole; no rows give no rows; extra columns pass through up to the mixture, under
any names, since a document's columns travel in a struct.
"""

from pyspark.sql import DataFrame, SparkSession

from catalogspark.functions.session import written
from catalogspark.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup

#: Near copies: word shingles of five words, similarity 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the production policy."""
    return quality_rules.keep_passing(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies."""
    return ngram_join.keep_one(docs, n=SHINGLE_WORDS, num=SIMILARITY[0], den=SIMILARITY[1])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that start more than once in the corpus; n_chars counts what is left."""
    return suffix_dedup.keep_unrepeated(docs, length="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the production mixture, once for each epoch that reads them."""
    return mixing.keep_mixture(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [("quality_rules", quality), ("ngram_jaccard", near_copies), ("suffix_dedup", repeats), ("mixing", mixture), ("packing", sequences)]
#: Byte-level repeats and packing are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
