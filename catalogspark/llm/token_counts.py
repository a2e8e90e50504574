"""Token counts of texts under a byte-level BPE vocabulary, by rank-synchronous array merging.

Texts travel to Python in Arrow batches. Pre-tokens of a block of texts are held as one ragged numpy array; in each
round every pre-token applies its lowest-rank pair at all places at once, until no pair is left, and the surviving
symbols are counted (see `byte_pairs`). Pre-tokens that a worker has met are looked up, not merged again.

Defined cases: null and empty texts have 0 tokens; the vocabulary's special strings inside a text are single tokens,
as the library does by default; texts of any length are counted whole (a block grows to hold a longer text); repeated
rows are counted each; no rows give no rows; the results replace input columns of the same name.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.session import ship_package
from catalogspark.llm import byte_pairs

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text that are held as arrays at a time.
BLOCK = 1 << 20


def n_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text. vocabulary: a file of public_tokenizers."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        import numpy as np

        enc = byte_pairs.encoder(byte_pairs.path_of(vocabulary))
        data, offsets = byte_pairs.buffers(texts)
        found = [enc.counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in byte_pairs.blocks(offsets, BLOCK)]
        return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())

    return count(text)


def with_counts(docs: DataFrame, text: str = "text", limit: int = 1024, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit."""
    ship_package(docs.sparkSession)
    counted = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": n_tokens(F.col(text), vocabulary)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op1_token_counts": op1_token_counts}
