"""Where each captured field comes from, carried from version to version; and bytes of files as text."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.operators.titles import LEGACY

# What a field's flag says of its source; a field without flag was typed.
SOURCES = {"sugerido": "ai", "imagen": "vision", "extraido": "ai", "confirmado": "ai-confirmed"}
TYPED = "manual"


def field_provenance(products: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """(product_id, field, source, evidence, original, normalized, updated_at) of the fields of products (product_id, v, ai).

    The first original and its evidence stay; the time is kept while source and value are what they were. Fields that a product
    no longer has are gone. previous has these columns for the version before, once for each product and field.
    """
    names = F.create_map(*[F.lit(x) for pair in SOURCES.items() for x in pair])
    flags = F.coalesce("ai", F.create_map().cast("map<string,string>"))
    each = products.select("product_id", flags.alias("ai"), F.explode("v").alias("field", "value"))
    each = each.select("product_id", "field", F.coalesce("value", F.lit("")).alias("value"), F.coalesce(names[F.element_at("ai", F.col("field"))], F.lit(TYPED)).alias("source"))
    old = previous.select("product_id", "field", *[F.col(c).alias(f"old_{c}") for c in ("source", "evidence", "original", "normalized", "updated_at")])
    both = each.join(old, ["product_id", "field"], "left")
    same = (F.col("old_source") == F.col("source")) & (F.col("old_normalized") == F.col("value"))
    return both.select(
        "product_id", "field", "source", F.coalesce("old_evidence", F.lit("")).alias("evidence"), F.coalesce("old_original", "value").alias("original"), T.tidy(F.col("value")).alias("normalized"),
        F.when(same, F.coalesce("old_updated_at", now)).otherwise(now).alias("updated_at"),
    )


def decoded_text(content: Column) -> Column:
    """(text, charset) of bytes: UTF-8 where they are strictly that, else Windows-1252; a mark of byte order in front goes."""
    legacy = F.translate(F.decode(content, "ISO-8859-1"), "".join(LEGACY.values()), "".join(LEGACY))
    valid = F.is_valid_utf8(content.cast("string"))
    text = F.when(valid, F.regexp_replace(content.cast("string"), "^﻿", "")).otherwise(legacy)
    return F.struct(text.alias("text"), F.when(valid, "utf-8").otherwise("windows-1252").alias("charset"))


def read_texts(spark: SparkSession, path) -> DataFrame:
    """(path, text, charset) of whole files, each in its own charset; the source leaves out files without bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decoded_text(F.col("content")).alias("t")).select("path", "t.*")
