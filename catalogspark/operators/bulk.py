"""Bulk edits with preview and exact undo, and suggestions grouped by what they change."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.operators.schema import category_fields


def preview(products: DataFrame, selected: DataFrame, field: str, value: str) -> DataFrame:
    """(product_id, from, same, not_applicable) of each selected product: what setting a field would change."""
    has = category_fields(products.sparkSession).filter(F.col("key") == field).select("cat", F.lit(True).alias("_has"))
    rows = products.join(selected.select("product_id").distinct(), "product_id", "left_semi").join(F.broadcast(has), "cat", "left")
    old = F.when(F.col("_has"), F.coalesce(F.col("v")[field], F.lit(""))).otherwise("")
    return rows.select("product_id", old.alias("from"), (F.coalesce("_has", F.lit(False)) & (old == value)).alias("same"), F.col("_has").isNull().alias("not_applicable"))


def apply(products: DataFrame, changes: DataFrame, field: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Products with the value set where the preview says so, and the undo table (product_id, field, from, had)."""
    todo = changes.filter("NOT same AND NOT not_applicable").select("product_id", F.lit(True).alias("_todo"))
    rows = products.join(todo, "product_id", "left")
    had = F.map_contains_key("v", field)
    undo = rows.filter("_todo").select("product_id", F.lit(field).alias("field"), F.col("v")[field].alias("from"), had.alias("had"))
    rest = F.map_filter("v", lambda k, _: k != field)
    out = rows.withColumn("v", F.when(F.col("_todo"), F.map_concat(rest, F.create_map(F.lit(field), F.lit(value)))).otherwise(F.col("v"))).drop("_todo")
    return out, undo


def revert(products: DataFrame, undo: DataFrame) -> DataFrame:
    """Products with the undone fields as they were, absent ones absent again."""
    rows = products.join(undo.select("product_id", F.col("field").alias("_f"), F.col("from").alias("_v"), F.col("had").alias("_h")), "product_id", "left")
    rest = F.map_filter("v", lambda k, _: k != F.col("_f"))
    old = F.when(F.col("_f").isNull(), F.col("v")).when(F.col("_h"), F.map_concat(rest, F.map_from_arrays(F.array("_f"), F.array("_v")))).otherwise(rest)
    return rows.withColumn("v", old).drop("_f", "_v", "_h")


def grouped(suggestions: DataFrame) -> DataFrame:
    """(field, from, to, products) of suggestions (product_id, field, from, to) that change something."""
    some = suggestions.filter("to <> '' AND NOT (to <=> from)")
    return some.groupBy("field", "from", "to").agg(F.count_distinct("product_id").alias("products"))


def merged(suggestions: DataFrame) -> DataFrame:
    """(field, from_key, to_key, products, sources): groups that propose the same folded change as one."""
    folded = suggestions.filter("to <> '' AND NOT (to <=> from)").select("product_id", "field", T.fold(F.col("from")).alias("from_key"), T.fold(F.col("to")).alias("to_key"), "source")
    return folded.groupBy("field", "from_key", "to_key").agg(F.count_distinct("product_id").alias("products"), F.count_distinct("source").alias("sources"))
