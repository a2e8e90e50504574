"""Merges: unknown rows only, newest wins, cascades."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.sync import first_wins


def add_unknown(current: DataFrame, incoming: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """current, and the first incoming row of each key that it lacks; nothing is overwritten."""
    fresh = first_wins(incoming, [key], seq).join(current.select(key).distinct(), key, "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def newest_wins(current: DataFrame, incoming: DataFrame, key: str, stamp: str) -> DataFrame:
    """(row..., action): the newer row of each key; current stays on a tie. Both sides have one row a key."""
    cols = [c for c in current.columns if c != key]
    both = current.select(key, F.struct(*cols).alias("_c")).join(incoming.select(key, F.struct(*cols).alias("_i")), key, "full")
    take = F.col("_c").isNull() | (F.col("_i").isNotNull() & (F.col(f"_i.{stamp}") > F.col(f"_c.{stamp}")))
    action = F.when(F.col("_c").isNull(), "added").when(take, "updated").otherwise("kept")
    return both.withColumn("_r", F.when(take, F.col("_i")).otherwise(F.col("_c"))).select(key, "_r.*", action.alias("action"))


def upsert(current: DataFrame, incoming: DataFrame, key: Column, seq: str = "seq") -> DataFrame:
    """Incoming rows replace current ones of the same key and keep their id; others are appended. Columns: id, seq, ..."""
    cols = [c for c in current.columns if c != "id"]
    c = current.withColumn("_k", key)
    i = first_wins(incoming.withColumn("_k", key), ["_k"], seq)
    both = c.select("_k", "id", F.struct(*cols).alias("_c")).join(i.select("_k", F.col("id").alias("_id"), F.struct(*cols).alias("_i")), "_k", "full")
    return both.select(F.coalesce("id", "_id").alias("id"), F.coalesce("_i", "_c").alias("_r")).select("id", "_r.*")


def without(entries: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (sku) and links (p, c) less those of removed SKUs (sku)."""
    left = entries.join(gone, "sku", "left_anti")
    kept = links.join(gone.withColumnRenamed("sku", "p"), "p", "left_anti").join(gone.withColumnRenamed("sku", "c"), "c", "left_anti")
    return left, kept.select("p", "c")
