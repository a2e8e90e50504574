"""External records: envelopes, first wins, changes against a cache, field differences, decisions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def envelope(rows: DataFrame, source: str, record_id: Column, data: Column, etag: Column) -> DataFrame:
    """(source_id, record_id, etag, checksum, data, seq) of raw records."""
    return rows.select(F.lit(source).alias("source_id"), F.coalesce(record_id.cast("string"), F.lit("")).alias("record_id"), etag.alias("etag"), F.md5(F.to_json(data)).alias("checksum"), data.alias("data"), "seq")


def keyed(rows: DataFrame, key: list[str], order: list, name: str = "_n") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def first_wins(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The first row of each key."""
    return keyed(rows, key, [seq]).filter("_n = 1").drop("_n")


def last_wins(rows: DataFrame, key: Column, seq: str = "seq") -> DataFrame:
    """The last row of each key, with `position`: the place of the key's first row."""
    k = rows.withColumn("_key", key)
    bounds = k.groupBy("_key").agg(F.min(seq).alias("position"), F.max(seq).alias("_last"))
    return k.join(bounds, "_key").filter(F.col(seq) == F.col("_last")).drop("_key", "_last")


def changed(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Records that the cache lacks, or has with another checksum or etag. Both have (source_id, record_id, checksum, etag)."""
    old = cache.select("source_id", "record_id", F.col("checksum").alias("_c"), F.col("etag").alias("_e"))
    return records.join(old, ["source_id", "record_id"], "left").filter("_c IS NULL OR _c <> checksum OR NOT (_e <=> etag)").drop("_c", "_e")


def field_changes(local: DataFrame, external: DataFrame, key: str) -> DataFrame:
    """(key, field, local, external) of differing fields of maps `data`; missing and empty are equal."""
    side = lambda df, name: df.select(key, F.explode("data").alias("field", name))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    both = side(local, "local").join(side(external, "external"), [key, "field"], "full")
    return both.select(key, "field", blank("local").alias("local"), blank("external").alias("external")).filter("local <> external")


def classified(external: DataFrame, changes: DataFrame, key: str, allowed: list[str], auto_accept: bool) -> DataFrame:
    """(key, n_changes, action): noop, suggest if all changed fields are allowed and auto-accept is on, else review."""
    by = changes.groupBy(key).agg(F.count("*").alias("n_changes"), F.bool_and(F.col("field").isin(*allowed)).alias("ok"))
    out = external.select(key).join(by, key, "left").fillna(0, ["n_changes"])
    action = F.when(F.col("n_changes") == 0, "noop").when(F.lit(auto_accept) & F.col("ok"), "suggest").otherwise("review")
    return out.select(key, "n_changes", action.alias("action"))


def overlaid(local: DataFrame, external: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Local records with the fields of accepted external ones on top."""
    e = external.join(decisions.filter("decision = 'accept'"), key, "left_semi").select(key, F.col("data").alias("_d"))
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter("data", lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("_d", none)), k))
    return local.join(e, key, "left").withColumn("data", F.map_concat(kept, F.coalesce("_d", none))).drop("_d")


def sync_summary(classified_: DataFrame, fetched: Column, unchanged: Column) -> DataFrame:
    """One row: records by action, how many were fetched, and how many of them had not changed (aggregates over the classified records)."""
    of = lambda a: F.count(F.when(F.col("action") == a, 1))
    return classified_.agg(of("accept").alias("accepted"), of("suggest").alias("suggested"), of("review").alias("review"), of("noop").alias("skipped"), fetched.alias("fetched"), unchanged.alias("unchanged"))
