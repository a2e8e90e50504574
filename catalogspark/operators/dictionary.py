"""Dictionaries: parsing, fuzzy lookup, codes by prefix, missing entries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogspark.functions import text as T


def parse_aliases(rows: DataFrame, text: str) -> DataFrame:
    """(alias, canon) from lines or `;`-separated `alias=canon`; a missing canon is the alias."""
    parts = rows.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"[\n;]")).alias("line")).withColumn("line", F.trim("line")).filter("line <> ''")
    alias = F.trim(F.substring_index("line", "=", 1))
    canon = F.trim(F.expr("CASE WHEN instr(line, '=') > 0 THEN substring(line, instr(line, '=') + 1) ELSE '' END"))
    return parts.select(alias.alias("alias"), F.when(canon == "", alias).otherwise(canon).alias("canon")).filter("alias <> ''").distinct()


def fuzzy(values: DataFrame, value: str, entries: DataFrame, threshold: float = 0.88, k: int = 3) -> DataFrame:
    """(value, alias, canon, score, exact, rank): entries that a value contains or resembles, exact first, then by score.

    Containing entries meet values on token n-grams by equality; resembling ones on segments of their compact forms, as
    in `anomalies.near_duplicates`: with d edits allowed, d + 1 segments of the longer form, one of which is kept.
    """
    v = values.select(F.col(value).alias("value")).distinct().withColumn("target", T.clean(F.col("value"))).filter("target <> ''")
    e = entries.select("alias", "canon").distinct().withColumn("a", T.clean(F.col("alias"))).filter("a <> ''")
    # containing as text: every place in the target where an alias of that length could start
    lengths = e.select(F.length("a").alias("n")).distinct()
    spots = v.join(F.broadcast(lengths), F.length("target") >= F.col("n")).select("value", "target", F.explode(F.transform(F.sequence(F.lit(1), F.length("target") - F.col("n") + 1), lambda p: F.substr("target", p, F.col("n")))).alias("a")).distinct()
    inside = spots.join(e, "a").select("value", "alias", "canon", F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    x, y = T.compact(F.col("value")), T.compact(F.col("alias"))
    gap = 1.0 - threshold
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.floor(F.lit(gap) * F.floor(F.length(c) / F.lit(threshold) + 1e-9) + 1e-9).cast("int")), lambda i: i)
    left = v.select("value", "target", x.alias("c"))
    right = e.select("alias", "canon", "a", y.alias("d"))
    size = lambda n, m: F.floor(n / m).cast("int")
    right = right.withColumn("n", F.length("d")).withColumn("i", F.explode(cut("d"))).withColumn("m", F.size(cut("d")))
    right = right.withColumn("at", F.col("i") * size(F.col("n"), F.col("m"))).withColumn("len", F.when(F.col("i") == F.col("m") - 1, F.col("n") - F.col("at")).otherwise(size(F.col("n"), F.col("m"))))
    right = right.select("alias", "canon", "a", "d", "n", F.substr("d", F.col("at") + 1, F.col("len")).alias("piece")).filter("piece <> ''")
    sizes = right.select(F.length("piece").alias("len")).distinct()
    grams = left.join(F.broadcast(sizes), F.length("c") >= F.col("len")).select("value", "target", "c", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("c") - F.col("len") + 1), lambda p: F.substr("c", p, F.col("len"))))).alias("piece"))
    close = grams.join(right, "piece").select("value", "target", "c", "alias", "canon", "a", "d").distinct().filter(~F.contains("target", "a"))
    close = close.withColumn("score", T.similarity(F.col("c"), F.col("d"))).filter(F.col("score") >= threshold)
    every = inside.unionByName(close.select("value", "alias", "canon", F.round("score", 3).alias("score"), F.lit(False).alias("exact")))
    w = Window.partitionBy("value").orderBy(F.desc("exact"), F.desc("score"), F.length("alias"), "alias")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def code_key(ingredients):
    """Ingredients split, folded, sorted and joined: the key of the code dictionary."""
    parts = F.filter(F.transform(F.split(ingredients, r"\s*(?:[,;/+]|\by\b)\s*"), T.clean), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(parts)), " + ")


def lookup(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Rows with the columns of a dictionary (key, ...), null where it has none."""
    return rows.join(table.withColumnRenamed("key", key), key, "left")


def missing(rows: DataFrame, value: str, known: DataFrame, seq: str = "seq") -> DataFrame:
    """(key, first_spelling): folded values that the dictionary (key) lacks, in their first spelling."""
    used = rows.select(T.clean(F.col(value)).alias("key"), F.col(value).alias("v"), F.col(seq).alias("seq")).filter("key <> ''")
    return used.join(known.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min_by("v", "seq").alias("first_spelling"))


def longest_prefix(rows: DataFrame, code: str, prefixes: DataFrame, longest: int) -> DataFrame:
    """Rows with the value of the longest prefix of their code; prefixes: (prefix, value)."""
    keyed = rows.select(code).distinct().filter(F.col(code).isNotNull())
    cut = keyed.select(code, F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.substr(code, F.lit(1), n))).alias("prefix")).distinct()
    best = cut.join(prefixes, "prefix").groupBy(code).agg(F.max_by("value", F.length("prefix")).alias("value"))
    return rows.join(best, code, "left")
