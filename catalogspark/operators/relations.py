"""Relations of products: alternatives, related products, top lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogspark.functions import text as T

TOP = 4


def top_k(pairs: DataFrame, owner: str, order: list, k: int = TOP) -> DataFrame:
    """The first k rows of each owner, with their rank."""
    w = Window.partitionBy(owner).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def alternatives(products: DataFrame, key: list[str], brand: str = "marca", sku: str = "sku", k: int = TOP) -> DataFrame:
    """(sku, other, rank): products with equal keys and another brand, by SKU, at most k.

    Linear in the group: each brand gives at most k rows to the group's head, the head keeps 2k rows (at most k of any
    one brand, so k of other brands remain), and every product is joined with the head of its group alone.
    """
    full = F.lit(True)
    for c in [*key, brand]:
        full = full & (F.coalesce(F.col(c), F.lit("")) != "")
    rows = products.filter(full).select(*key, F.col(brand).alias("b"), F.col(sku).alias("s"))
    per_brand = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key, "b").orderBy("s"))).filter(F.col("n") <= k)
    head = per_brand.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("s"))).filter(F.col("n") <= 2 * k)
    heads = head.select(*key, F.col("b").alias("hb"), F.col("s").alias("other"))
    pairs = rows.join(heads, key).filter("b <> hb AND s <> other").select(F.col("s").alias("sku"), "other")
    return top_k(pairs, "sku", ["other"], k)


def related(products: DataFrame, key: list[str], category: str = "cat", brand: str = "marca", maker: str = "fabricante", sku: str = "sku", k: int = TOP) -> DataFrame:
    """(sku, other, same_brand, rank): same category and same brand or same maker but no alternative, brand first, then SKU.

    Products are joined with heads of their groups only. The brand's head has k + 1 rows. Of a maker's products, one
    owner passes over those of its own brand, those of its own key (its alternatives) and itself; heads that keep
    k + 1 rows of a key and brand, 2k + 2 of a key, 2k + 2 of a brand and 5k + 5 in all still hold its first k.
    """
    full = F.col(brand) != ""
    for c in key:
        full = full & (F.coalesce(F.col(c), F.lit("")) != "")
    rows = products.select(F.col(category).alias("c"), F.col(brand).alias("b"), F.col(maker).alias("m"), F.col(sku).alias("s"), F.when(full, F.concat_ws("\u0001", *key)).alias("key"))
    first = lambda df, by, n: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("s"))).filter(F.col("_n") <= n).drop("_n")

    head = first(rows.filter("b <> ''"), ["c", "b"], k + 1).select("c", "b", F.col("s").alias("other"))
    own = top_k(rows.filter("b <> ''").join(head, ["c", "b"]).filter("s <> other").select("s", "other", F.lit(True).alias("same")), "s", ["other"], k).drop("rank")
    short = rows.join(own.groupBy("s").agg(F.count("*").alias("have")), "s", "left").filter(F.coalesce("have", F.lit(0)) < k).filter("m <> ''")
    heads = rows.filter("m <> ''")
    for by, n in ((["c", "m", "key", "b"], k + 1), (["c", "m", "key"], 2 * k + 2), (["c", "m", "b"], 2 * k + 2), (["c", "m"], 5 * k + 5)):
        heads = first(heads, by, n)
    heads = heads.select("c", "m", F.col("s").alias("other"), F.col("b").alias("ob"), F.col("key").alias("okey"))
    others = short.join(heads, ["c", "m"]).filter("s <> other AND NOT (b <> '' AND b = ob) AND NOT coalesce(key = okey AND b <> ob, false)").select("s", "other", F.lit(False).alias("same"))
    return top_k(own.unionByName(others), "s", [F.desc("same"), "other"], k).select(F.col("s").alias("sku"), "other", F.col("same").alias("same_brand"), "rank")


def complement_eligible(cat: Column, prescription: Column, specialty: Column) -> Column:
    """Non-medicines always; medicines only if declared free of prescription and declared no speciality."""
    return (cat != "med") | ((F.coalesce(prescription, F.lit("")) == "no") & (F.coalesce(specialty, F.lit("")) == "no"))


def declared(products: DataFrame, lists: str, allowed: DataFrame, sku: str = "sku") -> DataFrame:
    """(sku, other): SKUs listed in a field, split by blanks, commas, semicolons and bars, that exist among `allowed` (sku)."""
    listed = products.select(F.col(sku).alias("sku"), F.explode(F.array_distinct(F.split(F.col(lists), r"[\s,;|]+"))).alias("other")).filter("other <> '' AND other <> sku")
    return listed.join(allowed.select(F.col(sku).alias("other")).distinct(), "other", "left_semi").select("sku", "other")


def with_overrides(pairs: DataFrame, overrides: DataFrame) -> DataFrame:
    """(sku, other) pairs less those switched off, with those switched on, both directions. overrides: (a, b, on)."""
    both = overrides.select(F.explode(F.array(F.struct(F.col("a").alias("sku"), F.col("b").alias("other"), "on"), F.struct(F.col("b").alias("sku"), F.col("a").alias("other"), "on"))).alias("o")).select("o.*").distinct()
    kept = pairs.select("sku", "other").join(both.filter("NOT on").select("sku", "other"), ["sku", "other"], "left_anti")
    return kept.unionByName(both.filter("on").select("sku", "other")).distinct()


def relation_alerts(now: DataFrame, exported: DataFrame) -> DataFrame:
    """(sku, other, change): links of exported products that were added or removed since. Both: (sku, other)."""
    known = exported.select("sku").distinct()
    a = now.join(known, "sku", "left_semi").select("sku", "other").withColumn("n", F.lit(1))
    b = exported.select("sku", "other").withColumn("e", F.lit(1))
    return a.join(b, ["sku", "other"], "full").filter("n IS NULL OR e IS NULL").select("sku", "other", F.when(F.col("e").isNull(), "added").otherwise("removed").alias("change"))


def clean_links(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct (p, c) links between different entries that exist."""
    known = entries.select("sku").distinct()
    out = links.filter("p <> c").join(known.withColumnRenamed("sku", "p"), "p", "left_semi").join(known.withColumnRenamed("sku", "c"), "c", "left_semi")
    return out.select("p", "c").distinct()


#: Zone words up to which all sets of a row's words are counted.
FEW_WORDS = 6


def routine_mates(rows: DataFrame, key: str, step: str, zone: str) -> DataFrame:
    """(key, mates): how many rows are of another step and share a zone word, or lack a zone on either side.

    Rows are counted in classes of equal words and step. Classes of at most FEW_WORDS words meet by inclusion-exclusion: those
    that share a word are the sum over sets of words of +- those that have the whole set, at most 2 ** FEW_WORDS - 1 sets
    a class. A class of more words meets others on its words, each other class once. Pairs of rows are never made. Rows
    without step have none.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(T.fold(F.col(zone)), "[^a-z]+"), lambda w: F.length(w) > 3)))
    each = rows.select(F.col(key), F.nullif(F.col(step).cast("string"), F.lit("")).alias("_step"), (F.coalesce(F.col(zone), F.lit("")) == "").alias("_bare"), words.alias("_words"))
    classes = each.filter("_step IS NOT NULL").groupBy("_step", "_bare", "_words").agg(F.count("*").alias("n"))
    # names: '' stands for every row, '-' for rows without zone, else sorted words
    subsets = F.transform(F.expr("sequence(1L, shiftleft(1L, size(_words)) - 1)"), lambda m: F.struct(F.array_join(F.filter("_words", lambda w, i: F.getbit(m, i) == 1), " ").alias("name"), F.when(F.bit_count(m) % 2 == 1, 1).otherwise(-1).alias("sign")))
    subsets = F.when(F.size("_words").between(1, FEW_WORDS), subsets).otherwise(F.array().cast("array<struct<name:string,sign:int>>"))
    named = lambda *x: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).cast("int").alias("sign")) if isinstance(w, int) else F.struct(F.lit(n).alias("name"), w.cast("int").alias("sign")) for n, w in x])
    held = F.concat(F.transform(subsets, lambda s: F.struct(s["name"].alias("name"), F.lit(1).alias("sign"))), named(("", 1), ("-", F.col("_bare"))))
    by = classes.select("_step", "n", F.explode(held).alias("s")).groupBy("s.name", "_step").agg(F.sum(F.col("n") * F.col("s.sign")).alias("n"))
    other = by.select("name", "_step", (F.sum("n").over(Window.partitionBy("name")) - F.col("n")).alias("other"))
    asked = F.when(F.col("_bare"), named(("", 1))).otherwise(F.concat(subsets, named(("-", 1))))
    asks = classes.select("_step", "_bare", "_words", F.explode(asked).alias("s")).select("_step", "_bare", "_words", "s.*")
    counted = asks.join(other, ["name", "_step"]).select("_step", "_bare", "_words", (F.col("sign") * F.col("other")).alias("mates"))
    wide = classes.filter(F.size("_words") > FEW_WORDS).select(F.col("_step").alias("w_step"), F.col("_words").alias("w_words"), F.col("n").alias("w_n"), F.explode("_words").alias("word"))
    met = wide.join(classes.withColumn("word", F.explode("_words")), "word").filter("w_step <> _step").select("w_step", "w_words", "w_n", "_step", "_words", "n").distinct()
    of_wide = met.select(F.col("w_step").alias("_step"), F.lit(False).alias("_bare"), F.col("w_words").alias("_words"), F.col("n").alias("mates"))
    of_narrow = met.filter(F.size("_words") <= FEW_WORDS).select("_step", F.lit(False).alias("_bare"), "_words", F.col("w_n").alias("mates"))
    mates = counted.unionByName(of_wide).unionByName(of_narrow).groupBy("_step", "_bare", "_words").agg(F.sum("mates").alias("mates"))
    return each.join(mates, ["_step", "_bare", "_words"], "left").select(key, F.coalesce("mates", F.lit(0)).cast("long").alias("mates"))
