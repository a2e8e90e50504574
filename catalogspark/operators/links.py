"""Links between products and lookups of dictionary aliases in texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogspark.functions.session import written
from catalogspark.operators import extraction


def sku_key(c: Column) -> Column:
    """What SKUs are compared by: without blanks around, whatever their case."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def crosssell(links: DataFrame, entries: DataFrame) -> DataFrame:
    """(parent, child) of confirmed links whose ends both exist among entries (sku, eligible) and whose child is eligible, as the entries spell them.

    Of entries with the same SKU, whatever its case, the smallest spelling stands for all.
    """
    known = entries.filter(sku_key(F.col("sku")) != "").groupBy(sku_key(F.col("sku")).alias("key")).agg(F.min("sku").alias("sku"), F.max("eligible").alias("eligible"))
    ends = links.select(sku_key(F.col("parent")).alias("p"), sku_key(F.col("child")).alias("c")).distinct()
    both = ends.join(known.select(F.col("key").alias("p"), F.col("sku").alias("parent")), "p").join(known.filter("eligible").select(F.col("key").alias("c"), F.col("sku").alias("child")), "c")
    return both.select("parent", "child")


def upserted(entries: DataFrame, items: DataFrame) -> DataFrame:
    """(sku, title, eligible, state, is_new) of entries (sku, title, eligible, state) after items (sku, title, eligible) are put in.

    A product that is not eligible does not apply as a complement; one that is again has not been judged yet.
    """
    new = items.filter(F.trim(F.coalesce("sku", F.lit(""))) != "").select(sku_key(F.col("sku")).alias("key"), F.trim("sku").alias("n_sku"), F.col("title").alias("n_title"), F.col("eligible").alias("n_eligible"))
    both = entries.withColumns({"known": F.lit(True), "key": sku_key(F.col("sku"))}).join(new, "key", "full_outer")
    touched = F.col("n_eligible").isNotNull()
    state = F.when(touched & ~F.col("n_eligible"), "no_aplica").when(touched & (F.coalesce("state", F.lit("no_aplica")) == "no_aplica"), "sin_evaluar").otherwise(F.col("state"))
    return both.select(F.coalesce("sku", "n_sku").alias("sku"), F.coalesce("n_title", "title").alias("title"), F.coalesce("n_eligible", "eligible").alias("eligible"), state.alias("state"), F.col("known").isNull().alias("is_new"))


def lost_links(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Links of children that are no longer eligible, once each."""
    return links.select("parent", "child").distinct().join(entries.filter("NOT eligible").select(F.col("sku").alias("child")), "child", "left_semi").select("parent", "child")


def link_candidates(entries: DataFrame, links: DataFrame) -> DataFrame:
    """(sku, waiting, others): for each parent, how many eligible children of its category it is not linked with, those that wait for a parent and those that neither wait nor stand alone (they have one, or were not judged).

    Counts come from totals of each category less what is linked, so no pair of products is ever built.
    """
    waits, other = F.col("state") == "esperando", ~F.col("state").isin("esperando", "independiente")
    child = F.col("eligible") & (waits | other)
    totals = entries.filter(child).groupBy("cat").agg(F.count(F.when(waits, 1)).alias("all_waiting"), F.count(F.when(other, 1)).alias("all_others"))
    of = entries.filter(child).select(F.col("sku").alias("child"), F.col("cat").alias("child_cat"), waits.alias("child_waits"))
    known = links.select("parent", "child").distinct().join(of, "child")
    parents = entries.filter("parent").select("sku", "cat", F.coalesce(child & waits, F.lit(False)).cast("int").alias("own_waiting"), F.coalesce(child & other, F.lit(False)).cast("int").alias("own_others"))
    linked = known.join(parents.select(F.col("sku").alias("parent"), "cat"), "parent").filter("cat = child_cat AND child <> parent")
    linked = linked.groupBy(F.col("parent").alias("sku")).agg(F.count(F.when(F.col("child_waits"), 1)).alias("l_waiting"), F.count(F.when(~F.col("child_waits"), 1)).alias("l_others"))
    out = parents.join(totals, "cat", "left").join(linked, "sku", "left").fillna(0, ["all_waiting", "all_others", "l_waiting", "l_others"])
    return out.select("sku", (F.col("all_waiting") - F.col("l_waiting") - F.col("own_waiting")).alias("waiting"), (F.col("all_others") - F.col("l_others") - F.col("own_others")).alias("others"))


def parent_candidates(entries: DataFrame, links: DataFrame) -> DataFrame:
    """(sku, parents): for each eligible child, how many parents of its category it is not linked with; from totals, as in `link_candidates`."""
    parents = entries.filter("parent")
    totals = parents.groupBy("cat").agg(F.count("*").alias("all_parents"))
    of = parents.select(F.col("sku").alias("parent"), F.col("cat").alias("parent_cat"))
    children = entries.filter("eligible").select("sku", "cat", F.col("parent").cast("int").alias("own"))
    linked = links.select("parent", F.col("child").alias("sku")).distinct().join(of, "parent").join(children.select("sku", "cat"), "sku").filter("cat = parent_cat AND parent <> sku")
    linked = linked.groupBy("sku").agg(F.count("*").alias("l_parents"))
    out = children.join(totals, "cat", "left").join(linked, "sku", "left").fillna(0, ["all_parents", "l_parents"])
    return out.select("sku", (F.col("all_parents") - F.col("l_parents") - F.col("own")).alias("parents"))


def contained(rows: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, alias, canon, rank, at, size) of the aliases (alias, canon) that a text holds as whole words.

    Longer aliases go first and use up the text they stand on, so an alias inside a longer one is not found there. Blanks in
    an alias stand for any white space, other signs for themselves; an alias may have any number of words. at and size are
    characters of the text in one line; an alias that stands twice has its first place.
    """
    entries = written(dictionary.select("alias", "canon").distinct(), "aliases").select(F.lit("ingredient").alias("kind"), "alias", "canon", F.lit(0).cast("long").alias("seq"))
    texts = rows.select(key, extraction.flat(extraction.one_line(F.col(text))).alias("flat"))
    found = extraction.dictionary_candidates(texts, key, entries)
    hits = found.select(key, extraction.use_aliases(F.col("flat"), F.col("aliases")).alias("u")).select(key, F.posexplode("u.hits").alias("n", "h"))
    first = hits.groupBy(key, "h.alias", "h.canon").agg(F.min(F.struct("n", "h.at", "h.size")).alias("f"))
    own = entries.select(extraction.flat(F.trim("alias")).alias("alias"), "canon", F.col("alias").alias("spelled"))
    named = first.join(own, ["alias", "canon"])  # as the dictionary spells it
    w = Window.partitionBy(key).orderBy("f.n", "spelled")
    return named.select(key, F.col("spelled").alias("alias"), "canon", F.row_number().over(w).alias("rank"), F.col("f.at").alias("at"), F.col("f.size").alias("size"))
