"""Two versions of the relation catalogue merged: entries by clocks of their own, links, and manual relations.

entries (sku, updated_at, exported_at, snapshot, eligible, data map), links (parent, child) and manual (a, b, kind, on, at); times
are ISO texts, and null or empty means never. SKUs meet without blanks around and whatever their case, each once a side.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.links import sku_key


def _time(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def merged_entries(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entries after a merge, with action: added, updated, same or own (only local).

    The newer entry wins whole, but for the time of export and the snapshot taken then, which follow their own clock: the later
    export brings its snapshot (or keeps the local one, if it has none).
    """
    a = local.select(sku_key(F.col("sku")).alias("key"), *[F.col(c).alias(f"l_{c}") for c in ("sku", "updated_at", "exported_at", "snapshot", "eligible", "data")])
    b = incoming.filter(sku_key(F.col("sku")) != "").select(sku_key(F.col("sku")).alias("key"), *[F.col(c).alias(f"i_{c}") for c in ("sku", "updated_at", "exported_at", "snapshot", "eligible", "data")])
    both = a.join(b, "key", "full_outer")
    mine, theirs = F.col("l_sku").isNotNull(), F.col("i_sku").isNotNull()
    newer = mine & theirs & (_time("i_updated_at") > _time("l_updated_at"))
    export = mine & theirs & (_time("i_exported_at") != "") & (_time("i_exported_at") > _time("l_exported_at"))
    take = ~mine | newer
    pick = lambda c: F.when(take, F.col(f"i_{c}")).otherwise(F.col(f"l_{c}")).alias(c)
    action = F.when(~mine, "added").when(~theirs, "own").when(newer | export, "updated").otherwise("same")
    return both.select(
        pick("sku"), pick("updated_at"), F.when(~mine | export, F.col("i_exported_at")).otherwise(F.col("l_exported_at")).alias("exported_at"),
        F.when(~mine, F.col("i_snapshot")).when(export, F.coalesce("i_snapshot", "l_snapshot")).otherwise(F.col("l_snapshot")).alias("snapshot"), pick("eligible"), pick("data"), action.alias("action"),
    )


def merged_links(local: DataFrame, incoming: DataFrame, entries: DataFrame) -> DataFrame:
    """(parent, child, action) of links after a merge: own, added, or why an incoming one is left out (orphan, not eligible, known); what one side removed stays with the other."""
    keys = lambda df: df.select(sku_key(F.col("parent")).alias("p"), sku_key(F.col("child")).alias("c"), "parent", "child")
    known = entries.select(sku_key(F.col("sku")).alias("k"), "eligible").groupBy("k").agg(F.max("eligible").alias("eligible"))
    mine = keys(local)
    new = keys(incoming).groupBy("p", "c").agg(F.min("parent").alias("parent"), F.min("child").alias("child"))
    new = new.join(known.select(F.col("k").alias("p"), F.lit(True).alias("has_p")), "p", "left").join(known.select(F.col("k").alias("c"), F.lit(True).alias("has_c"), "eligible"), "c", "left")
    new = new.join(mine.select("p", "c").distinct().withColumn("mine", F.lit(True)), ["p", "c"], "left")
    action = F.when(F.col("has_p").isNull() | F.col("has_c").isNull(), "orphan").when(~F.coalesce("eligible", F.lit(False)), "not eligible").when(F.col("mine"), "known").otherwise("added")
    return mine.select("parent", "child", F.lit("own").alias("action")).unionByName(new.select("parent", "child", action.alias("action")))


def merged_relations(local: DataFrame, incoming: DataFrame, entries: DataFrame) -> DataFrame:
    """(a, b, kind, on, at, action) of manual relations, which have no direction: the newer decision wins where the two differ; action is own, added, changed or orphan."""
    ends = lambda df: df.select(F.least(sku_key(F.col("a")), sku_key(F.col("b"))).alias("x"), F.greatest(sku_key(F.col("a")), sku_key(F.col("b"))).alias("y"), "kind", "a", "b", "on", "at")
    known = entries.select(sku_key(F.col("sku")).alias("k")).distinct()
    mine = ends(local)
    new = ends(incoming).groupBy("x", "y", "kind").agg(F.max_by(F.struct("a", "b", "on", "at"), F.coalesce("at", F.lit(""))).alias("n"))
    new = new.join(known.withColumn("has_x", F.lit(True)).withColumnRenamed("k", "x"), "x", "left").join(known.withColumn("has_y", F.lit(True)).withColumnRenamed("k", "y"), "y", "left")
    orphan = F.col("n").isNotNull() & (F.col("has_x").isNull() | F.col("has_y").isNull())
    both = mine.join(new, ["x", "y", "kind"], "full_outer").withColumn("orphan", orphan)
    changed = F.col("a").isNotNull() & F.col("n").isNotNull() & ~F.col("orphan") & (F.coalesce("n.at", F.lit("")) > _time("at")) & ~F.col("on").eqNullSafe(F.col("n.on"))
    action = F.when(F.col("a").isNull(), F.when(F.col("orphan"), "orphan").otherwise("added")).when(changed, "changed").otherwise("own")
    value = lambda c: F.when(F.col("a").isNull() | (changed if c in ("on", "at") else F.lit(False)), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(value("a"), value("b"), "kind", value("on"), value("at"), action.alias("action"))


def merge_report(entries: DataFrame, links: DataFrame, relations: DataFrame) -> DataFrame:
    """(part, action, n): what a merge did."""
    count = lambda df, part: df.select(F.lit(part).alias("part"), "action")
    return count(entries, "entries").unionByName(count(links, "links")).unionByName(count(relations, "relations")).groupBy("part", "action").agg(F.count("*").alias("n"))
