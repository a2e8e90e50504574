"""Audit events: bounded histories, approval state, collapsed edits, latest rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bounded(rows: DataFrame, context: list[str], order: list, most: int) -> DataFrame:
    """The last `most` rows of each context; order: latest first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*context).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def latest(rows: DataFrame, key: str, stamps: list[str], seq: str) -> DataFrame:
    """The newest row of each key by its first stamp that is set; a later row wins a tie."""
    w = Window.partitionBy(key).orderBy(F.coalesce(*stamps).desc_nulls_last(), F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def approval(events: DataFrame, item: str, at: list[str], approve: str, revoke: str) -> DataFrame:
    """(item, approved): whether the last approval event of an item is an approval. A plain aggregate: no item is sorted."""
    some = events.filter(F.col("action").isin(approve, revoke))
    return some.groupBy(item).agg((F.max_by("action", F.struct(*at)) == approve).alias("approved"))


def collapsed(edits: DataFrame, owner: str, field: str, order: list[str], most: int = 50) -> DataFrame:
    """(owner, run, field, before, after, edits): the last `most` rows of an owner's log of edits.

    An edit that changes nothing is not logged. An edit of the field that the last row is about is merged into it, and the
    row disappears if the two change nothing together; then the row before it is the last one. The log is a fold over the
    owner's edits in order, so an owner's edits must fit one row.
    """
    row = "struct<field: string, before: string, after: string, edits: bigint>"
    entry = F.struct(*order, F.col(field).alias("field"), F.col("before").cast("string").alias("before"), F.col("after").cast("string").alias("after"))
    changes = edits.filter(~F.col("before").eqNullSafe(F.col("after"))).groupBy(owner).agg(F.array_sort(F.collect_list(entry)).alias("log"))

    def logged(log, e):
        last, rest = F.element_at(log, -1), F.slice(log, F.lit(1), F.size(log) - 1)
        one = F.struct(e["field"].alias("field"), e["before"].alias("before"), e["after"].alias("after"), F.lit(1).cast("long").alias("edits"))
        merged = F.struct(last["field"].alias("field"), last["before"].alias("before"), e["after"].alias("after"), (last["edits"] + 1).alias("edits"))
        same = (F.size(log) > 0) & F.get(log, F.size(log) - 1)["field"].eqNullSafe(e["field"])
        out = F.when(~same, F.concat(log, F.array(one))).when(last["before"].eqNullSafe(e["after"]), rest).otherwise(F.concat(rest, F.array(merged)))
        return F.slice(out, F.greatest(F.size(out) - most + 1, F.lit(1)), most)

    logs = changes.select(owner, F.aggregate("log", F.array().cast(f"array<{row}>"), logged).alias("log"))
    out = logs.select(owner, F.posexplode("log").alias("run", "row"))
    return out.select(owner, "run", F.col("row.field").alias(field), "row.before", "row.after", "row.edits")


def trimmed(events: DataFrame, item: str, at: list[str], approvals: list[str], most: int) -> DataFrame:
    """The last approval event of each item, and the last `most` of all other events.

    The cut among the others is found by a top-k, so no global window is needed.
    """
    last = events.filter(F.col("action").isin(*approvals)).groupBy(item).agg(F.max(F.struct(*at, "action")).alias("e")).select(item, "e.*")
    rest = events.filter(~F.col("action").isin(*approvals)).orderBy(*[F.desc(c) for c in at]).limit(most).select(item, *at, "action")
    return last.unionByName(rest)
