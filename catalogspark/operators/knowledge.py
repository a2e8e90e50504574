"""Evidence, confidence, status, conflicts and lookups of the knowledge graph."""

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogspark.functions import text as T

# Points of evidence kinds (step, cap), and the rules of confidence.
POINTS = {"observed": (0.25, 2.0), "imported": (0.5, 1.5), "ai": (0.25, 0.5), "confirmed": (3.0, None), "correction": (2.0, None)}
REJECT, RULE, PRIOR = 3.0, 4.0, 2.0
NO_HUMAN_CAP, CONFLICT_FACTOR, MONTH_LOSS, MOST_LOSS, MOST = 0.7, 0.6, 0.01, 0.15, 0.99
TRUSTED_MIN, TRUSTED_CONFIRMS = 0.85, 2
MONTH_SECONDS = 30 * 24 * 3600


def evidence_counts(evidence: DataFrame, target: list[str]) -> DataFrame:
    """(target..., one count a kind, confirm_refs, last_at) of evidence (target..., kind, ref, at)."""
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in (*POINTS, "rejected")]
    return evidence.groupBy(*target).agg(*counts, F.count_distinct(F.when(F.col("kind") == "confirmed", F.col("ref"))).alias("confirm_refs"), F.max("at").alias("last_at"))


def points() -> Column:
    out = F.lit(0.0)
    for kind, (step, cap) in POINTS.items():
        p = F.col(kind) * step
        out = out + (F.least(F.lit(cap), p) if cap else p)
    return out


def confidence(as_of: Column, rule: Column | None = None, conflict: Column | None = None) -> Column:
    """Confidence of rows with the columns of `evidence_counts`."""
    rule, conflict = (F.lit(False) if c is None else c for c in (rule, conflict))
    p = points() + F.when(rule, RULE).otherwise(0.0)
    c = p / (p + REJECT * F.col("rejected") + PRIOR)
    human = F.col("confirmed") + F.col("correction") > 0
    c = F.when(human | rule, c).otherwise(F.least(c, F.lit(NO_HUMAN_CAP)))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("last_at")) / MONTH_SECONDS
    c = c * (1 - F.least(F.lit(MOST_LOSS), F.greatest(F.lit(0.0), F.coalesce(age, F.lit(0.0))) * MONTH_LOSS))
    c = F.when(conflict, c * CONFLICT_FACTOR).otherwise(c)
    c = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(MOST), c)) * 100 + 0.5) / 100
    return F.when(rule & (F.col("rejected") == 0), 1.0).otherwise(c)


def status(conf: Column, conflict: Column | None = None) -> Column:
    conflict = F.lit(False) if conflict is None else conflict
    return (
        F.when((F.col("rejected") > 0) & (REJECT * F.col("rejected") >= points()), "rejected")
        .when(conflict, "conflicted")
        .when((F.col("confirmed") >= TRUSTED_CONFIRMS) & (F.col("confirm_refs") >= TRUSTED_CONFIRMS) & (F.col("rejected") == 0) & (conf >= TRUSTED_MIN), "trusted")
        .when(F.col("confirmed") + F.col("correction") > 0, "confirmed")
        .when(F.col("ai") > 0, "suggested")
        .otherwise("observed")
    )


def conflicts(relations: DataFrame) -> DataFrame:
    """(subject, predicate, candidates): subjects with two live objects or more of a predicate that allows one."""
    live = relations.filter("status <> 'rejected'")
    return live.groupBy("subject", "predicate").agg(F.count_distinct("object").alias("candidates")).filter("candidates > 1")


def resolved(values: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(type, value, entity_id, via): confirmed alias first, exact identity second, another alias that is not rejected third."""
    v = values.select("type", "value").distinct().withColumn("norm", T.identity(F.col("value")))
    a = aliases.filter("status <> 'rejected'").groupBy("type", F.col("normalized_alias").alias("norm")).agg(F.max_by(F.struct("entity_id", "status"), F.struct(F.col("status").isin("confirmed", "trusted"), "entity_id")).alias("a"))
    e = entities.select("type", F.col("normalized").alias("norm"), F.col("id").alias("e")).distinct()
    both = v.join(a, ["type", "norm"], "left").join(e, ["type", "norm"], "left")
    sure = F.col("a.status").isin("confirmed", "trusted")
    via = F.when(sure, "alias").when(F.col("e").isNotNull(), "exact").when(F.col("a").isNotNull(), "alias")
    found = F.when(sure, F.col("a.entity_id")).otherwise(F.coalesce("e", "a.entity_id"))
    return both.select("type", "value", found.alias("entity_id"), via.alias("via"))


def stats(entities: DataFrame) -> DataFrame:
    """Counts by type and by status in one pass: (type, status, n), null on the side that is summed over."""
    return entities.groupingSets([["type"], ["status"]], "type", "status").agg(F.count("*").alias("n"))


def _contains(token: str, t: Column) -> Column:
    return F.contains(t, F.lit(token))


def search(entities: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Entities whose tokens all query tokens begin or lie in, by confidence, then name."""
    found = entities
    for token in sorted(set(query.lower().split())):
        found = found.filter(F.exists("tokens", partial(_contains, token)))
    return found.orderBy(F.desc("confidence"), "canonical").limit(k)


def orphans(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(subject, predicate, object, missing): relations with an end that no entity has."""
    known = entities.select("id").distinct()
    rows = relations.select("subject", "predicate", "object")
    s = rows.join(known.withColumnRenamed("id", "subject"), "subject", "left_anti").withColumn("missing", F.lit("subject"))
    o = rows.join(known.withColumnRenamed("id", "object"), "object", "left_anti").withColumn("missing", F.lit("object"))
    return s.select(*rows.columns, "missing").unionByName(o.select(*rows.columns, "missing"))


def neighbours(relations: DataFrame) -> DataFrame:
    """(entity, direction, predicate, other) in both directions."""
    ends = F.array(F.struct(F.col("subject").alias("entity"), F.lit("out").alias("direction"), "predicate", F.col("object").alias("other")), F.struct(F.col("object").alias("entity"), F.lit("in").alias("direction"), "predicate", F.col("subject").alias("other")))
    return relations.select(F.explode(ends).alias("e")).select("e.*")


def strongest(relations: DataFrame, k: int = 1) -> DataFrame:
    """The k strongest objects of each subject and predicate, by confidence, then object."""
    w = Window.partitionBy("subject", "predicate").orderBy(F.desc("confidence"), "object")
    return relations.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def checked(products: DataFrame, relations: DataFrame) -> DataFrame:
    """(product_id, verdict, expected, confidence, strong, fill) of products (product_id, subject, typed) under what is known of their subject.

    relations: (subject, object, confidence, status). `match` if the typed object is known, `conflict` if it is but others
    are in conflict with it, `mismatch` if only others are known, `unknown` if nothing is typed or known. An object that is
    not typed may be filled with the strongest one. Rows without a subject, or with nothing typed and known, get no verdict.
    """
    live = relations.filter("status <> 'rejected'").withColumn("key", T.identity(F.col("object")))
    best = F.struct((-F.col("confidence")).alias("c"), "object", "status")
    top = live.groupBy("subject").agg(F.min(best).alias("top"), F.count("*").alias("n"), F.max((F.col("status") == "conflicted").cast("int")).alias("contested"))
    own = live.groupBy("subject", "key").agg(F.max("confidence").alias("own"))
    rows = products.filter("subject <> ''").withColumn("key", T.identity(F.coalesce("typed", F.lit("")))).join(top, "subject", "left").join(own, ["subject", "key"], "left")
    none, typed, contested = F.col("n").isNull(), F.col("key") != "", (F.col("n") > 1) & (F.col("contested") == 1)
    verdict = F.when(none | ~typed, "unknown").when(F.col("own").isNull(), "mismatch").when(contested, "conflict").otherwise("match")
    out = rows.filter(typed | ~none).withColumn("verdict", verdict)
    wrong = F.col("verdict") == "mismatch"
    return out.select(
        "product_id", "verdict", F.when(wrong, F.col("top.object")).alias("expected"), F.when(wrong, -F.col("top.c")).when(F.col("verdict") != "unknown", F.col("own")).alias("confidence"),
        (wrong & F.col("top.status").isin("confirmed", "trusted")).alias("strong"), F.when(~typed, F.col("top.object")).alias("fill"),
    )
