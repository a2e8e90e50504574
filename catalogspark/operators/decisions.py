"""Human decisions over the knowledge graph: withdrawn and added evidence, aliases, names, levels of correction."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import text as T

# What is never corrected alone, and the confidence that other corrections need.
CRITICAL_FIELDS = (
    "principio", "componente", "concentracion", "laboratorio", "marca", "fabricante", "receta", "leyenda", "precauciones", "modo", "nutrimental", "ingredientes", "alergenos", "advertencias", "indicaciones", "posologia", "poblacion", "contraindicaciones", "inci", "fps", "nivel", "via",
)
CRITICAL_TYPES = ("substance", "concentration", "laboratory", "brand", "manufacturer", "route", "prescription")
AUTO_TYPES = ("pharmaceuticalForm", "unit", "presentation", "category", "subcategory", "storeCategory")
AUTO_MIN, ASSIST_MIN = 0.85, 0.6
WITHDRAWN = ("observed", "imported")


def superseded(evidence: DataFrame, edited: DataFrame, ref: str = "ref") -> DataFrame:
    """Evidence with `superseded`: what was observed or imported from products (ref) that were edited since. Nothing is deleted."""
    refs = edited.select(F.col(ref)).distinct().withColumn("_edited", F.lit(True))
    return evidence.join(refs, ref, "left").withColumn("superseded", F.coalesce("_edited", F.lit(False)) & F.col("kind").isin(*WITHDRAWN)).drop("_edited")


def decided(evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """Evidence and the decisions (subject, predicate, object, accepted, ref, at) as confirmations and rejections."""
    kind = F.when(F.col("accepted"), "confirmed").otherwise("rejected")
    rows = decisions.select("subject", "predicate", "object", kind.alias("kind"), "ref", "at")
    return evidence.select(*rows.columns).unionByName(rows)


def choice_evidence(conflicts: DataFrame, choices: DataFrame) -> DataFrame:
    """Decisions of resolved conflicts: of the candidates (subject, predicate, object), the chosen object is accepted and the others are not."""
    picked = choices.select("subject", "predicate", F.col("object").alias("_chosen"), "ref", "at")
    return conflicts.join(picked, ["subject", "predicate"]).withColumn("accepted", F.col("object") == F.col("_chosen")).drop("_chosen")


def aliases(proposed: DataFrame) -> DataFrame:
    """(alias, entity, state) of proposals (alias, entity): an alias that points to several entities opens a conflict."""
    by = proposed.withColumn("alias", T.identity(F.col("alias"))).filter("alias <> ''").groupBy("alias").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity"))
    return by.select("alias", F.when(F.col("n") == 1, F.col("entity")).alias("entity"), F.when(F.col("n") == 1, "alias").otherwise("conflict").alias("state"))


def renames(names: DataFrame) -> DataFrame:
    """(id, canonical, accepted) of new names (id, old, new): only case, accents, blanks and signs may change."""
    same = (T.identity(F.col("old")) == T.identity(F.col("new"))) & (F.col("old") != F.col("new"))
    return names.select("id", F.when(same, F.col("new")).otherwise(F.col("old")).alias("canonical"), same.alias("accepted"))


def correction_level(field: Column, type_: Column, kind: Column, status: Column, confidence: Column, conflict: Column, safe: Column) -> Column:
    """What may happen with a correction: `review`, `suggest`, `assisted` or `automatic`.

    kind: seed (a fixed rule), alias, relation, ai or mismatch; safe: it can be undone, keeps the original and is logged.
    """
    known = status.isin("confirmed", "trusted")
    critical = field.isin(*CRITICAL_FIELDS) | type_.isin(*CRITICAL_TYPES) | kind.isin("relation", "mismatch")
    return (
        F.when(conflict | (status == "conflicted"), "review")
        .when(status == "rejected", "suggest")
        .when(kind == "mismatch", F.when(known, "review").otherwise("suggest"))
        .when(critical, F.when(known & (confidence >= ASSIST_MIN), "assisted").otherwise("suggest"))
        .when(kind == "ai", "suggest")
        .when(kind == "seed", F.when(safe, "automatic").otherwise("assisted"))
        .when((kind == "alias") & known & (confidence >= AUTO_MIN) & type_.isin(*AUTO_TYPES) & safe, "automatic")
        .when((kind == "alias") & (confidence >= ASSIST_MIN), "assisted")
        .otherwise("suggest")
    )


def merged_dictionary(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, code, source, verified, action) of two dictionaries (key, code, source, verified).

    A verified own row never changes; a verified incoming one replaces an unverified one; an empty code may be filled.
    """
    both = mine.select("key", *[F.col(c).alias(f"m_{c}") for c in ("code", "source", "verified")]).join(theirs.select("key", *[F.col(c).alias(f"t_{c}") for c in ("code", "source", "verified")]), "key", "full_outer")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    action = (
        F.when(F.col("m_verified").isNull(), "added").when(F.col("t_verified").isNull(), "own")
        .when(~F.col("m_verified") & F.col("t_verified"), "replaced").when(~F.col("m_verified") & blank("m_code") & ~blank("t_code"), "filled").otherwise("kept")
    )
    out = both.withColumn("action", action)
    taken = F.col("action").isin("added", "replaced")
    filled = F.when(F.col("action") == "filled", F.col("t_code"))
    pick = lambda c: F.when(taken, F.col(f"t_{c}")).otherwise(F.col(f"m_{c}"))
    source = F.when((F.col("action") == "filled") & blank("m_source"), F.col("t_source")).otherwise(pick("source"))
    return out.select("key", F.coalesce(filled, pick("code")).alias("code"), source.alias("source"), pick("verified").alias("verified"), "action")
