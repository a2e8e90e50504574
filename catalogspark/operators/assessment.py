"""What the learnt knowledge says of each captured field: known, new, in conflict, and what it would be called."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators import facts, knowledge

# The type of entity that each field names, types that are never corrected without a person, types that are not looked up.
FIELD_TYPES = {
    "marca": "brand", "principio": "substance", "componente": "substance", "laboratorio": "laboratory", "fabricante": "manufacturer", "forma": "pharmaceuticalForm", "concentracion": "concentration",
    "contenido": "presentation", "paquete": "presentation", "presentacion": "presentation", "tipo": "subcategory", "categoria": "storeCategory", "via": "route", "receta": "prescription",
}
CRITICAL_TYPES = ("substance", "concentration", "laboratory", "brand", "manufacturer", "route", "prescription")
NOT_LOOKED_UP = ("route", "prescription")
#: Entities of a type from which on a value that is not among them is unknown, not merely new.
MATURE = 20
STATES = {"trusted": "trusted", "confirmed": "confirmed", "conflicted": "conflict", "rejected": "rejected"}


def assess_products(products: DataFrame, entities: DataFrame, aliases: DataFrame, mature: int = MATURE) -> DataFrame:
    """(product_id, field, type, typed, state, entity_id, via, canonical, suggested) of every captured field that names an entity.

    state: unknown (also a strength without value and unit), new, known, confirmed, trusted, conflict or rejected. suggested: the
    canonical spelling where it differs from what was typed; never for presentations or rejected entities. Equal values are
    looked up once, whatever the number of products that have them. products: (product_id, v); entities: (id, type, canonical, normalized,
    status); aliases: (type, normalized_alias, entity_id, status).
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("type")) for f, t in FIELD_TYPES.items() if t not in NOT_LOOKED_UP])
    each = products.select("product_id", "v", F.explode(fields).alias("x")).select("product_id", "x.*", F.trim(F.coalesce(F.element_at("v", F.col("x.field")), F.lit(""))).alias("typed")).filter("typed <> ''")
    value = F.when(F.col("type") == "concentration", facts.strength(F.col("typed"))).when(F.col("type") == "presentation", facts.pack(F.col("typed"))["canonical"]).otherwise(F.col("typed"))
    each = each.withColumn("value", value)
    found = knowledge.resolved(each.filter("value IS NOT NULL"), entities, aliases).filter("entity_id IS NOT NULL")
    named = found.join(entities.select(F.col("id").alias("entity_id"), "canonical", "status"), "entity_id")
    many = entities.groupBy("type").agg((F.count("*") >= mature).alias("mature"))
    both = each.join(named, ["type", "value"], "left").join(many, "type", "left")
    state = F.lit("known")
    for status, name in STATES.items():
        state = F.when(F.col("status") == status, name).otherwise(state)
    state = F.when(F.col("value").isNull(), "unknown").when(F.col("entity_id").isNotNull(), state).when(F.coalesce("mature", F.lit(False)), "unknown").otherwise("new")
    differs = F.col("entity_id").isNotNull() & (F.trim("canonical") != F.col("typed")) & (F.col("type") != "presentation") & (F.col("status") != "rejected")
    return both.select("product_id", "field", "type", "typed", state.alias("state"), "entity_id", "via", "canonical", F.when(differs, F.col("canonical")).alias("suggested"))


def knowledge_issues(assessed: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """(product_id, field, code, severity): what an assessment tells the checks of quality. checks: verdicts of `knowledge.checked` (product_id, verdict, strong)."""
    code = F.when((F.col("state") == "unknown") & F.col("type").isin(*CRITICAL_TYPES), "knowledge-unknown").when(F.col("state") == "conflict", "knowledge-conflict").when(F.col("state") == "rejected", "knowledge-rejected")
    out = assessed.select("product_id", "field", code.alias("code"), F.lit("warning").alias("severity")).filter("code IS NOT NULL")
    if checks is None:
        return out
    wrong = checks.filter("verdict = 'mismatch'")
    severity: Column = F.when(F.coalesce("strong", F.lit(False)), "error").otherwise("warning")
    return out.unionByName(wrong.select("product_id", F.lit("laboratorio").alias("field"), F.lit("knowledge-mismatch").alias("code"), severity.alias("severity")))
