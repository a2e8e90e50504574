"""Queries over what the knowledge says of products."""

from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.operators import assessment
from catalogspark.plans.views import PRODUCTS_DUCK, products, table

STATUS = "CASE length(name) % 5 WHEN 0 THEN 'trusted' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'conflicted' WHEN 3 THEN 'rejected' ELSE 'observed' END"
#: Entities in SQL over `part`: brands under another spelling, every second name as a substance, two forms, makers of three numbers.
ENTITIES = f"""SELECT DISTINCT type, name, {STATUS} AS status FROM (
SELECT 'brand' AS type, upper(p_brand) AS name FROM part UNION ALL SELECT 'substance', p_name FROM part WHERE length(p_name) % 2 = 0 AND NOT p_name LIKE '%ring' UNION ALL SELECT 'pharmaceuticalForm', p_type FROM part WHERE p_type IN ('LARGE', 'PROMO')
UNION ALL SELECT 'manufacturer', concat('Maker ', CAST(p_partkey % 3 AS STRING)) FROM part UNION ALL SELECT 'substance', concat('Metal ', regexp_extract(p_name, '[a-z]+$', 0)) FROM part WHERE p_name LIKE '%ring' OR p_name LIKE '%rod')"""


def _knowledge(spark, d):
    part = table(spark, d, "part")
    entities = spark.sql(ENTITIES.replace("FROM part", "FROM {part}"), part=part).select("type", F.col("name").alias("canonical"), T.identity(F.col("name")).alias("normalized"), "status", F.concat_ws(":", "type", "name").alias("id"))
    of = lambda end, status: part.filter(F.col("p_name").endswith(end)).select(F.lit("substance").alias("type"), T.identity(F.col("p_name")).alias("normalized_alias"), F.lit(f"substance:Metal {end}").alias("entity_id"), F.lit(status).alias("status")).distinct()
    return entities, of("ring", "confirmed").unionByName(of("rod", "suggested"))


def assess_products(spark, d):
    out = assessment.assess_products(products(spark, d), *_knowledge(spark, d))
    return out.select("product_id", "field", "typed", "state", F.coalesce("via", F.lit("")).alias("via"), F.coalesce("suggested", F.lit("")).alias("suggested"))


def knowledge_issues(spark, d):
    p = products(spark, d)
    verdicts = p.select("product_id", F.when(F.col("product_id") % 9 == 0, "mismatch").otherwise("match").alias("verdict"), (F.col("product_id") % 2 == 0).alias("strong"))
    return assessment.knowledge_issues(assessment.assess_products(p, *_knowledge(spark, d)), verdicts)


QUERIES = {f.__name__: f for f in (assess_products, knowledge_issues)}

_A = f"""WITH p AS ({PRODUCTS_DUCK}), e AS ({ENTITIES.replace('AS STRING', 'AS VARCHAR')}),
v AS (SELECT product_id, unnest(['marca', 'principio', 'fabricante', 'forma', 'concentracion', 'contenido']) AS field, unnest(['brand', 'substance', 'manufacturer', 'pharmaceuticalForm', 'concentration', 'presentation']) AS type, unnest([marca, principio, fabricante, forma, concentracion, trim(contenido)]) AS typed FROM p),
f AS (SELECT *, CASE WHEN type = 'substance' AND typed LIKE '%ring' THEN 'Metal ring' WHEN type = 'substance' AND typed LIKE '%rod' AND length(typed) % 2 = 1 THEN 'Metal rod' WHEN type = 'brand' THEN upper(typed) ELSE typed END AS name FROM v WHERE typed <> ''),
a AS (SELECT product_id, field, f.type, typed, e.name AS canonical, status, CASE WHEN e.name IS NULL THEN '' WHEN e.name LIKE 'Metal%' THEN 'alias' ELSE 'exact' END AS via,
  CASE WHEN e.name IS NULL THEN CASE WHEN f.type = 'concentration' OR (f.type IN ('brand', 'substance') AND (SELECT count(*) FROM e x WHERE x.type = f.type) >= 20) THEN 'unknown' ELSE 'new' END
    ELSE CASE status WHEN 'conflicted' THEN 'conflict' WHEN 'observed' THEN 'known' ELSE status END END AS state FROM f LEFT JOIN e ON e.type = f.type AND e.name = f.name)"""
ORACLE_SQL = {
    "assess_products": _A + " SELECT product_id, field, typed, state, via, CASE WHEN canonical IS NOT NULL AND canonical <> typed AND status <> 'rejected' THEN canonical ELSE '' END AS suggested FROM a",
    "knowledge_issues": _A
    + """ SELECT product_id, field, CASE state WHEN 'unknown' THEN 'knowledge-unknown' WHEN 'conflict' THEN 'knowledge-conflict' ELSE 'knowledge-rejected' END AS code, 'warning' AS severity FROM a WHERE state IN ('conflict', 'rejected') OR (state = 'unknown' AND type IN ('brand', 'substance', 'manufacturer', 'concentration'))
UNION ALL SELECT product_id, 'laboratorio', 'knowledge-mismatch', CASE WHEN product_id % 2 = 0 THEN 'error' ELSE 'warning' END FROM p WHERE product_id % 9 = 0""",
}
