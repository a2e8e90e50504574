"""Queries over raw one-line texts: category, attributes, what is left, rows worth another try."""

from pyspark.sql import functions as F

from catalogspark.operators import extraction
from catalogspark.plans.views import PRODUCTS_DUCK, products, table

#: One-line texts made from products, each of a shape whose parts are known.
RAW = """CASE product_id % 6
WHEN 0 THEN concat(upper(brand), ' ', upper(producto), ' ', CAST(size AS STRING), 'MG TAB  CAJ C/', CAST(size + 1 AS STRING), ' MAKER ', CAST(product_id % 7 AS STRING))
WHEN 1 THEN concat(upper(producto), ' ', CAST(size AS STRING), '.5MG/0.6ML SOL INY CAJ C/4 RX ', brand)
WHEN 2 THEN concat(brand, ' CREMA HIDRATANTE ', upper(producto), ' FCO ', CAST(size AS STRING), 'ML')
WHEN 3 THEN concat(brand, ' SUERO ORAL COCO ', CAST(size AS STRING), 'ML SIN AZUCAR; ', producto)
WHEN 4 THEN concat('Suplemento Vitamina C ', CAST(size AS STRING), ' mg gomitas sabor a limón ', brand, ' MAKER ', CAST(product_id % 7 AS STRING))
ELSE concat('ZZZ ', producto, ' ', CAST(size AS STRING)) END"""
SHOWN = ("marca", "laboratorio", "fabricante", "principio", "receta", "concentracion", "volumen", "forma", "contenido", "tipo", "componente", "atributo", "sabor")


def _texts(spark, d):
    p = products(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size")), "product_id")
    return p.select("product_id", F.expr(RAW).alias("raw_text"))


def _dictionary(spark, d):
    part = table(spark, d, "part")
    kind = lambda k, alias, canon: part.select(F.lit(k).alias("kind"), alias.alias("alias"), canon.alias("canon")).distinct()
    maker = F.concat(F.lit("maker "), (F.col("p_partkey") % 7).cast("string"))
    every = kind("brand", F.col("p_brand"), F.concat(F.lit("Casa "), "p_brand")).unionByName(kind("maker", maker, F.initcap(maker))).unionByName(kind("ingredient", F.col("p_name"), F.initcap("p_name")))
    return every.withColumn("seq", F.lit(0).cast("long"))


def _states(spark, d):
    return extraction.row_state(extraction.extract(_texts(spark, d), "product_id", "raw_text", _dictionary(spark, d)))


def detect_category(spark, d):
    return extraction.detect_category(_texts(spark, d), "product_id", "raw_text")


def extract_attributes(spark, d):
    shown = [F.coalesce(F.col("fields")[k], F.lit("")).alias(k) for k in SHOWN]
    return _states(spark, d).select("product_id", F.coalesce("cat", F.lit("")).alias("cat"), *shown, F.size("fields").cast("long").alias("n_fields"), F.array_join("notes", " ").alias("notes"), F.col("error").isNotNull().alias("failed"))


def unassigned_tokens(spark, d):
    return extraction.unassigned_tokens(_states(spark, d), "product_id").select("product_id", F.col("place").cast("long").alias("place"), "token")


def extraction_retry_candidates(spark, d):
    missing = (F.coalesce(F.col("fields")["marca"], F.lit("")) == "") | (F.coalesce(F.col("fields")["contenido"], F.lit("")) == "")
    return extraction.retry_candidates(_states(spark, d), "product_id", missing, F.col("product_id") % 10 == 0)


QUERIES = {f.__name__: f for f in (detect_category, extract_attributes, unassigned_tokens, extraction_retry_candidates)}

# The twin knows the parts that each text was made of.
_PARTS = f"""WITH p AS ({PRODUCTS_DUCK}), t AS (SELECT product_id, product_id % 6 AS shape, producto AS name, p_brand AS brand, p_size AS n, 'Maker ' || (product_id % 7) AS maker FROM p JOIN part ON p_partkey = product_id),
title AS (SELECT *, list_aggregate(list_transform(string_split(name, ' '), lambda w: upper(w[1:1]) || w[2:]), 'string_agg', ' ') AS named FROM t),
x AS (SELECT *, ['med', 'med', 'cos', 'beb', 'sup', ''][shape + 1] AS cat FROM title)"""
_LEFT = _PARTS + """, l AS (SELECT product_id, CASE shape WHEN 1 THEN [] WHEN 2 THEN string_split(upper(name), ' ') WHEN 3 THEN string_split(name, ' ') WHEN 5 THEN list_concat(['ZZZ'], list_append(string_split(name, ' '), n::VARCHAR)) WHEN 4 THEN ['Suplemento'] ELSE [] END AS w FROM x)"""
ORACLE_SQL = {
    "detect_category": _PARTS + " SELECT product_id, nullif(cat, '') AS cat, CASE WHEN false THEN '' END AS ambiguous FROM x",
    "extract_attributes": _PARTS
    + """ SELECT product_id, cat, CASE WHEN shape = 5 THEN '' ELSE 'Casa ' || brand END AS marca, CASE WHEN shape = 0 THEN maker ELSE '' END AS laboratorio, CASE WHEN shape = 4 THEN maker ELSE '' END AS fabricante,
CASE WHEN shape IN (0, 1) THEN named ELSE '' END AS principio, CASE WHEN shape = 1 THEN 'si' ELSE '' END AS receta, CASE shape WHEN 0 THEN n || ' mg' WHEN 1 THEN n || '.5 mg' ELSE '' END AS concentracion, CASE WHEN shape = 1 THEN '0.6 mL' ELSE '' END AS volumen,
CASE shape WHEN 0 THEN 'Tableta' WHEN 1 THEN 'Solución inyectable' WHEN 4 THEN 'Gomita' ELSE '' END AS forma,
CASE shape WHEN 0 THEN 'CAJ C/' || (n + 1) || ' tabletas' WHEN 1 THEN 'CAJ C/4' WHEN 2 THEN 'FCO ' || n || ' mL' WHEN 3 THEN n || ' mL' WHEN 4 THEN n || ' mg' ELSE '' END AS contenido,
CASE shape WHEN 2 THEN 'Crema hidratante' WHEN 3 THEN 'Suero oral' ELSE '' END AS tipo, CASE WHEN shape = 4 THEN 'Vitamina C' ELSE '' END AS componente, CASE WHEN shape = 3 THEN 'Sin azúcar' ELSE '' END AS atributo,
CASE shape WHEN 3 THEN 'Coco' WHEN 4 THEN 'Limón' ELSE '' END AS sabor, [6, 7, 3, 5, 6, 0][shape + 1]::BIGINT AS n_fields, '' AS notes, shape = 5 AS failed FROM x""",
    "unassigned_tokens": _LEFT + " SELECT product_id, unnest(range(len(w))) AS place, unnest(w) AS token FROM l",
    "extraction_retry_candidates": _LEFT + " SELECT product_id, CASE WHEN shape = 5 THEN 'error' ELSE 'leftover' END AS why FROM l JOIN x USING (product_id) WHERE product_id % 10 <> 0 AND (shape = 5 OR len(w) > 0)",
}
