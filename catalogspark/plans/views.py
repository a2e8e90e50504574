"""Catalogue tables as views over the star-schema tables, and the same as DuckDB SQL.

Products are parts. Some fields are made dirty by rules on the part key, so that every check has rows to find.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.session import spread

PRODUCTS = """
SELECT p_partkey AS product_id, p_partkey AS seq,
  CASE WHEN p_partkey % 50 = 1 THEN concat(' p ', CAST(p_partkey - 1 AS STRING), ' ') WHEN p_partkey % 97 = 0 THEN '' ELSE concat('P-', CAST(p_partkey AS STRING)) END AS sku,
  CASE p_type WHEN 'ECONOMY' THEN 'med' WHEN 'LARGE' THEN 'dis' WHEN 'STANDARD' THEN 'cos' WHEN 'PROMO' THEN 'sup' WHEN 'SMALL' THEN 'beb' ELSE 'hig' END AS cat,
  CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_brand END AS marca,
  p_name AS producto,
  CASE WHEN p_partkey % 11 = 0 THEN concat('  ', CAST(p_size AS STRING), '  piezas') ELSE concat(CAST(p_size AS STRING), ' piezas') END AS contenido,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('Maker ', CAST(p_partkey % 7 AS STRING)) END AS fabricante,
  CASE WHEN p_partkey % 13 = 0 THEN 'quiza' WHEN p_partkey % 2 = 0 THEN 'si' ELSE 'no' END AS receta,
  CASE WHEN p_partkey % 19 = 0 THEN concat('-', CAST(p_size AS STRING)) WHEN p_partkey % 23 = 0 THEN 'alto' ELSE CAST(p_size AS STRING) END AS fps,
  CASE WHEN p_partkey % 29 = 0 THEN 'x' ELSE '' END AS otro,
  CASE WHEN p_partkey % 31 = 0 THEN 'sin asignar' ELSE '' END AS note,
  concat(p_brand, ' | ', p_name, ' | ', p_type, ' | ', CAST(p_size AS STRING), ' piezas') AS title,
  p_retailprice AS price, p_name AS principio, CAST(p_size % 5 AS STRING) AS concentracion, p_type AS forma
FROM part
"""
FIELDS = ("marca", "producto", "contenido", "fabricante", "receta", "fps", "otro", "principio", "concentracion", "forma")
#: The same in DuckDB.
PRODUCTS_DUCK = PRODUCTS.replace("AS STRING", "AS VARCHAR")
#: Captured fields as rows; only fields that are set are captured, and `otro` only where it has a value.
LONG_DUCK = "SELECT product_id, cat, field, value FROM (" + " UNION ALL ".join(f"SELECT product_id, cat, '{f}' AS field, {f} AS value FROM p" for f in FIELDS) + ") WHERE value <> ''"
FOLD_DUCK = "lower(strip_accents(coalesce({0}, '')))"


def clean_duck(c: str) -> str:
    return f"trim(regexp_replace({FOLD_DUCK.format(c)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def compact_duck(c: str) -> str:
    return f"replace({clean_duck(c)}, ' ', '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """products with the captured fields as columns and as the map v."""
    out = spark.sql(PRODUCTS.replace("FROM part", "FROM {part}"), part=spread(table(spark, sf_dir, "part"), "p_partkey"))
    pairs = F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), F.array(*FIELDS))
    return out.withColumn("v", F.map_filter(pairs, lambda _, x: x != ""))
