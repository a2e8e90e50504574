"""Queries over catalogue files: headers resolved to fields, files with delimiters of their own, templates of columns."""

from pyspark.sql import functions as F

from catalogspark.functions.session import shared_dir
from catalogspark.operators.schema import FIELDS
from catalogspark.sources import catalogues
from catalogspark.plans.views import PRODUCTS_DUCK, products

#: Headers and their cells, in SQL. Rows go to one of three files by their product.
COLUMNS = (
    ("Codigo SKU", "CASE WHEN product_id % 101 = 0 THEN 'EJEMPLO 1' ELSE sku END"),
    ("Categoría", "CASE WHEN product_id % 8 = 0 THEN '' WHEN product_id % 9 = 0 THEN 'Inventada' WHEN cat = 'med' THEN 'Medicamentos' WHEN cat = 'cos' THEN 'Dermo y más' ELSE upper(cat) END"),
    ("Marca", "marca"),
    ("¿Requiere receta médica?", "CASE WHEN product_id % 5 = 0 THEN 'quizá' WHEN receta = 'si' THEN 'SÍ, con receta' ELSE 'No' END"),
    ("Contenido neto", "CASE WHEN product_id % 4 = 0 THEN '' ELSE concat(trim(contenido), '; \"x\", y') END"),
    ("Piezas", "'12'"),
    ("Otra columna", "otro"),
    ("Datos crudos", "producto"),
)
SEPARATORS = (",", ";", "\t")
FILE = "product_id % 3"


def _rows(spark, d):
    return products(spark, d).select(F.expr(FILE).alias("file"), "product_id", *[F.expr(sql).alias(name) for name, sql in COLUMNS])


def _cells(spark, d):
    rows = _rows(spark, d).select(F.col("file").cast("string").alias("file"), F.col("product_id").cast("long").alias("line"), F.array(*[F.col(f"`{name}`") for name, _ in COLUMNS]).alias("cells"))
    heads = rows.select("file").distinct().select("file", F.lit(-1).cast("long").alias("line"), F.array(*[F.lit(name) for name, _ in COLUMNS]).alias("cells"))
    return heads.unionByName(rows)


def _shown(rows):
    shown = [F.coalesce(F.col("v")[k], F.lit("")).alias(k) for k in ("marca", "receta", "contenido")]
    return rows.select("sku", F.coalesce("cat", F.lit("")).alias("cat"), *shown, F.size("v").cast("long").alias("n_fields"), "raw", "pending", "error")


def map_headers(spark, d):
    return _shown(catalogues.map_headers(_cells(spark, d)))


def ignored_headers(spark, d):
    return catalogues.ignored_headers(_cells(spark, d))


def ingest_catalog_csv(spark, d):
    """Writes the products as files of three delimiters to the shared folder and takes them in again."""
    path, rows = shared_dir(spark, "catalogue"), _rows(spark, d)
    for i, sep in enumerate(SEPARATORS):
        rows.filter(F.col("file") == i).drop("file", "product_id").write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(f"{path}/{i}")
    files = [f"{path}/{i}" for i in range(len(SEPARATORS))]
    return _shown(catalogues.ingest_catalog_csv(spark, files))


def schema_table(spark, d):
    """The template of each category that products have."""
    met = products(spark, d).groupBy("cat").agg(F.count("*").alias("products"))
    return catalogues.schema_table(spark).join(met, "cat").select("cat", F.col("place").cast("long").alias("place"), "header", "products")


QUERIES = {f.__name__: f for f in (map_headers, ignored_headers, ingest_catalog_csv, schema_table)}

_SQL = lambda e: e.replace("AS STRING", "AS VARCHAR")
_ROWS = f"""WITH p AS ({PRODUCTS_DUCK}), a AS (SELECT p.*, {_SQL(COLUMNS[0][1])} AS s, {_SQL(COLUMNS[1][1])} AS c, {_SQL(COLUMNS[3][1])} AS r, {_SQL(COLUMNS[4][1])} AS n FROM p),
b AS (SELECT trim(s) AS sku, c, producto AS raw, CASE WHEN c IN ('', 'Inventada') THEN '' ELSE cat END AS cat, marca, CASE WHEN cat <> 'med' OR r = 'quizá' THEN '' WHEN r = 'No' THEN 'no' ELSE 'si' END AS receta, CASE WHEN n = '' THEN '12' ELSE n END AS contenido FROM a WHERE s <> 'EJEMPLO 1')
SELECT sku, cat, CASE WHEN cat = '' THEN '' ELSE marca END AS marca, CASE WHEN cat = '' THEN '' ELSE receta END AS receta, CASE WHEN cat = '' THEN '' ELSE contenido END AS contenido,
(CASE WHEN cat = '' THEN 0 ELSE 1 + (marca <> '')::INT + (receta <> '')::INT END)::BIGINT AS n_fields, raw, c = '' AS pending, CASE WHEN c = 'Inventada' THEN 'Categoría no reconocida: Inventada' ELSE '' END AS error FROM b"""
_TEMPLATES = ", ".join(f"('{c}', {i}, '{h}')" for c, fields in FIELDS.items() for i, h in enumerate(["SKU", "Categoría", *[label for _, label, *_ in fields], "Imagen principal (opcional)", "Datos crudos (opcional)"]))
ORACLE_SQL = {
    "map_headers": _ROWS,
    "ingest_catalog_csv": _ROWS,
    "ignored_headers": f"WITH p AS ({PRODUCTS_DUCK}) SELECT DISTINCT ({FILE})::VARCHAR AS file, 'Otra columna' AS header FROM p",
    "schema_table": f"WITH p AS ({PRODUCTS_DUCK}), t(cat, place, header) AS (VALUES {_TEMPLATES}), n AS (SELECT cat, count(*) AS products FROM p GROUP BY cat) SELECT cat, place::BIGINT AS place, header, products FROM t JOIN n USING (cat)",
}
