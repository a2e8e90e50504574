"""Queries over the batch file: its rows under the contract of 104 columns, its relations, its counters and its round trip."""

from pyspark.sql import functions as F

from catalogspark.functions.session import shared_dir
from catalogspark.operators import export
from catalogspark.plans.contents import HTML
from catalogspark.plans.views import PRODUCTS_DUCK, products

K = "product_id"
#: What other jobs made of a product, in SQL.
INPUTS = {
    "sku": f"CASE WHEN {K} % 20 = 7 THEN concat(' p-', CAST({K} - 1 AS STRING)) ELSE sku END",
    "img": f"CASE WHEN {K} % 4 = 0 THEN ' ' ELSE concat('img/', CAST({K} AS STRING), '.jpg') END",
    "html": HTML,
    "title": "concat(producto, ', ', contenido)",
    "meta_title": "concat(marca, ', ', producto)",
    "meta_description": "concat(producto, chr(10), ' por ', fabricante)",
    "image_text": f"CASE WHEN {K} % 5 = 0 THEN '' ELSE concat(marca, ', ', producto) END",
    "blocked": "cat = 'med' AND receta = 'quiza'",
    "incomplete": "marca = ''",
    "unconfirmed": f"{K} % 10 = 3",
    "worded": f"{K} % 13 = 6",
    "confirmed": "cat = 'med'",
}


def _rows(spark, d):
    return products(spark, d).select(F.col(K).alias("seq"), *[F.expr(sql).alias(k) for k, sql in INPUTS.items()])


def _relations(spark, d):
    p = products(spark, d).filter(f"{K} % 3 = 0")
    other = lambda i, step: F.concat(F.lit("P-"), (F.col(K) + i * step).cast("string"))
    each = [F.struct(F.lit("upsell").alias("kind"), F.lit(i).alias("rank"), other(i, 1).alias("other")) for i in range(1, 7)] + [F.struct(F.lit("crosssell").alias("kind"), F.lit(i).alias("rank"), other(i, 10).alias("other")) for i in range(1, 7)]
    return p.select("sku", F.explode(F.array(*each)).alias("r")).select("sku", "r.*")


def _known(spark, d):
    return products(spark, d).filter(f"{K} % 17 = 0").select("sku")


def export_batch_104(spark, d):
    out = export.batch(_rows(spark, d), _relations(spark, d), known=_known(spark, d))
    return out.withColumn("place", F.col("place").cast("long"))


def effective_relations(spark, d):
    kept = export.survivors(_rows(spark, d))
    return export.allowed_relations(_relations(spark, d), kept, _known(spark, d)).select("key", "kind", F.array_join("others", "|").alias("others"))


def batch_counters(spark, d):
    return export.counters(_rows(spark, d), without_language=True)


def csv_round_trip(spark, d):
    """How many rows of the batch come back as they were written, and how many do not."""
    rows = export.batch(_rows(spark, d))
    bad = export.round_trip(rows, shared_dir(spark, "batch"))
    return rows.select("sku").join(bad.select("sku").distinct(), "sku", "left_anti").select(F.lit("same").alias("result")).unionByName(bad.select(F.col("problem").alias("result"))).groupBy("result").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (export_batch_104, effective_relations, batch_counters, csv_round_trip)}

_SQL = lambda e: e.replace("AS STRING", "AS VARCHAR")
_JUDGED = f"""WITH p AS ({PRODUCTS_DUCK}), a AS (SELECT {K} AS seq, p.sku AS own_sku, {", ".join(f"{_SQL(sql)} AS i_{k}" for k, sql in INPUTS.items())} FROM p),
j AS (SELECT *, lower(trim(i_sku)) AS key, CASE WHEN trim(i_sku) = '' THEN 'no_sku' WHEN i_unconfirmed THEN 'unconfirmed' WHEN i_blocked THEN 'blocked' WHEN i_incomplete THEN 'incomplete' END AS reason FROM a)"""
_KEPT = _JUDGED + """, k AS (SELECT *, min(seq) OVER (PARTITION BY key) AS place, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM j WHERE reason IS NULL), s AS (SELECT * FROM k WHERE n = 1)"""
_RELATED = _KEPT + f""", o AS (SELECT lower(trim(sku)) AS key, 'upsell' AS kind, i AS rank, 'P-' || ({K} + i) AS other FROM p, range(1, 7) r(i) WHERE {K} % 3 = 0 UNION ALL SELECT lower(trim(sku)), 'crosssell', i, 'P-' || ({K} + 10 * i) FROM p, range(1, 7) r(i) WHERE {K} % 3 = 0),
w AS (SELECT o.*, row_number() OVER (PARTITION BY o.key, kind ORDER BY rank, other) AS m FROM o WHERE key IN (SELECT key FROM s) AND lower(other) IN (SELECT key FROM s UNION SELECT lower(trim(sku)) FROM p WHERE {K} % 17 = 0)),
e AS (SELECT key, kind, string_agg(other, '|' ORDER BY m) AS others FROM w WHERE m <= 4 OR kind = 'crosssell' GROUP BY key, kind)"""
_CELL = lambda c: f"replace(trim(regexp_replace(regexp_replace({c}, '[\\r\\n\\t]+', ' ', 'g'), '\\s{{2,}}', ' ', 'g')), ',', ';')"
_FILLED = {
    "sku": "trim(i_sku)",
    "description": _CELL("i_html"),
    "additional_attributes": "'categoria_prod=' || " + _CELL("i_title"),
    "short_description": f"CASE WHEN i_confirmed THEN {_CELL('i_meta_description')} ELSE '' END",
    "meta_title": f"CASE WHEN i_confirmed THEN {_CELL('i_meta_title')} ELSE '' END",
    "meta_description": f"CASE WHEN i_confirmed THEN {_CELL('i_meta_description')} ELSE '' END",
    "base_image": "trim(i_img)",
    "base_image_label": _CELL("i_image_text"),
    "upsell_skus": "coalesce((SELECT others FROM e WHERE e.key = s.key AND kind = 'upsell'), '')",
    "crosssell_skus": "coalesce((SELECT others FROM e WHERE e.key = s.key AND kind = 'crosssell'), '')",
} | {c: "'1'" for c in export.ONES}
ORACLE_SQL = {
    "export_batch_104": _RELATED + " SELECT place, " + ", ".join(f"{_FILLED.get(c, chr(39) * 2)} AS {c}" for c in export.COLUMNS) + " FROM s",
    "effective_relations": _RELATED + " SELECT key, kind, others FROM e",
    "batch_counters": _JUDGED
    + """, q AS (SELECT *, CASE WHEN reason IS NULL AND i_worded THEN 'language' ELSE reason END AS why FROM j), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM q WHERE why IS NULL)
SELECT (SELECT count(*) FROM q) AS total, """
    + ", ".join(f"(SELECT count(*) FROM q WHERE why = '{r.replace('-', '_')}') AS {r.replace('-', '_')}" for r in export.REASONS)
    + ", count(*) FILTER (n = 1) AS exported, count(*) FILTER (n > 1) AS replaced, count(*) FILTER (n = 1 AND NOT i_confirmed) AS without_meta, count(*) FILTER (n = 1 AND trim(i_img) = '') AS without_image FROM k",
    "csv_round_trip": _KEPT + " SELECT 'same' AS result, count(*) AS n FROM s",
}
