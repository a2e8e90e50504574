"""Queries over the provenance of fields and over bytes in one of two charsets."""

from pyspark.sql import functions as F

from catalogspark.operators import provenance, titles
from catalogspark.plans.views import LONG_DUCK, PRODUCTS_DUCK, products, table

K = "product_id"
FLAG = f"CASE {K} % 5 WHEN 0 THEN 'sugerido' WHEN 1 THEN 'imagen' WHEN 2 THEN 'confirmado' WHEN 3 THEN 'extraido' ELSE '' END"
#: Earlier state of a field, in SQL over (product_id, field, value); only two fields of some products have one.
BEFORE = {
    "source": f"CASE WHEN field = 'marca' AND {K} % 2 = 0 THEN CASE {K} % 5 WHEN 0 THEN 'ai' WHEN 1 THEN 'vision' WHEN 2 THEN 'ai-confirmed' WHEN 3 THEN 'ai' ELSE 'manual' END ELSE 'manual' END",
    "evidence": f"concat('e', CAST({K} AS STRING))",
    "original": f"CASE WHEN {K} % 7 = 0 THEN NULL ELSE 'first' END",
    "normalized": f"CASE WHEN {K} % 3 = 1 THEN value ELSE concat(value, '!') END",
    "updated_at": f"CASE WHEN {K} % 11 = 0 THEN NULL ELSE '2024-01-01' END",
}
MIXED = "CASE WHEN doc_id % 3 = 0 THEN concat(coalesce(text, ''), ' Ω señal “€”') WHEN doc_id % 3 = 1 THEN concat(coalesce(text, ''), ' fin') ELSE concat(coalesce(text, ''), ' ñ.') END"


def field_provenance(spark, d):
    p = products(spark, d)
    before = p.filter(f"{K} % 4 <> 0").select(K, F.explode("v").alias("field", "value")).filter("field IN ('marca', 'contenido')").select(K, "field", *[F.expr(sql).alias(c) for c, sql in BEFORE.items()])
    flagged = p.select(K, "v", F.create_map(F.lit("marca"), F.expr(FLAG)).alias("ai"))
    return provenance.field_provenance(flagged, before, F.lit("2025-01-01"))


def decode_mixed_charset(spark, d):
    """Texts as bytes, every third one in the legacy charset, and what they are read as."""
    docs = table(spark, d, "documents").select("doc_id", F.expr(MIXED).alias("t"))
    held = F.when(F.col("doc_id") % 3 == 2, titles.legacy_bytes(F.col("t"))["bytes"]).otherwise(F.encode("t", "UTF-8"))
    return docs.select("doc_id", provenance.decoded_text(held).alias("r")).select("doc_id", F.md5(F.encode("r.text", "UTF-8")).alias("text_md5"), "r.charset")


QUERIES = {f.__name__: f for f in (field_provenance, decode_mixed_charset)}

_SQL = lambda e: e.replace("AS STRING", "AS VARCHAR")
ORACLE_SQL = {
    "field_provenance": f"""WITH p AS ({PRODUCTS_DUCK}), l AS ({LONG_DUCK}), s AS (SELECT {K}, field, value, CASE WHEN field <> 'marca' THEN 'manual' ELSE CASE {K} % 5 WHEN 0 THEN 'ai' WHEN 1 THEN 'vision' WHEN 2 THEN 'ai-confirmed' WHEN 3 THEN 'ai' ELSE 'manual' END END AS source FROM l),
b AS (SELECT {K}, field, {", ".join(f"{_SQL(sql)} AS b_{c}" for c, sql in BEFORE.items())} FROM l WHERE {K} % 4 <> 0 AND field IN ('marca', 'contenido'))
SELECT {K}, field, source, coalesce(b_evidence, '') AS evidence, coalesce(b_original, value) AS original, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS normalized, CASE WHEN b_source = source AND b_normalized = value THEN coalesce(b_updated_at, '2025-01-01') ELSE '2025-01-01' END AS updated_at FROM s LEFT JOIN b USING ({K}, field)""",
    "decode_mixed_charset": f"""WITH d AS (SELECT doc_id, {MIXED} AS t FROM documents) SELECT doc_id, md5(CASE WHEN doc_id % 3 = 2 THEN regexp_replace(t, '[^\\x00-\\x7F\\x{{A0}}-\\x{{FF}}{"".join(titles.LEGACY)}]', '?', 'g') ELSE t END) AS text_md5, CASE WHEN doc_id % 3 = 2 THEN 'windows-1252' ELSE 'utf-8' END AS charset FROM d""",
}
