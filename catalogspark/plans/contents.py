"""Queries over content rules: outcomes, scores, dimensions and the summary of products with generated texts."""

from pyspark.sql import functions as F

from catalogspark.operators import content, language, rules
from catalogspark.plans.views import PRODUCTS_DUCK, products

K = "product_id"
#: Short description and long one of a product, in SQL; some lack what the rules ask for, some say what they must not.
MC = f"""CASE WHEN {K} % 10 = 0 THEN '' WHEN {K} % 8 = 3 THEN 'Texto general' ELSE concat(marca, ' ', producto,
  CASE {K} % 12 WHEN 5 THEN ' por definir' ELSE '' END, CASE {K} % 11 WHEN 2 THEN ', sin receta' WHEN 3 THEN ', requiere receta' ELSE '' END, CASE {K} % 13 WHEN 4 THEN ', el mejor' WHEN 6 THEN ', ideal' WHEN 8 THEN ', oferta' ELSE '' END) END"""
HTML = f"""CASE WHEN {K} % 6 = 1 THEN '' ELSE concat('<h2>', marca, ' ', producto, '</h2>', CASE WHEN {K} % 4 = 1 THEN '<p>' ELSE '<ul class="x"><li>' END, fabricante, ' ', forma, ' ', concentracion, ' ', CASE WHEN {K} % 7 = 0 THEN '' ELSE contenido END,
  CASE WHEN {K} % 4 = 1 THEN '</p>' ELSE '</li></ul>' END, CASE WHEN {K} % 9 = 0 THEN '<li><strong>Origen:</strong> </li>' ELSE '' END, CASE WHEN {K} % 2 = 0 THEN ' Consulte a su m&eacute;dico: consulte a su médico. Evite automedicarse' ELSE '' END, CASE WHEN {K} % 3 = 0 THEN ' Condiciones de conservación' ELSE '' END) END"""


def _texts(spark, d):
    return products(spark, d).withColumns({"mc": F.expr(MC), "html": F.expr(HTML)}).select("product_id", "cat", "v", "mc", "html")


def content_findings(spark, d):
    return content.findings(_texts(spark, d)).filter("state IN ('error', 'pendiente')").select("product_id", "rule", "dimension", "kind", "severity", "state", "lost")


def content_score(spark, d):
    return content.content_score(_texts(spark, d))


def content_dimensions(spark, d):
    """Points of each dimension over all products."""
    return rules.points(content.findings(_texts(spark, d)), "dimension").drop("infos")


def content_summary(spark, d):
    return rules.summary(content.content_score(_texts(spark, d)))


def lint_fields(spark, d):
    p = products(spark, d)
    v = F.map_concat(F.map_filter("v", lambda k, _: k != "contenido"), F.create_map(F.lit("contenido"), F.col("contenido"), F.lit("tipo"), F.when(F.col(K) % 3 == 0, "ideal").otherwise("medicinal"), F.lit("modo"), F.lit("ideal")))
    return language.lint_fields(p.select("product_id", "cat", v.alias("v")))


QUERIES = {f.__name__: f for f in (content_findings, content_score, content_dimensions, content_summary, lint_fields)}

#: Rule, dimension, weight, severity, kind, when it applies and when it fails on these products, worked out by hand.
_BY_HAND = (
    ("CMP-001", "completitud", 6, "error", "faltante", "true", "marca = '' OR cat IN ('dis', 'sup', 'beb')"),
    ("CMP-002", "completitud", 8, "warning", "faltante", "true", "cat NOT IN ('cos', 'sup')"),
    ("CMP-003", "completitud", 6, "warning", "faltante", "true", "cat = 'med' OR fabricante = ''"),
    ("FT-001", "fichaTecnica", 5, "error", "faltante", f"{K} % 6 <> 1", f"{K} % 4 = 1"),
    ("FT-002", "fichaTecnica", 6, "warning", "contenido", f"{K} % 6 <> 1", f"{K} % 7 = 0 AND cat <> 'dis'"),
    ("FT-003", "fichaTecnica", 4, "warning", "contenido", f"{K} % 6 <> 1", f"{K} % 9 = 0"),
    ("DES-001", "descripcion", 3, "error", "faltante", "true", f"{K} % 10 = 0"),
    ("DES-002", "descripcion", 4, "warning", "contenido", "marca <> ''", f"{K} % 10 <> 0 AND {K} % 8 = 3"),
    ("DES-003", "descripcion", 3, "warning", "contenido", "true", f"{K} % 10 <> 0 AND {K} % 8 <> 3 AND {K} % 12 = 5"),
    ("PRE-001", "presentacion", 5, "warning", "faltante", "true", "cat = 'dis'"),
    ("PRE-002", "presentacion", 5, "warning", "contenido", "cat IN ('med', 'sup')", "true"),
    ("COH-C02", "coherencia", 4, "error", "contradiccion", "cat = 'med'", f"{K} % 10 <> 0 AND {K} % 8 <> 3 AND (({K} % 11 = 2 AND receta = 'si') OR ({K} % 11 = 3 AND receta = 'no'))"),
    ("SEG-001", "seguridad", 5, "error", "faltante", "cat IN ('med', 'cos')", "cat = 'cos'"),
    ("SEG-002", "seguridad", 5, "warning", "contenido", f"cat = 'med' AND {K} % 6 <> 1", f"{K} % 2 <> 0"),
    ("SEG-003", "seguridad", 0, "info", "mejora", f"cat = 'med' AND {K} % 6 <> 1", f"{K} % 3 <> 0"),
    ("CLA-001", "claridad", 4, "warning", "contenido", "true", "false"),
    ("CLA-002", "claridad", 3, "warning", "contenido", "true", "false"),
    ("CLA-003", "claridad", 3, "warning", "contenido", "true", "false"),
    ("CLM-001", "claims", 6, "error", "contenido", "true", f"{K} % 10 <> 0 AND {K} % 8 <> 3 AND {K} % 13 = 4"),
    ("CLM-002", "claims", 4, "warning", "contenido", "true", f"{K} % 10 <> 0 AND {K} % 8 <> 3 AND ({K} % 13 = 6 OR (cat = 'med' AND {K} % 13 = 8))"),
)
_LOSS = {"error": 1.0, "warning": 0.5, "info": 0.0}
UNION = " UNION ALL ".join(
    f"SELECT {K}, '{i}' AS rule, '{dim}' AS dimension, '{kind}' AS kind, '{sev}' AS severity, CASE WHEN NOT ({applies}) THEN 'no_aplica' WHEN NOT ({fails}) THEN 'cumple' ELSE '{'error' if sev == 'error' else 'pendiente'}' END AS state, CASE WHEN {applies} THEN {float(w)}::DOUBLE ELSE 0 END AS possible, CASE WHEN ({applies}) AND ({fails}) THEN {w * _LOSS[sev]}::DOUBLE ELSE 0 END AS lost FROM p"
    for i, dim, w, sev, kind, applies, fails in _BY_HAND
)
_RESULTS = f"WITH p AS ({PRODUCTS_DUCK}), r AS ({UNION})"
_POINTS = "sum(possible) AS possible, sum(possible) - sum(lost) AS obtained, count(*) FILTER (state = 'error') AS errors, count(*) FILTER (state = 'pendiente' AND severity <> 'info') AS warnings"
_SCORED = f"{_RESULTS}, s AS (SELECT {K}, {_POINTS}, count(*) FILTER (state = 'pendiente' AND severity = 'info') AS infos FROM r GROUP BY {K}), t AS (SELECT *, floor(100 * obtained / possible + 0.5::DOUBLE)::INT AS score, CASE WHEN errors > 0 THEN 'critico' WHEN warnings > 0 THEN 'revisar' ELSE 'listo' END AS status FROM s)"
ORACLE_SQL = {
    "content_findings": f"{_RESULTS} SELECT {K}, rule, dimension, kind, severity, state, lost FROM r WHERE state IN ('error', 'pendiente')",
    "content_score": f"{_SCORED} SELECT * FROM t",
    "content_dimensions": f"{_RESULTS}, s AS (SELECT dimension, {_POINTS} FROM r GROUP BY dimension) SELECT *, floor(100 * obtained / possible + 0.5::DOUBLE)::INT AS score FROM s",
    "content_summary": f"{_SCORED} SELECT count(*) AS total, count(score) AS evaluated, count(*) FILTER (status = 'critico') AS critico, count(*) FILTER (status = 'revisar') AS revisar, count(*) FILTER (status = 'listo') AS listo, 0::BIGINT AS sin_evaluar, floor(avg(score) + 0.5::DOUBLE)::BIGINT AS average, min(score) AS least, max(score) AS greatest FROM t",
    "lint_fields": f"WITH p AS ({PRODUCTS_DUCK}) SELECT {K}, 'tipo' AS field, CASE WHEN {K} % 3 = 0 THEN 'subjective' ELSE 'medical' END AS list, CASE WHEN {K} % 3 = 0 THEN 'ideal' ELSE 'medicinal' END AS term FROM p WHERE cat IN ('dis', 'cos', 'beb', 'hig') AND ({K} % 3 = 0 OR cat = 'cos')",
}
