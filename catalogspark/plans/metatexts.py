"""Queries over meta texts: titles, descriptions and image texts from templates, within their limits."""

from functools import reduce

from pyspark.sql import functions as F

from catalogspark.functions.session import sealed
from catalogspark.operators import templates
from catalogspark.operators.schema import CATEGORIES
from catalogspark.plans.views import PRODUCTS_DUCK, products, table

STORE = "Farmacias Especializadas de Barrio"
#: Each product is written by the templates of one of these categories.
KINDS = ("med", "sup", "cos")
#: Values of the tokens, in SQL.
VALUES = {
    "marca": "marca",
    "concentracion": "concat(n, ' mg')",
    "principio": "producto",
    "laboratorio": "fabricante",
    "fabricante": "fabricante",
    "receta": "receta",
    "componente": "CASE WHEN product_id % 2 = 0 THEN concat(producto, ' de uso diario') ELSE producto END",
    "producto": "producto",
    "tipo": "CASE WHEN product_id % 4 = 1 THEN concat('crema ', producto) ELSE 'crema' END",
    "contenido": "concat(n, ' mL')",
    "sabor": "CASE WHEN product_id % 5 = 0 THEN 'Naranja' ELSE '' END",
    "atributo": "CASE WHEN product_id % 7 = 0 THEN 'Ácido hialurónico' ELSE '' END",
    "fps": "CASE WHEN product_id % 11 = 0 THEN '50+' ELSE '' END",
    "beneficio": "CASE WHEN product_id % 2 = 0 THEN 'Hidratación' ELSE '' END",
    "piel": "CASE WHEN product_id % 6 = 5 THEN 'Piel seca' ELSE '' END",
}


def _written(spark, d):
    p = products(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_size").cast("string").alias("n")), "product_id")
    p = p.select("product_id", *[F.expr(sql).alias(k) for k, sql in VALUES.items()])
    tokens = {c: templates.meta_tokens(c, {k: F.col(k) for k in VALUES}, F.lit(""), STORE, CATEGORIES[c]) for c in KINDS}
    of_kind = lambda c: F.col("product_id") % 3 == KINDS.index(c)
    # tokens and texts are columns below a seal: each is computed once a row, not again wherever it stands in a template or is read
    p = sealed(p.select("product_id", *[F.when(of_kind(c), t).alias(f"{c}_{k}") for c in KINDS for k, t in tokens[c].items()]))
    made = {c: templates.meta_texts(c, {k: F.col(f"{c}_{k}") for k in tokens[c]}, True) for c in KINDS}
    texts = reduce(lambda out, c: F.when(of_kind(c), made[c]).otherwise(out), KINDS[1:], made[KINDS[0]])
    return sealed(p.select("product_id", texts.alias("m")))


def render_meta(spark, d):
    of = lambda k: [F.col(f"m.{k}.text").alias(k), F.col(f"m.{k}.over").alias(f"{k}_over")]
    dropped = F.array_join(F.col("m.title.dropped"), " / ").alias("dropped")
    return _written(spark, d).select("product_id", *of("title"), *of("description"), *of("image"), dropped)


QUERIES = {"render_meta": render_meta}

_ONE = lambda *parts: "trim(regexp_replace(" + " || ' ' || ".join(parts) + ", '\\s+', ' ', 'g'))"
ORACLE_SQL = {
    "render_meta": f"""WITH q AS ({PRODUCTS_DUCK}), a AS (SELECT q.*, p_size::VARCHAR AS n, product_id % 3 AS shape FROM q JOIN part ON p_partkey = product_id),
b AS (SELECT product_id, shape, {", ".join(f"{sql} AS {k}" for k, sql in VALUES.items())} FROM a),
c AS (SELECT *, CASE WHEN product_id % 4 = 1 THEN producto || ' crema' ELSE producto || ' crema' END AS nombre, CASE WHEN fps <> '' THEN 'FPS 50+' WHEN atributo <> '' THEN 'con ácido hialurónico' ELSE '' END AS activo, concat_ws(', ', nullif(sabor, ''), contenido) AS variante,
  CASE WHEN beneficio <> '' AND piel <> '' THEN 'Hidratación para piel seca' WHEN beneficio <> '' THEN beneficio WHEN piel <> '' THEN 'Para piel seca' ELSE '' END AS ben FROM b),
t AS (SELECT *, CASE shape WHEN 0 THEN [concat_ws(' | ', {_ONE("'Comprar'", "marca", "concentracion")}, principio, nullif(laboratorio, ''))]
  WHEN 1 THEN [concat_ws(' | ', {_ONE("marca", "componente")}, variante, '{STORE}'), concat_ws(' | ', {_ONE("marca", "componente")}, variante), concat_ws(' | ', nullif(marca, ''), variante)]
  ELSE [concat_ws(' | ', {_ONE("marca", "nombre", "activo")}, variante, '{STORE}'), concat_ws(' | ', {_ONE("marca", "nombre", "activo")}, variante), concat_ws(' | ', {_ONE("marca", "nombre")}, variante)] END AS levels,
  CASE shape WHEN 0 THEN [] WHEN 1 THEN ['{STORE}', componente] ELSE ['{STORE}', activo] END AS parts,
  CASE shape WHEN 0 THEN concat_ws(' | ', {_ONE("'El'", "marca", "'de'", "concentracion", "'contiene'", "principio", "'por'", "laboratorio")}, CASE WHEN receta = 'si' THEN 'Venta en línea con receta médica de forma segura' ELSE 'Venta en línea de forma segura' END)
  WHEN 1 THEN concat_ws('. ', {_ONE("marca", "componente")} || ', ' || variante, nullif(fabricante, '')) || '.'
  ELSE concat_ws('. ', {_ONE("marca", "nombre", "activo")}, nullif(ben, ''), contenido, 'Compra en {STORE}') || '.' END AS description,
  CASE shape WHEN 0 THEN concat_ws(', ', {_ONE("marca", "concentracion")}, principio, contenido) WHEN 1 THEN concat_ws(', ', {_ONE("marca", "componente")}, contenido) ELSE concat_ws(', ', {_ONE("marca", "producto", "tipo")}, contenido) END AS image FROM c),
l AS (SELECT *, coalesce(list_position(list_transform(levels, lambda x: len(x) <= 60), true), len(levels)) AS k FROM t)
SELECT product_id, levels[k] AS title, len(levels[k]) > 60 AS title_over, description, len(description) > 155 AS description_over, image, len(image) > 125 AS image_over, array_to_string(list_filter(parts[1:k - 1], lambda x: x <> ''), ' / ') AS dropped FROM l"""
}
