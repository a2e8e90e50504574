"""Queries over normal forms: fields in their kind's form, quantities moved to where they belong, forms with their packs."""

from pyspark.sql import functions as F

from catalogspark.operators import normalize
from catalogspark.plans.views import PRODUCTS_DUCK, products, table

KEEP = ["omron"]
#: Captured values that are not in normal form, as (category, field, value in SQL, normal form in SQL), for products of that category.
DIRTY = (
    ("med", "marca", "upper(producto)", "named"),
    ("med", "concentracion", "concat(n, 'MG')", "concat(n, ' mg')"),
    ("med", "forma", "'SOL INY'", "'Solución inyectable'"),
    ("med", "contenido", "concat('CAJ  C/', n, ' TAB')", "concat('Caja con ', n, CASE WHEN n = '1' THEN ' tableta' ELSE ' tabletas' END)"),
    ("med", "indicaciones", "concat('PARA ADULTOS. USAR CON ', upper(producto), ' Y AGUA')", "concat('Para adultos. Usar con ', producto, ' y agua')"),
    ("med", "atc", "' a10b x16 '", "'A10BX16'"),
    ("med", "receta", "receta", "receta"),
    ("dis", "modelo", "concat('HEM-', n)", "concat('HEM-', n)"),
    ("dis", "marca", "'OMRON  DE MEXICO'", "'OMRON de Mexico'"),
    ("dis", "presentacion", "concat('Caja con ', n, ' piezas')", "'Caja'"),
    ("dis", "contenido", "''", "concat(n, ' ', CASE WHEN n = '1' THEN 'pieza' ELSE 'piezas' END)"),
    ("cos", "tipo", "concat(producto, ' ', n, 'ml')", "producto"),
    ("cos", "contenido", "''", "concat(n, ' mL')"),
    ("cos", "beneficios", r"concat('  uno   dos ', chr(10), chr(10), ' ', producto)", r"concat('uno dos', chr(10), producto)"),
    ("sup", "componente", "concat(n, ' mL')", "producto"),
    ("sup", "contenido", "producto", "concat(n, ' mL')"),
    ("beb", "contenido", "concat('Caja con 12 latas de ', n, ',5 mL')", "concat('12 x ', n, '.5 mL')"),
    ("beb", "envase", "''", "'Caja con 12 latas'"),
    ("hig", "contenido", "concat('Frasco con bomba de ', n, ' mL')", "concat(n, ' mL')"),
    ("hig", "envase", "''", "'Frasco con bomba'"),
    ("hig", "fabricante", "'GEL PH 5 SA'", "'Gel pH 5 Sa'"),
)
_KEYS = list(dict.fromkeys(k for _, k, _, _ in DIRTY))


def _value(key: str, column: int) -> str:
    cases = " ".join(f"WHEN '{row[0]}' THEN {row[column]}" for row in DIRTY if row[1] == key)
    return f"CASE cat {cases} ELSE '' END"


def _dirty(spark, d):
    p = products(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_size").cast("string").alias("n")), "product_id")
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in _KEYS]), F.array(*[F.expr(_value(k, 2)) for k in _KEYS]))
    return p.select("product_id", "cat", F.map_filter(pairs, lambda _, x: x != "").alias("v"))


def normalize_fields(spark, d):
    out = normalize.normalize_fields(_dirty(spark, d), KEEP)
    return out.select("product_id", *[F.coalesce(F.col("v")[k], F.lit("")).alias(k) for k in _KEYS], F.size("v").cast("long").alias("n_fields"), F.size("changes").cast("long").alias("n_changes"))


def repair_swapped_fields(spark, d):
    out = normalize.repair_swapped_fields(_dirty(spark, d))
    return out.select("product_id", F.explode("repairs").alias("r")).select("product_id", "r.field", F.col("r.from").alias("from_value"), F.col("r.to").alias("to_value"))


QUERIES = {f.__name__: f for f in (normalize_fields, repair_swapped_fields)}
_P = f"WITH q AS ({PRODUCTS_DUCK}), p AS (SELECT q.*, p_size::VARCHAR AS n, list_aggregate(list_transform(string_split(producto, ' '), lambda w: upper(w[1:1]) || w[2:]), 'string_agg', ' ') AS named FROM q JOIN part ON p_partkey = product_id)"
_COUNT = {"med": (7, 6), "dis": (4, 3), "cos": (3, 2), "sup": (2, 2), "beb": (2, 2), "hig": (3, 3)}
ORACLE_SQL = {
    "normalize_fields": _P
    + " SELECT product_id, "
    + ", ".join(f"{_value(k, 3)} AS {k}" for k in _KEYS)
    + ", (CASE cat "
    + " ".join(f"WHEN '{c}' THEN {a}" for c, (a, _) in _COUNT.items())
    + " END)::BIGINT AS n_fields, (CASE cat "
    + " ".join(f"WHEN '{c}' THEN {b}" for c, (_, b) in _COUNT.items())
    + " END + CASE WHEN cat = 'dis' AND n = '1' THEN 1 ELSE 0 END + CASE WHEN cat = 'cos' THEN 1 WHEN cat = 'beb' THEN 1 ELSE 0 END)::BIGINT AS n_changes FROM p",
    "repair_swapped_fields": _P
    + """ SELECT product_id, unnest(f) AS field, unnest(a) AS from_value, unnest(b) AS to_value FROM (SELECT product_id,
CASE cat WHEN 'dis' THEN ['presentacion', 'contenido'] WHEN 'cos' THEN ['tipo', 'contenido'] WHEN 'sup' THEN ['componente', 'contenido'] WHEN 'beb' THEN ['envase', 'contenido'] WHEN 'hig' THEN ['envase', 'contenido'] ELSE [] END AS f,
CASE cat WHEN 'dis' THEN ['Caja con ' || n || ' piezas', 'Caja con ' || n || ' piezas'] WHEN 'cos' THEN [producto || ' ' || n || 'ml', producto || ' ' || n || 'ml'] WHEN 'sup' THEN [n || ' mL', producto]
  WHEN 'beb' THEN ['Caja con 12 latas de ' || n || ',5 mL', 'Caja con 12 latas de ' || n || ',5 mL'] WHEN 'hig' THEN ['Frasco con bomba de ' || n || ' mL', 'Frasco con bomba de ' || n || ' mL'] ELSE [] END AS a,
CASE cat WHEN 'dis' THEN ['Caja', n || ' piezas'] WHEN 'cos' THEN [producto, n || 'ml'] WHEN 'sup' THEN [producto, n || ' mL'] WHEN 'beb' THEN ['Caja con 12 latas', '12 x ' || n || ',5 mL'] WHEN 'hig' THEN ['Frasco con bomba', n || ' mL'] ELSE [] END AS b FROM p)""",
}
