"""Queries over derived texts: titles, short descriptions, units, store categories, the legacy charset."""

from pyspark.sql import functions as F

from catalogspark.operators import titles
from catalogspark.plans.decisions import COPY
from catalogspark.plans.views import FOLD_DUCK, PRODUCTS_DUCK, products, table

#: Names and types of which some repeat the brand or each other.
NAME = "CASE WHEN product_id % 4 = 0 THEN concat(marca, ' ', producto) ELSE producto END"
KIND = "CASE product_id % 5 WHEN 0 THEN forma WHEN 1 THEN upper(producto) WHEN 2 THEN concat(producto, ' extra') WHEN 3 THEN concat(marca, ' ', forma) ELSE '' END"
BULK = "concat('Caja con ', CAST(product_id % 90 AS STRING), ',5GRS de polvo, ', CAST(product_id % 7 AS STRING), '  ml/5 y ', CAST(product_id AS STRING), ',125 Kg; tubo', CAST(product_id % 3 AS STRING), 'l')"
STORE = "concat(CASE product_id % 8 WHEN 0 THEN 'Vitaminas y ' WHEN 1 THEN 'Con Receta ' WHEN 2 THEN 'Protección SOLAR ' WHEN 3 THEN 'Termómetros ' WHEN 4 THEN 'Antigripales ' WHEN 5 THEN 'Pañales ' WHEN 6 THEN 'Dermo receta ' ELSE '' END, producto)"
LEGACY = "concat(coalesce(text, ''), CASE WHEN doc_id % 3 = 0 THEN ' Ω → “precio” – 5 €' ELSE '' END)"
MOST_WORDS = 12


def _named(spark, d):
    p = products(spark, d).withColumns({"name": F.expr(NAME), "kind": F.expr(KIND)})
    return p, titles.deduped({"producto": F.col("name"), "tipo": F.col("kind")}, F.col("marca"))


def dedupe_fields(spark, d):
    p, clean = _named(spark, d)
    return p.select("product_id", *[c.alias(k) for k, c in clean.items()])


def build_title(spark, d):
    p, clean = _named(spark, d)
    p = p.withColumns(clean).withColumn("copy", F.expr(COPY))
    segments = [titles.segment(F.col("marca")), titles.segment(F.concat_ws(" ", F.col("copy"), F.when(F.col("tipo") != "", F.col("tipo")))), titles.segment(F.col("forma"), True), titles.segment(F.trim("contenido")), titles.segment(F.col("fabricante"), True)]
    p = p.withColumn("t", titles.title(segments)).withColumn("m", titles.missing({"Marca": F.col("marca"), "Contenido": F.col("contenido")}))
    return p.select("product_id", "t.title", F.array_join("t.dropped", ";").alias("dropped"), F.array_join("m", ";").alias("missing"))


def build_short_description(spark, d):
    by = F.when(F.col("fabricante") != "", F.concat(F.lit("hecho por "), "fabricante"))
    items = [("copy", F.expr(COPY), False), ("maker", by, True), ("content", F.trim("contenido"), False), ("form", F.concat(F.lit("forma: "), "forma"), True)]
    p = products(spark, d).withColumn("s", titles.short_description(items, MOST_WORDS))
    return p.select("product_id", "s.text", F.col("s.words").cast("long").alias("words"), F.array_join("s.dropped", ";").alias("dropped"))


def normalize_units(spark, d):
    return products(spark, d).select("product_id", titles.spaced_units(F.expr(BULK)).alias("bulk"))


def guess_store_kind(spark, d):
    return products(spark, d).select("product_id", titles.store_kind(F.expr(STORE)).alias("kind"))


def encode_legacy_charset(spark, d):
    docs = table(spark, d, "documents").withColumn("b", titles.legacy_bytes(F.expr(LEGACY)))
    return docs.select("doc_id", F.length("b.bytes").cast("long").alias("n_bytes"), F.col("b.lost").cast("long").alias("lost"), F.md5(F.hex("b.bytes").cast("binary")).alias("hex_md5"))


QUERIES = {f.__name__: f for f in (dedupe_fields, build_title, build_short_description, normalize_units, guess_store_kind, encode_legacy_charset)}

_DUCK = lambda e: e.replace("AS STRING", "AS VARCHAR")
_TOKENS = lambda c: f"list_filter(string_split_regex({FOLD_DUCK.format(c)}, '[^a-z0-9]+'), lambda x: x <> '')"
_BARE = lambda c: f"CASE WHEN marca <> '' AND starts_with({FOLD_DUCK.format(c)}, {FOLD_DUCK.format('marca')} || ' ') THEN trim(substr({c}, len(marca) + 1)) ELSE {c} END"
_CAP = lambda c: f"upper(({c})[1:1]) || ({c})[2:]"
_NAMED = f"""WITH p AS ({PRODUCTS_DUCK}), a AS (SELECT *, {NAME} AS name, {KIND} AS kind FROM p), b AS (SELECT *, {_BARE('name')} AS n, {_BARE('kind')} AS k FROM a),
c AS (SELECT *, {_TOKENS('n')} AS nt, {_TOKENS('k')} AS kt FROM b), d AS (SELECT *, len(kt) > 0 AND n <> '' AND list_has_all(nt, kt) AS twin, len(nt) > 0 AND k <> '' AND list_has_all(kt, nt) AS part FROM c),
e AS (SELECT * REPLACE (CASE WHEN part AND NOT twin THEN '' ELSE n END AS n, CASE WHEN twin THEN '' ELSE k END AS k) FROM d)"""
ORACLE_SQL = {
    "dedupe_fields": _NAMED + " SELECT product_id, n AS producto, k AS tipo FROM e",
    "build_title": _NAMED + f""", g AS (SELECT product_id, marca, fabricante, regexp_replace(trim(contenido), '\\s+', ' ', 'g') AS content, forma, contenido, trim(concat_ws(' ', {COPY.replace('(producto', '(n')}, nullif(k, ''))) AS body FROM e),
h AS (SELECT *, concat_ws(' | ', nullif({_CAP('marca')}, ''), nullif({_CAP('body')}, '')) AS front, {_CAP('forma')} AS f, {_CAP('fabricante')} AS m FROM g),
i AS (SELECT *, concat_ws(' | ', nullif(front, ''), f, content, nullif(m, '')) AS t0, concat_ws(' | ', nullif(front, ''), f, content) AS t1, concat_ws(' | ', nullif(front, ''), content) AS t2 FROM h)
SELECT product_id, CASE WHEN len(t0) <= 70 THEN t0 WHEN len(t1) <= 70 THEN t1 ELSE t2 END AS title, CASE WHEN len(t0) <= 70 THEN '' WHEN len(t1) <= 70 THEN m ELSE concat_ws(';', f, nullif(m, '')) END AS dropped,
concat_ws(';', CASE WHEN marca = '' THEN 'Marca' END, CASE WHEN contenido = '' THEN 'Contenido' END) AS missing FROM i""",
    "build_short_description": f"""WITH p AS ({PRODUCTS_DUCK}), a AS (SELECT product_id, {_CAP('trim(' + COPY + ')')} || '.' AS s1, CASE WHEN fabricante = '' THEN '' ELSE 'Hecho por ' || fabricante || '.' END AS s2, {_CAP('trim(contenido)')} || '.' AS s3, 'Forma: ' || forma || '.' AS s4 FROM p),
b AS (SELECT *, len(string_split_regex(s1, '\\s+')) + len(string_split_regex(s3, '\\s+')) AS n0, CASE WHEN s2 = '' THEN 0 ELSE len(string_split_regex(s2, '\\s+')) END AS w2, len(string_split_regex(s4, '\\s+')) AS w4 FROM a),
c AS (SELECT *, s2 <> '' AND n0 + w2 <= {MOST_WORDS} AS k2 FROM b), e AS (SELECT *, n0 + CASE WHEN k2 THEN w2 ELSE 0 END AS n2 FROM c), f AS (SELECT *, n2 + w4 <= {MOST_WORDS} AS k4 FROM e)
SELECT product_id, concat_ws(' ', s1, CASE WHEN k2 THEN s2 END, s3, CASE WHEN k4 THEN s4 END) AS text, n2 + CASE WHEN k4 THEN w4 ELSE 0 END AS words, concat_ws(';', CASE WHEN s2 <> '' AND NOT k2 THEN 'maker' END, CASE WHEN NOT k4 THEN 'form' END) AS dropped FROM f""",
    # the same text put together from its parts as they must come out
    "normalize_units": f"WITH p AS ({PRODUCTS_DUCK}) SELECT product_id, 'Caja con ' || (product_id % 90) || '.5 g de polvo, ' || (product_id % 7) || ' mL / 5 y ' || product_id || ',125 kg; tubo' || (product_id % 3) || ' L' AS bulk FROM p",
    "guess_store_kind": f"WITH p AS ({PRODUCTS_DUCK}), a AS (SELECT product_id, {FOLD_DUCK.format(STORE)} AS s FROM p) SELECT product_id, CASE " + " ".join(f"WHEN regexp_matches(s, '{r}') THEN '{k}'" for k, r in titles.STORE_KINDS) + " ELSE 'otro' END AS kind FROM a",
    "encode_legacy_charset": f"""WITH l AS (SELECT map({list(titles.LEGACY)}, {[ord(x) for x in titles.LEGACY.values()]}) AS m), a AS (SELECT doc_id, string_split({LEGACY}, '') AS c FROM documents),
b AS (SELECT doc_id, list_transform(c, lambda x: CASE WHEN unicode(x) < 128 OR unicode(x) BETWEEN 160 AND 255 THEN unicode(x) ELSE m[x] END) AS codes FROM a, l)
SELECT doc_id, len(codes) AS n_bytes, len(list_filter(codes, lambda x: x IS NULL)) AS lost, md5(coalesce(array_to_string(list_transform(codes, lambda x: printf('%02X', coalesce(x, 63)::INT)), ''), '')) AS hex_md5 FROM b""",
}
