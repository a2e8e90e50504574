"""Catalogue files: delimited text whose delimiter each file decides for itself, headers resolved to fields, rows classed.

Cells are (file, line, cells): a row of texts, where line orders the rows of a file and the first row with any text is the
header. Which column means what depends on the file's header and the row's category, so headers are resolved once for each
file and category, and rows look their columns up by place.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogspark.functions import text as T
from catalogspark.operators.schema import CATEGORIES, FIELDS
from catalogspark.sources.records import delimiter_of

# Further names of fields, names of the SKU's column, and signs of the columns of raw texts and images.
ALIASES = {
    "contenido": ("presentacion", "contenido neto", "piezas", "contenido piezas", "contenido o piezas"),
    "principio": ("principio activo", "sustancia activa"),
    "laboratorio": ("fabricante",),
    "via": ("via de administracion", "via administracion"),
    "tecnologia": ("zona de medicion", "tecnologia zona de medicion"),
    "receta": ("receta", "receta medica", "requiere receta"),
}
SKU_HEADERS = ("sku", "referencia", "referencia interna", "sku o referencia interna", "codigo", "codigo sku")
CATEGORY_HEADER, RAW_HEADER, IMAGE_HEADER = "categoria", "crud|sucio", "^(imagen|archivo de imagen|archivo imagen|base image)"
# Words by which a category is named, in the order in which they are tried.
CATEGORY_WORDS = (("dis", "dispositiv"), ("med", "medic"), ("cos", "dermo|derma|cosmet"), ("sup", "suplement"), ("beb", "bebida|hidrata"), ("hig", "higiene|personal"), ("acc", "accesorio|general"))
NO, YES = r"^(no|n|0|false|sin)(?![a-z0-9_])", r"^(si|s|yes|y|1|true|requiere|con)(?![a-z0-9_])"
LEVELS = {"baja": "Baja", "media": "Media", "alta": "Alta", "muy alta": "Muy alta"}
EXAMPLE = r"(?i)^ejemplo(?![A-Za-z0-9_])"
#: Pairs of file and category up to which resolved headers are broadcast.
FEW_HEADERS = 50_000


def header_key(c: Column) -> Column:
    """What headers are compared by: folded, only letters and digits of ASCII, single blanks."""
    return F.trim(F.regexp_replace(T.fold(c), "[^a-z0-9]+", " "))


def _normal(text: str) -> str:
    import re
    import unicodedata

    bare = "".join(x for x in unicodedata.normalize("NFD", text) if not "̀" <= x <= "ͯ").lower()
    return re.sub("[^a-z0-9]+", " ", bare).strip()


def lookup(cat: str) -> dict[str, str]:
    """Header key to field of a category: labels and keys first (later fields win), then aliases that are not taken."""
    out = {}
    for key, label, *_ in FIELDS[cat]:
        for name in (_normal(label), key.lower(), _normal(key)):
            out[name] = key
    for key, *_ in FIELDS[cat]:
        for name in ALIASES.get(key, ()):
            out.setdefault(name, key)
    return out


def category_of(c: Column) -> Column:
    """Category that a text names; null if none."""
    n = header_key(c)
    out = reduce(lambda acc, x: F.when(n.rlike(x[1]), x[0]).otherwise(acc), reversed(CATEGORY_WORDS), F.lit(None).cast("string"))
    return F.when(n == "", None).when(n.isin(*FIELDS), n).otherwise(out)


def yes_or_no(c: Column) -> Column:
    n = header_key(c)
    return F.when(n.rlike(NO), "no").when(n.rlike(YES), "si").otherwise("")


def read_cells(spark: SparkSession, path) -> DataFrame:
    """(file, line, cells) of delimited files, each read with the delimiter of its first line.

    Files are grouped by delimiter on the driver, as a file listing would be; quotes may hold delimiters and line breaks.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    first = lines.filter("at = 0").groupBy("file").agg(F.regexp_replace(F.min_by("value", "n"), "^﻿", "").alias("head")).withColumn("sep", delimiter_of(F.col("head")))
    groups = first.groupBy("sep").agg(F.collect_list("file").alias("files"), F.max(F.length("head") - F.length(F.expr("replace(head, sep, '')")) + 1).alias("width")).collect()
    none = spark.createDataFrame([], "file string, line long, cells array<string>")

    def read(g) -> DataFrame:
        names = [f"c{i}" for i in range(g.width)]
        rows = spark.read.schema(", ".join(f"{c} string" for c in names)).option("sep", g.sep).option("multiLine", True).option("quote", '"').option("escape", '"').csv(g.files)
        return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.array(*[F.coalesce(F.col(c), F.lit("")) for c in names]).alias("cells"))

    return reduce(lambda a, b: a.unionByName(b), map(read, groups), none)


def _header(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers (file, names, keys) and the other rows (file, n, cells), n counted as in the file, 2 being the first; rows without text are left out."""
    filled = cells.filter(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    placed = filled.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line")))  # a quoted file is read by one task anyway
    names = F.transform("cells", lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^﻿", "")))
    head = placed.filter("n = 1").select("file", names.alias("names")).withColumn("keys", F.transform("names", header_key))
    return head, placed.filter("n > 1").select("file", F.col("n").cast("long").alias("n"), "cells")


def _places(keys: Column) -> dict[str, Column]:
    """Where SKU, category, raw text and image stand (from 0, -1 if nowhere)."""
    first = lambda test: F.coalesce(F.array_position(F.transform(keys, test), True), F.lit(0)).cast("int") - 1
    return {"sku": first(lambda k: k.isin(*SKU_HEADERS)), "category": first(lambda k: k == CATEGORY_HEADER), "raw": first(lambda k: k.rlike(RAW_HEADER)), "image": first(lambda k: k.rlike(IMAGE_HEADER))}


def resolved_headers(head: DataFrame) -> DataFrame:
    """(file, cat, fields): for each file and category, the field of each column, null for what no field is called."""
    places = F.array(*_places(F.col("keys")).values())
    cases = F.array(*[F.struct(F.lit(c).alias("cat"), F.create_map(*[F.lit(x) for pair in lookup(c).items() for x in pair]).alias("of")) for c in FIELDS])
    return head.select("file", "keys", places.alias("taken"), F.explode(cases).alias("x")).select("file", "x.cat", F.transform("keys", lambda k, i: F.when(~F.array_contains(F.col("taken"), i), F.col("x.of")[k])).alias("fields"))


def map_headers(cells: DataFrame, default_cat: str | None = None) -> DataFrame:
    """(file, n, sku, img, cat, v map, raw, pending, error) of every row but examples.

    A row's category is what its category column names, else default_cat. Of several columns of a field the first that is
    not empty counts. A row without values but with a raw text is pending; else error says what is wrong.
    """
    head, rows = _header(cells)
    places = head.select("file", *[c.alias(f"at_{k}") for k, c in _places(F.col("keys")).items()])
    fields = resolved_headers(head).withColumnRenamed("cat", "of")
    few = fields.count() <= FEW_HEADERS
    hint = F.broadcast if few else (lambda x: x)
    at = lambda k: F.trim(F.coalesce(F.get("cells", F.col(f"at_{k}")), F.lit("")))
    named = rows.join(hint(places), "file").select("file", "n", "cells", *[at(k).alias(k) for k in ("sku", "category", "raw", "image")])
    named = named.filter(~F.col("sku").rlike(EXAMPLE)).withColumn("named", category_of(F.col("category")))
    unknown = (F.col("category") != "") & F.col("named").isNull()
    named = named.withColumns({"unknown": unknown, "of": F.when(~unknown, F.coalesce("named", F.lit(default_cat)))})
    both = named.join(hint(fields), ["file", "of"], "left")
    pairs = F.transform(F.arrays_zip(F.coalesce("fields", F.array().cast("array<string>")).alias("fields"), "cells"), lambda p: F.struct(p["fields"].alias("key"), F.trim(F.coalesce(p["cells"], F.lit(""))).alias("value")))
    pairs = F.filter(pairs, lambda p: p["key"].isNotNull() & (p["value"] != ""))
    both = both.withColumn("pairs", F.when(F.col("of").isNotNull(), pairs).otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    once = F.filter("pairs", lambda p, i: F.array_position(F.transform("pairs", lambda q: q["key"]), p["key"]) == i + 1)
    level = lambda v: F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[header_key(v)]
    read = F.transform(once, lambda p: F.struct(p["key"].alias("key"), F.when(p["key"].isin("receta", "especialidad"), yes_or_no(p["value"])).when(p["key"] == "nivel", level(p["value"])).otherwise(p["value"]).alias("value")))
    v = F.map_from_entries(F.filter(read, lambda p: F.coalesce(p["value"], F.lit("")) != ""))
    both = both.withColumn("v", v)
    empty = F.size("v") == 0
    pending = ~F.col("unknown") & empty & (F.col("raw") != "")
    error = (
        F.when(F.col("unknown"), F.concat(F.lit("Categoría no reconocida: "), "category"))
        .when(~empty | pending, "")
        .when(F.col("of").isNull(), "Sin categoría. Agrega la columna Categoría o elige una por defecto.")
        .otherwise("Fila sin datos del producto.")
    )
    cat = F.when(~empty | pending, F.col("of")).otherwise(F.col("named"))
    return both.select("file", "n", "sku", F.col("image").alias("img"), cat.alias("cat"), "v", "raw", pending.alias("pending"), error.alias("error"))


def ignored_headers(cells: DataFrame, default_cat: str | None = None) -> DataFrame:
    """(file, header) of named columns that are no field of any category that the file's rows have."""
    head, rows = _header(cells)
    at = head.select("file", _places(F.col("keys"))["sku"].alias("s"), _places(F.col("keys"))["category"].alias("c"))
    text = lambda k: F.trim(F.coalesce(F.get("cells", F.col(k)), F.lit("")))
    met = rows.join(at, "file").filter(~text("s").rlike(EXAMPLE)).select("file", F.when(text("c") == "", F.lit(default_cat)).otherwise(category_of(text("c"))).alias("cat")).distinct()
    used = resolved_headers(head).join(met, ["file", "cat"], "left_semi").select("file", F.posexplode("fields").alias("place", "field")).filter("field IS NOT NULL").select("file", "place").distinct()
    special = F.array(*_places(F.col("keys")).values())
    named = head.select("file", special.alias("special"), F.posexplode("names").alias("place", "header")).filter((F.col("header") != "") & ~F.array_contains("special", F.col("place")))
    return named.join(used, ["file", "place"], "left_anti").select("file", "header")


def skipped_examples(cells: DataFrame) -> DataFrame:
    """(file, skipped): how many example rows a file has."""
    head, rows = _header(cells)
    at = head.select("file", _places(F.col("keys"))["sku"].alias("s"))
    example = F.trim(F.coalesce(F.get("cells", F.col("s")), F.lit(""))).rlike(EXAMPLE)
    return rows.join(at, "file").groupBy("file").agg(F.count(F.when(example, 1)).alias("skipped"))


def ingest_catalog_csv(spark: SparkSession, path, default_cat: str | None = None) -> DataFrame:
    """The rows of catalogue files below a path, as `map_headers` has them."""
    return map_headers(read_cells(spark, path), default_cat)


def schema_table(spark: SparkSession) -> DataFrame:
    """(cat, place, header) of the template of each category: SKU, category, its fields' labels, image, raw text."""
    rows = [(c, i, h) for c in CATEGORIES for i, h in enumerate(["SKU", "Categoría", *[label for _, label, *_ in FIELDS[c]], "Imagen principal (opcional)", "Datos crudos (opcional)"])]
    return spark.createDataFrame(rows, "cat string, place int, header string")
