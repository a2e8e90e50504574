"""Nutrition tables written as text lines: rows, and whether their energy agrees with protein, carbohydrates and fat."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Units and how they are written.
UNITS = {
    "g": "g", "mg": "mg", "mcg": "mcg", "µg": "mcg", "ug": "mcg", "kcal": "kcal", "cal": "kcal", "kj": "kJ", "ui": "UI", "iu": "UI", "ml": "mL", "l": "L", "%": "%", "mmol": "mmol",
    "meq": "mEq", "ufc": "UFC", "cfu": "CFU", "mosmol/l": "mOsmol/L", "mosmol/kg h2o": "mOsmol/kg H2O", "mosmol/kg": "mOsmol/kg",
}
# Names of portions, notes and of the nutrients that make up energy.
PORTION = r"(?iu)^(por\s+)?porci[oó]n(\s+de)?$|^tama[ñn]o\s+de\s+(la\s+)?porci[oó]n$|^(porciones?\s+por\s+envase|por\s+envase)$"
NOTE = r"(?iu)^de\s+(los|las|la|el)\s+(cuales?|cual)(?![A-Za-z0-9_])"
CAPTION = r"(?iu)^informaci[oó]n\s+nutri(?:mental|cional)\s*[:\-–]?\s*"
ENERGY = {
    "energy": r"(?iu)^(energ[ií]a|contenido energ[eé]tico|calor[ií]as|valor energ[eé]tico)",
    "protein": r"(?iu)^prote[ií]nas?(?![A-Za-z0-9_])",
    "carbohydrate": r"(?iu)^(carbohidratos?|hidratos de carbono)( total(?:es)?)?$",
    "fat": r"(?iu)^(grasas?|l[ií]pidos(?: \(grasas?\))?)( total(?:es)?)?$",
}
AMOUNT = r"^([<≤~]?\s*)(\d+(?:[.,]\d+)?)\s*(.+)$"


def capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def name_of(c: Column) -> Column:
    """A name in capitals alone becomes a sentence."""
    t = F.trim(c)
    return F.when((t == F.upper(t)) & t.rlike(r"\p{L}"), capital(F.lower(t))).otherwise(t)


def cell(c: Column) -> Column:
    """A plain amount gets a blank and the usual unit; any other text stays."""
    t = F.trim(c)
    written = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    unit = written[F.lower(F.regexp_replace(F.regexp_extract(t, AMOUNT, 3), r"\s+", " "))]
    return F.when(unit.isNotNull(), F.concat(F.regexp_extract(t, AMOUNT, 1), F.regexp_extract(t, AMOUNT, 2), F.lit(" "), unit)).otherwise(t)


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, kind, name, sub, cells) of every line that is not blank.

    kind: `head` (columns, in cells), `row`, `title`, `note`, `caption`, or a problem: `unnamed`, `portion`, `no-amount`.
    """
    t = F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")
    each = F.filter(F.transform(t, lambda x: F.trim(x)), lambda x: x != "")
    body = rows.select(key, F.posexplode(each).alias("line", "t"))
    head = (F.col("line") == 0) & F.startswith("t", F.lit("#"))
    body = body.select(key, "line", head.alias("head"), F.when(head, F.regexp_replace("t", r"^#+\s*", "")).otherwise(F.regexp_replace("t", r"^[-•–]\s*", "")).alias("t"), (~head & F.col("t").rlike(r"^[-•–]")).alias("sub"))
    bar = F.col("t").rlike(r"[|\t]")
    parts = F.split("t", r"\s*[|\t]\s*")
    cells = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")
    plain = F.regexp_replace("t", r"[:\s]+$", "")
    name = name_of(F.regexp_replace(F.get(parts, 0), r"[:\s]+$", ""))
    kind = (
        F.when(F.col("head"), "head").when(~bar & plain.rlike(NOTE), "note").when(~bar, "title")
        .when(name == "", "unnamed").when(name.rlike(PORTION), "portion").when(F.size(cells) == 0, "no-amount").otherwise("row")
    )
    out = body.select(key, "line", kind.alias("kind"), plain.alias("plain"), name.alias("name"), "sub", F.when(F.col("head"), parts).otherwise(F.transform(cells, cell)).alias("cells"))
    # a text before any row, title or note is the caption
    opens = F.when(F.col("kind").isin("row", "note", "title"), F.struct("line", "kind"))
    out = out.withColumn("first", F.min(opens).over(Window.partitionBy(key)))  # a window, so that lines are read once
    captioned = out.withColumn("kind", F.when(F.col(key).isNotNull() & (F.col("kind") == "title") & (F.col("first.line") == F.col("line")), "caption").otherwise(F.col("kind")))
    shown = F.when(F.col("kind") == "caption", capital(F.trim(F.regexp_replace("plain", CAPTION, "")))).when(F.col("kind") == "note", F.col("plain")).when(F.col("kind") == "title", name_of(F.col("plain"))).when(F.col("kind") == "head", "").otherwise(F.col("name"))
    return captioned.select(key, "line", "kind", shown.alias("name"), "sub", "cells")


def energy_gaps(table: DataFrame, key: str) -> DataFrame:
    """(key, column, declared, expected) of value columns of `lines` whose energy is off by more than 10 kcal and 20 %: 4 kcal a gram of protein and carbohydrates, 9 of fat."""
    kind = F.lit(None).cast("string")
    for name, pattern in ENERGY.items():
        kind = F.when(F.col("name").rlike(pattern), name).otherwise(kind)
    rows = table.filter("kind = 'row' AND NOT sub").withColumn("what", kind).filter("what IS NOT NULL")
    rows = rows.groupBy(key, "what").agg(F.min_by("cells", "line").alias("cells"))  # the first row of a name counts
    unit = F.when(F.col("what") == "energy", "kcal").otherwise("g")
    each = rows.select(key, "what", unit.alias("unit"), F.posexplode("cells").alias("column", "c"))
    c = F.when(F.col("what") == "energy", F.regexp_replace("c", r"\s*\(.*$", "")).otherwise(F.col("c"))
    number = F.when(F.regexp_extract(c, r"^(\d+(?:[.,]\d+)?) (\S+)$", 2) == F.col("unit"), F.replace(F.regexp_extract(c, r"^(\d+(?:[.,]\d+)?) (\S+)$", 1), F.lit(","), F.lit(".")).cast("double"))
    of = lambda w: F.max(F.when(F.col("what") == w, F.col("n")))
    sums = each.withColumn("n", number).groupBy(key, "column").agg(of("energy").alias("declared"), (4 * of("protein") + 4 * of("carbohydrate") + 9 * of("fat")).alias("expected"))
    return sums.filter(F.abs(F.col("declared") - F.col("expected")) > F.greatest(F.lit(10.0), F.col("expected") * 0.2))
