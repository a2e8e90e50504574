"""Reading foreign layouts: matrices with a header row, API payloads, renamed fields, delimited text; feeds and their checks."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix_to_rows(cells: DataFrame) -> DataFrame:
    """(sheet, row, data map) of sheets given as (sheet, row, cells array), row 0 being the header.

    A blank header becomes col_i; rows without any value are dropped.
    """
    header = cells.filter("row = 0").select("sheet", F.transform("cells", lambda h, i: F.when(F.trim(F.coalesce(h, F.lit(""))) == "", F.concat(F.lit("col_"), i + 1)).otherwise(F.trim(h))).alias("header"))
    rows = cells.filter("row > 0").join(header, "sheet")
    pairs = F.arrays_zip("header", "cells")
    data = F.map_from_entries(F.filter(F.transform(pairs, lambda p: F.struct(p["header"], F.coalesce(p["cells"], F.lit("")).alias("v"))), lambda p: p["header"].isNotNull()))
    return rows.select("sheet", "row", data.alias("data")).filter(F.exists(F.map_values("data"), lambda v: F.trim(v) != ""))


# Names under which payloads carry their records, in order.
WRAPPERS = ("data", "items", "results", "rows", "records")


def unwrap_payload(rows: DataFrame, payload: str) -> DataFrame:
    """One row a record (as JSON text): a top-level array, or the first array among the known names, or the object itself."""
    c = F.col(payload)
    arrays = [F.when(F.startswith(F.ltrim(F.get_json_object(c, f"$.{w}")), F.lit("[")), F.get_json_object(c, f"$.{w}")) for w in WRAPPERS]
    inner = F.when(F.startswith(F.ltrim(c), F.lit("[")), c).otherwise(F.coalesce(*arrays, F.concat(F.lit("["), c, F.lit("]"))))
    records = F.from_json(inner, "array<variant>")
    return rows.withColumn("record", F.explode(records)).withColumn("record", F.to_json("record"))


def project_fields(rows: DataFrame, names: dict[str, str], data: str = "data") -> DataFrame:
    """Maps renamed by target -> source; fields that a record lacks are not invented."""
    back = F.create_map(*[F.lit(x) for target, source in names.items() for x in (source, target)])
    kept = F.map_filter(data, lambda k, _: F.map_contains_key(back, k))
    return rows.withColumn(data, F.transform_keys(kept, lambda k, _: back[k]))


def delimiter_of(header: Column) -> Column:
    """Semicolon if it beats the comma and is not beaten by the tab, else the tab if it beats the comma, else the comma."""
    n = lambda ch: F.length(header) - F.length(F.replace(header, F.lit(ch), F.lit("")))
    return F.when((n(";") > n(",")) & (n(";") >= n("\t")), ";").when(n("\t") > n(","), "\t").otherwise(",")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header and quotes; blank rows and example rows (SKU begins with `ejemplo`) are dropped."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).select(delimiter_of(F.col("value"))).first()
    sep = first[0] if first else ","
    rows = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    sku = next((c for c in rows.columns if c.strip().lower().lstrip("\ufeff") == "sku"), None)
    filled = F.concat_ws("", *[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in rows.columns]) != ""
    return rows.filter(filled & (~F.startswith(F.lower(F.coalesce(F.col(f"`{sku}`"), F.lit(""))), F.lit("ejemplo")) if sku else F.lit(True)))


def sanitised(c: Column, many: bool = False) -> Column:
    """A cell without newlines; commas become semicolons, or bars in columns that hold several values."""
    return F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit(","), F.lit("|" if many else ";"))


def export_violations(rows: DataFrame, key: str, many: tuple = ()) -> DataFrame:
    """(key, column, violation) for cells with a newline, or with a comma outside the columns of several values."""
    cells = rows.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.lit(c in many).alias("many")) for c in rows.columns if c != key])).alias("c")).select(key, "c.*")
    bad = F.array_compact(F.array(F.when(F.col("value").rlike(r"[\r\n]"), "newline"), F.when(~F.col("many") & F.contains("value", F.lit(",")), "comma")))
    return cells.select(key, "column", F.explode(bad).alias("violation"))


def write_feed(rows: DataFrame, path: str, sep: str = ",") -> None:
    """One header and quoted rows a part file."""
    rows.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("lineSep", "\n").csv(path)
