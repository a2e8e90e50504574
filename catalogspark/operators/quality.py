"""Field checks, issue counts, quarantine and text hygiene of products (product_id, cat, v map, note)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.operators.schema import category_fields

# Severity of each issue code.
SEVERITY = {
    "control-character": "error", "whitespace-normalization": "info", "required-missing": "error", "invalid-option": "error", "negative-number": "error",
    "numeric-format": "warning", "unknown-field": "warning", "unassigned-text": "warning", "unknown-category": "error",
}
QUARANTINED = ("control-character", "invalid-option", "negative-number")
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def field_problems(products: DataFrame) -> DataFrame:
    """(product_id, field, code, severity) of every failed check.

    One row for each captured field and each required one; the schema is a small fixed table, so it is broadcast.
    """
    fields = category_fields(products.sparkSession).withColumnRenamed("key", "field")
    cats = F.broadcast(fields.select("cat").distinct())
    lost = products.join(cats, "cat", "left_anti").select("product_id", F.lit("").alias("field"), F.lit("unknown-category").alias("code"))
    products = products.join(cats, "cat", "left_semi")  # an unknown category is a product's only problem
    captured = products.select("product_id", "cat", F.explode("v").alias("field", "value"))
    known = captured.join(F.broadcast(fields), ["cat", "field"], "left")
    value = F.coalesce(F.col("value"), F.lit(""))
    tidy = T.tidy(value)
    codes = F.array_compact(
        F.array(
            F.when(F.col("required").isNull(), "unknown-field"),
            F.when(F.col("required").isNotNull() & value.rlike(CONTROL), "control-character"),
            F.when(F.col("required").isNotNull() & (value != tidy), "whitespace-normalization"),
            F.when(F.col("options").isNotNull() & (tidy != "") & ~F.array_contains("options", tidy), "invalid-option"),
            F.when(F.col("numeric") & (tidy != ""), F.when(T.negative_number(tidy), "negative-number").when(~tidy.rlike(r"\d"), "numeric-format")),
        )
    )
    found = known.select("product_id", "field", F.explode(codes).alias("code"))
    needed = products.select("product_id", "cat", "v").join(F.broadcast(fields.filter("required").groupBy("cat").agg(F.collect_list("field").alias("need"))), "cat")
    missing = needed.select("product_id", F.explode(F.filter("need", lambda k: T.tidy(F.col("v")[k]) == "")).alias("field"), F.lit("required-missing").alias("code"))
    noted = products.filter(F.trim(F.coalesce("note", F.lit(""))) != "").select("product_id", F.lit("").alias("field"), F.lit("unassigned-text").alias("code"))
    every = found.unionByName(missing).unionByName(lost).unionByName(noted)
    return every.withColumn("severity", severity(F.col("code")))


def severity(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, level in SEVERITY.items():
        out = F.when(code == name, level).otherwise(out)
    return out


def issue_counts(products: DataFrame, problems: DataFrame) -> DataFrame:
    """(product_id, errors, warnings, infos, status) of every product."""
    count = lambda s: F.count(F.when(F.col("severity") == s, 1))
    by = problems.groupBy("product_id").agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"))
    out = products.select("product_id").join(by, "product_id", "left").fillna(0, ["errors", "warnings", "infos"])
    return out.withColumn("status", F.when(F.col("errors") > 0, "critico").when(F.col("warnings") > 0, "revisar").otherwise("listo"))


def issue_rollup(counts: DataFrame) -> DataFrame:
    """Products, errors and warnings by status."""
    return counts.groupBy("status").agg(F.count("*").alias("products"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))


def quality_summary(counts: DataFrame) -> DataFrame:
    """One row of batch totals."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return counts.agg(F.count("*").alias("total"), of("listo"), of("revisar"), of("critico"), total("errors"), total("warnings"))


def quarantine(products: DataFrame, problems: DataFrame) -> DataFrame:
    """Products with fields that must not go on moved from v to `quarantined`, and every code of these fields as reasons."""
    by_field = problems.filter("field <> ''").groupBy("product_id", "field").agg(F.collect_set("code").alias("codes"), F.max(F.col("code").isin(*QUARANTINED)).alias("blocked"))
    bad = by_field.filter("blocked").groupBy("product_id").agg(F.collect_set("field").alias("fields"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("reasons"))
    out = products.join(bad, "product_id", "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))
    return out.withColumns({
        "quarantined": F.map_filter("v", lambda k, _: F.array_contains("fields", k)),
        "v": F.map_filter("v", lambda k, _: ~F.array_contains("fields", k)),
        "reasons": F.coalesce("reasons", F.array().cast("array<string>")),
    }).drop("fields")


# Text defects and the patterns that show them; the later ones are for texts of one line.
SPACE = rf"[\s{T.WIDE_SPACE}]"
HYGIENE = {
    "control": CONTROL,
    "invisible": r"[\x{00A0}\x{200B}-\x{200D}\x{FEFF}]",
    "mojibake": r"\x{FFFD}|[ÃÂ][\x{80}-\x{BF}]",
    "unresolved": r"\{[A-Za-z0-9_]+(?::[A-Za-z0-9_]+)?\}",
    "technical": r"(?<![A-Za-z0-9_])(undefined|null|NaN)(?![A-Za-z0-9_])",
}
HTML_BREAKER = {"html-breaker": r'[<>"]'}
ONE_LINE = {
    "double-space": SPACE + "{2,}",
    "edge-space": f"^{SPACE}|{SPACE}$",
    "space-before-comma": SPACE + "[,;]",
    "separators": f"[,;]{SPACE}*[,;]|\\|{SPACE}*\\|",
    "edge-separator": f"^(?:{SPACE}|[|,;:\\-–])|[|,;:\\-–]{SPACE}*$",
    "repeated-word": r"(?iu)(?<![\p{L}\p{N}])(\p{L}{2,})\s+\1(?![\p{L}\p{N}])",
}


def text_hygiene(rows: DataFrame, key: str, text: str, html: bool = False, multiline: bool = False) -> DataFrame:
    """(key, defect) for every objective defect of a text; an empty text has none."""
    c = F.coalesce(F.col(text), F.lit(""))
    tests = HYGIENE | ({} if html else HTML_BREAKER) | ({} if multiline else ONE_LINE)
    # $ stands for the very end, not for a place before a last line break
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(c.rlike(p.replace("$", r"\z")), name) for name, p in tests.items()]))).alias("defect"))
