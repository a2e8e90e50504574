"""Is a product ready for the store's batch file? Fourteen checks that follow the export itself, and what they block.

Rows are those of `export` with product_id, cat, v, and image_over (the image text is too long), near_sku (another SKU is
almost the same). The state depends on blocks and warnings alone; the score only describes them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogspark.operators import export
from catalogspark.operators.facts import markup_defects
from catalogspark.operators.links import sku_key
from catalogspark.operators.schema import FIELDS

OK, NONE, WARNING, BLOCK = "ok", "not applicable", "warning", "block"


def readiness_checks(rows: DataFrame, violations: DataFrame | None = None, broken: DataFrame | None = None, **options) -> DataFrame:
    """(product_id, check, level) of every check. options: those of `export.exclusion`.

    violations: what `export.violations` found in the batch (sku, column, violation), where one without sku concerns all rows.
    broken: what `export.round_trip` found (sku, problem). A product without known category or data has one check, which blocks.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    known = F.col("cat").isin(*FIELDS) & F.exists(F.map_values(F.coalesce("v", F.create_map().cast("map<string,string>"))), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    base = rows.withColumns({"known": F.coalesce(known, F.lit(False)), "reason": export.exclusion(**options), "key": sku_key(F.col("sku"))})
    # blank SKUs are no duplicates: they are dealt out by their product
    of = Window.partitionBy("key", F.when(F.col("key") == "", F.col("product_id")))
    base = base.withColumns({"n": F.count("*").over(of), "is_last": F.col("seq") == F.max("seq").over(of)})
    bad_html = markup_defects(rows.select("product_id", "html"), "product_id", "html").select("product_id").distinct().withColumn("bad_html", F.lit(True))
    base = base.join(bad_html, "product_id", "left")
    none = base.sparkSession.createDataFrame([], "key string")
    marks = lambda df, name: (df.select(sku_key(F.col("sku")).alias("key")).distinct() if df is not None else none).withColumn(name, F.lit(True))
    base = base.join(marks(violations.filter("sku IS NOT NULL") if violations is not None else None, "bad_cells"), "key", "left").join(marks(broken, "bad_trip"), "key", "left")
    layout = violations is not None and violations.filter("sku IS NULL").limit(1).count() > 0
    out, included = F.col("reason").isNotNull(), lambda c, allowed: F.when(~yes(c), OK).otherwise(WARNING if allowed else BLOCK)
    levels: dict[str, Column] = {
        "MR-001": F.when(F.col("key") == "", BLOCK).otherwise(OK),
        "MR-002": F.when(yes("blocked"), BLOCK).otherwise(OK),
        "MR-003": included("incomplete", options.get("with_incomplete", False)),
        "MR-004": included("unconfirmed", options.get("with_unconfirmed", False)),
        "MR-005": F.when(~yes("worded"), OK).otherwise(BLOCK if options.get("without_language", False) else WARNING),
        "MR-006": F.lit(BLOCK if layout else OK),
        "MR-007": F.when(out, NONE).when(yes("bad_trip"), BLOCK).otherwise(OK),
        "MR-008": F.when(out, NONE).when(yes("bad_cells"), BLOCK).otherwise(OK),
        "MR-009": F.when(yes("blocked"), NONE).when(blank("html"), BLOCK).when(yes("bad_html"), WARNING).otherwise(OK),
        "MR-010": F.when(yes("confirmed"), OK).otherwise(WARNING),
        "MR-011": F.when(blank("image_text") | yes("image_over"), WARNING).otherwise(OK),
        "MR-012": F.when(blank("img"), WARNING).otherwise(OK),
        "MR-013": F.when(F.col("key") == "", NONE).when(F.col("n") == 1, OK).when(F.col("is_last"), WARNING).otherwise(BLOCK),
        "MR-014": F.when(yes("near_sku"), WARNING).otherwise(OK),
    }
    every = F.array(*[F.struct(F.lit(c).alias("check"), level.alias("level")) for c, level in levels.items()])
    lost = F.array(F.struct(F.lit("MR-001").alias("check"), F.lit(BLOCK).alias("level")))
    return base.select("product_id", F.explode(F.when(F.col("known"), every).otherwise(lost)).alias("c")).select("product_id", "c.*")
