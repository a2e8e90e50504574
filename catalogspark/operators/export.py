"""The store's batch file: a contract of 104 columns as a table, rows that survive its exclusions, and a check by reading it back.

Rows come with what other jobs made of a product: seq, sku, img, html, title, meta_title, meta_description, image_text, and
the booleans blocked, incomplete, unconfirmed, worded (language to review) and confirmed (the category's meta texts are
confirmed). Null texts count as empty, null booleans as false.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogspark.operators.links import sku_key

# The columns in order, those that are always 1, and those that hold several values.
COLUMNS = (
    "sku", "store_view_code", "attribute_set_code", "product_type", "categories", "product_websites", "name", "description",
    "short_description", "weight", "product_online", "tax_class_name", "visibility", "price", "special_price", "special_price_from_date",
    "special_price_to_date", "url_key", "meta_title", "meta_keywords", "meta_description", "base_image", "base_image_label", "small_image",
    "small_image_label", "thumbnail_image", "thumbnail_image_label", "swatch_image", "swatch_image_label", "created_at", "updated_at", "new_from_date",
    "new_to_date", "display_product_options_in", "map_price", "msrp_price", "map_enabled", "gift_message_available", "custom_design", "custom_design_from",
    "custom_design_to", "custom_layout_update", "page_layout", "product_options_container", "msrp_display_actual_price_type", "country_of_manufacture", "additional_attributes", "qty",
    "out_of_stock_qty", "use_config_min_qty", "is_qty_decimal", "allow_backorders", "use_config_backorders", "min_cart_qty", "use_config_min_sale_qty", "max_cart_qty",
    "use_config_max_sale_qty", "is_in_stock", "notify_on_stock_below", "use_config_notify_stock_qty", "manage_stock", "use_config_manage_stock", "use_config_qty_increments", "qty_increments",
    "use_config_enable_qty_inc", "enable_qty_increments", "is_decimal_divided", "website_id", "deferred_stock_update", "use_config_deferred_stock_update", "related_skus", "related_position",
    "crosssell_skus", "crosssell_position", "upsell_skus", "upsell_position", "additional_images", "additional_image_labels", "hide_from_product_page", "custom_options",
    "giftcard_type", "giftcard_allow_open_amount", "giftcard_open_amount_min", "giftcard_open_amount_max", "giftcard_amount", "use_config_is_redeemable", "giftcard_is_redeemable", "use_config_lifetime",
    "giftcard_lifetime", "use_config_allow_message", "giftcard_allow_message", "use_config_email_template", "giftcard_email_template", "bundle_price_type", "bundle_sku_type", "bundle_price_view",
    "bundle_weight_type", "bundle_values", "bundle_shipment_type", "configurable_variations", "configurable_variation_labels", "downloadable_links", "downloadable_samples", "associated_skus",
)
ONES = ("product_online", "use_config_min_qty", "use_config_min_sale_qty", "use_config_max_sale_qty", "use_config_notify_stock_qty", "use_config_manage_stock")
MANY = ("categories", "product_websites", "related_skus", "related_position", "crosssell_skus", "crosssell_position", "upsell_skus", "upsell_position", "additional_images", "additional_image_labels")
#: Why a row stays out, in the order in which it is asked.
REASONS = ("no-sku", "unconfirmed", "blocked", "incomplete", "language")
RELATIONS = ("upsell", "related", "crosssell")


def cell(c: Column, many: bool = False) -> Column:
    """A cell in one line without commas: semicolons stand for them, or bars between several values."""
    one = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n\t]+", " "), r"\s{2,}", " "))
    return F.regexp_replace(one, r"\s*,\s*", "|") if many else F.replace(one, F.lit(","), F.lit(";"))


def exclusion(with_incomplete: bool = False, with_unconfirmed: bool = False, without_language: bool = False) -> Column:
    """The first reason why a row stays out; null if it goes in."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    asked = (sku_key(F.col("sku")) == "", yes("unconfirmed") & F.lit(not with_unconfirmed), yes("blocked"), yes("incomplete") & F.lit(not with_incomplete), yes("worded") & F.lit(without_language))
    return F.coalesce(*[F.when(a, r) for a, r in zip(asked, REASONS, strict=True)])


def survivors(rows: DataFrame, **options) -> DataFrame:
    """Rows that go in, the last of each SKU whatever its case, with place, the order of the first of them."""
    kept = rows.withColumn("reason", exclusion(**options)).filter("reason IS NULL").withColumn("key", sku_key(F.col("sku")))
    of = Window.partitionBy("key")
    last = kept.withColumns({"first": F.min("seq").over(of), "last": F.row_number().over(of.orderBy(F.desc("seq")))}).filter("last = 1")
    return last.drop("reason", "last")


def allowed_relations(relations: DataFrame, rows: DataFrame, known: DataFrame | None = None, most: int = 4) -> DataFrame:
    """(key, kind, others array) of relations (sku, other, kind, rank) whose other end is in the file or known from earlier files (sku).

    What may not be shown is dropped before the first `most` are taken; complements are not cut.
    """
    allow = rows.select("key")
    if known is not None:
        allow = allow.unionByName(known.select(sku_key(F.col("sku")).alias("key")))
    ends = relations.select(sku_key(F.col("sku")).alias("key"), "other", "kind", "rank").join(rows.select("key"), "key", "left_semi")
    kept = ends.join(allow.distinct().withColumnRenamed("key", "end"), sku_key(F.col("other")) == F.col("end"), "left_semi")
    cut = kept.withColumn("n", F.row_number().over(Window.partitionBy("key", "kind").orderBy("rank", "other"))).filter((F.col("n") <= most) | (F.col("kind") == "crosssell"))
    return cut.groupBy("key", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "other"))), lambda x: x["other"]).alias("others"))


def batch(rows: DataFrame, relations: DataFrame | None = None, attribute: str = "categoria_prod", known: DataFrame | None = None, **options) -> DataFrame:
    """(place and the 104 columns) of the rows that go in; place orders them."""
    kept = survivors(rows, **options)
    confirmed = F.coalesce(F.col("confirmed"), F.lit(False))
    filled = {
        "sku": F.trim("sku"), "description": F.regexp_replace("html", r"\n\s*", ""), "additional_attributes": F.concat(F.lit(f"{attribute}="), F.coalesce("title", F.lit(""))),
        "short_description": F.when(confirmed, F.col("meta_description")), "meta_title": F.when(confirmed, F.col("meta_title")), "meta_description": F.when(confirmed, F.col("meta_description")),
        "base_image": F.trim("img"), "base_image_label": F.col("image_text"),
    } | {c: F.lit("1") for c in ONES}
    if relations is not None:
        by = allowed_relations(relations, kept, known).groupBy("key").pivot("kind", list(RELATIONS)).agg(F.first("others"))
        kept = kept.join(by, "key", "left")
        filled |= {f"{k}_skus": F.array_join(k, ",") for k in RELATIONS}
    return kept.select(F.col("first").alias("place"), *[cell(filled.get(c, F.lit("")), c in MANY).alias(c) for c in COLUMNS])


def counters(rows: DataFrame, **options) -> DataFrame:
    """One row: rows in, out by reason, replaced by a later one of their SKU, exported, and of these without confirmed meta texts and without image."""
    judged = rows.select(F.coalesce(exclusion(**options), F.lit("kept")).alias("what"))
    last = survivors(rows, **options)
    shown = F.array(F.lit("exported"), F.when(~F.coalesce("confirmed", F.lit(False)), "without_meta"), F.when(F.trim(F.coalesce("img", F.lit(""))) == "", "without_image"))
    every = judged.unionByName(last.select(F.explode(F.array_compact(shown)).alias("what")))
    n = lambda *of: F.count(F.when(F.col("what").isin(*of), 1))
    return every.agg(n(*REASONS, "kept").alias("total"), *[n(r).alias(r.replace("-", "_")) for r in REASONS], *[n(k).alias(k) for k in ("exported", "without_meta", "without_image")], (n("kept") - n("exported")).alias("replaced"))


def violations(rows: DataFrame) -> DataFrame:
    """(sku, column, violation) of a batch that breaks its contract: a line break, or a comma where the columns hold one value; a column too many or missing has no sku."""
    have = [c for c in rows.columns if c != "place"]
    wrong = [(None, c, "missing") for c in COLUMNS if c not in have] + [(None, c, "unknown") for c in have if c not in COLUMNS]
    layout = rows.sparkSession.createDataFrame(wrong, "sku string, column string, violation string")
    each = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("")).alias("value"), F.lit(c in MANY).alias("many")) for c in COLUMNS if c in have]
    cells = rows.select("sku", F.explode(F.array(*each)).alias("c")).select("sku", "c.*")
    bad = F.array_compact(F.array(F.when(F.col("value").rlike(r"[\r\n]"), "line break"), F.when(~F.col("many") & F.contains("value", F.lit(",")), "comma")))
    return cells.select("sku", "column", F.explode(bad).alias("violation")).unionByName(layout)


def write_batch(rows: DataFrame, path: str) -> None:
    """The batch as delimited files, each with the header and lines that end as the store expects."""
    rows.orderBy("place").select(*COLUMNS).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def round_trip(rows: DataFrame, path: str) -> DataFrame:
    """(sku, problem) where what was written to path and read again differs: lost, added, changed (with the columns), or a line that has not 104 cells."""
    spark: SparkSession = rows.sparkSession
    write_batch(rows, path)
    back = spark.read.schema(", ".join(f"{c} string" for c in (*COLUMNS, "__more"))).option("header", True).option("enforceSchema", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    key = lambda df: df.select(sku_key(F.col("sku")).alias("key"), F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS]).alias("row"))
    a, b = key(rows).withColumnRenamed("row", "a"), key(back).withColumnRenamed("row", "b")
    both = a.join(b, "key", "full_outer")
    changed = F.concat_ws(",", *[F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), c) for c in COLUMNS])
    problem = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "added").when(changed != "", F.concat(F.lit("changed: "), changed))
    wide = spark.read.option("lineSep", "\n").text(path).select(F.substring_index("value", ",", 1).alias("key"), (F.length("value") - F.length(F.replace("value", F.lit(","), F.lit("")))).alias("commas"))
    lines = wide.filter(F.col("commas") != len(COLUMNS) - 1).select("key", F.lit("cells").alias("problem"))
    return both.select("key", problem.alias("problem")).filter("problem IS NOT NULL").unionByName(lines).withColumnRenamed("key", "sku")
