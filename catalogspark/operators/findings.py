"""Findings of products on several axes: alerts, field states, ranked and unified recommendations, counts of filters."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogspark.functions.session import written

# Order of recommendation classes.
CLASS_ORDER = {"bloqueo": 1, "error": 2, "contradiccion": 3, "faltante": 4, "seo": 5, "contenido": 6, "mejora": 7}
TONES = {"error": 3, "warning": 2, "info": 1}


def tone():
    out = F.lit(0)
    for name, n in TONES.items():
        out = F.when(F.col("severity") == name, n).otherwise(out)
    return out


def class_rank():
    out = F.lit(9)
    for name, n in CLASS_ORDER.items():
        out = F.when(F.col("class") == name, n).otherwise(out)
    return out


def axis_alerts(findings: DataFrame) -> DataFrame:
    """(product_id, axis, open, worst, first_code) of findings (product_id, axis, code, severity)."""
    worst = F.max(tone())
    name = F.when(worst == 3, "error").when(worst == 2, "warning").otherwise("info")
    return findings.groupBy("product_id", "axis").agg(F.count("*").alias("open"), name.alias("worst"), F.min(F.struct((-tone()).alias("t"), "code")).alias("f")).select("product_id", "axis", "open", "worst", F.col("f.code").alias("first_code"))


def field_states(captured: DataFrame, findings: DataFrame) -> DataFrame:
    """(product_id, field, state): the worst finding of each captured field, else ok where it has a value, else pending."""
    worst = findings.filter("field <> ''").groupBy("product_id", "field").agg(F.max(tone()).alias("t"))
    both = captured.join(worst, ["product_id", "field"], "full")
    state = F.when(F.col("t") == 3, "error").when(F.col("t") == 2, "warning").when(F.col("t") == 1, "info").when(F.trim(F.coalesce("value", F.lit(""))) != "", "ok").otherwise("pending")
    return both.select("product_id", "field", state.alias("state"))


def ranked(recommendations: DataFrame) -> DataFrame:
    """Recommendations (product_id, class, severity, text) with their rank: class, severity, text."""
    w = Window.partitionBy("product_id").orderBy(class_rank(), F.desc(tone()), "text")
    return recommendations.withColumn("rank", F.row_number().over(w))


def next_action(recommendations: DataFrame) -> DataFrame:
    """The best recommendation of each product, by a plain minimum."""
    first = F.min(F.struct(class_rank().alias("c"), (-tone()).alias("t"), "text", "class")).alias("r")
    return recommendations.groupBy("product_id").agg(first).select("product_id", F.col("r.class").alias("class"), F.col("r.text").alias("text"))


def unified(findings: DataFrame) -> DataFrame:
    """(product_id, cause, findings, axes, best_class, points): findings (product_id, id, keys, axis, class, points) that share a cause key.

    Components inside each product by least label; all products move together. A product has few findings, so labels
    settle in a few rounds; each round is a written table, and the last one changes nothing. Both sides of a join grow with the
    products, though their files are small, so they are merged and never broadcast.
    """
    rows = written(findings.withColumn("label", F.col("id")), "labels")
    while True:
        keyed = rows.select("product_id", "id", "label", F.explode("keys").alias("key"))
        low = keyed.groupBy("product_id", "key").agg(F.min("label").alias("low"))
        best = keyed.join(low.hint("merge"), ["product_id", "key"]).groupBy("product_id", "id").agg(F.min("low").alias("low"))
        moved = rows.join(best.hint("merge"), ["product_id", "id"], "left").withColumn("moved", F.coalesce(F.col("low") < F.col("label"), F.lit(False)))
        rows = written(moved.withColumn("label", F.least("label", F.coalesce("low", "label"))).drop("low"), "labels")
        if rows.filter("moved").isEmpty():
            break
        rows = rows.drop("moved")
    return rows.groupBy("product_id", F.col("label").alias("cause")).agg(
        F.count("*").alias("findings"), F.array_join(F.array_sort(F.collect_set("axis")), ",").alias("axes"), F.min(class_rank()).alias("best_class"), F.max("points").alias("points")
    )


def filter_counts(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """One row with a count for each named predicate, in one pass."""
    return rows.agg(*[F.count(F.when(F.expr(p), 1)).alias(name) for name, p in filters.items()])


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page of rows; a number before the first or past the last page stands for that page."""
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(1, number), pages) - 1) * size).limit(size)
