"""Scores of products on four axes and one combined score; summaries of each."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Penalties, bands, axis weights.
PENALTY = {"error": 20, "warning": 6, "info": 1}
ANOMALY = {"error": 20, "warning": 6}
AXES = {"health": 30, "seo": 25, "content": 25, "magento": 20}
DIMENSIONS = {
    "completeness": ("required-missing", "unassigned-text"),
    "validity": ("invalid-option", "numeric-format", "negative-number", "control-character", "unknown-category"),
    "language": ("language-claim", "language-medical", "language-review", "language-subjective", "rule-check"),
    "consistency": ("unknown-field",),
}


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c))


def band(score: Column) -> Column:
    return F.when(score.isNull(), "sin_evaluar").when(score >= 90, "excelente").when(score >= 75, "buena").when(score >= 50, "revisar").otherwise("critica")


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def health(products: DataFrame, problems: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(product_id, score, band, one score a dimension) from problems (product_id, code, severity) and anomalies (product_id, severity)."""
    cost = F.lit(0)
    for name, points in PENALTY.items():
        cost = F.when(F.col("severity") == name, points).otherwise(cost)
    sums = [F.sum(cost).alias("penalty")] + [F.sum(F.when(F.col("code").isin(*codes), cost).otherwise(0)).alias(f"p_{d}") for d, codes in DIMENSIONS.items()]
    by = problems.groupBy("product_id").agg(*sums)
    odd = anomalies.groupBy("product_id").agg(F.sum(F.when(F.col("severity") == "error", ANOMALY["error"]).otherwise(ANOMALY["warning"])).alias("anomaly"))
    out = products.select("product_id").join(by, "product_id", "left").join(odd, "product_id", "left").fillna(0)
    score = clamp(100 - F.col("penalty") - F.col("anomaly"))
    dims = [clamp((clamp(100 - F.col(f"p_{d}")) if d != "consistency" else clamp(100 - F.col(f"p_{d}")) - F.col("anomaly"))).alias(d) for d in DIMENSIONS]
    return out.select("product_id", score.alias("score"), band(score).alias("band"), *dims)


def score_summary(rows: DataFrame, score: str = "score") -> DataFrame:
    """One row: total, evaluated, rounded average, least, most, and rows of each band."""
    s = F.col(score)
    bands = [F.count(F.when(band(s) == b, 1)).alias(b) for b in ("excelente", "buena", "revisar", "critica", "sin_evaluar")]
    return rows.agg(F.count("*").alias("total"), half_up(F.avg(s)).alias("average"), F.min(s).alias("min"), F.max(s).alias("max"), *bands)


def readiness(checks: DataFrame) -> DataFrame:
    """(product_id, blocks, warnings, state, score) from check results (product_id, level: block, warning or ok)."""
    of = lambda level: F.count(F.when(F.col("level") == level, 1))
    by = checks.groupBy("product_id").agg(of("block").alias("blocks"), of("warning").alias("warnings"))
    state = F.when(F.col("blocks") > 0, "BLOCKED").when(F.col("warnings") > 0, "READY_WITH_WARNINGS").otherwise("READY")
    return by.select("product_id", "blocks", "warnings", state.alias("state"), clamp(100 - 25 * F.col("blocks") - 8 * F.col("warnings")).alias("score"))


def readiness_summary(rows: DataFrame) -> DataFrame:
    of = lambda s: F.count(F.when(F.col("state") == s, 1))
    return rows.agg(
        F.count("*").alias("total"), of("READY").alias("ready"), of("READY_WITH_WARNINGS").alias("with_warnings"), of("BLOCKED").alias("blocked"),
        F.count(F.when(F.col("state") != "BLOCKED", 1)).alias("exportable"), half_up(F.avg("score")).alias("average"), F.min("score").alias("min"), F.max("score").alias("max"),
    )


def score_360(rows: DataFrame) -> DataFrame:
    """Adds score, band, partial and the contribution of each axis to rows with nullable axis scores and `state`."""
    weight = sum((F.when(F.col(k).isNotNull(), w).otherwise(0) for k, w in AXES.items()), F.lit(0))
    points = sum((F.coalesce(F.col(k) * w, F.lit(0)) for k, w in AXES.items()), F.lit(0))
    out = rows.withColumn("_w", weight).withColumn("score", F.when(F.col("_w") > 0, half_up(points / F.col("_w"))))
    blocked = F.coalesce(F.col("state") == "BLOCKED", F.lit(False)) & F.col("score").isNotNull()
    out = out.withColumns({"band": F.when(blocked, "bloqueado").otherwise(band(F.col("score"))), "partial": (F.col("_w") > 0) & (F.col("_w") < 100)})
    share = {f"{k}_points": F.when(F.col(k).isNotNull() & (F.col("_w") > 0), half_up(F.lit(10.0) * F.col(k) * w / F.col("_w")) / 10).otherwise(0.0) for k, w in AXES.items()}
    return out.withColumns(share).drop("_w")


def score_360_summary(rows: DataFrame) -> DataFrame:
    means = [half_up(F.avg(k)).alias(f"{k}_average") for k in AXES]
    bands = [F.count(F.when(F.col("band") == b, 1)).alias(b) for b in ("excelente", "buena", "revisar", "critica", "bloqueado", "sin_evaluar")]
    return rows.agg(F.count("*").alias("total"), half_up(F.avg("score")).alias("average"), F.min("score").alias("min"), F.max("score").alias("max"), *means, *bands)


def consensus(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(product_id, proposed): in groups whose non-empty values agree when folded, the value for the rows without one."""
    from catalogspark.functions.text import fold

    filled = F.col(value) != ""
    g = rows.filter(F.concat(*[F.col(c) for c in group]) != "").groupBy(*group).agg(
        F.count_distinct(F.when(filled, fold(F.col(value)))).alias("n"), F.min_by(F.when(filled, F.col(value)), F.when(filled, F.col("seq"))).alias("proposed")
    )
    return rows.filter(~filled).join(g.filter("n = 1"), group).select("product_id", "proposed")
