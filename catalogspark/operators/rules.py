"""Rules as rows: conditions in SQL, weights and severities, all evaluated in one pass, and the scores they give.

A rule says when it applies and when it fails, over the columns of a row. `{field}` in a condition stands for a captured
field in one line, empty where it is missing. A rule that applies can lose its weight whole (error), half (warning) or not at all
(info); a provisional rule counts half, and its errors are warnings. The score is 100 * obtained / possible points. Which rules
a catalogue uses is data: a new rule is a new row, and no job changes.
"""

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.functions.session import sealed

#: Share of its weight that a failed rule loses.
LOSS = {"error": 1.0, "warning": 0.5, "info": 0.0}


class Rule(NamedTuple):
    id: str
    dimension: str
    weight: float
    severity: str
    kind: str
    fails: str
    applies: str = "true"
    categories: tuple = ()
    provisional: bool = False


def condition(sql: str) -> Column:
    return F.expr(re.sub(r"\{(\w+)\}", r"coalesce(f['\1'], '')", sql))


def captured(products: DataFrame) -> DataFrame:
    """products with f, their captured fields in one line each; fields that are empty are left out."""
    one = F.transform_values("v", lambda _, x: T.tidy(x))
    return products.withColumn("f", F.map_filter(F.coalesce(one, F.create_map().cast("map<string,string>")), lambda _, x: x != ""))


def evaluated(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, rule, dimension, severity, kind, state, possible, lost) of every rule on every row (with f and cat); state is cumple, pendiente, error or no_aplica."""

    def outcome(r: Rule) -> Column:
        applies = condition(r.applies) if not r.categories else F.col("cat").isin(*r.categories) & condition(r.applies)
        severity = "warning" if r.provisional and r.severity == "error" else r.severity
        possible = round(r.weight / 2 if r.provisional else r.weight, 2)
        lost = round(possible * LOSS[severity], 2)
        applies, failed = F.coalesce(applies, F.lit(False)), F.coalesce(condition(r.fails), F.lit(False))
        state = F.when(~applies, "no_aplica").when(~failed, "cumple").otherwise("error" if severity == "error" else "pendiente")
        return F.struct(F.lit(r.id).alias("rule"), F.lit(r.dimension).alias("dimension"), F.lit(severity).alias("severity"), F.lit(r.kind).alias("kind"), state.alias("state"),
                        F.when(applies, F.lit(float(possible))).otherwise(0.0).alias("possible"), F.when(applies & failed, F.lit(float(lost))).otherwise(0.0).alias("lost"))

    every = rows.select(key, F.array(*[outcome(r) for r in rules]).alias("r"))
    return sealed(every.select(key, F.explode("r").alias("r")).select(key, "r.*"))


def points(results: DataFrame, *by: str) -> DataFrame:
    """Points and score of groups of results: (by, possible, obtained, score, errors, warnings, infos), score null where nothing counts."""
    possible, lost = F.round(F.sum("possible"), 2), F.round(F.sum("lost"), 2)
    n = lambda cond: F.count(F.when(cond, 1))
    out = results.groupBy(*by).agg(
        possible.alias("possible"), F.round(possible - lost, 2).alias("obtained"), n(F.col("state") == "error").alias("errors"),
        n((F.col("state") == "pendiente") & (F.col("severity") != "info")).alias("warnings"), n((F.col("state") == "pendiente") & (F.col("severity") == "info")).alias("infos"),
    )
    return out.withColumn("score", F.when(F.col("possible") > 0, F.round(100 * F.col("obtained") / F.col("possible")).cast("int")))


def scores(results: DataFrame, key: str) -> DataFrame:
    """(key, possible, obtained, score, errors, warnings, infos, status) of every row."""
    status = F.when(F.col("score").isNull(), "sin_evaluar").when(F.col("errors") > 0, "critico").when(F.col("warnings") > 0, "revisar").otherwise("listo")
    return points(results, key).withColumn("status", status)


def summary(scored: DataFrame) -> DataFrame:
    """One row: rows by status, and the average, least and greatest score."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return scored.agg(F.count("*").alias("total"), F.count("score").alias("evaluated"), of("critico"), of("revisar"), of("listo"), of("sin_evaluar"), F.round(F.avg("score")).cast("long").alias("average"), F.min("score").alias("least"), F.max("score").alias("greatest"))
