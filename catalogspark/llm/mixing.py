"""Mixing sources to target weights by hierarchical budgeting, with DataFrame expressions only.

Leaves are (domain, language, source). Each level has weights; a budget of tokens flows from the root down. At every
node its children share the node's budget by weight, and a child gets no more than its subtree can supply (tokens times
`max_epochs`). What a child cannot take goes to its siblings, and only what the whole subtree cannot take was left to
the siblings of the parent, because capacities are summed upwards before budgets are dealt downwards. The shares of one
node are found exactly with running sums over its children in order of capacity / weight.

A leaf's budget is then read from seeded epochs: epoch 0, 1, ... are orders of its documents by
md5(seed, epoch, key, md5(text)). Whole epochs are taken while they fit, and the last epoch is cut after the first documents
whose tokens stay within the budget (a prefix of the order). To find the cut, tokens are summed by hash bucket first,
and only the documents of the one bucket in which the cut falls are put in order, so a leaf with a third of all rows is
never sorted in one task. There are as many buckets as the square root of the largest leaf's rows, so that a window over
buckets and the window over one bucket both stay small; their number changes the work, not the result.

Defined cases: null domain, language or source count as the empty string; a weight that is not given is `default_weight`;
a weight of 0 gives nothing; null and empty texts have no tokens and are taken with whole epochs and with the prefix in
which they lie, and a leaf without any tokens is read once; repeated rows have the same place in an order and are taken
or left together; no rows give no rows; a document's own columns travel in one struct, so names cannot clash.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogspark.functions.session import written

SPACES = " \t\n\x0b\x0c\r"
LEVELS = ("domain", "lang", "source")
#: Production mixture: weights by level and value; values that are not named have weight 1.
WEIGHTS = {
    "domain": {"bulk": 1.0, "curated": 2.0},
    "lang": {"en": 5.0, "fr": 2.0, "de": 2.0, "es": 1.0},
    "source": {},
}
SEED, MAX_EPOCHS, SHARE, LEAST_BUCKETS = 17, 2, 0.9, 256
#: Domains of sources, since the documents name none: src0, the crawl that holds a third of all rows, is bulk.
DOMAINS, DEFAULT_DOMAIN = {"src0": "bulk"}, "curated"
#: Leaves for which budgets are joined by broadcast; beyond it the join is left to Spark.
MAX_BROADCAST_LEAVES = 50_000


def n_words(text: Column) -> Column:
    """Tokens of a text for budgets: its words."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.lit(0)).otherwise(F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def domain_of(source: Column, domains: dict | None = None, default: str = DEFAULT_DOMAIN) -> Column:
    """Domain of a source under a table of sources; sources that it does not name have the default."""
    out = F.lit(default)
    for name, domain in (DOMAINS if domains is None else domains).items():
        out = F.when(F.coalesce(source, F.lit("")) == name, domain).otherwise(out)
    return out


def weight_of(level: str, weights: dict, default: float) -> Column:
    out = F.lit(float(default))
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def shares(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds `budget` to rows (parent..., child, capacity, weight, total): total shared by weight, none above its capacity.

    In order of capacity / weight the saturated children come first. With c the capacity and w the weight before a
    child, the level of the water there is (total - c) / (W - w); the child is saturated if its ratio is not above it.
    """
    order = Window.partitionBy(*parent).orderBy("ratio", "child")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    out = out.withColumns({"_before": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "_ahead": F.sum("weight").over(ahead)})
    out = out.withColumn("_level", F.when(F.col("_ahead") > 0, F.greatest(F.lit(0.0), (F.col("total") - F.col("_before")) / F.col("_ahead"))).otherwise(F.lit(0.0)))
    out = out.withColumn("_full", (F.col("weight") > 0) & (F.col("ratio") <= F.col("_level")))
    water = F.min(F.when(~F.col("_full") & (F.col("weight") > 0), F.struct("ratio", "child", "_level"))).over(Window.partitionBy(*parent))
    out = out.withColumn("_water", water["_level"])
    budget = F.when(F.col("weight") <= 0, F.lit(0)).when(F.col("_full"), F.col("capacity")).otherwise(F.floor(F.col("weight") * F.col("_water")))
    return out.withColumn("budget", F.least(budget.cast("long"), F.col("capacity"))).drop("ratio", "_before", "_ahead", "_level", "_full", "_water")


def budgets(leaves: DataFrame, total: int, weights: dict, max_epochs: int, default_weight: float = 1.0) -> DataFrame:
    """(domain, lang, source, supply, budget) from leaves (domain, lang, source, supply)."""
    weight = {level: weight_of(level, weights, default_weight) for level in LEVELS}
    able = lambda level, c: F.when(weight[level] > 0, c).otherwise(0).cast("long")
    low = leaves.withColumn("capacity", able("source", F.col("supply") * max_epochs))
    middle = low.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("capacity", able("lang", F.col("capacity")))
    top = middle.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumns({"total": F.lit(total).cast("long"), "child": F.col("domain"), "weight": weight["domain"], "root": F.lit(0)})
    top = shares(top, ["root"]).select("domain", F.col("budget").alias("total"))
    middle = shares(middle.join(top, "domain").withColumns({"child": F.col("lang"), "weight": weight["lang"]}), ["domain"]).select("domain", "lang", F.col("budget").alias("total"))
    low = low.join(middle, ["domain", "lang"]).withColumns({"child": F.col("source"), "weight": weight["source"]})
    return shares(low, ["domain", "lang"]).select(*LEVELS, "supply", "budget")


def order_key(seed: int, epoch: Column, key: Column, print_: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")), print_))


def placed(docs: DataFrame, key: str, text: str, domain: Column | None, carry: list[str]) -> DataFrame:
    """doc (the carried columns), key, print of the text, and the leaf, of every row."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    domain = domain_of(F.col("source")) if domain is None else domain
    return docs.select(
        F.struct(*carry).alias("doc"), F.col(key).alias("key"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("print"),
        F.coalesce(domain, F.lit("")).alias("domain"), blank("lang").alias("lang"), blank("source").alias("source"), F.col(text).alias("text"),
    )


def by_leaf(rows: DataFrame, small_side: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(small_side) if small else small_side, list(LEVELS), how)


def plan_of(narrow: DataFrame, weights: dict, share: float, seed: int, max_epochs: int, buckets: int | None) -> tuple[DataFrame, bool]:
    """(leaf, whole, last): whole epochs, and the last order key of the epoch that is cut (null: none); whether leaves are few."""
    leaves = written(narrow.groupBy(*LEVELS).agg(F.sum("n").alias("supply"), F.count("*").alias("rows")), "leaves")
    total, most = leaves.agg(F.floor(F.coalesce(F.sum("supply"), F.lit(0)) * F.lit(share)), F.coalesce(F.max("rows"), F.lit(0))).first()
    buckets = min(1 << 24, max(LEAST_BUCKETS, math.isqrt(most))) if buckets is None else buckets
    plan = budgets(leaves.drop("rows"), total, weights, max_epochs)
    some = F.col("supply") > 0
    plan = plan.withColumn("whole", F.when(some, F.floor(F.col("budget") / F.col("supply"))).otherwise(1).cast("int"))
    plan = written(plan.select(*LEVELS, "whole", F.when(some, F.col("budget") - F.col("whole") * F.col("supply")).otherwise(0).cast("long").alias("rest")), "plan")
    small = plan.count() <= MAX_BROADCAST_LEAVES

    cutting = by_leaf(narrow, plan.filter("rest > 0"), small).withColumn("rank_key", order_key(seed, F.col("whole"), F.col("key"), F.col("print")))
    at = F.conv(F.substring("rank_key", 1, 6), 16, 10).cast("long")
    cutting = cutting.withColumn("bucket", F.floor(at * buckets / (1 << 24)).cast("int"))
    sums = cutting.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("after", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket"))).withColumn("before", F.col("after") - F.col("n"))
    edge = written(sums.filter("before <= rest AND after > rest").select(*LEVELS, F.col("bucket").alias("edge"), "before"), "edges")
    run = Window.partitionBy(*LEVELS, "bucket").orderBy("rank_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = by_leaf(cutting, edge, small).filter("bucket = edge")
    fitting = inside.withColumn("upto", F.col("before") + F.sum("n").over(run)).filter("upto <= rest")
    last = fitting.groupBy(*LEVELS).agg(F.max("rank_key").alias("last_in"))
    ends = edge.join(last, list(LEVELS), "left")
    # below every key of the edge's bucket, if none of its documents fits
    floor_key = F.lower(F.lpad(F.conv(F.ceil(F.col("edge").cast("long") * (1 << 24) / buckets).cast("string"), 10, 16), 6, "0"))
    ends = ends.select(*LEVELS, F.coalesce("last_in", floor_key).alias("last"))
    return written(plan.join(ends, list(LEVELS), "left").select(*LEVELS, "whole", "last"), "plan"), small


def chosen(rows: DataFrame, plan: DataFrame, small: bool, seed: int) -> DataFrame:
    """Rows of `placed` once for each epoch that reads them."""
    met = by_leaf(rows, plan, small)
    part = F.col("last").isNotNull() & (order_key(seed, F.col("whole"), F.col("key"), F.col("print")) <= F.col("last"))
    times = F.col("whole") + part.cast("int")
    return met.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), F.greatest(times - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", domain: Column | None = None, weights: dict | None = None, share: float = SHARE, seed: int = SEED, max_epochs: int = MAX_EPOCHS, buckets: int | None = None, whole_rows: bool = True) -> DataFrame:
    """(doc, domain, epoch[, n_tokens]) of the mixture; its budget is `share` of all tokens.

    doc is the whole input row, or with whole_rows=False the row without its text and with n_tokens beside it.
    """
    weights = WEIGHTS if weights is None else weights
    slim = placed(docs, key, text, domain, [c for c in docs.columns if c != text])
    narrow = written(slim.withColumn("n", n_words(F.col("text"))).drop("text"), "narrow")
    plan, small = plan_of(narrow, weights, share, seed, max_epochs, buckets)
    if whole_rows:
        return chosen(placed(docs, key, text, domain, docs.columns), plan, small, seed).select("doc", "domain", "epoch")
    return chosen(narrow, plan, small, seed).select("doc", "domain", "epoch", F.col("n").alias("n_tokens"))


def keep_mixture(docs: DataFrame, **options) -> DataFrame:
    """Documents of the mixture, once an epoch, with the columns they came with."""
    return mixed(docs, **options).select("doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production mixture of all documents: one row for each document and epoch it is read in."""
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), whole_rows=False)
    return out.select("doc.doc_id", "domain", "doc.lang", "doc.source", "n_tokens", F.col("epoch").cast("long").alias("epoch"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLE_SQL = {
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN coalesce(source, '') = 'src0' THEN 'bulk' ELSE 'curated' END AS dm, coalesce(lang, '') AS l, coalesce(source, '') AS s,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n, md5(coalesce(text, '')) AS print FROM documents),
f AS (SELECT dm, l, s, sum(n)::BIGINT AS supply, 2 * sum(n)::BIGINT AS cap, 1.0::DOUBLE AS w,
      CASE l WHEN 'en' THEN 5.0 WHEN 'fr' THEN 2.0 WHEN 'de' THEN 2.0 ELSE 1.0 END::DOUBLE AS lw, CASE dm WHEN 'curated' THEN 2.0 ELSE 1.0 END::DOUBLE AS dw FROM d GROUP BY ALL),
c2 AS (SELECT dm, l, lw, dw, sum(cap)::BIGINT AS cap FROM f GROUP BY ALL),
c1 AS (SELECT dm, dw, sum(cap)::BIGINT AS cap FROM c2 GROUP BY ALL),
t AS (SELECT floor(sum(supply) * 0.9::DOUBLE)::BIGINT AS total FROM f),
-- a node's water level is the largest at which the capped shares of its children do not pass its budget
a1 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / dw, dm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(dw) OVER (ORDER BY cap / dw, dm ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c1, t),
b1 AS (SELECT dm, CASE WHEN cap / dw <= lv THEN cap ELSE floor(dw * greatest(0, (min({'r': cap / dw, 'k': dm, 'lv': lv}) FILTER (WHERE cap / dw > lv) OVER ()).lv))::BIGINT END AS total FROM a1),
a2 AS (SELECT c2.*, total, (total - coalesce(sum(cap) OVER (PARTITION BY dm ORDER BY cap / lw, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(lw) OVER (PARTITION BY dm ORDER BY cap / lw, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c2 JOIN b1 USING (dm)),
b2 AS (SELECT dm, l, CASE WHEN cap / lw <= lv THEN cap ELSE floor(lw * greatest(0, (min({'r': cap / lw, 'k': l, 'lv': lv}) FILTER (WHERE cap / lw > lv) OVER (PARTITION BY dm)).lv))::BIGINT END AS total FROM a2),
a3 AS (SELECT f.*, total, (total - coalesce(sum(cap) OVER (PARTITION BY dm, l ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY dm, l ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM f JOIN b2 USING (dm, l)),
b3 AS (SELECT dm, l, s, supply, CASE WHEN cap / w <= lv THEN cap ELSE floor(w * greatest(0, (min({'r': cap / w, 'k': s, 'lv': lv}) FILTER (WHERE cap / w > lv) OVER (PARTITION BY dm, l)).lv))::BIGINT END AS budget FROM a3),
p AS (SELECT *, CASE WHEN supply > 0 THEN budget // supply ELSE 1 END AS whole, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS rest FROM b3),
o AS (SELECT d.*, whole, rest, sum(n) OVER (PARTITION BY dm, l, s ORDER BY md5('17|' || whole || '|' || coalesce(doc_id::VARCHAR, '') || '|' || print) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN p USING (dm, l, s))
SELECT doc_id, dm AS domain, lang, source, n AS n_tokens, unnest(range(0, whole + (rest > 0 AND upto <= rest)::INT))::BIGINT AS epoch FROM o
"""
}
