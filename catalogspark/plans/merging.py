"""Queries over two versions of the relation catalogue: entries, links and manual relations after a merge, and its report."""

from pyspark.sql import functions as F

from catalogspark.operators import catalogues
from catalogspark.plans.views import table

#: Both versions in SQL over `part`: SKU, time of change, time of export, snapshot.
LOCAL = {"sku": "concat('P-', CAST(p_partkey AS STRING))", "updated_at": "concat('2024-01-1', CAST(p_partkey % 5 AS STRING))", "exported_at": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('2024-02-1', CAST(p_partkey % 4 AS STRING)) END", "snapshot": "concat('l', CAST(p_size AS STRING))", "eligible": "p_partkey % 2 = 0", "mark": "'local'"}
INCOMING = {"sku": "concat(' p-', CAST(p_partkey AS STRING))", "updated_at": "concat('2024-01-1', CAST(p_partkey % 3 + 1 AS STRING))", "exported_at": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('2024-02-1', CAST(p_partkey % 6 AS STRING)) END", "snapshot": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat('i', CAST(p_size AS STRING)) END", "eligible": "p_partkey % 4 <> 0", "mark": "'incoming'"}
ONLY_LOCAL, ONLY_INCOMING = "p_partkey % 10 <> 9", "p_partkey % 8 <> 5"


def _side(spark, d, columns, where):
    rows = table(spark, d, "part").filter(where).select(*[F.expr(sql).alias(k) for k, sql in columns.items()])
    return rows.withColumn("data", F.create_map(F.lit("from"), "mark")).drop("mark")


def _links(spark, d, step, where):
    part = table(spark, d, "part").filter(where)
    return part.select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("parent"), F.concat(F.lit("p-"), (F.col("p_partkey") + step).cast("string")).alias("child"))


def _manual(spark, d, flip):
    part = table(spark, d, "part").filter(f"p_partkey % 5 = {flip} OR p_partkey % 6 = 0")
    one, two = (F.concat(F.lit("P-"), (F.col("p_partkey") + i).cast("string")) for i in (0, 1))
    a, b = (two, one) if flip else (one, two)
    day = F.concat(F.lit("2024-03-1"), (F.col("p_partkey") % (3 + 2 * flip)).cast("string"))
    return part.select(a.alias("a"), b.alias("b"), F.lit("upsell").alias("kind"), (F.col("p_partkey") % (2 + flip) == 0).alias("on"), day.alias("at"))


def _merged(spark, d):
    return catalogues.merged_entries(_side(spark, d, LOCAL, ONLY_LOCAL), _side(spark, d, INCOMING, ONLY_INCOMING))


def _parts(spark, d):
    entries = _merged(spark, d)
    links = catalogues.merged_links(_links(spark, d, 1, "p_partkey % 3 = 0"), _links(spark, d, 1, "p_partkey % 2 = 0"), entries)
    return entries, links, catalogues.merged_relations(_manual(spark, d, 0), _manual(spark, d, 1), entries)


def merge_catalogue(spark, d):
    return _merged(spark, d).select("sku", "updated_at", "exported_at", "snapshot", "eligible", F.col("data")["from"].alias("origin"), "action")


def merge_catalogue_links(spark, d):
    return _parts(spark, d)[1]


def merge_manual_relations(spark, d):
    return _parts(spark, d)[2].select("a", "b", "kind", F.col("on").alias("is_on"), F.col("at").alias("decided"), "action")


def merge_catalogue_report(spark, d):
    return catalogues.merge_report(*_parts(spark, d))


QUERIES = {f.__name__: f for f in (merge_catalogue, merge_catalogue_links, merge_manual_relations, merge_catalogue_report)}

_SQL = lambda e: e.replace("AS STRING", "AS VARCHAR")
_COLS = lambda of: ", ".join(f"{_SQL(sql)} AS {k}" for k, sql in of.items())
_E = f"""WITH l AS (SELECT p_partkey AS k, {_COLS(LOCAL)} FROM part WHERE {ONLY_LOCAL}), i AS (SELECT p_partkey AS k, {_COLS(INCOMING)} FROM part WHERE {ONLY_INCOMING}),
j AS (SELECT k, l, i, l.k IS NOT NULL AND i.k IS NOT NULL AND i.updated_at > l.updated_at AS newer, l.k IS NOT NULL AND i.exported_at IS NOT NULL AND i.exported_at > coalesce(l.exported_at, '') AS later FROM l FULL JOIN i USING (k)),
e AS (SELECT k, CASE WHEN l.k IS NULL OR newer THEN i.sku ELSE l.sku END AS sku, CASE WHEN l.k IS NULL OR newer THEN i.updated_at ELSE l.updated_at END AS updated_at, CASE WHEN l.k IS NULL OR later THEN i.exported_at ELSE l.exported_at END AS exported_at,
  CASE WHEN l.k IS NULL THEN i.snapshot WHEN later THEN coalesce(i.snapshot, l.snapshot) ELSE l.snapshot END AS snapshot, CASE WHEN l.k IS NULL OR newer THEN i.eligible ELSE l.eligible END AS eligible, CASE WHEN l.k IS NULL OR newer THEN i.mark ELSE l.mark END AS origin,
  CASE WHEN l.k IS NULL THEN 'added' WHEN i.k IS NULL THEN 'own' WHEN newer OR later THEN 'updated' ELSE 'same' END AS action FROM j)"""
_L = _E + """, n AS (SELECT p_partkey AS p, p_partkey + 1 AS c FROM part WHERE p_partkey % 2 = 0), k AS (SELECT 'P-' || p_partkey AS parent, 'p-' || (p_partkey + 1) AS child, 'own' AS action FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'P-' || p, 'p-' || c, CASE WHEN x.k IS NULL OR y.k IS NULL THEN 'orphan' WHEN NOT y.eligible THEN 'not eligible' WHEN p % 3 = 0 THEN 'known' ELSE 'added' END FROM n LEFT JOIN e x ON x.k = p LEFT JOIN e y ON y.k = c)"""
_R = _L + """, m AS (SELECT p_partkey AS p, p_partkey % 2 = 0 AS is_on, '2024-03-1' || (p_partkey % 3) AS day FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 6 = 0), o AS (SELECT p_partkey AS p, p_partkey % 3 = 0 AS is_on, '2024-03-1' || (p_partkey % 5) AS day FROM part WHERE p_partkey % 5 = 1 OR p_partkey % 6 = 0),
q AS (SELECT p, m, o, m.p IS NOT NULL AND o.p IS NOT NULL AND x.k IS NOT NULL AND y.k IS NOT NULL AND o.day > m.day AND m.is_on <> o.is_on AS changed, x.k IS NULL OR y.k IS NULL AS orphan FROM m FULL JOIN o USING (p) LEFT JOIN e x ON x.k = p LEFT JOIN e y ON y.k = p + 1),
r AS (SELECT 'P-' || CASE WHEN m.p IS NULL THEN p + 1 ELSE p END AS a, 'P-' || CASE WHEN m.p IS NULL THEN p ELSE p + 1 END AS b, 'upsell' AS kind, CASE WHEN m.p IS NULL OR changed THEN o.is_on ELSE m.is_on END AS is_on, CASE WHEN m.p IS NULL OR changed THEN o.day ELSE m.day END AS decided,
  CASE WHEN m.p IS NULL AND orphan THEN 'orphan' WHEN m.p IS NULL THEN 'added' WHEN changed THEN 'changed' ELSE 'own' END AS action FROM q)"""
ORACLE_SQL = {
    "merge_catalogue": _E + " SELECT sku, updated_at, exported_at, snapshot, eligible, origin, action FROM e",
    "merge_catalogue_links": _L + " SELECT parent, child, action FROM k",
    "merge_manual_relations": _R + " SELECT a, b, kind, is_on, decided, action FROM r",
    "merge_catalogue_report": _R + " SELECT 'entries' AS part, action, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'links', action, count(*) FROM k GROUP BY ALL UNION ALL SELECT 'relations', action, count(*) FROM r GROUP BY ALL",
}
