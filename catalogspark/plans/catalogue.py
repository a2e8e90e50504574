"""Queries over products: keys, checks, duplicates, scores, relations."""

from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.operators import anomalies, export, quality, readiness, relations, scores
from catalogspark.operators.schema import FIELDS as CATEGORY, NUMERIC, OPTIONS
from catalogspark.operators.sync import last_wins
from catalogspark.plans import contents, exports
from catalogspark.plans.views import LONG_DUCK, PRODUCTS_DUCK, clean_duck, compact_duck, products, table

#: Long texts, some with a tag that stays open.
READY_HTML = f"concat({contents.HTML}, CASE WHEN product_id % 15 = 0 THEN '<b>x' ELSE '' END)"
P = f"WITH p AS ({PRODUCTS_DUCK})"
_SCHEMA = ", ".join(
    f"('{c}', '{k}', {str(req).lower()}, {'[' + ', '.join(repr(o) for o in OPTIONS[k]) + ']' if k in OPTIONS else 'NULL'}, {str(k in NUMERIC).lower()})"
    for c, fields in CATEGORY.items() for k, _, req, _ in fields
)
PROBLEMS = P + f""", s(cat, field, required, options, num) AS (VALUES {_SCHEMA}),
l AS ({LONG_DUCK}),
k AS (SELECT l.*, required, options, num, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS tidy FROM l LEFT JOIN s USING (cat, field)),
f AS (SELECT product_id, field, 'unknown-field' AS code, 'warning' AS severity FROM k WHERE required IS NULL
UNION ALL SELECT product_id, field, 'whitespace-normalization', 'info' FROM k WHERE required IS NOT NULL AND value <> tidy
UNION ALL SELECT product_id, field, 'invalid-option', 'error' FROM k WHERE options IS NOT NULL AND NOT list_contains(options, tidy)
UNION ALL SELECT product_id, field, 'negative-number', 'error' FROM k WHERE num AND regexp_matches(tidy, '(^|[^\\p{{L}}\\d])-\\s*\\d')
UNION ALL SELECT product_id, field, 'numeric-format', 'warning' FROM k WHERE num AND NOT regexp_matches(tidy, '(^|[^\\p{{L}}\\d])-\\s*\\d') AND NOT regexp_matches(tidy, '\\d')
UNION ALL SELECT p.product_id, s.field, 'required-missing', 'error' FROM p JOIN s ON s.cat = p.cat AND s.required WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.product_id = p.product_id AND l.field = s.field AND trim(l.value) <> '')
UNION ALL SELECT product_id, '', 'unassigned-text', 'warning' FROM p WHERE note <> '')"""
COUNTS = PROBLEMS + """,
c AS (SELECT p.product_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos
FROM p LEFT JOIN f USING (product_id) GROUP BY p.product_id),
i AS (SELECT *, CASE WHEN errors > 0 THEN 'critico' WHEN warnings > 0 THEN 'revisar' ELSE 'listo' END AS status FROM c)"""


def field_problems(spark, d):
    return quality.field_problems(products(spark, d))


def issue_counts(spark, d):
    p = products(spark, d)
    return quality.issue_counts(p, quality.field_problems(p))


def issue_rollup(spark, d):
    return quality.issue_rollup(issue_counts(spark, d))


def quality_summary(spark, d):
    return quality.quality_summary(issue_counts(spark, d))


def quarantine(spark, d):
    p = products(spark, d)
    out = quality.quarantine(p, quality.field_problems(p)).filter(F.size("quarantined") > 0)
    return out.select("product_id", F.array_join(F.array_sort(F.map_keys("quarantined")), ",").alias("fields"), F.array_join("reasons", ",").alias("reasons"), F.size("v").cast("long").alias("kept"))


def normalize_text(spark, d):
    docs = table(spark, d, "documents")
    tidy = T.tidy(F.col("text"))
    return docs.select("doc_id", F.md5(tidy).alias("normalized"), (tidy != F.coalesce("text", F.lit(""))).alias("changed"))


def match_keys(spark, d):
    return products(spark, d).select("product_id", T.fold(F.col("title")).alias("fold"), T.clean(F.col("title")).alias("clean"), T.compact(F.col("title")).alias("compact"), T.compact(F.col("sku")).alias("sku_key"))


def text_hygiene(spark, d):
    return quality.text_hygiene(table(spark, d, "documents"), "doc_id", "text").groupBy("defect").agg(F.count("*").alias("n"))


def duplicate_skus(spark, d):
    return anomalies.duplicates(products(spark, d), T.compact(F.col("sku")), "duplicate-sku", "error")


def duplicate_titles(spark, d):
    return anomalies.duplicates(products(spark, d), T.clean(F.col("title")), "duplicate-title", "warning")


def duplicate_meta(spark, d):
    p = products(spark, d).withColumn("meta", F.concat_ws(" ", "marca", "producto", "contenido"))
    return anomalies.other_holders(p, T.clean(F.col("meta"))).select("product_id", F.col("others").alias("duplicates"))


def near_duplicates(spark, d):
    return anomalies.near_duplicates(products(spark, d), F.col("title"), "seq", 0.92, 8)


def near_duplicate_urls(spark, d):
    return anomalies.near_duplicates(table(spark, d, "pages"), F.col("url"), "page_id", 0.90, 5)


def anomaly_summary(spark, d):
    return anomalies.anomaly_summary(duplicate_skus(spark, d).unionByName(duplicate_titles(spark, d)))


def _anomalies(spark, d):
    p = products(spark, d)
    sku = anomalies.other_holders(p, T.compact(F.col("sku"))).filter("others > 0").select("product_id", F.lit("error").alias("severity"))
    title = anomalies.other_holders(p, T.clean(F.col("title"))).filter("others > 0").select("product_id", F.lit("warning").alias("severity"))
    return sku.unionByName(title)


def health_score(spark, d):
    p = products(spark, d)
    out = scores.health(p, quality.field_problems(p), _anomalies(spark, d))
    return out.select("product_id", "band", *[F.col(c).cast("long").alias(c) for c in ("score", "completeness", "validity", "language", "consistency")])


def health_summary(spark, d):
    return scores.score_summary(health_score(spark, d))


def _checks(spark, d):
    """All checks of the store on products with the texts that other jobs would have made."""
    inputs = [F.expr(sql).alias(k) for k, sql in exports.INPUTS.items() if k != "html"]
    rows = products(spark, d).select("product_id", "seq", "cat", "v", F.expr(READY_HTML).alias("html"), *inputs, (F.col("product_id") % 23 == 0).alias("image_over"), (F.col("product_id") % 29 == 0).alias("near_sku"))
    batch = export.batch(rows)
    return readiness.readiness_checks(rows, export.violations(batch))


def readiness_checks(spark, d):
    return _checks(spark, d).groupBy("check", "level").agg(F.count("*").alias("products"))


def readiness_state(spark, d):
    return scores.readiness(_checks(spark, d)).withColumn("score", F.col("score").cast("long"))


def readiness_summary(spark, d):
    return scores.readiness_summary(readiness_state(spark, d))


def _axes(spark, d):
    """Health, content and readiness of each product; search has no score yet, so the combined score is partial."""
    health = health_score(spark, d).select("product_id", F.col("score").alias("health"))
    ready = readiness_state(spark, d).select("product_id", F.col("score").alias("magento"), "state")
    told = contents.content_score(spark, d).select("product_id", F.col("score").cast("long").alias("content"))
    return health.join(ready, "product_id").join(told, "product_id").select("product_id", "health", F.lit(None).cast("long").alias("seo"), "content", "magento", "state")


def score_360(spark, d):
    return scores.score_360(_axes(spark, d))


def score_360_summary(spark, d):
    return scores.score_360_summary(score_360(spark, d))


def infer_by_consensus(spark, d):
    rows = products(spark, d).withColumn("via", F.when(F.col("product_id") % 4 == 0, "").when(F.col("product_id") % 3 == 0, F.upper("forma")).otherwise(F.when(F.length("principio") > 9, F.col("forma")).otherwise(F.col("receta"))))
    return scores.consensus(rows, ["principio", "concentracion", "forma"], "via")


def alternatives(spark, d):
    out = relations.alternatives(products(spark, d).filter("sku LIKE 'P-%'"), ["principio", "forma"])
    return out.select("sku", "other", F.col("rank").cast("long").alias("rank"))


def related_products(spark, d):
    p = products(spark, d).filter("sku LIKE 'P-%'")
    out = relations.related(p, ["principio", "forma"])
    return out.select("sku", "other", "same_brand", F.col("rank").cast("long").alias("rank"))


def export_exclusions(spark, d):
    p = products(spark, d)
    counts = issue_counts(spark, d)
    reason = F.when(F.trim("sku") == "", "no-sku").when(F.col("product_id") % 37 == 0, "unconfirmed").when(F.col("errors") > 0, "blocked").when(F.col("marca") == "", "missing-data").otherwise("exported")
    return p.join(counts.select("product_id", "errors"), "product_id").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def work_bucket(spark, d):
    counts = issue_counts(spark, d)
    bucket = F.when(F.col("product_id") % 41 == 0, "approved").when(F.col("errors") > 0, "blocked").when(F.col("product_id") % 37 == 0, "review").otherwise("ready")
    return counts.select("product_id", bucket.alias("bucket"))


#: Declared speciality of a product; a third declares none.
SPECIALTY = "CASE product_id % 3 WHEN 0 THEN 'si' WHEN 1 THEN 'no' END"


def complement_eligible(spark, d):
    return products(spark, d).select("product_id", relations.complement_eligible(F.col("cat"), F.col("receta"), F.expr(SPECIALTY)).alias("eligible"))


def last_wins_export(spark, d):
    rows = products(spark, d).filter("trim(sku) <> ''")
    return last_wins(rows, F.lower(T.compact(F.col("sku")))).select("product_id", "sku", "position")


def merchant_feed(spark, d):
    p = products(spark, d).filter("trim(sku) <> '' AND marca <> ''")
    one_line = lambda c: F.trim(F.regexp_replace(c, r"[\t\r\n]+", " "))
    rows = last_wins(p, F.lower(T.compact(F.col("sku"))))
    return rows.select(F.col("sku").alias("id"), one_line(F.col("title")).alias("title"), one_line(F.concat_ws(". ", "producto", "contenido")).alias("description"), (F.length("title") > 150).alias("long_title"))


QUERIES = {f.__name__: f for f in (field_problems, issue_counts, issue_rollup, quality_summary, quarantine, normalize_text, match_keys, text_hygiene, duplicate_skus, duplicate_titles, duplicate_meta, near_duplicates, near_duplicate_urls, anomaly_summary, health_score, health_summary, readiness_checks, readiness_state, readiness_summary, score_360, score_360_summary, infer_by_consensus, alternatives, related_products, export_exclusions, work_bucket, complement_eligible, last_wins_export, merchant_feed)}

SKU, TITLE = compact_duck("sku"), clean_duck("title")
BAND = "CASE WHEN {0} IS NULL THEN 'sin_evaluar' WHEN {0} >= 90 THEN 'excelente' WHEN {0} >= 75 THEN 'buena' WHEN {0} >= 50 THEN 'revisar' ELSE 'critica' END"
DUP = P + """ SELECT '{kind}' AS type, '{sev}' AS severity, key, count(*) AS size, min(seq) AS first_seq FROM (SELECT {key} AS key, seq FROM p) WHERE key <> '' GROUP BY key HAVING count(*) > 1"""
NEAR = """, k AS (SELECT {seq} AS seq, {clean} AS clean FROM {table}), m AS (SELECT *, replace(clean, ' ', '') AS c FROM k WHERE length(clean) >= {least}),
v AS (SELECT DISTINCT c FROM m),
x AS (SELECT a.c AS x, b.c AS y, 1.0::DOUBLE - levenshtein(a.c, b.c) / greatest(length(a.c), length(b.c)) AS s FROM v a JOIN v b ON a.c <= b.c AND abs(length(a.c) - length(b.c)) <= 12)
SELECT least(a.seq, b.seq) AS first_seq, greatest(a.seq, b.seq) AS second_seq, round(s, 3) AS score, CASE WHEN a.seq < b.seq THEN b.clean ELSE a.clean END AS key, CASE WHEN a.seq < b.seq THEN a.clean ELSE b.clean END AS other_key
FROM x JOIN m a ON a.c = x JOIN m b ON b.c = y WHERE s >= {t} AND a.clean <> b.clean AND (x <> y OR a.seq < b.seq)"""
HEALTH = COUNTS + f""", o AS (SELECT product_id, CASE WHEN sk <> '' AND count(*) OVER (PARTITION BY sk) > 1 THEN 20 ELSE 0 END + CASE WHEN tk <> '' AND count(*) OVER (PARTITION BY tk) > 1 THEN 6 ELSE 0 END AS anomaly FROM (SELECT product_id, {SKU} AS sk, {TITLE} AS tk FROM p)),
w AS (SELECT product_id, sum(c) FILTER (code IN ('required-missing', 'unassigned-text')) AS a, sum(c) FILTER (code IN ('invalid-option', 'numeric-format', 'negative-number', 'control-character', 'unknown-category')) AS b, sum(c) FILTER (code = 'unknown-field') AS e
  FROM (SELECT *, CASE severity WHEN 'error' THEN 20 WHEN 'warning' THEN 6 ELSE 1 END AS c FROM f) GROUP BY product_id),
h AS (SELECT i.product_id, greatest(0, 100 - 20 * errors - 6 * warnings - infos - anomaly)::BIGINT AS score, greatest(0, 100 - coalesce(a, 0))::BIGINT AS completeness, greatest(0, 100 - coalesce(b, 0))::BIGINT AS validity, 100::BIGINT AS language,
  greatest(0, greatest(0, 100 - coalesce(e, 0)) - anomaly)::BIGINT AS consistency FROM i JOIN o USING (product_id) LEFT JOIN w USING (product_id))"""
_SQL = lambda e: e.replace("AS STRING", "AS VARCHAR")
#: The checks and their levels on these products, worked out by hand.
CHECKS = {
    "MR-001": "CASE WHEN key = '' THEN 'block' ELSE 'ok' END",
    "MR-002": "CASE WHEN i_blocked THEN 'block' ELSE 'ok' END",
    "MR-003": "CASE WHEN i_incomplete THEN 'block' ELSE 'ok' END",
    "MR-004": "CASE WHEN i_unconfirmed THEN 'block' ELSE 'ok' END",
    "MR-005": "CASE WHEN i_worded THEN 'warning' ELSE 'ok' END",
    "MR-006": "'ok'",
    "MR-007": "CASE WHEN key = '' OR i_blocked OR i_incomplete OR i_unconfirmed THEN 'not applicable' ELSE 'ok' END",
    "MR-008": "CASE WHEN key = '' OR i_blocked OR i_incomplete OR i_unconfirmed THEN 'not applicable' ELSE 'ok' END",
    "MR-009": "CASE WHEN i_blocked THEN 'not applicable' WHEN product_id % 6 = 1 AND product_id % 15 <> 0 THEN 'block' WHEN product_id % 15 = 0 THEN 'warning' ELSE 'ok' END",
    "MR-010": "CASE WHEN i_confirmed THEN 'ok' ELSE 'warning' END",
    "MR-011": "CASE WHEN trim(i_image_text) = '' OR product_id % 23 = 0 THEN 'warning' ELSE 'ok' END",
    "MR-012": "CASE WHEN trim(i_img) = '' THEN 'warning' ELSE 'ok' END",
    "MR-013": "CASE WHEN key = '' THEN 'not applicable' WHEN twins = 1 THEN 'ok' WHEN is_last THEN 'warning' ELSE 'block' END",
    "MR-014": "CASE WHEN product_id % 29 = 0 THEN 'warning' ELSE 'ok' END",
}
_READY = f""", ri AS (SELECT product_id, seq, {", ".join(f"{_SQL(sql)} AS i_{k}" for k, sql in exports.INPUTS.items() if k != "html")} FROM p), rk AS (SELECT *, lower(trim(i_sku)) AS key FROM ri),
rl AS (SELECT *, count(*) OVER (PARTITION BY key) AS twins, seq = max(seq) OVER (PARTITION BY key) AS is_last FROM rk), rc AS (SELECT product_id, unnest({list(CHECKS)}) AS "check", unnest([{", ".join(CHECKS.values())}]) AS level FROM rl),
rr AS (SELECT product_id, count(*) FILTER (level = 'block') AS blocks, count(*) FILTER (level = 'warning') AS warnings FROM rc GROUP BY product_id)"""
READY = P + _READY + """, s AS (SELECT *, CASE WHEN blocks > 0 THEN 'BLOCKED' WHEN warnings > 0 THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS state, greatest(0, 100 - 25 * blocks - 8 * warnings)::BIGINT AS score FROM rr)"""
AXES = HEALTH + _READY + f""", cr AS ({contents.UNION}), cs AS (SELECT product_id, floor(100 * (sum(possible) - sum(lost)) / sum(possible) + 0.5::DOUBLE)::BIGINT AS content FROM cr GROUP BY product_id),
a AS (SELECT product_id, h.score AS health, NULL::BIGINT AS seo, content, greatest(0, 100 - 25 * blocks - 8 * warnings)::BIGINT AS magento, CASE WHEN blocks > 0 THEN 'BLOCKED' WHEN warnings > 0 THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS state FROM h JOIN rr USING (product_id) JOIN cs USING (product_id)),
""" + """w2 AS (SELECT *, 30 * (health IS NOT NULL)::INT + 25 * (seo IS NOT NULL)::INT + 25 * (content IS NOT NULL)::INT + 20 * (magento IS NOT NULL)::INT AS w, coalesce(30 * health, 0) + coalesce(25 * seo, 0) + coalesce(25 * content, 0) + coalesce(20 * magento, 0) AS pts FROM a),
s2 AS (SELECT *, floor(pts / w + 0.5)::BIGINT AS score FROM w2),
z AS (SELECT product_id, health, seo, content, magento, state, score, CASE WHEN state = 'BLOCKED' AND score IS NOT NULL THEN 'bloqueado' ELSE """ + BAND.format("score") + """ END AS band, w > 0 AND w < 100 AS partial,
  coalesce(floor(10.0::DOUBLE * health * 30 / w + 0.5) / 10, 0) AS health_points, coalesce(floor(10.0::DOUBLE * seo * 25 / w + 0.5) / 10, 0) AS seo_points, coalesce(floor(10.0::DOUBLE * content * 25 / w + 0.5) / 10, 0) AS content_points, coalesce(floor(10.0::DOUBLE * magento * 20 / w + 0.5) / 10, 0) AS magento_points FROM s2)"""
ALT = P + """, q AS (SELECT * FROM p WHERE sku LIKE 'P-%'), alt AS (SELECT a.sku, b.sku AS other FROM q a JOIN q b ON a.principio = b.principio AND a.forma = b.forma AND a.marca <> b.marca AND a.marca <> '' AND b.marca <> '')"""
bands = lambda c, names: ", ".join(f"count(*) FILTER ({c} = '{b}') AS {b}" for b in names)
FIVE = ("excelente", "buena", "revisar", "critica", "sin_evaluar")
ORACLE_SQL = {
    "field_problems": PROBLEMS + " SELECT product_id, field, code, severity FROM f",
    "issue_counts": COUNTS + " SELECT product_id, errors, warnings, infos, status FROM i",
    "issue_rollup": COUNTS + " SELECT status, count(*) AS products, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings FROM i GROUP BY status",
    "quality_summary": COUNTS + " SELECT count(*) AS total, count(*) FILTER (status = 'listo') AS listo, count(*) FILTER (status = 'revisar') AS revisar, count(*) FILTER (status = 'critico') AS critico, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings FROM i",
    "quarantine": PROBLEMS + ", b AS (SELECT DISTINCT product_id, field FROM f WHERE code IN ('control-character', 'invalid-option', 'negative-number')), r AS (SELECT product_id, string_agg(DISTINCT field, ',' ORDER BY field) AS fields, string_agg(DISTINCT code, ',' ORDER BY code) AS reasons, count(DISTINCT field) AS n FROM f JOIN b USING (product_id, field) GROUP BY product_id) SELECT product_id, fields, reasons, (SELECT count(*) FROM l WHERE l.product_id = r.product_id) - n AS kept FROM r",
    "normalize_text": r"SELECT doc_id, md5(t) AS normalized, t <> coalesce(text, '') AS changed FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS t FROM documents)",
    "match_keys": P + f" SELECT product_id, lower(title) AS fold, {TITLE} AS clean, {compact_duck('title')} AS compact, {SKU} AS sku_key FROM p",
    "text_hygiene": r"""WITH w AS (SELECT coalesce(text, '') AS t FROM documents),
d AS (SELECT unnest(['control', 'invisible', 'mojibake', 'unresolved', 'technical', 'html-breaker', 'double-space', 'edge-space', 'space-before-comma', 'separators', 'edge-separator', 'repeated-word']) AS defect,
  unnest([regexp_matches(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]'), regexp_matches(t, '[\x{00A0}\x{200B}-\x{200D}\x{FEFF}]'), regexp_matches(t, '\x{FFFD}|[ÃÂ][\x{80}-\x{BF}]'), regexp_matches(t, '\{\w+(?::\w+)?\}'), regexp_matches(t, '\b(undefined|null|NaN)\b'), regexp_matches(t, '[<>"]'),
    regexp_matches(t, '[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]{2,}'), regexp_matches(t, '^[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]|[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]$'), regexp_matches(t, '[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}][,;]'), regexp_matches(t, '[,;][\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*[,;]|\|[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*\|'),
    regexp_matches(t, '^[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}|,;:\-–]|[|,;:\-–][\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*$'),
    -- neighbours: pieces of letters and digits that one run of white space parts
    (SELECT bool_or(a = b AND regexp_matches(a, '^\p{L}{2,}$')) FROM (SELECT unnest(l[:len(l) - 1]) AS a, unnest(l[2:]) AS b FROM (SELECT string_split_regex(lower(regexp_replace(t, '[^\p{L}\p{N}\s]+', ' | ', 'g')), '\s+') AS l)))]) AS hit FROM w)
SELECT defect, count(*) AS n FROM d WHERE hit GROUP BY defect""",
    "duplicate_skus": DUP.format(kind="duplicate-sku", sev="error", key=SKU),
    "duplicate_titles": DUP.format(kind="duplicate-title", sev="warning", key=TITLE),
    "duplicate_meta": P + f" SELECT product_id, CASE WHEN k = '' THEN 0 ELSE count(*) OVER (PARTITION BY k) - 1 END AS duplicates FROM (SELECT product_id, {clean_duck(chr(34) + 'meta' + chr(34))} AS k FROM (SELECT product_id, concat_ws(' ', marca, producto, contenido) AS meta FROM p))",
    "near_duplicates": P + NEAR.format(seq="seq", clean=TITLE, table="p", least=8, t=0.92),
    "near_duplicate_urls": "WITH u AS (SELECT 1)" + NEAR.format(seq="page_id", clean=clean_duck("url"), table="pages", least=5, t=0.90),
    "anomaly_summary": f"SELECT severity, type, count(*) AS n FROM (({DUP.format(kind='duplicate-sku', sev='error', key=SKU)}) UNION ALL ({DUP.format(kind='duplicate-title', sev='warning', key=TITLE)})) GROUP BY ALL",
    "health_score": HEALTH + f" SELECT *, {BAND.format('score')} AS band FROM h",
    "health_summary": HEALTH + f" SELECT count(*) AS total, floor(avg(score) + 0.5)::BIGINT AS average, min(score) AS min, max(score) AS max, {bands('b', FIVE)} FROM (SELECT *, {BAND.format('score')} AS b FROM h)",
    "readiness_checks": P + _READY + ' SELECT "check", level, count(*) AS products FROM rc GROUP BY ALL',
    "readiness_state": READY + " SELECT product_id, blocks, warnings, state, score FROM s",
    "readiness_summary": READY + " SELECT count(*) AS total, count(*) FILTER (state = 'READY') AS ready, count(*) FILTER (state = 'READY_WITH_WARNINGS') AS with_warnings, count(*) FILTER (state = 'BLOCKED') AS blocked, count(*) FILTER (state <> 'BLOCKED') AS exportable, floor(avg(score) + 0.5)::BIGINT AS average, min(score) AS min, max(score) AS max FROM s",
    "score_360": AXES + " SELECT * FROM z",
    "score_360_summary": AXES + f" SELECT count(*) AS total, floor(avg(score) + 0.5)::BIGINT AS average, min(score) AS min, max(score) AS max, floor(avg(health) + 0.5)::BIGINT AS health_average, floor(avg(seo) + 0.5)::BIGINT AS seo_average, floor(avg(content) + 0.5)::BIGINT AS content_average, floor(avg(magento) + 0.5)::BIGINT AS magento_average, {bands('band', (*FIVE[:4], 'bloqueado', 'sin_evaluar'))} FROM z",
    "infer_by_consensus": P + """, v AS (SELECT *, CASE WHEN product_id % 4 = 0 THEN '' WHEN product_id % 3 = 0 THEN upper(forma) WHEN length(principio) > 9 THEN forma ELSE receta END AS via FROM p),
g AS (SELECT principio, concentracion, forma, arg_min(via, seq) FILTER (via <> '') AS proposed FROM v GROUP BY ALL HAVING count(DISTINCT CASE WHEN via <> '' THEN lower(via) END) = 1) SELECT product_id, proposed FROM v JOIN g USING (principio, concentracion, forma) WHERE via = ''""",
    "alternatives": ALT + " SELECT sku, other, rank FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY other) AS rank FROM alt) WHERE rank <= 4",
    "related_products": ALT + """, c AS (SELECT a.sku, b.sku AS other, a.marca <> '' AND a.marca = b.marca AS same_brand FROM q a JOIN q b ON a.cat = b.cat AND a.sku <> b.sku AND ((a.marca <> '' AND a.marca = b.marca) OR (a.fabricante <> '' AND a.fabricante = b.fabricante)))
SELECT * FROM (SELECT sku, other, same_brand, row_number() OVER (PARTITION BY sku ORDER BY same_brand DESC, other) AS rank FROM c WHERE (sku, other) NOT IN (SELECT (sku, other) FROM alt)) WHERE rank <= 4""",
    "export_exclusions": COUNTS + " SELECT CASE WHEN trim(sku) = '' THEN 'no-sku' WHEN product_id % 37 = 0 THEN 'unconfirmed' WHEN errors > 0 THEN 'blocked' WHEN marca = '' THEN 'missing-data' ELSE 'exported' END AS reason, count(*) AS n FROM p JOIN i USING (product_id) GROUP BY 1",
    "work_bucket": COUNTS + " SELECT product_id, CASE WHEN product_id % 41 = 0 THEN 'approved' WHEN errors > 0 THEN 'blocked' WHEN product_id % 37 = 0 THEN 'review' ELSE 'ready' END AS bucket FROM i",
    "complement_eligible": P + " SELECT product_id, cat <> 'med' OR (receta = 'no' AND product_id % 3 = 1) AS eligible FROM p",
    "last_wins_export": P + f" SELECT product_id, sku, position FROM (SELECT *, min(seq) OVER (PARTITION BY {SKU}) AS position, max(seq) OVER (PARTITION BY {SKU}) AS last FROM p WHERE trim(sku) <> '') WHERE seq = last",
    "merchant_feed": P + f" SELECT sku AS id, title, producto || '. ' || contenido AS description, length(title) > 150 AS long_title FROM (SELECT *, max(seq) OVER (PARTITION BY {SKU}) AS last FROM p WHERE trim(sku) <> '' AND marca <> '') WHERE seq = last",
}
