"""Queries over language, nutrition tables, links, dictionaries and human decisions."""

import re

from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.functions.session import spread
from catalogspark.operators import decisions, knowledge, language, links, nutrition
from catalogspark.operators.relations import complement_eligible
from catalogspark.plans import records
from catalogspark.plans.catalogue import COUNTS, SPECIALTY, export_exclusions
from catalogspark.plans.views import PRODUCTS_DUCK, products, table

P = f"WITH p AS ({PRODUCTS_DUCK})"
#: Short copy of a product, with words that the lists know.
COPY = "concat(producto, CASE product_id % 6 WHEN 0 THEN ' ideal para limpieza' WHEN 1 THEN ', el mejor protector solar' WHEN 2 THEN ' Garantizado: crema para piel sensible' WHEN 3 THEN ' trata la dermatitis todo el día' WHEN 4 THEN ' cómodo, 100 % efectivo' ELSE '' END)"


def lint_language(spark, d):
    return language.lint(products(spark, d).withColumn("copy", F.expr(COPY)), "product_id", "copy", "cat")


def classify_routine_step(spark, d):
    return products(spark, d).select("product_id", language.routine_step(F.expr(COPY)).alias("step"))


def sunscreen_level(spark, d):
    factor = F.when(F.col("product_id") % 4 == 0, F.concat("fps", F.lit("+"))).otherwise(F.col("fps"))
    return products(spark, d).select("product_id", language.sunscreen_level(factor).alias("level"))


# -- nutrition ---------------------------------------------------------------------------------------------------------

TABLE = """concat('# Nutriente | Por porción | % VD', chr(10), 'de los cuales', chr(10), 'ENERGÍA: | ', CAST(p_size * 9 AS STRING), ' kcal (', CAST(p_size * 38 AS STRING), ' kJ) | ', CAST(p_size AS STRING), '%', chr(10),
  'Proteínas | ', CAST(p_size AS STRING), ',5 g', chr(10), '- Azúcares | <1 mg', chr(10), 'Vitaminas', chr(10), 'Carbohidratos totales | ', CAST(p_size % 7 AS STRING), 'G | ', chr(10), 'Grasas | ', CAST(p_partkey % 5 AS STRING), ' g', chr(10), 'Porción | 30 g', chr(10), 'Sodio |')"""


def _tables(spark, d):
    return nutrition.lines(spread(table(spark, d, "part"), "p_partkey").withColumn("block", F.expr(TABLE)), "p_partkey", "block")


def explode_nutrition(spark, d):
    return _tables(spark, d).select("p_partkey", F.col("line").cast("long").alias("line"), "kind", "name", "sub", F.array_join("cells", " | ").alias("cells"))


def check_nutrition_energy(spark, d):
    return nutrition.energy_gaps(_tables(spark, d), "p_partkey").select("p_partkey", F.col("column").cast("long").alias("column"), "declared", "expected")


# -- links -------------------------------------------------------------------------------------------------------------


def _links(spark, d):
    """Products that stand first and second on one order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"))
    a, b = (li.filter(F.col("l_linenumber") == n).select("l_orderkey", F.col("k").alias(name)) for n, name in ((1, "parent"), (2, "child")))
    return a.join(b, "l_orderkey").filter("parent <> child").select("parent", "child")


def _entries(spark, d):
    state = F.when(F.col("product_id") % 4 == 0, "esperando").when(F.col("product_id") % 4 == 1, "vinculado").when(F.col("product_id") % 4 == 2, "sin_evaluar").otherwise("independiente")
    eligible = complement_eligible(F.col("cat"), F.col("receta"), F.expr(SPECIALTY))
    return products(spark, d).select(F.col("product_id").alias("sku"), "cat", "title", eligible.alias("eligible"), state.alias("state"), (F.col("fabricante") != "").alias("parent"))


def catalogue_crosssell(spark, d):
    return links.crosssell(_links(spark, d), _entries(spark, d))


def upsert_entry(spark, d):
    e = _entries(spark, d)
    items = e.filter("sku % 3 = 0").select(F.col("sku").cast("string").alias("sku"), F.upper("title").alias("title"), (F.col("eligible") & (F.col("sku") % 2 == 0)).alias("eligible"))
    return links.upserted(e.filter("sku % 5 <> 0").withColumn("sku", F.col("sku").cast("string")).select("sku", "title", "eligible", "state"), items)


def lost_links(spark, d):
    return links.lost_links(_links(spark, d), _entries(spark, d))


def link_candidates(spark, d):
    return links.link_candidates(_entries(spark, d), _links(spark, d))


def parent_candidates(spark, d):
    return links.parent_candidates(_entries(spark, d), _links(spark, d))


def dictionary_contains(spark, d):
    p = table(spark, d, "part")
    aliases = p.select(F.explode(F.array("p_brand", "p_name", F.substring_index("p_name", " ", -1))).alias("alias")).distinct()
    return links.contained(products(spark, d), "product_id", "title", aliases.withColumn("canon", F.upper("alias"))).select("product_id", "alias", "canon", F.col("rank").cast("long").alias("rank"), F.col("at").cast("long").alias("first_char"), F.col("size").cast("long").alias("n_chars"))


# -- dictionaries and decisions ----------------------------------------------------------------------------------------


def _dictionaries(spark, d):
    code = lambda k, n: F.when(F.col(k) % n == 0, "").otherwise(F.concat(F.lit("A"), (F.col(k) % 10).cast("string")))
    rows = lambda t, k, b, n: table(spark, d, t).select(F.col(k).alias("key"), code(k, n).alias("code"), F.when(F.col(k) % 2 == 0, "").otherwise(t).alias("source"), (F.col(b) > 5000).alias("verified"))
    return rows("supplier", "s_suppkey", "s_acctbal", 3), rows("customer", "c_custkey", "c_acctbal", 4)


def merge_dictionary(spark, d):
    return decisions.merged_dictionary(*_dictionaries(spark, d))


def merge_store_categories(spark, d):
    mine, theirs = (x.select("key", "source") for x in _dictionaries(spark, d))
    return mine.unionByName(theirs.join(mine.select("key"), "key", "left_anti"))


def _judged(spark, d, evidence):
    by = knowledge.evidence_counts(evidence, ["subject", "predicate", "object"])
    return by.withColumn("confidence", knowledge.confidence(F.lit(records.AS_OF).cast("timestamp"))).withColumn("status", knowledge.status(F.col("confidence"))).select("subject", "object", "confidence", "status")


def supersede_evidence(spark, d):
    edited = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("ref"))
    evidence = spread(records._evidence(spark, d), "ref", rows=table(spark, d, "lineitem").count())  # joined and counted in tasks of bounded memory
    return _judged(spark, d, decisions.superseded(evidence, edited).filter("NOT superseded"))


def _people(spark, d):
    """A judgement of a brand's maker by each fiftieth line, and the day of it."""
    return records._evidence(spark, d).filter("kind = 'ai' AND ref % 8 = 0").select("subject", "predicate", "object", (F.col("ref") % 16 == 0).alias("accepted"), "ref", "at")


def confirm_reject(spark, d):
    return _judged(spark, d, decisions.decided(records._evidence(spark, d), _people(spark, d)))


def resolve_conflict(spark, d):
    """Each brand with several live makers is settled on its strongest one."""
    live = records._relations(spark, d).filter("status <> 'rejected'").select("subject", "predicate", "object", "confidence")
    choices = live.groupBy("subject", "predicate").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "object"))["object"].alias("object"), F.count("*").alias("n")).filter("n > 1").withColumns({"ref": F.lit(0).cast("long"), "at": F.lit(records.AS_OF).cast("date")})
    return _judged(spark, d, decisions.decided(records._evidence(spark, d), decisions.choice_evidence(live.select("subject", "predicate", "object"), choices)))


def add_alias(spark, d):
    p = table(spark, d, "part")
    return decisions.aliases(p.select(F.substring_index("p_name", " ", 1).alias("alias"), F.col("p_type").alias("entity")).unionByName(p.select(F.col("p_brand").alias("alias"), F.col("p_brand").alias("entity"))))


def rename_canonical(spark, d):
    k = F.col("c_custkey")
    new = F.when(k % 4 == 0, F.upper("c_name")).when(k % 4 == 1, F.replace("c_name", F.lit("#"), F.lit("  "))).when(k % 4 == 2, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))
    return decisions.renames(table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("old"), new.alias("new")))


def correction_level(spark, d):
    """Corrections of a field by what is known of each brand's makers."""
    r = records._relations(spark, d).withColumn("n", F.col("observed") + F.col("imported"))
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("n") % len(names)).cast("int") + 1)
    field, type_, kind = pick(("forma", "marca", "contenido")), pick(("unit", "category", "brand", "presentation")), pick(("alias", "seed", "alias", "ai", "alias", "mismatch", "alias"))
    level = decisions.correction_level(field, type_, kind, F.col("status"), F.col("confidence"), F.col("n") % 13 == 0, F.col("n") % 5 != 0)
    return r.select("subject", "object", level.alias("level"))


def export_counters(spark, d):
    long = products(spark, d).filter(F.length("title") > 38).agg(F.lit("long-title").alias("reason"), F.count("*").alias("n"))
    return export_exclusions(spark, d).unionByName(long)


def auto_correction_groups(spark, d):
    """Corrections of white space, by field, text before and after."""
    rows = products(spark, d).select(F.explode("v").alias("field", "from")).withColumn("to", T.tidy(F.col("from")))
    return rows.filter(F.col("from") != F.col("to")).groupBy("field", "from", "to").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (lint_language, classify_routine_step, sunscreen_level, explode_nutrition, check_nutrition_energy, catalogue_crosssell, upsert_entry, lost_links, link_candidates, parent_candidates, dictionary_contains, merge_dictionary, merge_store_categories, supersede_evidence, confirm_reject, resolve_conflict, add_alias, rename_canonical, correction_level, export_counters, auto_correction_groups)}

_TERMS = lambda terms: ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in terms)
STEP = "CASE " + " ".join(f"WHEN regexp_matches(copy, '(?i){pattern}') THEN '{step}'" for step, pattern in language.ROUTINE) + " ELSE '' END"
COPIES = P + f", q AS (SELECT product_id, {COPY} AS copy FROM p)"
LINKS = ", k AS (SELECT DISTINCT a.l_partkey AS parent, b.l_partkey AS child FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_partkey <> b.l_partkey)"
ENTRIES = P + ", e AS (SELECT product_id AS sku, cat, title, cat <> 'med' OR (receta = 'no' AND product_id % 3 = 1) AS eligible, CASE product_id % 4 WHEN 0 THEN 'esperando' WHEN 1 THEN 'vinculado' WHEN 2 THEN 'sin_evaluar' ELSE 'independiente' END AS state, fabricante <> '' AS parent FROM p)" + LINKS
DICTIONARIES = "WITH m AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'A' || (s_suppkey % 10) END AS code, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'supplier' END AS source, s_acctbal > 5000 AS verified FROM supplier), t AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'A' || (c_custkey % 10) END AS code, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'customer' END AS source, c_acctbal > 5000 AS verified FROM customer)"
JUDGED = " SELECT subject, object, confidence, status FROM r"
MORE = lambda rows: records.REL.replace("g AS (SELECT subject", f"v2 AS (SELECT * FROM v UNION ALL {rows}), g AS (SELECT subject", 1).replace("FROM v GROUP BY ALL", "FROM v2 GROUP BY ALL", 1)
# the same judgement under other names, before decisions are added
_LIVE = re.sub(r"\b([vghijr]) AS \(SELECT|FROM ([vghij])\b", lambda m: f"{m[1]}0 AS (SELECT" if m[1] else f"FROM {m[2]}0", records.REL.removeprefix("WITH "))
_BLOCK = TABLE.replace("AS STRING", "AS VARCHAR")
_UNITS = "CASE lower(u) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in nutrition.UNITS.items()) + " END"
NUTRITION = f"""WITH b AS (SELECT p_partkey, list_filter(list_transform(string_split({_BLOCK}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM part),
r AS (SELECT p_partkey, unnest(range(0, len(l))) AS line, unnest(l) AS raw FROM b), h AS (SELECT *, line = 0 AND starts_with(raw, '#') AS head FROM r),
s AS (SELECT *, NOT head AND regexp_matches(raw, '^[-•–]') AS sub, CASE WHEN head THEN regexp_replace(raw, '^#+\\s*', '') ELSE regexp_replace(raw, '^[-•–]\\s*', '') END AS t FROM h),
w AS (SELECT *, regexp_replace(t, '[:\\s]+$', '') AS plain, string_split_regex(t, '\\s*[|\\t]\\s*') AS parts, regexp_matches(t, '[|\\t]') AS bar FROM s),
x AS (SELECT *, list_filter(parts[2:], lambda x: x <> '') AS raws, CASE WHEN regexp_replace(parts[1], '[:\\s]+$', '') = upper(regexp_replace(parts[1], '[:\\s]+$', '')) THEN upper(parts[1][1]) || lower(regexp_replace(parts[1], '[:\\s]+$', '')[2:]) ELSE regexp_replace(parts[1], '[:\\s]+$', '') END AS name FROM w),
y AS (SELECT *, CASE WHEN head THEN 'head' WHEN NOT bar AND regexp_matches(plain, '(?i)^de\\s+(los|las|la|el)\\s+(cuales?|cual)\\b') THEN 'note' WHEN NOT bar THEN 'title' WHEN name = '' THEN 'unnamed' WHEN regexp_matches(name, '(?i)^porci[oó]n$') THEN 'portion' WHEN len(raws) = 0 THEN 'no-amount' ELSE 'row' END AS kind FROM x),
c AS (SELECT p_partkey, line, i, raw AS v, regexp_extract(raw, '^([<≤~]?\\s*)(\\d+(?:[.,]\\d+)?)\\s*(.+)$', ['a', 'n', 'u']) AS m FROM (SELECT p_partkey, line, unnest(range(0, len(raws))) AS i, unnest(raws) AS raw FROM y WHERE NOT head)),
d AS (SELECT p_partkey, line, i, CASE WHEN coalesce({_UNITS.replace('lower(u)', 'lower(m.u)')}, '') <> '' THEN m.a || m.n || ' ' || {_UNITS.replace('lower(u)', 'lower(m.u)')} ELSE v END AS v FROM c),
j AS (SELECT p_partkey, line, string_agg(v, ' | ' ORDER BY i) AS cells FROM d GROUP BY ALL)"""
ORACLE_SQL = {
    "lint_language": COPIES + f", t(list, term, pattern) AS (VALUES {_TERMS(language.TERMS)}), o(list, term, pattern) AS (VALUES {_TERMS(language.COSMETIC_TERMS)}) SELECT product_id, list, term FROM q JOIN t ON regexp_matches(copy, '(?i)' || pattern) UNION ALL SELECT q.product_id, list, term FROM q JOIN p USING (product_id) JOIN o ON p.cat = 'cos' AND regexp_matches(copy, '(?i)' || pattern)",
    "classify_routine_step": COPIES + f" SELECT product_id, {STEP} AS step FROM q",
    "sunscreen_level": P + ", q AS (SELECT product_id, regexp_extract(fps, '\\d+') AS n, product_id % 4 = 0 AS plus FROM p) SELECT product_id, CASE WHEN n = '' OR n::INT < 6 THEN '' WHEN n::INT < 15 THEN 'Baja' WHEN n::INT < 30 THEN 'Media' WHEN n::INT < 50 OR (n::INT = 50 AND NOT plus) THEN 'Alta' ELSE 'Muy alta' END AS level FROM q",
    "explode_nutrition": NUTRITION + " SELECT p_partkey, line, kind, CASE kind WHEN 'head' THEN '' WHEN 'note' THEN plain WHEN 'title' THEN plain ELSE name END AS name, sub, CASE WHEN head THEN list_aggregate(parts, 'string_agg', ' | ') ELSE coalesce(cells, '') END AS cells FROM y LEFT JOIN j USING (p_partkey, line)",
    "check_nutrition_energy": "WITH n AS (SELECT p_partkey, (p_size * 9)::DOUBLE AS declared, 4 * (p_size + 0.5::DOUBLE) + 4 * (p_size % 7) + 9 * (p_partkey % 5) AS expected FROM part) SELECT p_partkey, 0::BIGINT AS \"column\", declared, expected FROM n WHERE abs(declared - expected) > greatest(10.0::DOUBLE, expected * 0.2::DOUBLE)",
    "catalogue_crosssell": ENTRIES + " SELECT parent, child FROM k JOIN e a ON a.sku = k.parent JOIN e b ON b.sku = k.child WHERE b.eligible".replace("SELECT parent", "SELECT k.parent").replace(", child FROM", ", k.child FROM"),
    "upsert_entry": ENTRIES + ", o AS (SELECT * FROM e WHERE sku % 5 <> 0), n AS (SELECT sku, upper(title) AS title, eligible AND sku % 2 = 0 AS eligible FROM e WHERE sku % 3 = 0) SELECT coalesce(o.sku, n.sku)::VARCHAR AS sku, coalesce(n.title, o.title) AS title, coalesce(n.eligible, o.eligible) AS eligible, CASE WHEN n.sku IS NULL THEN o.state WHEN NOT n.eligible THEN 'no_aplica' WHEN o.sku IS NULL THEN 'sin_evaluar' ELSE o.state END AS state, o.sku IS NULL AS is_new FROM o FULL JOIN n ON n.sku = o.sku",
    "lost_links": ENTRIES + " SELECT k.parent, k.child FROM k JOIN e ON e.sku = k.child WHERE NOT e.eligible",
    "link_candidates": ENTRIES + " SELECT a.sku, count(*) FILTER (b.state = 'esperando') AS waiting, count(*) FILTER (b.state NOT IN ('esperando', 'independiente')) AS others FROM e a LEFT JOIN e b ON b.cat = a.cat AND b.sku <> a.sku AND b.eligible AND NOT EXISTS (SELECT 1 FROM k WHERE k.parent = a.sku AND k.child = b.sku) WHERE a.parent GROUP BY a.sku",
    "parent_candidates": ENTRIES + " SELECT a.sku, count(b.sku) AS parents FROM e a LEFT JOIN e b ON b.cat = a.cat AND b.sku <> a.sku AND b.parent AND NOT EXISTS (SELECT 1 FROM k WHERE k.parent = b.sku AND k.child = a.sku) WHERE a.eligible GROUP BY a.sku",
    "dictionary_contains": P + ", a AS (SELECT p_brand AS alias FROM part UNION SELECT p_name FROM part UNION SELECT split_part(p_name, ' ', -1) FROM part), h AS (SELECT product_id, alias, upper(alias) AS canon, instr(' ' || lower(title) || ' ', ' ' || lower(alias) || ' ') AS first_char, length(alias) AS n_chars FROM p JOIN a ON regexp_matches(lower(title), '(^|[^a-z0-9_])' || regexp_escape(lower(alias)) || '($|[^a-z0-9_])')), f AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h l WHERE l.product_id = h.product_id AND l.n_chars > h.n_chars AND l.first_char < h.first_char + h.n_chars AND h.first_char < l.first_char + l.n_chars)) SELECT product_id, alias, canon, row_number() OVER (PARTITION BY product_id ORDER BY n_chars DESC, first_char) AS rank, first_char, n_chars FROM f",
    "merge_dictionary": DICTIONARIES + """, x AS (SELECT coalesce(m.key, t.key) AS key, m, t, CASE WHEN m.key IS NULL THEN 'added' WHEN t.key IS NULL THEN 'own' WHEN NOT m.verified AND t.verified THEN 'replaced' WHEN NOT m.verified AND m.code = '' AND t.code <> '' THEN 'filled' ELSE 'kept' END AS action FROM m FULL JOIN t USING (key))
SELECT key, CASE WHEN action IN ('added', 'replaced', 'filled') THEN t.code ELSE m.code END AS code, CASE WHEN action IN ('added', 'replaced') OR (action = 'filled' AND m.source = '') THEN t.source ELSE m.source END AS source, CASE WHEN action IN ('added', 'replaced') THEN t.verified ELSE m.verified END AS verified, action FROM x""",
    "merge_store_categories": DICTIONARIES + " SELECT key, source FROM m UNION ALL SELECT key, source FROM t WHERE key NOT IN (SELECT key FROM m)",
    "supersede_evidence": records.REL.replace("FROM v GROUP BY ALL", "FROM v WHERE NOT (kind IN ('observed', 'imported') AND ref IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')) GROUP BY ALL", 1) + JUDGED,
    "confirm_reject": MORE("SELECT subject, object, ref, day, CASE WHEN ref % 16 = 0 THEN 'confirmed' ELSE 'rejected' END FROM v WHERE kind = 'ai' AND ref % 8 = 0") + JUDGED,
    "resolve_conflict": MORE("SELECT subject, object, 0, DATE '2002-01-01', CASE WHEN best = 1 THEN 'confirmed' ELSE 'rejected' END FROM (SELECT *, count(*) OVER (PARTITION BY subject) AS many, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, object) AS best FROM r0 WHERE status <> 'rejected') WHERE many > 1").replace("WITH v AS", "WITH " + _LIVE + ", v AS", 1) + JUDGED,
    "add_alias": "WITH a AS (SELECT lower(split_part(p_name, ' ', 1)) AS alias, p_type AS entity FROM part UNION ALL SELECT trim(regexp_replace(lower(p_brand), '[^a-z0-9%./+]+', ' ', 'g')), p_brand FROM part) SELECT alias, CASE WHEN count(DISTINCT entity) = 1 THEN min(entity) END AS entity, CASE WHEN count(DISTINCT entity) = 1 THEN 'alias' ELSE 'conflict' END AS state FROM a GROUP BY alias",
    "rename_canonical": "WITH n AS (SELECT c_custkey AS id, c_name AS old, CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN replace(c_name, '#', '  ') WHEN 2 THEN c_name || 'x' ELSE c_name END AS new FROM customer), m AS (SELECT *, c_custkey_same AS ok FROM (SELECT *, trim(regexp_replace(lower(old), '[^a-z0-9%./+]+', ' ', 'g')) = trim(regexp_replace(lower(new), '[^a-z0-9%./+]+', ' ', 'g')) AND old <> new AS c_custkey_same FROM n)) SELECT id, CASE WHEN ok THEN new ELSE old END AS canonical, ok AS accepted FROM m",
    "correction_level": records.REL + """, x AS (SELECT *, observed + imported AS n, ['forma', 'marca', 'contenido'][((observed + imported) % 3 + 1)::INT] AS field, ['unit', 'category', 'brand', 'presentation'][((observed + imported) % 4 + 1)::INT] AS type, ['alias', 'seed', 'alias', 'ai', 'alias', 'mismatch', 'alias'][((observed + imported) % 7 + 1)::INT] AS kind, status IN ('confirmed', 'trusted') AS known FROM r)
SELECT subject, object, CASE WHEN n % 13 = 0 THEN 'review' WHEN status = 'rejected' THEN 'suggest' WHEN kind = 'mismatch' THEN CASE WHEN known THEN 'review' ELSE 'suggest' END WHEN field = 'marca' OR type = 'brand' THEN CASE WHEN known AND confidence >= 0.6 THEN 'assisted' ELSE 'suggest' END WHEN kind = 'ai' THEN 'suggest'
  WHEN kind = 'seed' THEN CASE WHEN n % 5 <> 0 THEN 'automatic' ELSE 'assisted' END WHEN known AND confidence >= 0.85 AND n % 5 <> 0 THEN 'automatic' WHEN confidence >= 0.6 THEN 'assisted' ELSE 'suggest' END AS level FROM x""",
    "export_counters": COUNTS + " SELECT CASE WHEN trim(sku) = '' THEN 'no-sku' WHEN product_id % 37 = 0 THEN 'unconfirmed' WHEN errors > 0 THEN 'blocked' WHEN marca = '' THEN 'missing-data' ELSE 'exported' END AS reason, count(*) AS n FROM p JOIN i USING (product_id) GROUP BY 1 UNION ALL SELECT 'long-title', count(*) FROM p WHERE length(title) > 38",
    "auto_correction_groups": COUNTS + " SELECT field, value AS \"from\", tidy AS \"to\", count(*) AS n FROM k WHERE value <> tidy GROUP BY ALL",
}
