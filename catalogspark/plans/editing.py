"""Queries over bulk edits, findings, facts, links and categories."""

from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.operators import bulk, facts, findings, quality, relations
from catalogspark.operators.schema import CATEGORY_FIELDS
from catalogspark.plans import catalogue
from catalogspark.plans.views import LONG_DUCK, PRODUCTS_DUCK, clean_duck, products, table

P = f"WITH p AS ({PRODUCTS_DUCK})"


def bulk_preview(spark, d):
    p = products(spark, d).withColumn("v", F.map_concat("v", F.create_map(F.lit("tipo"), F.when(F.col("product_id") % 2 == 0, "Gel").otherwise("Crema"))))
    return bulk.preview(p, p.filter("product_id % 3 = 0"), "tipo", "Gel")


def _edited(spark, d):
    p = products(spark, d)
    return p, *bulk.apply(p, bulk.preview(p, p.filter("product_id % 3 = 0"), "fabricante", "Maker 1"), "fabricante", "Maker 1")


def bulk_apply(spark, d):
    return _edited(spark, d)[1].groupBy(F.coalesce(F.col("v")["fabricante"], F.lit("")).alias("fabricante")).agg(F.count("*").alias("n"))


def bulk_undo(spark, d):
    p, out, undo = _edited(spark, d)
    back = bulk.revert(out, undo)
    return back.select("product_id", F.coalesce(F.col("v")["fabricante"], F.lit("-")).alias("fabricante"))


def find_replace_value(spark, d):
    p = products(spark, d)
    return p.filter(F.lower(T.field(F.col("v"), "producto")) == "red widget").select("product_id", F.col("v")["producto"].alias("value"))


def _suggestions(spark, d):
    p = products(spark, d).filter("marca <> ''")
    k = F.col("product_id")
    to = F.when(k % 4 == 0, F.upper("marca")).when(k % 4 == 1, F.col("marca")).otherwise(F.concat("marca", F.lit(" SA")))
    return p.select("product_id", F.lit("marca").alias("field"), F.col("marca").alias("from"), to.alias("to"), F.when(k % 2 == 0, "lote").otherwise("conocimiento").alias("source"))


def group_suggestions(spark, d):
    return bulk.grouped(_suggestions(spark, d))


def merge_suggestion_groups(spark, d):
    return bulk.merged(_suggestions(spark, d))


def _findings(spark, d):
    f = quality.field_problems(products(spark, d))
    axis = F.when(F.col("code") == "required-missing", "content").when(F.col("code") == "invalid-option", "magento").otherwise("health")
    return f.withColumn("axis", axis)


def axis_alerts(spark, d):
    return findings.axis_alerts(_findings(spark, d))


def field_states(spark, d):
    p = products(spark, d)
    return findings.field_states(p.select("product_id", F.explode("v").alias("field", "value")), _findings(spark, d))


def _recommendations(spark, d):
    f = _findings(spark, d)
    kind = F.when(F.col("severity") == "error", F.when(F.col("axis") == "magento", "bloqueo").otherwise("faltante")).when(F.col("severity") == "warning", "contenido").otherwise("mejora")
    return f.select("product_id", kind.alias("class"), "severity", F.concat_ws(":", "code", "field").alias("text"))


def rank_recommendations(spark, d):
    return findings.ranked(_recommendations(spark, d)).select("product_id", "text", F.col("rank").cast("long").alias("rank"))


def next_action(spark, d):
    return findings.next_action(_recommendations(spark, d))


def unify_recommendations(spark, d):
    f = _findings(spark, d).withColumn("points", F.length("code").cast("long"))
    kind = F.when(F.col("severity") == "error", "error").otherwise("mejora")
    rows = f.select("product_id", F.concat_ws(":", "field", "code").alias("id"), F.array("field", "code").alias("keys"), "axis", kind.alias("class"), "points")
    return findings.unified(rows).select("product_id", "cause", "findings", "axes", F.col("best_class").cast("long").alias("best_class"), "points")


def attention_counts(spark, d):
    counts = catalogue.issue_counts(spark, d)
    return counts.select("product_id", F.col("errors").alias("blockers"), (F.col("errors") + F.col("warnings")).alias("attention"), F.col("infos").alias("improvements"))


FILTERS = {"no_brand": "marca = ''", "no_sku": "trim(sku) = ''", "medicines": "cat = 'med'", "noted": "note <> ''", "dear": "price > 1000", "long_title": "length(title) > 38", "no_maker": "fabricante = ''", "other_field": "otro <> ''"}


def filter_counts(spark, d):
    return findings.filter_counts(products(spark, d), FILTERS)


def list_filters(spark, d):
    p = products(spark, d)
    names = F.array_compact(F.array(*[F.when(F.expr(c), name) for name, c in FILTERS.items()]))
    return p.select("product_id", F.explode(names).alias("filter"))


def paginate(spark, d):
    return findings.page(products(spark, d).select("product_id", "title"), ["title", "product_id"], 2, 50)


def canonical_pack_and_strength(spark, d):
    k = F.col("p_partkey")
    n = F.col("p_size").cast("string")
    dose = F.when(k % 5 == 0, F.concat(n, F.lit("MG"))).when(k % 5 == 1, F.concat(n, F.lit(",5 ml / 2 gr"))).when(k % 5 == 2, F.concat(n, F.lit(" ui/ML"))).when(k % 5 == 3, F.concat(n, F.lit(" tabs"))).otherwise(F.concat(n, F.lit(" %")))
    packs = F.when(k % 4 == 0, n).when(k % 4 == 1, F.concat(n, F.lit(" pzas."))).when(k % 4 == 2, F.concat(F.lit("C/ "), n)).when(k % 8 == 3, F.concat(n, F.lit("  tabletas"))).otherwise(F.concat(F.lit("FCO  "), n, F.lit(" ml")))
    return table(spark, d, "part").select("p_partkey", facts.strength(dose).alias("strength"), facts.pack(packs).alias("p")).select("p_partkey", "strength", F.col("p.canonical").alias("pack"), F.col("p.rule").alias("rule"))


def explode_product_facts(spark, d):
    return facts.triples(products(spark, d)).groupBy("predicate", "object").agg(F.count("*").alias("n"))


def observe_products(spark, d):
    p = products(spark, d)
    known = p.filter("product_id % 2 = 0").select("product_id", F.col("marca").alias("subject"), F.lit("brand→category").alias("predicate"), F.col("cat").alias("object"))
    return facts.observations(p, known)


def html_defects(spark, d):
    return facts.markup_defects(table(spark, d, "pages"), "page_id", "html")


def explode_spec_rows(spark, d):
    return facts.spec_rows(table(spark, d, "documents"), "doc_id", "text")


def verify_extraction(spark, d):
    docs = table(spark, d, "documents")
    k = F.col("doc_id")
    cut = F.substring("text", 5, 30)
    evidence = F.when(k % 7 == 0, F.concat(F.lit("no "), cut)).otherwise(cut)
    value = F.when(k % 5 == 0, "zzzqqq").otherwise(F.substring_index(F.trim(F.col("text")), " ", 1))
    proposals = docs.filter("text IS NOT NULL").select("doc_id", F.when(k % 3 == 0, "secreto").otherwise("marca").alias("field"), value.alias("value"), evidence.alias("evidence"))
    return facts.verified(proposals, docs, "doc_id", "text", ["marca", "forma"]).select("doc_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def duplicate_position(spark, d):
    p = products(spark, d).filter("trim(sku) <> ''").withColumn("key", F.lower(T.compact(F.col("sku"))))
    bounds = p.groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    return p.join(bounds, "key").select("product_id", "n", (F.col("seq") == F.col("last")).alias("is_last"))


def complement_status(spark, d):
    k = F.col("product_id")
    p = products(spark, d).select("product_id", "sku", (F.col("cat") != "med").alias("ok"), F.when(k % 4 == 0, "esperando").when(k % 4 == 1, "independiente").alias("comp"))
    linked = p.filter("product_id % 6 = 0").select("sku", F.lit(True).alias("linked")).distinct()
    status = F.when(~F.col("ok"), "no_aplica").when(F.col("linked"), "vinculado").otherwise(F.coalesce("comp", F.lit("sin_evaluar")))
    return p.join(linked, "sku", "left").select("product_id", status.alias("status"))


def grow_dictionary(spark, d):
    p = products(spark, d)
    known = p.filter("product_id < 30").select(T.clean(F.col("principio")).alias("key")).distinct()
    words = p.select(F.explode(F.split("principio", " ")).alias("value")).unionByName(p.select(F.col("principio").alias("value"))).withColumn("key", T.clean(F.col("value"))).filter("key <> ''")
    return words.join(known, "key", "left_anti").groupBy("key").agg(F.min("value").alias("value"), F.count("*").alias("n"))


def data_signatures(spark, d):
    p = products(spark, d)
    return p.groupBy(T.signature(F.col("v")).alias("s")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


def routine_mates(spark, d):
    k = F.col("product_id")
    p = products(spark, d).filter("cat = 'cos'").select("product_id", (k % 3).alias("step"), F.when(k % 4 == 0, "").otherwise(F.concat("producto", F.lit(" rostro"))).alias("zone"))
    return relations.routine_mates(p, "product_id", "step", "zone")


def mine_replace_rules(spark, d):
    e = table(spark, d, "events")
    edits = e.select(F.when(F.col("event_id") % 3 == 0, "marca").otherwise("forma").alias("field"), F.col("event_type").alias("from"), (F.col("user_id") % 5).cast("string").alias("to"))
    return edits.groupBy("field", "from", "to").agg(F.count("*").alias("n")).withColumn("critical", F.col("field") == "marca")


QUERIES = {f.__name__: f for f in (bulk_preview, bulk_apply, bulk_undo, find_replace_value, group_suggestions, merge_suggestion_groups, axis_alerts, field_states, rank_recommendations, next_action, unify_recommendations, attention_counts, filter_counts, list_filters, paginate, canonical_pack_and_strength, explode_product_facts, observe_products, html_defects, explode_spec_rows, verify_extraction, duplicate_position, complement_status, grow_dictionary, data_signatures, routine_mates, mine_replace_rules)}

HAS = lambda f: "cat IN (" + ", ".join(repr(c) for c, keys in CATEGORY_FIELDS.items() if f in keys) + ")"
FIND = catalogue.PROBLEMS + ", x AS (SELECT *, CASE code WHEN 'required-missing' THEN 'content' WHEN 'invalid-option' THEN 'magento' ELSE 'health' END AS axis, CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS t FROM f)"
RECS = FIND + ", r AS (SELECT product_id, t, CASE WHEN severity = 'error' THEN CASE WHEN axis = 'magento' THEN 'bloqueo' ELSE 'faltante' END WHEN severity = 'warning' THEN 'contenido' ELSE 'mejora' END AS class, code || ':' || field AS text FROM x), q AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE class WHEN 'bloqueo' THEN 1 WHEN 'faltante' THEN 4 WHEN 'contenido' THEN 6 ELSE 7 END, t DESC, text) AS rank FROM r)"
SUG = P + ", s AS (SELECT product_id, 'marca' AS field, marca AS \"from\", CASE WHEN product_id % 4 = 0 THEN upper(marca) WHEN product_id % 4 = 1 THEN marca ELSE marca || ' SA' END AS \"to\", product_id % 2 AS source FROM p WHERE marca <> ''), g AS (SELECT * FROM s WHERE \"from\" <> \"to\")"
ORACLE_SQL = {
    "bulk_preview": P + f" SELECT product_id, CASE WHEN NOT ({HAS('tipo')}) THEN '' WHEN product_id % 2 = 0 THEN 'Gel' ELSE 'Crema' END AS \"from\", ({HAS('tipo')}) AND product_id % 2 = 0 AS same, NOT ({HAS('tipo')}) AS not_applicable FROM p WHERE product_id % 3 = 0",
    "bulk_apply": P + f" SELECT CASE WHEN product_id % 3 = 0 AND {HAS('fabricante')} THEN 'Maker 1' ELSE fabricante END AS fabricante, count(*) AS n FROM p GROUP BY 1",
    "bulk_undo": P + " SELECT product_id, CASE WHEN fabricante = '' THEN '-' ELSE fabricante END AS fabricante FROM p",
    "find_replace_value": P + " SELECT product_id, producto AS value FROM p WHERE lower(trim(producto)) = 'red widget'",
    "group_suggestions": SUG + " SELECT field, \"from\", \"to\", count(DISTINCT product_id) AS products FROM g GROUP BY ALL",
    "merge_suggestion_groups": SUG + " SELECT field, lower(\"from\") AS from_key, lower(\"to\") AS to_key, count(DISTINCT product_id) AS products, count(DISTINCT source) AS sources FROM g GROUP BY ALL",
    "axis_alerts": FIND + " SELECT product_id, axis, count(*) AS open, CASE max(t) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS worst, arg_min(code, {'a': -t, 'b': code}) AS first_code FROM x GROUP BY product_id, axis",
    "field_states": FIND + ", w AS (SELECT product_id, field, max(t) AS t FROM x WHERE field <> '' GROUP BY ALL) SELECT product_id, field, CASE t WHEN 3 THEN 'error' WHEN 2 THEN 'warning' WHEN 1 THEN 'info' ELSE CASE WHEN trim(coalesce(value, '')) <> '' THEN 'ok' ELSE 'pending' END END AS state FROM l FULL JOIN w USING (product_id, field)",
    "rank_recommendations": RECS + " SELECT product_id, text, rank FROM q",
    "next_action": RECS + " SELECT product_id, class, text FROM q WHERE rank = 1",
    "unify_recommendations": FIND + """, y AS (SELECT DISTINCT product_id, field, code, axis, severity, field || ':' || code AS id FROM x), e AS (SELECT a.product_id, a.id AS a, b.id AS b FROM y a JOIN y b ON a.product_id = b.product_id AND (a.field = b.field OR a.code = b.code OR a.field = b.code OR a.code = b.field)),
z AS (WITH RECURSIVE r AS (SELECT product_id, id, id AS t FROM y UNION SELECT r.product_id, r.id, e.b FROM r JOIN e ON e.product_id = r.product_id AND e.a = r.t) SELECT product_id, id, min(t) AS cause FROM r GROUP BY ALL)
SELECT product_id, cause, count(*) AS findings, string_agg(DISTINCT axis, ',' ORDER BY axis) AS axes, min(CASE severity WHEN 'error' THEN 2 ELSE 7 END)::BIGINT AS best_class, max(length(code))::BIGINT AS points FROM y JOIN z USING (product_id, id) GROUP BY product_id, cause""",
    "attention_counts": catalogue.COUNTS + " SELECT product_id, errors AS blockers, errors + warnings AS attention, infos AS improvements FROM i",
    "filter_counts": P + " SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in FILTERS.items()) + " FROM p",
    "list_filters": P + " " + " UNION ALL ".join(f"SELECT product_id, '{n}' AS filter FROM p WHERE {c}" for n, c in FILTERS.items()),
    "paginate": P + " SELECT product_id, title FROM p ORDER BY title, product_id LIMIT 50 OFFSET 50",
    "canonical_pack_and_strength": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || ' mg' WHEN 1 THEN p_size || '.5 mL/2 g' WHEN 2 THEN p_size || ' UI/mL' WHEN 4 THEN p_size || ' %' END AS strength, CASE p_partkey % 4 WHEN 0 THEN p_size || ' piezas' WHEN 1 THEN p_size || ' piezas' WHEN 2 THEN 'Caja con ' || p_size || CASE WHEN p_size = 1 THEN ' pieza' ELSE ' piezas' END ELSE CASE WHEN p_partkey % 8 = 7 THEN 'Frasco ' || p_size || ' ml' WHEN p_size = 1 THEN '1 tableta' ELSE p_size || ' tabletas' END END AS pack, CASE p_partkey % 4 WHEN 0 THEN 'existing.bare-number→piezas' WHEN 1 THEN 'seed.presentation.pzas→piezas' WHEN 2 THEN 'existing.c/N→Caja con N piezas' ELSE CASE WHEN p_partkey % 8 = 7 OR p_size = 1 THEN 'existing.expand' ELSE 'none' END END AS rule FROM part",
    "explode_product_facts": P + """, t AS (SELECT title AS s, 'product→brand' AS predicate, marca AS object FROM p UNION ALL SELECT title, 'product→pharmaceuticalForm', forma FROM p UNION ALL SELECT title, 'product→category', cat FROM p UNION ALL SELECT marca, 'brand→laboratory', fabricante FROM p UNION ALL SELECT marca, 'brand→substance', principio FROM p UNION ALL SELECT marca, 'brand→category', cat FROM p)
SELECT predicate, object, count(*) AS n FROM t WHERE s <> '' AND object <> '' GROUP BY ALL""",
    "observe_products": P + """, t AS (SELECT product_id, marca AS subject, 'brand→laboratory' AS predicate, fabricante AS object FROM p UNION ALL SELECT product_id, marca, 'brand→substance', principio FROM p UNION ALL SELECT product_id, marca, 'brand→category', cat FROM p WHERE product_id % 2 <> 0) SELECT * FROM t WHERE subject <> '' AND object <> ''""",
    "html_defects": r"""WITH RECURSIVE t AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '</?[a-zA-Z][\w-]*\b[^>]*>')) AS t FROM pages),
u AS (SELECT page_id, lower(regexp_extract(t, '^</?([a-zA-Z][\w-]*)', 1)) AS tag, starts_with(t, '</') AS closing, row_number() OVER () AS o FROM t WHERE NOT ends_with(t, '/>')),
n AS (SELECT page_id, tag, closing, row_number() OVER (PARTITION BY page_id ORDER BY o) AS i FROM u WHERE tag NOT IN ('br', 'hr', 'img', 'meta', 'input', 'link')),
s AS (SELECT DISTINCT page_id, 0::BIGINT AS i, []::VARCHAR[] AS open, NULL::VARCHAR AS lost FROM n
UNION ALL SELECT s.page_id, n.i, CASE WHEN NOT closing THEN list_append(open, tag) WHEN open[-1] = tag THEN open[:len(open) - 1] ELSE open END, CASE WHEN closing AND open[-1] IS DISTINCT FROM tag THEN tag END FROM s JOIN n ON n.page_id = s.page_id AND n.i = s.i + 1)
SELECT DISTINCT page_id, lost AS tag, 'unopened' AS defect FROM s WHERE lost IS NOT NULL UNION ALL SELECT DISTINCT page_id, tag, 'unclosed' FROM (SELECT page_id, unnest(arg_max(open, i)) AS tag FROM s GROUP BY page_id)
UNION ALL SELECT page_id, '', 'empty' FROM pages WHERE regexp_matches(coalesce(html, ''), '(?i)<p>\s*</p>|<li>\s*</li>|<h1>\s*</h1>|<h2>\s*</h2>|<h3>\s*</h3>|<h4>\s*</h4>|<h5>\s*</h5>|<h6>\s*</h6>|<td>\s*</td>|<th>\s*</th>|<strong>\s*</strong>')""",
    "explode_spec_rows": "WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents) SELECT doc_id, line, trim(split_part(t, '|', 1)) AS name, trim(substring(t, instr(t, '|') + 1)) AS value FROM l WHERE contains(t, '|')",
    "verify_extraction": """WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN 'no ' ELSE '' END || substring(text, 5, 30) AS evidence, CASE WHEN doc_id % 5 = 0 THEN 'zzzqqq' ELSE split_part(trim(text), ' ', 1) END AS value FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(value), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS v, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') AS t FROM d)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'field' WHEN NOT contains(text, evidence) THEN 'evidence' WHEN NOT list_has_all(t, v) THEN 'value' ELSE 'accepted' END AS reason FROM w""",
    "duplicate_position": P + f" SELECT product_id, count(*) OVER (PARTITION BY {catalogue.SKU}) AS n, seq = max(seq) OVER (PARTITION BY {catalogue.SKU}) AS is_last FROM p WHERE trim(sku) <> ''",
    "complement_status": P + ", k AS (SELECT DISTINCT sku FROM p WHERE product_id % 6 = 0) SELECT product_id, CASE WHEN cat = 'med' THEN 'no_aplica' WHEN sku IN (SELECT sku FROM k) THEN 'vinculado' WHEN product_id % 4 = 0 THEN 'esperando' WHEN product_id % 4 = 1 THEN 'independiente' ELSE 'sin_evaluar' END AS status FROM p",
    "grow_dictionary": P + f", w AS (SELECT unnest(string_split(principio, ' ')) AS value FROM p UNION ALL SELECT principio FROM p), k AS (SELECT {clean_duck('value')} AS key, value FROM w) SELECT key, min(value) AS value, count(*) AS n FROM k WHERE key <> '' AND key NOT IN (SELECT {clean_duck('principio')} FROM p WHERE product_id < 30) GROUP BY key",
    "data_signatures": P + f", l AS ({LONG_DUCK}), s AS (SELECT product_id, string_agg(field || '=' || value, ';' ORDER BY field) AS s FROM l GROUP BY product_id), g AS (SELECT count(*) AS n FROM s GROUP BY s) SELECT n, count(*) AS groups FROM g GROUP BY n",
    "routine_mates": P + """, z AS (SELECT product_id, product_id % 3 AS step, CASE WHEN product_id % 4 = 0 THEN '' ELSE producto || ' rostro' END AS zone FROM p WHERE cat = 'cos'), w AS (SELECT *, list_filter(regexp_split_to_array(lower(zone), '[^a-z]+'), lambda x: length(x) > 3) AS words FROM z)
SELECT a.product_id, count(*) AS mates FROM w a JOIN w b ON a.step <> b.step AND (a.zone = '' OR b.zone = '' OR list_has_any(a.words, b.words)) GROUP BY a.product_id""",
    "mine_replace_rules": "SELECT CASE WHEN event_id % 3 = 0 THEN 'marca' ELSE 'forma' END AS field, event_type AS \"from\", (user_id % 5)::VARCHAR AS \"to\", count(*) AS n, event_id % 3 = 0 AS critical FROM events GROUP BY ALL",
}
