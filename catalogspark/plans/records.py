"""Queries over external records, audit events, knowledge, dictionaries and merges."""

from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.operators import audit, dictionary, knowledge, merge, relations, sync
from catalogspark.plans.views import PRODUCTS_DUCK, clean_duck, compact_duck, products, table
from catalogspark.sources import records

AS_OF = "2002-01-01 00:00:00"


# -- external records: orders against a cache of them ----------------------------------------------------------------


def _orders(spark, d, cached: bool = False):
    o = table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    if cached:
        o = o.filter("o_orderkey % 11 <> 0").withColumn("cents", F.when(F.col("o_orderkey") % 7 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
        o = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 21 == 0, "X").otherwise(F.col("o_orderstatus")))
    data = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("total"), F.col("cents").cast("string"), F.lit("priority"), F.col("o_orderpriority"))
    return o.select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("seq"), data.alias("data"))


def _envelopes(spark, d, cached=False):
    return sync.envelope(_orders(spark, d, cached), "erp", F.col("o_orderkey"), F.col("data"), F.lit("e1"))


def envelope_records(spark, d):
    return _envelopes(spark, d).select("source_id", "record_id", "checksum")


def incremental_changes(spark, d):
    return sync.changed(_envelopes(spark, d), _envelopes(spark, d, True)).select("record_id", "checksum")


def record_diff(spark, d):
    return sync.field_changes(_orders(spark, d, True), _orders(spark, d), "o_orderkey")


def _classified(spark, d):
    return sync.classified(_orders(spark, d), record_diff(spark, d), "o_orderkey", ["total"], True)


def classify_records(spark, d):
    return _classified(spark, d)


def sync_summary(spark, d):
    return sync.sync_summary(_classified(spark, d), F.count("*"), F.count(F.when(F.col("n_changes") == 0, 1)))


def apply_decisions(spark, d):
    decisions = _classified(spark, d).select("o_orderkey", F.when(F.col("action") == "suggest", "accept").otherwise("keep").alias("decision"))
    out = sync.overlaid(_orders(spark, d, True), _orders(spark, d), decisions, "o_orderkey")
    return out.select("o_orderkey", F.col("data")["status"].alias("status"), F.col("data")["total"].alias("total"))


def first_wins(spark, d):
    return sync.first_wins(_orders(spark, d), ["o_custkey"]).select("o_custkey", "o_orderkey")


def project_field_map(spark, d):
    out = records.project_fields(_orders(spark, d), {"estado": "status", "importe": "total", "nada": "none"})
    return out.select("o_orderkey", F.array_join(F.array_sort(F.map_keys("data")), ",").alias("keys"), F.col("data")["importe"].alias("importe"))


def unwrap_payload(spark, d):
    e = table(spark, d, "events").filter("props IS NOT NULL")
    k = F.col("event_id") % 4
    payload = F.when(k == 0, F.concat(F.lit('{"items":['), "props", F.lit(","), "props", F.lit("]}"))).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 2, F.concat(F.lit('{"total":1,"rows":['), "props", F.lit("]}"))).otherwise(F.col("props"))
    out = records.unwrap_payload(e.select("event_id", payload.alias("payload")), "payload")
    return out.select("event_id", F.get_json_object("record", "$.k").cast("long").alias("k"))


def matrix_to_rows(spark, d):
    s = table(spark, d, "supplier")
    body = s.select(F.col("s_nationkey").cast("long").alias("sheet"), (F.col("s_suppkey") + 1).alias("row"), F.array("s_name", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_nationkey").cast("string")), F.col("s_suppkey").cast("string")).alias("cells"))
    header = s.select(F.col("s_nationkey").cast("long").alias("sheet")).distinct().select("sheet", F.lit(0).cast("long").alias("row"), F.array(F.lit("name"), F.lit(" "), F.lit("key")).alias("cells"))
    out = records.matrix_to_rows(body.unionByName(header))
    return out.select("sheet", "row", F.col("data")["name"].alias("name"), F.col("data")["col_2"].alias("col_2"), F.col("data")["key"].alias("key"))


def validate_export(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"), F.concat_ws(",", "lang", "source").alias("tags"), "lang")
    return records.export_violations(docs, "doc_id", ("tags",))


# -- audit events ------------------------------------------------------------------------------------------------------


def _events(spark, d):
    return table(spark, d, "events").withColumnRenamed("event_type", "action")


def bounded_history(spark, d):
    return audit.bounded(_events(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


def latest_per_id(spark, d):
    e = _events(spark, d).withColumn("shown", F.when(F.col("event_id") % 5 == 0, F.col("ts")))
    return audit.latest(e, "user_id", ["shown", "ts"], "event_id").select("user_id", "event_id")


def approval_state(spark, d):
    return audit.approval(_events(spark, d), "user_id", ["ts", "event_id"], "purchase", "error")


def collapse_changes(spark, d):
    edits = _events(spark, d).withColumns({"before": (F.col("event_id") % 3).cast("string"), "after": (F.col("event_id") % 4).cast("string")})
    return audit.collapsed(edits, "user_id", "action", ["ts", "event_id"]).select("user_id", F.col("run").cast("long").alias("run"), "action", "before", "after", "edits")


def trim_audit(spark, d):
    return audit.trimmed(_events(spark, d), "user_id", ["ts", "event_id"], ["purchase", "error"], 500).select("user_id", "event_id", "action")


# -- knowledge: brands and makers seen together ------------------------------------------------------------------------


def _evidence(spark, d):
    """Brand -> maker observations; the kind of evidence follows from the line's flags."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    n = F.col("l_linenumber")
    kind = F.when((F.col("l_returnflag") == "R") & (n == 1), "confirmed").when((F.col("l_returnflag") == "R") & (n == 2), "rejected").when(F.col("l_returnflag") == "R", "correction").when(n == 3, "imported").when(n == 4, "ai").otherwise("observed")
    return li.join(p, "l_partkey").join(s, "l_suppkey").select(F.col("p_brand").alias("subject"), F.lit("brand→laboratory").alias("predicate"), F.col("s_name").alias("object"), kind.alias("kind"), F.col("l_orderkey").alias("ref"), F.col("l_shipdate").alias("at"))


def _relations(spark, d):
    by = knowledge.evidence_counts(_evidence(spark, d), ["subject", "predicate", "object"])
    conf = knowledge.confidence(F.lit(AS_OF).cast("timestamp"))
    return by.withColumn("confidence", conf).withColumn("status", knowledge.status(F.col("confidence")))


def evidence_confidence(spark, d):
    return _relations(spark, d).select("subject", "object", "confidence", "status", "observed", "confirmed", "rejected")


def functional_conflicts(spark, d):
    return knowledge.conflicts(_relations(spark, d)).select("subject", "candidates")


def relation_checks(spark, d):
    """Each product's maker (its first supplier; a fifth names none, a seventh another) under what is known of its brand."""
    first = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s_suppkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    k = F.col("product_id")
    p = products(spark, d).join(first.select(F.col("l_partkey").alias("product_id"), "s_name"), "product_id")
    p = p.select("product_id", F.col("marca").alias("subject"), F.when(k % 5 == 0, "").when(k % 7 == 0, "Otro").otherwise(F.upper("s_name")).alias("typed"))
    r = _relations(spark, d)
    many = r.filter("status <> 'rejected' AND confirmed > 0").groupBy("subject").agg((F.count("*") > 40).alias("many"))
    r = r.filter("confirmed > 0").join(many, "subject", "left").withColumn("status", F.when(F.col("many") & (F.col("status") != "rejected"), "conflicted").otherwise(F.col("status")))
    return knowledge.checked(p, r.select("subject", "object", "confidence", "status"))


def explain_confidence(spark, d):
    r = _relations(spark, d)
    return r.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum(knowledge.points()), 2).alias("points"), F.sum("rejected").alias("rejections"))


def knowledge_stats(spark, d):
    b = _relations(spark, d).select(F.substring_index("subject", "#", -1).cast("int").alias("k"), "status")
    return knowledge.stats(b.select(F.when(F.col("k") % 2 == 0, "even").otherwise("odd").alias("type"), "status"))


def entity_neighbours(spark, d):
    return knowledge.neighbours(_relations(spark, d)).groupBy("entity", "direction").agg(F.count("*").alias("n"))


def _entities(spark, d):
    b = table(spark, d, "part").select(F.col("p_brand").alias("canonical")).distinct()
    k = F.substring_index("canonical", "#", -1).cast("int")
    return b.filter(k % 5 != 0).select(F.lit("brand").alias("type"), F.concat(F.lit("brand:"), F.replace(T.identity(F.col("canonical")), F.lit(" "), F.lit("-"))).alias("id"), "canonical", T.identity(F.col("canonical")).alias("normalized"), F.split(T.identity(F.col("canonical")), " ").alias("tokens"), (k / 100).cast("double").alias("confidence"))


def resolve_entities(spark, d):
    e = _entities(spark, d)
    k = F.substring_index("canonical", "#", -1).cast("int")
    aliases = e.select("type", F.concat(F.lit("brand "), (k + 1).cast("string")).alias("normalized_alias"), F.col("id").alias("entity_id"), F.when(k % 3 == 0, "confirmed").when(k % 3 == 1, "suggested").otherwise("rejected").alias("status"))
    values = table(spark, d, "part").select(F.lit("brand").alias("type"), F.col("p_brand").alias("value"))
    return knowledge.resolved(values, e, aliases).select("value", "entity_id", "via")


def orphan_check(spark, d):
    known = _entities(spark, d).select(F.col("canonical").alias("id")).unionByName(table(spark, d, "supplier").filter("s_suppkey % 9 <> 0").select(F.col("s_name").alias("id")))
    return knowledge.orphans(_relations(spark, d), known).groupBy("subject", "missing").agg(F.count("*").alias("n"))


def search_entities(spark, d):
    return knowledge.search(_entities(spark, d), "brand 1", 10).select("id", "confidence")


# -- dictionaries --------------------------------------------------------------------------------------------------


def parse_alias_dictionary(spark, d):
    lines = table(spark, d, "customer").select(F.concat(F.lower("c_name"), F.lit(" = "), "c_mktsegment", F.lit(";"), "c_mktsegment", F.lit("\n\n"), "c_name", F.lit("=")).alias("t"))
    return dictionary.parse_aliases(lines, "t")


def _dictionary(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("canon")).distinct()
    return names.select(F.expr("substring(canon, 2)").alias("alias"), "canon").unionByName(names.select(F.substring_index("canon", " ", 1).alias("alias"), "canon"))


def dictionary_fuzzy(spark, d):
    values = table(spark, d, "part").select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("")).alias("value"))
    entries = _dictionary(spark, d).groupBy("alias").agg(F.min("canon").alias("canon"))
    return dictionary.fuzzy(values, "value", entries).select("value", "alias", "score", "exact", F.col("rank").cast("long").alias("rank"))


def missing_from_dictionary(spark, d):
    known = table(spark, d, "part").filter("p_partkey < 20").select(T.clean(F.col("p_name")).alias("key"))
    return dictionary.missing(products(spark, d), "producto", known)


def lookup_code(spark, d):
    codes = table(spark, d, "part").filter("p_partkey % 2 = 0").groupBy(dictionary.code_key(F.col("p_name")).alias("key")).agg(F.min("p_brand").alias("code"))
    rows = table(spark, d, "part").select("p_partkey", dictionary.code_key(F.concat("p_name", F.lit(", "), F.upper("p_name"))).alias("code_key"))
    return dictionary.lookup(rows, "code_key", codes).select("p_partkey", "code_key", "code")


def longest_prefix_area(spark, d):
    n = table(spark, d, "nation").select(F.md5("n_name").alias("m"), "n_name")
    prefixes = n.select(F.explode(F.array(F.substring("m", 1, 1), F.substring("m", 1, 2), F.substring("m", 1, 3))).alias("prefix"), "n_name").groupBy("prefix").agg(F.min("n_name").alias("value"))
    rows = table(spark, d, "part").select("p_partkey", F.substring(F.md5("p_name"), 1, 4).alias("code"))
    return dictionary.longest_prefix(rows, "code", prefixes, 3).select("p_partkey", "code", F.col("value").alias("area"))


# -- merges and links --------------------------------------------------------------------------------------------------


def merge_products(spark, d):
    p = products(spark, d).select("sku", "seq", "marca")
    return merge.add_unknown(p.filter("seq % 3 <> 0 AND sku LIKE 'P-%'"), p.filter("seq % 2 = 0 AND sku <> ''").withColumn("marca", F.lit("new")), "sku")


def merge_newest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    late = o.filter("o_orderkey % 4 <> 1").select("o_orderkey", F.expr("o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 3 AS INT) - 1)").alias("o_orderdate"), F.lit("N").alias("o_orderstatus"))
    return merge.newest_wins(o.filter("o_orderkey % 5 <> 0"), late, "o_orderkey", "o_orderdate").groupBy("action", "o_orderstatus").agg(F.count("*").alias("n"))


def upsert_batch(spark, d):
    p = products(spark, d).filter("sku LIKE 'P-%'").select(F.col("product_id").alias("id"), "seq", "sku", "marca")
    new = p.filter("seq % 3 = 0").select((F.col("id") + 1_000_000).alias("id"), "seq", F.when(F.col("seq") % 2 == 0, F.lower("sku")).otherwise(F.concat(F.lit("Q"), "sku")).alias("sku"), F.lit("new").alias("marca"))
    return merge.upsert(p, new, F.lower("sku")).select("id", "sku", "marca")


def _links(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("P-"), "p_partkey").alias("p"), F.concat(F.lit("P-"), (F.col("p_partkey") * 7) % 211).alias("c"))
    return p


def clean_links(spark, d):
    return relations.clean_links(_links(spark, d), products(spark, d).filter("seq % 6 <> 0"))


def remove_entry(spark, d):
    e = products(spark, d).filter("sku LIKE 'P-%'").select("sku")
    gone = e.filter("sku LIKE '%7'")
    return merge.without(e, _links(spark, d), gone)[1]


def declared_compatibles(spark, d):
    p = products(spark, d).filter("sku LIKE 'P-%'").withColumn("compat", F.concat(F.lit("P-"), F.col("seq") + 1, F.lit(", P-"), F.col("seq") + 2, F.lit(" | P-"), F.col("seq"), F.lit(";NONE")))
    return relations.declared(p, "compat", p.filter("seq % 4 <> 0"))


def apply_overrides(spark, d):
    pairs = _links(spark, d).select(F.col("p").alias("sku"), F.col("c").alias("other"))
    k = F.col("p_partkey")
    over = table(spark, d, "part").filter("p_partkey % 9 = 0").select(F.concat(F.lit("P-"), (k * 7) % 211).alias("a"), F.concat(F.lit("P-"), k).alias("b"), (k % 2 == 0).alias("on"))
    return relations.with_overrides(pairs, over)


def relation_alerts(spark, d):
    now = _links(spark, d).select(F.col("p").alias("sku"), F.col("c").alias("other"))
    k = F.col("p_partkey")
    old = table(spark, d, "part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("P-"), k).alias("sku"), F.concat(F.lit("P-"), (k * 7 + (k % 5 == 0).cast("int")) % 211).alias("other"))
    return relations.relation_alerts(now, old)


QUERIES = {f.__name__: f for f in (envelope_records, incremental_changes, record_diff, classify_records, sync_summary, apply_decisions, first_wins, project_field_map, unwrap_payload, matrix_to_rows, validate_export, bounded_history, latest_per_id, approval_state, collapse_changes, trim_audit, evidence_confidence, functional_conflicts, relation_checks, explain_confidence, knowledge_stats, entity_neighbours, resolve_entities, orphan_check, search_entities, parse_alias_dictionary, dictionary_fuzzy, missing_from_dictionary, lookup_code, longest_prefix_area, merge_products, merge_newest, upsert_batch, clean_links, remove_entry, declared_compatibles, apply_overrides, relation_alerts)}

P = f"WITH p AS ({PRODUCTS_DUCK})"
ORDERS = """WITH e AS (SELECT o_orderkey, o_custkey, o_orderstatus AS status, round(o_totalprice * 100)::BIGINT::VARCHAR AS total, o_orderpriority AS priority FROM orders),
l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 21 = 0 THEN 'X' ELSE o_orderstatus END AS status, (round(o_totalprice * 100)::BIGINT + (o_orderkey % 7 = 0)::INT)::VARCHAR AS total, o_orderpriority AS priority FROM orders WHERE o_orderkey % 11 <> 0),
x AS (SELECT o_orderkey, 'status' AS field, coalesce(l.status, '') AS local, e.status AS external FROM e LEFT JOIN l USING (o_orderkey) UNION ALL SELECT o_orderkey, 'total', coalesce(l.total, ''), e.total FROM e LEFT JOIN l USING (o_orderkey) UNION ALL SELECT o_orderkey, 'priority', coalesce(l.priority, ''), e.priority FROM e LEFT JOIN l USING (o_orderkey)),
c AS (SELECT * FROM x WHERE local <> external),
a AS (SELECT o_orderkey, count(c.field) AS n_changes, CASE WHEN count(c.field) = 0 THEN 'noop' WHEN bool_and(c.field = 'total') THEN 'suggest' ELSE 'review' END AS action FROM e LEFT JOIN c USING (o_orderkey) GROUP BY o_orderkey)"""
SUM = "md5('{\"status\":\"' || status || '\",\"total\":\"' || total || '\",\"priority\":\"' || priority || '\"}')"
REL = """WITH v AS (SELECT p_brand AS subject, s_name AS object, l_orderkey AS ref, l_shipdate AS day, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'confirmed' WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 'rejected' WHEN l_returnflag = 'R' THEN 'correction' WHEN l_linenumber = 3 THEN 'imported' WHEN l_linenumber = 4 THEN 'ai' ELSE 'observed' END AS kind
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
g AS (SELECT subject, object, count(*) FILTER (kind = 'observed') AS observed, count(*) FILTER (kind = 'imported') AS imported, count(*) FILTER (kind = 'ai') AS ai, count(*) FILTER (kind = 'confirmed') AS confirmed, count(*) FILTER (kind = 'correction') AS correction, count(*) FILTER (kind = 'rejected') AS rejected,
  count(DISTINCT CASE WHEN kind = 'confirmed' THEN ref END) AS refs, max(day) AS last_at FROM v GROUP BY ALL),
h AS (SELECT *, (0.0::DOUBLE + least(2.0::DOUBLE, observed * 0.25::DOUBLE) + least(1.5::DOUBLE, imported * 0.5::DOUBLE) + least(0.5::DOUBLE, ai * 0.25::DOUBLE) + confirmed * 3.0::DOUBLE + correction * 2.0::DOUBLE) AS pts FROM g),
i AS (SELECT *, CASE WHEN confirmed + correction > 0 THEN pts / (pts + 3.0::DOUBLE * rejected + 2.0::DOUBLE) ELSE least(0.7::DOUBLE, pts / (pts + 3.0::DOUBLE * rejected + 2.0::DOUBLE)) END * (1 - least(0.15::DOUBLE, greatest(0.0::DOUBLE, (epoch(TIMESTAMP '2002-01-01') - epoch(last_at)) / 2592000::DOUBLE) * 0.01::DOUBLE)) AS c FROM h),
j AS (SELECT *, floor(greatest(0.0::DOUBLE, least(0.99::DOUBLE, c)) * 100 + 0.5::DOUBLE) / 100 AS confidence FROM i),
r AS (SELECT *, CASE WHEN rejected > 0 AND 3.0 * rejected >= pts THEN 'rejected' WHEN confirmed >= 2 AND refs >= 2 AND rejected = 0 AND confidence >= 0.85 THEN 'trusted' WHEN confirmed + correction > 0 THEN 'confirmed' WHEN ai > 0 THEN 'suggested' ELSE 'observed' END AS status FROM j)"""
ID = "trim(regexp_replace(lower(p_brand), '[^a-z0-9%./+]+', ' ', 'g'))"
ENT = f"WITH b AS (SELECT DISTINCT p_brand, {ID} AS norm, split_part(p_brand, '#', 2)::INT AS k FROM part), e AS (SELECT p_brand AS canonical, 'brand:' || replace(norm, ' ', '-') AS id, norm, k FROM b WHERE k % 5 <> 0)"
LINKS = "SELECT 'P-' || p_partkey AS p, 'P-' || ((p_partkey * 7) % 211) AS c FROM part"
KEY = "list_aggregate(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array({0}, '\\s*(?:[,;/+]|\\by\\b)\\s*'), lambda x: {1}), lambda x: x <> ''))), 'string_agg', ' + ')"
ORACLE_SQL = {
    "envelope_records": ORDERS + f" SELECT 'erp' AS source_id, o_orderkey::VARCHAR AS record_id, {SUM} AS checksum FROM e",
    "incremental_changes": ORDERS + f" SELECT e.o_orderkey::VARCHAR AS record_id, e.checksum FROM (SELECT *, {SUM} AS checksum FROM e) e LEFT JOIN (SELECT *, {SUM} AS checksum FROM l) l USING (o_orderkey) WHERE l.checksum IS NULL OR l.checksum <> e.checksum",
    "record_diff": ORDERS + " SELECT o_orderkey, field, local, external FROM c",
    "classify_records": ORDERS + " SELECT o_orderkey, n_changes, action FROM a",
    "sync_summary": ORDERS + " SELECT 0::BIGINT AS accepted, count(*) FILTER (action = 'suggest') AS suggested, count(*) FILTER (action = 'review') AS review, count(*) FILTER (action = 'noop') AS skipped, count(*) AS fetched, count(*) FILTER (n_changes = 0) AS unchanged FROM a",
    "apply_decisions": ORDERS + " SELECT o_orderkey, CASE WHEN action = 'suggest' THEN e.status ELSE l.status END AS status, CASE WHEN action = 'suggest' THEN e.total ELSE l.total END AS total FROM l JOIN e USING (o_orderkey) JOIN a USING (o_orderkey)",
    "first_wins": "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
    "project_field_map": ORDERS + " SELECT o_orderkey, 'estado,importe' AS keys, total AS importe FROM e",
    "unwrap_payload": "SELECT event_id, (props->>'k')::BIGINT AS k FROM events, range(CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END) WHERE props IS NOT NULL",
    "matrix_to_rows": "SELECT s_nationkey::BIGINT AS sheet, s_suppkey + 1 AS row, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_nationkey::VARCHAR END AS col_2, s_suppkey::VARCHAR AS key FROM supplier",
    "validate_export": "SELECT doc_id, 'body' AS \"column\", 'newline' AS violation FROM documents WHERE regexp_matches(text, '[\\r\\n]') UNION ALL SELECT doc_id, 'body', 'comma' FROM documents WHERE contains(text, ',')",
    "bounded_history": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5",
    "latest_per_id": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS n FROM events) WHERE n = 1",
    "approval_state": "SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) = 'purchase' AS approved FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id",
    "collapse_changes": """WITH RECURSIVE n AS (SELECT user_id, event_type AS f, (event_id % 3)::VARCHAR AS b, (event_id % 4)::VARCHAR AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_id % 3 <> event_id % 4),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, []::STRUCT(f VARCHAR, b VARCHAR, a VARCHAR, n BIGINT)[] AS log FROM n
UNION ALL SELECT s.user_id, n.i, (CASE WHEN len(log) = 0 OR log[-1].f <> n.f THEN list_append(log, {'f': n.f, 'b': n.b, 'a': n.a, 'n': 1::BIGINT}) WHEN log[-1].b = n.a THEN log[:len(log) - 1] ELSE list_append(log[:len(log) - 1], {'f': n.f, 'b': log[-1].b, 'a': n.a, 'n': log[-1].n + 1}) END)[-50:]
  FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1),
l AS (SELECT user_id, arg_max(log, i) AS log FROM s GROUP BY user_id), e AS (SELECT user_id, unnest(range(0, len(log))) AS run, unnest(log) AS r FROM l)
SELECT user_id, run::BIGINT AS run, r.f AS action, r.b AS before, r.a AS after, r.n AS edits FROM e""",
    "trim_audit": "SELECT user_id, event_id, event_type AS action FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('purchase', 'error')) WHERE n = 1 UNION ALL (SELECT user_id, event_id, event_type FROM events WHERE event_type NOT IN ('purchase', 'error') ORDER BY ts DESC, event_id DESC LIMIT 500)",
    "evidence_confidence": REL + " SELECT subject, object, confidence, status, observed, confirmed, rejected FROM r",
    "functional_conflicts": REL + " SELECT subject, count(*) AS candidates FROM r WHERE status <> 'rejected' GROUP BY subject HAVING count(*) > 1",
    "relation_checks": REL + f""", w AS (SELECT subject, object, confidence, status, trim(regexp_replace(lower(object), '[^a-z0-9%./+]+', ' ', 'g')) AS key, count(*) OVER (PARTITION BY subject) AS n, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, object) AS best FROM r WHERE status <> 'rejected' AND confirmed > 0),
f AS (SELECT l_partkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY l_partkey), p AS ({PRODUCTS_DUCK}),
t AS (SELECT product_id, marca AS subject, CASE WHEN product_id % 5 = 0 THEN '' WHEN product_id % 7 = 0 THEN 'Otro' ELSE upper(s_name) END AS typed FROM p JOIN f ON l_partkey = product_id JOIN supplier USING (s_suppkey) WHERE marca <> ''),
m AS (SELECT t.*, b.object AS top, b.confidence AS top_c, b.status AS top_s, b.n, o.confidence AS own FROM t LEFT JOIN w b ON b.subject = t.subject AND b.best = 1 LEFT JOIN w o ON o.subject = t.subject AND o.key = trim(regexp_replace(lower(t.typed), '[^a-z0-9%./+]+', ' ', 'g'))),
z AS (SELECT *, CASE WHEN n IS NULL OR typed = '' THEN 'unknown' WHEN own IS NULL THEN 'mismatch' WHEN n > 40 THEN 'conflict' ELSE 'match' END AS verdict FROM m WHERE typed <> '' OR n IS NOT NULL)
SELECT product_id, verdict, CASE WHEN verdict = 'mismatch' THEN top END AS expected, CASE verdict WHEN 'mismatch' THEN top_c WHEN 'unknown' THEN NULL ELSE own END AS confidence, coalesce(verdict = 'mismatch' AND n <= 40 AND top_s IN ('confirmed', 'trusted'), false) AS strong, CASE WHEN typed = '' THEN top END AS fill FROM z""",
    "explain_confidence": REL + " SELECT status, count(*) AS n, round(sum(pts), 2) AS points, sum(rejected)::BIGINT AS rejections FROM r GROUP BY status",
    "knowledge_stats": REL + " SELECT type, status, count(*) AS n FROM (SELECT CASE WHEN split_part(subject, '#', 2)::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS type, status FROM r) GROUP BY GROUPING SETS ((type), (status))",
    "entity_neighbours": REL + " SELECT subject AS entity, 'out' AS direction, count(*) AS n FROM r GROUP BY subject UNION ALL SELECT object, 'in', count(*) FROM r GROUP BY object",
    "resolve_entities": ENT + """, a AS (SELECT 'brand ' || (k + 1) AS norm, id, k % 3 AS s FROM e WHERE k % 3 <> 2), t AS (SELECT norm, arg_max({'id': id, 's': s}, {'c': s = 0, 'id': id}) AS a FROM a GROUP BY norm)
SELECT b.p_brand AS value, CASE WHEN a.s = 0 THEN a.id ELSE coalesce(e.id, a.id) END AS entity_id, CASE WHEN a.s = 0 THEN 'alias' WHEN e.id IS NOT NULL THEN 'exact' WHEN a IS NOT NULL THEN 'alias' END AS via FROM b LEFT JOIN t USING (norm) LEFT JOIN e ON e.norm = b.norm""",
    "orphan_check": REL + " SELECT subject, 'subject' AS missing, count(*) AS n FROM r WHERE split_part(subject, '#', 2)::INT % 5 = 0 GROUP BY subject UNION ALL SELECT subject, 'object', count(*) FROM r JOIN supplier ON s_name = object WHERE s_suppkey % 9 = 0 GROUP BY subject",
    "search_entities": ENT + " SELECT id, (k / 100)::DOUBLE AS confidence FROM e WHERE len(list_filter(string_split(norm, ' '), lambda t: contains(t, '1'))) > 0 AND len(list_filter(string_split(norm, ' '), lambda t: contains(t, 'brand'))) > 0 ORDER BY confidence DESC, canonical LIMIT 10",
    "parse_alias_dictionary": "SELECT DISTINCT * FROM (SELECT lower(c_name) AS alias, c_mktsegment AS canon FROM customer UNION ALL SELECT c_mktsegment, c_mktsegment FROM customer UNION ALL SELECT c_name, c_name FROM customer)",
    "dictionary_fuzzy": f"""WITH n AS (SELECT DISTINCT p_name AS canon FROM part), e AS (SELECT alias, min(canon) AS canon FROM (SELECT substring(canon, 2) AS alias, canon FROM n UNION ALL SELECT split_part(canon, ' ', 1), canon FROM n) GROUP BY alias),
v AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS value FROM part),
x AS (SELECT value, alias, contains({clean_duck('value')}, {clean_duck('alias')}) AS exact, 1.0::DOUBLE - levenshtein({compact_duck('value')}, {compact_duck('alias')}) / greatest(length({compact_duck('value')}), length({compact_duck('alias')})) AS s FROM v, e)
SELECT * FROM (SELECT value, alias, CASE WHEN exact THEN 1.0 ELSE round(s, 3) END AS score, exact, row_number() OVER (PARTITION BY value ORDER BY exact DESC, CASE WHEN exact THEN 1.0 ELSE round(s, 3) END DESC, length(alias), alias) AS rank FROM x WHERE exact OR s >= 0.88) WHERE rank <= 3""",
    "missing_from_dictionary": P + f" SELECT key, arg_min(producto, seq) AS first_spelling FROM (SELECT {clean_duck('producto')} AS key, producto, seq FROM p) WHERE key <> '' AND key NOT IN (SELECT {clean_duck('p_name')} FROM part WHERE p_partkey < 20) GROUP BY key",
    "lookup_code": f"WITH k AS (SELECT p_partkey, p_brand, {clean_duck('p_name')} AS code_key FROM part) SELECT p_partkey, code_key, code FROM k LEFT JOIN (SELECT code_key, min(p_brand) AS code FROM k WHERE p_partkey % 2 = 0 GROUP BY code_key) USING (code_key)",
    "longest_prefix_area": """WITH x AS (SELECT unnest([md5(n_name)[1:1], md5(n_name)[1:2], md5(n_name)[1:3]]) AS prefix, n_name FROM nation), f AS (SELECT prefix, min(n_name) AS value FROM x GROUP BY prefix), r AS (SELECT p_partkey, md5(p_name)[1:4] AS code FROM part)
SELECT p_partkey, code, arg_max(value, length(prefix)) AS area FROM r LEFT JOIN f ON starts_with(code, prefix) GROUP BY ALL""",
    "merge_products": P + " SELECT sku, seq, marca FROM p WHERE seq % 3 <> 0 AND sku LIKE 'P-%' UNION ALL SELECT sku, seq, 'new' FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY seq) AS n FROM p WHERE seq % 2 = 0 AND sku <> '') WHERE n = 1 AND sku NOT IN (SELECT sku FROM p WHERE seq % 3 <> 0 AND sku LIKE 'P-%')",
    "merge_newest": """WITH c AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0), i AS (SELECT o_orderkey, o_orderdate + to_days((o_orderkey % 3 - 1)::INT) AS d FROM orders WHERE o_orderkey % 4 <> 1)
SELECT action, o_orderstatus, count(*) AS n FROM (SELECT CASE WHEN c.o_orderkey IS NULL THEN 'added' WHEN i.d > c.o_orderdate THEN 'updated' ELSE 'kept' END AS action, CASE WHEN c.o_orderkey IS NULL OR i.d > c.o_orderdate THEN 'N' ELSE c.o_orderstatus END AS o_orderstatus FROM c FULL JOIN i ON c.o_orderkey = i.o_orderkey) GROUP BY ALL""",
    "upsert_batch": P + """, c AS (SELECT product_id AS id, seq, sku, marca FROM p WHERE sku LIKE 'P-%') SELECT id, CASE WHEN seq % 6 = 0 THEN lower(sku) ELSE sku END AS sku, CASE WHEN seq % 6 = 0 THEN 'new' ELSE marca END AS marca FROM c UNION ALL SELECT id + 1000000, 'Q' || sku, 'new' FROM c WHERE seq % 3 = 0 AND seq % 2 <> 0""",
    "clean_links": P + f", k AS (SELECT sku FROM p WHERE seq % 6 <> 0) SELECT DISTINCT p, c FROM ({LINKS}) WHERE p <> c AND p IN (SELECT sku FROM k) AND c IN (SELECT sku FROM k)",
    "remove_entry": P + f", g AS (SELECT sku FROM p WHERE sku LIKE 'P-%' AND sku LIKE '%7') SELECT p, c FROM ({LINKS}) WHERE p NOT IN (SELECT sku FROM g) AND c NOT IN (SELECT sku FROM g)",
    "declared_compatibles": P + ", q AS (SELECT * FROM p WHERE sku LIKE 'P-%'), x AS (SELECT sku, 'P-' || (seq + 1) AS other FROM q UNION ALL SELECT sku, 'P-' || (seq + 2) FROM q) SELECT sku, other FROM x WHERE other IN (SELECT sku FROM q WHERE seq % 4 <> 0)",
    "apply_overrides": f"""WITH l AS ({LINKS}), o AS (SELECT 'P-' || ((p_partkey * 7) % 211) AS a, 'P-' || p_partkey AS b, p_partkey % 2 = 0 AS sw FROM part WHERE p_partkey % 9 = 0), d AS (SELECT a, b, sw FROM o UNION SELECT b, a, sw FROM o)
SELECT p AS sku, c AS other FROM l WHERE (p, c) NOT IN (SELECT (a, b) FROM d WHERE NOT sw) UNION SELECT a, b FROM d WHERE sw""",
    "relation_alerts": f"""WITH n AS (SELECT p AS sku, c AS other FROM ({LINKS})), o AS (SELECT 'P-' || p_partkey AS sku, 'P-' || ((p_partkey * 7 + (p_partkey % 5 = 0)::INT) % 211) AS other FROM part WHERE p_partkey % 3 <> 0)
SELECT sku, other, 'added' AS change FROM n WHERE sku IN (SELECT sku FROM o) AND (sku, other) NOT IN (SELECT (sku, other) FROM o) UNION ALL SELECT sku, other, 'removed' FROM o WHERE (sku, other) NOT IN (SELECT (sku, other) FROM n)""",
}
