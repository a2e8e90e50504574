import math

import pytest
from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.operators import anomalies, audit, dictionary, knowledge, merge, quality, relations, scores, sync
from catalogspark.sources import records


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(("value", "clean", "compact"), [("  Ómron HEM-7121 ", "omron hem 7121", "omronhem7121"), (None, "", ""), ("ÑÜ%", "nu", "nu")])
def test_keys(spark, value, clean, compact):
    assert one(spark, value, T.clean) == clean
    assert one(spark, value, T.compact) == compact


def test_text_expressions(spark):
    assert one(spark, "  Omron\t HEM-7121\n ", T.tidy) == "Omron HEM-7121"
    assert one(spark, "abc", T.fnv1a) == "1a47e90b"
    assert [one(spark, x, T.numeric_like) for x in ("500 mg", "2,5", "2.5/0.6 mL", "x1", "")] == [True, True, True, False, False]
    assert [one(spark, x, T.negative_number) for x in ("-5", "a-5", "x - 5", "5")] == [True, False, True, False]
    assert one(spark, "hola mundo hola", T.repeated_words) and not one(spark, "de la de la", T.repeated_words)


def product(i, cat, v, note=""):
    return (i, i, cat, v, note)


@pytest.fixture
def products(spark):
    rows = [
        product(1, "med", {"marca": "A", "concentracion": "5 mg", "principio": "p", "forma": "t", "contenido": "30", "laboratorio": "l", "via": "o", "receta": "si"}),
        product(2, "med", {"marca": " A ", "receta": "quiza", "raro": "1"}),
        product(3, "cos", {"marca": "A", "contenido": "1", "fabricante": "m", "fps": "-3"}, "resto"),
        product(4, "zzz", {"raro": "1"}, "resto"),
        product(5, "cos", {"marca": "A\x01", "contenido": "1", "fabricante": "m", "fps": "alto"}),
    ]
    return spark.createDataFrame(rows, "product_id long, seq long, cat string, v map<string,string>, note string")


def test_field_problems(products):
    got = {(r.product_id, r.field, r.code) for r in quality.field_problems(products).collect()}
    assert {x for x in got if x[0] == 1} == set()
    assert {(2, "marca", "whitespace-normalization"), (2, "receta", "invalid-option"), (2, "raro", "unknown-field"), (2, "via", "required-missing")} <= got
    assert {x for x in got if x[0] == 3} == {(3, "fps", "negative-number"), (3, "", "unassigned-text")}
    assert {x for x in got if x[0] == 4} == {(4, "", "unknown-category")}
    assert {x for x in got if x[0] == 5} == {(5, "marca", "control-character"), (5, "fps", "numeric-format")}
    counts = {r.product_id: r.status for r in quality.issue_counts(products, quality.field_problems(products)).collect()}
    assert counts == {1: "listo", 2: "critico", 3: "critico", 4: "critico", 5: "critico"}
    moved = {r.product_id: (set(r.quarantined), r.reasons) for r in quality.quarantine(products, quality.field_problems(products)).collect()}
    assert moved[3] == ({"fps"}, ["negative-number"]) and moved[1] == (set(), [])


def brute_pairs(rows, t, least):
    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(now[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
            prev = now
        return prev[-1]

    keys = [" ".join("".join(c if c.isalnum() else " " for c in r.lower()).split()) for r in rows]
    out = set()
    for i in range(len(rows)):
        for j in range(i):
            a, b = keys[j].replace(" ", ""), keys[i].replace(" ", "")
            if min(len(keys[i]), len(keys[j])) >= least and keys[i] != keys[j] and 1 - lev(a, b) / max(len(a), len(b)) >= t:
                out.add((j, i))
    return out


@pytest.mark.parametrize(("t", "least"), [(0.92, 8), (0.9, 5), (0.8, 3)])
def test_near_duplicates_equal_brute_force(spark, t, least):
    import random

    r = random.Random(3)
    rows = ["Omron HEM 7121", "Omron HEM 7122", "Mounjaro 2.5 mg", "ab cdef gh", "a bcd efgh", ""]
    for _ in range(60):
        base = "".join(r.choice("abc d1") for _ in range(r.randint(3, 40)))
        rows += [base, "".join(c for c in base if r.random() > 0.03), base.replace("a", "A", 1) + r.choice(["", "x", " y"])]
    df = spark.createDataFrame(list(enumerate(rows)), "seq long, title string")
    got = {(x.first_seq, x.second_seq) for x in anomalies.near_duplicates(df, F.col("title"), "seq", t, least).collect()}
    assert got == brute_pairs(rows, t, least)


def test_duplicates_of_sku(spark):
    df = spark.createDataFrame([(0, "ABC-01"), (1, " abc01 "), (2, ""), (3, "")], "seq long, sku string")
    assert [(r.key, r.size, r.first_seq) for r in anomalies.duplicates(df, T.compact(F.col("sku")), "duplicate-sku", "error").collect()] == [("abc01", 2, 0)]


def test_scores(spark):
    p = spark.createDataFrame([(1,), (2,)], "product_id long")
    found = spark.createDataFrame([(1, "required-missing", "error"), (1, "numeric-format", "warning")], "product_id long, code string, severity string")
    got = {r.product_id: (r.score, r.band) for r in scores.health(p, found, found.limit(0).select("product_id", "severity")).collect()}
    assert got == {1: (74, "revisar"), 2: (100, "excelente")}
    axes = spark.createDataFrame([(1, 80, 60, 40, 90, "READY"), (2, 80, None, 60, 100, "READY"), (3, None, None, None, None, None), (4, 100, 100, 100, 100, "BLOCKED")], "i int, health int, seo int, content int, magento int, state string")
    rows = {r.i: r for r in scores.score_360(axes).collect()}
    assert (rows[1].score, rows[1].health_points, rows[1].seo_points, rows[1].content_points, rows[1].magento_points) == (67, 24.0, 15.0, 10.0, 18.0)
    assert (rows[2].score, rows[2].partial) == (79, True)
    assert (rows[3].score, rows[3].band, rows[4].band) == (None, "sin_evaluar", "bloqueado")


def test_relations_equal_brute_force(spark):
    import random

    r = random.Random(5)
    rows = [(f"S{i:03d}", r.choice("xy"), r.choice(["", "A", "B", "C"]), r.choice(["", "m", "n"]), r.choice("kq")) for i in range(160)]
    df = spark.createDataFrame(rows, "sku string, cat string, marca string, fabricante string, k string")
    alt = {(a[0], b[0]) for a in rows for b in rows if a[4] == b[4] and a[2] and b[2] and a[2] != b[2]}

    def top(pairs):
        out = set()
        for s in {p[0] for p in pairs}:
            out |= set(sorted([p for p in pairs if p[0] == s], key=lambda p: (not p[2], p[1]))[:4])
        return {p[:2] for p in out}

    assert {(x.sku, x.other) for x in relations.alternatives(df, ["k"]).collect()} == top({(*p, True) for p in alt})
    rel = {(a[0], b[0], bool(a[2]) and a[2] == b[2]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and ((a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3])) and (a[0], b[0]) not in alt}
    assert {(x.sku, x.other) for x in relations.related(df, ["k"]).collect()} == top(rel)


def test_dictionaries(spark):
    text = spark.createDataFrame([("LILLY=Eli Lilly;LILLY MEDICAL\nPisa = PISA",)], "t string")
    got = {(r.alias, r.canon) for r in dictionary.parse_aliases(text, "t").collect()}
    assert got == {("LILLY", "Eli Lilly"), ("LILLY MEDICAL", "LILLY MEDICAL"), ("Pisa", "PISA")}
    best = dictionary.fuzzy(spark.createDataFrame([("LILLY",)], "v string"), "v", spark.createDataFrame(list(got), "alias string, canon string")).orderBy("rank").first()
    assert (best.canon, best.exact) == ("Eli Lilly", True)
    assert one(spark, "PARACETAMOL, Cafeína", dictionary.code_key) == one(spark, "cafeina + paracetamol", dictionary.code_key)
    codes = spark.createDataFrame([("A10BX16",), ("N02BE01",), ("ZZZ",)], "code string")
    areas = spark.createDataFrame([("A", "a"), ("A10", "diabetes"), ("N02", "dolor")], "prefix string, value string")
    assert {r.code: r.value for r in dictionary.longest_prefix(codes, "code", areas, 3).collect()} == {"A10BX16": "diabetes", "N02BE01": "dolor", "ZZZ": None}


def test_sync_and_merge(spark):
    rec = spark.createDataFrame([(0, "s", "1", "c1", "e"), (1, "s", "1", "c2", "e"), (2, "s", "2", "c", None)], "seq long, source_id string, record_id string, checksum string, etag string")
    first = sync.first_wins(rec, ["source_id", "record_id"])
    assert sorted(r.seq for r in first.collect()) == [0, 2]
    cache = spark.createDataFrame([("s", "1", "old", "e"), ("s", "2", "c", None)], rec.drop("seq").schema)
    assert [r.record_id for r in sync.changed(first, cache).collect()] == ["1"]
    last = sync.last_wins(spark.createDataFrame([(0, "A1"), (1, "b"), (2, "a1")], "seq long, sku string"), F.lower("sku")).collect()
    assert {(r.seq, r.position) for r in last} == {(2, 0), (1, 1)}
    a = spark.createDataFrame([("x", 1, "old"), ("y", 5, "old")], "k string, at int, v string")
    b = spark.createDataFrame([("x", 2, "new"), ("y", 5, "new"), ("z", 1, "new")], a.schema)
    once = merge.newest_wins(a, b, "k", "at")
    assert {(r.k, r.v, r.action) for r in once.collect()} == {("x", "new", "updated"), ("y", "old", "kept"), ("z", "new", "added")}
    assert {r.action for r in merge.newest_wins(once.drop("action"), b, "k", "at").collect()} == {"kept"}


def test_audit(spark):
    edits = spark.createDataFrame([("u", 1, "f", "a", "b"), ("u", 2, "f", "b", "c"), ("u", 3, "g", "x", "y"), ("u", 4, "g", "y", "x"), ("u", 5, "f", "c", "d")], "u string, at int, field string, before string, after string")
    got = {(r.field, r.before, r.after, r.edits) for r in audit.collapsed(edits, "u", "field", ["at"]).collect()}
    assert got == {("f", "a", "d", 3)}


def test_confidence(spark):
    schema = "t string, kind string, ref string, at timestamp"
    rows = [("ai", "ai", str(i), None) for i in range(50)] + [("two", "confirmed", str(i), None) for i in range(4)] + [("no", "rejected", "1", None), ("no", "observed", "2", None)]
    by = knowledge.evidence_counts(spark.createDataFrame(rows, schema), ["t"]).withColumn("c", knowledge.confidence(F.current_timestamp()))
    got = {r.t: (r.c, r.s) for r in by.withColumn("s", knowledge.status(F.col("c"))).collect()}
    assert got["ai"] == (0.2, "suggested") and got["no"][1] == "rejected"
    assert math.isclose(got["two"][0], 0.86) and got["two"][1] == "trusted"


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('sku;b;c\n1;"x;y";"di ""hola"""\nejemplo 1;q;r\n;;\n')
    assert [tuple(r) for r in records.read_catalogue(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x;y", 'di "hola"')]
    cells = spark.createDataFrame([("s", 0, ["sku", " "]), ("s", 1, ["1", "v"]), ("s", 2, ["", None])], "sheet string, row long, cells array<string>")
    assert [r.data for r in records.matrix_to_rows(cells).collect()] == [{"sku": "1", "col_2": "v"}]
    pay = spark.createDataFrame([('{"data":1,"items":[{"a":1},{"a":2}]}',), ('[{"a":3}]',), ('{"a":4}',)], "p string")
    assert sorted(r.record for r in records.unwrap_payload(pay, "p").collect()) == ['{"a":1}', '{"a":2}', '{"a":3}', '{"a":4}']


def test_stream_of_changed_records_survives_a_replay(spark, tmp_path):
    from catalogspark.streaming import jobs

    src, cache, out = (str(tmp_path / x) for x in ("src", "cache", "out"))
    schema = "seq long, source_id string, record_id string, checksum string, etag string"
    spark.createDataFrame([], "source_id string, record_id string, checksum string, etag string").write.parquet(f"{cache}/batch=-1")
    for n, rows in enumerate([[(0, "s", "1", "a", "e"), (1, "s", "1", "b", "e")], [(2, "s", "1", "a", "e"), (3, "s", "2", "x", "e")], [(4, "s", "2", "y", "e")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.changed_records(spark.readStream.schema(schema).parquet(src), cache, out, str(tmp_path / "state")).awaitTermination()
        assert sorted((r.record_id, r.checksum) for r in spark.read.parquet(f"{out}/batch={n}").collect()) == [[("1", "a")], [("2", "x")], [("2", "y")]][n]
