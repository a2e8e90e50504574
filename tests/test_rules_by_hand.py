"""Operators against small cases worked out by hand."""

from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.operators import audit, decisions, findings, knowledge, language, links, nutrition, quality, relations


def test_fold_strips_every_mark(spark):
    got = spark.createDataFrame([("Ő š É é ñ Ǖ ø ß 漢",), (None,)], "t string").select(T.fold(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["o s e e n u ø ß 漢", ""]


def test_tidy_takes_wide_blanks(spark):
    assert spark.createDataFrame([(" a　  b ",)], "t string").select(T.tidy(F.col("t")).alias("t")).first().t == "a b"


def test_complement_needs_declared_fields(spark):
    rows = [("med", "no", "no", True), ("med", "no", None, False), ("med", "no", "", False), ("med", "si", "no", False), ("med", None, "no", False), ("cos", None, None, True)]
    got = spark.createDataFrame(rows, "c string, r string, s string, want boolean").select(relations.complement_eligible(F.col("c"), F.col("r"), F.col("s")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_field_problems_by_hand(spark):
    rows = [
        (1, "hig", {"marca": "M", "tipo": "t", "contenido": "60 piezas", "fluor": "1,450 ppm", "area": "Otra"}, ""), (2, "med", {"concentracion": "-5 mg", "area": "Nada", "receta": "quiza"}, ""),
        (3, "cos", {"nivel": "Altísima", "rutina": "Cabello", "contenido": "grande", "fps": "alto"}, ""), (4, "zzz", {"marca": " x"}, "note"), (5, "acc", {"contenido": "1\x07", "nada": "x"}, " n "),
    ]
    found = quality.field_problems(spark.createDataFrame(rows, "product_id long, cat string, v map<string,string>, note string")).filter("code <> 'required-missing'")
    assert sorted((r.product_id, r.field, r.code) for r in found.collect()) == [
        (2, "area", "invalid-option"), (2, "concentracion", "negative-number"), (2, "receta", "invalid-option"), (3, "contenido", "numeric-format"), (3, "fps", "numeric-format"), (3, "nivel", "invalid-option"),
        (4, "", "unknown-category"), (5, "", "unassigned-text"), (5, "contenido", "control-character"), (5, "nada", "unknown-field"),
    ]


def test_hygiene_by_hand(spark):
    cases = {
        "a b": [], "": [], "la la luna": ["repeated-word"], "luna que luna": [], "a  b": ["double-space"], "a b\n": ["edge-space"], 'a "b"': ["html-breaker"], "a b": ["invisible"], "a , b": ["space-before-comma"],
        "a,, b": ["separators"], "a| |b": ["separators"], "a;": ["edge-separator"], "- a": ["edge-separator"], "x {marca:lc} y": ["unresolved"], "es null": ["technical"], "nullable": [], "Ã\u0083 x": ["mojibake"], "dé de": [],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {}
    for r in quality.text_hygiene(rows, "k", "t").collect():
        got.setdefault(r.k, []).append(r.defect)
    assert [sorted(got.get(i, [])) for i in range(len(cases))] == [sorted(v) for v in cases.values()]
    assert quality.text_hygiene(rows, "k", "t", html=True, multiline=True).filter("defect IN ('html-breaker', 'double-space', 'separators')").count() == 0


def test_edits_collapse_over_what_vanished(spark):
    edits = [("u", 1, "f", "a", "b"), ("u", 2, "f", "b", "c"), ("u", 3, "g", "x", "y"), ("u", 4, "g", "y", "x"), ("u", 5, "f", "c", "d"), ("u", 6, "h", "q", "q"), ("v", 1, "f", "1", "2"), ("v", 2, "f", "2", "1"), ("w", 1, "f", None, "1")]
    df = spark.createDataFrame(edits, "owner string, at int, field string, before string, after string")
    got = sorted((r.owner, r.run, r.field, r.before, r.after, r.edits) for r in audit.collapsed(df, "owner", "field", ["at"]).collect())
    assert got == [("u", 0, "f", "a", "d", 3), ("w", 0, "f", None, "1", 1)]
    many = spark.createDataFrame([("u", i, f"f{i}", "a", "b") for i in range(70)], df.schema)
    assert sorted(r.field for r in audit.collapsed(many, "owner", "field", ["at"]).collect()) == sorted(f"f{i}" for i in range(20, 70))


def test_pages_are_clamped(spark):
    rows = spark.range(25)
    ids = lambda n: [r.id for r in findings.page(rows, ["id"], n, 10).collect()]
    assert ids(3) == ids(9) == [20, 21, 22, 23, 24] and ids(-1) == ids(1) == list(range(10))
    assert findings.page(rows.limit(0), ["id"], 4, 10).count() == 0


def test_relation_verdicts(spark):
    known = spark.createDataFrame([("b1", "Lab A", 0.9, "confirmed"), ("b2", "Lab B", 0.8, "conflicted"), ("b2", "Lab C", 0.7, "conflicted"), ("b3", "Lab D", 0.9, "rejected")], "subject string, object string, confidence double, status string")
    rows = [(1, "b1", "LAB  a"), (2, "b1", "other"), (3, "b1", ""), (4, "b2", "lab c"), (5, "b3", "Lab D"), (6, "b4", None), (7, "", "x")]
    got = {r.product_id: (r.verdict, r.expected, r.confidence, r.strong, r.fill) for r in knowledge.checked(spark.createDataFrame(rows, "product_id int, subject string, typed string"), known).collect()}
    assert got == {1: ("match", None, 0.9, False, None), 2: ("mismatch", "Lab A", 0.9, True, None), 3: ("unknown", None, None, False, "Lab A"), 4: ("conflict", None, 0.7, False, None), 5: ("unknown", None, None, False, None)}


def test_language_and_levels(spark):
    rows = [(1, "Cura y ELIMINA; el mejor", "med"), (2, "curado, secular", "cos"), (3, None, "cos"), (4, "desinflamante todo el dia", "cos"), (5, "Increíbles", None), (6, "desinflamante todo el dia", "med"), (7, "diagnóstico; alivia várices", "dis"), (8, "diagnóstico; alivia várices", "acc")]
    got = sorted(map(tuple, language.lint(spark.createDataFrame(rows, "k int, t string, c string"), "k", "t", "c").collect()))
    assert got == [(1, "claim", "cura"), (1, "claim", "el mejor"), (1, "claim", "elimina"), (4, "claim", "todo el día"), (4, "medical", "antiinflamatorio"), (5, "subjective", "increíble"), (7, "review", "diagnóstico"), (8, "medical", "enfermedad"), (8, "review", "alivia")]
    free = spark.createDataFrame([(1, "cos", {"tipo": "ideal", "inci": "ideal", "modo": "ideal", "nivel": "ideal", "otro": "ideal", "marca": "antibiótico"})], "product_id int, cat string, v map<string,string>")
    assert sorted(map(tuple, language.lint_fields(free).collect())) == [(1, "marca", "medical", "antibiótico o antimicótico"), (1, "tipo", "subjective", "ideal")]
    levels = {"5": "", "6": "Baja", "FPS 15": "Media", "30": "Alta", "50": "Alta", "50+": "Muy alta", "60": "Muy alta", "x": "", "": ""}
    assert {r.f: r.l for r in spark.createDataFrame([(x,) for x in levels], "f string").select("f", language.sunscreen_level(F.col("f")).alias("l")).collect()} == levels
    steps = {"protector solar con crema": "Protección solar", "Crema facial": "Hidratación", "jabón facial": "Limpieza", "nada": ""}
    assert {r.f: r.l for r in spark.createDataFrame([(x,) for x in steps], "f string").select("f", language.routine_step(F.col("f")).alias("l")).collect()} == steps


def test_nutrition_tables(spark):
    text = "Información nutrimental: por porción\nENERGÍA | 200 kcal (840 kJ)\nProteína | 10,0g\n- de leche | <1 mg\nde los cuales:\nVITAMINAS\nCarbohidratos | 10 g\nGrasas totales | 5 g\nPorción | 30 g\nSodio |\n | 3 g"
    table = nutrition.lines(spark.createDataFrame([(1, text), (2, None), (3, "# N | A | B\nEnergía | 100 kcal | x\nproteínas | 5 g | 1 g\nCarbohidratos | 15 g\nGrasa | 2 g")], "k int, t string"), "k", "t")
    got = [(r.kind, r.name, r.sub, list(r.cells)) for r in sorted(table.filter("k = 1").collect(), key=lambda r: r.line)]
    assert got == [
        ("caption", "Por porción", False, []), ("row", "Energía", False, ["200 kcal (840 kJ)"]), ("row", "Proteína", False, ["10,0 g"]), ("row", "de leche", True, ["<1 mg"]), ("note", "de los cuales", False, []), ("title", "Vitaminas", False, []),
        ("row", "Carbohidratos", False, ["10 g"]), ("row", "Grasas totales", False, ["5 g"]), ("portion", "Porción", False, ["30 g"]), ("no-amount", "Sodio", False, []), ("unnamed", "", False, ["3 g"]),
    ]
    assert list(map(tuple, nutrition.energy_gaps(table, "k").collect())) == [(1, 0, 200.0, 125.0)]


def test_dictionaries_aliases_and_levels(spark):
    d = "key int, code string, source string, verified boolean"
    mine = spark.createDataFrame([(1, "A", "m", True), (2, "", "", False), (3, "B", "m", False), (4, "C", "m", False)], d)
    theirs = spark.createDataFrame([(1, "Z", "t", True), (2, "Y", "t", False), (3, "X", "t", True), (5, "W", "t", False)], d)
    got = sorted(map(tuple, decisions.merged_dictionary(mine, theirs).collect()))
    assert got == [(1, "A", "m", True, "kept"), (2, "Y", "t", False, "filled"), (3, "X", "t", True, "replaced"), (4, "C", "m", False, "own"), (5, "W", "t", False, "added")]
    a = decisions.aliases(spark.createDataFrame([("Á", "e1"), ("a", "e1"), ("b", "e1"), ("B", "e2"), (" ", "e3")], "alias string, entity string"))
    assert sorted(map(tuple, a.collect())) == [("a", "e1", "alias"), ("b", None, "conflict")]
    rows = [("x", "unit", "alias", "confirmed", 0.9, False, True, "automatic"), ("marca", "unit", "alias", "trusted", 0.9, False, True, "assisted"), ("x", "brand", "seed", "observed", 0.1, False, True, "suggest"), ("x", "unit", "seed", "observed", 0.0, False, False, "assisted"),
            ("x", "unit", "alias", "confirmed", 0.7, False, True, "assisted"), ("x", "unit", "ai", "confirmed", 0.9, False, True, "suggest"), ("x", "unit", "mismatch", "trusted", 0.9, False, True, "review"), ("x", "unit", "alias", "rejected", 0.9, False, True, "suggest"), ("x", "unit", "alias", "trusted", 0.9, True, True, "review")]
    df = spark.createDataFrame(rows, "f string, t string, k string, s string, c double, x boolean, safe boolean, want string")
    got = df.select(decisions.correction_level(*(F.col(c) for c in ("f", "t", "k", "s", "c", "x", "safe"))).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_aliases_are_found_at_word_edges(spark):
    texts = spark.createDataFrame([(1, "Crema L'Oréal 30 ml"), (2, "Crema L Oreal"), (3, "Aspirina  Protect, tabletas"), (4, "Aspirinas"), (5, None)], "k int, t string")
    dictionary = spark.createDataFrame([("L'Oréal", "L'ORÉAL"), ("aspirina", "ASPIRINA"), ("Aspirina Protect", "PROTECT")], "alias string, canon string")
    assert sorted((r.k, r.canon, r["rank"], r.at, r.size) for r in links.contained(texts, "k", "t", dictionary).collect()) == [(1, "L'ORÉAL", 1, 7, 7), (3, "PROTECT", 1, 1, 16)]


def test_aliases_of_any_length_use_up_their_text(spark):
    texts = spark.createDataFrame([(1, "lleva uno dos tres cuatro cinco seis siete y uno dos")], "k int, t string")
    dictionary = spark.createDataFrame([("uno dos tres cuatro cinco seis siete", "long"), ("uno dos", "short"), ("tres", "inner")], "alias string, canon string")
    assert sorted((r.canon, r["rank"], r.at) for r in links.contained(texts, "k", "t", dictionary).collect()) == [("long", 1, 7), ("short", 2, 46)]
