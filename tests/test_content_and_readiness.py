"""Content rules, their scores and the checks of the store against hand-worked cases."""

from pyspark.sql import functions as F

from catalogspark.operators import content, export, readiness, rules, scores

MED = {"marca": "Mounjaro", "principio": "Tirzepatida", "concentracion": "2.5 mg", "forma": "Solución inyectable", "via": "Subcutánea", "laboratorio": "Eli Lilly", "receta": "si", "contenido": "Caja con 4 plumas"}
HTML = "<p>Mounjaro Tirzepatida 2.5 mg</p><ul><li><strong>Datos:</strong> Solución inyectable, Subcutánea, Caja con 4 plumas, Eli Lilly</li></ul><p>Consulte a su médico y evite automedicarse.</p><h2>Condiciones de conservación:</h2>"
COS = {"marca": "Casa", "producto": "Sérum", "beneficio": "Hidratación", "fabricante": "Lab", "contenido": "30 mL", "fps": "50+", "modo": "Aplicar.", "precauciones": "Evitar los ojos."}


def failed(spark, *products):
    rows = [(i, cat, v, mc, html) for i, (cat, v, mc, html) in enumerate(products)]
    df = spark.createDataFrame(rows, "product_id int, cat string, v map<string,string>, mc string, html string")
    found = content.findings(df)
    out = {i: set() for i in range(len(rows))}
    for r in found.filter("state IN ('error', 'pendiente')").collect():
        out[r.product_id].add(r.rule)
    return out, {r.product_id: r for r in content.content_score(df).collect()}


def test_content_rules(spark):
    good = "Mounjaro de Tirzepatida, 2.5 mg."
    cases = [
        ("med", MED, good, HTML),
        ("med", MED | {"forma": "Tableta", "volumen": "0.6 mL"}, good, ""),
        ("med", MED | {"leyenda": "Contiene 5 mg; no requiere receta"}, good, ""),
        ("med", MED | {"receta": "no", "contenido": "Caja con 4 plumas de 2,5 MG"}, good + " Se vende con receta", ""),
        ("med", MED | {"receta": "no"}, good + " no requiere receta", ""),
        ("med", MED | {"forma": "TAB", "contenido": "CAJ C/28", "indicaciones": "TODO EN MAYUSCULAS", "poblacion": "todo en mayúsculas"}, good, ""),
        ("med", MED | {"forma": "xyz", "indicaciones": "Pendiente", "categoria": "Caja con 4  PLUMAS"}, good + ", el mejor en oferta", ""),
        ("cos", COS, "Casa Sérum", "<ul><li>Casa Sérum Hidratación 30 mL Lab</li></ul> Evitar los ojos"),
        ("cos", COS | {"precauciones": "", "porcion": "30 mL"}, "Casa Sérum medicinal", ""),
        ("cos", COS, "Sérum", "<ul><li>Casa Sérum Hidratación 30 mL Lab</li></ul><li> <strong>x</strong></li>"),
        ("dis", {"marca": "Omron", "modelo": "HEM", "tipo": "Baumanómetro", "uso": "medir", "fabricante": "Omron", "paquete": "Caja", "presentacion": "1 pieza"}, "Omron HEM", ""),
        ("dis", {"marca": "Omron", "presentacion": "30"}, "", ""),
        ("beb", {"marca": "X", "contenido": "mucho"}, "X", "sin lista"),
    ]
    got, total = failed(spark, *cases)
    assert got[0] == set() and (total[0].score, total[0].status) == (100, "listo")
    assert got[1] == {"COH-C01", "COH-C04"} and total[1].status == "critico"
    assert got[2] == {"COH-C02", "COH-C03"}
    assert got[3] == {"COH-C02"} and got[4] == set()
    assert got[5] == {"CLA-001", "CLA-002", "CLA-003", "PRE-001", "PRE-002"}
    assert got[6] == {"PRE-002", "DES-003", "CLM-001", "CLM-002", "CLA-003"}
    assert got[7] == set() and got[8] == {"SEG-001", "CLM-002"}
    assert got[9] == {"DES-002", "FT-003", "SEG-002"}
    assert got[10] == set() and (total[10].score, total[10].status) == (100, "listo")
    assert got[11] == {"CMP-001", "CMP-002", "CMP-003", "DES-001"}
    assert {"FT-001", "FT-002", "PRE-001", "CMP-001", "CMP-002", "CMP-003", "DES-002"} == got[12]


def test_scores_and_summary(spark):
    empty = [("zzz", {"a": "b"}, "", ""), ("med", {}, "", ""), ("med", None, None, None)]
    got, total = failed(spark, ("med", MED | {"forma": "Tableta"}, "Mounjaro Tirzepatida", ""), *empty)
    # possible: 20 completeness, 10 descriptions, 10 presentation, 12 coherence (no volume), 5 safety, 10 clarity, 10 claims
    assert (total[0].possible, total[0].obtained, total[0].score, total[0].errors) == (77.0, 72.0, 94, 1)
    assert all(total[i].status == "sin_evaluar" and total[i].score is None for i in (1, 2, 3))
    scored = spark.createDataFrame([(100, "listo"), (81, "revisar"), (None, "sin_evaluar")], "score int, status string")
    s = rules.summary(scored).first()
    assert (s.total, s.evaluated, s.average, s.least, s.greatest, s.critico, s.sin_evaluar) == (3, 2, 91, 81, 100, 0, 1)


def test_provisional_rules_count_half(spark):
    rows = rules.captured(spark.createDataFrame([(1, "med", {"a": " x "}), (2, "med", {}), (3, "cos", {})], "k int, cat string, v map<string,string>"))
    own = [rules.Rule("A", "d", 4, "error", "k", "{a} = ''"), rules.Rule("B", "d", 5, "error", "k", "{a} = ''", provisional=True), rules.Rule("C", "e", 3, "info", "k", "true", categories=("cos",))]
    out = {(r.k, r.rule): (r.state, r.possible, r.lost) for r in rules.evaluated(rows, "k", own).collect()}
    assert out[1, "A"] == ("cumple", 4.0, 0.0) and out[2, "A"] == ("error", 4.0, 4.0) and out[2, "B"] == ("pendiente", 2.5, 1.25) and out[2, "C"] == ("no_aplica", 0.0, 0.0) and out[3, "C"] == ("pendiente", 3.0, 0.0)
    by = {r.k: (r.score, r.status) for r in rules.scores(rules.evaluated(rows, "k", own), "k").collect()}
    assert by == {1: (100, "listo"), 2: (19, "critico"), 3: (45, "critico")}


SHAPE = "product_id int, seq long, cat string, v map<string,string>, sku string, img string, html string, title string, meta_title string, meta_description string, image_text string, image_over boolean, near_sku boolean, blocked boolean, incomplete boolean, unconfirmed boolean, worded boolean, confirmed boolean"


def test_readiness(spark):
    r = lambda i, sku, **k: (i, i, k.get("cat", "med"), k.get("v", {"marca": "x"}), sku, k.get("img", ""), k.get("html", "<p>a</p>"), "t", "", "", k.get("alt", "a"), k.get("over"), k.get("near"), k.get("blocked"), k.get("incomplete"), k.get("ai"), k.get("worded"), k.get("confirmed"))
    rows = spark.createDataFrame([
        r(1, "A1"), r(2, "a1 "), r(3, "A2"), r(4, ""), r(5, None, blocked=True), r(6, "B", img="x", confirmed=True), r(7, "C", cat="zzz"), r(8, "D", v={"marca": " "}), r(9, "E", html="<p>a", alt=None, near=True, worded=True, ai=True), r(10, "F", html=" ", incomplete=True, over=True),
    ], SHAPE)
    found = readiness.readiness_checks(rows, export.violations(export.batch(rows)), spark.createDataFrame([("a2", "lost")], "sku string, problem string"))
    by = {}
    for x in found.filter("level IN ('block', 'warning')").collect():
        by.setdefault(x.product_id, {}).setdefault(x.level, set()).add(x.check[3:])
    assert by[1] == {"block": {"013"}, "warning": {"010", "012"}} and by[2] == {"warning": {"010", "012", "013"}}
    assert by[3] == {"block": {"007"}, "warning": {"010", "012"}}
    assert by[4] == {"block": {"001"}, "warning": {"010", "012"}} and by[5] == {"block": {"001", "002"}, "warning": {"010", "012"}}
    assert 6 not in by and by[7] == {"block": {"001"}} == by[8]
    assert by[9] == {"block": {"004"}, "warning": {"005", "009", "010", "011", "012", "014"}}
    assert by[10] == {"block": {"003", "009"}, "warning": {"010", "011", "012"}}
    states = {s.product_id: (s.state, s.score) for s in scores.readiness(found).collect()}
    assert states[6] == ("READY", 100) and states[2] == ("READY_WITH_WARNINGS", 76) and states[1][0] == "BLOCKED" and states[9] == ("BLOCKED", 27)
    # what is not blocked is what the batch has
    ready = {x.sku.strip().lower() for x in rows.join(scores.readiness(readiness.readiness_checks(rows)).filter("state <> 'BLOCKED'"), "product_id").collect()}
    assert ready == {x.sku.lower() for x in export.batch(rows.filter(F.col("product_id").isin(1, 2, 3, 4, 5, 6, 9, 10))).collect()}
