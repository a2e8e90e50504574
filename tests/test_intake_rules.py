"""Extraction and normal forms against hand-worked literals."""

from pyspark.sql import functions as F

from catalogspark.operators import extraction, facts, normalize, titles

KEEP = ["gnc", "omron", "gsk"]
DICTIONARY = [("brand", "Lamobrigan", "Lamobrigan", 0), ("maker", "PISA", "Pisa", 0), ("ingredient", "Escitalopram", "Escitalopram", 0)]


def extracted(spark, texts, dictionary=None, **more):
    rows = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(texts)], "k int, t string, c string").repartition(4)
    known = spark.createDataFrame(dictionary, "kind string, alias string, canon string, seq long") if dictionary else None
    return {r.k: r for r in extraction.row_state(extraction.extract(rows, "k", "t", known, "c", **more)).collect()}


def test_medicine_with_dictionary(spark):
    got = extracted(spark, [("LAMOBRIGAN ESCITALOPRAM 10MG TAB CAJ C/28 PISA", None), ("pisa Escitalopram escitalopram", "med"), (None, None), ("ZZZ QWERTY 123", None), ("hola", "hig")], DICTIONARY)
    assert got[0].cat == "med" and got[0].fields == {"marca": "Lamobrigan", "laboratorio": "Pisa", "principio": "Escitalopram", "concentracion": "10 mg", "forma": "Tableta", "contenido": "CAJ C/28 tabletas"}
    assert got[0].leftover == [] and got[0].error is None
    assert got[1].fields == {"laboratorio": "Pisa", "principio": "Escitalopram"} and got[1].leftover == []
    assert got[2].cat is None and got[2].leftover == [] and got[2].fields == {}
    assert got[3].cat is None and got[3].leftover == ["ZZZ", "QWERTY", "123"] and got[3].error.startswith("No se detectó")
    assert got[4].error.startswith("No se encontraron")


def test_rules_use_up_their_text(spark):
    texts = [
        ("MOUNJARO 2.5MG/0.6ML SOL INY CAJ C/4 LILLY", None), ("ATORVASTATINA 20 MG TAB C/30", None), ("ATORVASTATINA 20 MG TAB C/30 RX", None), ("ELECTROLIT SUERO ORAL COCO 625ML SIN AZUCAR", None),
        ("OMRON HEM-7121 BAUMANOMETRO DIGITAL", None), ("PROTECTOR SOLAR FACIAL SPF 50+ FCO 50ML", None), ("CERAVE CREMA HIDRATANTE 454G", None), ("Intensive cream 50 mL", "dis"), ("Metformina 850 mg tab lib prolongada 2 mg", "med"),
    ]
    got = extracted(spark, texts, suggest_brand=False)
    f = [got[i].fields for i in range(len(texts))]
    assert (f[0]["concentracion"], f[0]["volumen"], f[0]["forma"], got[0].leftover) == ("2.5 mg", "0.6 mL", "Solución inyectable", ["MOUNJARO", "LILLY"]) and "marca" not in f[0]
    assert "receta" not in f[1] and f[2]["receta"] == "si"
    assert (got[3].cat, f[3]["sabor"], f[3]["atributo"], f[3]["contenido"], got[3].leftover) == ("beb", "Coco", "Sin azúcar", "625 mL", ["ELECTROLIT"])
    assert (got[4].cat, f[4]["tipo"], f[4]["modelo"]) == ("dis", "Baumanómetro digital", "HEM-7121")
    assert (got[5].cat, f[5]["fps"], f[5]["tipo"], f[5]["contenido"]) == ("cos", "50+", "Protector solar", "FCO 50 mL") and "atributo" not in f[5]
    assert (f[6]["tipo"], f[6]["contenido"]) == ("Crema hidratante", "454 g")
    assert "tipo" not in f[7]
    assert got[8].notes == ["Dosis sin asignar: 2 mg.", "Liberación prolongada detectada, pero no hay presentación a la cual agregarla."]


def test_forms_kinds_and_packs(spark):
    want = [
        ("GNC Vitamina C 1000 mg gomitas frasco 60", "sup", "forma", "Gomita"), ("Vitamina D3 softgel frasco c/90", "sup", "forma", "Cápsula blanda"), ("Magnesio tabletas masticables frasco c/60", "sup", "forma", "Tableta masticable"),
        ("Vitamina C efervescente tubo c/20", "sup", "forma", "Tableta efervescente"), ("Proteína whey polvo bote 900 g sabor chocolate", "sup", "componente", "Proteína whey"), ("Colágeno liquido botella 500 mL", "sup", "forma", "Líquido"),
        ("Omega 3 caps veg frasco c/60", "sup", "forma", "Cápsula vegetal"), ("Ketorolaco tab sublingual 30 mg caja c/10", "med", "forma", "Tableta sublingual"), ("Paracetamol 500 mg tab caja c/20", "med", "forma", "Tableta"),
        ("Accu-Chek lancetas caja c/100", "dis", "tipo", "Lancetas"), ("Omron esfigmomanometro digital", "dis", "tipo", "Esfigmomanómetro digital"), ("Eucerin exfoliante facial 100 mL", "cos", "tipo", "Exfoliante"),
        ("Colgate acondicionador 400 mL", "hig", "producto", "Acondicionador"), ("Saba toallas sanitarias c/10", "hig", "producto", "Toallas sanitarias"), ("Rodillera ortopedica talla M", "acc", "producto", "Rodillera"),
        ("Fresubin nutricion oral 200 mL", "beb", "tipo", "Nutrición oral"), ("Nature Made calcio tabletas c/100", "sup", "componente", "Calcio"), ("Vitamina b12 500 mcg", "sup", "componente", "Vitamina B12"),
        ("Proteína barras caja c/12 barras", "sup", "contenido", "caja c/12 barras"), ("Omega 3 softgels bote 120 perlas", "sup", "contenido", "120 perlas"),
    ]
    got = extracted(spark, [w[:2] for w in want])
    assert [got[i].fields.get(w[2]) for i, w in enumerate(want)] == [w[3] for w in want]


def test_dictionary_order_and_spans(spark):
    dictionary = [("brand", "Casa", "Casa", 0), ("brand", "Casa Azul", "Casa Azul", 1), ("maker", "Azul", "Azul SA", 2), ("ingredient", "uno dos tres cuatro cinco seis siete", "Largo", 3), ("ingredient", "uno", "Uno", 4)]
    got = extracted(spark, [("CASA AZUL uno dos tres cuatro cinco seis siete 5MG TAB UNO", "med"), ("azul casa CASA uno", "med"), ("casa uno", "cos")], dictionary, suggest_brand=True)
    assert got[0].fields == {"marca": "Casa Azul", "principio": "Largo, Uno", "concentracion": "5 mg", "forma": "Tableta"} and got[0].leftover == []
    assert got[1].fields == {"marca": "Casa", "laboratorio": "Azul SA", "principio": "Uno"} and got[1].leftover == ["CASA"]
    assert got[2].fields == {"marca": "Casa"} and got[2].leftover == ["uno"]
    guess = extracted(spark, [("Mi Marca crema facial", "cos")], suggest_brand=True)[0]
    assert guess.fields["marca"] == "Mi Marca" and guess.notes == ["La marca es una sugerencia por posición. Verifícala."]


def test_case_units_and_packs(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    assert val(titles.spaced_units(F.lit("500mg 10ML 5GR"))) == "500 mg 10 mL 5 g" and val(titles.spaced_units(F.lit("10ML"), True)) == "10 ml" and val(titles.spaced_units(F.lit("150 UG"))) == "150 UG"
    packs = {"CAJ C/30 TAB": "Caja con 30 tabletas", "C/30": "Caja con 30 piezas", "X 30": "Caja con 30 piezas", "c/1": "Caja con 1 pieza", "30": "30 piezas", "FCO 30 ml": "Frasco 30 ml", "Caja con 4 plumas": "Caja con 4 plumas"}
    assert {k: val(normalize.expanded_pack(F.lit(k))) for k in packs} == packs
    cases = {"ELI LILLY": "Eli Lilly", "GNC VITAMINA DE LA CASA": "GNC Vitamina de la Casa", "Mixto IGUAL": "Mixto IGUAL", "CI 77891": "CI 77891", "SPF 50 XZT": "SPF 50 XZT", "": ""}
    assert {k: val(normalize.fixed_case(F.lit(k), KEEP)) for k in cases} == cases
    assert val(normalize.sentence_case(F.lit("TOMAR DOS. USAR CON AGUA! LUEGO NADA"), KEEP)) == "Tomar dos. Usar con agua! Luego nada"
    assert [tuple(val(facts.pack(F.lit(x)))) for x in ("30 pzas", "c/1", "FCO 30 ml", "30", "Caja")] == [("30 piezas", "seed.presentation.pzas→piezas"), ("Caja con 1 pieza", "existing.c/N→Caja con N piezas"), ("Frasco 30 ml", "existing.expand"), ("30 piezas", "existing.bare-number→piezas"), ("Caja", "none")]
    assert val(titles.small_nouns(F.lit("28 CÁPSULAS y 3 Sobres"))) == "28 cápsulas y 3 sobres"
    pieces = [("Cápsulas", "Caja con 28 piezas", "28 Cápsulas"), ("Tabletas masticables", "1", "1 Tableta masticables"), ("Tableta", "Frasco x 30", "30 Tabletas"), ("Jarabe", "30", ""), ("Cápsulas", "Frasco 30 mL", "")]
    assert [val(normalize.pieces_of_form(F.lit(a), F.lit(b))) for a, b, _ in pieces] == [w for *_, w in pieces]
    form = lambda a, b, **k: val(normalize.form_and_content(F.lit(a), F.lit(b), **k))
    assert form("Solución inyectable", "Caja con 4 plumas") == "Solución inyectable, Caja con 4 plumas" and form("Bebible", "200 mL", supplement=True) == "Líquido 200 mL"
    assert form("Cápsulas", "Caja con 28 piezas", by_piece=True) == "28 Cápsulas" and form("Tableta", "30 tabletas") == "30 tabletas" and form("", "x") == "x"


def test_quantities_move_where_they_belong(spark):
    rows = [
        (1, "sup", {"componente": "200 mL", "contenido": "Fórmula hipercalórica"}), (2, "sup", {"componente": "Fórmula hipercalórica 200 mL"}), (3, "sup", {"componente": "Fórmula hipercalórica", "contenido": "200 mL"}),
        (4, "sup", {"componente": "Vitamina C 500 mg", "contenido": "Frasco con 30 cápsulas"}), (5, "sup", {"contenido": "Fórmula hipercalórica"}), (6, "cos", {"contenido": "Frasco con gotero de 30 mL", "tipo": "Sérum"}),
        (7, "beb", {"contenido": "Caja con 12 latas de 330 mL", "tipo": "Agua"}), (8, "beb", {"contenido": "Botella de 600 mL", "tipo": "Agua"}), (9, "dis", {"presentacion": "Caja con 50 piezas"}), (10, "zzz", {"contenido": "x"}), (11, "med", None),
    ]
    got = {r.product_id: (r.v, r.changes) for r in normalize.normalize_fields(spark.createDataFrame(rows, "product_id int, cat string, v map<string,string>")).collect()}
    assert got[1][0] == {"componente": "Fórmula hipercalórica", "contenido": "200 mL"} and len(got[1][1]) == 2
    assert got[2][0] == {"componente": "Fórmula hipercalórica", "contenido": "200 mL"} and len(got[2][1]) == 2
    assert got[3][0] == {"componente": "Fórmula hipercalórica", "contenido": "200 mL"} and got[3][1] == []
    assert got[4][0] == {"componente": "Vitamina C 500 mg", "contenido": "Frasco con 30 cápsulas"} and got[4][1] == []
    assert got[5][0] == {"componente": "Fórmula hipercalórica"}
    assert got[6][0] == {"contenido": "30 mL", "tipo": "Sérum", "envase": "Frasco con gotero"}
    assert got[7][0] == {"contenido": "12 x 330 mL", "tipo": "Agua", "envase": "Caja con 12 latas"} and got[8][0] == {"contenido": "600 mL", "tipo": "Agua", "envase": "Botella"}
    assert got[9][0] == {"presentacion": "Caja", "contenido": "50 piezas"} and got[10] == ({}, [])
    assert not got[11][0]
