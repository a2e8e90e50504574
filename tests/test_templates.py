"""Meta texts against hand-worked literals."""

from pyspark.sql import functions as F

from catalogspark.operators import templates, titles


def texts(spark, cat, v, store="", shorten=False, of=None):
    one = spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v))
    clean = titles.deduped({k: F.col(k) for k in v}, F.col("marca"))
    tokens = templates.meta_tokens(cat, clean, F.lit("un título"), store)
    return one.select(templates.meta_texts(cat, tokens, shorten, of).alias("m")).first().m


def rendered(spark, text, separator, most, tokens, shorten=False):
    t = templates.Template(text, separator, most, {k: F.lit(x) for k, x in tokens.items()})
    return spark.range(1).select(t.render(shorten).alias("r")).first().r, t.unknown


def test_medicine(spark):
    med = {"marca": "Mounjaro", "concentracion": "2.5 mg", "principio": "Tirzepatida", "laboratorio": "Eli Lilly", "contenido": "Caja con 4 plumas", "receta": "si"}
    m = texts(spark, "med", med)
    assert m.title.text == "Comprar Mounjaro 2.5 mg | Tirzepatida | Eli Lilly"
    assert m.description.text == "El Mounjaro de 2.5 mg contiene Tirzepatida por Eli Lilly | Venta en línea con receta médica de forma segura"
    assert m.image.text == "Mounjaro 2.5 mg, Tirzepatida, caja con 4 plumas" and not m.image.over
    assert texts(spark, "med", med | {"receta": "no", "laboratorio": None}).description.text == "El Mounjaro de 2.5 mg contiene Tirzepatida por | Venta en línea de forma segura"


def test_supplement_drops_brackets_from_the_right(spark):
    v = {"marca": "Fresubin HPC", "componente": "Fórmula Hipercalórica e Hiperproteica", "sabor": "Frutos del Bosque", "contenido": "200 mL", "fabricante": "Fresenius Kabi", "caracteristicas": "Alta en proteína. Sin gluten.", "tipoCorto": ""}
    m = texts(spark, "sup", v, "Farmacias Especializadas")
    assert m.title.text == "Fresubin HPC | Frutos del Bosque, 200 mL" and m.title.dropped == ["Farmacias Especializadas", "Fórmula Hipercalórica e Hiperproteica"]
    m = texts(spark, "sup", v | {"tipoCorto": "Hipercalórica"}, "Farmacias Especializadas")
    assert m.title.text == "Fresubin HPC Hipercalórica | Frutos del Bosque, 200 mL"
    assert m.description.text == "Fresubin HPC Hipercalórica, Frutos del Bosque, 200 mL. Fresenius Kabi. Alta en proteína."
    assert texts(spark, "sup", v | {"sabor": "", "tipoCorto": "Fórmula"}, "Farmacias Especializadas").title.text == "Fresubin HPC Fórmula | 200 mL | Farmacias Especializadas"


def test_other_categories(spark):
    hig = {"marca": "Colgate", "producto": "Total 12", "tipo": "Pasta dental", "variante": "Menta", "contenido": "100 mL", "envase": "Tubo", "beneficio": "Salud bucal completa", "publico": "Adultos"}
    m = texts(spark, "hig", hig, "Farmacias Especializadas")
    assert m.title.text == "Colgate Total 12 Pasta dental | Menta, 100 mL"
    assert m.description.text == "Colgate Total 12 Pasta dental. Salud bucal completa para adultos. Tubo de 100 mL. Compra en Farmacias Especializadas."
    cos = {"marca": "CeraVe", "producto": "Crema Hidratante", "tipo": "Crema", "atributo": "Ceramidas", "contenido": "454 g"}
    m = texts(spark, "cos", cos)
    assert m.title.text == "CeraVe Crema Hidratante con ceramidas | 454 g" and m.image.text == "CeraVe Crema Hidratante, 454 g"
    beb = {"marca": "X", "tipo": "Agua", "sabor": "Coco", "contenido": "12 x 330 mL", "envase": "Caja con 12 latas", "publico": "Adultos"}
    assert texts(spark, "beb", beb).description.text == "X Agua. Para adultos. Caja con 12 latas (12 x 330 mL)."
    assert texts(spark, "dis", {"marca": "Omron", "modelo": "HEM-7121", "tipo": "Baumanómetro digital", "tecnologia": "digital de brazo", "contenido": "1 pieza"}).title.text == "Omron HEM-7121 Baumanómetro digital | De brazo, 1 pieza"
    acc = {"marca": "Y", "producto": "Rodillera", "talla": "M", "lado": "Derecho", "material": "neopreno", "contenido": "1 pieza", "envase": "Bolsa"}
    m = texts(spark, "acc", acc)
    assert (m.title.text, m.description.text) == ("Y Rodillera | Talla M, Derecho, 1 pieza", "Y Rodillera. Neopreno. Bolsa con 1 pieza.")


def test_lines_go_from_the_store_backwards(spark):
    t = {"a": "Marca Producto Muy Largo Con Muchas Palabras", "b": "Bloque B", "c": "Bloque C", "tienda": "Tienda"}
    r, _ = rendered(spark, "{a}\n{b}\n{c}\n{tienda}", " | ", 60, t, True)
    assert (r.text, r.length, r.dropped, r.shortened, r.over) == ("Marca Producto Muy Largo Con Muchas Palabras | Bloque B", 55, ["Tienda", "Bloque C"], True, False)
    r, _ = rendered(spark, "{a}\n{b}\n{c}\n{tienda}", " | ", 30, t, True)
    assert r.over and not r.shortened and r.text.endswith("Tienda")
    assert not rendered(spark, "{b}\n{c}", " | ", 60, t, True)[0].shortened and rendered(spark, "{a}", " | ", 0, t, True)[0].text == t["a"]


def test_empty_tokens_unknown_tokens_and_loose_ends(spark):
    assert rendered(spark, "{a}[ {b}]\n[{c}]", " | ", 60, {"a": "A", "b": "", "c": None})[0].text == "A"
    r, unknown = rendered(spark, "{x} {a}\n{y:o} fijo\n{b} solo", ". ", 60, {"a": "A.", "b": ""})
    assert (r.text, unknown) == ("A. fijo.", ["x", "y"])
    assert rendered(spark, "{a} ( {b} ) -\n- , {a} por {b}", " | ", 60, {"a": "A", "b": ""})[0].text == "A | A por"
    assert rendered(spark, "{a} por[ {b}]", " | ", 60, {"a": "A", "b": ""})[0].text == "A"
    assert rendered(spark, "{a:lc}\n{b:lc}", ", ", 60, {"a": "Hola", "b": "GNC x"})[0].text == "hola, GNC x"
    assert rendered(spark, "", " | ", 60, {})[0].text == ""
