"""Catalogue files against hand-worked literals."""

import os

from pyspark.sql import functions as F

from catalogspark.sources import catalogues


def write(tmp_path, **files):
    for name, text in files.items():
        with open(os.path.join(tmp_path, f"{name}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return str(tmp_path)


def by_file(df):
    return df.withColumn("file", F.regexp_extract("file", r"([^/]+)\.csv$", 1))


def test_each_file_has_its_own_delimiter(spark, tmp_path):
    path = write(tmp_path, semi='a;b;c\r\n1;"x;y";"di ""hola"""\r\n', comma='﻿a,b\n"1\n2",\n,,\n', tab="a\tb\tc,d\n1\t2\n")
    got = {(r.file, tuple(r.cells)) for r in by_file(catalogues.read_cells(spark, path)).collect()}
    assert ("semi", ("1", "x;y", 'di "hola"')) in got and ("tab", ("1", "2", "")) in got and ("comma", ("1\n2", "")) in got


def test_headers_rows_and_examples(spark, tmp_path):
    path = write(
        tmp_path,
        one="SKU,Categoría,Marca,Principio activo,Forma farmacéutica,¿Requiere receta médica?,Otra cosa\nA1,Medicamentos,Ozempic,Semaglutida,SOL INY,Sí,x\nEJEMPLO,Medicamentos,x,,,\n\nA2,Inventada,x,,,,\nA3,,y,,,,\nA4,Medicamentos,,,,quizá,\n",
        two="Codigo;Categoria;Piezas;Contenido neto;Nivel de protección;Datos crudos (opcional);Imagen principal\nB1;cosméticos;;30 mL;MUY ALTA;;f.jpg\nB2;dermo;12;30 mL;nada;;\nB3;beb;;;;AGUA 600ML;\n",
    )
    got = {r.sku: r for r in by_file(catalogues.ingest_catalog_csv(spark, path)).collect()}
    assert set(got) == {"A1", "A2", "A3", "A4", "B1", "B2", "B3"}
    assert got["A1"].cat == "med" and got["A1"].v == {"marca": "Ozempic", "principio": "Semaglutida", "forma": "SOL INY", "receta": "si"} and got["A1"].n == 2 and got["A1"].error == ""
    assert got["A2"].error == "Categoría no reconocida: Inventada" and got["A2"].cat is None and not got["A2"].v
    assert got["A3"].error.startswith("Sin categoría") and got["A4"].error == "Fila sin datos del producto."
    assert got["B1"].v == {"contenido": "30 mL", "nivel": "Muy alta"} and got["B1"].img == "f.jpg" and got["B2"].v == {"contenido": "12"}
    assert (got["B3"].pending, got["B3"].cat, got["B3"].raw, got["B3"].error) == (True, "beb", "AGUA 600ML", "")
    cells = catalogues.read_cells(spark, path)
    assert {(r.file, r.header) for r in by_file(catalogues.ignored_headers(cells)).collect()} == {("one", "Otra cosa")}
    assert {(r.file, r.skipped) for r in by_file(catalogues.skipped_examples(cells)).collect()} == {("one", 1), ("two", 0)}
    default = {r.sku: r for r in catalogues.ingest_catalog_csv(spark, path, "hig").collect()}
    assert default["A3"].cat == "hig" and default["A3"].v == {"marca": "y"}


def test_no_rows(spark):
    none = spark.createDataFrame([], "file string, line long, cells array<string>")
    assert catalogues.map_headers(none).count() == 0 and catalogues.ignored_headers(none).count() == 0
    one = spark.createDataFrame([("f", 1, ["SKU", "Marca", None])], "file string, line long, cells array<string>")
    assert catalogues.map_headers(one, "med").count() == 0
