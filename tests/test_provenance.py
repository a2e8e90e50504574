import os

from pyspark.sql import functions as F

from catalogspark.operators import provenance


def test_fields_keep_their_first_original(spark):
    v = {"marca": " A  b ", "forma": "Gel", "via": None}
    now = spark.createDataFrame([(1, v, {"marca": "sugerido", "forma": "confirmado"}), (2, {"marca": "x"}, None)], "product_id int, v map<string,string>, ai map<string,string>")
    before = "product_id int, field string, source string, evidence string, original string, normalized string, updated_at string"
    old = spark.createDataFrame([(1, "marca", "ai", "seen", "a", " A  b ", "t1"), (1, "forma", "manual", None, "GEL", "Gel", "t1"), (1, "gone", "manual", "", "", "", "t1"), (2, "marca", "manual", "e", None, "x", None)], before)
    got = {(r.product_id, r.field): tuple(r)[2:] for r in provenance.field_provenance(now, old, F.lit("t2")).collect()}
    assert got == {
        (1, "marca"): ("ai", "seen", "a", "A b", "t1"),
        (1, "forma"): ("ai-confirmed", "", "GEL", "Gel", "t2"),
        (1, "via"): ("manual", "", "", "", "t2"),
        (2, "marca"): ("manual", "e", "x", "x", "t2"),
    }
    first = provenance.field_provenance(now, old.limit(0), F.lit("t2"))
    assert first.filter("updated_at = 't2'").count() == 4


def test_each_file_in_its_own_charset(spark, tmp_path):
    files = {"a.csv": "﻿año €".encode(), "b.csv": "año €".encode("cp1252"), "c.csv": b"plain", "d.csv": b"", "e.csv": b"\x81\xe9"}
    for name, data in files.items():
        with open(os.path.join(tmp_path, name), "wb") as f:
            f.write(data)
    got = {os.path.basename(r.path): (r.text, r.charset) for r in provenance.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ("año €", "utf-8"), "b.csv": ("año €", "windows-1252"), "c.csv": ("plain", "utf-8"), "e.csv": ("\x81é", "windows-1252")}
