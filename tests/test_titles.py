"""Derived texts against small cases worked out by hand."""

from pyspark.sql import functions as F

from catalogspark.operators import titles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_brand_and_type_are_not_said_twice(spark):
    rows = [
        ("Ácme", "ácme crema", "gel", "crema", "gel"),  # the brand is found without accents and cut by its length
        ("Acme", "acmecrema", "gel", "acmecrema", "gel"),
        ("", "Crema facial noche", "CREMA, noche", "Crema facial noche", ""),
        ("", "noche", "crema de noche", "", "crema de noche"),
        ("", "crema", "Crema", "crema", ""),  # equal words: the type goes
        ("Acme", None, None, "", ""),
        ("", "--", "crema", "--", "crema"),  # no words, inside of nothing
    ]
    data = spark.createDataFrame(rows, "m string, p string, t string, want_p string, want_t string")
    out = titles.deduped({"producto": F.col("p"), "tipo": F.col("t")}, F.col("m"))
    for r in data.select(out["producto"].alias("p"), out["tipo"].alias("t"), "want_p", "want_t").collect():
        assert (r.p, r.t) == (r.want_p, r.want_t)


def test_title_drops_soft_segments_from_the_right(spark):
    parts = [titles.segment(F.lit("aaaa")), titles.segment(F.lit("bbbb"), True), titles.segment(F.lit(None)), titles.segment(F.lit("cccc")), titles.segment(F.lit("pH 5"), True)]
    whole = "Aaaa | Bbbb | Cccc | pH 5"
    for limit, want, dropped in ((25, whole, []), (24, "Aaaa | Bbbb | Cccc", ["pH 5"]), (17, "Aaaa | Cccc", ["Bbbb", "pH 5"]), (1, "Aaaa | Cccc", ["Bbbb", "pH 5"])):
        got = one(spark, titles.title(parts, limit))
        assert (got.title, got.dropped) == (want, dropped)
    assert one(spark, titles.title([titles.segment(F.lit(""))], 5)).title == ""
    assert one(spark, titles.missing({"A": F.lit(""), "B": F.lit("x"), "C": F.lit(None).cast("string")})) == ["A", "C"]


def test_short_description_keeps_order_and_budget(spark):
    items = [("a", F.lit("uno dos"), False), ("b", F.lit("tres cuatro cinco"), True), ("c", F.lit("seis!"), True), ("d", F.lit(None).cast("string"), True), ("e", F.lit("siete"), False)]
    got = one(spark, titles.short_description(items, 4))
    assert (got.text, got.words, got.dropped) == ("Uno dos. Seis! Siete.", 4, ["b"])
    assert one(spark, titles.short_description(items, 7)).text == "Uno dos. Tres cuatro cinco. Seis! Siete."


def test_units(spark):
    cases = {
        "5MG/10Ml": "5 mg / 10 mL", "12,5grs": "12.5 g", "1,234 mg": "1,234 mg", "1.234,56 kg": "1.234.56 kg", "3µg y 4UG": "3 µg y 4 UG", "2lts, 5 iu": "2 L, 5 UI",
        "5 mgx": "5 mgx", "7 gotas": "7 gotas", "": "", None: "",
    }
    data = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert all(r.got == r.want for r in data.select(titles.spaced_units(F.col("t")).alias("got"), "want").collect())


def test_store_kinds(spark):
    cases = {"Con RECETA y vitaminas": "rx", "recetas": "otro", "Colágeno": "sup", "Cuidado de la piel": "cos", "Pañales": "hig", "Antigripal": "otc", "Oxímetros": "dis", None: "otro"}
    data = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r.got == r.want for r in data.select(titles.store_kind(F.col("t")).alias("got"), "want").collect())


def test_legacy_charset_equals_the_codec(spark):
    for text in ("", "añ€“Ž”\n\\]^-", "漢a\U0001f600\x81Ω", None):
        got = one(spark, titles.legacy_bytes(F.lit(text).cast("string")))
        want = [bytes([ord(c)]) if ord(c) < 128 else c.encode("cp1252", "replace") for c in text or ""]
        assert bytes(got.bytes) == b"".join(want)
        assert got.lost == sum(1 for c, b in zip(text or "", want) if b == b"?" and c != "?")
