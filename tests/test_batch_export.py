"""The batch file against hand-worked literals."""

import glob

from catalogspark.operators import export

ROW = "seq long, sku string, img string, html string, title string, meta_title string, meta_description string, image_text string, blocked boolean, incomplete boolean, unconfirmed boolean, worded boolean, confirmed boolean"


def rows(spark):
    r = lambda seq, sku, title="t", **k: (seq, sku, k.get("img"), k.get("html", "<p>a,\n  b</p>"), title, "mt, x", "md", k.get("alt"), k.get("blocked"), k.get("incomplete"), k.get("ai"), k.get("worded"), k.get("confirmed"))
    return spark.createDataFrame([
        r(1, "A1", "Mounjaro, 5 mg | x\ny", confirmed=True, img=" a.jpg "), r(2, " "), r(3, None), r(4, "B", ai=True), r(5, "C", blocked=True), r(6, "D", incomplete=True), r(7, "a1 ", "second", alt="x, y"), r(8, "E", worded=True), r(9, 'F "q"', html=None),
    ], ROW)


def test_rows_cells_and_reasons(spark):
    assert len(export.COLUMNS) == len(set(export.COLUMNS)) == 104
    got = {r.sku: r for r in export.batch(rows(spark)).collect()}
    assert set(got) == {"a1", "E", 'F "q"'} and got["a1"].place == 1 and len(got["a1"]) == 105
    a = got["a1"]
    assert (a.description, a.additional_attributes, a.base_image_label, a.meta_title, a.base_image) == ("<p>a;b</p>", "categoria_prod=second", "x; y", "", "")
    assert all(a[c] == "1" for c in export.ONES) and a.name == "" and a.qty == ""
    c = export.counters(rows(spark)).first()
    assert (c.total, c.no_sku, c.unconfirmed, c.blocked, c.incomplete, c.language, c.exported, c.replaced, c.without_meta, c.without_image) == (9, 2, 1, 1, 1, 0, 3, 1, 3, 3)
    more = {r.sku: r for r in export.batch(rows(spark).filter("seq <> 7"), with_incomplete=True, with_unconfirmed=True, without_language=True).collect()}
    assert set(more) == {"A1", "B", "D", 'F "q"'} and more["A1"].additional_attributes == "categoria_prod=Mounjaro; 5 mg | x y" and more["A1"].meta_title == "mt; x" and more["A1"].short_description == "md"


def test_relations_are_allowed_before_they_are_cut(spark):
    rel = spark.createDataFrame([("A1", f"N{i}", "upsell", i) for i in range(5)] + [("A1", "E", "upsell", 9), ("A1", 'f "Q"', "upsell", 10), ("A1", "K", "upsell", 11)] + [("A1", "E", "crosssell", 1), ("E", "A1", "related", 1)], "sku string, other string, kind string, rank int")
    got = {r.sku: r for r in export.batch(rows(spark), rel, known=spark.createDataFrame([("k",)], "sku string")).collect()}
    assert (got["a1"].upsell_skus, got["a1"].crosssell_skus, got["E"].related_skus) == ('E|f "Q"|K', "E", "A1")


def test_contract_and_round_trip(spark, tmp_path):
    good = export.batch(rows(spark))
    assert export.violations(good).count() == 0
    path = str(tmp_path / "batch")
    assert export.round_trip(good, path).collect() == []
    text = "".join(open(f, newline="", encoding="utf-8").read() for f in glob.glob(f"{path}/*.csv"))
    assert text.endswith("\r\n") and '"F ""q"""' in text
    bad = good.selectExpr("place", "sku", "'x,y' AS name", "'a\\nb' AS qty", "'1,2' AS categories", *[c for c in export.COLUMNS if c not in ("sku", "name", "qty", "categories", "weight")], "1 AS more")
    found = {(r.sku, r.column, r.violation) for r in export.violations(bad).collect()}
    assert {("E", "name", "comma"), ("E", "qty", "line break"), (None, "weight", "missing"), (None, "more", "unknown")} <= found and not any(c == "categories" for _, c, _ in found)
