from catalogspark.operators import catalogues

ENTRY = "sku string, updated_at string, exported_at string, snapshot string, eligible boolean, data map<string,string>"


def test_entries_follow_two_clocks(spark):
    e = lambda sku, up, ex, snap, who, ok=True: (sku, up, ex, snap, ok, {"w": who})
    local = spark.createDataFrame([e("A", "2024-01-02", "2024-01-01", "s1", "l"), e("B", "2024-01-01", "2024-01-05", "s1", "l"), e("C", None, None, None, "l"), e("D", "2024-01-01", "2024-01-01", "s1", "l"), e("Z", "1", None, None, "l")], ENTRY)
    incoming = spark.createDataFrame([e(" a", "2024-01-01", "2024-02-01", "s2", "i"), e("b", "2024-02-01", "2024-01-04", "s2", "i"), e("c", "2024-01-01", None, None, "i"), e("D", "2024-01-01", "2024-01-01", "s9", "i"), e("E", None, None, None, "i"), e(" ", "2025", None, None, "i")], ENTRY)
    got = {r.sku.strip().upper(): (r.data["w"], r.exported_at, r.snapshot, r.action) for r in catalogues.merged_entries(local, incoming).collect()}
    assert got == {
        "A": ("l", "2024-02-01", "s2", "updated"), "B": ("i", "2024-01-05", "s1", "updated"), "C": ("i", None, None, "updated"), "D": ("l", "2024-01-01", "s1", "same"), "E": ("i", None, None, "added"), "Z": ("l", None, None, "own"),
    }
    again = catalogues.merged_entries(catalogues.merged_entries(local, incoming).drop("action"), incoming)
    assert {r.action for r in again.collect()} == {"same", "own"}


def test_links_and_relations(spark):
    entries = spark.createDataFrame([("A", None, None, None, True, {}), ("B", None, None, None, True, {}), ("C", None, None, None, False, {})], ENTRY)
    pair = "parent string, child string"
    links = catalogues.merged_links(spark.createDataFrame([("A", "B")], pair), spark.createDataFrame([("a", "b "), ("B", "A"), ("b", "a"), ("A", "C"), ("A", "X"), ("X", "A")], pair), entries)
    assert sorted((r.parent, r.child, r.action) for r in links.collect()) == [("A", "B", "own"), ("A", "C", "not eligible"), ("A", "X", "orphan"), ("B", "A", "added"), ("X", "A", "orphan"), ("a", "b ", "known")]
    shape = "a string, b string, kind string, on boolean, at string"
    mine = spark.createDataFrame([("A", "B", "upsell", True, "2024-01-02"), ("A", "C", "upsell", True, "2024-01-02")], shape)
    theirs = spark.createDataFrame([("b", "a", "upsell", False, "2024-01-03"), ("B", "A", "upsell", True, "2024-01-01"), ("c", "a", "upsell", False, "2024-01-01"), ("B", "C", "related", True, None), ("B", "X", "related", True, "2")], shape)
    got = {(r.a, r.b, r.kind): (r.on, r.at, r.action) for r in catalogues.merged_relations(mine, theirs, entries).collect()}
    assert got == {("A", "B", "upsell"): (False, "2024-01-03", "changed"), ("A", "C", "upsell"): (True, "2024-01-02", "own"), ("B", "C", "related"): (True, None, "added"), ("B", "X", "related"): (True, "2", "orphan")}
