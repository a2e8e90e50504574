from catalogspark.operators import assessment


def test_states_suggestions_and_issues(spark):
    e = [("b1", "brand", "Bayer", "bayer", "trusted"), ("b2", "brand", "Pfizer", "pfizer", "conflicted"), ("s1", "substance", "Paracetamol", "paracetamol", "confirmed"), ("c1", "concentration", "500 mg", "500 mg", "rejected"), ("p1", "presentation", "30 piezas", "30 piezas", "observed")]
    entities = spark.createDataFrame(e, "id string, type string, canonical string, normalized string, status string")
    aliases = spark.createDataFrame([("substance", "acetaminofen", "s1", "confirmed"), ("brand", "bayer", "b2", "suggested"), ("brand", "old", "b1", "rejected")], "type string, normalized_alias string, entity_id string, status string")
    rows = [
        (1, {"marca": "BAYER", "principio": "Acetaminofén", "concentracion": "500MG", "contenido": "30 pzas", "receta": "si"}), (2, {"marca": "pfizer", "concentracion": "mucho", "laboratorio": "X", "forma": " "}), (3, {"marca": "Old", "principio": "Paracetamol"}), (4, None),
    ]
    products = spark.createDataFrame(rows, "product_id int, v map<string,string>")
    found = assessment.assess_products(products, entities, aliases, mature=2)
    got = {(r.product_id, r.field): (r.state, r.via, r.suggested) for r in found.collect()}
    assert got == {
        (1, "marca"): ("trusted", "exact", "Bayer"), (1, "principio"): ("confirmed", "alias", "Paracetamol"), (1, "concentracion"): ("rejected", "exact", None), (1, "contenido"): ("known", "exact", None),
        (2, "marca"): ("conflict", "exact", "Pfizer"), (2, "concentracion"): ("unknown", None, None), (2, "laboratorio"): ("new", None, None), (3, "marca"): ("unknown", None, None), (3, "principio"): ("confirmed", "exact", None),
    }
    checks = spark.createDataFrame([(1, "mismatch", True), (2, "match", True), (3, "mismatch", None)], "product_id int, verdict string, strong boolean")
    issues = sorted((r.product_id, r.field, r.code, r.severity) for r in assessment.knowledge_issues(found, checks).collect())
    assert issues == [
        (1, "concentracion", "knowledge-rejected", "warning"), (1, "laboratorio", "knowledge-mismatch", "error"), (2, "concentracion", "knowledge-unknown", "warning"), (2, "marca", "knowledge-conflict", "warning"), (3, "laboratorio", "knowledge-mismatch", "warning"), (3, "marca", "knowledge-unknown", "warning"),
    ]
