"""Steps that must not end in one task, grow with copies of an expression, or pass a table through the driver."""

import pytest
from pyspark.sql import functions as F

from catalogspark.functions import session
from catalogspark.operators import anomalies, findings, nutrition
from catalogspark.plans import contents, decisions, metatexts, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [lambda s: views.products(s, SF), lambda s: contents._texts(s, SF), lambda s: decisions._tables(s, SF)])
def test_products_of_one_small_file_are_many_tasks(spark, rows):
    assert rows(spark).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_meta_texts_stand_once_in_their_plan(spark):
    plan = metatexts.render_meta(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 300_000


def test_unified_broadcasts_no_findings(spark, monkeypatch):
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(findings, "written", seen)
    rows = [(1, "a:x", ["a", "x"], "health", "error", 1), (1, "b:x", ["b", "x"], "content", "mejora", 5), (1, "c:y", ["c", "y"], "health", "mejora", 2), (2, "a:x", ["a", None], "health", "error", 1)]
    df = spark.createDataFrame(rows, "product_id long, id string, keys array<string>, axis string, class string, points long")
    got = sorted(map(tuple, findings.unified(df).collect()))
    assert got == [(1, "a:x", 2, "content,health", 2, 5), (1, "c:y", 1, "health", 7, 2), (2, "a:x", 1, "health", 2, 1)]
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


def test_captions_of_lines_are_found_in_one_pass(spark):
    df = spark.createDataFrame([(1, "Titulo\nSodio | 1 g"), (2, "Sodio | 1 g\nTitulo"), (None, "Titulo\nSodio | 1 g")], "k long, t string")
    out = nutrition.lines(df, "k", "t")
    assert sorted((str(r.k), r.line, r.kind) for r in out.collect()) == [("1", 0, "caption"), ("1", 1, "row"), ("2", 0, "row"), ("2", 1, "title"), ("None", 0, "title"), ("None", 1, "row")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_near_pairs_are_verified_where_they_meet_and_joined_to_rows_without_a_shuffle_of_pairs(spark):
    df = spark.createDataFrame([(1, "Alfa Beta 10"), (2, "alfa beta 11"), (2, "alfa beta 11"), (3, "Alfa Bet a 10")], "seq long, t string")
    out = anomalies.near_duplicates(df, F.col("t"), "seq", 0.9, 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not plan[0].startswith("Aggregate")
    first = min(i for i, line in enumerate(plan) if "levenshtein" in line)
    assert first > min(i for i, line in enumerate(plan) if "Aggregate" in line and "score" in line)
    assert sorted((r.first_seq, r.second_seq) for r in out.collect()) == [(1, 2), (1, 3), (2, 3)]


def test_superseded_evidence_is_joined_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    assert session.spread(spark.range(10), "id", rows=10_001).rdd.getNumPartitions() == 101
    rows = views.table(spark, SF, "lineitem").count()
    plan = decisions.supersede_evidence(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-rows // 100)}), REPARTITION_BY_NUM" in plan
