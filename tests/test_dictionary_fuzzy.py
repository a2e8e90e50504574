from pyspark.sql import functions as F

from catalogspark.plans import records


def test_dictionary_fuzzy_keeps_short_aliases(spark, tmp_path):
    spark.createDataFrame([(1, "red widget"), (2, "blue box")], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {(x.value, x.alias) for x in records.dictionary_fuzzy(spark, str(tmp_path)).filter(F.col("exact")).collect()}
    assert {("red widget", "red"), ("blue boxs", "blue")} <= got
