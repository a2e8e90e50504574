"""Streaming queries, run to the end of the stored events; their twins are the batch results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.functions.session import shared_dir
from catalogspark.streaming import jobs


#: How late an event may be; state of older ones is dropped.
LATE = "2 days"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream; the glob stands for one file as well as for a folder."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return events.withColumnRenamed("event_type", "action").withColumn("ts", F.col("ts").cast("timestamp"))


def _last(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an update-mode stream over all there is; returns each key's last row."""
    spark = updates.sparkSession
    path = shared_dir(spark, "stream")
    schema = updates.schema

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/part={number}")

    updates.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{path}/out")
    rest = [c for c in updates.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def stream_approval_state(spark, d):
    return _last(jobs.approval_stream(_events(spark, d), "user_id", ["ts", "event_id"], "purchase", "error"), ["user_id"])


def stream_evidence_counts(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("target"), F.col("action").alias("kind"), "event_id", "ts")
    return _last(jobs.evidence_stream(e, ["target"], "event_id", "ts", LATE), ["target", "kind"])


def stream_hourly_actions(spark, d):
    return _last(jobs.windowed_counts(_events(spark, d), "ts", F.col("action"), "1 hour", LATE), ["start", "key"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (stream_approval_state, stream_evidence_counts, stream_hourly_actions)}
ORACLE_SQL = {
    "stream_approval_state": "SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) = 'purchase' AS approved FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id",
    "stream_evidence_counts": "SELECT user_id AS target, event_type AS kind, count(DISTINCT event_id) AS n FROM events GROUP BY ALL",
    "stream_hourly_actions": "SELECT date_trunc('hour', ts) AS start, event_type AS key, count(*) AS n FROM events GROUP BY ALL",
}
