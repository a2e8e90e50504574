"""Incremental forms of three batch jobs, on Structured Streaming.

State is bounded: replays are dropped within the watermark, and aggregates keep one row for each key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalogspark.operators import sync


def approval_stream(events: DataFrame, item: str, at: list[str], approve: str, revoke: str) -> DataFrame:
    """(item, approved): last approval event of each item so far. For update or complete mode."""
    some = events.filter(F.col("action").isin(approve, revoke))
    return some.groupBy(item).agg((F.max_by("action", F.struct(*at)) == approve).alias("approved"))


def evidence_stream(evidence: DataFrame, target: list[str], ident: str, at: str, late: str = "1 day") -> DataFrame:
    """(target..., kind, n): evidence counted once for each id, replays within `late` dropped. For update or complete mode."""
    fresh = evidence.withWatermark(at, late).dropDuplicatesWithinWatermark([ident])
    return fresh.groupBy(*target, "kind").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, at: str, by: Column, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, n): events in tumbling windows of event time. Append mode gives a window once it is over."""
    out = events.withWatermark(at, late).groupBy(F.window(at, width), by.alias("key")).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "key", "n")


def changed_records(records: DataFrame, cache_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Writes records that are new or changed against a cache table, and a new version of the cache, batch by batch.

    Both outputs carry the batch id as a partition, so a batch that is tried again overwrites its own folders. The
    cache is append-only; the latest batch of a record wins.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = sync.first_wins(batch, ["source_id", "record_id"])
        cache = spark.read.schema("source_id string, record_id string, checksum string, etag string, batch long").parquet(cache_path).filter(F.col("batch") < number)
        last = cache.groupBy("source_id", "record_id").agg(F.max_by(F.struct("checksum", "etag"), "batch").alias("c")).select("source_id", "record_id", "c.*")
        new = sync.changed(first, last).persist()
        new.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        new.select("source_id", "record_id", "checksum", "etag").write.mode("overwrite").parquet(f"{cache_path}/batch={number}")
        new.unpersist()

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
