"""Continuous ingest: deduplicated entries, windowed counts, draining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY_BUCKETS = 256
WATERMARK = "2 hours"


def event_time(stream: DataFrame, time: str) -> DataFrame:
    """Zone-free times become timestamps, which watermarks need."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def deduplicated(stream: DataFrame, time: str, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """First row per key within the watermark; state older than it is dropped."""
    return event_time(stream, time).withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def write_new(known_path: str, keys: list[str], buckets: int = KEY_BUCKETS) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that also drops keys already in the stored table.

    The table is laid out by a hash bucket of the keys, and a batch reads only
    the buckets that its own keys fall into.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("key_bucket")

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.select("*", bucket)
        touched = [r["key_bucket"] for r in fresh.select("key_bucket").distinct().collect()]  # at most `buckets` numbers
        try:
            known = batch.sparkSession.read.schema(fresh.schema).parquet(known_path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            known = None
        if known is not None:
            own = known.where(F.col("key_bucket").isin(touched)).select(*keys, "key_bucket")
            fresh = fresh.join(own, [*keys, "key_bucket"], "left_anti").select(fresh.columns)
        fresh.write.mode("append").partitionBy("key_bucket").parquet(known_path)

    return write


def hourly_counts(stream: DataFrame, time: str, status: str, watermark: str = WATERMARK) -> DataFrame:
    """Rows per hour and status (tumbling windows)."""
    hours = F.window(F.col(time), "1 hour")
    return (
        event_time(stream, time).withWatermark(time, watermark)
        .groupBy(hours.alias("w"), status)
        .agg(F.count("*").alias("count"))
        .select(F.col("w.start").alias("hour"), status, "count")
    )


def rolling_counts(stream: DataFrame, time: str, width: str = "7 days", slide: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """Rows per sliding window."""
    return (
        event_time(stream, time).withWatermark(time, watermark)
        .groupBy(F.window(F.col(time), width, slide).alias("w"))
        .agg(F.count("*").alias("count"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")
    )


def requests_over_limit(stream: DataFrame, client: str, time: str, limit: int, width: str, watermark: str = WATERMARK) -> DataFrame:
    """Windows in which a client went over its request limit."""
    return (
        event_time(stream, time).withWatermark(time, watermark)
        .groupBy(client, F.window(F.col(time), width).alias("w"))
        .agg(F.count("*").alias("requests"))
        .where(F.col("requests") > limit)
        .select(client, F.col("w.start").alias("window_start"), "requests")
    )


def drain(stream: DataFrame, checkpoint: str, writer: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process everything available now, in batches, then stop."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(writer).start()
    )
    query.awaitTermination()
    return query
