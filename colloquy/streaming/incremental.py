"""Structured Streaming variants of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import resume
from ..sources.io import path_exists

KEY_BUCKETS = 1024


def append_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "id"):
    """Transforms arriving JSON files and appends rows whose key the sink does not hold yet.

    Exactly once per key: a batch that runs again finds its keys in the sink. The sink is partitioned by
    key_bucket, a hash of the key; a batch reads only the keys of the buckets that it touches. Returns the
    started query, which ends when all files present are done.
    """

    def write(batch: DataFrame, _: int) -> None:
        made = transform(batch).dropDuplicates([key]).withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int"))
        made = made.persist()
        if path_exists(spark, sink):
            touched = [r[0] for r in made.select("key_bucket").distinct().collect()]  # at most KEY_BUCKETS
            known = spark.read.parquet(sink).filter(F.col("key_bucket").isin(touched)).select(key)
            resume(made, known, key).write.mode("append").partitionBy("key_bucket").parquet(sink)
        else:
            made.write.mode("append").partitionBy("key_bucket").parquet(sink)
        made.unpersist()

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window_start, kind, n, value_sum) of event-time windows; later rows than *late* are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")).select(F.col("w.start").alias("window_start"), kind, "n", "value_sum")


def first_per_key(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of every key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
