"""Streaming twins of the batch operators: file streams drained with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintforge.sources.stores import shared_folder


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the event file(s), with event time and a watermark of four hours."""
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder) if not path.endswith("/") else spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "4 hours")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream to the end of its input and return its final table, from Parquet in the shared folder.

    Offsets and state are kept there too.  A batch replaces its own folder (in mode complete, the whole table), so one
    that runs again changes nothing.
    """
    spark, place = stream.sparkSession, shared_folder(stream.sparkSession)
    schema = stream.schema

    def store(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/batch={0 if mode == 'complete' else number}")

    run = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{place}-offsets").trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    finally:
        run.stop()
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{place}/batch=-1")
    return spark.read.schema(schema).parquet(f"{place}/batch=*")


def hourly_counts(spark: SparkSession, path: str) -> DataFrame:
    """(start second, event_type, n, value) of each hour."""
    counts = events_stream(spark, path).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return drained(counts).select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))
